"""Review queues, decisions and curation: the human is a table of decisions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.functions.text import stable_id

#: Of two splits the one whose copy is kept.
SPLIT_PRIORITY = "case {0} when 'test' then 3 when 'valid' then 2 else 1 end"
DECISIONS = ("KEEP_BOTH", "KEEP_A_EXCLUDE_B", "KEEP_B_EXCLUDE_A")


def review_queue(pairs: DataFrame, flagged: DataFrame, groups: DataFrame) -> DataFrame:
    """priority, review_id, subject, evidence: P0 pairs (a, b), P1 flagged items (name, reason), P3 groups (name, n).

    Cases of one id are one case whose evidence is the union, sorted.
    """
    row = lambda df, p, subject, why: df.select(F.lit(p).alias("priority"), subject.alias("subject"), why.alias("why"))
    both = F.concat_ws("|", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    cases = row(pairs, "P0", both, F.lit("near duplicate")).unionByName(row(flagged, "P1", F.col("name").cast("string"), F.col("reason"))).unionByName(row(groups, "P3", F.col("name").cast("string"), F.lit("source group")))
    one = cases.groupBy("priority", "subject").agg(F.array_join(F.array_sort(F.collect_set("why")), "|").alias("evidence"))
    return one.select("priority", stable_id(F.col("priority"), F.col("subject"), length=16).alias("review_id"), "subject", "evidence")


def validate_decisions(queue: DataFrame, decisions: DataFrame, allowed: tuple[str, ...] = (*DECISIONS, "PENDING")) -> DataFrame:
    """review_id, problem: DUPLICATE, UNKNOWN_CASE, INVALID_DECISION, MISSING.  Empty if all is well."""
    n = F.count("*").over(Window.partitionBy("review_id"))
    repeated = decisions.withColumn("n_", n).where("n_ > 1").select("review_id", F.lit("DUPLICATE").alias("problem")).distinct()
    unknown = decisions.join(queue.select("review_id"), "review_id", "left_anti").select("review_id", F.lit("UNKNOWN_CASE").alias("problem")).distinct()
    invalid = decisions.where(~F.col("decision").isin(*allowed)).select("review_id", F.lit("INVALID_DECISION").alias("problem")).distinct()
    missing = queue.join(decisions.select("review_id"), "review_id", "left_anti").select("review_id", F.lit("MISSING").alias("problem"))
    return repeated.union(unknown).union(invalid).union(missing)


def merge_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every case with its decision so far, PENDING if there is none."""
    old = decisions.select(F.col("review_id").alias("d_id"), F.col("decision").alias("d"))
    return queue.join(old, F.col("review_id") == F.col("d_id"), "left").select("review_id", "priority", F.coalesce("d", F.lit("PENDING")).alias("decision"))


def latest_decisions(log: DataFrame) -> DataFrame:
    """An append-only log (review_id, decision, ts): the latest entry of each case."""
    return log.groupBy("review_id").agg(F.max_by("decision", F.struct("ts", "decision")).alias("decision"))


def decision_progress(merged: DataFrame) -> DataFrame:
    return merged.groupBy("priority").agg(F.count("*").alias("n_cases"), F.count_if(F.col("decision") != "PENDING").alias("n_decided"), F.count_if(F.col("decision") == "PENDING").alias("n_pending"))


def image_actions(decided: DataFrame) -> DataFrame:
    """image, action, n_votes, conflict from decided pairs (a, b, decision): each pair votes on both its images; differing votes are a conflict."""
    vote = lambda name, side: F.struct(F.col(name).alias("image"), F.when(F.col("decision") == side, "EXCLUDE").otherwise("KEEP").alias("action"))
    votes = decided.select(F.explode(F.array(vote("a", "KEEP_B_EXCLUDE_A"), vote("b", "KEEP_A_EXCLUDE_B"))).alias("v")).select("v.*")
    g = votes.groupBy("image").agg(F.count("*").alias("n_votes"), F.count_distinct("action").alias("k"), F.min("action").alias("least"))
    return g.select("image", F.when(F.col("k") > 1, "CONFLICT").otherwise(F.col("least")).alias("action"), "n_votes", (F.col("k") > 1).alias("conflict"))


def curation_plan(images: DataFrame, actions: DataFrame, key: str = "image") -> DataFrame:
    """All images with their action; KEEP without a vote."""
    a = actions.select(F.col("image").alias("a_image"), F.col("action").alias("a_action"))
    return images.join(a, F.col(key) == F.col("a_image"), "left").select(*images.columns, F.coalesce("a_action", F.lit("KEEP")).alias("action"))


def policy_summary(decided: DataFrame, split_a: str, split_b: str) -> DataFrame:
    """How decisions agree with the rule that the copy in the split of higher priority stays: direction, n_pairs, n_excluded (distinct images)."""
    pa, pb = SPLIT_PRIORITY.format(split_a), SPLIT_PRIORITY.format(split_b)
    wanted = f"case when ({pa}) > ({pb}) then 'KEEP_A_EXCLUDE_B' when ({pb}) > ({pa}) then 'KEEP_B_EXCLUDE_A' else 'KEEP_BOTH' end"
    out = decided.withColumn("direction", F.expr(f"case when decision = 'KEEP_BOTH' then 'KEPT' when decision = {wanted} then 'FOLLOWS_RULE' else 'AGAINST_RULE' end")).withColumn("gone", F.expr("case decision when 'KEEP_A_EXCLUDE_B' then b when 'KEEP_B_EXCLUDE_A' then a end"))
    return out.groupBy("direction").agg(F.count("*").alias("n_pairs"), F.count_distinct("gone").alias("n_excluded"))


def readiness(checks: DataFrame) -> DataFrame:
    """One row from (name, passed): how many checks fail and whether all pass."""
    return checks.agg(F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.bool_and("passed").alias("ready"))


def label_counts(rows: DataFrame, column: str, separator: str = r"\|") -> DataFrame:
    """How many rows carry each of the labels of a separated list."""
    return rows.select(F.explode(F.array_distinct(F.split(column, separator))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def round_robin(rows: DataFrame, key: str, criteria: dict[str, Column], limit: int) -> DataFrame:
    """Up to ``limit`` distinct keys, taken in turn from several rankings: key, criterion, turn.

    criteria: a sort expression each (null: not in that ranking).  In each turn every criterion in order takes the first of its ranking
    that nobody has taken; a ranking that is used up takes nothing.  At most ``limit`` keys are ever taken, so the
    first ``limit`` places of each ranking are all that can be chosen, and these few rows are dealt out in one task.
    """
    names = list(criteria)
    tops = None
    for k, order in enumerate(criteria.values()):
        part = rows.withColumn("o_", order).where("o_ is not null").orderBy("o_", key).limit(limit)
        ranked = part.select(F.col(key), F.lit(k).alias("k_"), F.row_number().over(Window.orderBy("o_", key)).alias("place"))  # ``limit`` rows
        tops = ranked if tops is None else tops.unionByName(ranked)

    def deal(table):
        rankings = [[] for _ in names]
        for r in sorted(table.to_pylist(), key=lambda r: r["place"]):
            rankings[r["k_"]].append(r[key])
        taken, out, turn = set(), [], 0
        while len(out) < limit:
            turn += 1
            for k, ranking in enumerate(rankings):
                found = next((x for x in ranking if x not in taken), None)
                if found is not None and len(out) < limit:
                    taken.add(found)
                    out.append((found, names[k], turn))
            if not out or out[-1][2] < turn:
                break
        return pa.table({key: pa.array([x for x, _, _ in out], table.schema.field(key).type), "criterion": pa.array([c for _, c, _ in out], pa.string()), "turn": pa.array([t for _, _, t in out], pa.int32())})

    kind = rows.schema[key].dataType.simpleString()
    return tops.withColumn("one_", F.lit(0)).groupBy("one_").applyInArrow(deal, f"{key} {kind}, criterion string, turn int")


def tier_quota_sample(images: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """The first images of each tier: those with hard objects of class 1 first, most of them first, then by name."""
    w = Window.partitionBy("tier").orderBy(F.desc(F.col("n_hard1") > 0), F.desc("n_hard1"), "img")
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return images.where(F.col("tier").isin(*quotas)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota[F.col("tier")])
