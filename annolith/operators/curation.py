"""From reviewed pairs to a curated dataset: pairs and their reviews, manifest, exclusions, mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.functions.text import hamming
from annolith.operators.review import SPLIT_PRIORITY
from annolith.sources.work import Work


def pair_key(a: str, b: str) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string")))


def group_signature(members: DataFrame, group: str, key: str, signature: str) -> DataFrame:
    """group, group_size, least, differs: whether the members' signatures are not all one.  Groups of one are left out."""
    g = members.groupBy(group).agg(F.count("*").alias("group_size"), F.min(key).alias("least"), (F.min(signature) != F.max(signature)).alias("differs"))
    return g.where("group_size > 1")


def pairs_within(members: DataFrame, group: str, key: str, hash_: str) -> DataFrame:
    """group, a, b, distance of the hashes of all member pairs: for groups known to be small; see ``least_distances`` for others."""
    a, b = members.select(F.col(group), F.col(key).alias("a"), F.col(hash_).alias("ha")), members.select(F.col(group).alias("g_b"), F.col(key).alias("b"), F.col(hash_).alias("hb"))
    return a.join(b, F.expr(f"{group} = g_b and a < b")).select(group, "a", "b", F.expr(hamming("ha", "hb")).alias("distance"))


def least_distances(spark: SparkSession, members: DataFrame, group: str, key: str, hash_: str, pairs_up_to: int = 512) -> DataFrame:
    """group, n, n_pairs, least_distance of the 64-bit hashes of groups of any size (of two members and more), exact.

    A group in which a hash occurs twice has distance 0.  Groups of at most ``pairs_up_to`` hashes compare all pairs.  Larger ones use an index of four chunks of 16 bits
    and radii that grow: if two hashes differ by at most 4 * k + 3 bits, some chunk of theirs differs by at most k, so round k looks
    every chunk up with exactly k bits changed, and a group is done when its least distance so far is at most 4 * k + 3.  Lists of hashes are never gathered; a
    round's look-ups are 4 * (16 over k) rows a hash, and few groups reach k = 3.
    """
    work = Work(spark, "least-distances")
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(hash_).alias("d_")).where("n > 1")
    sizes = work.table(sizes, "sizes")
    one = members.select(F.col(group).alias("g_"), F.col(hash_).alias("h_")).distinct().join(sizes.where("d_ = n").select(F.col(group).alias("s_"), "n"), F.col("g_") == F.col("s_")).drop("s_")
    one = work.table(one, "hashes")
    few, many = one.where(F.col("n") <= pairs_up_to).drop("n"), one.where(F.col("n") > pairs_up_to).drop("n")
    told = few.alias("a").join(few.alias("b"), F.expr("a.g_ = b.g_ and a.h_ < b.h_")).groupBy(F.col("a.g_").alias("g_")).agg(F.min(F.expr(hamming("a.h_", "b.h_"))).alias("least"))
    best = None
    for k in range(17):
        if many.isEmpty():
            break
        masks = [m for m in range(1 << 16) if m.bit_count() == k]  # 12,870 at most
        chunks = many.select("g_", "h_", F.posexplode(F.array(*[F.expr(f"cast(shiftrightunsigned(h_, {16 * c}) & 65535 as int)") for c in range(4)])).alias("c", "v"))
        wanted = chunks.join(F.broadcast(spark.createDataFrame([(m,) for m in masks], "m int"))).select(F.col("g_").alias("x_"), F.col("h_").alias("y_"), F.col("c").alias("xc"), F.expr("v ^ m").alias("xv")) if k else chunks.toDF("x_", "y_", "xc", "xv")
        met = chunks.join(wanted, F.expr("g_ = x_ and c = xc and v = xv and h_ < y_")).groupBy("g_").agg(F.min(F.expr(hamming("h_", "y_"))).alias("least"))
        best = work.table(met if best is None else best.unionByName(met).groupBy("g_").agg(F.min("least").alias("least")), f"best-{k}")
        done = best.where(F.col("least") <= 4 * k + 3).select(F.col("g_").alias("done_"))
        many = work.table(many.join(done, F.col("g_") == F.col("done_"), "left_anti"), f"open-{k}")
    if best is not None:
        told = told.unionByName(best)
    least = F.when(F.col("d_") < F.col("n"), 0).otherwise(F.col("least"))
    return sizes.join(told, F.col(group) == F.col("g_"), "left").select(group, "n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), least.cast("int").alias("least_distance"))


def classified_pairs(pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Cross-split pairs (a, b, split_a, split_b) with review_status and review_id; reviewed: a, b, review_id, decision in either order.

    Only a pair that was reviewed itself and decided KEEP_BOTH is reviewed.
    """
    kept = reviewed.where("decision = 'KEEP_BOTH'").select(pair_key("a", "b").alias("r_key"), "review_id").groupBy("r_key").agg(F.min("review_id").alias("review_id"))
    crossed = pairs.where("not (split_a <=> split_b)").withColumn("p_key", pair_key("a", "b"))
    out = crossed.join(kept, F.col("p_key") == F.col("r_key"), "left").drop("p_key", "r_key")
    return out.withColumn("review_status", F.when(F.col("review_id").isNotNull(), "REVIEWED_KEEP_BOTH_CANDIDATE").otherwise("UNREVIEWED_CROSS_SPLIT_CANDIDATE"))


def _sides(decided: DataFrame) -> DataFrame:
    """Each decided pair as seen from both its images: review_id, decision, notes, image, split, paired, paired_split, action."""
    side = lambda x, y, gone: F.struct(F.col(x).alias("image"), F.col(f"split_{x}").alias("split"), F.col(y).alias("paired"), F.col(f"split_{y}").alias("paired_split"), F.when(F.col("decision") == gone, "EXCLUDE").when(F.col("decision").isin("KEEP_BOTH", "KEEP_A_EXCLUDE_B", "KEEP_B_EXCLUDE_A"), "KEEP").alias("action"))
    return decided.select("review_id", "decision", "notes", F.explode(F.array(side("a", "b", "KEEP_B_EXCLUDE_A"), side("b", "a", "KEEP_A_EXCLUDE_B"))).alias("s")).select("review_id", "decision", "notes", "s.*")


def curated_manifest(images: DataFrame, decided: DataFrame) -> DataFrame:
    """image, split, action, curated_split, reason, review_id, decision (of all its reviews in their order, joined by |), paired_with, paired_split.

    images: image, split, each once.  An image that any review excludes is excluded.
    """
    seen = _sides(decided).where("action is not null")
    # Reviews of one image: as many as it has near duplicates that a person has looked at.
    per = seen.groupBy(F.col("image").alias("s_image")).agg(F.max(F.col("action") == "EXCLUDE").alias("gone"), F.array_sort(F.collect_list(F.struct("review_id", "decision", "paired", "paired_split"))).alias("e"))
    j = images.join(per, F.col("image") == F.col("s_image"), "left")
    text = lambda f: F.coalesce(F.array_join(F.transform("e", lambda x: x[f].cast("string")), "|"), F.lit(""))
    gone = F.coalesce("gone", F.lit(False))
    return j.select("image", "split", F.when(gone, "EXCLUDE").otherwise("KEEP").alias("action"), F.when(gone, "").otherwise(F.col("split")).alias("curated_split"),
                    F.when(F.col("e").isNotNull(), "Human-reviewed P0 decision").otherwise("Retained without changes; no P0 exclusion").alias("reason"),
                    text("review_id").alias("review_id"), text("decision").alias("decision"), text("paired").alias("paired_with"), text("paired_split").alias("paired_split"))


def exclusions(manifest: DataFrame) -> DataFrame:
    return manifest.where("action = 'EXCLUDE'").select("image", F.col("split").alias("original_split"), "review_id", "decision", "reason", "paired_with", "paired_split")


def dataset_totals(manifest: DataFrame, counts: list[str]) -> DataFrame:
    """Images and objects of each class by split and overall (split null), before and after curation."""
    kept = F.col("action") == "KEEP"
    sums = [F.count("*").alias("images"), F.count_if(kept).alias("curated_images")]
    for c in counts:
        sums += [F.sum(c).alias(c), F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)).alias(f"curated_{c}")]
    return manifest.rollup("split").agg(*sums)


def correction_states(decided: DataFrame) -> DataFrame:
    """image, state of what a policy correction must look at: CONFLICT (kept and excluded), MISMATCH (excluded though its split ranks higher), NEEDS_REVIEW.

    Needs review: a mismatch without notes, an exclusion within one split or from an unknown one, and both images of a pair without final decision.
    """
    s = _sides(decided)
    rank = lambda c: F.expr(f"case {c} when 'test' then 3 when 'valid' then 2 when 'train' then 1 else 0 end")
    gone = F.col("action") == "EXCLUDE"
    against = gone & (rank("split") > rank("paired_split"))
    conflict = s.groupBy("image").agg(F.count_distinct("action").alias("k")).where("k > 1").select("image", F.lit("CONFLICT").alias("state"))
    mismatch = s.where(against).select("image", F.lit("MISMATCH").alias("state"))
    unclear = (against & (F.trim(F.coalesce("notes", F.lit(""))) == "")) | (gone & ((rank("split") == 0) | (rank("paired_split") == 0) | F.col("split").eqNullSafe(F.col("paired_split")))) | F.col("decision").isin("PENDING", "REVIEW_MORE")
    needs = s.where(unclear).select("image", F.lit("NEEDS_REVIEW").alias("state"))
    return conflict.unionByName(mismatch).unionByName(needs).distinct()


def mismatch_groups(decided: DataFrame) -> DataFrame:
    """image, split, review_id: all reviews of the mismatched images of test and valid."""
    wrong = correction_states(decided).where("state = 'MISMATCH'").select(F.col("image").alias("m_image"))
    return _sides(decided).where("split in ('test', 'valid')").join(wrong, F.col("image") == F.col("m_image"), "left_semi").select("image", "split", "review_id")


def suggestion(split_a: str, split_b: str) -> Column:
    """What the split priority would suggest: never decided by itself."""
    a, b = SPLIT_PRIORITY.format(split_a), SPLIT_PRIORITY.format(split_b)
    return F.expr(f"case when ({a}) > ({b}) then 'KEEP_A_EXCLUDE_B' when ({b}) > ({a}) then 'KEEP_B_EXCLUDE_A' else 'REVIEW_MORE' end")


def image_findings(images: DataFrame, labels: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """split, name, issue, severity of image files (split, name, stem, suffix, readable) and label files (split, stem, readable).

    ORPHAN_LABEL, UNSUPPORTED_EXTENSION, AMBIGUOUS_LABEL_PAIRING (several images of one stem), IMAGE_UNREADABLE, MISSING_LABEL, LABEL_UNREADABLE,
    MISSING_DIRECTORY (a split that has images or labels alone).
    """
    fine = images.where(F.lower("suffix").isin(*suffixes))
    n = F.count("*").over(Window.partitionBy("split", "stem"))
    row = lambda df, name, issue, severity="ERROR": df.select("split", F.col(name).alias("name"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))
    l = labels.select(F.col("split").alias("l_split"), F.col("stem").alias("l_stem"), F.col("readable").alias("l_readable"))
    on = F.expr("split = l_split and stem = l_stem")
    i = fine.select(F.col("split").alias("i_split"), F.col("stem").alias("i_stem")).distinct()
    parts = [
        row(labels.join(i, F.expr("split = i_split and stem = i_stem"), "left_anti"), "stem", "ORPHAN_LABEL"),
        row(images.where(~F.lower("suffix").isin(*suffixes)), "name", "UNSUPPORTED_EXTENSION", "REVIEW"),
        row(fine.withColumn("n", n).where("n > 1"), "name", "AMBIGUOUS_LABEL_PAIRING"),
        row(fine.where("not readable"), "name", "IMAGE_UNREADABLE"),
        row(fine.join(l, on, "left_anti"), "name", "MISSING_LABEL"),
        row(fine.join(l, on).where("not l_readable"), "name", "LABEL_UNREADABLE"),
    ]
    a, b = images.select("split").distinct(), labels.select("split").distinct()
    parts.append(row(a.join(b, "split", "left_anti").unionByName(b.join(a, "split", "left_anti")), "split", "MISSING_DIRECTORY"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
