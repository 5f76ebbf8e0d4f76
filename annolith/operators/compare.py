"""Two models on the same objects: outcome transitions, false-positive association, metric deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.functions.geometry import iou
from annolith.operators.matching import greedy, leftovers, match, object_outcomes, prefixed

# Outcome of model A, outcome of model B, name of the transition.
TRANSITIONS = [
    ("CORRECT", "CORRECT", "CORRECT_IN_BOTH"),
    ("CORRECT", "CLASS_CONFUSION", "CORRECT_IN_A_WRONG_IN_B"),
    ("CORRECT", "MISSED", "CORRECT_IN_A_MISSED_IN_B"),
    ("CLASS_CONFUSION", "CORRECT", "A_CLASS_CONFUSION_B_CORRECT"),
    ("CLASS_CONFUSION", "CLASS_CONFUSION", "STILL_MISSED_BY_B"),
    ("CLASS_CONFUSION", "MISSED", "STILL_MISSED_BY_B"),
    ("MISSED", "CORRECT", "RECOVERED_BY_B"),
    ("MISSED", "CLASS_CONFUSION", "A_MISSED_B_CLASS_CONFUSION"),
    ("MISSED", "MISSED", "STILL_MISSED_BY_B"),
]


def transitions(gt: DataFrame, pred_a: DataFrame, pred_b: DataFrame) -> DataFrame:
    """img, j, c, a, b, transition of every object."""
    a = object_outcomes(gt, pred_a).select("img", "j", "c", F.col("outcome").alias("a"))
    b = object_outcomes(gt, pred_b).select("img", "j", F.col("outcome").alias("b"))
    named = F.create_map(*[F.lit(x) for one, two, name in TRANSITIONS for x in (f"{one} {two}", name)])
    return a.join(b, ["img", "j"]).withColumn("transition", named[F.concat_ws(" ", "a", "b")])


def false_positive_transitions(gt: DataFrame, pred_a: DataFrame, pred_b: DataFrame, least: float = 0.5) -> DataFrame:
    """img, category, i_a, i_b, iou: the models' false positives paired by falling overlap (ties to low indices); the rest are NEW or REMOVED."""
    extra_a, extra_b = leftovers(pred_a, match(gt, pred_a), "i"), leftovers(pred_b, match(gt, pred_b), "i")
    x, y = prefixed(extra_a, "a_"), prefixed(extra_b, "b_")
    close = x.join(y, F.expr("a_img = b_img and a_c = b_c")).withColumn("iou", F.expr(iou("a_", "b_"))).where(F.col("iou") >= least)
    taken = greedy(close.select(F.col("a_img").alias("img"), F.col("a_i").alias("i"), F.col("b_i").alias("j"), "iou"), [-F.col("iou"), F.col("i"), F.col("j")])
    kept = taken.select("img", F.lit("PERSISTENT_FALSE_POSITIVE").alias("category"), F.col("i").alias("i_a"), F.col("j").alias("i_b"), "iou")
    gone = leftovers(extra_a, taken, "i").select("img", F.lit("REMOVED_FALSE_POSITIVE_IN_B").alias("category"), F.col("i").alias("i_a"), F.lit(None).cast("int").alias("i_b"), F.lit(None).cast("double").alias("iou"))
    new = leftovers(extra_b, taken.select("img", F.col("j").alias("i")), "i").select("img", F.lit("NEW_FALSE_POSITIVE_IN_B").alias("category"), F.lit(None).cast("int").alias("i_a"), F.col("i").alias("i_b"), F.lit(None).cast("double").alias("iou"))
    return kept.unionByName(gone).unionByName(new)


def metric_deltas(points: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, a, b, delta (a - b) from rows of models A and B."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = points.select("model", *keys, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, v)"))
    wide = long.groupBy(*keys, "metric").pivot("model", ["A", "B"]).agg(F.first("v"))
    return wide.select(*keys, "metric", F.col("A").alias("a"), F.col("B").alias("b"), (F.col("A") - F.col("B")).alias("delta"))


def distribution(rows: DataFrame, column: str, subset: str) -> DataFrame:
    """value, n_all, n_subset and their shares: the whole population against the rows where ``subset`` holds."""
    g = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_all"), F.count_if(F.expr(subset)).alias("n_subset"))
    t = g.agg(F.sum("n_all").alias("t_all"), F.sum("n_subset").alias("t_subset"))
    return g.crossJoin(F.broadcast(t)).select("value", "n_all", "n_subset", F.expr("try_divide(cast(n_all as double), t_all)").alias("share_all"), F.expr("coalesce(try_divide(cast(n_subset as double), t_subset), 0D)").alias("share_subset"))
