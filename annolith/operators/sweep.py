"""Threshold sweeps and what is chosen from them.

Greedy matching goes by falling score, so the matches at a threshold are those
of the full match whose score reaches it: one fold for each image gives the
whole curve, read off as running sums over distinct scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.functions.geometry import iou
from annolith.operators.matching import edges, taken_edges, taken_of
from annolith.operators.ranges import BLOCKS, carried, even_blocks
from annolith.sources.work import Work


def ratios(df: DataFrame, n_images: Column | None = None) -> DataFrame:
    """Adds precision, recall, f1 (0 where undefined) and fp_per_image."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)})
    return out if n_images is None else out.withColumn("fp_per_image", part(fp, n_images))


def scored_predictions(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """pred with tp: whether the full match takes it."""
    m = taken_edges(edges(gt, pred, least), [-F.col("s"), F.col("i"), -F.col("iou"), F.col("j")]).select(F.col("img").alias("m_img"), F.transform("m", lambda x: x["i"]).alias("m_is"))
    joined = pred.join(m, F.expr("img = m_img"), "left")  # by the image alone, as the boxes lie already
    return joined.select(*pred.columns, F.coalesce(F.array_contains("m_is", F.col("i")), F.lit(False)).cast("int").alias("tp"))


def sweep(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """scope (class as text, or Overall), threshold, tp, fp, fn, precision, recall, f1, fp_per_image at every distinct score."""
    box = lambda df: F.struct(*[c for c in df.columns if c != "img"])
    rows = gt.select("img", box(gt).alias("gt")).unionByName(pred.select("img", box(pred).alias("pred")), allowMissingColumns=True)
    return sweeps(rows.withColumn("nth", F.row_number().over(Window.partitionBy("img").orderBy("img"))), ("pred",), least).drop("model")


def sweeps(rows: DataFrame, models: tuple[str, ...], least: float = 0.5) -> DataFrame:
    """``sweep`` of several models on the same objects, with model.  rows: img, nth (from 1 in each image), a struct gt (j, c, x1, y1, x2, y2) and one named as each model (i, c, s, x1, y1, x2, y2), null where a row has none.

    Rows are shuffled by image once, whatever the number of models, and all that the curves need is counted in that one pass: predictions by scope and score,
    objects by scope, images.  The running sum goes by score ranges (BLOCKS of them) and within each, so no task sees a whole curve.
    """
    # Written once: the matching that it comes from is read for the blocks, for the rows and for the totals.
    counts = Work(rows.sparkSession, "sweep").table(_counts(rows, models, least).withColumn("block", F.floor(F.col("threshold") * BLOCKS)), "counts")
    steps = counts.where("what = 'prediction'").select("model", "scope", "threshold", "t", "n", "block")
    above = Window.partitionBy("model", "scope").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy("model", "scope", "block").agg(F.sum("t").alias("bt"), F.sum("n").alias("bn"))
    blocks = blocks.select(F.col("model").alias("b_model"), F.col("scope").alias("b_scope"), F.col("block").alias("b_block"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("t0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("model", "scope", "block").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.join(F.broadcast(blocks), F.expr("model = b_model and scope = b_scope and block = b_block"))  # BLOCKS + 1 rows a model and scope at most
    tp, n = F.col("t0") + F.sum("t").over(w), F.col("n0") + F.sum("n").over(w)
    curve = placed.select("model", "scope", "threshold", tp.alias("tp"), (n - tp).alias("fp"))
    totals = counts.where("what = 'object'").select(F.col("scope").alias("g_scope"), F.col("n").alias("n_gt"))
    images = counts.where("what = 'image'").select(F.col("model").alias("n_model"), F.col("n").alias("n_images"))
    joined = curve.join(F.broadcast(totals), F.expr("scope = g_scope")).join(F.broadcast(images), F.expr("model = n_model"))  # one row for each class; for each model
    return ratios(joined.withColumn("fn", F.col("n_gt") - F.col("tp")), F.col("n_images")).select("scope", "threshold", "tp", "fp", "fn", "precision", "recall", "f1", "fp_per_image", "model")


def _counts(rows: DataFrame, models: tuple[str, ...], least: float) -> DataFrame:
    """what, model, scope, threshold, t, n: predictions (n, of which t are matched) by model, scope and score, objects by scope, images by model (those with an object or a prediction of it)."""
    boxes = ["gt", *models]
    # As a window, which reads rows as nth has left them, sorted by image; an aggregate of arrays would sort them before the shuffle and again after it.
    whole = Window.partitionBy("img")
    images = rows.select("img", "nth", *[F.collect_list(c).over(whole).alias(c) for c in boxes]).where("nth = 1")
    overlap = iou("g.", "p.")
    edge = f"struct(-p.s as o, p.i as i, -({overlap}) as v, g.j as j)"
    ranked = f"sort_array(filter(flatten(transform({{0}}, p -> transform(filter(gt, g -> g.c = p.c and img is not null), g -> {edge}))), e -> -e.v >= {least}D))"
    images = images.select("img", *boxes, *[F.expr(ranked.format(m)).alias(f"{m}_e") for m in models])
    images = images.select(*boxes, *[taken_of(f"{m}_e").alias(f"{m}_m") for m in models])
    # Counted by class first, without names, as every box passes here: of is 0 for objects, k for predictions of model k and -k for its images.
    entry = "struct({0} as of, {1} as c, {2} as s, {3} as t)"
    c, s = (f"cast(null as {kinds[x].dataType.simpleString()})" for kinds in [rows.schema[models[0]].dataType] for x in "cs")
    found = [f"transform(gt, g -> {entry.format(0, 'g.c', s, 0)})"]
    for k, m in enumerate(models, 1):
        found.append(f"transform({m}, p -> {entry.format(k, 'p.c', 'p.s', f'int(exists({m}_m, e -> e.i = p.i))')})")
        found.append(f"if(size(gt) + size({m}) > 0, array({entry.format(-k, c, s, 0)}), array())")
    each = images.select(F.expr(f"explode(concat({', '.join(found)}))").alias("x")).select("x.*")
    counted = each.groupBy("of", "c", "s").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    scopes = F.expr("explode(if(of < 0, array(string(null)), array(string(c), 'Overall')))").alias("scope")
    named = counted.select("of", scopes, F.col("s").alias("threshold"), "t", "n").groupBy("of", "scope", "threshold").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    what, model = "case when of = 0 then 'object' when of > 0 then 'prediction' else 'image' end as what", f"get(array({', '.join(map(repr, models))}), abs(of) - 1) as model"
    return named.selectExpr(what, model, "scope", "threshold", "t", "n")


def at_grid(curve: DataFrame, first: int = 5, last: int = 90) -> DataFrame:
    """The curve at the thresholds i / 100: the state of the lowest distinct score at or above each.

    Between two grid points only the lowest score counts, so scores are first reduced to one for each hundredth;
    what is left (a hundred rows or so a scope) is carried on in falling order.
    """
    spark = curve.sparkSession
    grid = spark.range(first, last + 1).select((F.col("id") / F.lit(100.0)).alias("threshold")).crossJoin(F.broadcast(curve.select("scope").distinct()))  # one row a class
    values = [c for c in curve.columns if c not in ("scope", "threshold")]
    # The grid point that a score serves first: the largest i with i / 100 <= score.
    guess = F.floor(F.col("threshold") * 100)
    step = F.when((guess + 1) / F.lit(100.0) <= F.col("threshold"), guess + 1).when(guess / F.lit(100.0) > F.col("threshold"), guess - 1).otherwise(guess)
    lowest = curve.groupBy("scope", step.alias("step")).agg(F.min("threshold").alias("threshold"), F.min_by(F.struct(*values), "threshold").alias("v")).select("scope", "threshold", "v.*")
    both = lowest.withColumn("is_grid", F.lit(0)).unionByName(grid.withColumn("is_grid", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("scope").orderBy(F.desc("threshold"), "is_grid").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("scope", "threshold", "is_grid", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in values]).where("is_grid = 1").drop("is_grid").where("tp is not null")


def best_point(curve: DataFrame, by: str = "f1", keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """The row of the largest value; ties go to higher recall, precision, threshold."""
    rest = [c for c in curve.columns if c not in keys]
    top = curve.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, "recall", "precision", "threshold")).alias("b"))
    return top.select(*keys, "b.*")


def precision_floor(curve: DataFrame, floor: float, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    return best_point(curve.where((F.col("tp") + F.col("fp") > 0) & (F.col("precision") >= floor)), "recall", keys)


def operating_points(curve: DataFrame, target: str = "1", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """One row for each model and threshold: the target class's and the overall figures side by side (t_ and o_)."""
    cols = ["tp", "fp", "fn", "precision", "recall", "fp_per_image"]
    wide = curve.groupBy(*keys, "threshold").pivot("scope", [target, "Overall"]).agg(F.first(F.struct(*cols)))
    return wide.where(F.col(f"`{target}`").isNotNull() & F.col("Overall").isNotNull()).select(*keys, "threshold", *[F.col(f"`{target}`")[c].alias(f"t_{c}") for c in cols], *[F.col("Overall")[c].alias(f"o_{c}") for c in cols])


def select_policy(points: DataFrame, least_precision: float, most_fp: float, most_fp_overall: float, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """The feasible point (inclusive constraints, some positive prediction) of largest target recall, then precision, fewer false positives overall, of the target, higher threshold."""
    ok = points.where(F.expr(f"t_tp + t_fp > 0 and t_precision >= {least_precision}D and t_fp_per_image <= {most_fp}D and o_fp_per_image <= {most_fp_overall}D"))
    rest = [c for c in points.columns if c not in keys]
    top = ok.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("t_recall", "t_precision", -F.col("o_fp"), -F.col("t_fp"), "threshold")).alias("b"))
    return top.select(*keys, "b.*")


def frontier(curve: DataFrame, scope: str) -> DataFrame:
    """budget, model, threshold, fp, recall, slack: for every false-positive count of either model the point of largest recall (then precision, threshold) within it.

    A running maximum over false-positive counts, by ranges of them, replaces the join of every budget with every point.
    """
    work = Work(curve.sparkSession, "frontier")
    own = work.table(curve.where(F.col("scope") == scope).select("model", "fp", "recall", "precision", "threshold"), "curve")
    best = own.groupBy("model", "fp").agg(F.max(F.struct("recall", "precision", "threshold", "fp")).alias("b")).withColumnRenamed("fp", "budget")
    budgets = own.select(F.col("fp").alias("budget")).distinct().crossJoin(F.broadcast(own.select("model").distinct()))  # one row a model
    rows = work.table(even_blocks(work.table(budgets.join(best, ["model", "budget"], "left"), "budgets"), "budget"), "rows")
    filled = carried(rows, ["model"], [F.col("budget")], F.col("b"), "most", largest=True)
    return filled.select("budget", "model", F.col("most.threshold").alias("threshold"), F.col("most.fp").alias("fp"), F.col("most.recall").alias("recall"), (F.col("budget") - F.col("most.fp")).alias("slack"))


def closest_cost(curve: DataFrame, scope: str) -> DataFrame:
    """For every point of model A the false-positive count of model B nearest to its own (then larger recall, threshold): threshold_a, fp_a, threshold_b, fp_b.

    Only the nearest counts at or below and at or above can win; both are carried along the counts, by ranges of them.
    """
    work = Work(curve.sparkSession, "closest")
    own = work.table(curve.where(F.col("scope") == scope).select("model", "fp", "recall", "threshold"), "curve")
    b = own.where("model = 'B'").groupBy("fp").agg(F.max(F.struct("recall", "threshold")).alias("v"))
    a = own.where("model = 'A'").select(F.col("fp"), F.col("threshold").alias("threshold_a"))
    both = a.join(b.withColumnRenamed("fp", "b_fp"), F.col("fp") == F.col("b_fp"), "full_outer").select(F.coalesce("fp", "b_fp").alias("fp"), "threshold_a", "v")
    hit = F.when(F.col("v").isNotNull(), F.struct(F.col("fp").alias("fp"), F.col("v.recall").alias("recall"), F.col("v.threshold").alias("threshold")))
    rows = work.table(even_blocks(work.table(both, "both"), "fp").withColumn("same", F.col("block")), "rows")
    low = work.table(carried(rows, [], [F.col("fp"), F.col("threshold_a")], hit, "lo").withColumnRenamed("same", "block"), "low")
    near = carried(low, [], [F.desc("fp"), F.col("threshold_a")], hit, "hi", down=True).where("threshold_a is not null")
    options = F.array_compact(F.array("lo", "hi"))
    pick = F.array_min(F.transform(options, lambda x: F.struct(F.abs(x["fp"] - F.col("fp")).alias("gap"), (-x["recall"]).alias("r"), (-x["threshold"]).alias("t"), x["fp"].alias("fp"))))
    return near.withColumn("p", pick).where("p is not null").select("threshold_a", F.col("fp").alias("fp_a"), (-F.col("p.t")).alias("threshold_b"), F.col("p.fp").alias("fp_b"))


def skyline(points: np.ndarray) -> np.ndarray:
    """Indexes of the distinct rows that no other dominates (all columns at least as large, one larger)."""
    order = np.lexsort(points.T[::-1])[::-1]  # falling: a row is dominated by earlier ones alone
    front = np.zeros((0, points.shape[1]))
    out = []
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        p = points[part]
        for x in range(0, len(front), 1024):  # against what is in front already
            f = front[x : x + 1024]
            p_alive = ~((f[None] >= p[:, None]).all(axis=2)).any(axis=1)
            part, p = part[p_alive], p[p_alive]
        over = np.tril((p[None] >= p[:, None]).all(axis=2), -1)  # rows are distinct, so at least as large everywhere is larger somewhere
        alive = ~over.any(axis=1)
        out.append(part[alive])
        front = np.concatenate([front, p[alive]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def pareto(points: DataFrame, maximise: list[str], keep: str, tasks: int = 64) -> DataFrame:
    """Distinct vectors that no other dominates, with the largest ``keep`` of each and how many points share it.

    Points are collapsed to distinct vectors; every task leaves its own skyline, and ever fewer tasks merge skylines
    until one does, so no pair of points is compared across tasks before both have survived their own.
    """
    vectors = points.groupBy(*maximise).agg(F.max(keep).alias(keep), F.count("*").alias("n_equal"))

    def local(batches):
        held = pa.Table.from_batches([b for b in batches if b.num_rows], schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if held is not None:
            values = np.stack([held.column(c).to_numpy().astype(float) for c in maximise], axis=1)
            yield from held.take(pa.array(skyline(values))).to_batches()

    while True:
        vectors = vectors.repartition(tasks).mapInArrow(local, vectors.schema)
        if tasks == 1:
            return vectors
        tasks = max(1, tasks // 8)


def same_cost_pairs(points: DataFrame, tolerance: int = 1) -> DataFrame:
    """Decision counts over all pairs of distinct states of models A and B whose false positives differ by at most ``tolerance`` in both scopes.

    Only the highest threshold of equal states counts.  Costs are bucketed, so nearby states alone are joined.
    """
    state = ["t_tp", "t_fp", "t_fn", "o_tp", "o_fp", "o_fn"]
    unique = points.groupBy("model", *state).agg(F.max_by(F.struct("threshold", "t_recall", "t_precision"), "threshold").alias("p")).select("model", *state, "p.*")
    width = tolerance + 1
    a = unique.where("model = 'A'").select(*[F.col(c).alias(f"a_{c}") for c in unique.columns]).withColumn("bucket", F.explode(F.expr(f"sequence(bigint(a_o_fp div {width}) - 1, bigint(a_o_fp div {width}) + 1)")))
    b = unique.where("model = 'B'").select(*[F.col(c).alias(f"b_{c}") for c in unique.columns]).withColumn("b_bucket", F.expr(f"bigint(b_o_fp div {width})"))
    pairs = a.join(b, F.expr(f"bucket = b_bucket and abs(a_o_fp - b_o_fp) <= {tolerance} and abs(a_t_fp - b_t_fp) <= {tolerance}"))
    decision = "case when a_t_recall > b_t_recall and a_t_precision >= b_t_precision then 'A_PREFERRED' when b_t_recall > a_t_recall and b_t_precision >= a_t_precision then 'B_PREFERRED_UNDER_THIS_BUDGET' else 'NO_CLEAR_ADVANTAGE' end"
    return pairs.groupBy(F.expr(decision).alias("decision")).agg(F.count("*").alias("n"))
