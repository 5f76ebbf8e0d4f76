"""Evidence about what a model misses: tags, review rows, residuals, diagnostics at a threshold, recovery, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.functions.geometry import area, size_bucket
from annolith.operators.matching import edges, leftovers, match, nearest_prediction, object_outcomes, prefixed

# The tags of a missed object, in their order.
TAGS = ("LOW_CONFIDENCE", "CLASS_CONFUSION", "SMALL_OBJECT", "CROWDED_SCENE", "UNKNOWN")
# How many objects an image holds.
SCENES = "case when {0} = 1 then 'single' when {0} = 2 then 'two' else 'three_or_more' end"


def missed_tags(gt: DataFrame, pred: DataFrame, image_area: float, active: float = 0.25, floor: float = 0.001, least: float = 0.5, crowd: int = 3) -> DataFrame:
    """img, j, c, size, n_gt, categories (array, in the order of TAGS) of every object that active predictions miss.

    LOW_CONFIDENCE: a prediction below ``active`` fits it one to one; CLASS_CONFUSION: an active one of another class does; SMALL_OBJECT; CROWDED_SCENE: ``crowd`` objects or more.
    """
    hot, cold = pred.where(F.col("s") >= active), pred.where((F.col("s") >= floor) & (F.col("s") < active))
    outcomes = object_outcomes(gt, hot, least)
    missed = gt.join(outcomes.where("outcome <> 'CORRECT'").select(F.col("img").alias("o_img"), F.col("j").alias("o_j"), "outcome"), F.expr("img = o_img and j = o_j")).drop("o_img", "o_j")
    low = match(missed.drop("outcome"), cold, least).select(F.col("img").alias("w_img"), F.col("j").alias("w_j"))
    n = gt.groupBy(F.col("img").alias("n_img")).agg(F.count("*").alias("n_gt"))
    rows = missed.join(low, F.expr("img = w_img and j = w_j"), "left").join(n, F.col("img") == F.col("n_img"))
    rows = rows.withColumn("size", F.expr(size_bucket(f"(({area()}) / {image_area}D)")))
    tests = [F.col("w_img").isNotNull(), F.col("outcome") == "CLASS_CONFUSION", F.col("size").isin("tiny", "small"), F.col("n_gt") >= crowd]
    tags = F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, TAGS[:-1], strict=True)]))
    return rows.select("img", "j", "c", "size", "n_gt", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(TAGS[-1]))).alias("categories"))


def review_rows(gt: DataFrame, pred: DataFrame, image_area: float, target: int = 1, active: float = 0.25) -> DataFrame:
    """One row for each missed object of the target class: its tags, size, scene and nearest prediction of any class (null without one)."""
    tags = missed_tags(gt, pred, image_area, active).where(F.col("c") == target)
    near = prefixed(nearest_prediction(gt, pred, tags.select("img", "j")), "near_")
    count = pred.groupBy(F.col("img").alias("p_img")).agg(F.count("*").alias("n_pred"), F.count_if(F.col("s") >= active).alias("n_active"))
    j = tags.join(near, F.expr("img = near_img and j = near_j"), "left").join(count, F.col("img") == F.col("p_img"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("img", "j", "size", "n_gt", zero("n_pred"), zero("n_active"), F.col("near_i").alias("nearest"), F.col("near_predicted_class").alias("nearest_class"), F.col("near_iou").alias("iou"), "categories", F.lit("PENDING").alias("status"))


def review_aggregate(rows: DataFrame) -> DataFrame:
    """category, n, percentage of review rows; categories overlap, those without a row count 0."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(t,) for t in TAGS], "category string")
    counts = rows.select(F.explode("categories").alias("tag")).groupBy("tag").agg(F.count("*").alias("k"))
    total = rows.agg(F.count("*").alias("total"))
    n = F.coalesce("k", F.lit(0))
    return names.join(counts, F.col("category") == F.col("tag"), "left").crossJoin(F.broadcast(total)).select("category", n.alias("n"), F.expr("coalesce(try_divide(100D * coalesce(k, 0), total), 0D)").alias("percentage"))  # one row


def residuals(gt: DataFrame, pred: DataFrame, target: int = 1, least: float = 0.5) -> DataFrame:
    """img, j, wrong_class, most_confident: objects that no prediction of their class fits at any confidence, and what of another class does."""
    own = gt.where(F.col("c") == target)
    same = edges(own, pred, least).select("img", "j").distinct()
    wrong = edges(own, pred, least, same_class=False).groupBy(F.col("img").alias("x_img"), F.col("j").alias("x_j")).agg(F.max("s").alias("most_confident"))
    left = own.select("img", "j").join(same, ["img", "j"], "left_anti")
    return left.join(wrong, F.expr("img = x_img and j = x_j"), "left").select("img", "j", F.col("x_img").isNotNull().alias("wrong_class"), "most_confident")


def diagnostics(gt: DataFrame, pred: DataFrame, threshold: float, historic: DataFrame) -> DataFrame:
    """One row: confusions (all, of class 1) at a threshold, and what became of the objects (img, j) missed before."""
    states = object_outcomes(gt, pred.where(F.col("s") >= threshold)).select("img", "j", "c", "outcome")
    old = historic.select(F.col("img").alias("h_img"), F.col("j").alias("h_j"))
    j = states.join(old, F.expr("img = h_img and j = h_j"), "left")
    was = F.col("h_img").isNotNull()
    count = lambda test, name: F.count_if(test).alias(name)
    confused = F.col("outcome") == "CLASS_CONFUSION"
    return j.agg(count(confused, "class_confusions"), count(confused & (F.col("c") == 1), "target_confusions"), count(was & (F.col("outcome") == "CORRECT"), "recovered"), count(was & confused, "wrong_class"), count(was & (F.col("outcome") == "MISSED"), "still_missed"))


def recovery(gt: DataFrame, pred_a: DataFrame, pred_b: DataFrame, reviews: DataFrame, target: int = 1) -> DataFrame:
    """category, n, recovered: what model B makes of the target objects that A misses, by the categories (img, j, categories joined by |) of their human review."""
    old = object_outcomes(gt, pred_a).where(F.expr(f"outcome <> 'CORRECT' and c = {target}")).select("img", "j")
    new = object_outcomes(gt, pred_b).select("img", "j", F.col("outcome").alias("b"))
    tagged = old.join(new, ["img", "j"]).join(reviews.select("img", "j", "categories"), ["img", "j"])
    return tagged.select("b", F.explode(F.array_distinct(F.split("categories", r"\|"))).alias("category")).where("category <> ''").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("b") == "CORRECT").alias("recovered"))


def case_differences(one: DataFrame, two: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, problem: images of one side alone or given twice (FOREIGN, MISSING, REPEATED), or of unequal ``columns`` (DIFFERENT).  Both sides must be the same set."""
    a = one.groupBy(key).agg(F.count("*").alias("n_a"), F.min(F.struct(*columns)).alias("v_a"))
    b = two.groupBy(F.col(key).alias("key_b")).agg(F.count("*").alias("n_b"), F.min(F.struct(*columns)).alias("v_b"))
    j = a.join(b, F.col(key) == F.col("key_b"), "full_outer")
    problem = F.when(F.col(key).isNull(), "FOREIGN").when(F.col("key_b").isNull(), "MISSING").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "REPEATED").when(~F.col("v_a").eqNullSafe(F.col("v_b")), "DIFFERENT")
    return j.select(F.coalesce(key, "key_b").alias(key), problem.alias("problem")).where("problem is not null")


def model_decision(deltas: DataFrame, target: str = "1") -> DataFrame:
    """One row from (scope, metric, delta = B - A): target_improved, precision_kept, f1_kept, decision.

    B is a candidate if the target's recall gains and nothing guarded falls; A remains if recall does not gain, or if both guards fall.
    """
    d = lambda scope, metric: F.max(F.when((F.col("scope") == scope) & (F.col("metric") == metric), F.col("delta")))
    row = deltas.agg((d(target, "recall") > 0).alias("target_improved"), ((d(target, "precision") >= 0) & (d("Overall", "precision") >= 0)).alias("precision_kept"), (d("Overall", "f1") >= 0).alias("f1_kept"))
    decision = F.when(F.expr("target_improved and precision_kept and f1_kept"), "B_IS_CANDIDATE").when(F.expr("not target_improved or (not precision_kept and not f1_kept)"), "A_REMAINS_REFERENCE").otherwise("TRADEOFF_REQUIRES_DECISION")
    return row.withColumn("decision", decision)


def curve_differences(rows: DataFrame, key: str, order: str, value: str, one: str, two: str) -> DataFrame:
    """order, one, two, difference of two runs' curves, epoch by epoch, where both have the epoch."""
    wide = rows.where(F.col(key).isin(one, two)).groupBy(order).pivot(key, [one, two]).agg(F.first(value))
    return wide.where(F.col(f"`{one}`").isNotNull() & F.col(f"`{two}`").isNotNull()).select(order, F.col(f"`{one}`").alias("one"), F.col(f"`{two}`").alias("two"), (F.col(f"`{two}`") - F.col(f"`{one}`")).alias("difference"))


def draw_check(rows: DataFrame, draws: DataFrame, key: str, tier: str, weight: str = "weight") -> DataFrame:
    """tier, expected, actual, tolerance, plausible: draws (one row each, with ``key``) against the weights.  Tolerance: max(5, six standard deviations of a binomial)."""
    total = rows.agg(F.sum(weight).alias("w_"))
    n = draws.agg(F.count("*").alias("n_"))
    mass = rows.groupBy(tier).agg(F.sum(weight).alias("mass_"))
    drawn = draws.select(F.col(key).alias("d_key")).join(rows.select(key, tier), F.col("d_key") == F.col(key)).groupBy(F.col(tier).alias("d_tier")).agg(F.count("*").alias("k_"))
    j = mass.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n)).join(drawn, F.col(tier) == F.col("d_tier"), "left")  # one row each
    expected = F.col("mass_") / F.col("w_") * F.col("n_")
    out = j.select(tier, expected.alias("expected"), F.coalesce("k_", F.lit(0)).alias("actual"), F.greatest(F.lit(5.0), 6 * F.sqrt(expected * (1 - expected / F.col("n_")))).alias("tolerance"))
    return out.withColumn("plausible", F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance"))


def top_draws(rows: DataFrame, key: str, weight: str = "weight", k: int = 10) -> DataFrame:
    """key, draws: the largest expected numbers of draws in one pass of as many draws as rows; ties by key."""
    t = rows.agg(F.count("*").alias("n_"), F.sum(weight).alias("w_"))
    return rows.crossJoin(F.broadcast(t)).select(key, (F.col(weight) / F.col("w_") * F.col("n_")).alias("draws")).orderBy(F.desc("draws"), key).limit(k)  # one row


def coverage_sample(images: DataFrame, objects: DataFrame, categories: tuple[str, ...], each: int = 2, crowded: int = 3) -> DataFrame:
    """img, why: the first images of each category (of hard objects), and the first crowded images with hard objects."""
    first = Window.partitionBy("category").orderBy("img")
    of_each = objects.where(F.col("category").isin(*categories)).select("img", "category").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).select("img", F.col("category").alias("why"))
    full = images.where("crowded and n_hard > 0").orderBy("img").limit(crowded).select("img", F.lit("CROWDED").alias("why"))
    return of_each.unionByName(full)


def matched_pair(points: DataFrame, tolerance: int = 1) -> DataFrame:
    """The pair of states of models A and B of nearly equal cost (false positives in both scopes) that is best by six keys:

    the smaller of the target recalls, the larger, fewer false positives overall, of the target, higher threshold of A, of B.  Only the highest threshold of
    equal states counts; costs are bucketed, so nearby states alone are joined, and a cost's states are first reduced to those that can win.
    """
    state = ["t_tp", "t_fp", "t_fn", "o_tp", "o_fp", "o_fn"]
    unique = points.groupBy("model", *state).agg(F.max_by(F.struct("threshold", "t_recall", "t_precision"), "threshold").alias("p")).select("model", "t_fp", "o_fp", "p.*")
    # Of the states of one model and cost, a pair's keys grow with recall, then threshold: the best one alone can win.
    best = unique.groupBy("model", "t_fp", "o_fp").agg(F.max(F.struct("t_recall", "threshold", "t_precision")).alias("b")).select("model", "t_fp", "o_fp", "b.*")
    width = tolerance + 1
    a = prefixed(best.where("model = 'A'"), "a_").withColumn("bucket", F.explode(F.expr(f"sequence(bigint(a_o_fp div {width}) - 1, bigint(a_o_fp div {width}) + 1)")))
    b = prefixed(best.where("model = 'B'"), "b_").withColumn("b_bucket", F.expr(f"bigint(b_o_fp div {width})"))
    pairs = a.join(b, F.expr(f"bucket = b_bucket and abs(a_o_fp - b_o_fp) <= {tolerance} and abs(a_t_fp - b_t_fp) <= {tolerance}"))
    order = F.struct(F.least("a_t_recall", "b_t_recall"), F.greatest("a_t_recall", "b_t_recall"), -(F.col("a_o_fp") + F.col("b_o_fp")), -(F.col("a_t_fp") + F.col("b_t_fp")), F.col("a_threshold"), F.col("b_threshold"))
    keep = ["a_threshold", "a_t_fp", "a_o_fp", "a_t_recall", "a_t_precision", "b_threshold", "b_t_fp", "b_o_fp", "b_t_recall", "b_t_precision"]
    top = pairs.agg(F.max_by(F.struct(*keep), order).alias("p")).where("p is not null").select("p.*")
    decision = "case when a_t_recall > b_t_recall and a_t_precision >= b_t_precision then 'A_PREFERRED' when b_t_recall > a_t_recall and b_t_precision >= a_t_precision then 'B_PREFERRED_UNDER_THIS_BUDGET' else 'NO_CLEAR_ADVANTAGE' end"
    return top.select("a_threshold", "a_t_fp", "a_o_fp", "b_threshold", "b_t_fp", "b_o_fp", F.expr(decision).alias("decision"))


def refined_thresholds(predictions: list[DataFrame], first: int = 5, last: int = 90) -> DataFrame:
    """threshold: the grid i / 100 and every distinct score of any model within it."""
    spark = predictions[0].sparkSession
    out = spark.range(first, last + 1).select((F.col("id") / F.lit(100.0)).alias("threshold"))
    for p in predictions:
        out = out.unionByName(p.where(F.col("s").between(first / 100, last / 100)).select(F.col("s").alias("threshold")))
    return out.distinct()


def scene_composition(gt: DataFrame, images: DataFrame) -> DataFrame:
    """composition (both, with_only, without_only, empty), n of images by the classes 0 and 1 of their objects."""
    own = gt.groupBy(F.col("img").alias("g_img")).agg(F.max(F.col("c") == 0).alias("zero"), F.max(F.col("c") == 1).alias("one"))
    kind = F.expr("case when zero and one then 'both' when zero then 'with_only' when one then 'without_only' else 'empty' end")
    return images.join(own, F.col("img") == F.col("g_img"), "left").groupBy(kind.alias("composition")).agg(F.count("*").alias("n"))


def confidence_histogram(pred: DataFrame) -> DataFrame:
    """bucket, n: predictions by confidence, the quarters from 0.25 on; empty ones count 0."""
    names = ("<0.25", "0.25-0.50", "0.50-0.75", ">=0.75")
    counts = [F.count_if(test).alias(name) for name, test in zip(names, (F.col("s") < 0.25, F.col("s").between(0.25, 0.5) & (F.col("s") < 0.5), (F.col("s") >= 0.5) & (F.col("s") < 0.75), F.col("s") >= 0.75), strict=True)]
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return pred.agg(*counts).select(F.expr(f"stack({len(names)}, {pairs}) as (bucket, n)"))


def strata_sample(cases: DataFrame, key: str, strata: dict[str, Column], limit: int = 20) -> DataFrame:
    """key, stratum, turn: distinct cases taken in turn from several strata in key order, then from all of them (round robin)."""
    from annolith.operators.review import round_robin

    criteria = {name: F.when(test, F.col(key)) for name, test in strata.items()} | {"ANY": F.col(key)}
    return round_robin(cases, key, criteria, limit).withColumnRenamed("criterion", "stratum")


def suppressed(pred: DataFrame, most: float = 0.7) -> DataFrame:
    """img, i of the predictions that class-agnostic suppression keeps: by falling score, each that overlaps no kept one by more than ``most``."""
    from annolith.functions.geometry import iou

    box = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "i", "x1", "y1", "x2", "y2")))
    over = iou("k.", "x.")
    kept = F.expr(f"aggregate(b, filter(b, x -> false), (a, x) -> case when exists(a, k -> {over} > {most}D) then a else concat(a, array(x)) end)")
    return pred.groupBy("img").agg(box.alias("b")).select("img", F.explode(kept).alias("x")).select("img", "x.i")


def lost_buffer(seconds: str, fps: str) -> Column:
    """Frames that a lost track is remembered: seconds times rate, half to even, 1 at least."""
    return F.expr(f"greatest(1, cast(bround({seconds} * {fps}) as int))")


def scene_cuts(frames: DataFrame, source: str, order: str, features: str, least_correlation: float, most_difference: float) -> DataFrame:
    """Adds cut: whether a frame's histogram (array) correlates with the one before it by less than the first limit, or differs from it in the mean by more than the second.

    The first frame of a source is no cut; a histogram without variation correlates with an equal one by 1, with another by 0.
    """
    w = Window.partitionBy(source).orderBy(order)
    rows = frames.withColumn("before_", F.lag(features).over(w))
    both = rows.withColumn("z_", F.arrays_zip(F.col(features).alias("x"), F.col("before_").alias("y")))
    mean = lambda c: f"(aggregate({c}, 0D, (a, v) -> a + v) / size({c}))"
    both = both.withColumns({"mx_": F.expr(mean(features)), "my_": F.expr(mean("before_"))})
    total = lambda e: f"aggregate(z_, 0D, (a, v) -> a + {e})"
    sums = both.withColumns({"xy_": F.expr(total("(v.x - mx_) * (v.y - my_)")), "xx_": F.expr(total("(v.x - mx_) * (v.x - mx_)")), "yy_": F.expr(total("(v.y - my_) * (v.y - my_)")), "gap_": F.expr(total("abs(v.x - v.y)") + " / size(z_)")})
    r = F.expr(f"coalesce(try_divide(xy_, sqrt(xx_ * yy_)), case when {features} = before_ then 1D else 0D end)")
    cut = F.coalesce(F.col("before_").isNotNull() & ((r < least_correlation) | (F.col("gap_") > most_difference)), F.lit(False))
    return sums.withColumn("cut", cut).drop("before_", "z_", "mx_", "my_", "xy_", "xx_", "yy_", "gap_")


def track_counters(rows: DataFrame, source: str, track: str) -> DataFrame:
    """source, tracks (distinct), cuts, frames from rows with ``cut`` by frame."""
    return rows.groupBy(source).agg(F.count_distinct(track).alias("tracks"), F.count_if(F.col("cut")).alias("cuts"), F.count("*").alias("frames"))


def false_positive_accounts(transitions: DataFrame, fp_a: DataFrame, fp_b: DataFrame) -> DataFrame:
    """One row: false positives of both models, new, removed, persistent, and whether b - a = new - removed."""
    t = transitions.agg(*[F.count_if(F.col("category") == c).alias(n) for c, n in (("NEW_FALSE_POSITIVE_IN_B", "new"), ("REMOVED_FALSE_POSITIVE_IN_B", "removed"), ("PERSISTENT_FALSE_POSITIVE", "persistent"))])
    a, b = fp_a.agg(F.count("*").alias("a")), fp_b.agg(F.count("*").alias("b"))
    return a.crossJoin(b).crossJoin(t).withColumn("balanced", F.expr("b - a = new - removed"))  # one row each


def false_positives(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return leftovers(pred, match(gt, pred), "i")
