"""Ordered detections: identity switches, transfers, class flips, scenes, display ids, smoothed classes, curves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annolith.operators.audit import coverage
from annolith.operators.matching import hungarian
from annolith.sources.work import Work


def changes(rows: DataFrame, key: str, order: list[str], value: str, alias: str = "n_changes") -> DataFrame:
    """How often ``value`` differs from the row before it, by key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("before_", F.lag(value).over(w)).groupBy(key).agg(F.count_if(F.col("before_") != F.col(value)).alias(alias))


def generations(rows: DataFrame, source: str, order: list[str], cut: str) -> DataFrame:
    """Adds generation: how many cuts a source has had up to and with each row."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("generation", F.sum(F.expr(cut).cast("int")).over(w))


def display_ids(rows: DataFrame, source: str, order: list[str], raw: str) -> DataFrame:
    """Adds display_id: (generation, raw id) numbered by first sight within a source, never used again."""
    first = rows.groupBy(source, "generation", raw).agg(F.min(F.struct(*order)).alias("first_"))
    numbered = first.withColumn("display_id", F.row_number().over(Window.partitionBy(source).orderBy("first_", "generation", raw))).drop("first_")
    return rows.join(numbered, [source, "generation", raw])


def smoothed_class(rows: DataFrame, track: str, order: list[str], cls: str, confidence: str, decay: float, hysteresis: float, classes: int = 2) -> DataFrame:
    """track, order columns, shown: an exponential vote of each track with hysteresis; ties of the vote go to the lower class.

    Rows are sorted by track and order outside memory and walked once; a track's votes are all that is carried from one batch to the next.
    For unbounded streams see ``annolith.streaming``.
    """
    own = rows.select(track, *order, F.col(cls).cast("int").alias("c_"), F.col(confidence).cast("double").alias("p_"))
    k = len(order)

    def walk(batches):
        key, votes, shown = None, [], None
        for batch in batches:
            out = []
            for t, c, p in zip(*(batch.column(x).to_pylist() for x in (0, k + 1, k + 2)), strict=True):
                if shown is None or t != key:
                    key, votes, shown = t, [0.0] * classes, c
                votes = [decay * v + (1.0 - decay) * (p if n == c else 0.0) for n, v in enumerate(votes)]
                best = votes.index(max(votes))
                if best != shown and votes[best] > votes[shown] + hysteresis:
                    shown = best
                out.append(shown)
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(out, pa.int32())], names=[track, *order, "shown"])

    shape = T.StructType([*own.schema.fields[: k + 1], T.StructField("shown", T.IntegerType())])
    return own.repartition(track).sortWithinPartitions(track, *order, "c_", "p_").mapInArrow(walk, shape)


def frame_violations(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """img, problem of the frames that one side alone covers (both: img, one row a frame at least): ONLY_TRUTH or ONLY_OUTPUT.  Frames without boxes count as covered."""
    found = coverage(truth, outputs, "img")
    return found.select(F.col("key").alias("img"), F.when(F.col("side") == "ONLY_LEFT", "ONLY_TRUTH").otherwise("ONLY_OUTPUT").alias("problem"))


def matched_rows(gt: DataFrame, out: DataFrame, least: float = 0.5) -> DataFrame:
    """img, j, scene, object, gc, track, oc, iou of every match, frame by frame by assignment of largest total overlap."""
    m = hungarian(gt.select("img", "j", "c", "x1", "y1", "x2", "y2"), out.select("img", "i", "c", "s", "x1", "y1", "x2", "y2"), least)
    # Indices are compared by order, not as keys of a join: rows lie together by frame already and are not shuffled again.
    g = gt.select(F.col("img").alias("g_img"), F.col("j").alias("g_j"), "scene", "object", F.col("c").alias("gc"))
    o = out.select(F.col("img").alias("o_img"), F.col("i").alias("o_i"), "track", F.col("c").alias("oc"))
    rows = m.join(g, F.expr("img = g_img and j <= g_j and j >= g_j")).join(o, F.expr("img = o_img and i <= o_i and i >= o_i"))
    return rows.select("img", "i", "j", "iou", "scene", "object", "gc", "track", "oc")


def identity_changes(rows: DataFrame) -> DataFrame:
    """Adds switch, transfer, scene_transfer and flip to matched rows.

    switch: the track differs from the last one that the object (scene, object) was matched to; rows without a track are looked over, and none themselves.
    transfer: the object differs from the last one of the track (in a frame the truths come in order); scene_transfer: its scene does.  flip: the class shown differs from
    that of the object's match before, tracked or not.
    """
    by_object = Window.partitionBy("scene", "object").orderBy("img", "j").rowsBetween(Window.unboundedPreceding, -1)
    # Rows without a track have no last object: they go by frame, so that they do not all meet in one task.
    by_track = Window.partitionBy("track", F.when(F.col("track").isNull(), F.col("img"))).orderBy("img", "j").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("track").isNotNull()
    before = rows.withColumns({"t0_": F.last("track", ignorenulls=True).over(by_object), "c0_": F.last("oc").over(by_object), "o0_": F.when(known, F.last(F.struct("scene", "object")).over(by_track))})
    other = F.coalesce(known & (F.col("o0_") != F.struct("scene", "object")), F.lit(False))
    told = before.withColumns({"switch": F.coalesce(known & (F.col("t0_") != F.col("track")), F.lit(False)), "transfer": other, "scene_transfer": other & (F.col("o0_.scene") != F.col("scene")), "flip": F.coalesce(F.col("c0_") != F.col("oc"), F.lit(False))})
    return told.drop("t0_", "c0_", "o0_")


def tracking_metrics(gt: DataFrame, out: DataFrame, least: float = 0.5, target: int = 1, frames: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row of scores.  gt: img (frame), scene, j, object, c, box; out: img, i, track (null: not tracked), c, s, box.

    frames: the frames that both sides cover (img); a frame of one side alone is an error, found before anything is matched.
    Without any track, what is said of identities is null and MOTA leaves switches out.
    target_recall: of the truths of class ``target``, those matched and shown as such.  Matches are written once and read for all scores.
    """
    if frames is not None and (wrong := frame_violations(*frames).limit(5).collect()):
        raise ValueError(f"truth and outputs cover different frames: {', '.join(f'{r.img} {r.problem}' for r in wrong)}")
    rows = Work(gt.sparkSession, "tracking").table(matched_rows(gt, out, least), "matched")
    flags = {"id_switches": "switch", "id_transfers": "transfer", "scene_id_transfers": "scene_transfer", "class_flips": "flip"}
    sums = identity_changes(rows).agg(F.count("*").alias("matched"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.count_if(F.expr("gc = oc")).alias("class_correct"), F.count_if(F.expr(f"gc = {target} and oc = {target}")).alias("target_shown"))
    tracked = rows.where("track is not null")
    ids = tracked.groupBy("scene", "object").agg(F.count_distinct("track").alias("k")).agg(F.avg("k").alias("mean_ids_per_object"))
    spans = tracked.groupBy("track").agg(F.count_distinct("scene", "object").alias("k")).agg(F.count_if(F.col("k") > 1).alias("ids_spanning_objects"))
    truths = gt.agg(F.count("*").alias("gt_boxes"), F.count_distinct("scene", "object").alias("gt_objects"), F.count_if(F.col("c") == target).alias("targets"))
    one = truths.crossJoin(out.agg(F.count("*").alias("outputs"), (F.count("track") > 0).alias("tracked"))).crossJoin(sums).crossJoin(ids).crossJoin(spans)  # one row each
    part = lambda a, b: F.expr(f"coalesce(try_divide(cast({a} as double), {b}), 0D)")
    only = lambda c: F.expr(f"if(tracked, {c}, null)").alias(c)
    return one.select(
        "tracked", "gt_boxes", "gt_objects", "outputs", "matched", F.expr("outputs - matched").alias("false_positives"), *[only(c) for c in ("id_switches", "id_transfers", "scene_id_transfers", "ids_spanning_objects", "mean_ids_per_object")], "class_flips",
        part("matched", "gt_boxes").alias("recall"), part("matched", "outputs").alias("precision"), part("class_correct", "matched").alias("class_accuracy"), part("target_shown", "targets").alias("target_recall"),
        F.expr("1D - try_divide(cast(gt_boxes - matched + outputs - matched + if(tracked, id_switches, 0) as double), gt_boxes)").alias("mota"),
    )


def curve_summary(rows: DataFrame, key: str, order: str, value: str, ends: int = 5) -> DataFrame:
    """key, best (order of the first maximum), first_mean, last_mean (of the first and last rows), minimum, maximum, contiguous (orders count from 1)."""
    up, down = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    r = rows.withColumn("up_", F.row_number().over(up)).withColumn("down_", F.row_number().over(down))
    v = F.col(value)
    return r.groupBy(key).agg(F.max_by(order, F.struct(v, -F.col(order))).alias("best"), F.avg(F.when(F.col("up_") <= ends, v)).alias("first_mean"), F.avg(F.when(F.col("down_") <= ends, v)).alias("last_mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.bool_and(F.col("up_") == F.col(order)).alias("contiguous"))


def early_stopping(rows: DataFrame, key: str, order: str, value: str, patience: int) -> DataFrame:
    """key, best_fitness, best_epoch, stop: strict improvement moves the best; while the best is 0, so does every epoch."""
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("e"), F.col(value).cast("double").alias("f")))).alias("r"))
    fold = F.expr("aggregate(r, struct(0D as f, 0L as e), (a, x) -> if(x.f > a.f or a.f = 0, struct(x.f as f, x.e as e), a))")
    return g.select(key, fold.alias("b"), F.size("r").alias("n")).select(key, F.col("b.f").alias("best_fitness"), F.col("b.e").alias("best_epoch"), (F.col("n") - F.col("b.e") >= patience).alias("stop"))


def offsets(rows: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """Adds start: the sum of the lengths before each row of a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))
