"""Named queries of the library and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.functions import geometry
from annolith.operators import audit, compare, duplicates, matching, parse, review, sampling, sweep, tracking
from annolith.plans.registry import QUERIES, query
from annolith.plans.sql import CHOICES, DECIDED, LINES, ORACLES, QUEUE, TIERS
from annolith.sources.fixtures import ground_truth, line_boxes, predictions
from annolith.sources.tables import manifest_truth, tables
from annolith.sources.tables import train_inventory as inventory
from annolith.streaming import votes

def _sql(spark, sf_dir, cte: str, *names: str):
    """The rows of one of the shared table expressions (written in the SQL that both engines read)."""
    name, body = cte.split(" as (", 1)
    text = body[:-1]
    for n in names:
        text = text.replace(f" from {n}", f" from {{{n}}}")
    return spark.sql(text.replace("varchar)", "string)"), **dict(zip(names, tables(spark, sf_dir, *names), strict=True)))


def label_lines(spark, sf_dir):
    return _sql(spark, sf_dir, LINES, "lineitem")


def _boxes(spark, sf_dir):
    return ground_truth(spark, sf_dir), predictions(spark, sf_dir), predictions(spark, sf_dir, "B")


def _curves(spark, sf_dir, models=("A", "B")):
    return sweep.sweeps(line_boxes(spark, sf_dir, models), models)


@query
def parse_validate(spark, sf_dir):
    out = parse.parse_lines(label_lines(spark, sf_dir))
    return out.select("img", "n", "line", "class_id", "area", "size_category", F.array_join("issues", "|").alias("issues"))


@query
def duplicate_lines(spark, sf_dir):
    return parse.repeated_annotations(parse.parse_lines(label_lines(spark, sf_dir)), "img", "n").select("img", "n", "line")


@query
def suspicious_boxes(spark, sf_dir):
    out = parse.suspicious_boxes(parse.parse_lines(label_lines(spark, sf_dir)).where("class_id is not null"))
    return out.select("img", "n", "reason")


@query
def audit_status(spark, sf_dir):
    return audit.issue_status(parse.annotation_issues(parse.parse_lines(label_lines(spark, sf_dir)), "img", "n"), "severity")


@query
def exact_duplicates(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return audit.exact_duplicates(docs.withColumn("name", F.lpad(F.col("doc_id").cast("string"), 12, "0")), "text", "name", "source")


@query
def source_groups(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^(https?)", 1).alias("scheme"))
    return audit.group_rollup(hosts, "host", "scheme")


def _hashes(spark, sf_dir):
    return duplicates.sign_hash(*tables(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def near_duplicate_pairs(spark, sf_dir):
    return duplicates.near_pairs(_hashes(spark, sf_dir))


@query
def near_duplicate_components(spark, sf_dir):
    return duplicates.near_components(spark, _hashes(spark, sf_dir))


@query
def orphans_missing(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return audit.coverage(docs, labels, "doc_id")


@query
def class_distribution(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return audit.class_distribution(labels.join(docs.select("doc_id", "lang"), "doc_id"), "lang", "quality", "doc_id")


@query
def bbox_statistics(spark, sf_dir):
    (items,) = tables(spark, sf_dir, "lineitem")
    return audit.metric_statistics(items.withColumn("grp", F.col("l_returnflag")), "grp", ["l_quantity", "l_extendedprice"]).withColumn("mean", F.round("mean", 6))


@query
def object_counts(spark, sf_dir):
    orders, items = tables(spark, sf_dir, "orders", "lineitem")
    n = items.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    images = orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderstatus").alias("split"), F.expr("nullif(coalesce(k, 0), 5)").alias("n"))
    return audit.object_counts(images, "split", "n")


@query
def resolution_histogram(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return audit.histogram(part, F.expr("concat(p_size, 'x', p_partkey % 7)"), "resolution")


@query
def review_queue(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    flagged = labels.where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("name"), F.expr("case when quality = 0 then 'low quality' else 'toxic' end").alias("reason"))
    groups = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return review.review_queue(near_duplicate_pairs(spark, sf_dir), flagged, groups)


@query
def decision_validation(spark, sf_dir):
    return review.validate_decisions(_sql(spark, sf_dir, QUEUE, "part"), _sql(spark, sf_dir, CHOICES, "part"))


@query
def decision_progress(spark, sf_dir):
    one = _sql(spark, sf_dir, CHOICES, "part").groupBy("review_id").agg(F.min("decision").alias("decision"))
    return review.decision_progress(review.merge_decisions(_sql(spark, sf_dir, QUEUE, "part"), one))


@query
def action_map(spark, sf_dir):
    return review.image_actions(_sql(spark, sf_dir, DECIDED, "orders"))


@query
def policy_sanity(spark, sf_dir):
    return review.policy_summary(_sql(spark, sf_dir, DECIDED, "orders"), "split_a", "split_b")


@query
def label_counts(spark, sf_dir):
    (items,) = tables(spark, sf_dir, "lineitem")
    return review.label_counts(items.select(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_returnflag").alias("labels")), "labels")


@query
def iou_pairs(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.edges(gt, a, 0.1).select("img", "i", "j", "iou")


@query
def greedy_match(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.match(gt, a).select("img", "i", "j")


@query
def confusion_match(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.confusions(gt, a, matching.match(gt, a)).select("img", "i", "j")


@query
def object_outcomes(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.object_outcomes(gt, a.where("s >= 0.25")).select("img", "j", "c", "outcome", "i")


@query
def failure_events(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.failure_events(gt, a).groupBy("event").agg(F.count("*").alias("n"))


@query
def nearest_prediction(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.nearest_prediction(gt, a, matching.leftovers(gt, matching.match(gt, a), "j"))


@query
def difficulty_tiers(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.image_difficulty(matching.difficulty(gt, a), gt.select("img").union(a.select("img")).distinct())


@query
def object_difficulty(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.difficulty(gt, a)


@query
def hungarian_match(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return matching.hungarian(gt, a)


@query
def threshold_sweep(spark, sf_dir):
    return _curves(spark, sf_dir, ("A",)).drop("model")


@query
def threshold_grid(spark, sf_dir):
    return sweep.at_grid(_curves(spark, sf_dir, ("A",)).drop("model")).select("scope", "threshold", "tp", "fp", "fn")


@query
def best_f1(spark, sf_dir):
    return sweep.best_point(_curves(spark, sf_dir), "f1", ("model", "scope")).select("model", "scope", "threshold", "tp", "fp", "fn", "f1")


@query
def precision_floor(spark, sf_dir):
    return sweep.precision_floor(_curves(spark, sf_dir), 0.8, ("model", "scope")).select("model", "scope", "threshold", "tp", "fp", "fn", "recall")


@query
def policy_select(spark, sf_dir):
    points = sweep.operating_points(_curves(spark, sf_dir))
    return sweep.select_policy(points, 0.75, 0.4, 0.9).select("model", "threshold", "t_tp", "t_fp", "o_fp")


@query
def fp_budget_frontier(spark, sf_dir):
    return sweep.frontier(_curves(spark, sf_dir), "1").where("threshold is not null")


@query
def closest_cost(spark, sf_dir):
    return sweep.closest_cost(_curves(spark, sf_dir), "1")


@query
def pareto(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return sweep.pareto(part.select("p_size", "p_retailprice", F.expr("-(p_partkey % 50)").alias("z"), "p_partkey"), ["p_size", "p_retailprice", "z"], "p_partkey")


@query
def same_cost_pairs(spark, sf_dir):
    return sweep.same_cost_pairs(sweep.operating_points(_curves(spark, sf_dir)))


@query
def transitions(spark, sf_dir):
    gt, a, b = _boxes(spark, sf_dir)
    return compare.transitions(gt, a.where("s >= 0.25"), b.where("s >= 0.25")).groupBy("c", "transition").agg(F.count("*").alias("n"))


@query
def fp_transitions(spark, sf_dir):
    return compare.false_positive_transitions(*_boxes(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query
def metric_deltas(spark, sf_dir):
    best = sweep.best_point(_curves(spark, sf_dir), "f1", ("model", "scope"))
    return compare.metric_deltas(best, ["scope"], ["precision", "recall", "f1"])


@query
def distribution_compare(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    rows = matching.object_outcomes(gt, a).select("img", "j", "outcome").join(gt, ["img", "j"])
    area = geometry.area()
    return compare.distribution(rows.withColumn("bucket", F.expr(f"case when {area} < 120 then 'small' when {area} < 180 then 'medium' else 'large' end")), "bucket", "outcome = 'MISSED'")


def _tiers(spark, sf_dir):
    return _sql(spark, sf_dir, TIERS, "part")


@query
def tier_quota_sample(spark, sf_dir):
    return review.tier_quota_sample(_tiers(spark, sf_dir), {3: 30, 2: 15, 1: 8}).select("img", "tier", "place")


@query
def round_robin_sample(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    third = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("double"))
    out = review.round_robin(part, "p_partkey", {"largest": -F.col("p_size").cast("double"), "cheapest": F.col("p_retailprice"), "third": third}, 40)
    return out.withColumnRenamed("p_partkey", "key")


def _events(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.withColumn("raw", F.col("event_id") % 5)


@query
def class_flips(spark, sf_dir):
    return tracking.changes(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query
def scene_generation(spark, sf_dir):
    return tracking.generations(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type = 'error'").select("event_id", "generation")


@query
def display_ids(spark, sf_dir):
    rows = tracking.generations(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type = 'error'")
    return tracking.display_ids(rows, "user_id", ["ts", "event_id"], "raw").select("event_id", "display_id")


@query
def ema_vote(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_id") % 2).alias("c"), (F.col("event_id") * 7 % 10 / 10.0).alias("p"))
    return tracking.smoothed_class(rows, "user_id", ["ts", "event_id"], "c", "p", 0.7, 0.05).select("event_id", "shown")


@query
def tracking_metrics(spark, sf_dir):
    """Orders are frames, a hundred of them a scene; some outputs are not tracked, and in a second run none is."""
    gt, a, _ = _boxes(spark, sf_dir)
    truth = gt.withColumns({"scene": F.expr("img div 100"), "object": F.col("j")})
    frames = (gt.select("img"), a.select("img"))
    runs = {"tracked": F.expr("case when (img + i) % 11 > 0 then i * 2 + img % 2 end"), "plain": F.lit(None).cast("long")}
    out = [tracking.tracking_metrics(truth, a.withColumn("track", track), frames=frames).withColumn("run", F.lit(name)) for name, track in runs.items()]
    return out[0].unionByName(out[1])


@query
def frame_violations(spark, sf_dir):
    """Frames that one side alone covers: outputs lack one customer in seven, and go on after the last order date of the truth."""
    (orders,) = tables(spark, sf_dir, "orders")
    frames = orders.select(F.col("o_orderkey").alias("img"), "o_custkey", "o_orderdate")
    return tracking.frame_violations(frames.where("o_orderdate < date'1998-01-01'"), frames.where("o_custkey % 7 <> 0"))


@query
def sampling_weights(spark, sf_dir):
    return sampling.tier_weights(_tiers(spark, sf_dir)).select("img", "tier", "weight")


@query
def sampling_stats(spark, sf_dir):
    out = sampling.plan_statistics(sampling.tier_weights(_tiers(spark, sf_dir)))
    return out.select("n", F.round("max_draws", 9).alias("max_draws"), F.round("expected_unique", 4).alias("expected_unique"), F.round("effective_size", 4).alias("effective_size"), "risk")


@query
def class_exposure(spark, sf_dir):
    return sampling.class_exposure(sampling.tier_weights(_tiers(spark, sf_dir)), ["n0", "n1"]).withColumn("expected", F.round("expected", 6))


@query
def weighted_sample(spark, sf_dir):
    tiers, (orders,) = _tiers(spark, sf_dir), tables(spark, sf_dir, "orders")
    total = tiers.agg(F.sum(F.col("tier") + 1).alias("total"))
    u = orders.crossJoin(F.broadcast(total)).select(F.col("o_orderkey").alias("draw"), F.expr("(o_orderkey * 7919 + o_custkey * 31) % total").alias("u"))
    return sampling.weighted_draw(tiers.withColumn("w", F.col("tier") + 1), "img", "w", u)


@query
def fingerprint(spark, sf_dir):
    return audit.fingerprint(*tables(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query
def verify_snapshot(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    after = docs.where("doc_id % 5 <> 0").withColumn("text", F.expr("case when doc_id % 11 = 0 then concat(text, '!') else text end"))
    return audit.snapshot_difference(audit.fingerprint(docs.where("doc_id % 7 <> 0"), "doc_id", "text"), audit.fingerprint(after, "doc_id", "text"))


@query
def argument_drift(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    a = nation.where("n_nationkey % 5 <> 1").select("n_name", F.expr("string(n_regionkey % 3)"))
    b = nation.where("n_nationkey % 7 <> 2").select("n_name", F.expr("string(n_regionkey % 2)"))
    return audit.argument_drift(a, b, nation.where("n_nationkey in (3, 8)").select("n_name"))


def epochs(spark, sf_dir):
    from pyspark.sql.window import Window

    (orders,) = tables(spark, sf_dir, "orders")
    m = orders.groupBy(F.col("o_orderpriority").alias("run"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    return m.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("m")))


@query
def curve_summary(spark, sf_dir):
    return tracking.curve_summary(epochs(spark, sf_dir), "run", "epoch", "v")


@query
def early_stopping(spark, sf_dir):
    return tracking.early_stopping(epochs(spark, sf_dir), "run", "epoch", "v", 10)


@query
def frame_offsets(spark, sf_dir):
    from pyspark.sql.window import Window

    (items,) = tables(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    rows = items.select(F.col("l_orderkey").alias("video"), F.row_number().over(order).alias("segment"), F.col("l_quantity").cast("long").alias("frames"))
    return tracking.offsets(rows, "video", "segment", "frames").select("video", "segment", "start")


@query
def projected_truth(spark, sf_dir):
    """Boxes of a demo video frame by frame: each order a scene of three frames, zoomed, on a canvas of 640 x 480."""
    (orders,) = tables(spark, sf_dir, "orders")
    placed = {k: F.expr(v) for k, v in geometry.letterbox("(200 + o_custkey % 300)", "(150 + o_orderkey % 200)", 640, 480).items()}
    place = F.struct(*[v.alias(k) for k, v in placed.items()])
    box = F.expr("array(named_struct('c', int(o_orderkey % 2), 'x', (o_custkey % 100) / 100D, 'y', (o_orderkey % 90) / 90D, 'w', (1 + o_custkey % 37) / 80D, 'h', (1 + o_orderkey % 29) / 400D))")
    segment = F.struct((F.col("o_orderkey") * 3).alias("start_frame"), F.lit(3).alias("frames"), place.alias("placement"), box.alias("objects"))
    manifests = orders.select(F.lit("valid").alias("split"), F.expr("array(640, 480)").alias("size"), F.lit(3).alias("frames_per_image"), F.lit(1.5).alias("max_zoom"), F.array(segment).alias("segments"))
    out = manifest_truth(manifests)
    return out.select("img", "c", *[F.floor(F.col(x) * 1000 + 0.3).alias(x) for x in ("x1", "y1", "x2", "y2")])


@query
def train_inventory(spark, sf_dir):
    lines = label_lines(spark, sf_dir).where("line rlike '^[01] 0.[0-9]+ 0.[0-9]+ 0.[0-9]+ 0.[0-9]+$'")
    (orders,) = tables(spark, sf_dir, "orders")
    return inventory(orders.select(F.col("o_orderkey").alias("img")), lines, "img")


QUERIES["stream_windows"] = votes.stream_windows
QUERIES["stream_votes"] = votes.stream_votes
QUERIES["stream_display_ids"] = votes.stream_display_ids


def queries() -> dict:
    from annolith.plans import curation, draws, evaluation, files, preflight, stores, streams  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from annolith.plans import curation, draws, evaluation, files, preflight, stores, streams

    return {k: v for k, v in (ORACLES | curation.ORACLES | evaluation.ORACLES | streams.ORACLES | stores.ORACLES | draws.ORACLES | preflight.ORACLES | files.ORACLES).items() if k in queries()}
