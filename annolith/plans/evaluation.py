"""Queries on what models miss and how runs compare, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.operators import checks, compare, evidence, sampling, sweep
from annolith.operators.matching import object_outcomes
from annolith.plans.registry import query
from annolith.plans.sql import BOTH, HEAD, POINTS, PRED_A, TIERS, area, curve, edges, greedy, iou, matched, outcome
from annolith.sources.fixtures import ground_truth, line_boxes, predictions
from annolith.sources.tables import tables
from annolith.sources.work import Work

#: Area of the images of the fixtures, in square pixels.
IMAGE_AREA = 20000


def _boxes(spark, sf_dir):
    return ground_truth(spark, sf_dir), predictions(spark, sf_dir), predictions(spark, sf_dir, "B")


def _curves(spark, sf_dir, models=("A", "B")):
    return sweep.sweeps(line_boxes(spark, sf_dir, models), models)


def _tiers(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return part.selectExpr("p_partkey as img", "p_size % 4 as tier", "(p_size * 7) % 3 as n_hard1", "1 + p_size % 2 as n0", "p_size % 3 as n1")


@query
def missed_tags(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return evidence.missed_tags(gt, a, IMAGE_AREA).select("img", "j", "size", "n_gt", F.array_join("categories", "|").alias("categories"))


@query
def missed_review_rows(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return evidence.review_rows(gt, a, IMAGE_AREA).select("img", "j", "size", "n_gt", "n_pred", "n_active", "nearest", "nearest_class", F.round("iou", 9).alias("iou"), "status")


@query
def missed_review_aggregate(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return evidence.review_aggregate(evidence.review_rows(gt, a, IMAGE_AREA)).select("category", "n", F.round("percentage", 6).alias("percentage"))


@query
def missed_by_scene(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    return evidence.missed_tags(gt, a, IMAGE_AREA).where("c = 1").groupBy("size", F.expr(evidence.SCENES.format("n_gt")).alias("scene")).agg(F.count("*").alias("n"))


@query
def residual_failures(spark, sf_dir):
    gt, a, b = _boxes(spark, sf_dir)
    of = lambda p, m: evidence.residuals(gt, p).select(F.lit(m).alias("model"), "img", "j", "wrong_class", "most_confident")
    return of(a, "A").unionByName(of(b, "B"))


@query
def threshold_diagnostics(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    historic = object_outcomes(gt, a.where("s >= 0.25")).where("outcome <> 'CORRECT' and c = 1").select("img", "j")
    return evidence.diagnostics(gt, a, 0.1, historic)


@query
def recovery_by_category(spark, sf_dir):
    gt, a, b = _boxes(spark, sf_dir)
    reviews = gt.select("img", "j", F.expr("case img % 3 when 0 then 'BLUR|DARK' when 1 then 'DARK' else 'CROWDED|BLUR' end").alias("categories"))
    return evidence.recovery(gt, a.where("s >= 0.25"), b.where("s >= 0.25"), reviews)


@query
def same_validation_set(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    size = "o_custkey % 7 as width", "o_custkey % 5 as height"
    one = orders.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey as img", *size)
    two = orders.where("o_orderkey % 13 <> 0").selectExpr("o_orderkey as img", "case when o_orderkey % 17 = 0 then 99 else o_custkey % 7 end as width", "o_custkey % 5 as height")
    return evidence.case_differences(one, two, "img", ["width", "height"])


@query
def model_selection(spark, sf_dir):
    best = sweep.best_point(_curves(spark, sf_dir), "f1", ("model", "scope"))
    deltas = compare.metric_deltas(best, ["scope"], ["precision", "recall", "f1"]).withColumn("delta", F.col("b") - F.col("a"))
    return evidence.model_decision(deltas)


@query
def matched_cost_pair(spark, sf_dir):
    return evidence.matched_pair(sweep.operating_points(_curves(spark, sf_dir)))


@query
def refined_thresholds(spark, sf_dir):
    _, a, b = _boxes(spark, sf_dir)
    return evidence.refined_thresholds([a, b])


@query
def metric_table_checks(spark, sf_dir):
    gt, a, _ = _boxes(spark, sf_dir)
    n = gt.select("img").union(a.select("img")).distinct().agg(F.count("*").alias("n_images"))
    rows = Work(spark, "metrics").table(_curves(spark, sf_dir, ("A",)).crossJoin(F.broadcast(n)), "curve")  # one row
    key = F.expr("cast(round(threshold * 1000) as int)")
    damaged = rows.withColumns({"tp": F.when((key % 7 == 0) & (F.col("scope") == "Overall"), F.col("tp") + 1).otherwise(F.col("tp")), "recall": F.when(key % 5 == 0, 0.5).otherwise(F.col("recall"))})
    damaged = damaged.where(~((key % 11 == 0) & (F.col("scope") == "0"))).unionByName(rows.where((key % 13 == 0) & (F.col("scope") == "1")))
    expected = rows.where(key % 3 != 0).select("model", "threshold")
    return checks.metric_table_violations(damaged, expected, ["0", "1"], F.col("n_images")).select("model", F.expr("cast(round(threshold * 1000) as int)").alias("threshold"), "problem")


@query
def metric_range_check(spark, sf_dir):
    bad = _curves(spark, sf_dir, ("A",)).drop("model").withColumn("f1", F.when(F.col("threshold") > 0.99, F.col("f1") + 1).when(F.col("threshold") < 0.01, F.lit(float("nan"))).otherwise(F.col("f1")))
    return checks.out_of_range(bad, ["precision", "recall", "f1"]).select("scope", "threshold", "metric")


@query
def drift_warnings(spark, sf_dir):
    c = _curves(spark, sf_dir)
    best = sweep.best_point(c, "f1", ("model", "scope"))
    return checks.drift(best.where("model = 'A'"), best.where("model = 'B'"), ["scope"], "recall", 0.001).select("scope", F.round("difference", 9).alias("difference"))


@query
def false_positive_accounts(spark, sf_dir):
    gt, a, b = _boxes(spark, sf_dir)
    return evidence.false_positive_accounts(compare.false_positive_transitions(gt, a, b), evidence.false_positives(gt, a), evidence.false_positives(gt, b))


@query
def scene_composition(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    gt, _, _ = _boxes(spark, sf_dir)
    return evidence.scene_composition(gt, orders.select(F.col("o_orderkey").alias("img")))


@query
def confidence_histogram(spark, sf_dir):
    _, a, _ = _boxes(spark, sf_dir)
    return evidence.confidence_histogram(a)


@query
def suppressed_boxes(spark, sf_dir):
    _, a, _ = _boxes(spark, sf_dir)
    return evidence.suppressed(a, 0.3)


@query
def strata_round_robin(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    strata = {"large": F.col("p_size") > 48, "cheap": F.col("p_retailprice") < 905, "rare": F.col("p_partkey") % 97 == 0}
    return evidence.strata_sample(part, "p_partkey", strata, 20).withColumnRenamed("p_partkey", "key")


@query
def sampler_diagnostics(spark, sf_dir):
    tiers = _tiers(spark, sf_dir).withColumn("w", F.col("tier") + 1)
    (orders,) = tables(spark, sf_dir, "orders")
    u = orders.crossJoin(F.broadcast(tiers.agg(F.sum("w").alias("total")))).select(F.col("o_orderkey").alias("draw"), F.expr("(o_orderkey * 7919 + o_custkey * 31) % total").alias("u"))  # one row
    draws = sampling.weighted_draw(tiers, "img", "w", u)
    out = evidence.draw_check(tiers, draws.select(F.col("key").alias("img")), "img", "tier", "w")
    return out.select("tier", F.round("expected", 6).alias("expected"), "actual", F.round("tolerance", 6).alias("tolerance"), "plausible")


@query
def top_expected_draws(spark, sf_dir):
    return evidence.top_draws(sampling.tier_weights(_tiers(spark, sf_dir)), "img").withColumn("draws", F.round("draws", 9))


@query
def weight_mapping_check(spark, sf_dir):
    tiers = _tiers(spark, sf_dir)
    given = tiers.where("img % 19 <> 0").select("img", F.expr("case when img % 23 = 0 then 7D else tier + 1D end").alias("weight"))
    given = given.unionByName(given.where("img % 29 = 0")).unionByName(tiers.where("img % 101 = 0").select((F.col("img") + 10**9).alias("img"), F.lit(1.0).alias("weight")))
    return checks.weight_violations(tiers, given, tiers.where("img % 31 = 0").select("img"), {0: 1, 1: 2, 2: 3, 3: 4})


@query
def coverage_sample(spark, sf_dir):
    tiers = _tiers(spark, sf_dir)
    objects = tiers.select("img", F.expr("case n_hard1 when 0 then 'EASY' when 1 then 'LOW' else 'CONFUSED' end").alias("category"))
    images = tiers.select("img", F.expr("n0 + n1 >= 4").alias("crowded"), F.col("n_hard1").alias("n_hard"))
    return evidence.coverage_sample(images, objects, ("LOW", "CONFUSED"))


@query
def run_comparison(spark, sf_dir):
    from annolith.plans.catalogue import epochs

    return evidence.curve_differences(epochs(spark, sf_dir), "run", "epoch", "v", "1-URGENT", "5-LOW")


@query
def resume_validation(spark, sf_dir):
    from annolith.plans.catalogue import epochs

    rows = epochs(spark, sf_dir).where("run = '1-URGENT'").select("epoch", "v")
    saved = rows.where("epoch % 9 <> 0").withColumn("v", F.when(F.col("epoch") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return checks.table_difference(rows, saved)


@query
def scene_cut_detection(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    frames = events.select("user_id", "event_id", F.expr("transform(sequence(0, 7), k -> cast((event_id * (k + 3) + user_id * k) % 11 as double))").alias("h"))
    out = evidence.scene_cuts(frames, "user_id", "event_id", "h", -0.4, 4.5)
    return evidence.track_counters(out.withColumn("track", F.col("event_id") % 5), "user_id", "track")


@query
def new_false_positive_images(spark, sf_dir):
    gt, a, b = _boxes(spark, sf_dir)
    new = compare.false_positive_transitions(gt, a, b).where("category = 'NEW_FALSE_POSITIVE_IN_B'")
    return new.select("img").distinct().orderBy("img").limit(12)  # a gallery of twelve


@query
def target_multipliers(spark, sf_dir):
    return sampling.target_weights(_tiers(spark, sf_dir), "n1", 2.5).groupBy("weight").agg(F.count("*").alias("n"), F.min("img").alias("least"))


_MISSED = f"""{HEAD}{matched('qa', where='s >= 0.25')}, cold as (select * from ({PRED_A}) q where s >= 0.001 and s < 0.25), missed as (select * from gt where not exists (select 1 from qam where qam.img = gt.img and qam.j = gt.j)),
 {greedy('low', edges('missed', 'cold', 0.5), 's desc, i, iou desc, j')}, scene as (select img, count(*) as n_gt from gt group by 1),
 tags as (select m.*, s.n_gt, case when a < 0.001 then 'tiny' when a < 0.01 then 'small' when a < 0.1 then 'medium' else 'large' end as size, l.i is not null as low, x.i is not null as mixed
  from (select *, {area('missed')} / {IMAGE_AREA} as a from missed) m join scene s using (img) left join low l on l.img = m.img and l.j = m.j left join qax x on x.img = m.img and x.j = m.j),
 rows_ as (select *, coalesce(nullif(concat_ws('|', case when low then 'LOW_CONFIDENCE' end, case when mixed then 'CLASS_CONFUSION' end, case when size in ('tiny', 'small') then 'SMALL_OBJECT' end, case when n_gt >= 3 then 'CROWDED_SCENE' end), ''), 'UNKNOWN') as categories from tags)"""
_TWO = f"{HEAD}{matched('qa', where='s >= 0.25')}, {matched('qb', 'B', where='s >= 0.25')}, oa as ({outcome('qa')}), ob as ({outcome('qb')})"
_BEST = f"{BOTH}, best as (select * from (select *, row_number() over (partition by model, scope order by f1 desc, recall desc, precision desc, threshold desc) as k from curves) q where k = 1)"
_EPOCHS = "m as (select o_orderpriority as run, row_number() over (partition by o_orderpriority order by date_trunc('month', o_orderdate))::int as epoch, sum(round(o_totalprice * 100)::bigint)::bigint as v from orders group by o_orderpriority, date_trunc('month', o_orderdate))"


def _residual(model: str, pred: str) -> str:
    return f"select '{model}' as model, g.img, g.j, coalesce(w.n, 0) > 0 as wrong_class, w.s as most_confident from gt g left join (select g.img, g.j, count(*) as n, max(p.s) as s from gt g join {pred} p on g.img = p.img and g.c <> p.c where {iou('g', 'p')} >= 0.5 group by 1, 2) w on w.img = g.img and w.j = g.j where g.c = 1 and not exists (select 1 from {pred} p where p.img = g.img and p.c = g.c and {iou('g', 'p')} >= 0.5)"


ORACLES: dict[str, str] = {
    "missed_tags": f"{_MISSED} select img, j, size, n_gt, categories from rows_",
    "missed_review_rows": f"""{_MISSED}, alls as (select * from ({PRED_A}) q), near as (select g.img, g.j, p.i, p.c as pc, {iou('g', 'p')} as iou, row_number() over (partition by g.img, g.j order by {iou('g', 'p')} desc, p.s desc, p.i) as k from rows_ g join alls p on p.img = g.img), counts as (select img, count(*) as n_pred, count(*) filter (s >= 0.25) as n_active from alls group by 1)
 select r.img, r.j, r.size, r.n_gt, coalesce(c.n_pred, 0) as n_pred, coalesce(c.n_active, 0) as n_active, n.i as nearest, n.pc as nearest_class, round(n.iou, 9) as iou, 'PENDING' as status from rows_ r left join near n on n.img = r.img and n.j = r.j and n.k = 1 left join counts c on c.img = r.img where r.c = 1""",
    "missed_review_aggregate": f"{_MISSED}, one as (select unnest(string_split(categories, '|')) as category from rows_ where c = 1), names as (select unnest(['LOW_CONFIDENCE', 'CLASS_CONFUSION', 'SMALL_OBJECT', 'CROWDED_SCENE', 'UNKNOWN']) as category) select n.category, count(o.category) as n, coalesce(round(100.0::double * count(o.category) / nullif((select count(*) from rows_ where c = 1), 0), 6), 0) as percentage from names n left join one o using (category) group by 1",
    "missed_by_scene": f"{_MISSED} select size, case when n_gt = 1 then 'single' when n_gt = 2 then 'two' else 'three_or_more' end as scene, count(*) as n from rows_ where c = 1 group by 1, 2",
    "residual_failures": f"{HEAD}{matched('qa')}, {matched('qb', 'B')} {_residual('A', 'qap')} union all {_residual('B', 'qbp')}",
    "threshold_diagnostics": f"{HEAD}{matched('qa', where='s >= 0.25')}, {matched('qc', where='s >= 0.1')}, oa as ({outcome('qa')}), oc as ({outcome('qc')}), h as (select img, j from oa where outcome <> 'CORRECT' and c = 1), z as (select oc.*, h.img is not null as was from oc left join h on h.img = oc.img and h.j = oc.j) select count(*) filter (outcome = 'CLASS_CONFUSION') as class_confusions, count(*) filter (outcome = 'CLASS_CONFUSION' and c = 1) as target_confusions, count(*) filter (was and outcome = 'CORRECT') as recovered, count(*) filter (was and outcome = 'CLASS_CONFUSION') as wrong_class, count(*) filter (was and outcome = 'MISSED') as still_missed from z",
    "recovery_by_category": f"{_TWO}, t as (select oa.img, ob.outcome as b from oa join ob using (img, j) where oa.outcome <> 'CORRECT' and oa.c = 1), e as (select b, unnest(string_split(case img % 3 when 0 then 'BLUR|DARK' when 1 then 'DARK' else 'CROWDED|BLUR' end, '|')) as category from t) select category, count(*) as n, count(*) filter (b = 'CORRECT') as recovered from e group by 1",
    "same_validation_set": "with a as (select o_orderkey as img, o_custkey % 7 as w, o_custkey % 5 as h from orders where o_orderkey % 11 <> 0), b as (select o_orderkey as img, case when o_orderkey % 17 = 0 then 99 else o_custkey % 7 end as w, o_custkey % 5 as h from orders where o_orderkey % 13 <> 0) select coalesce(a.img, b.img) as img, case when a.img is null then 'FOREIGN' when b.img is null then 'MISSING' else 'DIFFERENT' end as problem from a full join b on a.img = b.img where a.img is null or b.img is null or a.w <> b.w or a.h <> b.h",
    "model_selection": f"{_BEST}, d as (select a.scope, b.recall - a.recall as r, b.precision - a.precision as p, b.f1 - a.f1 as f from best a join best b on a.scope = b.scope and a.model = 'A' and b.model = 'B'), t as (select (select r from d where scope = '1') > 0 as target_improved, (select bool_and(p >= 0) from d where scope in ('1', 'Overall')) as precision_kept, (select f from d where scope = 'Overall') >= 0 as f1_kept) select *, case when target_improved and precision_kept and f1_kept then 'B_IS_CANDIDATE' when not target_improved or (not precision_kept and not f1_kept) then 'A_REMAINS_REFERENCE' else 'TRADEOFF_REQUIRES_DECISION' end as decision from t",
    "matched_cost_pair": f"""{POINTS}, u as (select * from (select *, row_number() over (partition by model, t_tp, t_fp, t_fn, o_tp, o_fp, o_fn order by threshold desc) as k from points) q where k = 1),
 z as (select a.threshold as a_threshold, a.t_fp as a_t_fp, a.o_fp as a_o_fp, b.threshold as b_threshold, b.t_fp as b_t_fp, b.o_fp as b_o_fp, case when a.t_recall > b.t_recall and a.t_precision >= b.t_precision then 'A_PREFERRED' when b.t_recall > a.t_recall and b.t_precision >= a.t_precision then 'B_PREFERRED_UNDER_THIS_BUDGET' else 'NO_CLEAR_ADVANTAGE' end as decision,
  row_number() over (order by least(a.t_recall, b.t_recall) desc, greatest(a.t_recall, b.t_recall) desc, a.o_fp + b.o_fp, a.t_fp + b.t_fp, a.threshold desc, b.threshold desc) as k from u a join u b on a.model = 'A' and b.model = 'B' and abs(a.o_fp - b.o_fp) <= 1 and abs(a.t_fp - b.t_fp) <= 1) select * exclude (k) from z where k = 1""",
    "refined_thresholds": f"{HEAD}{matched('qa')}, {matched('qb', 'B')} select i / 100.0::double as threshold from range(5, 91) r(i) union select s from qap where s between 0.05 and 0.9 union select s from qbp where s between 0.05 and 0.9",
    "metric_table_checks": f"""{HEAD}{matched('qa')}, {curve('qa', 'A')}, r as (select *, round(threshold * 1000)::int as key, (select n from qan) as n_images from qac),
 d as (select model, scope, key, case when key % 7 = 0 and scope = 'Overall' then tp + 1 else tp end as tp, fp, fn, precision, case when key % 5 = 0 then 0.5 else recall end as recall, f1, fp_per_image, n_images from r where not (key % 11 = 0 and scope = '0') union all select model, scope, key, tp, fp, fn, precision, recall, f1, fp_per_image, n_images from r where key % 13 = 0 and scope = '1'),
 e as (select distinct key from r where key % 3 <> 0), g as (select key, count(*) as n, count(distinct scope) as k, sum(case when scope = 'Overall' then tp else -tp end) as t, sum(case when scope = 'Overall' then fp else -fp end) as f, sum(case when scope = 'Overall' then fn else -fn end) as m from d group by 1)
 select distinct 'A' as model, key as threshold, p as problem from (select key, 'FOREIGN_KEY' as p from d where key not in (select key from e) union all select key, 'DUPLICATE_SCOPE' from g where n > k union all select e.key, 'MISSING_SCOPE' from e left join g on g.key = e.key where coalesce(k, 0) < 3 union all select key, 'OVERALL_SUM' from g where t <> 0 or f <> 0 or m <> 0
  union all select key, 'ARITHMETIC' from d where abs(precision - coalesce(tp::double / nullif(tp + fp, 0), 0)) > 1e-12 or abs(recall - coalesce(tp::double / nullif(tp + fn, 0), 0)) > 1e-12 or abs(f1 - coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)) > 1e-12 or abs(fp_per_image - fp::double / n_images) > 1e-12) q""",
    "metric_range_check": f"{HEAD}{matched('qa')}, {curve('qa', 'A')} select scope, threshold, 'f1' as metric from qac where threshold < 0.01 or (threshold > 0.99 and f1 > 0)",
    "drift_warnings": f"{_BEST} select a.scope, round(abs(a.recall - b.recall), 9) as difference from best a join best b on a.scope = b.scope and a.model = 'A' and b.model = 'B' where abs(a.recall - b.recall) > 0.001",
    "false_positive_accounts": f"""{HEAD}{matched('qa')}, {matched('qb', 'B')}, xa as (select * from qap where not exists (select 1 from qam where qam.img = qap.img and qam.i = qap.i)), xb as (select img, i as j, c, x1, y1, x2, y2 from qbp where not exists (select 1 from qbm where qbm.img = qbp.img and qbm.i = qbp.i)),
 {greedy('kept', f"select g.img, g.i, p.j, {iou('g', 'p')} as iou from xa g join xb p on g.img = p.img and g.c = p.c where {iou('g', 'p')} >= 0.5", 'iou desc, i, j')},
 n as (select (select count(*) from xa) as a, (select count(*) from xb) as b, (select count(*) from kept) as persistent) select a, b, b - persistent as new, a - persistent as removed, persistent, true as balanced from n""",
    "new_false_positive_images": f"""{HEAD}{matched('qa')}, {matched('qb', 'B')}, xa as (select * from qap where not exists (select 1 from qam where qam.img = qap.img and qam.i = qap.i)), xb as (select img, i as j, c, x1, y1, x2, y2 from qbp where not exists (select 1 from qbm where qbm.img = qbp.img and qbm.i = qbp.i)),
 {greedy('kept', f"select g.img, g.i, p.j, {iou('g', 'p')} as iou from xa g join xb p on g.img = p.img and g.c = p.c where {iou('g', 'p')} >= 0.5", 'iou desc, i, j')} select distinct img from xb where not exists (select 1 from kept k where k.img = xb.img and k.j = xb.j) order by img limit 12""",
    "target_multipliers": f"with {TIERS} select case when n1 > 0 then 2.5::double else 1.0::double end as weight, count(*) as n, min(img) as least from tiers group by 1",
    "scene_composition": f"{HEAD}own as (select img, bool_or(c = 0) as z, bool_or(c = 1) as o from gt group by 1) select case when z and o then 'both' when z then 'with_only' when o then 'without_only' else 'empty' end as composition, count(*) as n from orders left join own on img = o_orderkey group by 1",
    "confidence_histogram": f"with p as ({PRED_A}) select b as bucket, count(s) as n from (select unnest(['<0.25', '0.25-0.50', '0.50-0.75', '>=0.75']) as b) left join p on b = case when s < 0.25 then '<0.25' when s < 0.5 then '0.25-0.50' when s < 0.75 then '0.50-0.75' else '>=0.75' end group by 1",
    "suppressed_boxes": f"""with recursive p as ({PRED_A}), o as (select *, row_number() over (partition by img order by s desc, i) as k from p), t(img, k, kept) as (select distinct img, 0::bigint, []::bigint[] from o union all
 select t.img, t.k + 1, case when exists (select 1 from o z where z.img = t.img and list_contains(t.kept, z.k) and {iou('z', 'e')} > 0.3) then t.kept else list_append(t.kept, e.k) end from t join o e on e.img = t.img and e.k = t.k + 1) select o.img, o.i from o join (select img, arg_max(kept, k) as kept from t group by 1) f on f.img = o.img and list_contains(f.kept, o.k)""",
    "strata_round_robin": "with recursive r as (select (select list(p_partkey order by p_partkey) from part where p_size > 48) as a, (select list(p_partkey order by p_partkey) from part where p_retailprice < 905) as b, (select list(p_partkey order by p_partkey) from part where p_partkey % 97 = 0) as c, (select list(p_partkey order by p_partkey) from (from part order by p_partkey limit 20)) as d), t(step, chosen, pick) as (select -1, []::bigint[], null::bigint union all select step + 1, case when p is null then chosen else list_append(chosen, p) end, p from (select step, chosen, list_filter(case (step + 1) % 4 when 0 then a when 1 then b when 2 then c else d end, lambda x: not list_contains(chosen, x))[1] as p from t, r where len(chosen) < 20 and step < 100) q) select pick as key, case step % 4 when 0 then 'large' when 1 then 'cheap' when 2 then 'rare' else 'ANY' end as stratum, (step // 4 + 1)::int as turn from t where pick is not null",
    "sampler_diagnostics": f"with {TIERS}, c as (select img, tier, sum(1 + tier) over (order by img) as upto, 1 + tier as w from tiers), u as (select (o_orderkey * 7919 + o_custkey * 31) % (select sum(1 + tier) from tiers) as u from orders), d as (select tier, count(*) as k from u join c on u.u < c.upto and u.u >= c.upto - c.w group by 1), e as (select tier, sum(1 + tier)::double / (select sum(1 + tier) from tiers) * (select count(*) from orders) as e, (select count(*) from orders) as n from tiers group by 1), f as (select e.tier, e.e as expected, coalesce(k, 0) as actual, greatest(5.0, 6 * sqrt(e.e * (1 - e.e / n))) as tolerance from e left join d using (tier)) select tier, round(expected, 6) as expected, actual, round(tolerance, 6) as tolerance, abs(actual - expected) <= tolerance as plausible from f",
    "top_expected_draws": f"with {TIERS}, t as (select count(*) as n, sum(tier) as s from tiers), w as (select img, 1.0::double + tier * (case when s > 0 then least(0.1::double * n / s, 1.0::double / 3) else 0.0::double end) as weight, n from tiers, t) select img, round(weight / (select sum(weight) from w) * n, 9) as draws from w order by weight desc, img limit 10",
    "weight_mapping_check": f"with {TIERS}, g as (select img, case when img % 23 = 0 then 7 else tier + 1 end as weight from tiers where img % 19 <> 0) select img, case when img % 19 = 0 then 'MISSING' when img % 29 = 0 then 'REPEATED' else 'WRONG_WEIGHT' end as problem from (select t.*, g.weight from tiers t left join g using (img)) q where img % 19 = 0 or img % 29 = 0 or weight <> case when img % 31 = 0 then 1 else tier + 1 end union all select img + 1000000000, 'FOREIGN' from tiers where img % 101 = 0",
    "coverage_sample": f"with {TIERS}, o as (select img, case n_hard1 when 1 then 'LOW' when 2 then 'CONFUSED' end as why from tiers where n_hard1 > 0) select img, why from (select *, row_number() over (partition by why order by img) as k from o) q where k <= 2 union all (select img, 'CROWDED' from tiers where n0 + n1 >= 4 and n_hard1 > 0 order by img limit 3)",
    "run_comparison": f"with {_EPOCHS} select a.epoch, a.v as one, b.v as two, b.v - a.v as difference from m a join m b on a.epoch = b.epoch and a.run = '1-URGENT' and b.run = '5-LOW'",
    "resume_validation": f"with {_EPOCHS}, a as (select epoch, v from m where run = '1-URGENT') select epoch, v, 'ONLY_LEFT' as side, 1 as times from a where epoch % 9 = 0 or epoch % 7 = 0 union all select epoch, v + 1, 'ONLY_RIGHT', 1 from a where epoch % 7 = 0 and epoch % 9 <> 0",
    "scene_cut_detection": "with f as (select user_id, event_id, [((event_id * (k + 3) + user_id * k) % 11)::double for k in range(0, 8)] as h from events), l as (select *, lag(h) over (partition by user_id order by event_id) as b from f), m as (select *, list_avg(h) as mx, list_avg(b) as my from l), s as (select *, list_sum([(h[k] - mx) * (b[k] - my) for k in range(1, 9)]) as xy, list_sum([(x - mx) * (x - mx) for x in h]) as xx, list_sum([(x - my) * (x - my) for x in b]) as yy, list_sum([abs(h[k] - b[k]) for k in range(1, 9)]) / 8 as gap from m), c as (select user_id, event_id, b is not null and (case when xx * yy = 0 then (case when h = b then 1 else 0 end) else xy / sqrt(xx * yy) end < -0.4 or gap > 4.5) as cut from s) select user_id, count(distinct event_id % 5) as tracks, count(*) filter (cut) as cuts, count(*) as frames from c group by 1",
}
