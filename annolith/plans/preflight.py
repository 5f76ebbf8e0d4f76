"""Named queries of preflights, readiness and review samples, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.operators import matching, preflight
from annolith.plans import catalogue, evaluation
from annolith.plans.draws import CATEGORIES
from annolith.plans.registry import query
from annolith.sources.work import Work
from annolith.plans.sql import ORACLES as _KNOWN, TIERS
from annolith.sources.tables import tables

_QUOTAS = {3: 30, 2: 15, 1: 8}


@query
def sampling_recommendation(spark, sf_dir):
    return preflight.recommendation(catalogue._tiers(spark, sf_dir).withColumn("strat", F.expr("img % 4")).withColumn("n1", F.expr("if(strat = 3, 0, if(strat = 2, n1 + img % 2, n1))")), ("strat",))


@query
def experiment_readiness(spark, sf_dir):
    """An experiment for each customer nation: orders are reviewed cases, their categories and evidence come from keys."""
    (customer, orders) = tables(spark, sf_dir, "customer", "orders")
    rows = orders.join(customer.select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).select(F.col("c_nationkey").alias("experiment"), "o_orderkey")
    k = F.expr("o_orderkey % 1000")
    reviews = rows.select("experiment", (k + F.col("experiment") * 50 < 1700).alias("reviewed"), F.expr("case when o_orderkey % 997 = experiment then array('ANNOTATION_SUSPICIOUS', 'BLUR') when o_orderkey % 499 = experiment * 3 then array('UNKNOWN') when o_orderkey % 701 = experiment * 7 then array('SMALL', 'OCCLUSION') else array('CLEAR') end").alias("categories"))
    reviews = reviews.where("experiment % 3 > 0 or categories[0] = 'CLEAR'")
    automatic = rows.groupBy("experiment").agg(F.count_if(F.expr("o_orderkey % 13 = experiment")).alias("low_confidence"), F.count_if(F.expr("o_orderkey % 17 = experiment")).alias("class_confusion")).where("experiment <> 4")
    classes = rows.groupBy("experiment").agg(F.sum(F.expr("o_orderkey % 5")).alias("n0"), F.sum(F.expr("o_orderkey % (3 + experiment % 4)")).alias("n1"))
    return preflight.readiness(reviews, automatic, classes, ("experiment",))


@query
def provenance_violations(spark, sf_dir):
    """A frozen manifest of texts and languages against documents of which some have changed, gone or come."""
    (docs,) = tables(spark, sf_dir, "documents")
    digests = lambda d: d.select("doc_id", F.sha2("text", 256).alias("image"), F.sha2("lang", 256).alias("label"))
    manifest = digests(docs.where("doc_id % 19 <> 3"))
    now = docs.where("doc_id % 23 <> 5").withColumns({"text": F.expr("if(doc_id % 29 = 1, text || '.', text)"), "lang": F.expr("if(doc_id % 31 = 2, 'xx', lang)")})
    return preflight.provenance_violations(manifest.unionByName(manifest.where("doc_id % 37 = 4")), digests(now), "doc_id", ["image", "label"])


@query
def prediction_violations(spark, sf_dir):
    _, a, _ = catalogue._boxes(spark, sf_dir)
    bad = a.withColumns({"c": F.expr("if(img % 17 = 3 and i = 0, 7, c)"), "s": F.expr("if(img % 19 = 4 and i = 1, 1.5D, s)"), "x2": F.expr("if(img % 23 = 5 and i = 0, double('NaN'), x2)")})
    return preflight.prediction_violations(bad, 2, 0.001, 6)


@query
def run_violations(spark, sf_dir):
    """A run for each customer: what its orders give against what was required, and its orders by date as epochs."""
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    facts = orders.groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("orders"), F.max("o_orderstatus").alias("status"))
    pairs = lambda df, n: df.select("run", F.expr(f"stack(2, 'orders', string({n}), 'status', status) as (key, value)"))
    evidence = pairs(facts, "orders").where("not (run % 7 = 2 and key = 'status')")
    required = pairs(customer.select(F.col("c_custkey").alias("run")).join(facts, "run", "left"), "orders + if(run % 11 = 1, 1, 0)")
    rank = F.expr("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)")
    epochs = orders.select(F.col("o_custkey").alias("run"), (rank + F.expr("if(o_custkey % 13 = 2, 1, 0)")).cast("long").alias("epoch"), (F.lit(100) + F.expr("if(o_orderkey % 41 = 0, 1, 0)")).cast("long").alias("samples"), F.expr("o_orderkey % 43 <> 0").alias("used"), F.expr("o_orderkey % 47").alias("steps"), F.lit(100).cast("long").alias("expected"))
    return preflight.run_violations(required, evidence, epochs)


@query
def review_sample(spark, sf_dir):
    """The targeted review queue: tiers, categories and crowded scenes together, each image once."""
    gt, a, _ = catalogue._boxes(spark, sf_dir)
    objects = Work(spark, "sample").table(matching.difficulty(gt, a), "objects")  # read for every reason
    images = matching.image_difficulty(objects, gt.select("img").union(a.select("img")).distinct())
    return preflight.review_sample(images, objects, _QUOTAS, CATEGORIES[1:]).select("img", F.array_join("reasons", "|").alias("reasons"))


_QUOTA = " ".join(f"when {t} then {n}" for t, n in _QUOTAS.items())
ORACLES = {
    "sampling_recommendation": f"with {TIERS}, t as (select img % 4 as strat, case img % 4 when 3 then 0 when 2 then n1 + img % 2 else n1 end as k from tiers), g as (select strat, count(*) as images, count(*) filter (k > 0) as positive from t group by 1) select strat, images, positive, images - positive as negative, (images - positive)::double / nullif(positive, 0) as weight, case when (images - positive)::double / nullif(positive, 0) > 1 then 'CLASS_AWARE_SAMPLING' else 'DEFER' end as recommendation from g",
    "experiment_readiness": """with r as (select c_nationkey as x, o_orderkey as k from orders join customer on o_custkey = c_custkey), v as (select x, k % 1000 + x * 50 < 1700 as ok, case when k % 997 = x then ['ANNOTATION_SUSPICIOUS', 'BLUR'] when k % 499 = x * 3 then ['UNKNOWN'] when k % 701 = x * 7 then ['SMALL', 'OCCLUSION'] else ['CLEAR'] end as c from r),
 g as (select x, count(*) as total, count(*) filter (ok) as reviewed, count(*) filter (ok and list_contains(c, 'ANNOTATION_SUSPICIOUS')) as suspicious, count(*) filter (ok and list_contains(c, 'UNKNOWN')) as unknown, count(*) filter (ok and list_has_any(c, ['OCCLUSION', 'BLUR', 'LOW_LIGHT', 'OTHER'])) as obscured from v where x % 3 > 0 or c[1] = 'CLEAR' group by 1),
 a as (select x, count(*) filter (k % 13 = x) as low, count(*) filter (k % 17 = x) as confused, sum(k % 5) as n0, sum(k % (3 + x % 4)) as n1 from r group by 1), j as (select g.*, case when x = 4 then 0 else low end as low, case when x = 4 then 0 else confused end as confused, n0, n1 from g join a using (x))
 select x as experiment, total, reviewed, suspicious, unknown, obscured, case when reviewed < total or suspicious > 0 or unknown > 0 or obscured > 0 then 'REVIEW_REQUIRED' when low + confused > 0 and n1 < n0 then 'YES' else 'NO' end as decision, case when reviewed = total and suspicious = 0 and low > 0 and confused > 0 and n1 < n0 then 'PASS' else 'FAIL' end as design from j""",
    "provenance_violations": """select doc_id, unnest(list_filter([case when doc_id % 37 = 4 and doc_id % 19 <> 3 then 'REPEATED' end, case when doc_id % 23 = 5 and doc_id % 19 <> 3 then 'MISSING' end, case when doc_id % 19 = 3 and doc_id % 23 <> 5 then 'FOREIGN' end, case when doc_id % 29 = 1 and text is not null and doc_id % 19 <> 3 and doc_id % 23 <> 5 then 'CHANGED image' end,
 case when doc_id % 31 = 2 and lang is distinct from 'xx' and doc_id % 19 <> 3 and doc_id % 23 <> 5 then 'CHANGED label' end], lambda x: x is not null)) as problem from documents""",
    "prediction_violations": "with p as (select l_orderkey as img, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 as i, ((l_partkey * 13 + l_suppkey * 7) % 1000)::double / 1000 as s from lineitem), g as (select img, count(*) as n, bool_or(img % 17 = 3 and i = 0) as c, bool_or((img % 19 = 4 and i = 1) or s < 0.001) as s, bool_or(img % 23 = 5 and i = 0) as b from p group by 1) select img, unnest(list_filter([case when n > 6 then 'TOO_MANY' end, case when c then 'UNKNOWN_CLASS' end, case when s then 'INVALID_SCORE' end, case when b then 'INVALID_BOX' end], lambda x: x is not null)) as problem from g",
    "run_violations": """with f as (select c_custkey as run, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1), e as (select o_custkey as run, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) + case when o_custkey % 13 = 2 then 1 else 0 end as epoch from orders)
 select run, null as item, 'NOT_RUN' as problem from f where n = 0 union all select run, 'status', 'MISSING' from f where n > 0 and run % 7 = 2 union all select run, 'orders', 'WRONG_VALUE' from f where n > 0 and run % 11 = 1
 union all select run, epoch::varchar, unnest(list_filter([case when run % 13 = 2 then 'OUT_OF_SEQUENCE' end, case when k % 41 = 0 then 'WRONG_SAMPLES' end, case when k % 43 = 0 then 'SAMPLER_NOT_USED' end, case when k % 47 = 0 then 'NO_STEPS' end], lambda x: x is not null)) from e""",
    "review_sample": f"""with o as ({_KNOWN.get('object_difficulty') or evaluation.ORACLES['object_difficulty']}), i as ({_KNOWN.get('difficulty_tiers') or evaluation.ORACLES['difficulty_tiers']}),
 r as (select img, 'tier ' || tier as reason from (select *, row_number() over (partition by tier order by n_hard1 > 0 desc, n_hard1 desc, img) as k from i where tier > 0) q where k <= case tier {_QUOTA} end
 union select img, category from (select img, category, row_number() over (partition by category order by img) as k from (select distinct img, category from o where category <> 'EASY_CORRECT') x) q where k <= 2 union select * from (select img, 'crowded' from i where crowded and n_hard > 0 order by img limit 3) q)
 select img, string_agg(reason, '|' order by reason) as reasons from r group by 1""",
}
