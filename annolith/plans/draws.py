"""Named queries of draws, plans and overlaps, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.functions.text import cosine_hash, cosine_waves
from annolith.operators import curation, draws, duplicates, evidence, matching
from annolith.plans import catalogue, evaluation
from annolith.plans.registry import query
from annolith.sources.work import Work
from annolith.plans.sql import HASHES, ORACLES as _KNOWN, TIERS
from annolith.sources.tables import tables

SEED = 42
#: The categories of ``matching.difficulty``.
CATEGORIES = ("EASY_CORRECT", "LOW_CONFIDENCE_CORRECT", "CLASS_CONFUSION", "LOCALIZATION_FAILURE", "MATCH_COMPETITION", "MISSED_NO_CORRECT_CLASS_PROPOSAL")


@query
def category_sample(spark, sf_dir):
    """24 of each of several overlapping categories of documents."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    rows = docs.join(labels, "doc_id", "left")
    tags = F.array_compact(F.array(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("source "), "source"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.length("text") < 500, "short")))
    return draws.category_sample(rows.select("doc_id", F.explode(tags).alias("category")), "category", "doc_id", 24, SEED)


@query
def group_sample(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    return draws.group_sample(pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id"), "host", "page_id", 24, SEED)


@query
def pair_sample(spark, sf_dir):
    """A dozen pairs of orders of one customer, those of different status first."""
    (orders,) = tables(spark, sf_dir, "orders")
    a = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("sa"))
    b = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("b"), F.col("o_orderstatus").alias("sb"))
    pairs = a.join(b, F.expr("o_custkey = k and a < b")).select("a", "b", (F.col("sa") != F.col("sb")).alias("cross_split"))
    return draws.pair_sample(pairs, 12, SEED)


@query
def shuffled_images(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return draws.shuffled(orders.select("o_orderkey"), "o_orderkey", 64, SEED)


def _rows(spark, sf_dir):
    return catalogue._tiers(spark, sf_dir)


@query
def epoch_draws(spark, sf_dir):
    """The draws of epoch 3, as many as images."""
    rows = _rows(spark, sf_dir).withColumn("weight", F.lit(1.0) + F.col("tier") * 0.25)
    return draws.epoch_draws(rows, "img", "weight", SEED, 3)


def _excluded(spark, sf_dir):
    return _rows(spark, sf_dir).where("img % 13 = 5").select("img")


@query
def plan_images(spark, sf_dir):
    """The plan after review: images that it excludes are not weighted up."""
    out = draws.plan_images(_rows(spark, sf_dir), "img", SEED, _excluded(spark, sf_dir))
    return out.select("img", "tier", "eligible", *[F.round(c, 9).alias(c) for c in ("weight", "probability", "expected")], "drawn")


@query
def plan_tiers(spark, sf_dir):
    out = draws.plan_tiers(draws.plan_images(_rows(spark, sf_dir), "img", SEED, _excluded(spark, sf_dir)))
    return out.select("tier", "n", F.round("weight", 9).alias("weight"), F.round("fraction", 9).alias("fraction"), F.round("expected", 6).alias("expected"), "drawn")


@query
def plan_summary(spark, sf_dir):
    """The plans before and after review."""
    rows = []
    for stage, gone in (("before", None), ("after", _excluded(spark, sf_dir))):
        images = draws.plan_images(_rows(spark, sf_dir), "img", SEED, gone)
        s = draws.plan_summary(images, draws.plan_tiers(images))
        rows.append(s.select(F.lit(stage).alias("stage"), *[F.round(c, 5).alias(c) if kind == "double" else F.col(c) for c, kind in s.dtypes]))
    return rows[0].unionByName(rows[1])


@query
def plan_verification(spark, sf_dir):
    """A stored plan with changed, lost and foreign rows against its recomputation."""
    plan = draws.plan_images(_rows(spark, sf_dir), "img", SEED)
    stored = plan.where("img % 97 <> 3").withColumn("tier", F.when(F.col("img") % 101 == 4, 9).otherwise(F.col("tier"))).withColumn("n0", F.expr("if(img % 103 = 5, null, n0)"))
    foreign = plan.where("img % 89 = 6").withColumn("img", -F.col("img") - 1)
    return draws.plan_differences(stored.unionByName(foreign), plan, "img")


@query
def failure_overlaps(spark, sf_dir):
    """In how many missed objects the four associations meet, in all combinations."""
    gt, a, _ = catalogue._boxes(spark, sf_dir)
    missed = evidence.missed_tags(gt, a, evaluation.IMAGE_AREA)
    flag = lambda tag: F.array_contains("categories", tag)
    return draws.overlap_counts(missed, {t: flag(t) for t in evidence.TAGS[:-1]})


@query
def mining_summary(spark, sf_dir):
    gt, a, _ = catalogue._boxes(spark, sf_dir)
    objects = Work(spark, "mining").table(matching.difficulty(gt, a), "objects")  # read by all counts
    images = matching.image_difficulty(objects, gt.select("img").union(a.select("img")).distinct())
    return draws.mining_summary(objects, images, CATEGORIES)


@query
def source_group_nearest(spark, sf_dir):
    """The least distance within groups of any size, here a fifth of all vectors each, and a group of copies."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    hashes = duplicates.sign_hash(vectors, "vec_id", "embedding").withColumn("g", F.expr("key % 5"))
    copies = hashes.where("key % 3 = 0").withColumn("g", F.lit(99)).withColumn("hash", F.expr("hash & 255"))
    return curation.least_distances(spark, hashes.unionByName(copies), "g", "key", "hash", pairs_up_to=16)


@query
def cosine_hashes(spark, sf_dir):
    """Perceptual hashes of the vectors as grey images of 32 x 32, native."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    grey = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.get(F.col("embedding"), (F.floor(k / 128) * 8 + F.floor((k % 32) / 4)).cast("int")).cast("double"))
    return vectors.select("vec_id", cosine_hash(grey).alias("hash"))


_MD5 = "md5('42:' || {})"


def _draw(p: str, rows: str, epoch: int) -> str:
    """CTEs that end in {p}d (draw, img)."""
    u = f"('0x' || md5('{SEED}:{epoch}:' || i)[1:13])::bigint / 4503599627370496.0::double"
    return f"""{p}f as (select img, greatest(1, round(weight * 1000000)::bigint) as w from {rows}), {p}c as (select img, sum(w) over (order by img) as upto, w from {p}f), {p}s as (select sum(w)::bigint as total from {p}f),
 {p}u as (select i as draw, least(total - 1, floor({u} * total::double)::bigint) as u from range((select count(*) from {p}f)) q(i), {p}s), {p}d as (select u.draw, c.img from {p}u u asof join {p}c c on u.u < c.upto)"""


def _plan(p: str, eligible: str) -> str:
    """CTEs that end in {p}i, the images of a plan; needs tiers."""
    step = "case when sum(t) over () > 0 then least(0.1::double * count(*) over () / sum(t) over (), 1.0::double / 3) else 0.0 end"
    return f"""{p}t as (select *, {eligible} as eligible, case when {eligible} then tier else 0 end as t from tiers), {p}z as (select *, 1.0::double + t * {step} as weight from {p}t), {_draw(p, f'{p}z', 0)},
 {p}i as (select z.img, z.tier, z.n0, z.n1, z.eligible, z.weight, z.weight / sum(z.weight) over () as probability, z.weight / sum(z.weight) over () * count(*) over () as expected, coalesce(n, 0) as drawn from {p}z z left join (select img, count(*) as n from {p}d group by 1) k on k.img = z.img)"""


_SUMMARY = """select '{name}' as stage, count(*) as n, round((sum(weight) - count(*)) / count(*), 5) as extra_mass, round(sum(1 - pow(1 - probability, n_)), 5) as expected_unique, round(1 / sum(probability * probability), 5) as effective_size, round(max(expected), 5) as max_expected, max(drawn) as max_drawn, count(*) filter (drawn > 0) as unique_drawn,
 count(*) filter (eligible and tier > 0) as eligible_hard, count(*) filter (not eligible) as excluded, sum(n0)::bigint as n0_before, sum(n1)::bigint as n1_before, round(sum(n0 * expected), 5) as n0_expected, round(sum(n1 * expected), 5) as n1_expected,
 case when max(expected) > 3 or (select bool_or(k <= 0.05 * n and f > 0.2) from (select count(*) as k, sum(probability) as f from {s}i group by tier) q, (select count(*) as n from {s}i) r) then 'FAIL' when max(expected) > 2 or sum(1 - pow(1 - probability, n_)) < 0.6 * count(*) then 'WARNING' else 'PASS' end as risk
 from {s}i, (select count(*) as n_ from {s}i) m"""
_TAGS = ", ".join(f"{name!r}" for name in evidence.TAGS[:-1])
_WAVES = "[" + ", ".join("[" + ", ".join(f"{x!r}::double" for x in row) + "]" for row in cosine_waves()) + "]"
ORACLES = {
    "category_sample": f"""with m as (select doc_id, unnest(list_filter(['lang ' || lang, 'source ' || source, case when toxic = 1 then 'toxic' end, case when length(text) < 500 then 'short' end], lambda x: x is not null)) as category from documents left join labels using (doc_id)),
 r as (select category, doc_id, row_number() over (partition by category order by {_MD5.format("category || ':' || doc_id")}, doc_id) as place from (select distinct * from m) q) select * from r where place <= 24""",
    "group_sample": f"""with m as (select distinct regexp_extract(url, '^https?://([^/]+)', 1) as host, page_id from pages), f as (select *, row_number() over (partition by host order by page_id) as n from m), g as (select host, least(3, max(n)) as size, {_MD5.format('host')} as o from f group by 1 having max(n) > 1),
 b as (select *, coalesce(sum(size) over (order by o, host rows between unbounded preceding and 1 preceding), 0) as before from g) select f.host, f.page_id, (before + n)::int as place from f join b using (host) where n <= 3 and 24 - before >= 2 and before + n <= 24""",
    "pair_sample": f"select a.o_orderkey as a, b.o_orderkey as b, a.o_orderstatus <> b.o_orderstatus as cross_split from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey order by not cross_split, {_MD5.format("a.o_orderkey || ':' || b.o_orderkey")}, 1, 2 limit 12",
    "shuffled_images": f"select * from (select o_orderkey, row_number() over (order by {_MD5.format('o_orderkey')}, o_orderkey) as place from orders) q where place <= 64",
    "epoch_draws": f"with {TIERS}, z as (select img, 1.0::double + tier * 0.25::double as weight from tiers), {_draw('p', 'z', 3)} select draw, img from pd",
    "plan_images": f"with {TIERS}, {_plan('p', 'img % 13 <> 5')} select img, tier, eligible, round(weight, 9) as weight, round(probability, 9) as probability, round(expected, 9) as expected, drawn from pi",
    "plan_tiers": f"with {TIERS}, {_plan('p', 'img % 13 <> 5')} select t::int as tier, count(img) as n, round(max(weight), 9) as weight, round(coalesce(sum(probability), 0), 9) as fraction, round(coalesce(sum(expected), 0), 6) as expected, coalesce(sum(drawn), 0)::bigint as drawn from range(4) q(t) left join pi on tier = t group by 1",
    "plan_summary": f"with {TIERS}, {_plan('q', 'true')}, {_plan('p', 'img % 13 <> 5')} {_SUMMARY.format(name='before', s='q')} union all {_SUMMARY.format(name='after', s='p')}",
    "plan_verification": f"""with {TIERS} select img, null as "column", 'missing' as stored, 'there' as recomputed from tiers where img % 97 = 3 union all select -img - 1, null, 'there', 'missing' from tiers where img % 89 = 6
 union all select img, 'tier', '9', tier::varchar from tiers where img % 101 = 4 and img % 97 <> 3 union all select img, 'n0', null, n0::varchar from tiers where img % 103 = 5 and img % 97 <> 3""",
    "failure_overlaps": f"""with t as ({_KNOWN.get('missed_tags') or evaluation.ORACLES['missed_tags']}), b as (select list_sum([case when list_contains(string_split(categories, '|'), [{_TAGS}][k + 1]) then 1 << k else 0 end for k in range(0, 4)]) as bits from t), m as (select unnest(range(0, 16)) as m)
 select case when m = 0 then 'none' else array_to_string([[{_TAGS}][k + 1] for k in range(0, 4) if (m >> k) & 1 = 1], '+') end as combination, (select count(*) from b where bits = m) as exact, (select count(*) from b where bits::bigint & m = m) as at_least from m""",
    "mining_summary": f"""with o as ({_KNOWN.get('object_difficulty') or evaluation.ORACLES['object_difficulty']}), i as ({_KNOWN.get('difficulty_tiers') or evaluation.ORACLES['difficulty_tiers']}), k as (select unnest([{', '.join(f"'{c}'" for c in CATEGORIES)}]) as name)
 select 'objects' as metric, 'all' as name, count(*) as n from o union all select 'images', 'all', count(*) from i union all select 'classes', c::varchar, (select count(*) from o where o.c = q.c) from range(2) q(c) union all select 'tiers', t::varchar, (select count(*) from i where tier = t) from range(4) q(t)
 union all select 'all_difficulty', name, (select count(*) from o where category = name) from k union all select 'target_difficulty', name, (select count(*) from o where category = name and c = 1) from k union all select 'hard_images', 'class 1', count(*) from i where n_hard1 > 0 union all select 'critical_images', 'tier 3', count(*) from i where tier = 3""",
    "source_group_nearest": f"""with {HASHES}, m as (select key % 5 as g, key, hash from hashes union all select 99, key, hash & 255 from hashes where key % 3 = 0) select a.g as g, (select count(*) from m x where x.g = a.g) as n, count(*) as n_pairs, min(bit_count(xor(a.hash, b.hash)))::int as least_distance from m a join m b on a.g = b.g and a.key < b.key group by 1""",
    "cosine_hashes": f"""with g as (select vec_id, [embedding[((k // 128) * 8 + (k % 32) // 4 + 1)::int]::double for k in range(0, 1024)] as g from embeddings),
 r as (select vec_id, w, flatten([[list_sum([g[y * 32 + x + 1] * w[v + 1][x + 1] for x in range(0, 32)]) for v in range(0, 8)] for y in range(0, 32)]) as r from g, (select {_WAVES} as w) q),
 c as (select vec_id, flatten([[list_sum([r[y * 8 + v + 1] * w[u + 1][y + 1] for y in range(0, 32)]) for v in range(0, 8)] for u in range(0, 8)]) as c from r), b as (select vec_id, [case when k > 1 and c[k] > list_sort(c[2:64])[32] then 1 else 0 end for k in range(1, 65)] as b from c)
 select vec_id, array_to_string(['0123456789abcdef'[8 * b[k] + 4 * b[k + 1] + 2 * b[k + 2] + b[k + 3] + 1] for k in range(1, 65, 4)], '') as hash from b""",
}
