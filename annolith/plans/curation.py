"""Queries on findings, reviews and curated datasets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.operators import audit, checks, curation, duplicates, parse, review
from annolith.plans.registry import query
from annolith.plans.sql import HASHES, LINES
from annolith.sources.tables import IMAGE_SUFFIXES, tables


def _decided(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    split = "case {0} % 4 when 0 then 'train' when 1 then 'valid' when 2 then 'test' else 'other' end"
    return orders.selectExpr(
        "concat('r', o_orderkey) as review_id", "o_orderkey % 5000 as a", "o_custkey % 5000 + 1000000 as b", f"{split.format('(o_orderkey % 5000)')} as split_a", f"{split.format('(o_custkey % 5000)')} as split_b",
        "case o_orderkey % 7 when 0 then 'KEEP_A_EXCLUDE_B' when 1 then 'KEEP_B_EXCLUDE_A' when 2 then 'REVIEW_MORE' when 3 then 'PENDING' else 'KEEP_BOTH' end as decision", "case when o_orderkey % 3 = 0 then ' ' else 'looked at' end as notes")


_SPLIT = "case {0} % 4 when 0 then 'train' when 1 then 'valid' when 2 then 'test' else 'other' end"
_DECIDED = f"decided as (select concat('r', o_orderkey) as review_id, o_orderkey % 5000 as a, o_custkey % 5000 + 1000000 as b, {_SPLIT.format('(o_orderkey % 5000)')} as split_a, {_SPLIT.format('(o_custkey % 5000)')} as split_b, case o_orderkey % 7 when 0 then 'KEEP_A_EXCLUDE_B' when 1 then 'KEEP_B_EXCLUDE_A' when 2 then 'REVIEW_MORE' when 3 then 'PENDING' else 'KEEP_BOTH' end as decision, case when o_orderkey % 3 = 0 then ' ' else 'looked at' end as notes from orders)"
_SIDES = f"""{_DECIDED}, sides as (select review_id, decision, notes, a as image, split_a as split, b as paired, split_b as paired_split, case decision when 'KEEP_B_EXCLUDE_A' then 'EXCLUDE' when 'KEEP_BOTH' then 'KEEP' when 'KEEP_A_EXCLUDE_B' then 'KEEP' end as action from decided
 union all select review_id, decision, notes, b, split_b, a, split_a, case decision when 'KEEP_A_EXCLUDE_B' then 'EXCLUDE' when 'KEEP_BOTH' then 'KEEP' when 'KEEP_B_EXCLUDE_A' then 'KEEP' end from decided)"""
_RANK = "case {0} when 'test' then 3 when 'valid' then 2 when 'train' then 1 else 0 end"
_STATES = f"""states as (select image, 'CONFLICT' as state from sides group by 1 having count(distinct action) > 1
 union select image, 'MISMATCH' from sides where action = 'EXCLUDE' and {_RANK.format('split')} > {_RANK.format('paired_split')}
 union select image, 'NEEDS_REVIEW' from sides where (action = 'EXCLUDE' and ((trim(notes) = '' and {_RANK.format('split')} > {_RANK.format('paired_split')}) or split = 'other' or paired_split = 'other' or split = paired_split)) or decision in ('PENDING', 'REVIEW_MORE'))"""


def _images(decided):
    one = lambda x: decided.select(F.col(x).alias("image"), F.col(f"split_{x}").alias("split"))
    return one("a").union(one("b")).distinct()


@query
def curated_manifest(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    return curation.curated_manifest(_images(decided), decided)


@query
def curation_exclusions(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    return curation.exclusions(curation.curated_manifest(_images(decided), decided))


@query
def curation_totals(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    manifest = curation.curated_manifest(_images(decided), decided)
    return curation.dataset_totals(manifest.withColumns({"n0": F.col("image") % 4, "n1": F.col("image") % 3}), ["n0", "n1"])


@query
def correction_states(spark, sf_dir):
    return curation.correction_states(_decided(spark, sf_dir))


@query
def mismatch_reviews(spark, sf_dir):
    return curation.mismatch_groups(_decided(spark, sf_dir))


@query
def policy_suggestions(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy(curation.suggestion("split_a", "split_b").alias("suggestion"), "decision").agg(F.count("*").alias("n"))


@query
def classified_pairs(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    pairs = decided.selectExpr("b as a", "a as b", "split_b as split_a", "split_a as split_b").where("a % 3 <> 0").distinct()
    return curation.classified_pairs(pairs, decided).groupBy("review_status").agg(F.count("*").alias("n"), F.min("review_id").alias("least_review"))


@query
def readiness_gate(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    states = curation.correction_states(decided)
    _, orphans = checks.foreign_keys(labels, docs.select("doc_id"), "doc_id")
    table = {"pending reviews": decided.where("decision in ('PENDING', 'REVIEW_MORE')"), "conflicts": states.where("state = 'CONFLICT'"), "orphan labels": orphans, "repeated reviews": decided.groupBy("review_id").count().where("count > 1")}
    return checks.gate(spark, table)


@query
def readiness_summary(spark, sf_dir):
    return review.readiness(readiness_gate(spark, sf_dir))


@query
def image_findings(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    split = "case p_partkey % 3 when 0 then 'train' when 1 then 'valid' else 'test' end"
    images = part.where("p_partkey % 17 <> 0").selectExpr(f"{split} as split", "concat('i', p_partkey) as name", "concat('s', case when p_partkey % 13 = 0 then p_partkey - 3 else p_partkey end) as stem", "case when p_partkey % 7 = 0 then 'gif' when p_partkey % 2 = 0 then 'JPG' else 'tiff' end as suffix", "p_partkey % 19 <> 0 as readable")
    labels = part.where("p_partkey % 11 <> 0 and p_partkey % 3 <> 2").selectExpr(f"{split} as split", "concat('s', p_partkey) as stem", "p_partkey % 23 <> 0 as readable")
    return curation.image_findings(images, labels, IMAGE_SUFFIXES)


@query
def annotation_issues(spark, sf_dir):
    from annolith.plans.catalogue import label_lines

    return parse.annotation_issues(parse.parse_lines(label_lines(spark, sf_dir)), "img", "n").groupBy("issue", "severity").agg(F.count("*").alias("n"))


@query
def size_histogram(spark, sf_dir):
    from annolith.plans.catalogue import label_lines

    boxes = parse.parse_lines(label_lines(spark, sf_dir)).where("class_id is not null")
    return boxes.groupBy("class_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("size_category") == s).alias(s) for s in ("tiny", "small", "medium", "large")])


@query
def audit_totals(spark, sf_dir):
    from annolith.plans.catalogue import label_lines

    parsed = parse.parse_lines(label_lines(spark, sf_dir))
    ok = F.col("class_id").isNotNull()
    return parsed.agg(F.count("*").alias("lines"), F.count_if(ok).alias("boxes"), F.count_distinct(F.when(~ok, F.struct("img", "n"))).alias("invalid"), F.count_distinct("img").alias("images"), F.count_if(F.col("class_id") == 0).alias("class0"), F.count_if(F.col("class_id") == 1).alias("class1"), F.count_if(F.array_contains("issues", "OUT_OF_BOUNDS")).alias("out_of_bounds"))


@query
def source_group_pairs(spark, sf_dir):
    (vectors,) = tables(spark, sf_dir, "embeddings")
    hashes = duplicates.sign_hash(vectors, "vec_id", "embedding").withColumn("g", F.floor(F.col("key") / 4))
    return curation.least_distances(spark, hashes, "g", "key", "hash").select("g", "n_pairs", "least_distance")


@query
def source_group_differences(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return curation.group_signature(docs.withColumn("sig", F.sha2("text", 256)), "source", "doc_id", "sig")


@query
def set_digest(spark, sf_dir):
    """Order-free digest of each group's members, of bounded groups (their names are gathered)."""
    (nation,) = tables(spark, sf_dir, "nation")
    from annolith.functions.text import set_digest

    return nation.groupBy("n_regionkey").agg(set_digest(F.collect_list(F.concat(F.lit('"'), "n_name", F.lit('"')))).alias("digest"))


@query
def path_violations(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    paths = part.selectExpr("p_partkey as key", "case p_partkey % 6 when 0 then concat('/data/train/', p_partkey, '.jpg') when 1 then concat('/data/train/../valid/', p_partkey) when 2 then concat('data/train/', p_partkey) when 3 then '/data/train' when 4 then concat('/data/train/./x/../', p_partkey) else concat('/data/trainer/', p_partkey) end as path")
    return checks.outside(paths, "path", "/data/train")


@query
def choice_validation(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    rows = part.selectExpr("p_partkey as key", "case p_partkey % 5 when 0 then ' blur | DARK|blur' when 1 then 'dark|clear' when 2 then 'fog' when 3 then ' | ' else 'CLEAR' end as choice")
    out = checks.choices(rows, "choice", ["BLUR", "DARK", "CLEAR"], [("DARK", "CLEAR")])
    return out.select("key", F.array_join("choices", "|").alias("choices"), "problem")


@query
def latest_decisions(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return review.latest_decisions(events.select(F.col("user_id").cast("string").alias("review_id"), F.col("event_type").alias("decision"), "ts"))


@query
def decision_categories(spark, sf_dir):
    (labels,) = tables(spark, sf_dir, "labels")
    rows = labels.selectExpr("doc_id", "to_json(map('quality', quality, 'toxic', toxic)) as cell")
    cells = rows.select("doc_id", F.from_json("cell", "map<string, int>").alias("m"))
    return cells.select(F.explode("m").alias("name", "value")).groupBy("name", "value").agg(F.count("*").alias("n"))


@query
def audit_review_required(spark, sf_dir):
    from annolith.plans.catalogue import label_lines

    found = parse.annotation_issues(parse.parse_lines(label_lines(spark, sf_dir)), "img", "n").where("severity = 'REVIEW'")
    return audit.issue_status(found, "severity")


@query
def source_names(spark, sf_dir):
    from annolith.functions.text import source_group, stem

    (part,) = tables(spark, sf_dir, "part")
    names = part.select(F.expr("concat('data/', p_size, '/img', p_partkey % 500, case when p_partkey % 3 = 0 then concat('.rf.', lower(hex(p_partkey))) else '_v2' end, '.JPG')").alias("path"))
    return names.groupBy(source_group(stem(F.col("path"))).alias("source")).agg(F.count("*").alias("n"))


@query
def inventory_alignment(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    order = part.where("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("img"), (F.col("p_partkey") * 3 % 1001).alias("place"))
    inventory = part.where("p_partkey % 40 <> 9").select(F.col("p_partkey").alias("img"), F.col("p_size").alias("n"))
    rows, off = checks.aligned_inventory(order, inventory, "img", "place")
    return rows.select("img", "place", "n").unionByName(off.select("img", F.lit(-1).cast("long").alias("place"), F.lit(-1).alias("n")))


@query
def formatted_report(spark, sf_dir):
    from annolith.functions.text import decimals, escaped

    (part,) = tables(spark, sf_dir, "part")
    rows = part.selectExpr("p_partkey as key", "case when p_partkey % 9 = 0 then null else p_partkey / 8D end as v", "concat('<b>', p_size, ' & ', p_partkey, '</b>') as t")
    return rows.select("key", decimals(F.col("v"), 3).alias("v"), escaped(F.col("t")).alias("t"))


_PARTS = """i as (select case p_partkey % 3 when 0 then 'train' when 1 then 'valid' else 'test' end as split, concat('i', p_partkey) as name, concat('s', case when p_partkey % 13 = 0 then p_partkey - 3 else p_partkey end) as stem, case when p_partkey % 7 = 0 then 'gif' else 'jpg' end as suffix, p_partkey % 19 <> 0 as readable from part where p_partkey % 17 <> 0),
 l as (select case p_partkey % 3 when 0 then 'train' when 1 then 'valid' else 'test' end as split, concat('s', p_partkey) as stem, p_partkey % 23 <> 0 as readable from part where p_partkey % 11 <> 0 and p_partkey % 3 <> 2), f as (select * from i where suffix <> 'gif')"""
_BROKEN = "line like 'only%' or line like 'x %' or line like '%nan%' or line like '0.5 %' or line like '7 %' or line like '1 0.5 1.5%'"
_BOXES = f"{LINES}, v as (select *, [try_cast(t as double) for t in string_split(line, ' ')] as v, {_BROKEN} as broken from lines), z as (select *, case when not broken then v[4] * v[5] end as a from v)"
_ISSUES = f"""{_BOXES}, again as (select sum(c - 1) as n from (select count(*) as c from z group by img, case when broken then line else v::varchar end, broken) q),
 e as (select case when line like 'only%' then 'FIELD_COUNT' when line like 'x %' then 'NON_NUMERIC' when line like '%nan%' then 'NON_FINITE' when line like '0.5 %' then 'CLASS_NOT_INTEGER' when line like '7 %' then 'INVALID_CLASS_ID' else 'INVALID_COORDINATES' end as issue, 'ERROR' as severity, count(*) as n from z where broken group by 1
 union all select 'OUT_OF_BOUNDS', 'REVIEW', count(*) from z where not broken and (v[2] - v[4] / 2 < -1e-6 or v[2] + v[4] / 2 > 1 + 1e-6 or v[3] - v[5] / 2 < -1e-6 or v[3] + v[5] / 2 > 1 + 1e-6) union all select 'NEAR_ZERO', 'REVIEW', count(*) from z where not broken and least(v[4], v[5]) < 1e-4 union all select 'DUPLICATE_ANNOTATION', 'REVIEW', n from again)"""
_MANIFEST = f"""{_SIDES}, m as (select image, split, case when bool_or(coalesce(action, '') = 'EXCLUDE') then 'EXCLUDE' else 'KEEP' end as action, coalesce(string_agg(review_id, '|' order by review_id) filter (action is not null), '') as review_id, coalesce(string_agg(decision, '|' order by review_id) filter (action is not null), '') as decision,
 coalesce(string_agg(paired::varchar, '|' order by review_id) filter (action is not null), '') as paired_with, coalesce(string_agg(paired_split, '|' order by review_id) filter (action is not null), '') as paired_split from sides group by 1, 2),
 manifest as (select image, split, action, case when action = 'EXCLUDE' then '' else split end as curated_split, case when review_id <> '' then 'Human-reviewed P0 decision' else 'Retained without changes; no P0 exclusion' end as reason, review_id, decision, paired_with, paired_split from m)"""

ORACLES: dict[str, str] = {
    "curated_manifest": f"with {_MANIFEST} select * from manifest",
    "curation_exclusions": f"with {_MANIFEST} select image, split as original_split, review_id, decision, reason, paired_with, paired_split from manifest where action = 'EXCLUDE'",
    "curation_totals": f"with {_MANIFEST}, c as (select *, image % 4 as n0, image % 3 as n1, action = 'KEEP' as k from manifest) select split, count(*) as images, count(*) filter (k) as curated_images, sum(n0) as n0, coalesce(sum(n0) filter (k), 0) as curated_n0, sum(n1) as n1, coalesce(sum(n1) filter (k), 0) as curated_n1 from c group by rollup (split)",
    "correction_states": f"with {_SIDES}, {_STATES} select image, state from states",
    "mismatch_reviews": f"with {_SIDES}, {_STATES} select image, split, review_id from sides where split in ('test', 'valid') and image in (select image from states where state = 'MISMATCH')",
    "policy_suggestions": f"with {_DECIDED}, p as (select decision, case split_a when 'test' then 3 when 'valid' then 2 else 1 end as x, case split_b when 'test' then 3 when 'valid' then 2 else 1 end as y from decided) select case when x > y then 'KEEP_A_EXCLUDE_B' when y > x then 'KEEP_B_EXCLUDE_A' else 'REVIEW_MORE' end as suggestion, decision, count(*) as n from p group by 1, 2",
    "classified_pairs": f"with {_DECIDED}, p as (select distinct b as a, a as b, split_a, split_b from decided where b % 3 <> 0 and split_a <> split_b), k as (select least(a, b) as x, greatest(a, b) as y, min(review_id) as rid from decided where decision = 'KEEP_BOTH' group by 1, 2) select case when rid is null then 'UNREVIEWED_CROSS_SPLIT_CANDIDATE' else 'REVIEWED_KEEP_BOTH_CANDIDATE' end as review_status, count(*) as n, min(rid) as least_review from p left join k on x = least(a, b) and y = greatest(a, b) group by 1",
    "readiness_gate": f"with {_SIDES}, {_STATES}, n as (select 'pending reviews' as name, count(*) as violations from decided where decision in ('PENDING', 'REVIEW_MORE') union all select 'conflicts', count(*) from states where state = 'CONFLICT' union all select 'orphan labels', count(*) from labels where doc_id not in (select doc_id from documents) union all select 'repeated reviews', 0) select name, violations, violations = 0 as passed from n",
    "readiness_summary": f"with {_SIDES}, {_STATES}, n as (select count(*) as v from decided where decision in ('PENDING', 'REVIEW_MORE') union all select count(*) from states where state = 'CONFLICT' union all select count(*) from labels where doc_id not in (select doc_id from documents) union all select 0) select count(*) as n_checks, count(*) filter (v > 0) as n_failed, bool_and(v = 0) as ready from n",
    "image_findings": f"with {_PARTS} select split, stem as name, 'ORPHAN_LABEL' as issue, 'ERROR' as severity from l where not exists (select 1 from f where f.split = l.split and f.stem = l.stem) union all select split, name, 'UNSUPPORTED_EXTENSION', 'REVIEW' from i where suffix = 'gif' union all select split, name, 'AMBIGUOUS_LABEL_PAIRING', 'ERROR' from (select *, count(*) over (partition by split, stem) as n from f) q where n > 1 union all select split, name, 'IMAGE_UNREADABLE', 'ERROR' from f where not readable union all select split, name, 'MISSING_LABEL', 'ERROR' from f where not exists (select 1 from l where f.split = l.split and f.stem = l.stem) union all select f.split, name, 'LABEL_UNREADABLE', 'ERROR' from f join l on f.split = l.split and f.stem = l.stem where not l.readable union all select distinct split, split, 'MISSING_DIRECTORY', 'ERROR' from i where split not in (select split from l)",
    "annotation_issues": f"with {_ISSUES} select issue, severity, n from e where n > 0",
    "audit_review_required": f"with {_ISSUES} select 0 as n_errors, sum(n)::bigint as n_issues, 'REVIEW_REQUIRED' as status from e where severity = 'REVIEW'",
    "size_histogram": f"with {_BOXES} select v[1]::int as class_id, count(*) as n, count(*) filter (a < 0.001) as tiny, count(*) filter (a >= 0.001 and a < 0.01) as small, count(*) filter (a >= 0.01 and a < 0.1) as medium, count(*) filter (a >= 0.1) as large from z where not broken group by 1",
    "audit_totals": f"with {_BOXES} select count(*) as lines, count(*) filter (not broken) as boxes, count(distinct (img, n)) filter (broken) as invalid, count(distinct img) as images, count(*) filter (not broken and v[1] = 0) as class0, count(*) filter (not broken and v[1] = 1) as class1, count(*) filter (not broken and (v[2] - v[4] / 2 < -1e-6 or v[2] + v[4] / 2 > 1 + 1e-6 or v[3] - v[5] / 2 < -1e-6 or v[3] + v[5] / 2 > 1 + 1e-6)) as out_of_bounds from z",
    "source_group_pairs": f"with {HASHES} select a.key // 4 as g, count(*) as n_pairs, min(bit_count(xor(a.hash, b.hash)))::int as least_distance from hashes a join hashes b on a.key // 4 = b.key // 4 and a.key < b.key group by 1",
    "source_group_differences": "select source, count(*) as group_size, min(doc_id) as least, count(distinct text) > 1 as differs from documents group by 1 having count(*) > 1",
    "set_digest": "select n_regionkey, sha256(concat('[', string_agg(concat('\"', n_name, '\"'), ',' order by n_name), ']')) as digest from nation group by 1",
    "path_violations": "select p_partkey as key, case p_partkey % 6 when 1 then concat('/data/train/../valid/', p_partkey) when 2 then concat('data/train/', p_partkey) when 3 then '/data/train' else concat('/data/trainer/', p_partkey) end as path from part where p_partkey % 6 in (1, 2, 3, 5)",
    "choice_validation": "select p_partkey as key, case p_partkey % 5 when 0 then 'BLUR|DARK' when 1 then 'DARK|CLEAR' when 2 then 'FOG' when 3 then '' else 'CLEAR' end as choices, case p_partkey % 5 when 1 then 'EXCLUSIVE' when 2 then 'UNKNOWN' when 3 then 'EMPTY' end as problem from part",
    "source_names": "select case when p_partkey % 3 = 0 then concat('img', p_partkey % 500) else concat('img', p_partkey % 500, '_v2') end as source, count(*) as n from part group by 1",
    "inventory_alignment": "select p_partkey as img, p_partkey * 3 % 1001 as place, p_size as n from part where p_partkey % 50 <> 7 and p_partkey % 40 <> 9 union all select p_partkey, -1, -1 from part where (p_partkey % 50 <> 7) <> (p_partkey % 40 <> 9)",
    "formatted_report": "select p_partkey as key, case when p_partkey % 9 = 0 then 'n/a' else format('{:.3f}', p_partkey / 8.0::double) end as v, concat('&lt;b&gt;', p_size, ' &amp; ', p_partkey, '&lt;/b&gt;') as t from part",
    "latest_decisions": "select user_id::varchar as review_id, arg_max(event_type, (ts, event_type)) as decision from events group by 1",
    "decision_categories": "select name, value, count(*) as n from (select 'quality' as name, quality as value from labels union all select 'toxic', toxic from labels) q group by 1, 2",
}
