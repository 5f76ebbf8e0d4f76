"""Named queries that write files in the formats of the sources and read them back, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolith.functions.text import canonical_id
from annolith.operators import matching, parse
from annolith.plans import catalogue
from annolith.plans.registry import query
from annolith.plans.sql import LINES, ORACLES as _KNOWN
from annolith.sources import tables as sources
from annolith.sources.tables import tables
from annolith.sources.work import Work

FOLDERS = 100


@query
def label_files(spark, sf_dir):
    """Label lines written as text files (with a byte order mark) and scanned again: label, line_number, line."""
    lines = catalogue.label_lines(spark, sf_dir).withColumn("label", F.col("img") % FOLDERS)
    order = F.struct("img", "n", "line")
    marked = lines.withColumn("value", F.col("line")).repartition("label").sortWithinPartitions("label", order)
    where = f"{Work(spark, 'labels').path}/labels"
    marked.select("label", "value").write.partitionBy("label").text(where)
    found = sources.label_lines(spark, where)
    return found.select(F.regexp_extract("path", "label=([0-9]+)", 1).cast("long").alias("label"), F.col("line_number").cast("long").alias("line_number"), "line")


@query
def pixel_boxes(spark, sf_dir):
    """Label lines of known numbers, parsed and turned into pixel corners of images of different sizes."""
    (items,) = tables(spark, sf_dir, "lineitem")
    part = lambda e: F.format_string("%d.%03d", F.expr(f"({e}) div 1000"), F.expr(f"({e}) % 1000"))
    line = F.concat_ws(" ", (F.col("l_partkey") % 2).cast("string"), part("l_partkey * 7 % 1000"), part("l_suppkey * 5 % 1000"), part("1 + l_linenumber * 31 % 400"), part("1 + l_suppkey * 3 % 300"))
    lines = items.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("img"), F.lit(1).alias("n"), line.alias("line"), (F.lit(400) + F.col("l_orderkey") % 100).alias("width"), (F.lit(300) + F.col("l_partkey") % 50).alias("height"))
    parsed = parse.parse_lines(lines)
    return sources.pixel_boxes(parsed, "img")


@query
def csv_report(spark, sf_dir):
    """A report of named columns and the strict reading of it."""
    (part,) = tables(spark, sf_dir, "part")
    path, fields = f"{Work(spark, 'report').path}/report.csv", ["p_partkey", "p_name", "p_size", "p_retailprice"]
    sources.write_report(part.withColumn("ignored", F.lit(1)), path, fields)
    return sources.strict_csv(spark, path, T.StructType([part.schema[f] for f in fields]))


@query
def json_case_files(spark, sf_dir):
    """Images with their ground truth and predictions as JSON documents, one a line, read back and matched: outcomes by class."""
    gt, a, _ = catalogue._boxes(spark, sf_dir)
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    truth = gt.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("j", F.struct(F.col("c").cast("int").alias("class_id"), box).alias("b")))).alias("g"))  # the boxes of one image
    found = a.groupBy(F.col("img").alias("p_img")).agg(F.sort_array(F.collect_list(F.struct("i", F.struct(F.col("c").cast("int").alias("class_id"), F.col("s").alias("confidence"), box).alias("b")))).alias("p"))
    cases = truth.join(found, F.col("img") == F.col("p_img"), "full_outer").select(F.coalesce("img", "p_img").cast("string").alias("image"), F.lit(100).alias("width"), F.lit(100).alias("height"), F.transform("g", lambda x: x["b"]).alias("ground_truth"), F.transform("p", lambda x: x["b"]).alias("predictions"))
    bucket = F.pmod(F.xxhash64("image"), F.lit(FOLDERS))
    where = f"{Work(spark, 'cases').path}/cases"
    cases.withColumn("bucket", bucket).repartition("bucket").write.json(where)
    g, p = sources.case_boxes(sources.json_cases(spark, where, lines=True))
    return matching.object_outcomes(g, p.where("s >= 0.25")).groupBy("c", "outcome").agg(F.count("*").alias("n"))


@query
def epoch_metrics_file(spark, sf_dir):
    """A metrics file whose header and values are padded with blanks, a row for each day of events."""
    (events,) = tables(spark, sf_dir, "events")
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    text = days.select(F.concat(F.lit("  "), F.col("day").cast("string"), F.lit(" ,   "), F.col("n").cast("string"), F.lit(","), F.col("errors").cast("string"), F.lit("  ")).alias("value"), F.lit(1).alias("k"))
    head = spark.createDataFrame([("   day,  n  , errors ", 0)], "value string, k int")
    where = f"{Work(spark, 'epochs').path}/results"
    head.unionByName(text).coalesce(1).sortWithinPartitions("k").select("value").write.text(where)  # a line for each day
    return sources.trimmed_csv(spark, where).select("day", F.col("n").cast("long").alias("n"), F.col("errors").cast("long").alias("errors"))


@query
def evidence_rows(spark, sf_dir):
    """The evidence of each order, gathered and told row by row in its fixed order."""
    (items,) = tables(spark, sf_dir, "lineitem")
    rows = sources.evidence_by_image(items.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey")
    return rows.select("l_orderkey", F.posexplode("evidence").alias("place", "e")).select("l_orderkey", "place", "e.*")


@query
def metrics_documents(spark, sf_dir):
    """Metrics as JSON and as CSV, overall and by class, as they are read back."""
    (labels,) = tables(spark, sf_dir, "labels")
    figures = [F.count("*").alias("n"), F.avg(F.col("toxic").cast("double")).alias("share")]
    folder = f"{Work(spark, 'metrics').path}/m"
    sources.write_metrics(labels.agg(*figures), labels.groupBy(F.col("quality").alias("class_id")).agg(*figures), folder, ["n", "share"])
    columns = ["scope", "class_id", "n", "share"]
    kinds = "scope string, class_id int, n long, share double"
    both = spark.read.schema(kinds).csv(f"{folder}/metrics.csv", header=True).select(*columns, F.lit("csv").alias("format")).unionByName(spark.read.schema(kinds).json(f"{folder}/metrics.json", multiLine=True).select(*columns, F.lit("json").alias("format")))
    return both.withColumn("share", F.round("share", 9))


@query
def published_outputs(spark, sf_dir):
    """A table published twice: what stands there now, what was archived, and a version that is never replaced."""
    docs, _ = tables(spark, sf_dir, "documents", "labels")
    work = Work(spark, "published")
    folder = f"{work.path}/out"
    kept = docs.select("doc_id", "lang", "source")
    sources.publish(spark, kept.where("doc_id % 2 = 0"), folder, "doc_id")
    archive = sources.prepare_output(spark, folder, overwrite=True)
    sources.publish(spark, kept, folder, "doc_id")
    version = sources.write_version(kept.where("doc_id % 3 = 0"), f"{work.path}/versions", "v1")
    out = [spark.read.parquet(x).groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).withColumn("which", F.lit(name)) for name, x in (("now", folder), ("archive", archive), ("v1", version))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def canonical_ids(spark, sf_dir):
    """Identifiers of JSON values whose keys come in another order."""
    (part,) = tables(spark, sf_dir, "part")
    return part.select("p_partkey", canonical_id(F.to_json(F.struct(F.col("p_type").alias("b"), F.col("p_partkey").alias("a")))).alias("id"))


_D = "(({0}) % 1000)::double / 1000"
ORACLES = {
    "label_files": f"with {LINES} select * from (select img % {FOLDERS} as label, row_number() over (partition by img % {FOLDERS} order by img, n, line) as line_number, line from lines) q where trim(line) <> ''",
    "pixel_boxes": """with b as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as img, l_partkey % 2 as c, (l_partkey * 7 % 1000)::double / 1000 as x, (l_suppkey * 5 % 1000)::double / 1000 as y, (1 + l_linenumber * 31 % 400)::double / 1000 as w, (1 + l_suppkey * 3 % 300)::double / 1000 as h, 400 + l_orderkey % 100 as iw, 300 + l_partkey % 50 as ih from lineitem)
 select img, c, (x - w / 2) * iw as x1, (y - h / 2) * ih as y1, (x + w / 2) * iw as x2, (y + h / 2) * ih as y2 from b""",
    "csv_report": "select p_partkey, p_name, p_size, p_retailprice from part",
    "json_case_files": f"select c, outcome, count(*) as n from ({_KNOWN['object_outcomes']}) q group by 1, 2",
    "epoch_metrics_file": "select ts::date::varchar as day, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by 1",
    "evidence_rows": "select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) - 1 as place, l_partkey, l_suppkey, l_linenumber from lineitem",
    "metrics_documents": "with m as (select 'overall' as scope, null as class_id, count(*) as n, round(avg(toxic), 9) as share from labels union all select 'class', quality, count(*), round(avg(toxic), 9) from labels group by 2) select *, unnest(['csv', 'json']) as format from m",
    "published_outputs": "select lang, count(*) as n, max(doc_id) as last, which from (select lang, doc_id, unnest(list_filter(['now', case when doc_id % 2 = 0 then 'archive' end, case when doc_id % 3 = 0 then 'v1' end], lambda x: x is not null)) as which from documents) q group by 1, 4",
    "canonical_ids": """select p_partkey, sha256('{"a": ' || p_partkey || ', "b": "' || p_type || '"}')[1:16] as id from part""",
}
