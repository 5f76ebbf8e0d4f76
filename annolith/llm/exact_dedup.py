"""Exact dedup by content sort.

Texts are normalised (A-Z to a-z), range-partitioned by sampled splitters over
their first KEY characters and sorted within partitions by Spark's
external sort, so equal texts become neighbours.  Neighbours are compared in
full.  Only texts that agree in their first KEY characters are put in order by their SHA-256, so that
the sample that fixes the splitters (which the driver holds) never carries a long text.
doc_id ends the key, so a text held by a third of all rows spreads over
many partitions; the first and last run of each partition are stitched by a
grouping of these runs alone on the full text.

The row with the largest doc_id of each run stays.  Edge cases: null text equals the empty text; a null doc_id
counts as smaller than any; of rows equal in both text and doc_id exactly one
is kept; an empty table gives no rows; other columns pass through
``deduplicate`` and are ignored by ``exact_dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, lower_ascii, shuffle_partitions, tidy

KEY = 64
#: edge: 0 for a run within its partition, 1 for one that may go on in another; text: only in one row of each such run
RUNS = "doc_id long, rank long, sha string, part int, run long, edge int, size long, best long, best_rank long, text string"


@tidy
def _runs(batches):
    """Rows of a sorted partition with their runs; the rows of the last run of a batch are held back (identifiers only) until it ends."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, rank = 0, 0  # of the first row that is held back
    ids, null = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    text = sha = None  # of the run that is held back

    def given(ids, null, shas, texts, starts, edge):
        """Whole runs: run k has the rows starts[k] : starts[k + 1]; rows come in ascending doc_id (nulls first), so its last is the largest."""
        size = np.diff(starts)
        of = np.repeat(np.arange(len(size)), size)
        end = starts[1:] - 1
        head = np.zeros(len(ids), dtype=bool)
        head[starts[:-1]] = edge
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(rank + np.arange(len(ids))), shas.take(pa.array(of)), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(run + of), pa.array(edge[of].astype(np.int32)), pa.array(size[of]), pa.array(ids[end][of], mask=null[end][of]), pa.array(rank + end[of]), pc.if_else(pa.array(head), texts.take(pa.array(of)), pa.scalar(None, pa.string()))],
            names=["doc_id", "rank", "sha", "part", "run", "edge", "size", "best", "best_rank", "text"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm, shas = batch.column("norm"), batch.column("sha")
        own = batch.column("doc_id")
        new = np.ones(n, dtype=bool)
        new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = text is not None and norm[0].as_py() != text
        begins = np.flatnonzero(new)
        held = len(ids)
        ids = np.concatenate([ids, own.fill_null(0).to_numpy(zero_copy_only=False)])
        null = np.concatenate([null, own.is_null().to_numpy(zero_copy_only=False)])
        if len(begins):
            starts = np.concatenate([[0], held + begins])
            first = begins[:-1]  # rows of this batch where the runs begin that end in it
            edge = np.zeros(len(begins), dtype=bool)
            edge[0] = run == 0
            whole = [pa.array([x], pa.string()) if text is not None else y.slice(0, 1) for x, y in ((sha, shas), (text, norm))]
            texts = [pa.concat_arrays([x, y.take(pa.array(first))]) for x, y in zip(whole, (shas, pa.nulls(n, pa.string())), strict=True)]
            stop = starts[-1]
            yield given(ids[:stop], null[:stop], *texts, starts, edge)
            run, rank = run + len(begins), rank + int(stop)
            ids, null = ids[stop:], null[stop:]
        text, sha = norm[n - 1].as_py(), shas[n - 1].as_py()
    if len(ids):
        yield given(ids, null, pa.array([sha]), pa.array([text]), np.array([0, len(ids)]), np.array([True]))


def mark_copies(spark: SparkSession, docs: DataFrame, work: Work) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    norm = docs.select("doc_id", lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    keyed = norm.select("doc_id", "norm", F.substring("norm", 1, KEY).alias("key"), F.sha2("norm", 256).alias("sha"))
    order = ["key", F.unhex("sha"), "doc_id"]
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    runs = work.table(ordered.select("doc_id", "norm", "sha").mapInArrow(_runs, RUNS), "runs")
    edges = runs.where("edge = 1 and text is not null").groupBy("text").agg(
        F.sum("size").alias("size"),
        F.max(F.struct(F.coalesce("best", F.lit(-(1 << 63))).alias("id"), "part", "best_rank")).alias("top"),
        F.collect_list(F.struct("part", "run")).alias("members"),  # two runs of each partition at most
    )
    edges = edges.select(F.explode("members").alias("m"), F.col("size").alias("all_size"), "top").select("m.part", "m.run", "all_size", F.col("top.part").alias("top_part"), F.col("top.best_rank").alias("top_rank"), F.expr("nullif(top.id, bigint('-9223372036854775808'))").alias("top_id"))
    inner = runs.where("edge = 0").select("doc_id", F.col("best").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rank") == F.col("best_rank")).alias("kept"), F.col("sha").alias("text_sha256"))
    outer = runs.where("edge = 1").join(edges, ["part", "run"]).select("doc_id", F.col("top_id").alias("keep_id"), F.col("all_size").alias("group_size"), ((F.col("part") == F.col("top_part")) & (F.col("rank") == F.col("top_rank"))).alias("kept"), F.col("sha").alias("text_sha256"))
    return inner.unionByName(outer)


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mark_copies(spark, docs, Work(spark, "exact"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without its copies; all its columns.  Of equal texts the row of the largest doc_id stays."""
    marks = Work(spark, "exact-marks").table(exact_dedup(spark, docs), "marks")
    names = [f"c{k}" for k in range(len(docs.columns))]  # by place: docs may have any names
    named = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(x)] for x in ("doc_id", "text"))
    kept = marks.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    own = F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256)
    joined = named.withColumn("own_sha", own).join(kept, F.expr(f"{doc_id} <=> kept_id and own_sha = kept_sha"), "left_semi")
    if not marks.where("not kept and doc_id <=> keep_id").isEmpty():  # rows that share identifier and text: one of them stays
        joined = joined.dropDuplicates([doc_id, "own_sha"])
    return joined.select(*names).toDF(*docs.columns)
