"""Mixing sources to target weights by entropy balancing.

Each source's target is its weighted share of the budget, at most CAP times its
size, the excess reshared by weight.  Document rates are the entropy-balancing
weights nearest to the uniform rate under two families of token constraints that overlap:

- each source gives its target (held exactly),
- each language keeps the share of the words that it has in the corpus (held as far as the sources allow: the dual has a ridge
  of PULL for each word of the language).

Rates are exponentially tilted odds, rate = CAP / (1 + exp(-(x + y))), with a dual variable x for each source and y for each
language, so they lie between 0 and CAP.  The dual is convex.  Newton steps solve it: for given y each source finds its own x (a
root in one variable, task by task, where its rows lie), and gives its part of the gradient and Hessian for y with x eliminated; these
are summed over all tasks, and the driver, which holds a number for each language and each pair of languages that share a source, takes the step.  The sums over documents are sums over
cells (source, language), as documents of a cell have one rate: words are added up by cell once, before any step.
Steps end when the languages' gradient, relative to their words, is below RESIDUAL.

Rates become copies by carrying the rounding error from one document to the
next in order of falling size, in groups of about GROUP documents of a source: the words
taken from a group miss its target by at most half its last, smallest documents.
A source that holds a third of all rows is many groups.

Sources weigh 5, 2, 1, repeating, by code point, null last.  Edge cases: null
text has size 0; a null language is one of its own; a source of no words has target 0; repeated rows are each
sampled; an empty table gives no rows; other columns are ignored (``mix`` passes them on).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Work

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
GROUP, PULL, RESIDUAL, MOST_STEPS = 5000, 0.02, 1e-6, 30


def _size(text):
    # words = runs of white space + 1, less one for each end of the text that is white space or empty
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n_docs, source_size) to (..., target); one row for each source in and out.

    The reshared targets are min(cap * size, weight * level) for the level that spends the budget.  Each
    round sums over all sources those that are capped and the weights of the others, and raises the level; it ends when no further source is capped.
    """
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    names = ordered.rdd.map(tuple).zipWithIndex()  # ranks all sources by code point; one small row for each
    ranked = names.map(lambda x: (*x[0], float(weights[x[1] % len(weights)]))).toDF("source string, n_docs long, source_size long, weight double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    while True:
        top = F.col("source_size") * cap <= F.col("weight") * level if level else F.col("source_size") == 0
        row = ranked.agg(F.sum(F.when(top, F.col("source_size"))).alias("capped"), F.sum(F.when(~top, F.col("weight"))).alias("open")).first()
        rest = budget - cap * (row.capped or 0)
        found = rest / row.open if row.open else math.inf
        if found <= level or math.isinf(found):
            level = found
            break
        level = found
    target = F.least(F.col("source_size") * cap, F.col("weight") * level) if not math.isinf(level) else F.col("source_size") * cap

    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


def source_dual(size: np.ndarray, y: np.ndarray, goal: float, cap: float) -> float:
    """x with sum(size * cap / (1 + exp(-(x + y)))) = goal, by Newton steps kept within a shrinking bracket."""
    total = size.sum()
    share = goal / (cap * total)
    middle = math.log(share / (1 - share))
    low, high = middle - y.max(), middle - y.min()
    x = (low + high) / 2
    for _ in range(100):
        rate = cap / (1 + np.exp(-(x + y)))
        off = float(size @ rate) - goal
        if abs(off) <= 1e-12 * goal:
            break
        low, high = (low, x) if off > 0 else (x, high)
        slope = float(size @ (rate * (1 - rate / cap)))
        x = x - off / slope if slope > 0 and low < x - off / slope < high else (low + high) / 2
    return x


def _cell_rates(y: dict[str | None, float], cap: float, derivatives: bool):
    """For each source, its cells (source, lang, size, target) with their rates, or their part of the gradient (m null) and Hessian for y."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy().astype(float)
        langs = table.column("lang").to_pylist()
        own = np.array([y.get(lang, 0.0) for lang in langs])
        goal, total = float(table.column("target")[0].as_py()), size.sum()
        full = goal >= cap * total * (1 - 1e-12)
        if full or goal <= 0:
            rate = np.full(len(size), cap if full else 0.0)
        else:
            rate = cap / (1 + np.exp(-(source_dual(size, own, goal, cap) + own)))
        if not derivatives:
            return pa.table({"source": table.column("source"), "lang": table.column("lang"), "rate": rate})
        slope = size * rate * (1 - rate / cap)
        with_x = np.diag(slope) - (np.outer(slope, slope) / slope.sum() if slope.sum() > 0 else 0)  # x follows y so that the source keeps its target
        index = np.arange(len(size))
        left, right = np.repeat(index, len(size)), np.tile(index, len(size))
        names = np.array(langs, dtype=object)
        return pa.table({
            "l": pa.array([*langs, *names[left]], pa.string()),
            "m": pa.array([*langs, *names[right]], pa.string()),
            "g": pa.array(np.concatenate([size * rate, np.zeros(len(left))])),
            "h": pa.array(np.concatenate([np.zeros(len(size)), with_x.reshape(-1)])),
        })

    return run


def balanced_rates(cells: DataFrame, work: Work, cap: float = CAP, pull: float = PULL) -> DataFrame:
    """(source, lang, rate) of each cell (source, lang, size, target); languages keep their shares as far as the sources' targets allow."""
    sums = cells.groupBy("lang").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "lang").collect()  # one row a language
    spent = cells.select("source", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    langs = [r.lang for r in sums]
    words = np.array([float(r["size"]) for r in sums])
    goals = words * (spent / words.sum()) if words.sum() else words
    y, place = np.zeros(len(langs)), {lang: k for k, lang in enumerate(langs)}
    before = math.inf
    for _ in range(MOST_STEPS):
        step = cells.groupBy("source").applyInArrow(_cell_rates(dict(zip(langs, y.tolist(), strict=True)), cap, True), "l string, m string, g double, h double")
        rows = step.groupBy("l", "m").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # pairs of languages
        at, to = (np.array([place[x] for x in rows.column(c).to_pylist()], dtype=np.int64) for c in ("l", "m"))
        gradient, hessian = -goals, np.zeros((len(langs), len(langs)))
        hessian[at, to] = rows.column("h").to_numpy()
        gradient[at[at == to]] += rows.column("g").to_numpy()[at == to]
        gradient = gradient + pull * words * y
        residual = float(np.abs(gradient / np.maximum(1.0, words)).max()) if len(words) else 0.0
        if residual < RESIDUAL or residual >= before:  # the second: no further than rounding allows
            break
        before = residual
        y = y - np.linalg.solve(hessian + np.diag(pull * np.maximum(1.0, words)), gradient)
    return work.table(cells.groupBy("source").applyInArrow(_cell_rates(dict(zip(langs, y.tolist(), strict=True)), cap, False), "source string, lang string, rate double"), "rates")


def _round(table: pa.Table) -> pa.Table:
    """Copies of a group's documents: error diffusion from the largest to the smallest."""
    size = table.column("size").to_numpy()
    ids = table.column("doc_id")
    order = np.lexsort((table.column("digest").to_numpy(), ids.fill_null(0).to_numpy(), ~ids.is_null().to_numpy(), -size))
    rate = table.column("rate").to_numpy()
    copies = np.empty(len(size), dtype=np.int64)
    owed = 0.0
    for i in order:
        owed += rate[i] * size[i]
        low = math.floor(rate[i])
        n = low if size[i] == 0 else min(math.ceil(rate[i]), max(low, round(owed / size[i])))
        copies[i] = n
        owed -= n * size[i]
    return table.append_column("copies", pa.array(copies)).select(["doc_id", "size", "source_size", "target", "copies"])


def mix(spark: SparkSession, docs: DataFrame, work: Work) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row."""
    # digest: tells rows of one identifier (or none) and size apart, so that reruns agree
    sized = work.table(docs.select("doc_id", "source", "lang", _size(F.col("text")).alias("size"), F.xxhash64("text", "lang").alias("digest")), "sizes")
    sources = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    targets = work.table(source_targets(sources), "targets")
    cells = sized.groupBy("source", "lang").agg(F.sum("size").alias("size")).where("size > 0").alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source"))
    cells = work.table(cells.select("c.source", "c.lang", "c.size", "t.target"), "cells")
    rates = balanced_rates(cells, work)
    joined = sized.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).join(rates.alias("r"), F.expr("d.source <=> r.source and d.lang <=> r.lang"), "left")
    group = F.pmod(F.xxhash64("d.doc_id", "d.size"), F.greatest(F.lit(1), F.ceil(F.col("t.n_docs") / GROUP))).alias("group")
    dealt = joined.select("d.doc_id", "d.source", "d.size", "d.digest", "t.source_size", "t.target", F.coalesce("r.rate", F.lit(1.0)).alias("rate"), group)  # a cell without words: every document once
    return dealt.groupBy("source", "group").applyInArrow(_round, "doc_id long, size long, source_size long, target double, copies long")


def mixture(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    out = mix(spark, docs, Work(spark, "mixing"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to CAP times)."""
    copies = mix(spark, docs, Work(spark, "mixing"))
    # Rows that share a doc_id share their copies; where they differ, each such row takes the mean, rounded.
    by_id = copies.groupBy("doc_id").agg(F.round(F.avg("copies")).cast("int").alias("copies")).withColumnRenamed("doc_id", "own_id")
    names = [f"c{k}" for k in range(len(docs.columns))]  # by place: docs may have any names
    joined = docs.toDF(*names).join(by_id, F.expr(f"{names[docs.columns.index('doc_id')]} <=> own_id"))
    return joined.withColumn("copy", F.explode(F.expr("array_repeat(1, copies)"))).select(*names).toDF(*docs.columns)
