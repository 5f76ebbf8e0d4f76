"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (1 to 4 bytes within a word, lower-cased
ASCII, words bounded by a mark) of every training text, task by task, into one
matrix of languages by buckets; the tasks' matrices are summed.  The smoothed
log-probabilities form a matrix of 2**BITS rows that is broadcast: 128 KB for each language, however many texts there are.  Scoring adds up its rows with numpy, without a
Python loop over n-grams, and the logarithm of the language's share of the training texts (the prior).

Edge cases: null texts and texts without a letter are ``und`` with score 0; a
table without a training row gives ``und`` everywhere; rows whose language is
null are never learned from; repeated rows are each scored; other columns are
ignored.  Letters are the characters of the Unicode categories L*.  Of equally likely languages the first by code point is taken.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, tidy
from .textvec import Slice, mix, slices

BITS, ORDERS = 15, (1, 2, 3, 4)
FEW_CELLS, SLICE = 1 << 20, 1 << 18
UND = "und"
#: What the pipeline keeps: documents whose likeliest language has this share at least.
SURE = 0.5
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """languages in code-point order; weights [bucket, language]; prior of each language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    bits: int


def _keys(order: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * order + 7))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0x20  # what is no letter parts words
_TABLES = [_keys(k) for k in range(max(ORDERS))]


def features(s: Slice, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (buckets of the n-grams, bounds): text i has buckets[bounds[i] : bounds[i + 1]].

    n-grams hold at most one word mark, at either end, and never cross texts.
    """
    folded = _FOLD[s.data]
    mark = folded == 0x20
    owner_edge = s.offsets
    parts = [(t[folded] & np.uint64(0xFFFFFFFF)) for t in _TABLES]
    out = []
    n = len(folded)
    for order in ORDERS:
        m = n - order + 1
        if m <= 0:
            out.append((np.zeros(0, dtype=np.int64), np.zeros(s.n_texts + 1, dtype=np.int64)))
            continue
        total = parts[0][:m].copy()
        fine = ~mark[:m] if order == 1 else ~(mark[:m] & mark[1 : m + 1])
        for k in range(1, order):
            total += parts[k][k : k + m] * np.uint64(2 * k + 1)
            if 0 < k < order - 1:
                fine &= ~mark[k : k + m]
        if order > 1:
            for k in range(1, order):
                at = owner_edge[1:-1] - k
                fine[at[(at >= 0) & (at < m)]] = False
        at = np.flatnonzero(fine)
        out.append((((total[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(at, np.minimum(s.offsets, m))))
    return out


def train(training: DataFrame, bits: int = BITS) -> Model:
    """From columns lang and text, all rows; 2**bits buckets."""
    usable = training.where("lang is not null and text is not null").select("lang", "text")
    size = 1 << bits

    @tidy
    def count(batches):
        known: dict[str, np.ndarray] = {}  # counts of the buckets, then the number of texts
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for s in slices(batch.column(1), SLICE):
                codes: dict[str, int] = {}
                own = np.array([codes.setdefault(x, len(codes)) for x in langs[s.first : s.first + s.n_texts]], dtype=np.int64)
                found = [np.repeat(own, np.diff(bounds)) * size + buckets for buckets, bounds in features(s, bits)]
                if len(codes) * size <= FEW_CELLS:
                    table = sum(np.bincount(x, minlength=len(codes) * size) for x in found)
                    cells = np.flatnonzero(table)
                    n = table[cells]
                else:
                    cells, n = np.unique(np.concatenate(found), return_counts=True)
                starts = np.searchsorted(cells, np.arange(len(codes) + 1) * size)
                texts = np.bincount(own, minlength=len(codes))
                for lang, k in codes.items():
                    row = known.setdefault(lang, np.zeros(size + 1, dtype=np.int64))
                    row[cells[starts[k] : starts[k + 1]] - k * size] += n[starts[k] : starts[k + 1]]
                    row[size] += texts[k]
        for lang, row in known.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at])], names=["lang", "bucket", "n"])

    rows = usable.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each language and bucket at most
    languages = sorted(rows.column("lang").unique().to_pylist())
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((size + 1, len(languages)))
    counts[rows.column("bucket").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    grams, texts = counts[:size] + 0.5, counts[size]
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), np.log(texts / max(1.0, texts.sum())), bits)


def _columns(s: Slice, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(summed log-probabilities of each text and language, number of n-grams of each text)."""
    n_langs = len(model.languages)
    out, size = np.zeros((s.n_texts, n_langs)), np.zeros(s.n_texts, dtype=np.int64)
    for buckets, bounds in features(s, model.bits):
        for k in range(n_langs):
            total = np.concatenate([[0.0], np.cumsum(model.weights[:, k][buckets], dtype=np.float64)])
            out[:, k] += total[bounds[1:]] - total[bounds[:-1]]
        size += np.diff(bounds)
    return out, size


def identify(spark: SparkSession, docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """docs (its ``columns``, the text among them) with lang_pred and score: the share of the likeliest language, by mean log-probability of ten n-grams."""
    shared = spark.sparkContext.broadcast(Model(model.languages, np.asfortranarray(model.weights), model.prior, model.bits))  # 4 * 2**bits bytes a language
    shape = docs.select(*columns)
    text = columns.index("text")

    @tidy
    def score(batches):
        model = shared.value
        names = np.array([*model.languages, UND], dtype=object)
        for batch in batches:
            preds, scores = [], []
            for s in slices(batch.column(text), SLICE):
                raw = s.data.tobytes()
                high = np.concatenate([[0], np.cumsum((_FOLD[s.data] != 0x20) & (s.data < 0x80))])
                letters = high[s.offsets[1:]] > high[s.offsets[:-1]]
                for i in np.flatnonzero(~letters):
                    letters[i] = _LETTER.search(raw[s.offsets[i] : s.offsets[i + 1]].decode()) is not None
                if not model.languages:
                    letters[:] = False
                best, share = np.full(s.n_texts, len(model.languages)), np.zeros(s.n_texts)
                if letters.any():
                    sums, size = _columns(s, model)
                    mean = (sums + model.prior) * (10 / np.maximum(10.0, size))[:, None]
                    top = np.argmax(mean, axis=1)
                    best[letters] = top[letters]
                    share[letters] = (1 / np.exp(mean - mean[np.arange(len(top)), top][:, None]).sum(axis=1))[letters]
                preds += names[best].tolist()
                scores.append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*(f"c{k}" for k in range(len(columns))), "lang_pred", "score"])

    fields = ", ".join(f"c{k} {shape.schema[k].dataType.simpleString()}" for k in range(len(columns)))
    out = shape.toDF(*(f"c{k}" for k in range(len(columns)))).mapInArrow(score, f"{fields}, lang_pred string, score double")
    return out.toDF(*columns, "lang_pred", "score")  # by place: a column of docs may have either name


def _fold():
    return F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents whose crc32(doc_id) mod 4 is not 2."""
    model = train(docs.where(~_fold()).select("lang", "text"))
    return identify(spark, docs, model, ["doc_id", "text"]).select("doc_id", _fold().alias("held_out"), "lang_pred", "score")


def with_known_language(spark: SparkSession, docs: DataFrame, keep: Collection[str] | None = None, sure: float = SURE) -> DataFrame:
    """docs that are in a language of ``keep`` (None: any that was learned), told with a share of ``sure`` at least; all their columns.

    Texts that are ``und`` go, and so do texts of no learned language, whose n-grams fit several about equally.
    Learns from the documents of language_id's training folds.
    """
    model = train(docs.where(~_fold()).select("lang", "text"))
    named = [f"c{k}" for k in range(len(docs.columns))]
    found = identify(spark, docs, model, docs.columns).toDF(*named, "pred", "score")
    wanted = F.col("pred") != UND if keep is None else F.col("pred").isin(*keep)
    return found.where(wanted & (F.col("score") >= sure)).select(*named).toDF(*docs.columns)
