"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters (all-capital words kept apart from the same word in other cases), of digits, and of punctuation; their unigrams and
bigrams are hashed into BUCKETS weights.  A text's features are its n-gram
shares times SCALE, so long and short texts weigh alike.  Training (FTRL-proximal, per-coordinate
rates, L1 and L2) sees at most MOST_TRAINING labelled texts, those of least
hash of doc_id, in that order; this bound is a parameter.  Scoring is a sparse dot product, done with numpy
for a slice of texts at once against the broadcast weights (BUCKETS * 4 bytes).  The counted features of the training texts are written
once; the driver holds them all if they take HELD_BYTES at most, and else reads them again, one of PARTS parts at a time, in each epoch.

Edge cases: null and empty texts score the bias alone; documents without a
label, with a null label or a null doc_id are not learned from; of several labels of one document the
largest counts; without any training row every score is 0.5; repeated rows are
each scored; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, crc32_of_id, tidy
from .textvec import Slice, folding, mix, slices

BUCKETS, SCALE, MOST_TRAINING, EPOCHS = 1 << 18, 20.0, 6000, 3
HELD_BYTES, PARTS = 128 << 20, 64
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0
_TABLE = folding(lower=True)
_SPACE, _LETTERS, _DIGITS, _SIGNS = 0, 1, 2, 3
_KIND = np.full(256, _SIGNS, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x30:0x3A] = _DIGITS
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _LETTERS


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the hashed unigrams and bigrams of text i are buckets[bounds[i] : bounds[i + 1]], in no particular order."""
    n = len(s.data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(s.n_texts + 1, dtype=np.int64)
    kind = _KIND[s.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[s.offsets] = True
    inside = kind != _SPACE
    begins, ends = np.flatnonzero(edge[:n] & inside), np.flatnonzero(edge[1:] & inside) + 1
    hashes = s.hashes(begins, ends, _TABLE)
    capitals = np.concatenate([[0], np.cumsum((s.data >= 0x41) & (s.data <= 0x5A))])
    shouted = (ends - begins > 1) & (capitals[ends] - capitals[begins] == ends - begins)
    hashes[shouted] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
    bounds = np.searchsorted(begins, s.offsets)
    shift = np.uint64(64 - 18)
    single = mix(hashes) >> shift
    pairs = np.zeros(len(hashes), dtype=np.uint64)  # a text's first word pairs with nothing but its start
    pairs[1:] = hashes[:-1]
    pairs[bounds[:-1][bounds[:-1] < len(hashes)]] = 17
    double = mix(hashes * np.uint64(5) + pairs * np.uint64(0x9E3779B97F4A7C15)) >> shift
    both = np.stack([single, double], axis=1).reshape(-1).astype(np.int64)
    return both, 2 * bounds


class Ftrl:
    """FTRL-proximal for one dense weight table; z and n are its sums of gradients and squared gradients."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(spark: SparkSession, labelled: DataFrame, most: int = MOST_TRAINING, held_bytes: int = HELD_BYTES) -> np.ndarray:
    """Weights (the bias last) from columns doc_id, text, label; at most ``most`` rows, as counted features."""

    @tidy
    def shrink(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                buckets, bounds = features(s)
                ids, labels = batch.column(0).slice(s.first, s.n_texts), batch.column(2).slice(s.first, s.n_texts)
                packed = []
                for i in range(s.n_texts):
                    u, c = np.unique(buckets[bounds[i] : bounds[i + 1]], return_counts=True)
                    packed.append(np.stack([u, c], axis=1).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(packed, pa.binary())], names=["doc_id", "label", "counts"])

    counted = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(shrink, "doc_id long, label int, counts binary")
    rank = ["rank", "doc_id", "counts"]
    work = Work(spark, "classifier")
    written = work.table(counted.withColumn("rank", F.xxhash64("doc_id")), "counted", "none")
    total = written.agg(F.count("*").alias("n"), F.sum(F.length("counts")).alias("bytes")).first()
    if total.n > most:  # rows that share a labelled doc_id
        written = written.orderBy(*rank).limit(most)
    if (total.bytes or 0) <= held_bytes:
        rows = sorted(written.collect(), key=lambda r: (r.rank, r.doc_id, r.counts))
    else:
        rows = None
        ordered = work.table(written.repartitionByRange(PARTS, *rank).sortWithinPartitions(*rank), "ordered", "none")
    model = Ftrl(BUCKETS)
    for _ in range(EPOCHS):
        for r in rows if rows is not None else ordered.toLocalIterator():
            pairs = np.frombuffer(r.counts, dtype="<i4").reshape(-1, 2)
            at = np.append(pairs[:, 0].astype(np.int64), BUCKETS)
            x = np.append(pairs[:, 1] * (SCALE / max(1, int(pairs[:, 1].sum()))), 1.0)
            model.update(at, x, float(r.label))
    work.close()
    return model.weights(np.arange(BUCKETS + 1)).astype(np.float32)


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = spark.sparkContext.broadcast(weights)

    @tidy
    def run(batches):
        w = shared.value
        for batch in batches:
            for s in slices(batch.column(1)):
                buckets, bounds = features(s)
                total = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=np.float64)])
                mean = (total[bounds[1:]] - total[bounds[:-1]]) * SCALE / np.maximum(1, np.diff(bounds))
                out = 1 / (1 + np.exp(-np.clip(mean + float(w[-1]), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n_texts), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels whose crc32(doc_id) mod 5 is not 0."""
    usable = labels.where("quality is not null and doc_id is not null").where(crc32_of_id(F.col("doc_id")) % 5 != 0)
    one = usable.groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "label_id")  # ``most`` rows bound the broadcast
    training = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    weights = train(spark, training, most)
    fold = F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    return score(spark, docs, weights).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
