"""Packing: deficit round-robin over one queue for each source fills every window to the sources' token proportions.

Each source's documents form a queue of tokens.  Windows are blocks of sequences, long enough that a queue's mean
quantum is LEAST_RUN tokens, so that documents are not cut to shreds.  A window takes from every
queue its quantum, window * (the source's target share), in one run, and what a
quantum leaves over as a fraction is carried to the next window: the first k queues have given
floor(w * their quanta) tokens after w windows.  These deficits are thus known in closed form at every window, across all
partitions, and every task cuts its own documents without waiting for another.

``targets`` are weights of the sources; without them the proportions are the corpus's own, which empty
all queues at once.  With other targets some queue runs dry first: the mixture then goes on with
the others, in the same proportions among them (a new phase; there are as many as queues at most).
Every token is packed.  What is left over after the full windows of a phase, less than a window, follows them queue by queue.
All sequences are full but those of the end, which are powers of two and need no padding.

Edge cases: null text is empty (its end id is still packed); a null source is a
queue of its own; repeated rows are each packed; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work, binary_array, tidy
from .tokens import encode_column, encoder, tokenizer_path

LEAST_RUN = 1024
ENCODED = "doc_id long, source string, part int, local long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Phase:
    """Who gives which tokens to which window while all queues last.  All numbers are Python integers, so nothing overflows.

    totals: tokens of each queue; position: of the phase's first token in the packed stream.
    Queues that give less than a token a window wait for the end of the phase.
    """

    def __init__(self, totals: list[int], window: int, position: int):
        self.totals, self.window, self.position = totals, window, position
        whole = sum(totals)
        regular = [t if t * window >= whole else 0 for t in totals]
        self.ahead = [0, *accumulate(regular)]  # tokens of the first k regular queues
        self.all = self.ahead[-1]
        self.windows = self.all // window
        left = [t - self.given(k, self.windows) for k, t in enumerate(totals)]
        self.tail = [self.windows * window + x for x in [0, *accumulate(left)]]

    def start(self, k: int, w: int) -> int:
        """Tokens that the queues before k have given to the first w windows."""
        return self.ahead[k] * self.window * w // self.all if self.all else 0

    def given(self, k: int, w: int) -> int:
        return self.start(k + 1, w) - self.start(k, w)

    def find(self, k: int, at: int) -> int:
        """The window that takes this token of queue k (self.windows: the end of the phase)."""
        quantum = (self.ahead[k + 1] - self.ahead[k]) * self.window
        if not quantum:
            return self.windows
        w = min(self.windows, at * self.all // quantum)
        while w and self.given(k, w) > at:
            w -= 1
        while w < self.windows and self.given(k, w + 1) <= at:
            w += 1
        return w

    def runs(self, k: int, at: int, length: int):
        """(tokens, place in the packed stream) of the tokens at : at + length of queue k."""
        while length:
            w = self.find(k, at)
            before = self.given(k, w)
            if w == self.windows:
                n, place = length, self.tail[k] + at - before
            else:
                n = min(length, self.given(k, w + 1) - at)
                place = w * self.window + self.start(k, w + 1) - self.start(k, w) + at - before
            yield n, self.position + place
            at, length = at + n, length - n


class Schedule:
    """Phases of queues with ``totals`` tokens; weights: target proportions (None: the totals)."""

    def __init__(self, totals: list[int], capacity: int, weights: list[float] | None = None, least_run: int = LEAST_RUN):
        self.capacity, self.all = capacity, sum(totals)
        window = capacity * max(1, -(-len(totals) * least_run // capacity))
        self.phases: list[Phase] = []
        #: For each queue, where its tokens of each phase begin.
        self.begins: list[list[int]] = [[] for _ in totals]
        left = list(totals)
        while any(left):
            share = None if weights is None else [w if x else 0 for w, x in zip(weights, left, strict=True)]
            if share is None or not any(share):
                give = list(left)
            else:
                lasts = min(Fraction(x) / Fraction(w) for x, w in zip(left, share, strict=True) if w)
                give = [min(x, math.floor(lasts * Fraction(w))) for x, w in zip(left, share, strict=True)]
                give = [x if w and Fraction(x) / Fraction(w) == lasts else g for g, x, w in zip(give, left, share, strict=True)]
            for own, t, x in zip(self.begins, totals, left, strict=True):
                own.append(t - x)
            self.phases.append(Phase(give, window, self.all - sum(left)))
            left = [x - g for x, g in zip(left, give, strict=True)]

    def runs(self, k: int, at: int, length: int):
        """(tokens, place in the packed stream) of the tokens at : at + length of queue k."""
        while length:
            p = bisect_right(self.begins[k], at) - 1
            end = self.begins[k][p] + self.phases[p].totals[k]
            n = min(length, end - at)
            yield from self.phases[p].runs(k, at - self.begins[k][p], n)
            at, length = at + n, length - n

    def sequences(self, at: int, length: int):
        """Cuts tokens at : at + length of the whole packed stream where sequences end: (part of the length, sequence_id, offset)."""
        while length:
            full = self.all // self.capacity
            k = at // self.capacity
            if k < full:
                offset, size, number = at - k * self.capacity, self.capacity, k
            else:
                left, number, offset = self.all - full * self.capacity, full, at - full * self.capacity
                size = 1 << (left.bit_length() - 1)
                while offset >= size:
                    offset, left, number = offset - size, left - size, number + 1
                    size = 1 << (left.bit_length() - 1)
            n = min(length, size - offset)
            yield n, number, offset
            at, length = at + n, length - n


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """ids of every document (two bytes each where the vocabulary allows), with its place in its source's queue of this partition."""

    @tidy
    def encode(batches):
        from pyspark import TaskContext

        part, used = TaskContext.get().partitionId(), {}
        kind = np.dtype("<u2") if encoder(path).n_ids <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            sources = batch.column(1).to_pylist()
            for first, flat, bounds in encode_column(batch.column(2), path):
                n = len(bounds) - 1
                with_end = np.insert(flat.astype(kind), bounds[1:], end_id)
                where = bounds + np.arange(n + 1)
                sizes = np.diff(where)
                local = np.empty(n, dtype=np.int64)
                for i in range(n):
                    s = sources[first + i]
                    local[i] = used.get(s, 0)
                    used[s] = int(local[i] + sizes[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.full(n, part, dtype=np.int32)), pa.array(local), pa.array(sizes, pa.int64()), binary_array(with_end, where)], names=["doc_id", "source", "part", "local", "n", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(encode, ENCODED)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 2048, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: weight of each source (0 if not named: its tokens follow all others').
    """
    path = tokenizer_path(vocabulary)
    work = Work(spark, "packing")
    encoded = work.table(encode_documents(docs, path, end_id), "encoded")
    # Where each partition's share of a queue begins: a running sum over partitions, per source.
    shares = work.table(encoded.groupBy("source", "part").agg(F.sum("n").alias("n")), "shares")
    bases = shares.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    queues = shares.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()  # one row a source
    weights = None if targets is None else [float(targets.get(r.source, 0)) for r in queues]
    number = {r.source: k for k, r in enumerate(queues)}
    plan = spark.sparkContext.broadcast((Schedule([r.n for r in queues], capacity, weights), number))
    wide = encoder(path).n_ids > 1 << 16

    @tidy
    def cut(batches):
        schedule, number = plan.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids, sources, starts, lengths, blobs = (batch.column(k) for k in range(5))
            for doc_id, source, at, n, blob in zip(ids.to_pylist(), sources.to_pylist(), starts.to_pylist(), lengths.to_pylist(), blobs, strict=True):
                raw = memoryview(np.frombuffer(blob.as_buffer(), "<u4" if wide else "<u2").astype("<u4")).cast("B")
                done = 0
                for run, place in schedule.runs(number[source], at, n):
                    for length, sequence, offset in schedule.sequences(place, run):
                        for column, value in zip(out, (doc_id, done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), n, sequence, offset), strict=True):
                            column.append(value)
                        done += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = encoded.alias("e").join(bases.alias("b"), F.expr("e.part = b.part and e.source <=> b.source")).select("e.doc_id", "e.source", (F.col("b.base") + F.col("e.local")).alias("at"), "e.n", "e.ids")
    return placed.mapInArrow(cut, PIECES)
