"""Periodic runs of words, by the runs theorem.

Every run (maximal stretch that repeats a period at least twice) holds a
Lyndon root that is the longest Lyndon word at its place, under the order of words or
under the opposite order.  So for both orders:

1. suffix arrays by prefix doubling, many texts at once; only suffixes that still tie are sorted again;
2. the longest Lyndon word at place i ends at the next smaller value of the inverse suffix array;
3. each such root is extended to both sides: LCP array and sparse-table range minimum of the text
   give the matching words to the right, those of the reversed text the words to the left;
4. roots whose extension reaches two periods are runs; equal ones are merged.

All steps are numpy over the texts of a slice, a text being the unit: it never leaves its task.  Texts in
which no stretch of six words occurs twice are left out before step 1: a run of at least
max(12, 2 * period) words has period-apart equal stretches of at least six, so such texts have none.

Edge cases: null and empty texts, and texts of fewer than twelve words, have no runs (n_runs 0, nulls, the
hash of the empty string; collapsed is the words joined by a space).  A null doc_id is handled like any
other text.  Repeated rows each give a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, ragged, tidy
from .textvec import Slice, folding, mix, not_space, slices

#: A run has at least max(LEAST, 2 * period) words.
LEAST = 12
_FOLD, _KEEP = folding(lower=False), not_space()

RUNS = "doc_id long, start long, length long, period long"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Suffix array, its inverse and LCP of many sequences laid one after another.

    ``values``: numbers of the words; every sequence ends with a place of its own (its end mark) that counts as smaller than any word.
    owner: sequence of each place, in ascending order.  Suffixes rank by sequence first, so each sequence has its own stretch of the array.
    """

    def __init__(self, values: np.ndarray, owner: np.ndarray):
        n = self.n = len(values)
        key = owner.astype(np.int64) * (int(values.max(initial=0)) + 1) + values
        places, rank = np.arange(n), np.zeros(n, dtype=np.int64)
        self.levels = []  # level k: classes by the first 2**k words
        k, base = 0, np.zeros(n, dtype=np.int64)
        while len(places):
            order = np.argsort(key, kind="stable")
            places, key, base = places[order], key[order], base[order]
            new = np.ones(len(places), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.ones(len(places), dtype=bool)  # where an old class begins
            group[1:] = base[1:] != base[:-1]
            at = np.arange(len(places))
            rank[places] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            self.levels.append(rank.astype(np.int32))
            tied = ~new
            tied[:-1] |= ~new[1:]
            places = places[tied]
            base = rank[places]
            after = places + (1 << k)
            key = base * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            k += 1
        self.inverse = rank
        self.array = np.empty(n, dtype=np.int64)
        self.array[rank] = np.arange(n)
        self._lcp(owner)

    def _lcp(self, owner: np.ndarray) -> None:
        """lcp[r]: equal words of the suffixes of ranks r - 1 and r (0 between sequences), from the classes of all levels."""
        i, j = self.array[:-1].copy(), self.array[1:].copy()
        same = np.flatnonzero((owner[i] == owner[j]) & (self.levels[0][i] == self.levels[0][j]))
        i, j = i[same], j[same]
        length = np.zeros(len(same), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            equal = (i < self.n) & (j < self.n)
            equal &= level[np.minimum(i, self.n - 1)] == level[np.minimum(j, self.n - 1)]
            step = equal.astype(np.int64) << k
            i, j, length = i + step, j + step, length + step
        lcp = np.zeros(self.n, dtype=np.int32)
        lcp[same + 1] = length
        self.levels = []
        self.table = sparse_table(lcp)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words of the suffixes at places i and j (of one sequence, never the same place): a range minimum of the LCP array."""
        a, b = self.inverse[i], self.inverse[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k) + 1]).astype(np.int64)


def sparse_table(values: np.ndarray) -> np.ndarray:
    """table[k, i]: minimum of values[i : i + 2**k] (cut off at the end)."""
    n = len(values)
    table = [values]
    while 1 << len(table) <= n:
        half, last = 1 << (len(table) - 1), table[-1]
        row = last.copy()
        row[: n - half] = np.minimum(last[: n - half], last[half:])
        table.append(row)
    return np.stack(table)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value (the length if there is none), by descending a sparse table."""
    n = len(values)
    table = sparse_table(values)
    at = np.arange(n) + 1
    for k in range(len(table) - 1, -1, -1):
        row = table[k]
        inside = at < n
        ahead = np.minimum(at, n - 1)
        at = np.where(inside & (row[ahead] > values), np.minimum(at + (1 << k), n), at)
    return at


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sequence, start, length, period) of all runs of the sequences words[bounds[i] : bounds[i + 1]], by sequence, start and period."""
    size = np.diff(bounds)
    n = len(size)
    owner = np.repeat(np.arange(n), size + 1)
    begin = bounds[:-1] + np.arange(n)  # with an end mark behind each sequence
    end = begin + size
    inside = np.ones(len(owner), dtype=bool)
    inside[end] = False
    values = np.zeros(len(owner), dtype=np.int64)
    values[inside] = words + 1
    if not len(words):
        return (np.zeros(0, dtype=np.int64),) * 4
    mirror = begin[owner] + end[owner] - 1 - np.arange(len(owner))  # place in the reversed sequence
    mirror[end] = end
    back = np.empty_like(values)
    back[mirror] = values
    opposite = np.where(inside, int(values.max()) + 1 - values, 0)
    forward, backward = Suffixes(values, owner), Suffixes(back, owner)
    found = []
    for inverse in (forward.inverse, Suffixes(opposite, owner).inverse):
        i = np.flatnonzero(inside)
        j = next_smaller(inverse)[i]  # the end mark at the latest
        period = j - i
        right = forward.common(i, j)
        left = np.zeros(len(i), dtype=np.int64)
        inner = np.flatnonzero(i > begin[owner[i]])
        left[inner] = backward.common(mirror[i[inner] - 1], mirror[j[inner] - 1])
        length = period + left + right
        good = length >= np.maximum(LEAST, 2 * period)
        found.append(np.stack([owner[i], i - left - begin[owner[i]], length, period])[:, good])
    rows = np.concatenate(found, axis=1)
    order = np.lexsort((rows[2], rows[3], rows[1], rows[0]))
    rows = rows[:, order]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    return tuple(rows[:, new])


def word_numbers(s: Slice, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly where the bytes are."""
    hashes = s.hashes(begins, ends, _FOLD)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new][number]
    size = ends - begins
    apart = size != size[one]
    like = np.flatnonzero(~apart & (begins != begins[one]))
    apart[like[~s.same(s.chunks(_FOLD), begins[like], begins[one[like]], size[like])]] = True
    if apart.any():  # words of equal hash: numbered by their bytes
        raw, extra = s.data.tobytes(), {}
        for k in np.flatnonzero(apart).tolist():
            number[k] = int(new.sum()) + extra.setdefault(raw[begins[k] : ends[k]], len(extra))
    return number


def may_hold_runs(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sequences in which some stretch of LEAST / 2 words occurs twice: all that hold a run, by hashes that are equal where the stretches are."""
    width = LEAST // 2
    n = len(numbers)
    out = np.zeros(len(bounds) - 1, dtype=bool)
    if n < width:
        return out
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + numbers[k : n - width + 1 + k].astype(np.uint64))
    inside = owner[: len(key)] == owner[width - 1 :]
    key, owner = key[inside] ^ mix(owner[: len(inside)][inside].astype(np.uint64) + np.uint64(1)), owner[: len(inside)][inside]
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    out[owner[1:][key[1:] == key[:-1]]] = True
    return out


def repeated_from(n_words: np.ndarray, bounds: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Which original word stands at each place: in documents with crc % 10 = 0 (crc < 0: none) the words from a = g % n on repeat with period p."""
    at = np.arange(bounds[-1])
    for d in np.flatnonzero((crc >= 0) & (crc % 10 == 0) & (n_words > 0)).tolist():
        n, g = int(n_words[d]), int(crc[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[bounds[d] + a : bounds[d + 1]] = bounds[d] + a + np.arange(n - a) % p
    return at


def found_runs(s: Slice, crc: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(begins, ends, bounds) of the words of all texts, then (text, start, length, period) of their runs.  crc: see ``repeated_from``."""
    begins, ends, bounds = s.words(_KEEP)
    if crc is not None:
        at = repeated_from(np.diff(bounds), bounds, crc)
        begins, ends = begins[at], ends[at]
    numbers = word_numbers(s, begins, ends)
    some = np.flatnonzero(may_hold_runs(numbers, bounds))
    size = np.diff(bounds)[some]
    owner, start, length, period = runs_of(numbers[ragged(bounds[:-1][some], size)], np.concatenate([[0], np.cumsum(size)]))
    return begins, ends, bounds, some[owner], start, length, period


def kept_words(bounds: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words outside all runs but for the first period of each."""
    edge = np.zeros(bounds[-1] + 1, dtype=np.int64)
    np.add.at(edge, bounds[owner] + start + period, 1)
    np.add.at(edge, bounds[owner] + start + length, -1)
    return np.cumsum(edge)[:-1] == 0


def _joined(s: Slice, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the words, each with a space behind it; where each begins, and the end)."""
    size = ends - begins + 1
    stops = np.cumsum(size)
    out = np.full(int(stops[-1]) if len(stops) else 0, 0x20, dtype=np.uint8)
    inner = np.ones(len(out), dtype=bool)
    inner[stops - 1] = False
    out[inner] = s.data[ragged(begins, ends - begins)]
    return out.tobytes(), np.concatenate([[0], stops])


def document_runs(docs: DataFrame) -> DataFrame:
    """Every run of every text: doc_id, start (word from 0), length and period in words."""

    @tidy
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                _, _, _, owner, *columns = found_runs(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + s.first)), *map(pa.array, columns)], names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with every run cut down to its first period: the kept words joined by single spaces.  Null texts stay null; all columns stay."""
    kind = docs.schema["text"].dataType.simpleString()
    names = [f"c{k}" for k in range(len(docs.columns))]  # by place: docs may have any names
    place = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            column, texts = batch.column(place), []
            for s in slices(column):
                begins, ends, bounds, owner, *spans = found_runs(s)
                keep = kept_words(bounds, owner, *spans)
                raw, at = _joined(s, begins[keep], ends[keep])
                of = at[np.concatenate([[0], np.cumsum(keep)])[bounds]].tolist()
                texts += [raw[i : max(i, j - 1)].decode() for i, j in zip(of[:-1], of[1:], strict=True)]
            new = pa.array([t if there else None for t, there in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == place else batch.column(k) for k in range(len(names))], names=names)

    assert kind == "string", "text must be a string column"
    named = docs.toDF(*names)
    return named.mapInArrow(run, named.schema).toDF(*docs.columns)


def periodic_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A digest of each document's runs, once its words repeat as its identifier says (see ``repeated_from``).

    n_runs; start, length, period and exponent_milli (1000 * length / period, rounded down) of the longest run (ties: smallest start, then period); runs_sha256 over lines
    ``start,length,period`` of all runs by start and period; collapsed_sha256 over the words that are kept (see ``kept_words``), joined by single spaces.
    """

    @tidy
    def run(batches):
        for batch in batches:
            crcs = batch.column(1).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(2)):
                n = s.n_texts
                begins, ends, bounds, owner, start, length, period = found_runs(s, crcs[s.first : s.first + n])
                keep = kept_words(bounds, owner, start, length, period)
                raw, at = _joined(s, begins[keep], ends[keep])
                of = at[np.concatenate([[0], np.cumsum(keep)])[bounds]].tolist()
                view = memoryview(raw)
                collapsed = [hashlib.sha256(view[i : max(i, j - 1)]).hexdigest() for i, j in zip(of[:-1], of[1:], strict=True)]
                lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
                first = np.searchsorted(owner, np.arange(n + 1))
                listed = first.tolist()
                sha = [hashlib.sha256("".join(lines[i:j]).encode()).hexdigest() for i, j in zip(listed[:-1], listed[1:], strict=True)]
                best = np.lexsort((period, start, -length, owner))
                has = np.diff(first) > 0
                top = best[np.minimum(first[:-1], max(len(best) - 1, 0))] if len(best) else np.zeros(n, dtype=np.int64)
                shown = [pa.array(x[top] if len(best) else top, mask=~has) for x in (start, length, period, 1000 * length // np.maximum(period, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, n), pa.array(np.diff(first)), *shown, pa.array(sha), pa.array(collapsed)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", F.coalesce(crc32_of_id(F.col("doc_id")), F.lit(-1)).alias("crc"), "text").mapInArrow(run, DIGEST)
