"""N-gram Jaccard join with signature trees.

1. Every text is cut into words once; its set of hashed word shingles is written to the work folder, and all later steps read
   that.  Texts of equal sets share one representative (the smallest doc_id).
2. Sets that are similar enough share a shingle among their first
   floor((1 - s) * size) + 1 under any common order (prefix filter).  The order here is frequent
   shingles last; which are frequent is counted over all sets, task by task, and the list is bounded (MOST_FREQUENT).
   A set is routed to the block of each shingle of its prefix that another set has there too.
3. The members of a block form a signature tree: nodes hold the OR of their members' bitmaps (two to four bits a
   shingle, 512 at least) and their size range.  The dual traversal of a tree with itself drops node pairs whose size ranges exclude the
   similarity, whose largest possible overlap is too small, or which are one component already.  Pairs of leaves that
   remain are the candidates; they are compared in full.  The trees of many blocks are traversed at once.
4. Large groups of copies meet in many blocks and would give all their pairs there.  So the trees are asked in three turns,
   and the links found in one contract the components that the next need not look into:
   in the first two turns (each set's first FIRST blocks; then all blocks of CROWD sets or more that hold several components) a tree gives likely
   pairs only, no more than needed to join its members, a pivot (the member nearest to the block's majority) against
   the others first.  The third turn takes every pair that the bounds let through in every block that
   still holds several components; that turn makes the result whole.
   A pair counts in the block of its first common shingle, so its overlap there is at most what either set has from that shingle on.

The result is exact but for collisions of 64-bit shingle hashes and 128-bit digests of equal sets.  Blocks of more than CHUNK sets are
dealt out in chunks, in the third turn in pairs of chunks; frequent shingles are salted where blocks are gathered.  Bound of overlap of two sets: the common
bits of their bitmaps, plus the shingles one of them hides behind shared bits.

Edge cases: null texts and texts without words have empty sets and link with nothing; a text
of fewer words than a shingle is one shingle; rows that share a doc_id count as one document for links; a row whose doc_id is
null links with nothing (component_id null); an empty table gives no rows; other columns are ignored (``keep_one`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.operators.components import components

from .common import Work, binary_array, list_array, ragged, shuffle_partitions, small_batches, tidy
from .textvec import folding, mix, not_space, shingle_hashes, slices

MOST_FREQUENT, LEAST_FREQUENT, FLUSH = 1 << 23, 16, 1 << 21
FAN, CHUNK, CROWD, FIRST, PAIRS_AT_ONCE = 8, 2048, 16, 4, 1 << 16
BITS_A_SHINGLE, LEAST_BITS = 2, 9  # up to twice as many a shingle; logarithm of the narrowest bitmap
#: Rows and bytes of bitmaps of the blocks that are traversed at once (or one block, if larger).
ROWS_AT_ONCE, BYTES_AT_ONCE = 8192, 2 << 20
PIVOTS, LEAST_PIVOTED, DEVIATIONS = 3, 8, 2
MOST_BROADCAST = 1 << 20  # identifiers of dropped documents that are broadcast at most


@dataclass(frozen=True)
class Similarity:
    """Links at 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80

    def prefix(self, n):
        return n * (100 - self.percent) // 100 + 1

    def overlap(self, a, b):
        """Least intersection of two linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def doublings(self) -> int:
        """How many times a bitmap can be as wide again as that of a linked set."""
        return next(k for k in range(8) if self.percent << k >= 100)


_FOLD, _WORD = folding(lower=True), not_space()
IDENTITY = ["doc_id", "n", "d1", "d2"]


def shingle_sets(docs: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), set (its sorted shingles, 8 bytes each)."""

    @tidy
    def make(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                begins, ends, bounds = s.words(_WORD)
                hashes, cut = shingle_hashes(s.hashes(begins, ends, _FOLD), bounds, how.width)
                parts = [np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                flat = np.concatenate(parts)
                n = np.array([len(p) for p in parts])
                bounds = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[0], np.cumsum(x, dtype=np.uint64)]).astype(np.uint64) for x in (flat, mix(flat + np.uint64(0x51ED2701)))]
                d1, d2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(n)), pa.array(n), pa.array(d1), pa.array(d2), binary_array(flat, bounds)], names=[*IDENTITY, "set"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, d1 long, d2 long, set binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds) of a column of sets."""
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if values is None:
        return np.zeros(0, dtype=np.uint64), offsets * 0
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, dtype=np.uint8)
    return data.view(np.uint64) if len(data) else np.zeros(0, dtype=np.uint64), (offsets - offsets[0]) // 8


def frequent_shingles(sets: DataFrame, work: Work) -> np.ndarray:
    """Sorted shingles found often, by counts of all sets: those that some task met twice in FLUSH shingles, with enough of them in all."""

    @tidy
    def count(batches):
        held, size, total = [], 0, 0

        def counted():
            flat = np.concatenate(held)
            flat.sort()
            again = np.flatnonzero(flat[1:] == flat[:-1])  # all but one of each that is met twice
            tokens, n = np.unique(flat[again], return_counts=True)
            n = n + 1
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), dtype=np.int64))], names=["token", "n", "total"])

        for batch in batches:
            flat = _flat(batch.column(0))[0]
            for k in range(0, len(flat), FLUSH):
                part = flat[k : k + FLUSH].copy()
                held.append(part)
                size += len(part)
                total += len(part)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([total])], names=["token", "n", "total"])

    counts = work.table(sets.select("set").mapInArrow(count, "token long, n long, total long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "counts")
    total = counts.agg(F.sum("total")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // MOST_FREQUENT))  # so at most MOST_FREQUENT are left
    out = np.sort(counts.where(F.col("n") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64))
    work.drop("counts")
    return out


def _bits(n: int) -> int:
    return 1 << max(LEAST_BITS, int(BITS_A_SHINGLE * n - 1).bit_length())


def signatures(spark: SparkSession, sets: DataFrame, how: Similarity, frequent: np.ndarray) -> DataFrame:
    """The identity of each set that is not empty, with prefix (first shingles of the common order), rare (how many of them are not frequent) and bits (bitmap)."""
    shared = spark.sparkContext.broadcast(frequent)  # MOST_FREQUENT * 8 bytes at most

    @tidy
    def sign(batches):
        often = shared.value
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(often & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            flat, bounds = _flat(batch.column(4))
            late = np.zeros(len(flat), dtype=bool)
            at = np.flatnonzero(sieve[(flat & np.uint64(0xFFFFF)).astype(np.int64)])
            if len(often) and len(at):
                place = np.minimum(np.searchsorted(often, flat[at]), len(often) - 1)
                late[at] = often[place] == flat[at]
            prefix, n_rare, bits = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own, behind = flat[a:b], late[a:b]
                p = how.prefix(len(own))
                rare = own[~behind][:p]
                prefix += [rare, own[behind][: p - len(rare)]]
                n_rare.append(len(rare))
                m = _bits(len(own))
                map_ = np.zeros(m, dtype=bool)
                map_[(own & np.uint64(m - 1)).astype(np.int64)] = True
                bits.append(np.packbits(map_).tobytes())
            tokens = np.concatenate(prefix) if prefix else np.zeros(0, dtype=np.uint64)
            ends = np.concatenate([[0], np.cumsum(how.prefix(np.diff(bounds)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], list_array(tokens.view(np.int64), ends, pa.int64()), pa.array(n_rare, pa.int32()), pa.array(bits, pa.binary())], names=[*IDENTITY, "prefix", "rare", "bits"])

    full = sets.where("n > 0 and doc_id is not null").select(*IDENTITY, "set")
    return full.mapInArrow(sign, "doc_id long, n long, d1 long, d2 long, prefix array<long>, rare int, bits binary")


@tidy
def _met_twice(batches):
    """Rows (token, rep, n, pos, salted) sorted by token: drops those whose token no other row has.  Salted tokens are known to be frequent and stay."""
    last, stays = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if last is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(last, columns, strict=True)]
        token, salted = columns[0], columns[4]
        same = token[1:] == token[:-1]
        keep = salted | np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep[0] |= stays
        last, stays = [c[-1:] for c in columns], bool(keep[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns[:4]], names=["token", "rep", "n", "pos"])
    if stays:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[:4]], names=["token", "rep", "n", "pos"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def folded(bits: list[bytes], m: int) -> np.ndarray:
    """Bitmaps as rows of m / 64 words; wider ones are folded to m bits by OR (a shingle's bit is its lowest bits)."""
    out = np.empty((len(bits), m // 64), dtype=np.uint64)
    sizes = np.array([len(b) for b in bits])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        w = np.frombuffer(b"".join([bits[i] for i in at]), dtype=np.uint64).reshape(len(at), -1)
        while w.shape[1] > m // 64:
            half = w.shape[1] // 2
            w = w[:, :half] | w[:, half:]
        out[at] = w
    return out


class Trees:
    """The signature trees of many blocks.  Rows come by block, then by n.

    room: how many shingles of a set do not come before the block's own in the common order.
    """

    def __init__(self, block: np.ndarray, n: np.ndarray, room: np.ndarray, maps: np.ndarray, how: Similarity):
        self.how, self.block, self.n, self.maps = how, block, n, maps
        self.low, self.high, self.room, self.bits, self.start = [n], [n], [room], [maps], []
        self.ones = _popcount(maps)
        self.hidden = [n - self.ones]
        owner = block
        while True:
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            if first.all():
                break
            rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            at = np.flatnonzero(rank % FAN == 0)
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.room.append(np.maximum.reduceat(self.room[-1], at))
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at, axis=0))
            self.hidden.append(np.maximum.reduceat(self.hidden[-1], at))
            self.start.append(np.concatenate([at, [len(owner)]]))
            owner = owner[at]
        self.at_once = max(1, PAIRS_AT_ONCE * 16 // maps.shape[1] // (FAN * FAN))

    def regroup(self, group: np.ndarray) -> None:
        """group: which members are one component already."""
        self.first, self.last = [group], [group]
        for start in self.start:
            self.first.append(np.minimum.reduceat(self.first[-1], start[:-1]))
            self.last.append(np.maximum.reduceat(self.last[-1], start[:-1]))

    def _alive(self, level: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        lo, hi, percent = self.low[level], self.high[level], self.how.percent
        # The closest sizes that members of both nodes can have; both ranges are intervals of sizes.
        below, above = np.minimum(hi[u], hi[v]), np.maximum(lo[u], lo[v])
        ok = 100 * below >= percent * above
        first, last = self.first[level], self.last[level]
        ok &= ~((first[u] == last[u]) & (first[v] == last[v]) & (first[u] == first[v]))
        need = self.how.overlap(lo[u], lo[v])
        ok &= np.minimum(self.room[level][u], self.room[level][v]) >= need
        at = np.flatnonzero(ok)
        a, b = u[at], v[at]
        ok[at] = _popcount(self.bits[level][a] & self.bits[level][b]) + np.minimum(self.hidden[level][a], self.hidden[level][b]) >= need[at]
        return ok

    def traverse(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that the bounds let through, some at a time; ``regroup`` may be called in between."""
        roots = np.arange(len(self.low[-1]))
        stack = [(len(self.low) - 1, roots[k : k + self.at_once], roots[k : k + self.at_once]) for k in range(0, len(roots), self.at_once)]
        while stack:
            level, u, v = stack.pop()
            if level == 0:
                if len(u):
                    yield u, v
                continue
            start = self.start[level - 1]
            wide = start[v + 1] - start[v]
            total = (start[u + 1] - start[u]) * wide
            own, k = np.repeat(np.arange(len(u)), total), ragged(np.zeros(len(u), dtype=np.int64), total)
            a, b = start[u[own]] + k // wide[own], start[v[own]] + k % wide[own]
            real = a < b if level == 1 else a <= b
            a, b = a[real], b[real]
            ok = self._alive(level - 1, a, b)
            a, b = a[ok], b[ok]
            step = len(a) or 1 if level == 1 else self.at_once
            stack += [(level - 1, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]

    def likely(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the similarity as estimated from the bitmaps reaches the threshold, give or take DEVIATIONS standard deviations of the estimate."""
        m = 64 * self.maps.shape[1]
        common = _popcount(self.maps[u] & self.maps[v])
        ones = np.minimum(self.ones[u] + self.ones[v] - common, m - 1)
        union = -m * np.log1p(-ones / m)
        t = union / m
        union = np.maximum(union - DEVIATIONS * np.sqrt(m * (np.exp(t) - t - 1)), np.maximum(self.n[u], self.n[v]))
        return 100 * (self.n[u] + self.n[v] - union) >= self.how.percent * union

    def _pivoted(self, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In each larger block the member nearest to the bits that most members have, with the members like it; some rounds, each among those left over."""
        left = np.ones(len(group), dtype=bool)
        for _ in range(PIVOTS):
            rows = np.flatnonzero(left)
            _, starts, sizes = np.unique(self.block[rows], return_index=True, return_counts=True)
            rows = rows[np.repeat(sizes >= LEAST_PIVOTED, sizes)]
            if not len(rows):
                return
            _, starts, sizes = np.unique(self.block[rows], return_index=True, return_counts=True)
            own, most = self.maps[rows], np.empty((len(sizes), self.maps.shape[1]), dtype=np.uint64)
            step = max(1, BYTES_AT_ONCE // (8 * len(rows)))  # words at a time, so that one byte for each bit stays small
            for k in range(0, own.shape[1], step):
                bits = np.unpackbits(np.ascontiguousarray(own[:, k : k + step]).view(np.uint8), axis=1)
                counts = np.add.reduceat(bits, starts, axis=0, dtype=np.uint16)
                most[:, k : k + step] = np.packbits(2 * counts > sizes[:, None], axis=1).view(np.uint64)
            which = np.repeat(np.arange(len(sizes)), sizes)
            near = _popcount(own & most[which]) / np.maximum(1, _popcount(own | most[which]))
            best = np.lexsort((-near, which))[starts]
            pivot = rows[best][which]
            good = (rows != pivot) & self.likely(pivot, rows)
            left[pivot] = left[rows[good]] = False
            good &= group[rows] != group[pivot]
            yield pivot[good], rows[good]

    def all_pairs(self, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.regroup(group)
        for u, v in self.traverse():
            other = group[u] != group[v]
            yield u[other], v[other]

    def joining_pairs(self, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Likely pairs, as many as it takes to join the members of each block."""
        name = np.unique(np.stack([self.block, group], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        root = np.arange(int(name.max()) + 1)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def joined(u, v) -> tuple[np.ndarray, np.ndarray]:
            new = []
            for k, (x, y) in enumerate(zip(name[u].tolist(), name[v].tolist(), strict=True)):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    new.append(k)
            return u[new], v[new]

        def settled() -> np.ndarray:
            flat = root
            while (flat[flat] != flat).any():
                flat = flat[flat]
            return flat[name]

        for u, v in self._pivoted(group):
            yield joined(u, v)
        self.regroup(settled())
        for u, v in self.traverse():
            own = self.first[0]
            open_ = own[u] != own[v]
            u, v = u[open_], v[open_]
            good = self.likely(u, v)
            u, v = joined(u[good], v[good])
            if len(u):
                yield u, v
                self.regroup(settled())


def block_pairs(block: np.ndarray, side: np.ndarray | None, n: np.ndarray, room: np.ndarray, group: np.ndarray, bits: list[bytes], how: Similarity, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (by block, then n) from the trees of their blocks; with ``side``, of rows of different sides.

    Sets of each bitmap width are joined with each other and with all wider ones that a linked set can have, folded.
    """
    widths = np.array([8 * len(b) for b in bits])
    for m in np.unique(widths):
        own = np.flatnonzero((widths >= m) & (widths <= m << how.doublings()))
        first = np.flatnonzero(np.concatenate([[True], block[own][1:] != block[own][:-1]]))
        size = np.diff(np.concatenate([first, [len(own)]]))
        mixed = np.minimum.reduceat(group[own], first) != np.maximum.reduceat(group[own], first)
        mixed &= np.logical_or.reduceat(widths[own] == m, first)
        own = own[np.repeat(mixed, size)]
        if not len(own):
            continue
        trees = Trees(block[own], n[own], room[own], folded([bits[i] for i in own], int(m)), how)
        for u, v in trees.all_pairs(group[own]) if whole else trees.joining_pairs(group[own]):
            a, b = own[u], own[v]
            fits = (widths[a] == m) | (widths[b] == m)
            if side is not None:
                fits &= side[a] != side[b]
            yield a[fits], b[fits]


def _pairs_of_blocks(how: Similarity, whole: bool):
    """Rows (token, i, j, c, rep, n, room, component, bits) sorted by token, i, j and n, to pairs (a, b)."""

    def given(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(k).to_numpy() for k in range(3)], axis=1)
        block = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
        c, rep, n, room, group = (t.column(k).to_numpy() for k in range(3, 8))
        side = np.where(key[:, 1] == key[:, 2], np.arange(len(c)) + CHUNK * CHUNK, c)  # within a chunk every row is a side of its own
        for a, b in block_pairs(block, side, n, room, group, t.column(8).to_pylist(), how, whole):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], names=["a", "b"])

    @tidy
    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            if held:
                old = held[-1]
                if all(old.column(k)[-1].as_py() == key[0, k] for k in range(3)):
                    new = new[1:]
            at = 0
            for x in new:  # a block may begin: what is held is whole blocks
                if rows + x - at and (rows + x - at >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE):
                    yield from given([*held, batch.slice(at, x - at)] if x > at else held)
                    held, rows, size, at = [], 0, 0, x
            held.append(batch.slice(at))
            rows += batch.num_rows - at
            size += held[-1].column(8).nbytes
        if held:
            yield from given(held)

    return run


def verified(spark: SparkSession, sets: DataFrame, pairs: DataFrame, how: Similarity, work: Work, name: str, n_pairs: int) -> DataFrame:
    """The pairs (a, b) that are linked, by full comparison of their sets.

    A bitmap of the wanted identifiers, at most 32 MB and about 16 bits for each, picks the sets that take part (false passes only cost time).
    """
    places = 1 << min(28, max(16, (32 * n_pairs).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(places))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    words = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(bigint(1), cast(p % 32 as int)))").alias("v")).toArrow()  # places / 32 rows at most
    table = np.zeros(places // 32, dtype=np.uint32)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)

    @tidy
    def pick(batches):
        held = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            take = np.flatnonzero(held[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            if len(take):
                yield batch.select([0, 1]).take(pa.array(take))

    ids = sets.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "set").withColumn("p", place)
    own = work.table(ids.mapInArrow(pick, "id long, set binary"), f"{name}-sets", "none")

    @tidy
    def compare(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= how.percent * (len(p) + len(q) - common) and common:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in range(2)], names=["a", "b"])

    one, two = own.toDF("x", "set_x"), own.toDF("y", "set_y")
    joined = pairs.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y")).select("a", "b", "set_x", "set_y")
    out = work.table(joined.mapInArrow(compare, "a long, b long"), f"{name}-links")  # a pair can stand twice where texts share an identifier
    work.drop(f"{name}-sets")
    return out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, report: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.  report: gets the numbers of candidates and links of each turn."""
    with small_batches(spark):  # sets and bitmaps are wide rows; all steps that carry them run in here
        return _joined(spark, docs, width, percent, report)


def _joined(spark: SparkSession, docs: DataFrame, width: int, percent: int, report: dict[str, int] | None) -> DataFrame:
    how = Similarity(width, percent)
    work = Work(spark, "ngrams")
    parts = shuffle_partitions(spark)
    report = {} if report is None else report
    sets = work.table(shingle_sets(docs, how), "sets", "none")
    whose = work.table(sets.select(*IDENTITY), "identities")
    if not whose.groupBy(*IDENTITY).count().where("count > 1").isEmpty():  # rows that share identifier and text take part once
        sets = sets.dropDuplicates(IDENTITY)
    named = whose.where("n > 0 and doc_id is not null")
    reps = work.table(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "representatives")
    signed = signatures(spark, sets, how, frequent_shingles(sets, work))
    mine = F.expr("doc_id = rep and n = rn and d1 = r1 and d2 = r2")
    own = work.table(signed.join(reps.toDF("rn", "r1", "r2", "rep"), mine).select("rep", F.col("n").cast("int").alias("n"), "prefix", "rare", "bits"), "signatures")
    routed = own.select(F.posexplode("prefix").alias("pos", "token"), "rep", "n", "rare").select("token", "rep", "n", "pos", (F.col("pos") >= F.col("rare")).alias("salted"))
    salt = F.when(F.col("salted"), F.pmod(F.xxhash64("rep"), F.lit(parts))).otherwise(0)
    met = routed.repartition(parts, "token", salt).sortWithinPartitions("token").mapInArrow(_met_twice, "token long, rep long, n int, pos int")
    rows = work.table(met, "blocks")
    bitmaps = work.table(own.select(F.col("rep").alias("r"), "bits"), "bitmaps")
    work.drop("signatures")
    found, compared = None, None

    def labelled(found, rows):
        if found is None:
            return rows.withColumn("component", F.col("rep"))
        return rows.join(found, F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("component"))

    def mixed(rows, name, least):
        """Rows of the blocks that hold several components, and the blocks with their sizes."""
        rows = work.table(rows, name)
        blocks = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").where(F.col("m") >= least)
        return rows, blocks.select(F.col("token").alias("t"), F.ceil(F.col("m") / CHUNK).cast("int").alias("k"))

    def turn(name, chosen, whole, least=2):
        """Candidates of the trees of all mixed blocks with ``least`` sets, their full comparison, components of all links so far."""
        nonlocal found, compared
        rows, blocks = mixed(labelled(found, chosen), f"{name}-rows", least)
        chunk = F.when(F.col("k") > 1, F.pmod(F.xxhash64("rep", "token"), F.col("k")).cast("int")).otherwise(0)
        dealt = rows.join(blocks, F.col("token") == F.col("t")).withColumn("c", chunk)
        other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)) if whole else F.col("c")
        dealt = dealt.withColumn("o", other).select("token", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep", "n", "pos", "component")
        # Only a member with another of fitting size next to it can be linked in this block; the others need no bitmap.
        by_size = Window.partitionBy("token", "i", "j").orderBy("n")
        dealt = dealt.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)}).where(f"100 * bigint(less) >= {percent} * n or 100 * bigint(n) >= {percent} * more").drop("less", "more")
        with_bits = dealt.join(bitmaps, F.col("rep") == F.col("r")).select("token", "i", "j", "c", "rep", F.col("n").cast("long").alias("n"), F.expr("bigint(n - pos)").alias("room"), "component", "bits")
        grouped = with_bits.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "rep")
        pairs = grouped.mapInArrow(_pairs_of_blocks(how, whole), "a long, b long").distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = work.table(pairs, f"{name}-candidates")
        work.drop(f"{name}-rows")
        n_pairs = pairs.count()
        report[f"{name} candidates"] = n_pairs
        compared = pairs if compared is None else compared.union(pairs)
        if n_pairs:
            links = verified(spark, sets, pairs, how, work, name, n_pairs)
            report[f"{name} links"] = links.count()
        if report.get(f"{name} links"):
            found = components(links if found is None else found.toDF("a", "b").union(links), work, name)

    early = Window.partitionBy("rep").orderBy("pos")
    turn("first", rows.withColumn("nth", F.row_number().over(early)).where(F.col("nth") <= FIRST).drop("nth"), whole=False)
    turn("second", rows, whole=False, least=CROWD)
    turn("third", rows, whole=True)
    work.drop("sets", "bitmaps", "blocks")
    whose = whose.join(reps.toDF("rn", "r1", "r2", "rep"), F.expr("n = rn and d1 = r1 and d2 = r2 and doc_id is not null"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    if found is None:
        return whose.withColumnRenamed("rep", "component_id")
    return whose.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; all its columns.  Rows without doc_id stay."""
    found = Work(spark, "ngrams-kept").table(ngram_jaccard_join(spark, docs, width, percent), "joined")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    few = gone.count() <= MOST_BROADCAST  # 8 bytes each; beyond that both sides are shuffled
    names = [f"c{k}" for k in range(len(docs.columns))]  # by place: docs may have any names
    doc_id = names[docs.columns.index("doc_id")]
    return docs.toDF(*names).join(F.broadcast(gone) if few else gone, F.col(doc_id) == F.col("gone_id"), "left_anti").toDF(*docs.columns)
