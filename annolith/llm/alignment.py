"""Cross-tokenizer alignment: minimal groups of overlapping tokens, and how often two ids are linked across the corpus.

A text is tokenised by a byte-level vocabulary (A, over space + text) and by a
sentencepiece vocabulary (B, which puts that space before the text itself).
Tokens are the nodes of a bipartite graph, with an edge wherever the byte
ranges of an A token and a B token overlap.  Union-find over the edges gives
its connected components: exactly the minimal groups, cut wherever tokens of
both end.  The members of a component are expanded into links, and the
documents that hold a link are counted for each pair of ids by a distributed grouping.

How the work is spread:

* Texts are cut before a single space between two visible characters, where
  tokens of both vocabularies end whatever stands elsewhere (checked against B's pieces; without that property texts stay whole), so a component
  never crosses a cut.  The distinct segments of a block of texts are encoded and
  aligned once, equal segments being told by their bytes.
* A block (consecutive rows of a task, about BLOCK_BYTES of text, or one longer text) writes its dictionary
  of pairs with the number of its documents that hold each, and for each document
  places in that dictionary.  Pairs are counted over the dictionaries, never over
  documents one by one; the counts go back to the blocks by a second grouping,
  bounded by a block's dictionary.  No group grows with the corpus.

Edge cases: texts that are null, empty, or whose joined tokens of A or B differ from space + text (a text with
U+2581, which B reads as a space) have no tokens: zeros and an empty hash.  Strings of special tokens inside texts are plain text.
A repeated row is a document of its own, in the counts too.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, list_array, ragged, tidy
from .textvec import Slice, folding, slices
from .tokens import _VISIBLE, S, UnitEncoder, _cuts, tokenizer_path

BLOCK_BYTES = 2 << 20
#: Links of a component are listed one by one up to this many; beyond, by distinct ids with their numbers of occurrences.
LISTED = 256
#: Units that the sentencepiece model gets in one string.
AT_ONCE = 500
SPACE_SIGN = "▁"
_FOLD = folding(lower=False)

TOKENS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place array<int>, times array<int>, pair array<long>, n_docs array<int>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>"


class _TokenBytes:
    """Bytes of each id: flat[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[ids], self.sizes[ids])]


class ByteEncoder(UnitEncoder):
    """A byte-level vocabulary for which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.model, special, self.specials = self.tokenizer.model, set(self.specials), []
        self.separable = self.whole_bytes
        of_char = {chr(c): b for b, c in enumerate(self.byte_text.tolist())}
        tokens = [b""] * self.n_ids
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = token.encode() if token in special else bytes(of_char[c] for c in token)
        self.bytes_of = _TokenBytes(tokens)


class PieceEncoder(UnitEncoder):
    """A sentencepiece vocabulary, with the same memory of pieces of text.  Texts begin with the space that the model puts before them."""

    def __init__(self, path: str, most_units: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether no piece goes on over a space, so that tokens end before every space after another character.
        self.separable = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        self.space = self.model.piece_to_id(SPACE_SIGN)
        self.specials, self.fold, self.most = [], _FOLD, most_units
        self.bytes_of = _TokenBytes([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)])
        self._forget()

    def cuts(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        return _cuts_at_spaces(s, self.separable)

    def _alone(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space]

    def _new_ids(self, s: Slice, begins: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> list[list[int]]:
        raw = s.data.tobytes()
        out: list[list[int]] = [[]] * len(begins)
        plain = self.separable & (ends - begins > 1) & _VISIBLE[classes[np.minimum(begins + 1, len(raw) - 1)]] & _VISIBLE[classes[ends - 1]]
        easy = np.flatnonzero(plain).tolist()
        slow = np.flatnonzero(~plain).tolist()
        groups = [easy[k : k + AT_ONCE] for k in range(0, len(easy), AT_ONCE)]
        texts = [b"".join([raw[begins[i] : ends[i]] for i in g]) for g in groups]
        for g, text, ids in zip(groups, texts, self.model.encode([t.decode()[1:] for t in texts], num_threads=1) if texts else [], strict=True):
            found = np.array(ids, dtype=np.int64)
            if self.bytes_of.joined(found).tobytes() != text:  # characters that the model changes: each alone
                slow += g
                continue
            stops = (np.searchsorted(np.cumsum(self.bytes_of.sizes[found]), np.cumsum(ends[g] - begins[g])) + 1).tolist()
            for i, x, y in zip(g, [0, *stops[:-1]], stops, strict=True):
                out[i] = ids[x:y]
        for i in slow:
            out[i] = self._alone(raw[begins[i] : ends[i]].decode())
        return out


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges u[i] - v[i] of n nodes, all edges at once: the smallest node of each node's component.

    Each round hooks the roots of open edges to their smallest neighbouring root and compresses all paths.
    """
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v = u[apart], v[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap; the tokens of both tile the same bytes, so they are at most their numbers added."""
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    low = np.searchsorted(b_end, a_start, side="right")
    high = np.searchsorted(b_start, a_end, side="left")
    n = high - low
    return np.repeat(np.arange(len(a_end)), n), ragged(low, n)


def _cuts_at_spaces(s: Slice, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts of segments, class of each byte): every text, and if ``split`` every single space between two visible characters, starts one."""
    _, c = _cuts(s)
    starts = np.zeros(len(s.data) + 1, dtype=bool)
    if split:
        at = np.flatnonzero(c[1:-1] == S) + 1
        starts[at[_VISIBLE[c[at - 1]] & _VISIBLE[c[at + 1]]]] = True
    starts[s.offsets] = True
    return np.flatnonzero(starts[: len(s.data)]), c


def _distinct(s: Slice, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a representative of each unit, unit of each segment): segments of a unit have equal bytes."""
    sizes = ends - begins
    hashes = s.hashes(begins, ends, _FOLD)
    order = np.argsort(hashes, kind="stable")
    first = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    unit = np.empty(len(order), dtype=np.int64)
    unit[order] = np.cumsum(first) - 1
    reps = order[first]
    one = reps[unit]
    apart = sizes != sizes[one]
    like = np.flatnonzero(~apart & (begins != begins[one]))
    apart[like[~s.same(s.chunks(_FOLD), begins[like], begins[one[like]], sizes[like])]] = True
    apart = np.flatnonzero(apart)  # of equal hash but other bytes: units of their own
    unit[apart] = len(reps) + np.arange(len(apart))
    return np.concatenate([reps, apart]), unit


def _given_back(s: Slice, ids: np.ndarray, bounds: np.ndarray, tokens: _TokenBytes) -> np.ndarray:
    """Whether the joined tokens of each text are its bytes."""
    size = np.diff(s.offsets)
    total = np.concatenate([[0], np.cumsum(tokens.sizes[ids])])
    good = total[bounds[1:]] - total[bounds[:-1]] == size
    n = np.where(good, np.diff(bounds), 0)
    unlike = tokens.joined(ids[ragged(bounds[:-1], n)]) != s.data[ragged(s.offsets[:-1], np.where(good, size, 0))]
    if unlike.any():
        good[np.repeat(np.arange(s.n_texts), np.where(good, size, 0))[unlike]] = False
    return good


class Aligned:
    """The distinct segments (units) of a block, tokenised by both vocabularies and aligned.

    ids, bounds by side ("a", "b"): tokens of unit u are ids[side][bounds[side][u] : bounds[side][u + 1]], ends[side] their last bytes within the unit's text.
    group: component of each token, counted over all units in the order of the bytes.
    good[u]: whether both tokenisations give back the unit's bytes; other units hold no tokens.
    """

    def __init__(self, s: Slice, a: ByteEncoder, b: PieceEncoder):
        self.n, self.sizes = s.n_texts, np.diff(s.offsets)
        found = {side: own.encode(s) for side, own in (("a", a), ("b", b))}
        self.good = _given_back(s, *found["a"], a.bytes_of) & _given_back(s, *found["b"], b.bytes_of)
        held = np.where(self.good, self.sizes, 0)
        self.ids, self.bounds, self.ends = {}, {}, {}
        for side, own in (("a", a), ("b", b)):
            ids, bounds = found[side]
            n = np.where(self.good, np.diff(bounds), 0)
            self.ids[side] = ids[ragged(bounds[:-1], n)].astype(np.int64)
            self.bounds[side] = np.concatenate([[0], np.cumsum(n)])
            self.ends[side] = np.cumsum(own.bytes_of.sizes[self.ids[side]])
        n_a, n_b = len(self.ids["a"]), len(self.ids["b"])
        u, v = overlaps(self.ends["a"], self.ends["b"]) if n_a else (np.zeros(0, dtype=np.int64),) * 2
        root = components(n_a + n_b, u, n_a + v)
        heads, group = np.unique(root, return_inverse=True)  # a component's smallest node is its first A token
        self.n_groups = len(heads)
        self.group = {"a": group[:n_a], "b": group[n_a:]}
        self.counts = {side: np.bincount(self.group[side], minlength=self.n_groups) for side in "ab"}
        self.unit_of_group = np.searchsorted(self.bounds["a"], heads, side="right") - 1
        self.group_bounds = np.searchsorted(self.unit_of_group, np.arange(self.n + 1))
        last = np.cumsum(self.counts["a"]) - 1
        self.group_end = self.ends["a"][last] - (np.cumsum(held) - held)[self.unit_of_group]  # within its unit

    def per_unit(self, of_group: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit_of_group, weights=of_group, minlength=self.n).astype(np.int64)

    def strings(self) -> list[bytes]:
        """``a1,a2|b1;`` for each group of each unit, joined."""
        group = np.concatenate([self.group["a"], self.group["b"]])
        key = group * 2 + np.repeat([0, 1], [len(self.ids["a"]), len(self.ids["b"])])
        order = np.argsort(key, kind="stable")
        ids, key = np.concatenate([self.ids["a"], self.ids["b"]])[order], key[order]
        last = np.ones(len(key), dtype=bool)
        last[:-1] = key[1:] != key[:-1]
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, len(str(max(1, int(ids.max(initial=0)))))))
        stops = np.cumsum(digits + 1)  # of each token, its mark included
        out = np.empty(int(stops[-1]) if len(stops) else 0, dtype=np.uint8)
        out[stops - 1] = np.where(last, np.where(key & 1, ord(";"), ord("|")), ord(","))
        left, at, number = ids, stops - 2, digits
        while len(left):  # the last digit of every number, then the last but one, ...
            out[at] = 48 + left % 10
            more = number > 1
            left, at, number = left[more] // 10, at[more] - 1, number[more] - 1
        raw = out.tobytes()
        bounds = np.concatenate([[0], stops])[self.bounds["a"] + self.bounds["b"]].tolist()
        return [raw[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, times, bounds): the distinct pairs of ids linked in each unit, a << 32 | b, with the number of their links."""
        n_a, n_b = self.counts["a"], self.counts["b"]
        listed = n_a * n_b <= LISTED
        small = listed[self.group["a"]]
        reach = n_b[self.group["a"][small]]
        begin = (np.cumsum(n_b) - n_b)[self.group["a"][small]]
        order_b = np.argsort(self.group["b"], kind="stable")
        pairs = [np.repeat(self.ids["a"][small], reach) << 32 | self.ids["b"][order_b[ragged(begin, reach)]]]
        units = [np.repeat(self.unit_of_group[self.group["a"][small]], reach)]
        times = [np.ones(len(pairs[0]), dtype=np.int64)]
        for g in np.flatnonzero(~listed).tolist():
            a, k = np.unique(self.ids["a"][self.group["a"] == g], return_counts=True)
            b, m = np.unique(self.ids["b"][self.group["b"] == g], return_counts=True)
            pairs.append((a[:, None] << 32 | b).reshape(-1))
            times.append((k[:, None] * m).reshape(-1))
            units.append(np.full(len(pairs[-1]), self.unit_of_group[g]))
        pair, unit, time = np.concatenate(pairs), np.concatenate(units), np.concatenate(times)
        order = np.lexsort((pair, unit))
        pair, unit, time = pair[order], unit[order], time[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])
        at = np.flatnonzero(new)
        return pair[at], np.add.reduceat(time, at) if len(at) else time, np.searchsorted(unit[at], np.arange(self.n + 1))


def align_block(s: Slice, a: ByteEncoder, b: PieceEncoder) -> tuple[Aligned, np.ndarray, np.ndarray]:
    """(aligned units, unit of each segment, document of each segment).  Texts of the slice begin with a space; documents with a segment that cannot be aligned have no segments."""
    lengths = np.diff(s.offsets)
    begins, _ = _cuts_at_spaces(s, a.separable and b.separable)
    ends = np.concatenate([begins[1:], [len(s.data)]])
    reps, unit = _distinct(s, begins, ends)
    size = (ends - begins)[reps]
    units = Aligned(Slice(s.data[ragged(begins[reps], size)], np.concatenate([[0], np.cumsum(size)]), 0), a, b)
    doc = np.searchsorted(s.offsets, begins, side="right") - 1
    bad = np.bincount(doc, weights=~units.good[unit], minlength=s.n_texts) > 0
    bad |= lengths <= 1  # the space alone: a null or empty text
    keep = ~bad[doc]
    return units, unit[keep], doc[keep]


_HELD: dict[tuple[str, str], tuple[ByteEncoder, PieceEncoder]] = {}


def vocabularies(a: str, b: str) -> tuple[ByteEncoder, PieceEncoder]:
    """One pair for each Python worker."""
    if (a, b) not in _HELD:
        _HELD[a, b] = ByteEncoder(a), PieceEncoder(b)
    return _HELD[a, b]


def _spaced(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def _tokens(paths: tuple[str, str]):
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = {"groups_sha256": pa.string(), "place": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "pair": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, kinds.get(x, pa.int64())) for x in names], names=names)

    @tidy
    def run(batches):
        from pyspark import TaskContext

        a, b = vocabularies(*paths)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids = batch.column(0)
            for s in slices(batch.column(1), BLOCK_BYTES):
                units, unit, doc = align_block(s, a, b)
                n = s.n_texts
                total = {k: np.bincount(doc, weights=x[unit], minlength=n).astype(np.int64) for k, x in (("n_a", np.diff(units.bounds["a"])), ("n_b", np.diff(units.bounds["b"])), ("n_groups", np.diff(units.group_bounds)), ("n_links", units.per_unit(units.counts["a"] * units.counts["b"])))}
                pair, times, bounds = units.links()
                used = np.zeros(units.n, dtype=bool)
                used[unit] = True
                held = np.unique(pair[np.repeat(used, np.diff(bounds))])  # the block's dictionary: of documents that are aligned as a whole
                code = np.searchsorted(held, pair)
                reach = np.diff(bounds)[unit]
                at = ragged(bounds[:-1][unit], reach)
                key = np.repeat(doc, reach) * max(len(held), 1) + code[at]
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
                sums = np.add.reduceat(times[at][order], first) if len(key) else first
                owner, place = np.divmod(key[first], max(len(held), 1))
                of_doc = np.searchsorted(owner, np.arange(n + 1))
                strings = units.strings()
                of_segment = np.searchsorted(doc, np.arange(n + 1)).tolist()
                listed = unit.tolist()
                sha = [hashlib.sha256(b"".join([strings[u] for u in listed[i:j]])[:-1]).hexdigest() if j > i else "" for i, j in zip(of_segment[:-1], of_segment[1:], strict=True)]
                yield rows(n, block=pa.array(np.full(n, block)), doc_id=doc_ids.slice(s.first, n), groups_sha256=pa.array(sha, pa.string()), place=list_array(place, of_doc, pa.int32()), times=list_array(sums, of_doc, pa.int32()), **{k: pa.array(x) for k, x in total.items()})
                if len(held):
                    whole = np.array([0, len(held)])
                    yield rows(1, block=pa.array([block]), pair=list_array(held, whole, pa.int64()), n_docs=list_array(np.bincount(place, minlength=len(held)), whole, pa.int32()))
                block += 1

    return run


def _tokenised(spark: SparkSession, docs: DataFrame, work: Work, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(documents with places in their block's dictionary, dictionaries as rows of block, place, pair and n_docs)."""
    table = work.table(_spaced(docs).mapInArrow(_tokens((tokenizer_path(a), tokenizer_path(b))), TOKENS), "tokens")
    texts = table.where("pair is null").drop("pair", "n_docs")
    held = table.where("pair is not null").select("block", F.posexplode(F.arrays_zip("pair", "n_docs"))).select("block", F.col("pos").alias("place"), "col.pair", "col.n_docs")
    return texts, held


def _counted(held: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold each pair, and whether that is the most of its A id (which has at most as many pairs as B has ids)."""
    counts = held.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("n_docs") == most)


def pair_counts(spark: SparkSession, docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(a_id, b_id, n_docs, best) of every pair of ids that any document links."""
    _, held = _tokenised(spark, docs, Work(spark, "alignment"), a, b)
    return _counted(held).select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.expr("int(pair & 4294967295)").alias("b_id"), "n_docs", "best")


def aligned_groups(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """The minimal groups themselves: bytes start to end of space + text, and the ids of both tokenisations there."""
    paths = tokenizer_path(a), tokenizer_path(b)

    @tidy
    def run(batches):
        own = vocabularies(*paths)
        for batch in batches:
            for s in slices(batch.column(1), BLOCK_BYTES // 4):
                units, unit, doc = align_block(s, *own)
                n = np.diff(units.group_bounds)[unit]
                at = ragged(units.group_bounds[:-1][unit], n)  # group of each row
                size = units.sizes[unit]
                before = np.cumsum(size) - size
                head = np.searchsorted(doc, np.arange(s.n_texts))  # first segment of each document
                base = before - np.append(before, 0)[head][doc]
                end = np.repeat(base, n) + units.group_end[at]
                owner = np.repeat(doc, n)
                new = np.ones(len(owner), dtype=bool)
                new[1:] = owner[1:] != owner[:-1]
                start = np.where(new, 0, np.concatenate([[0], end[:-1]]) if len(end) else end)
                group = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0)) if len(owner) else owner
                ids = [list_array(units.ids[x][ragged((np.cumsum(units.counts[x]) - units.counts[x])[at], units.counts[x][at])], np.concatenate([[0], np.cumsum(units.counts[x][at])]), pa.int32()) for x in "ab"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + s.first)), pa.array(group, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), *ids], names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    return _spaced(docs).mapInArrow(run, GROUPS)


def _summed(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one block with the counts of its pairs."""
    n_docs, best = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=bool)
    if len(counts):
        at = counts["place"].to_numpy()
        n_docs[at], best[at] = counts["n_docs"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    place, times = (texts[x].combine_chunks() for x in ("place", "times"))
    owner = np.repeat(np.arange(len(texts)), place.value_lengths().to_numpy())
    at, times = place.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = [np.zeros(len(texts), dtype=np.int64) for _ in range(2)]
    np.add.at(sums[0], owner, np.where(best[at], times, 0) if len(at) else times)
    np.add.at(sums[1], owner, times * n_docs[at] if len(at) else times)
    return pa.table([*(texts[x] for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]), texts["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def cross_tokenizer_alignment(spark: SparkSession, docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """A digest of each document's groups and links: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its A id), count_sum (documents that hold each link's pair, added up), groups_sha256."""
    texts, held = _tokenised(spark, docs, Work(spark, "alignment"), a, b)
    counts = held.select(F.col("block").alias("of_block"), "place", "pair").join(_counted(held), "pair").select("of_block", "place", "n_docs", "best")
    return texts.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_summed, DIGEST)
