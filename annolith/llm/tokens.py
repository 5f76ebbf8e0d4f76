"""Whole-text encoding with the tokenizers library, sharing the work of repeated words.

Both vocabularies split a text into pre-tokens before any merge, so the ids of
a text are the ids of its pieces one after another, wherever the text is cut
between two pre-tokens.  ``UnitEncoder`` cuts at places that are such
boundaries under either tokenizer (see ``_cuts``), hashes the pieces of a slice
of texts with numpy, and asks the tokenizer only for pieces not met before.
A hash only finds the remembered piece; the bytes of both are compared, and a piece that
differs from the remembered one of its hash is encoded apart.
The result equals ``Tokenizer.encode`` on the whole text; texts holding the
string of a special token are encoded whole.

Edge cases: null and empty texts have no ids.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .common import ragged
from .textvec import Slice, folding, slices

L, S, P, A, W, D, X = 1, 2, 3, 4, 5, 6, 0  # letter, space, punctuation, apostrophe, other white space, digit, anything else


def _classes() -> np.ndarray:
    table = np.full(256, X, dtype=np.uint8)
    table[0x21:0x7F] = P
    table[0x30:0x3A] = D
    table[0x41:0x5B] = table[0x61:0x7B] = L
    table[0x27], table[0x20] = A, S
    table[0x09:0x0E] = W
    return table


_CLASS = _classes()
_LETTER_LEADS = np.zeros(256, dtype=bool)
_LETTER_LEADS[[0xC3, 0xC4, 0xC5]] = True  # U+00C0 - U+017F


def _pairs() -> np.ndarray:
    """Whether a piece may start between two classes (index: first * 8 + second)."""
    table = np.zeros((8, 8), dtype=bool)
    table[L, [P, D, W]] = True
    table[[P, D], L] = True
    table[P, D] = table[D, P] = True
    return table.reshape(-1)


_PAIRS = _pairs()
_VISIBLE = np.zeros(8, dtype=bool)
_VISIBLE[[L, P, A, D]] = True


def _cuts(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pieces, class of each byte).

    Each start is a pre-token boundary whatever stands elsewhere in the text:
    between a letter and punctuation, a digit or white space; between punctuation or a digit and a
    letter; between digits and punctuation; before a single space between two visible characters;
    between a single other white-space character and a letter.  Apostrophes (contractions) and
    characters outside ASCII and U+00C0 - U+017F never stand beside a cut, but for the space.
    """
    data = s.data
    n = len(data)
    c = _CLASS[data]
    lead = np.flatnonzero(_LETTER_LEADS[data[:-1]])
    if len(lead):
        pair = data[lead].astype(np.int64) << 8 | data[lead + 1]
        lead = lead[~np.isin(pair, [0xC397, 0xC3B7, 0xC4B0])]  # the signs of multiplication and division; I with a dot, whose lower case is two characters
        c[lead] = c[lead + 1] = L
    starts = np.zeros(n + 1, dtype=bool)
    starts[1:n] = _PAIRS[c[:-1] << 3 | c[1:]]
    at = np.flatnonzero(c[1:-1] == S) + 1
    starts[at[_VISIBLE[c[at - 1]] & _VISIBLE[c[at + 1]]]] = True
    at = np.flatnonzero(c[1:-1] == W) + 1
    starts[at[_VISIBLE[c[at - 1]] & (c[at + 1] == L)] + 1] = True
    starts[s.offsets] = True
    return np.flatnonzero(starts[:n]), c


#: Bytes of pieces remembered before the memory is emptied.
MOST_BYTES = 16 << 20


class UnitEncoder:
    """ids of whole texts.  ``most_units``: pieces remembered before the memory is emptied (about 40 bytes each)."""

    def __init__(self, path: str, most_units: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.lowers = spec["normalizer"] is not None
        #: Whether the ids of a text stand for all its bytes, one run after another.
        self.whole_bytes = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.n_ids = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in visible]
        #: How byte-level vocabularies write each byte: visible Latin-1 as itself, the rest from U+0100 on.
        self.byte_text = np.arange(256, dtype="<u2")
        self.byte_text[other] = 256 + np.arange(len(other))
        self.fold, self.most = folding(lower=False), most_units
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(4))
        #: Two levels of (sorted hashes, place in the pool, number of ids, place of the bytes, number of bytes): a large one, and a small one that is merged into it now and then.
        self.levels = [none, none]
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.bytes, self.bytes_used = np.zeros(1 << 18, dtype=np.uint8), 0

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, number of ids, place of the bytes, number of bytes) of each key; place -1: not known."""
        out = np.full(len(keys), -1, dtype=np.int64), *(np.zeros(len(keys), dtype=np.int64) for _ in range(3))
        for known, *columns in self.levels:
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys
                for to, column in zip(out, columns, strict=True):
                    to[hit] = column[at[hit]]
        return out

    def _keep(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids into the pool: (places, counts)."""
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total = int(counts.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        begins = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + total] = [i for f in found for i in f]
        self.used += total
        return begins, counts

    def _remember(self, s: Slice, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """keys ascend and are new."""
        begins, counts = self._keep(found)
        total = int(sizes.sum())
        while self.bytes_used + total > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.bytes_used : self.bytes_used + total] = s.data[ragged(starts, sizes)]
        fresh, level = (keys, begins, counts, self.bytes_used + np.cumsum(sizes) - sizes, sizes), 1
        self.bytes_used += total
        if len(self.levels[1][0]) > 150_000:
            fresh, level = self._merged(self.levels[1], fresh), 0
            self.levels[1] = tuple(x[:0] for x in fresh)
        self.levels[level] = self._merged(self.levels[level], fresh)
        return begins, counts

    def _differs(self, s: Slice, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Indexes of the pieces whose bytes are not those remembered at ``places``."""
        odd = sizes != lengths
        like = np.flatnonzero(~odd)
        n = sizes[like]
        unlike = s.data[ragged(starts[like], n)] != self.bytes[ragged(places[like], n)]
        odd[like[np.repeat(np.arange(len(like)), n)[unlike]]] = True
        return np.flatnonzero(odd)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    def _new_ids(self, s: Slice, begins: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> list[list[int]]:
        """ids of the pieces begins[i] : ends[i].  Words of plain letters are one pre-token each and go to the model at once."""
        bare = classes == L
        data = s.data
        if self.lowers:  # A-Z, and U+00C0 - U+00DE as UTF-8
            data = data.copy()
            data[(data >= 0x41) & (data <= 0x5A)] += 0x20
            after = np.flatnonzero(s.data[:-1] == 0xC3) + 1
            after = after[(s.data[after] >= 0x80) & (s.data[after] <= 0x9E) & (s.data[after] != 0x97)]
            data[after] += 0x20
            bare &= ~_LETTER_LEADS[s.data] | (s.data == 0xC3)
        others = np.concatenate([[0], np.cumsum(~bare)])
        first = begins + (s.data[begins] == 0x20)
        plain = ((others[ends] - others[first]) == 0) & (ends > first)
        text = self.byte_text[data].tobytes().decode("utf-16-le")
        raw = s.data.tobytes()
        tokenize = self.model.tokenize
        start = (first if self.lowers else begins).tolist()  # one vocabulary drops spaces, in the other they belong to the word
        stop = ends.tolist()
        slow = np.flatnonzero(~plain).tolist()
        rest = iter(self.tokenizer.encode_batch([raw[begins[i] : stop[i]].decode() for i in slow], add_special_tokens=False) if slow else [])
        return [[t.id for t in tokenize(text[a:b])] if easy else next(rest).ids for easy, a, b in zip(plain.tolist(), start, stop, strict=True)]

    def cuts(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the pieces, class of each byte)."""
        return _cuts(s)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i of the slice has ids[bounds[i] : bounds[i + 1]]."""
        if not len(s.data):
            return np.zeros(0, dtype=np.uint32), np.zeros(s.n_texts + 1, dtype=np.int64)
        begins, classes = self.cuts(s)
        ends = np.concatenate([begins[1:], [len(s.data)]])
        sizes = ends - begins
        hashes = s.hashes(begins, ends, self.fold)
        order = np.argsort(hashes)
        ranked = hashes[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        keys, at = ranked[first], order[first]
        if len(self.levels[0][0]) + len(self.levels[1][0]) + len(keys) > self.most or self.bytes_used > MOST_BYTES:
            self._forget()
        place, count, held, length = self._look_up(keys)
        known = np.flatnonzero(place >= 0)
        odd = known[self._differs(s, begins[at[known]], sizes[at[known]], held[known], length[known])]
        if len(odd):
            place[odd], count[odd] = self._keep(self._new_ids(s, begins[at[odd]], ends[at[odd]], classes))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new], count[new] = self._remember(s, keys[new], begins[at[new]], sizes[at[new]], self._new_ids(s, begins[at[new]], ends[at[new]], classes))
        unit = np.empty(len(order), dtype=np.int64)
        unit[order] = np.cumsum(first) - 1
        places, counts = place[unit], count[unit]
        # Pieces of one hash in this slice: each is compared with the one that was looked up.
        one = at[unit]
        apart = sizes != sizes[one]
        like = np.flatnonzero(~apart & (begins != begins[one]))
        apart[like[~s.same(s.chunks(self.fold), begins[like], begins[one[like]], sizes[like])]] = True
        apart = np.flatnonzero(apart)
        if len(apart):
            places[apart], counts[apart] = self._keep(self._new_ids(s, begins[apart], ends[apart], classes))
        ids = self.pool[ragged(places, counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        bounds = total[np.searchsorted(begins, s.offsets)]
        return self._with_specials(s, ids, bounds)

    def _with_specials(self, s: Slice, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = s.data.tobytes()
        if not any(x.encode() in raw for x in self.specials):
            return ids, bounds
        texts = [raw[a:b] for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, t in enumerate(texts):
            if any(x.encode() in t for x in self.specials):
                parts[i] = np.asarray(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id of a byte-level vocabulary stands for."""
        out = np.zeros(self.n_ids, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token.encode()) if token in self.specials else len(token)
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def encode_column(column: pa.Array, path: str):
    """Yields (first row, ids, bounds) for each slice of a string column."""
    own = encoder(path)
    for s in slices(column):
        yield s.first, *own.encode(s)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
