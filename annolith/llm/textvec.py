"""Vectorised text scanning for Arrow string columns.

Python workers receive whole texts in Arrow batches.  Everything here works on
the UTF-8 bytes of many texts at once with numpy: word boundaries, 64-bit word
hashes and shingle hashes cost a few nanoseconds a byte and need no Python
object per word.  Batches are walked in slices of about ``SLICE_BYTES`` of
text, so the working memory is bounded by that (or by one text, if longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
LONG = 256  # byte ranges longer than this are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def folding(*, lower: bool) -> np.ndarray:
    """What each byte counts as: itself, or a-z for A-Z if ``lower``."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    return table


def not_space() -> np.ndarray:
    """Bytes of the words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, dtype=bool)
    keep[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """Bytes of the lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, before lower-casing."""
    keep = np.zeros(256, dtype=bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


class Slice:
    """Some consecutive texts of a batch; null texts are empty.

    data: their bytes, offsets: where each text starts (one more entry ends the last).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n_texts = len(offsets) - 1

    def words(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, bounds): byte ranges of all words; text i has words bounds[i]:bounds[i + 1]."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n_texts + 1, dtype=np.int64)
        inside = keep[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[self.offsets] = True  # a text's words end with it
        begins = np.flatnonzero(edge[:n] & inside)
        ends = np.flatnonzero(edge[1:] & inside) + 1
        return begins, ends, np.searchsorted(begins, self.offsets)

    def chunks(self, fold: np.ndarray) -> np.ndarray:
        """The 8 bytes from each place on as an integer, little-endian (zeros past the end)."""
        n = len(self.data)
        w = np.zeros(n + 8, dtype=np.uint64)
        w[:n] = fold[self.data]
        for k in (1, 2, 4):
            w[:-k] |= w[k:] << np.uint64(8 * k)
        return w

    def hashes(self, begins: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, equal wherever the folded bytes are; different ranges of up to 7 bytes never share one.

        Longer ranges are chained 8 bytes at a time through ``mix``, which is not linear, so no family of texts collides by construction.
        """
        if not len(begins):
            return np.zeros(0, dtype=np.uint64)
        w = self.chunks(fold)
        size = ends - begins
        out = mix(w[begins] & _MASK[np.minimum(size, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
        at = np.flatnonzero((size > 7) & (size <= LONG))
        h = size[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        k = 0
        while len(at):
            left = size[at] - k
            h = mix(h ^ (w[begins[at] + k] & _MASK[np.minimum(left, 8)]))
            done = left <= 8
            if done.any():
                out[at[done]] = h[done]
                at, h = at[~done], h[~done]
            k += 8
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(fold[self.data[begins[i] : ends[i]]].tobytes())
        return out

    def same(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ranges a : a + size and b : b + size hold the same bytes; w: ``chunks``."""
        out = np.ones(len(a), dtype=bool)
        at, k = np.flatnonzero(a != b), 0
        while len(at):
            mask = _MASK[np.minimum(size[at] - k, 8)]
            equal = (w[a[at] + k] & mask) == (w[b[at] + k] & mask)
            out[at[~equal]] = False
            at, k = at[equal & (size[at] > k + 8)], k + 8
        return out


#: Keeps the first n bytes of a little-endian integer.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Walks an Arrow string column in slices of about ``most`` bytes, whole texts each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the ``width``-word shingles of each text; a text of fewer words (but one) has its whole sequence as one."""
    n_words = np.diff(bounds)
    factors = mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    n = len(words)
    full = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        full += words[k : n - width + 1 + k] * factors[k] if len(full) else full
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_bounds[-1], dtype=np.uint64)
    inside = np.ones(len(full), dtype=bool)
    for k in range(1, width):  # shingles that would cross the end of a text
        at = bounds[1:] - k
        at = at[(at >= 0) & (at < len(full))]
        inside[at] = False
    # Positions before a text's start that belong to an earlier text are covered by the loop above.
    long = n_words >= width
    to = np.repeat(long, counts)
    out[to] = full[inside]
    for i in np.flatnonzero((n_words > 0) & ~long):
        w = words[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = (w * factors[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), out_bounds
