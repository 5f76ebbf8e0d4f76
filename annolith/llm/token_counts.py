"""Token counts: each document is encoded once, and its tokens are attributed to sections by their character spans.

With a byte-level vocabulary that leaves the text as it is every id stands for a fixed run of UTF-8 bytes,
so the spans of a document's tokens are running sums of their lengths.  Under any other vocabulary (one that
normalises or drops white space, say) the library's own offsets are the spans.  Sections
(any ordered, disjoint spans that cover the text) are joined to them as
intervals by two binary searches.  A token that crosses a boundary is
allocated by ``rule``:

    "start"     to the section of its first character (the default)
    "majority"  to the section holding most of its bytes, the earlier on a tie
    "none"      to no section; it is counted in ``n_crossing`` alone

Under the first two rules the sections' counts add up to the document's.

Sections here are lines with their line breaks (``by="line"``), or the fields
``first line`` and ``rest`` (``by="field"``).  Edge cases: a null or empty text has one section of no
characters and no tokens; repeated rows are counted each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ragged, tidy
from .textvec import Slice, slices
from .tokens import UnitEncoder, encoder, tokenizer_path

SCHEMA = "doc_id long, section int, n_bytes long, n_tokens long, n_crossing long, doc_tokens long"


def _section_starts(data: np.ndarray, offsets: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each section, number of sections of each text); offsets bound the texts."""
    breaks = np.flatnonzero(data == 0x0A) + 1
    owner = np.searchsorted(offsets, breaks - 1, side="right") - 1
    inner = breaks < offsets[owner + 1]  # a break at the end of a text starts no section
    breaks, owner = breaks[inner], owner[inner]
    if by == "field" and len(owner):
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        breaks, owner = breaks[first], owner[first]
    n = np.bincount(owner, minlength=len(offsets) - 1) + 1
    texts = np.concatenate([offsets[:-1], breaks])
    whose = np.concatenate([np.arange(len(offsets) - 1), owner])
    return texts[np.lexsort((texts, whose))], n


def attribute(data: np.ndarray, offsets: np.ndarray, token_start: np.ndarray, token_end: np.ndarray, by: str, rule: str) -> tuple[np.ndarray, ...]:
    """(sections of each text, bytes, tokens and crossing tokens of each section)."""
    if rule not in ("start", "majority", "none"):
        raise ValueError(f"unknown rule {rule!r}")
    starts, n = _section_starts(data, offsets, by)
    ends = np.concatenate([starts[1:], [len(data)]])
    # An empty section (of an empty text) holds nothing, so searching by first byte from the right is right.
    a = np.searchsorted(starts, token_start, side="right") - 1
    b = np.searchsorted(starts, np.maximum(token_end - 1, token_start), side="right") - 1
    crossing = a != b
    to = a
    if rule == "majority" and crossing.any():
        to = a.copy()
        for i in np.flatnonzero(crossing):
            parts = np.minimum(ends[a[i] : b[i] + 1], token_end[i]) - np.maximum(starts[a[i] : b[i] + 1], token_start[i])
            to[i] = a[i] + int(np.argmax(parts))
    elif rule == "none":
        to = a[~crossing]
    counts = np.bincount(to, minlength=len(starts))
    touched = np.bincount(a[crossing], minlength=len(starts))
    return n, ends - starts, counts, touched


def spans_by_library(s: Slice, own: UnitEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, bounds) of the tokens of each text, by the library's offsets."""
    raw = s.data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
    starts, ends, n = [], [], []
    for at, t, e in zip(s.offsets[:-1], texts, own.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        place = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        of_char = np.concatenate([np.flatnonzero((s.data[at : at + len(t.encode())] & 0xC0) != 0x80), [len(t.encode())]])
        starts.append(at + of_char[place[:, 0]])
        ends.append(at + of_char[place[:, 1]])
        n.append(len(place))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", by: str = "line", rule: str = "start") -> DataFrame:
    """One row for each section: doc_id, section (from 0), n_bytes, n_tokens, n_crossing (tokens that start in it and end in a later one), doc_tokens."""
    path = tokenizer_path(vocabulary)

    @tidy
    def count(batches):
        own = encoder(path)
        lengths = own.byte_lengths()
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                if own.whole_bytes:
                    flat, bounds = own.encode(s)
                    end = np.cumsum(lengths[flat])
                    start = end - lengths[flat]
                else:
                    start, end, bounds = spans_by_library(s, own)
                n, size, tokens, crossing = attribute(s.data, s.offsets, start, end, by, rule)
                rows = np.repeat(np.arange(s.n_texts), n)
                index = ragged(np.zeros(s.n_texts, dtype=np.int64), n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + s.first)), pa.array(index, pa.int32()), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()), pa.array(np.diff(bounds)[rows], pa.int64())], names=["doc_id", "section", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
