import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from annolith.llm import runs

from .conftest import docs_of


def brute(w):
    """(start, length, period) of all runs, from the definition."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, m, q) for (s, m), q in out.items())


def changed(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return w
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def collapsed(w, found):
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def digest(doc_id, text):
    w = changed(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest())


def sequences():
    rng = random.Random(8)
    out = [[], [0], [0] * 11, [0] * 12, [0] * 100, [0, 1] * 30, list(range(30)), list(range(30)) * 2, list(range(9)) * 2 + [1] * 13]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    out.append(b)  # Fibonacci words are full of runs
    for _ in range(150):
        w = []
        while len(w) < rng.randint(1, 120):
            root = [rng.randint(0, rng.choice([1, 2, 5, 40])) for _ in range(rng.randint(1, 20))]
            w += root * rng.randint(1, 5) + root[: rng.randint(0, len(root))]
        out.append(w)
    return out


@pytest.fixture(scope="module")
def frame_rows(rows):
    rng = random.Random(6)
    texts = [rng.choice([" ", "\n", " \t"]).join(f"w{x}" * (1 + x % 4) for x in w) for w in sequences()]
    texts += ["x" * 5000 + " y" * 40, "é “é” " * 9, "  a " * 8]
    return [(i, t) for i, t, _, _ in rows if len(t or "") < 20000] + [(1000 + k, t) for k, t in enumerate(texts)] + [(3000 + k, t) for k, t in enumerate(texts)]


def test_runs_equal_the_definition():
    """All at once, and each alone."""
    many = sequences()
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in many])])
    owner, *columns = runs.runs_of(np.array([x for w in many for x in w], dtype=np.int64), bounds)
    rows = list(zip(owner.tolist(), *(c.tolist() for c in columns), strict=True))
    for k, w in enumerate(many):
        want = brute(w)
        assert [r[1:] for r in rows if r[0] == k] == want
        alone = runs.runs_of(np.array(w, dtype=np.int64), np.array([0, len(w)]))
        assert list(zip(*(c.tolist() for c in alone[1:]), strict=True)) == want


def test_suffix_array_and_lcp():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        w = [*rng.integers(1, 3, n).tolist(), 0]
        s = runs.Suffixes(np.array(w), np.zeros(n + 1, dtype=np.int64))
        assert s.array.tolist() == sorted(range(n + 1), key=lambda i: w[i:])
        for i, j in rng.integers(0, n + 1, (50, 2)).tolist():
            if i != j:
                k = 0
                while max(i, j) + k <= n and w[i + k] == w[j + k]:
                    k += 1
                assert s.common(np.array([i]), np.array([j]))[0] == k
        values = rng.permutation(n)
        assert runs.next_smaller(values).tolist() == [next((j for j in range(i + 1, n) if values[j] < values[i]), n) for i in range(n)]


def test_digest_equals_brute_force(spark, frame_rows):
    docs = docs_of(spark, [(i, t, None, None) for i, t in frame_rows]).repartition(3)
    got = Counter(map(tuple, runs.periodic_runs(spark, docs).collect()))
    assert got == Counter(digest(i, t) for i, t in frame_rows)
    assert any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in frame_rows)


def test_runs_and_collapsed_texts(spark, frame_rows):
    docs = docs_of(spark, [(k, t, None, None) for k, (_, t) in enumerate(frame_rows)])
    want, texts = [], {}
    for k, (_, t) in enumerate(frame_rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(w)
        want += [(k, *r) for r in found]
        texts[k] = None if t is None else collapsed(w, found)
    assert sorted(map(tuple, runs.document_runs(docs).collect())) == sorted(want)
    out = runs.collapse_runs(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == texts


@pytest.mark.parametrize("bits", [64, 1])
def test_words_of_equal_hash_are_told_apart(bits, monkeypatch):
    plain = runs.Slice.hashes
    monkeypatch.setattr(runs.Slice, "hashes", lambda *x: plain(*x) & np.uint64((1 << bits) - 1))
    import pyarrow as pa

    words = "a b a cc dd cc b a".split()
    s = next(runs.slices(pa.array([" ".join(words)])))
    numbers = runs.word_numbers(s, *s.words(runs._KEEP)[:2]).tolist()
    assert [[x == y for y in numbers] for x in numbers] == [[x == y for y in words] for x in words]


def test_one_very_long_text(spark):
    """Every word a repetition: the longest case of prefix doubling."""
    text = "la " * 60_000 + "end"
    (row,) = runs.document_runs(docs_of(spark, [(1, text, None, None)])).collect()
    assert tuple(row) == (1, 0, 60_000, 1)


def test_no_rows(spark, no_docs):
    assert runs.periodic_runs(spark, no_docs).count() == runs.document_runs(no_docs).count() == runs.collapse_runs(no_docs).count() == 0
