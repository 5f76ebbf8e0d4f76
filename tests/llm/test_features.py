"""Hashed n-grams, trained weights and scores, recomputed one by one with Python integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolith.llm import language_id, quality_classifier
from annolith.llm.textvec import slices

from .conftest import docs_of, words

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


def word_hash(raw):
    """Of up to 256 bytes, A-Z as a-z."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    n = len(raw)
    if n <= 7:
        return mix(int.from_bytes(raw, "little") | n << 56)
    h = n * 0x9E3779B97F4A7C15 & MASK
    for k in range(0, n, 8):
        h = mix(h ^ int.from_bytes(raw[k : k + 8], "little"))
    return h


def quality_features(text):
    raw, out, before = text.encode(), [], 17
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9 \x09-\x0d]+", raw):
        h = word_hash(m[0])
        if len(m[0]) > 1 and re.fullmatch(rb"[A-Z]+", m[0]):
            h ^= 0xA5A5A5A5A5A5A5A5
        out += [mix(h) >> 46, mix((h * 5 + before * 0x9E3779B97F4A7C15) & MASK) >> 46]
        before = h
    return out


def language_features(text):
    def fold(b):
        return b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32

    raw, out = [fold(b) for b in text.encode()], []
    for order in (1, 2, 3, 4):
        for p in range(len(raw) - order + 1):
            gram = raw[p : p + order]
            marks = [b == 32 for b in gram]
            if any(marks[1:-1]) or (marks[0] and (order == 1 or marks[1])):
                continue
            total = sum((mix(b + 1000 * k + 7) & 0xFFFFFFFF) * (2 * k + 1) for k, b in enumerate(gram))
            out.append((total * 0x9E3779B97F4A7C15 & MASK) >> 64 - language_id.BITS)
    return out


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(1)
    return [t or "" for _, t, _, _ in rows if len(t or "") < 4000] + ["".join(rng.choice(["a", "B", "XY", "é", "中", " ", "\n", "!", "7", "42", "\x00", "longerword", "EVENLONGERWORD", "x" * 30]) for _ in range(rng.randint(0, 40))) for _ in range(150)]


def test_features_equal_plain_loops(texts):
    for s in slices(pa.array(texts), 2000):
        own = texts[s.first : s.first + s.n_texts]
        buckets, bounds = quality_classifier.features(s)
        assert [buckets[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [quality_features(t) for t in own]
        found = language_id.features(s)
        for k, t in enumerate(own):
            assert Counter(int(b) for buckets, bounds in found for b in buckets[bounds[k] : bounds[k + 1]]) == Counter(language_features(t))


def test_weights_and_scores_equal_plain_loops(spark, texts):
    rng = random.Random(3)
    labelled = [(k, t, rng.randint(0, 1)) for k, t in enumerate(texts[:60])] + [(900, words(rng, 3000), 1), (901, "", 0)]
    df = spark.createDataFrame(labelled, "doc_id long, text string, label int").repartition(3)
    weights = quality_classifier.train(spark, df)
    rank = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    q, bias = quality_classifier, quality_classifier.BUCKETS
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == bias else q.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for _, t, y in sorted(labelled, key=lambda r: rank[r[0]]):
            c = Counter(quality_features(t))
            x = {i: k * q.SCALE / max(1, sum(c.values())) for i, k in c.items()} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    want = np.zeros(bias + 1)
    for i in z:
        want[i] = weight(i)
    assert np.abs(weights - want).max() < 1e-5 and (want != 0).sum() > 100
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(5000, words(rng, 20_000), "en", "a"), (5000, None, None, None)]
    got = Counter((r.doc_id, round(r.score, 5)) for r in q.score(spark, docs_of(spark, rows), weights).collect())
    exact = Counter()
    for i, t, _, _ in rows:
        f = quality_features(t or "")
        exact[i, round(1 / (1 + math.exp(-max(-35, min(35, sum(float(weights[b]) for b in f) * q.SCALE / max(1, len(f)) + float(weights[-1]))))), 5)] += 1
    assert sum((got - exact).values()) <= 2  # rounding at the fifth digit
