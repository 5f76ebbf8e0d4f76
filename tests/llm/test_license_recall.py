"""What the votes of rare words leave out, against every bin and against plain alignments at every word."""

import random

import numpy as np
import pyarrow as pa

from annolith.llm import license_scan as ls
from annolith.llm.textvec import slices


def made(seed, n, templates, most=4):
    rng, texts = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, most)):
            rate = rng.random() * 0.15
            for x in rng.choice(templates)[1].split():
                words += rng.choice([[], [f"x{rng.randint(0, 99)}"], [x, f"y{rng.randint(0, 99)}"]]) if rng.random() < rate else [x]
            words += [f"z{rng.randint(0, 500)}" for _ in range(rng.randint(0, 120))]
        texts.append(" ".join(words))
    return texts, {w: rng.random() * 8 for w in ls.vocabulary()}


def labels(index, texts, exhaustive):
    out = {}
    for s in slices(pa.array(texts)):
        for t, label, _, share, base in index.scan(*ls._scan_words(s), exhaustive):
            if not base:
                out[t + s.first, label] = max(share, out.get((t + s.first, label), 0.0))
    return out


def test_votes_find_what_every_bin_finds():
    texts, idf = made(4, 120, ls.TEMPLATES)
    index = ls.Index(idf)
    got, want = labels(index, texts, False), labels(index, texts, True)
    assert len(want) > 150 and not set(got) - set(want)
    assert len(got) >= 0.98 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def test_short_templates_against_plain_alignments():
    short = [t for t in ls.TEMPLATES if len(t[1].split()) <= 25]
    texts, idf = made(8, 25, short, most=2)
    got = labels(ls.Index(idf), texts, False)
    missed = n = 0
    for k, text in enumerate(texts):
        words = text.split()
        for label, body, keys in short:
            wanted = body.split()
            width = len(wanted) + len(wanted) // 8
            tries = [words[p : p + width] for p in range(len(words)) if words[p] in wanted]
            found = any(f" {' '.join(w)} ".count(f" {key} ") for w in tries for key in keys.split(";")) and any(subsequence(wanted, w) >= ls.MIN_MATCH * len(wanted) and all(f" {key} " in f" {' '.join(w)} " for key in keys.split(";")) for w in tries)
            n += found
            missed += found and (k, label) not in got
    assert n > 20 and missed <= 0.03 * n


def test_idf_does_not_matter_for_what_is_whole():
    for weights in (np.zeros, np.ones):
        names = ls.vocabulary()
        index = ls.Index(dict(zip(names, weights(len(names)).tolist(), strict=True)))
        texts = [t for _, t, _ in ls.TEMPLATES] + [" ".join(t for _, t, _ in ls.TEMPLATES)]
        got = labels(index, texts, False)
        assert all(got[k, label] == 1.0 for k, (label, _, _) in enumerate(ls.TEMPLATES))
        assert {label for k, label in got if k == len(ls.TEMPLATES)} == {label for label, _, _ in ls.TEMPLATES}
