"""Quality rules, classifier, language ID, exact dedup, mixing and license scan against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from annolith.llm import exact_dedup, language_id, license_scan, mixing, quality_classifier, quality_rules

from annolith.llm.textvec import slices

from .conftest import docs_of

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(x):
    return (x is not None, x if x is not None else 0)


def figures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_figures(spark, docs, no_docs, rows):
    extra = [(900, "a b c d e f\n" * 9 + "x", "en", "a"), (901, "q w e r t y u i o p " * 3, "en", "a"), (902, "p q r s t " * 30, "en", "a"), (903, "the cat sat on the mat and the dog ran off to the wood", "en", "a")]
    got = sorted((tuple(r[:6]) for r in quality_rules.quality_rules(spark, docs.unionByName(docs_of(spark, extra))).collect()), key=lambda r: (key(r[0]), r[1:]))
    assert got == sorted(((i, *figures(t)) for i, t, _, _ in [*rows, *extra]), key=lambda r: (key(r[0]), r[1:]))
    assert quality_rules.quality_rules(spark, no_docs).collect() == []


def test_verdict_is_the_same_in_every_order(spark, docs):
    base = quality_rules.base_figures(docs)
    names = list(quality_rules.RULES)
    one, two = (base.withColumn("kept", quality_rules.cascade(order)).select("doc_id", "kept").collect() for order in (names, names[::-1]))
    assert sorted(one, key=str) == sorted(two, key=str)
    failed = {r.doc_id for r in base.where("base_failed").collect()}
    assert all(not r.kept for r in one if r.doc_id in failed)


def test_exact_dedup(spark, docs, no_docs, rows):
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = [(i, max(g, key=key), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    got = exact_dedup.exact_dedup(spark, docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=lambda r: (key(r[0]), r[3])) == sorted(want, key=lambda r: (key(r[0]), r[3]))
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.deduplicate(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "").translate(LOWER) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(spark, no_docs).collect() == []
    clash = docs.withColumnsRenamed({"score": "kept_id", "label": "own_sha", "n": "kept_sha", "token": "c0"})
    again = exact_dedup.deduplicate(spark, clash)
    assert again.columns == clash.columns and again.count() == len(groups)


def test_a_group_that_spans_partitions(spark):
    many = docs_of(spark, [(k, "same text" if k % 3 else f"t{k}", "en", "a") for k in range(400)])
    got = exact_dedup.exact_dedup(spark, many).collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(hot) == 266 and {r.keep_id for r in hot} == {398} and [r.doc_id for r in hot if r.kept] == [398]


def test_language_id(spark, no_docs):
    rng = random.Random(1)
    syllables = {"en": ["the", "ing", "and", "sh"], "fr": ["eau", "que", "ou", "é"], "de": ["sch", "ung", "ü", "ein"]}
    rows = [(k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30)), lang, "a") for k in range(300) for lang in [["en", "fr", "de"][k % 3]]]
    odd = [(1005, "\u00b2 \u00bd \u2167", "en", "a"), (1000, None, "en", "a"), (1001, "123 !!", "en", "a"), (1002, "the and", None, None), (1003, "", "fr", "a"), (1004, "中文", None, "a")]
    docs = docs_of(spark, rows + odd)
    got = {r.doc_id: r for r in language_id.language_id(spark, docs).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang, _ in rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert {k for k in got if got[k].lang_pred == "und"} == {1000, 1001, 1003, 1005} and got[1000].score == 0
    assert language_id.with_known_language(spark, docs).columns == docs.columns
    assert {r.doc_id for r in language_id.with_known_language(spark, docs).collect()} == {k for k, r in got.items() if r.lang_pred != "und" and r.score >= language_id.SURE}
    assert {r.lang for r in language_id.with_known_language(spark, docs, keep=["fr"]).collect()} <= {"fr", None}
    assert language_id.language_id(spark, no_docs).collect() == []
    assert {r.lang_pred for r in language_id.language_id(spark, docs.withColumn("lang", docs.lang.substr(1, 0)).where("false").union(docs_of(spark, odd[:2]))).collect()} == {"und"}


def test_language_id_equals_brute_force(spark):
    """The model of a plain loop over the same hashed n-grams gives the same predictions."""
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abcdeé ü-1") for _ in range(rng.randint(1, 60))), ["x", "y", "z"][k % 3], "a") for k in range(90)]
    buckets = {}
    for k, t, _, _ in rows:
        (s,) = slices(pa.array([t]))
        buckets[k] = [int(b) for found, _ in language_id.features(s) for b in found]
    learned = [(k, lang) for k, _, lang, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    count, texts = defaultdict(Counter), Counter(lang for _, lang in learned)
    for k, lang in learned:
        count[lang].update(buckets[k])
    size = 1 << language_id.BITS
    total = {lang: sum(c.values()) + 0.5 * size for lang, c in count.items()}
    for r in language_id.language_id(spark, docs_of(spark, rows)).collect():
        if r.lang_pred == "und":
            continue
        sums = {lang: sum(math.log((count[lang][b] + 0.5) / total[lang]) for b in buckets[r.doc_id]) + math.log(texts[lang] / len(learned)) for lang in "xyz"}
        scale = 10 / max(10, len(buckets[r.doc_id]))
        assert sums[r.lang_pred] == pytest.approx(max(sums.values()), abs=1e-3)
        assert r.score == pytest.approx(1 / sum(math.exp(scale * (x - sums[r.lang_pred])) for x in sums.values()), abs=1e-4)


def test_any_number_of_languages(spark):
    rows = [(k, f"word{k} text", f"lang{k % 700}", "a") for k in range(1400)]
    got = language_id.language_id(spark, docs_of(spark, rows)).collect()
    assert len(got) == 1400
    assert all(r.lang_pred.startswith("lang") for r in got)
    # A language's weights are the same, however many others there are.
    frame = docs_of(spark, rows).select("lang", "text")
    few, many = language_id.train(frame.where("lang in ('lang5', 'lang77')")), language_id.train(frame)
    assert few.bits == many.bits == language_id.BITS
    for k, lang in enumerate(few.languages):
        assert np.array_equal(few.weights[:, k], many.weights[:, many.languages.index(lang)])


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(4)
    rows = [([rng.randrange(50) for _ in range(rng.randint(1, 9))], rng.randint(0, 1)) for _ in range(60)]
    model, z, n = quality_classifier.Ftrl(50), [0.0] * 51, [0.0] * 51

    def weight(i):
        l1 = 0.0 if i == 50 else quality_classifier.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((quality_classifier.BETA + math.sqrt(n[i])) / quality_classifier.ALPHA + quality_classifier.L2)

    for buckets, label in rows:
        x = {b: c * quality_classifier.SCALE / len(buckets) for b, c in Counter(buckets).items()} | {50: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_classifier.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
        at = np.array(sorted(x))
        model.update(at, np.array([x[i] for i in sorted(x)]), float(label))
    assert model.weights(np.arange(51)).tolist() == pytest.approx([weight(i) for i in range(51)])


def test_quality_classifier(spark, no_docs):
    rng = random.Random(2)
    good, bad = ["calm", "river", "stone", "light", "walk"], ["buy###", "now***", "FREE!!", "click$$$"]
    rows = [(k, " ".join(rng.choice(bad if k % 4 == 0 else good) for _ in range(40)), "en", "a") for k in range(400)] + [(999, None, "en", "a"), (998, "", None, None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(400)] + [(999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(spark, docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == (k % 4 != 0) for k, r in got.items() if k < 400)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert quality_classifier.quality_scores(spark, no_docs, labels).collect() == []
    assert {r.score for r in quality_classifier.quality_scores(spark, docs, labels.where("false")).collect()} == {0.5}


def test_every_language_has_a_constraint_of_its_own(spark):
    rng = random.Random(9)
    langs = [*(f"l{k}" for k in range(99)), "\uffffother"]
    cells = [(s, lang, rng.randint(50, 5000)) for s in "ab" for lang in langs]
    size = Counter()
    for s, _, n in cells:
        size[s] += n
    df = spark.createDataFrame([(s, lang, n, size[s] * (0.4 if s == "a" else 1.6)) for s, lang, n in cells], "source string, lang string, size long, target double")
    got = {(r.source, r.lang): r.rate for r in mixing.balanced_rates(df, mixing.Work(spark, "test")).collect()}
    logit = {k: math.log(r / (2 - r)) for k, r in got.items()}
    shift = logit["a", "l0"] - logit["b", "l0"]
    assert all(logit["a", lang] - logit["b", lang] == pytest.approx(shift, abs=1e-6) for lang in langs)
    share = sum(size[s] * (0.4 if s == "a" else 1.6) for s in "ab") / sum(size.values())
    for lang in langs:  # each keeps its share nearly: the sources' targets leave room for that
        words = sum(n for _, x, n in cells if x == lang)
        assert sum(got[s, x] * n for s, x, n in cells if x == lang) == pytest.approx(share * words, rel=0.05)


def test_languages_keep_their_shares_within_the_sources_targets(spark):
    """The rates of the Newton steps satisfy the conditions of the convex dual."""
    rng = random.Random(6)
    cells = [(s, lang, rng.randint(50, 5000)) for s in "abcde" for lang in ["en", "fr", None] if rng.random() < 0.9]
    size = Counter()
    for s, _, n in cells:
        size[s] += n
    target = {s: n * rng.choice([0.3, 0.9, 1.5, 2.0]) for s, n in size.items()}
    df = spark.createDataFrame([(s, lang, n, float(target[s])) for s, lang, n in cells], "source string, lang string, size long, target double")
    got = {(r.source, r.lang): r.rate for r in mixing.balanced_rates(df, mixing.Work(spark, "test")).collect()}
    assert all(0 <= r <= 2 for r in got.values()) and len(got) == len(cells)
    for s in size:
        assert sum(got[s, lang] * n for x, lang, n in cells if x == s) == pytest.approx(target[s])
    logit = {k: math.log(r / (2 - r)) for k, r in got.items() if 0 < r < 2}
    free = [s for s in size if target[s] < 2 * size[s]]
    difference = {s: {lang: logit[s, lang] - logit[s, "en"] for lang in ["fr", None] if (s, lang) in got} for s in free if (s, "en") in got}
    for lang in ["fr", None]:  # x + y: the difference between two languages is the same in every source
        values = [d[lang] for d in difference.values() if lang in d]
        assert values == pytest.approx([values[0]] * len(values), abs=1e-6)


def _targets(rows, weights=(5, 2, 1)):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    rest, active, target = 1.5 * sum(size.values()), set(names), {}
    while active:
        total = sum(weight[s] for s in active)
        over = {s for s in active if rest * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in active}
            break
        target |= {s: 2.0 * size[s] for s in over}
        rest -= sum(2 * size[s] for s in over)
        active -= over
    return size, target


def test_mixing(spark, docs, no_docs, rows):
    size, target = _targets(rows)
    got = mixing.mixture(spark, docs).collect()
    source = {i: s for i, _, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
    smallest = {s: max((len(WORD.findall(t or "")) for _, t, _, x in rows if x == s), default=0) for s in size}
    assert all(abs(taken[s] - target[s]) <= smallest[s] for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(spark, docs.repartition(3)).collect()))
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 4
    assert mixing.mixture(spark, no_docs).collect() == []


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def changed(text, every):
    """text with a word put in after each ``every`` words, key phrases left whole."""
    words = text.split()
    return " ".join(w + (" inserted" if k % every == every - 1 and k > 8 and words[k - 1] not in {"warranty", "endorse", "promote", "without", "or"} else "") for k, w in enumerate(words))


def test_license_scan(spark, docs, no_docs, rows):
    more = [
        (500, "Released Under the MIT License. Again: under-the\nmit license", "en", "a"),
        (501, "Apache License, Version 2.0 and CC BY-NC", "en", "a"),
        (502, "under the mit licenses", "en", "a"),
        (503, "This work is licensed under the GNU General Public License, version 3.", "en", "a"),
        (504, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documents", "en", "a"),
        (505, "under the mit", "en", "a"),
        (506, "license version 2", "en", "a"),
        (507, "intro words " * 400 + changed(license_scan.TEMPLATES[1][1], 12) + " outro" * 300, "en", "a"),  # one word in twelve is another, one in twelve is put in
        (508, changed(next(t for x, t, _ in license_scan.TEMPLATES if x == "bsd-3"), 40), "en", "a"),
        (509, " ".join(sorted(license_scan.TEMPLATES[1][1].split())), "en", "a"),  # the words in another order
        (510, next(t for x, t, _ in license_scan.TEMPLATES if x == "isc") + " and more", "en", "a"),
    ]
    all_ = rows + more
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(spark, docs.unionByName(docs_of(spark, more))).collect()}
    for i, t, _, _ in all_:
        w = LICENSE_WORD.findall((t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    labels = {i: r.labels for (i, _), r in got.items()}
    assert set(labels[507].split(",")) == {"mit"} and "bsd-3" in labels[508] and labels[509] == "" and labels[510] == "isc"
    assert labels[503] == "gpl-3" and labels[504] == "mit" and labels[502] == labels[505] == labels[506] == ""
    assert license_scan.license_scan(spark, no_docs).collect() == []
