import os
import random
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from annolith.llm import language_id, mixing, ngram_join
from annolith.llm.common import Work
from annolith.llm.ngram_join import Similarity
from annolith.llm.tokens import tokenizer_path
from annolith.sources.work import owned, shared_folder

from .conftest import docs_of, words


def brute(rows, width, percent):
    sets, whole = {}, {}
    for i, t, _, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(x for x in sets if x is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


@pytest.fixture(scope="module")
def near_rows(rows):
    rng = random.Random(9)
    out = list(rows)
    for g in range(8):
        base = words(rng, rng.randint(20, 150), 400).split(" ")
        for k in range(rng.randint(2, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            out.append((1000 + 100 * g + k, " ".join(w), "en", "a"))
    passage = words(rng, 60, 9999)
    return out + [(3000 + k, f"{words(rng, 15, 9999)} {passage} {words(rng, 15, 9999)}", "en", "b") for k in range(40)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, near_rows, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs_of(spark, near_rows), width, percent).collect()}
    assert got == brute(near_rows, width, percent)


def test_chunks_of_large_blocks_lose_no_pair(spark, near_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs_of(spark, near_rows), 4, 85).collect()}
    assert got == brute(near_rows, 4, 85)


def test_no_documents_and_one_of_each_group(spark, no_docs, docs, rows):
    assert ngram_join.ngram_jaccard_join(spark, no_docs).collect() == []
    kept = ngram_join.keep_one(spark, docs)
    want = brute(rows, 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def _family(rng):
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, size=int(rng.integers(5, 90)), dtype=np.int64).astype(np.uint64)
        for _ in range(int(rng.integers(1, 9))):
            cut = base[rng.random(len(base)) > rng.random() * 0.5]
            sets.append(np.unique(np.concatenate([cut, rng.integers(0, 1 << 62, size=int(rng.integers(0, 5)), dtype=np.int64).astype(np.uint64)])))
    sets += [np.arange(128, dtype=np.uint64) << np.uint64(1), np.arange(257, dtype=np.uint64) << np.uint64(1)]  # similarity 0.498, bitmaps of different widths
    return [s for s in sets if len(s)]


def _bitmaps(sets):
    out = []
    for s in sets:
        m = ngram_join._bits(len(s))
        b = np.zeros(m, dtype=bool)
        b[(s & np.uint64(m - 1)).astype(np.int64)] = True
        out.append(np.packbits(b).tobytes())
    return out


@pytest.mark.parametrize("percent", [20, 45, 85])
@pytest.mark.parametrize("blocks", [1, 3])
def test_trees_keep_every_linked_pair(percent, blocks):
    rng = np.random.default_rng(4)
    how = Similarity(4, percent)
    sets = sorted(_family(rng), key=len)
    block = np.sort(rng.integers(0, blocks, len(sets)))
    n, ids, bits = np.array([len(s) for s in sets]), np.arange(len(sets)), _bitmaps(sets)
    by = np.lexsort((n, block))
    n, bits, sets = n[by], [bits[i] for i in by], [sets[i] for i in by]
    found = {(min(p), max(p)) for u, v in ngram_join.block_pairs(block, None, n, n, ids, bits, how, True) for p in zip(u.tolist(), v.tolist(), strict=True)}
    joining = [p for u, v in ngram_join.block_pairs(block, None, n, n, ids, bits, how, False) for p in zip(u.tolist(), v.tolist(), strict=True)]
    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if block[a] == block[b] and 100 * k >= percent * (n[a] + n[b] - k):
                linked += 1
                assert (b, a) in found
    assert linked and 0 < len(joining)
    same = np.zeros(len(sets), dtype=np.int64)
    assert not list(ngram_join.block_pairs(block, None, n, n, same, bits, how, True))


@pytest.mark.parametrize("percent", [30, 50])
def test_low_similarities_equal_brute_force(spark, near_rows, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark, docs_of(spark, near_rows), 3, percent).collect()}
    assert got == brute(near_rows, 3, percent)


def test_most_links_come_from_the_trees_first_turn(spark, near_rows):
    report = {}
    ngram_join.ngram_jaccard_join(spark, docs_of(spark, near_rows), 4, 85, report).collect()
    assert report["first links"] > 0.9 * sum(v for k, v in report.items() if k.endswith("links"))


def test_words_that_collide_under_linear_hashes_are_not_linked(spark):
    twins = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(n)) for n in (1024, 2048) for k in (0, 1)]
    got = ngram_join.ngram_jaccard_join(spark, docs_of(spark, [(k, f"w x y {t}", "en", "a") for k, t in enumerate(twins)]), 4, 85).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_pipeline_equals_brute_force(spark, near_rows, tmp_path):
    """Each stage against plain Python, on what its predecessor kept."""
    size = lambda t: len((t or "").split(None)) if t else 0
    docs = docs_of(spark, near_rows)
    told = {(r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(spark, docs).collect()}  # held against brute force in test_selection
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        before, docs = docs.collect(), spark.createDataFrame(out.collect(), out.schema)
        kept[name] = docs.collect()
        ids = Counter(r.doc_id for r in kept[name])
        if name == "language_id":
            assert set(ids) == {i for i, lang, score in told if lang != "und" and score >= language_id.SURE}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[r.text.encode().lower()] = max(best.get(r.text.encode().lower(), -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted(-1 if i is None else i for i in ids.elements()) == sorted(best.values())
        elif name == "ngram_jaccard_join":
            want = brute([(r.doc_id, r.text, None, None) for r in before], 5, 80)
            assert set(ids) == {i for i, (_, c) in want.items() if i is None or i == c}
        else:
            per = Counter(r.source for r in kept[name])
            assert per and max(ids.values()) <= 2
            copies = {r.doc_id: r for r in mixing.mixture(spark, spark.createDataFrame(before, docs.schema)).collect()}
            assert all(n * size(next(r.text for r in before if r.doc_id == i)) == copies[i].taken for i, n in ids.items() if i is not None and copies[i].size)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in kept["source_mixing"]:
        want[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    folder = str(tmp_path)
    docs_of(spark, near_rows).write.parquet(f"{folder}/documents.parquet")
    root = shared_folder(spark).removeprefix("file://") + "/annolith"
    before = set(os.listdir(root))
    whole = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        whole[r.doc_id] += r.length
    assert whole == want
    assert {x.rpartition("-")[0].partition("-")[0] for x in set(os.listdir(root)) - before} == {"pipeline", "packing"}  # what the result is read from


def test_stages_take_columns_of_any_name(spark, docs, no_docs):
    """Names that stages use inside, and an empty table, from the first stage to the last."""
    clashing = ["gone_id", "own_id", "copies", "copy", "c0", "kept_id", "own_sha", "part", "component_id", "text_sha256", "rate"]
    for own in (docs, no_docs):
        for c in clashing:
            own = own.withColumn(c, F.lit(3))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, own, "")
            assert kept.columns == own.columns
            rows = kept.collect()
            assert all(r[c] == 3 for r in rows for c in clashing)
            own = spark.createDataFrame(rows, own.schema)
        assert (corpus_pipeline.STAGES[-1][1](spark, own, "").count() > 0) == (own.count() > 0)


def test_owned_folders_are_those_of_the_thread(spark):
    other = []
    with owned():
        mine = Work(spark, "mine")
        mine.table(spark.range(3), "t")
        thread = threading.Thread(target=lambda: other.append(Work(spark, "other")))
        thread.start()
        thread.join()
        kept = Work(spark, "kept", keep=True)
        kept.table(spark.range(3), "t")
        other[0].table(spark.range(3), "t")
    exists = [os.path.exists(w.path.removeprefix("file://")) for w in (mine, kept, *other)]
    assert exists == [False, True, True]
    kept.close()
    other[0].close()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
