import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from annolith.llm import binary_output, packing, token_counts
from annolith.llm.common import Work
from annolith.llm.textvec import Slice, slices
from annolith.llm.tokens import UnitEncoder, tokenizer_path

PIECES = ["a", "B", "é", "ç", "ß", "'s", "'", "!", "#", " ", "  ", "\n", "\t", "1", "23", "\u00a0", "“", "ll", "'ll", "İ", "中", "e\u0301", "\x1c", "×", "œ", "|", "<|endoftext|>", "the", "\r\n", "\u2028", "٣", "Σ", "À", "Ś"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name, rows):
    rng = random.Random(3)
    own = UnitEncoder(tokenizer_path(name), most_units=3000)  # forgets often
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [t for _, t, _, _ in rows]
    found = []
    for s in slices(pa.array(texts), 4096):
        ids, bounds = own.encode(s)
        found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TWINS = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(n)) for n in (1024, 2048) for k in (0, 1)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("bits", [64, 3])
def test_pieces_of_equal_hash_are_told_apart(name, bits, rows, monkeypatch):
    plain = Slice.hashes
    monkeypatch.setattr(Slice, "hashes", lambda *a: plain(*a) & np.uint64((1 << bits) - 1))
    own = UnitEncoder(tokenizer_path(name))
    texts = TWINS + [f"A text with {t} in it." for t in TWINS] + [t or "" for _, t, _, _ in rows if len(t or "") < 5000]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        found = []
        for s in slices(pa.array(texts), 4096):
            ids, bounds = own.encode(s)
            found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert found == want


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def _encode(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def test_binary_output_round_trip(spark, docs, no_docs, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in binary_output.token_id_output(spark, docs).collect())
    at, want = 0, []
    for i, t, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""))):
        ids = [*_encode("byte_bpe_50k.json", t), 2]
        want.append((-1 if i is None else i, at, len(ids), _crc(ids)))
        at += len(ids)
    assert got == sorted(want)
    assert binary_output.token_id_output(spark, no_docs).collect() == []
    manifest, dictionary = binary_output.write_shards(spark, docs, Work(spark, "test"), tokenizer_path("byte_bpe_50k.json"), 2)
    total = 0
    for r in manifest.collect():
        data = binary_output.read_file(r.file)
        assert r.file.endswith(".tok") and len(data) == r.n_bytes
        reader = binary_output.ShardReader(data, dictionary)
        total += sum(len(reader.ids(k)) for k in range(len(reader.counts)))
        with pytest.raises(ValueError, match="another dictionary"):
            binary_output.ShardReader(data, dictionary + b"x")
    assert total == at
    folder = manifest.first().file.rpartition("/")[0]
    assert binary_output.read_file(f"{folder}/dictionary.zstd") == dictionary
    binary_output.write_file(f"{folder}/00000-00000-999999.tok", b"left by a lost attempt")  # in no row of the manifest
    assert binary_output.read_shards(spark, manifest, dictionary).count() == len(rows)


def test_packing_covers_every_id_once(spark, docs, no_docs, rows):
    got = packing.pack(spark, docs, capacity=256).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        of_doc[r.doc_id, r.doc_tokens].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t, _, _ in rows:
        ids = [*_encode("word_bpe_49k.json", t), 1]
        want[i, len(ids)].append(ids)
    assert of_doc.keys() == want.keys()
    for key, copies in want.items():
        pieces = [(r.start, r.length, r.ids_crc32) for r in of_doc[key]]
        assert all(c == _crc(copies[0][s : s + n]) for s, n, c in pieces)  # rows that share id and length are copies
        covered = sorted(x for s, n, _ in pieces for x in range(s, s + n))
        assert covered == sorted(x for ids in copies for x in range(len(ids)))
        assert sum(n for _, n, _ in pieces) == sum(map(len, copies))
    sizes = []
    for k in range(len(of_sequence)):
        at = 0
        for offset, n in sorted(of_sequence[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == 256 or s & (s - 1) == 0 for s in sizes) and max(sizes) <= 256
    assert packing.pack(spark, no_docs).collect() == []


def _placed(plan, totals):
    """(place in the stream, tokens, queue) of all runs; they must fill the stream."""
    out = sorted((place, n, k) for k, t in enumerate(totals) for n, place in plan.runs(k, 0, t))
    at = 0
    for place, n, _ in out:
        assert place == at
        at += n
    assert at == sum(totals)
    return out


def test_windows_hold_the_sources_proportions():
    totals = [700_000, 200_000, 99_999, 1]
    plan = packing.Schedule(totals, 2048)
    (phase,) = plan.phases
    for w in range(1, phase.windows + 1):
        given = [phase.given(k, w) for k in range(4)]
        assert sum(given) == phase.window * w
        assert all(abs(g - t * phase.window * w / phase.all) <= 1 for g, t in zip(given[:3], totals, strict=False))
    runs = _placed(plan, totals)
    assert sum(totals) / len(runs) > 1000
    many = packing.Schedule([5] * 3000, 64)
    _placed(many, [5] * 3000)
    assert packing.Schedule([], 8).phases == []


@pytest.mark.parametrize("seed", range(20))
def test_targets_rule_until_a_queue_runs_dry(seed):
    rng = random.Random(seed)
    totals = [rng.choice([0, 1, 900, 40_000, 90_000]) for _ in range(6)]
    weights = [rng.choice([0, 1, 2, 5]) for _ in totals]
    plan = packing.Schedule(totals, 64, weights, least_run=100)
    runs = _placed(plan, totals)
    if any(w and t for w, t in zip(weights, totals, strict=True)):
        first, held = plan.phases[0], Counter()
        for place, n, k in runs:
            if place + n <= first.window * first.windows:
                held[k] += n
        share = sum(w for w, t in zip(weights, totals, strict=True) if t)
        for k, (w, t) in enumerate(zip(weights, totals, strict=True)):
            if t and first.windows:
                assert abs(held[k] - first.window * first.windows * w / share) <= first.windows + 2 + first.window * 0.05


def test_every_queue_can_end_a_phase():
    totals = [1000 * (k + 1) for k in range(100)]
    plan = packing.Schedule(totals, 64, [1] * 100)
    assert len(plan.phases) == 100
    _placed(plan, totals)


def test_packing_to_targets(spark, docs, rows):
    got = packing.pack(spark, docs, capacity=64, targets={"a": 3, "b": 1}).collect()
    plain = packing.pack(spark, docs, capacity=64).collect()
    assert sum(r.length for r in got) == sum(r.length for r in plain)
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(r.doc_id, r.doc_tokens) for r in plain}


@pytest.mark.parametrize("rule", ["start", "majority", "none"])
def test_token_counts_follow_the_rule(spark, docs, no_docs, rows, rule):
    own = UnitEncoder(tokenizer_path("byte_bpe_50k.json"))
    lengths = own.byte_lengths()
    got = defaultdict(list)
    for r in token_counts.token_counts(spark, docs, rule=rule).collect():
        got[r.doc_id].append((r.section, r.n_bytes, r.n_tokens, r.n_crossing, r.doc_tokens))
    for i, t, _, _ in rows:
        raw = (t or "").encode()
        lines = raw.split(b"\n")
        sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])
        ends = np.cumsum(sizes)
        counts, crossing, at = [0] * len(sizes), [0] * len(sizes), 0
        ids = _encode("byte_bpe_50k.json", t)
        for x in ids:
            a, b = at, at + int(lengths[x])
            first, last = (int(np.searchsorted(ends, p, side="right")) for p in (a, b - 1))
            crossing[first] += first != last
            parts = [min(b, ends[s]) - max(a, ends[s] - sizes[s]) for s in range(first, last + 1)]
            if rule == "start" or first == last:
                counts[first] += 1
            elif rule == "majority":
                counts[first + int(np.argmax(parts))] += 1
            at = b
        want = [(k, s, c, x, len(ids)) for k, (s, c, x) in enumerate(zip(sizes, counts, crossing, strict=True))]
        for w in want:
            assert w in got[i]
    assert token_counts.token_counts(spark, no_docs).collect() == []
    with pytest.raises(ValueError):
        token_counts.attribute(np.zeros(1, np.uint8), np.array([0, 1]), np.array([0]), np.array([1]), "line", "other")


def test_spans_are_the_library_offsets_where_the_vocabulary_normalises(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {(r.doc_id, r.section, r.n_tokens, r.n_crossing, r.doc_tokens) for r in token_counts.token_counts(spark, docs, vocabulary="word_bpe_49k.json").collect()}
    for i, t, _, _ in rows:
        e = library.encode(t or "", add_special_tokens=False)
        ends = [k + 1 for k, c in enumerate(t or "") if c == "\n" and k + 1 < len(t)] + [len(t or "")]
        section = lambda p: next((k for k, x in enumerate(ends) if p < x), len(ends) - 1)
        for k in range(len(ends)):
            inside = [(a, b) for a, b in e.offsets if section(a) == k]
            assert (i, k, len(inside), sum(section(max(b - 1, a)) != k for a, b in inside), len(e.ids)) in got


def test_fields_are_first_line_and_rest(spark, docs):
    rows = token_counts.token_counts(spark, docs.where("doc_id = 32"), by="field").collect()
    assert [r.section for r in rows] == [0, 1] and sum(r.n_tokens for r in rows) == rows[0].doc_tokens
