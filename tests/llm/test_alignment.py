import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from annolith.llm import alignment as al
from annolith.llm.textvec import Slice, slices
from annolith.llm.tokens import tokenizer_path

from .conftest import docs_of

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
PIECES = ["a", "B", "é", "ß", "'s", "'", "!", "#", " ", "  ", "   ", "\n", "\t", "1", "23", " ", "“", "İ", "中", "é", "\x1c", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "the", " word", " Wort", "\r\n", " ", "٣", "\x00", "🙂", "▁", " x"]


def _library():
    tok, piece = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in visible)}

    def tokens(text):
        a = tok.encode(" " + text, add_special_tokens=False)
        b = piece.encode(text)
        return (
            [(i, bytes(chars[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)],
            [(i, bytes([int(p[3:-1], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, piece.id_to_piece(i)) for i in b)],
        )

    return tokens


def brute(texts):
    """Groups of each text: [(A ids, B ids, end)]; None where it cannot be aligned."""
    tokens, out = _library(), []
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append(None)
            continue
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        groups, common = [], sorted(ends[0] & ends[1])
        place = [iter(zip(np.cumsum([len(x) for _, x in side]).tolist(), (i for i, _ in side), strict=True)) for side in (a, b)]
        held = [next(p, None) for p in place]
        for end in common:
            found = ([], [])
            for k in (0, 1):
                while held[k] and held[k][0] <= end:
                    found[k].append(held[k][1])
                    held[k] = next(place[k], None)
            groups.append((*found, end))
        out.append(groups)
    return out


def digest(texts):
    groups = brute(texts)
    links = [Counter(p for a, b, _ in g or [] for p in ((x, y) for x in a for y in b)) for g in groups]
    n_docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in n_docs.items():
        most[a] = max(most[a], n)
    out = []
    for g, c in zip(groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in g or [])
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((sum(len(a) for a, _, _ in g or []), sum(len(b) for _, b, _ in g or []), len(g or []), sum(c.values()), sum(k for p, k in c.items() if n_docs[p] == most[p[0]]), sum(k * n_docs[p] for p, k in c.items()), sha))
    return out, n_docs, most


def texts_of(rows):
    rng = random.Random(9)
    return [t for _, t, _, _ in rows] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, " " * 500, "é" * 700 + " " + "=-" * 400, "word " * 2000]


@pytest.fixture(scope="module")
def texts(rows):
    return texts_of(rows)


def test_digest_equals_brute_force(spark, texts):
    frame = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in al.cross_tokenizer_alignment(spark, frame).collect()}
    want, n_docs, most = digest(texts)
    assert [got[i] for i in range(len(texts))] == want
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in al.pair_counts(spark, frame).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in n_docs.items()}


def test_groups_equal_brute_force(spark, texts):
    frame = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(3)
    got = defaultdict(list)
    for r in al.aligned_groups(frame).collect():
        got[r.doc_id].append((r.group, r.start, r.end, r.a_ids, r.b_ids))
    for i, groups in enumerate(brute(texts)):
        want, start = [], 0
        for k, (a, b, end) in enumerate(groups or []):
            want.append((k, start, end, a, b))
            start = end
        assert sorted(got[i]) == want


@pytest.mark.parametrize("bits", [64, 2])
@pytest.mark.parametrize("most", [600_000, 50])
def test_ids_from_memory_are_those_of_the_library(texts, bits, most, monkeypatch):
    """Whatever is remembered, forgotten or of equal hash."""
    plain = Slice.hashes
    monkeypatch.setattr(Slice, "hashes", lambda *x: plain(*x) & np.uint64((1 << bits) - 1))
    own, tokens = al.PieceEncoder(B, most), _library()
    few = [t for t in texts if t and len(t) < 5000][:: 1 if bits == 64 else 4]
    for _ in range(2):
        found = []
        for s in slices(pa.array([" " + t for t in few]), 4096):
            ids, bounds = own.encode(s)
            found += [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        assert found == [[i for i, _ in tokens(t)[1]] for t in few]


def test_components():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        for m in (0, n // 2, n):
            u, v = rng.integers(0, n, m), rng.integers(0, n, m)
            label = np.arange(n)
            for _ in range(n):
                for x, y in zip(u, v, strict=True):
                    label[x] = label[y] = min(label[x], label[y])
            assert al.components(n, u, v).tolist() == label.tolist()
    chain = np.arange(10_000)
    assert not al.components(10_001, chain, chain + 1).any()


def test_large_components_are_expanded_by_distinct_ids(texts, monkeypatch):
    a, b = al.ByteEncoder(A), al.PieceEncoder(B)
    s = next(slices(pa.array([" " + (t or "") for t in texts]), 1 << 24))
    plain = al.align_block(s, a, b)[0].links()
    monkeypatch.setattr(al, "LISTED", 1)
    for x, y in zip(plain, al.align_block(s, a, b)[0].links(), strict=True):
        assert np.array_equal(x, y)


def test_edge_cases(spark, docs, rows, no_docs):
    assert al.cross_tokenizer_alignment(spark, no_docs).count() == al.pair_counts(spark, no_docs).count() == al.aligned_groups(no_docs).count() == 0
    got = al.cross_tokenizer_alignment(spark, docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _, _ in rows)  # repeated rows and null identifiers stay
    empty = {i for i, t, _, _ in rows if not t}
    assert {tuple(r)[1:] for r in got if r.doc_id in empty} == {(0, 0, 0, 0, 0, 0, "")}
