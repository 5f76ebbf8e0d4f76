import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from annolith.llm import warc
from annolith.llm.common import Work

SCHEMA = "page_id long, url string, html string, keep long, sha string, n int, file string"


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(3)
    texts = ["", "a", "<p>é “x” 中</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "x" * 400_000, "".join(chr(rng.randint(32, 900)) for _ in range(30_000))]
    rows = [(k, f"http://e.org/{k}?a b\r\n<é>", rng.choice(texts)) for k in range(60)]
    rows += [(100, None, None), (101, "", "single"), (None, "u", "a"), (None, "u", "only unnamed"), (None, None, "only unnamed"), (59, "http://e.org/again", rows[59][2]), (58, rows[58][1], rows[58][2]), (7, "http://e.org/other", "another text of page 7")]
    return rows


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame([(*r, 1, "s", 2, "f") for r in page_rows], SCHEMA).repartition(3).cache()


def digest(rows, least=0):
    best, out = {}, []
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    for i, _, t in rows:
        data = (t or "").encode()
        keep = best[t or ""]
        again = len(data) >= least and keep >= 0 and i != keep
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, pages, page_rows, least):
    assert Counter(map(tuple, warc.archived_pages(spark, pages, least).collect())) == digest(page_rows, least)


def test_small_archives_and_payloads(spark, pages, page_rows, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    manifest = warc.write_archives(pages, Work(spark, "test"))
    rows = warc.read_archives(manifest, 4).collect()
    assert manifest.count() > 5 and {r.kind for r in rows} == {"record"}
    assert sum(r.n_records for r in manifest.collect()) == len(page_rows)
    texts = {(t or "").encode() for _, _, t in page_rows}
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == texts
    assert all(r.payload_digest == f"sha1:{warc.base32_sha1(bytes(r.payload))}" for r in rows if r.record_type == "response")
    assert not any(c in r.target_uri for r in rows if r.target_uri for c in " \r\n<")
    assert Counter(r.record_type for r in rows)["warcinfo"] == manifest.count()


def test_no_pages(spark, pages):
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def salvage(data):
    return list(warc.Salvage(Bytes(data)))


def parts(n, packed):
    out = []
    for k in range(n):
        raw = warc.page_record(f"{warc.NAME}{k}", None, bytes([k]) * 50 + b"\r\n" * (k % 3) + hashlib.sha256(bytes([k])).digest() * 9, k - 1 if k % 4 == 3 else None)
        out.append(warc.member(raw) if packed else raw)
    return out


def names(found):
    return [f[3]["warc-record-id"] for f in found if f[0] == "record"]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("chunk", [256 << 10, 64])
def test_every_kind_of_damage(packed, chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    own = parts(9, packed)
    whole = salvage(b"".join(own))
    ids = [f"<{warc.NAME}{k}>" for k in range(9)]
    assert names(whole) == ids and {f[0] for f in whole} == {"record"}
    at = [sum(map(len, own[:k])) for k in range(10)]
    assert [f[1:3] for f in whole] == list(zip(at[:-1], at[1:], strict=True))
    rng = random.Random(1)
    for _ in range(150):
        bad, kind = rng.randrange(9), rng.choice(["flip", "cut", "junk", "lose", "zero"])
        x = own[bad]
        p = rng.randrange(len(x))
        if kind == "flip":
            x = x[:p] + bytes([x[p] ^ (1 << rng.randrange(8))]) + x[p + 1 :]
        elif kind == "cut":
            x = x[: p + 1] if p + 1 < len(x) else x[:-1]
        elif kind == "junk":
            x = bytes(rng.randrange(256) for _ in range(rng.randint(1, 300))) + x
        elif kind == "lose":
            x = x[p + 1 :]
        else:
            q = min(len(x), p + 40)
            x = x[:p] + bytes(q - p) + x[q:]
        data = b"".join([*own[:bad], x, *own[bad + 1 :]])
        found = salvage(data)
        others = [i for k, i in enumerate(ids) if k != bad]
        assert [i for i in names(found) if i in others] == others, (bad, kind, x)  # all others are recovered, in order
        if kind == "junk":
            assert ids[bad] in names(found)
        # Records and gaps cover the file without overlap, but for a record kept from a damaged member.
        covered, end = 0, 0
        for f in found:
            assert f[1] >= end or f[0] == "gap"
            covered += f[2] - max(f[1], end)
            end = max(end, f[2])
        assert covered == end == len(data)
        for f in found:
            if f[0] == "gap":
                assert f[1] >= at[bad] and f[2] <= at[bad] + len(x)


def test_known_gaps():
    own = parts(4, True)
    junk = b"\x1f\x8b\x08 no member WARC/1.1 no record"
    found = salvage(own[0] + junk + own[1] + own[2][:-20] + own[3])
    at = len(own[0]) + len(junk) + len(own[1])
    assert [f[:3] for f in found if f[0] == "gap"] == [("gap", len(own[0]), len(own[0]) + len(junk)), ("gap", at, at + len(own[2]) - 20)]
    raw = parts(3, False)
    spoilt = raw[1].replace(b"\x01\x01\x01", b"\x01\x02\x01", 1)  # its length and end mark hold
    (gap,) = [f for f in salvage(raw[0] + spoilt + raw[2]) if f[0] == "gap"]
    assert gap == ("gap", len(raw[0]), len(raw[0]) + len(raw[1]), "a digest differs")
    both = warc.member(raw[0] + spoilt + raw[2])  # several records in one member
    assert names(salvage(both)) == [f"<{warc.NAME}0>", f"<{warc.NAME}2>"] and [f[0] for f in salvage(both)] == ["record", "gap", "record"]
    assert [f[0] for f in salvage(b"no archive at all")] == ["gap"] and salvage(b"") == []


def test_plain_gzip_and_foreign_records(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nFolded: a\r\n b\r\nContent-Type: text/plain\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest().encode() + b"\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    dateless = text.replace(b"WARC-Date", b"Other")
    assert [f[0] for f in salvage(text + dateless + text)] == ["record", "gap", "record"]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(text) + b"junk" + gzip.compress(text))
    (tmp_path / "b.warc").write_bytes(text + text[:-9] + text)
    files = spark.createDataFrame([(f"file://{tmp_path}/{x}",) for x in ("a.warc.gz", "b.warc")], "file string")
    rows = warc.read_archives(files, 2).collect()
    assert Counter((r.file[-4:], r.kind) for r in rows) == {("c.gz"[-4:], "record"): 2, ("c.gz"[-4:], "gap"): 1, ("warc", "record"): 2, ("warc", "gap"): 1}
    assert {bytes(r.payload) for r in rows if r.kind == "record"} == {b"hello"}
