"""WARC archives: a writer that records equal payloads once, and a reader that salvages damaged files.

Writing.  Payloads are equal when SHA-256 and length are.  The record of the
largest page_id of equal payloads is the response, the others are revisits that refer to
it (profile identical-payload-digest) and carry the HTTP header alone; only identifiers and
digests are grouped, and rows of a hot payload are pre-aggregated.  Tasks stream records, one
gzip member each, into ``<part>-<seq>-<attempt>.warc.gz`` in the shared folder.
A manifest, written with Spark's commit protocol, says which files count.

Reading.  A file is read member by member (or record by record where it is
not compressed) with one record in memory.  Checks: gzip checksum, version line,
header fields, length, end mark, block digest and payload digest.  After a
failed check the reader searches for the next place where a whole member or a
version line with a whole record begins, goes on there, and logs the bytes
between as a quarantined gap.  A record whose digest alone fails is a gap of its
own bytes.  A record of a damaged member is kept if its own digest holds.  Inside a gap, a payload that itself holds a whole record cannot be told
from one of the file.

Edge cases: null payload is empty; a null url is written as the record's own name, and white space and control characters of urls are
percent-encoded; a null page_id never is a response that others refer to (if no row of its payload has a page_id, each is a response);
rows that repeat the response's page_id and payload are responses too; other columns are ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, shuffle_partitions, tidy

#: An archive is closed when it exceeds this.
ARCHIVE_BYTES = 32 << 20
CHUNK = 256 << 10
#: A longer header counts as damage.
HEADER_BYTES = 1 << 20
REQUIRED = ("warc-type", "warc-record-id", "warc-date")
NAME = "urn:annolith:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "part int, seq int, file string, n_records long, n_bytes long"
ROWS = "kind string, file string, start long, end long, reason string, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_KINDS = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in ROWS.split(", ")])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, not compressed."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None, name: str) -> str:
    return name if not url else re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(name: str, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The response, or revisit if ``refers_to`` is given, of one page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, name)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{NAME}{refers_to}>")], http)


def member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def with_decisions(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, keep): keep is the page that a revisit refers to, null for responses."""
    named = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    named = named.withColumn("sha", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    rows = named.where(F.col("n") >= least).groupBy("sha", "n", "page_id").agg(F.count("*").alias("k"))
    kept = rows.groupBy(F.col("sha").alias("of"), F.col("n").alias("of_n")).agg(F.max("page_id").alias("keep"), F.count("*").alias("k")).where("k > 1 and keep is not null").drop("k")
    again = rows.join(kept, F.expr("sha = of and n = of_n and not page_id <=> keep")).select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "keep")
    return named.join(again.hint("shuffle_hash"), F.expr("page_id <=> again and sha = again_sha"), "left").select("page_id", "url", "html", "keep")


def write_archives(pages: DataFrame, work: Work, least: int = 0) -> DataFrame:
    """Writes a record for each page; payloads of fewer bytes than ``least`` are all responses.  Returns the manifest: part, seq, file, n_records, n_bytes."""
    folder = f"{work.path}/archives"

    @tidy
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        part, seq, n, at, out, names = task.partitionId(), 0, 0, 0, None, 0
        store, path = fs.FileSystem.from_uri(folder)

        def closed():
            out.close()
            store.move(f"{place}.part", place)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": f"{folder}/{place.rpartition('/')[2]}", "n_records": n, "n_bytes": at}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, html, keep in zip(*batch.columns, strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    place = f"{path}/{part:05d}-{seq:05d}-{task.taskAttemptId()}.warc.gz"
                    out, at, n = store.open_output_stream(f"{place}.part"), 0, 0
                    info = member(record("warcinfo", [("WARC-Record-ID", f"<urn:annolith:archive:{part}-{seq}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: annolith\r\nformat: WARC File Format 1.1\r\n"))
                    out.write(info)
                    at = len(info)
                own = page_id.as_py()
                names += own is None
                data = member(page_record(f"{NAME}{own}" if own is not None else f"urn:annolith:unnamed:{part}-{names}", url.as_py(), html.as_py(), keep.as_py()))
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= ARCHIVE_BYTES:
                    yield closed()
                    seq, out = seq + 1, None
        if out is not None:
            yield closed()

    return work.table(with_decisions(pages, least).mapInArrow(run, MANIFEST), "manifest")


# --- reading


class Damaged(Exception):
    """A failed check; ``end``: where the record ends, if that is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def _digest_holds(value: str, data: bytes) -> bool | None:
    """None: a digest of unknown kind."""
    kind, _, text = value.partition(":")
    if kind.lower() not in ("sha1", "md5", "sha256", "sha512"):
        return None
    own = hashlib.new(kind.lower(), data).digest()
    return text.lower() == own.hex() or text.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


class _Stream:
    """Bytes of a file from ``at`` on; ``data`` holds what has been read and not yet taken."""

    def __init__(self, file, at: int):
        self.file, self.size, self.at, self.data = file, file.size(), at, bytearray()

    def more(self) -> bool:
        raw = self.file.read_at(min(CHUNK, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(raw)
        self.data += raw
        return bool(raw)

    def left(self) -> int | None:
        """Bytes that can still come, if known."""
        return len(self.data) + self.size - self.at

    def place(self) -> int:
        """Place in the file of the next byte."""
        return self.at - len(self.data)

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self.more():
                raise Damaged("the record is cut off")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def header(self) -> bytes:
        """Up to the empty line, which is taken too; empty at the end of the stream."""
        while len(self.data) < 7 and self.more():
            pass
        if not self.data:
            return b""
        if not self.data.startswith(b"WARC/1."):
            raise Damaged("no version line")
        seen = 0
        while (at := self.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.data)
            if seen > HEADER_BYTES or not self.more():
                raise Damaged("the header does not end")
        out = self.take(at)
        self.take(4)
        return out


class _Member(_Stream):
    """The decompressed bytes of the gzip member that begins at ``at``; its checksum is checked where it ends."""

    def __init__(self, file, at: int):
        super().__init__(file, at)
        self.open, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bool:
        while not self.open.eof:
            raw = self.rest or (self.file.read_at(min(CHUNK, self.size - self.at), self.at) if self.at < self.size else b"")
            if not raw:
                raise Damaged("the member is cut off")
            if not self.rest:
                self.at += len(raw)
            try:
                out = self.open.decompress(raw, 16 * CHUNK)
            except zlib.error as e:
                raise Damaged(f"the member does not decompress: {e}") from None
            self.rest = self.open.unconsumed_tail
            if out:
                self.data += out
                return True
        return False

    def left(self) -> int | None:
        return None

    def place(self) -> int:
        return self.at - len(self.open.unused_data)


def _fields(raw: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw).split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d+", lines[0]):
        raise Damaged("no version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged("a header line without a name")
        key = name.decode().lower()
        if key in out and key != "warc-concurrent-to":  # two headers that have run into one
            raise Damaged("a header field twice")
        out[key] = value.strip().decode("utf-8", "replace")
    return out


def _next_record(stream: _Stream) -> tuple[dict[str, str], bytes, bytes, bool] | None:
    """(header fields, block, payload, whether a digest was checked) of the record at the head of the stream; None at its end."""
    raw = stream.header()
    if not raw:
        return None
    fields = _fields(raw)
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damaged("no valid length")
    if stream.left() is not None and int(length) > stream.left():
        raise Damaged("the record is longer than the file")
    block = stream.take(int(length))
    if stream.take(4) != b"\r\n\r\n":
        raise Damaged("no end mark behind the block")
    http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    checks = [_digest_holds(fields["warc-block-digest"], block)] if "warc-block-digest" in fields else []
    if "warc-payload-digest" in fields and fields.get("warc-type") != "revisit":
        checks.append(_digest_holds(fields["warc-payload-digest"], payload))
    if False in checks:
        raise Damaged("a digest differs", stream.place())
    if missing := [x for x in REQUIRED if not fields.get(x)]:
        raise Damaged(f"no {', '.join(missing)}", stream.place())
    return fields, block, payload, True in checks


class Salvage:
    """Iterates over ("record", start, end, fields, block, payload) and ("gap", start, end, reason) of a file (anything with size() and read_at(n, place))."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def _starts(self, at: int) -> bool:
        return at == self.size or self.file.read_at(min(7, self.size - at), at).startswith((b"\x1f\x8b\x08", b"WARC/1."))

    def _records(self, at: int) -> Iterator[tuple]:
        """Records of the member or the single record at ``at``, returns where it ends."""
        if self.file.read_at(min(2, self.size - at), at) != b"\x1f\x8b":
            stream = _Stream(self.file, at)
            fields, block, payload, _ = _next_record(stream)
            yield "record", at, stream.place(), fields, block, payload
            return stream.place()
        stream, held = _Member(self.file, at), None
        try:
            while (found := self._checked(stream)) is not None:
                if held:
                    yield self._told(at, stream, held)
                held = found
        except Damaged:
            if isinstance(held, Damaged) or held and held[3]:  # its own digest holds, whatever else is wrong with the member
                yield self._told(at, stream, held)
            raise
        if held is None:
            raise Damaged("an empty member", stream.place())
        yield self._told(at, stream, held)
        return stream.place()

    @staticmethod
    def _checked(stream: _Stream):
        """The next record, None, or the failed check of a record of known length: the next one stands behind it."""
        try:
            return _next_record(stream)
        except Damaged as e:
            if e.end is None:
                raise
            return e

    @staticmethod
    def _told(at: int, stream: _Stream, held) -> tuple:
        return ("gap", at, stream.place(), held.reason) if isinstance(held, Damaged) else ("record", at, stream.place(), *held[:3])

    def _candidates(self, at: int) -> Iterator[int]:
        """Places from ``at`` on where a member or a version line may begin."""
        mark = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
        kept, place = b"", at
        while True:
            raw = self.file.read_at(min(CHUNK, self.size - place), place) if place < self.size else b""
            text, base = kept + raw, place - len(kept)
            stop = len(text) if not raw else len(text) - 6  # a mark that may go on in the next bytes waits for them
            for m in mark.finditer(text):
                if m.start() < stop:
                    yield base + m.start()
            if not raw:
                return
            kept, place = text[max(stop, 0) :], place + len(raw)

    def _next_valid(self, at: int) -> int:
        for place in self._candidates(at):
            try:
                if next(self._records(place))[0] == "record":
                    return place
            except Damaged:
                continue
        return self.size

    def __iter__(self) -> Iterator[tuple]:
        at = 0
        while at < self.size:
            records = self._records(at)
            try:
                while True:
                    try:
                        found = next(records)
                    except StopIteration as done:
                        at = done.value
                        break
                    yield found
            except Damaged as e:
                end = e.end if e.end is not None and e.end > at and self._starts(e.end) else self._next_valid(at + 1)
                yield "gap", at, end, e.reason
                at = end


def _row(file: str, found: tuple, payloads: bool) -> dict:
    kind, start, end, *rest = found
    if kind == "gap":
        return {"kind": kind, "file": file, "start": start, "end": end, "reason": rest[0]}
    fields, block, payload = rest
    size = len(payload)
    if fields.get("warc-type") == "revisit":  # the length of the payload that is not repeated here
        said = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", block)
        size = int(said[1]) if said else None
    return {
        "kind": kind, "file": file, "start": start, "end": end, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest"), "payload_bytes": size, "payload": payload if payloads else None,
    }


def read_archives(files: DataFrame, partitions: int, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files named in column ``file``; kind tells them apart.  A file is read by one task, record by record."""

    @tidy
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    rows, size = [], 0
                    for found in Salvage(source):
                        rows.append(_row(file, found, payloads))
                        size += len(rows[-1].get("payload") or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)

    return files.select("file").repartition(partitions, "file").mapInArrow(run, ROWS)


def archived_pages(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, reads the archives back: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to.  A gap in these fresh files is an error."""
    manifest = write_archives(pages, Work(spark, "warc"), least)
    rows = read_archives(manifest, shuffle_partitions(spark), payloads=False)
    number = lambda c: F.regexp_extract(c, f"^<{NAME}(-?[0-9]+)>$", 1)
    kind = F.when(F.col("kind") == "gap", F.raise_error(F.concat_ws(" ", "file", "start", "end", "reason"))).otherwise(F.col("record_type"))
    found = rows.select(
        number("record_id").try_cast("long").alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        kind.alias("record_type"),
        number("refers_to").try_cast("long").alias("refers_to"),
    )
    return found.where("record_type in ('response', 'revisit')")
