"""Token-ID / binary output: documents compressed one by one against a shared zstandard dictionary.

File format of one shard (all integers little-endian)::

    8 bytes   b"ANNOTOK1"
    u32       length of the header, then the header as JSON: dictionary sha256, number of
              documents, id width in bytes, end id
    n * i64   doc_id, ascending
    (n+1)*u64 offset index: document i's frame is at offsets[i] : offsets[i + 1] of the payload
    n * u32   number of ids of each document
    payload   one zstandard frame for each document

A short document is opened by one index look-up and one small decompression.
The dictionary is trained once on the serialized ids of a bounded sample
(``SAMPLE`` documents, those of least hash), written beside the shards and
named in every shard by its SHA-256, which the reader checks.

Tasks write shards as files ``<part>-<seq>-<attempt>.tok`` into a folder of the shared file
system.  Which of them count is said by a manifest, a table written with
Spark's commit protocol: a file of a lost or repeated attempt is in no manifest row and never read.

Edge cases: null text is empty (only the end id is written); a null doc_id
sorts first and is kept as such; repeated rows are each written; an empty
table gives no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work, shuffle_partitions, tidy
from .tokens import encode_column, tokenizer_path

MAGIC = b"ANNOTOK1"
NULL_ID = -(1 << 63)
#: Documents whose ids train the dictionary, at most, and characters of each (from a place drawn by its identifier) and bytes of their ids that are shown to it.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 4096, 65536
#: A shard is closed when its ids exceed this.
SHARD_BYTES = 8 << 20

MANIFEST = "part int, seq int, file string, first_doc_id long, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _encoded(batches, path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, flat, bounds in encode_column(batch.column(1), path):
            for i in range(len(bounds) - 1):
                yield ids[first + i], np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A zstandard dictionary from at most SAMPLE documents, the same at every run."""
    import zstandard

    ids = docs.select(F.col("doc_id").alias("picked")).where("picked is not null").distinct().orderBy(F.xxhash64("picked"), "picked").limit(SAMPLE)
    start = F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES + 1)).cast("int") + 1
    picked = docs.select("doc_id", F.substring(F.col("text"), start, F.lit(SAMPLE_BYTES)).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("picked"))  # SAMPLE rows bound the broadcast
    rows = picked.groupBy("doc_id").agg(F.max("text").alias("text")).orderBy("doc_id").collect()
    samples = []
    for row in rows:
        for _, flat, _ in encode_column(pa.array([row.text], type=pa.string()), path):
            samples.append(np.append(flat, np.uint32(end_id)).astype("<u4").tobytes()[:SAMPLE_BYTES])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples for training: their bytes serve as a plain dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def pack_shard(doc_ids: list[int | None], frames: list[bytes], counts: list[int], dictionary: bytes, end_id: int) -> bytes:
    header = json.dumps({"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "documents": len(doc_ids), "width": 4, "end_id": end_id}, sort_keys=True).encode()
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, keys.tobytes(), offsets.tobytes(), np.array(counts, dtype="<u4").tobytes(), *frames])


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        (size,) = struct.unpack_from("<I", data, 8)
        self.header = json.loads(data[12 : 12 + size])
        if self.header["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("another dictionary was used for this shard")
        n, at = self.header["documents"], 12 + size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 8 * n).astype(np.int64)
        self.counts = np.frombuffer(data, "<u4", n, at + 16 * n + 8)
        self.payload = at + 20 * n + 8
        self.data = memoryview(data)
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def ids(self, i: int) -> np.ndarray:
        raw = self.open(bytes(self.data[self.payload + self.offsets[i] : self.payload + self.offsets[i + 1]]), max_output_size=4 * int(self.counts[i]))
        return np.frombuffer(raw, "<u4")


def write_file(uri: str, data: bytes) -> None:
    """Into any file system that pyarrow reaches (local, HDFS, object stores); the whole file appears at once."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.part") as out:
        out.write(data)
    store.move(f"{path}.part", path)


def read_file(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source:
        return source.read()


def write_shards(spark: SparkSession, docs: DataFrame, work: Work, path: str, end_id: int) -> tuple[DataFrame, bytes]:
    """Writes all documents in ascending doc_id order; returns (manifest, dictionary)."""
    dictionary = train_dictionary(docs, path, end_id)
    folder = f"{work.path}/files"
    write_file(f"{folder}/dictionary.zstd", dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    @tidy
    def encode(batches):
        import zstandard
        from pyspark import TaskContext

        own, task = shared.value, TaskContext.get()
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_content_size=True).compress
        part, seq, ids, frames, counts, size = task.partitionId(), 0, [], [], [], 0

        def closed():
            data = pack_shard(ids, frames, counts, own, end_id)
            file = f"{folder}/{part:05d}-{seq:05d}-{task.taskAttemptId()}.tok"
            write_file(file, data)
            row = {"part": part, "seq": seq, "file": file, "first_doc_id": ids[0], "n_docs": len(ids), "n_tokens": sum(counts), "n_bytes": len(data)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *((x, pa.int64()) for x in ("first_doc_id", "n_docs", "n_tokens", "n_bytes"))]))

        for doc_id, flat in _encoded(batches, path, end_id):
            ids.append(doc_id)
            frames.append(press(flat.tobytes()))
            counts.append(len(flat))
            size += len(frames[-1])
            if size >= SHARD_BYTES:
                yield closed()
                seq, ids, frames, counts, size = seq + 1, [], [], [], 0
        if ids:
            yield closed()

    order = ["doc_id", F.length("text"), F.xxhash64("text")]  # rows that share an identifier, or have none, can lie in many ranges
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return work.table(ordered.mapInArrow(encode, MANIFEST), "manifest"), dictionary


def read_shards(spark: SparkSession, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    # Ids before each shard: those of earlier parts (one row for each part of the write), and of earlier shards of its part.
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    shards = manifest.withColumn("within", within).join(before, F.col("part") == F.col("p")).select("file", (F.col("before") + F.col("within")).alias("start"))
    shared = spark.sparkContext.broadcast(dictionary)

    @tidy
    def decode(batches):
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = ShardReader(read_file(file), shared.value)
                n = reader.counts.astype(np.int64)
                start = base + np.cumsum(n) - n
                crc = [zlib.crc32(reader.ids(i)) for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == NULL_ID), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(shuffle_partitions(spark), "file").mapInArrow(decode, ROWS)


def token_id_output(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Encodes, writes and reads back all documents: (doc_id, start, n_tokens, ids_crc32)."""
    manifest, dictionary = write_shards(spark, docs, Work(spark, "binary"), tokenizer_path(vocabulary), end_id)
    return read_shards(spark, manifest, dictionary)
