"""What the operators of this subpackage share: the shared work folder, written tables, ranks."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.sources.work import Work

__all__ = ["SPACE", "WORD", "Work", "binary_array", "crc32_of_id", "documents", "list_array", "lower_ascii", "ragged", "shuffle_partitions", "small_batches", "tidy"]

#: Words of most contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def lower_ascii(text):
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Rows go to and from Python by ``rows`` at most while this holds: for steps (run inside it) whose rows are wide, so that a task's batches stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """For a function over Arrow batches: a Python worker that has ended a task keeps none of the memory that the task has freed, while it waits for the next."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def crc32_of_id(doc_id):
    """crc32 of the identifier written as text; null stays null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges starts[i] : starts[i] + counts[i]."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary array: item i is the bytes of data[bounds[i] : bounds[i + 1]]."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(bounds, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8) if data.size else b"")])


def list_array(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, dtype=np.int32)), pa.array(data, type=kind))
