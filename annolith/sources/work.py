"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="annolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where folders opened by this thread's innermost ``owned`` are listed.
_OPENED: ContextVar[list[Work] | None] = ContextVar("opened", default=None)


@contextmanager
def owned() -> Iterator[None]:
    """Closes the folders that this thread opens inside: for who writes a result that needed them, and then needs them no more."""
    mine: list[Work] = []
    token = _OPENED.set(mine)
    try:
        yield
    finally:
        _OPENED.reset(token)
        for work in mine:
            work.close()


class Work:
    """A scratch folder of one operator call: tables are written there and read back, which cuts lineage.

    A written table survives the loss of any executor; nothing is kept in executors' memory or disks.
    The folder goes when it is closed (see ``owned``), or else with the application, unless it is to be kept.
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        self.spark, self.path = spark, f"{shared_folder(spark)}/annolith/{name}-{uuid.uuid4().hex}"
        if not keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            store = path.getFileSystem(spark._jsc.hadoopConfiguration())
            store.mkdirs(path)
            store.deleteOnExit(path)
        mine = _OPENED.get()
        if mine is not None and not keep:
            mine.append(self)

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Deletes the whole folder."""
        self._delete(self.path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
