"""Streams of frames: cuts against the frame before, a limit of frames for each source, and a log of rates."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from annolith.streaming.votes import PROVIDER


def is_cut(before: np.ndarray, now: np.ndarray, least_correlation: float, most_difference: float) -> bool:
    """The rule of ``annolith.operators.evidence.scene_cuts``."""
    x, y = now - now.mean(), before - before.mean()
    spread = np.sqrt((x * x).sum() * (y * y).sum())
    correlation = (x * y).sum() / spread if spread > 0 else float(np.array_equal(now, before))
    return bool(correlation < least_correlation or np.abs(now - before).mean() > most_difference)


class SceneCuts(StatefulProcessor):
    """State of a source: the histogram and place of its last frame.  A row at or before that place is late: it is told as such, is no cut and changes nothing."""

    def __init__(self, least_correlation: float, most_difference: float):
        self.limits = least_correlation, most_difference

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "frame long, histogram array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, histogram = self.before.get() if self.before.exists() else (None, None)
        parts = pd.concat(list(rows)).sort_values("frame", kind="stable")
        cuts, late = [], []
        for frame, own in zip(parts["frame"].tolist(), parts["histogram"], strict=True):
            late.append(place is not None and frame <= place)
            cuts.append(not late[-1] and histogram is not None and is_cut(np.asarray(histogram, dtype=float), np.asarray(own, dtype=float), *self.limits))
            if not late[-1]:
                place, histogram = frame, own
        self.before.update((place, [float(x) for x in histogram]))
        yield pd.DataFrame({"source": key[0], "frame": parts["frame"].to_numpy(), "cut": cuts, "late": late})

    def close(self) -> None:
        pass


def scene_cuts(frames: DataFrame, least_correlation: float, most_difference: float) -> DataFrame:
    """source, frame, cut, late of a stream (source, frame, histogram)."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return frames.select("source", "frame", "histogram").groupBy("source").transformWithStateInPandas(SceneCuts(least_correlation, most_difference), outputStructType="source long, frame long, cut boolean, late boolean", outputMode="append", timeMode="none")


class FirstFrames(StatefulProcessor):
    """Lets the first ``most`` frames of a source through; state is their number, so a source that has had its frames costs nothing but that."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        room, held = self.most - n, None
        for part in rows:
            if room > 0:  # the first of what the batch brings, whatever its size
                held = part if held is None else pd.concat([held, part])
                held = held.sort_values("frame", kind="stable").head(room)
        if held is not None and len(held):
            self.count.update((n + len(held),))
            yield pd.DataFrame({"source": key[0], "frame": held["frame"].to_numpy(), "number": n + 1 + np.arange(len(held))})

    def close(self) -> None:
        pass


def first_frames(frames: DataFrame, most: int) -> DataFrame:
    """source, frame, number (from 1) of the first ``most`` frames of each source of a stream; batches of a source must come in order."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return frames.select("source", "frame").groupBy("source").transformWithStateInPandas(FirstFrames(most), outputStructType="source long, frame long, number long", outputMode="append", timeMode="none")


class RateLog(StreamingQueryListener):
    """Keeps batch, rows, rows per second and watermark of every batch of the streams named ``name``, until ``write`` puts them into a table.

    One short row for each batch; ``callback(batch, rows, rows per second)`` is called as they come, if given.
    """

    def __init__(self, name: str, callback=None):
        self.name, self.callback, self.rows = name, callback, []
        self.own, self.ended = None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.own = event.id

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            rate = p.processedRowsPerSecond
            self.rows.append((p.batchId, p.timestamp, p.numInputRows, float(rate) if rate == rate else 0.0, dict(p.eventTime).get("watermark"), json.loads(p.json).get("batchDuration", 0)))
            if self.callback:
                self.callback(p.batchId, p.numInputRows, rate)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self.own:
            self.ended.set()

    def write(self, spark: SparkSession, where: str) -> DataFrame:
        """Appends what has been gathered to the table at ``where``."""
        schema = "batch long, at string, n_rows long, rows_per_second double, watermark string, duration_ms long"
        rows, self.rows = self.rows, []
        spark.createDataFrame(rows, schema).withColumn("stream", F.lit(self.name)).coalesce(1).write.mode("append").parquet(where)
        return spark.read.parquet(where)


def logged(stream: DataFrame, name: str, where: str, log: str, checkpoint: str, callback=None) -> tuple[DataFrame, DataFrame]:
    """Runs a stream over what is there now into the table at ``where`` while its rates are logged: (rows, log)."""
    spark = stream.sparkSession
    rates = RateLog(name, callback)
    spark.streams.addListener(rates)
    try:
        stream.writeStream.queryName(name).format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(where).awaitTermination()
        rates.ended.wait(30)  # events come after the stream has ended
    finally:
        spark.streams.removeListener(rates)
    return spark.read.schema(stream.schema).parquet(where), rates.write(spark, log)
