"""Streams of detection rows: class votes with state for each track, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annolith.sources.work import Work

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClassVote(StatefulProcessor):
    """The exponential vote of ``annolith.operators.tracking.smoothed_class`` with its state kept between batches."""

    def __init__(self, decay: float, hysteresis: float, ttl_ms: int | None = None):
        self.decay, self.hysteresis, self.ttl_ms = decay, hysteresis, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("vote", "v0 double, v1 double, shown int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        v, shown = ([held[0], held[1]], held[2]) if held else ([0.0, 0.0], None)
        parts = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # the rows of one track in one batch
        out = []
        for c, p in zip(parts["c"], parts["p"], strict=True):
            shown = int(c) if shown is None else shown
            v = [self.decay * v[k] + (1 - self.decay) * (float(p) if c == k else 0.0) for k in (0, 1)]
            best = 1 if v[1] > v[0] else 0
            if best != shown and v[best] > v[shown] + self.hysteresis:
                shown = best
            out.append(shown)
        self.state.update((v[0], v[1], shown))
        yield pd.DataFrame({"track": key[0], "event_id": parts["event_id"].to_numpy(), "shown": out})

    def close(self) -> None:
        pass


class SceneTracks(StatefulProcessor):
    """Per source: scene generation, never-reused display ids and a buffer of lost tracks, with their state kept between batches.

    A row whose ``cut`` holds begins a generation; (generation, raw id) gets the next number at first sight.  A track unseen for more than
    ``buffer`` frames is forgotten: seen again, it is another one.  State holds the tracks of the current scene alone.
    """

    def __init__(self, buffer: int | None = None):
        self.buffer = buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scene = handle.getValueState("scene", "generation long, next long, frame long")
        self.tracks = handle.getMapState("tracks", "raw long", "display long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, number, frame = self.scene.get() if self.scene.exists() else (0, 1, -1)
        known = {k[0]: tuple(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        parts = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        ids, generations = [], []
        for raw, cut in zip(parts["raw"], parts["cut"], strict=True):
            frame += 1
            if cut:
                generation, known = generation + 1, {}
            display, seen = known.get(int(raw), (None, frame))
            if display is None or (self.buffer is not None and frame - seen > self.buffer):
                display, number = number, number + 1
            known[int(raw)] = (display, frame)
            ids.append(display)
            generations.append(generation)
        if self.buffer is not None:
            known = {k: v for k, v in known.items() if frame - v[1] <= self.buffer}
        self.scene.update((generation, number, frame))
        self.tracks.clear()
        for raw, v in known.items():
            self.tracks.updateValue((raw,), v)
        yield pd.DataFrame({"source": key[0], "event_id": parts["event_id"].to_numpy(), "generation": generations, "display_id": ids})

    def close(self) -> None:
        pass


def _run(stream: DataFrame, work: Work, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into a written table, and reads that."""
    where, spark = f"{work.path}/{name}", work.spark
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{work.path}/{name}-log").trigger(availableNow=True).start(where)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(where)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_votes(spark: SparkSession, sf_dir: str, decay: float = 0.7, hysteresis: float = 0.05) -> DataFrame:
    """track, event_id, shown for every event, as a stream would say them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("track"), "ts", "event_id", (F.col("event_id") % 2).cast("int").alias("c"), (F.col("event_id") * 7 % 10 / 10.0).cast("double").alias("p"))
    voted = rows.groupBy("track").transformWithStateInPandas(ClassVote(decay, hysteresis), outputStructType="track long, event_id long, shown int", outputMode="append", timeMode="none")
    return _run(voted, Work(spark, "votes"), "votes", "append")


def scene_tracks(rows: DataFrame, buffer: int | None = None) -> DataFrame:
    """source, event_id, generation, display_id of a stream (source, ts, event_id, raw, cut); batches of one source must come in order."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("source").transformWithStateInPandas(SceneTracks(buffer), outputStructType="source long, event_id long, generation long, display_id long", outputMode="append", timeMode="none")


def stream_display_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, event_id, generation, display_id of all events, as a stream would number them."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("source"), "ts", "event_id", (F.col("event_id") % 5).alias("raw"), (F.col("event_type") == "error").alias("cut"))
    return _run(scene_tracks(rows), Work(spark, "scenes"), "scenes", "append")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by event type of all windows that the watermark (10 minutes) has closed."""
    w = _events(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return _run(w.select(F.col("window.start").alias("window_start"), "event_type", "n"), Work(spark, "windows"), "windows", "append")
