"""Detections of a stream to tracks: association by overlap in two stages of score, lost tracks that expire by event time.

Rows are detections (source, frame, ts, i, s, c, x1, y1, x2, y2, cut); rows of one source and frame
number are one frame and share ts and cut.  Frames of a source are taken in the order of (ts, frame).  For each frame:

0. a frame whose ``cut`` holds ends all open tracks (event "cut");
1. tracks last seen more than ``buffer`` before the frame are expired (event "lost");
2. detections of score ``high`` or more take open tracks, pairs of the largest overlap first (then the lower track, then the lower i), down to an overlap of ``overlap``;
3. the tracks left of those seen in the frame before take detections of score ``low`` to below ``high`` in the same way, down to ``weak_overlap``;
4. detections left of score ``new`` or more open tracks, numbered on from the last number of the source, which is never used again.

A source that falls silent keeps no state for long: an event-time timer expires
its tracks once the watermark has passed their last sight by ``buffer``.
Rows behind the watermark are late and dropped; so are rows of frames at or before the last frame that the source has had.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annolith.streaming.votes import PROVIDER

OUTPUT = "source long, event string, track long, frame long, i int, ts timestamp, seen long"


@dataclass(frozen=True)
class TrackerConfig:
    """Limits of the tracker; every value is checked when it is made."""

    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    overlap: float = 0.2
    weak_overlap: float = 0.5
    buffer_seconds: float = 1.0
    decay: float | None = None
    hysteresis: float = 0.0
    cut_correlation: float | None = None
    cut_difference: float | None = None

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if v is None and f.default is None:
                continue
            if isinstance(v, bool) or not isinstance(v, int | float) or v != v:
                raise ValueError(f"{f.name} must be a number")
        if not 0 <= self.low <= self.high <= 1:
            raise ValueError("0 <= low <= high <= 1 must hold")
        if not 0 <= self.new <= 1 or not 0 <= self.overlap < 1 or not 0 <= self.weak_overlap < 1:
            raise ValueError("new, overlap and weak_overlap must lie in 0 to 1")
        if self.buffer_seconds < 0 or self.hysteresis < 0:
            raise ValueError("buffer_seconds and hysteresis must not be negative")
        if self.decay is not None and not 0 <= self.decay < 1:
            raise ValueError("decay must lie in 0 to below 1")
        if self.cut_correlation is not None and not -1 <= self.cut_correlation <= 1:
            raise ValueError("cut_correlation must lie in -1 to 1")
        if self.cut_difference is not None and not 0 < self.cut_difference <= 255:
            raise ValueError("cut_difference must lie above 0, up to 255")

    @classmethod
    def from_yaml(cls, path: str | Path) -> TrackerConfig:
        """From a mapping whose keys are the names of the fields; any other key is an error."""
        import yaml

        given = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
        given = {} if given is None else given
        if not isinstance(given, dict):
            raise ValueError(f"{path} must hold a mapping")
        if unknown := sorted(set(map(str, given)) - {f.name for f in fields(cls)}):
            raise ValueError(f"{path} has unknown keys: {', '.join(unknown)}")
        return cls(**given)

    def with_confidence(self, confidence: float) -> TrackerConfig:
        """One confidence for matches and new tracks; weak detections stay below it."""
        return replace(self, high=confidence, new=confidence, low=min(self.low, confidence))

    def buffer_frames(self, fps: float) -> int:
        """The buffer in frames, half to even, one at least."""
        if not fps > 0:
            raise ValueError("fps must be positive")
        return max(1, round(self.buffer_seconds * fps))


def overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inner = max(w, 0.0) * max(h, 0.0)
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / whole if whole > 0 else 0.0


def pairs(tracks: dict[int, tuple], boxes: dict[int, tuple], least: float) -> dict[int, int]:
    """i: track of the pairs taken by falling overlap, then track, then i."""
    found = sorted((-o, t, i) for t, a in tracks.items() for i, b in boxes.items() if (o := overlap(a, b)) >= least and o > 0)
    out, used = {}, set()
    for _, t, i in found:
        if i not in out and t not in used:
            out[i] = t
            used.add(t)
    return out


class Associate(StatefulProcessor):
    """State of a source: its last frame and number, and its open tracks (box, last sight, first sight, frames seen)."""

    def __init__(self, config: TrackerConfig):
        self.config, self.buffer = config, round(config.buffer_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, frame long, number long")
        self.open = handle.getMapState("open", "track long", "x1 double, y1 double, x2 double, y2 double, ts long, frame long, seen long")

    def _wake(self) -> None:
        """One timer, for the track that expires first."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [v[4] for _, v in self.open.iterator()] if self.open.exists() else []
        if times:
            self.handle.registerTimer((min(times) + self.buffer) // 1000 + 1)

    @staticmethod
    def _told(key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["event", "track", "frame", "i", "ts", "seen"])
        out.insert(0, "source", key[0])
        return out.assign(ts=pd.to_datetime(out["ts"], unit="us"), i=out["i"].astype("Int32"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, out = self.config, []
        at, frame, number = self.last.get() if self.last.exists() else (-(1 << 62), -(1 << 62), 1)
        tracks = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        parts = pd.concat(list(rows))
        parts["us"] = parts["ts"].to_numpy(dtype="datetime64[us]").astype("int64")
        parts = parts.sort_values(["us", "frame", "i"])
        # Plain lists: a table for each frame costs far more than the few boxes in it.
        dets_ = zip(*(parts[k].tolist() for k in ("us", "frame", "i", "s", "x1", "y1", "x2", "y2", "cut")), strict=True)
        for (us, own), dets in groupby(dets_, key=itemgetter(0, 1)):
            if (us, own) <= (at, frame):
                continue
            dets = list(dets)
            if any(d[8] for d in dets):
                out += [("cut", t, v[5], None, v[4], v[6]) for t, v in sorted(tracks.items())]
                tracks = {}
            gone = {t: v for t, v in tracks.items() if us - v[4] > self.buffer}
            out += [("lost", t, v[5], None, v[4], v[6]) for t, v in sorted(gone.items())]
            tracks = {t: v for t, v in tracks.items() if t not in gone}
            box = {d[2]: d[4:8] for d in dets}
            score = {d[2]: d[3] for d in dets}
            taken = pairs(tracks, {i: b for i, b in box.items() if score[i] >= c.high}, c.overlap)
            rest = {t: v for t, v in tracks.items() if t not in taken.values() and (v[4], v[5]) == (at, frame)}
            taken |= pairs(rest, {i: b for i, b in box.items() if c.low <= score[i] < c.high}, c.weak_overlap)
            for i in sorted(box):
                if i not in taken and score[i] >= c.new:
                    taken[i], number = number, number + 1
                if i in taken:
                    seen = tracks[taken[i]][6] + 1 if taken[i] in tracks else 1
                    tracks[taken[i]] = (*map(float, box[i]), int(us), int(own), seen)
                    out.append(("seen", taken[i], int(own), i, int(us), seen))
            at, frame = int(us), int(own)
        self.last.update((at, frame, number))
        self._keep(tracks)
        if out:
            yield self._told(key, out)

    def _keep(self, tracks: dict[int, tuple]) -> None:
        self.open.clear()
        for t, v in tracks.items():
            self.open.updateValue((t,), v)
        self._wake()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracks = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        now = timerValues.getCurrentWatermarkInMs()
        gone = {t: v for t, v in tracks.items() if (v[4] + self.buffer) // 1000 + 1 <= now}
        self._keep({t: v for t, v in tracks.items() if t not in gone})
        if gone:
            yield self._told(key, [("lost", t, v[5], None, v[4], v[6]) for t, v in sorted(gone.items())])

    def close(self) -> None:
        pass


def associate(detections: DataFrame, config: TrackerConfig, late: str = "10 minutes") -> DataFrame:
    """source, event ("seen", "lost" or "cut"), track, frame, i, ts, seen of a stream of detections.

    "seen": detection i of the frame belongs to the track, for the seen-th time.  "lost" and "cut": the track has ended; frame, ts and seen are those of its last sight.
    """
    detections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = detections.select("source", "frame", "ts", "i", "s", "x1", "y1", "x2", "y2", "cut").withWatermark("ts", late)
    return rows.groupBy("source").transformWithStateInPandas(Associate(config), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
