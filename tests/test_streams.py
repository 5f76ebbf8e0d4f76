"""Streams over several micro-batches: state between batches, timers, late rows, limits, rates."""

import datetime as dt
import random

import pytest

from annolith.operators import evidence
from annolith.streaming import frames, tracker

DETECTION = "source long, frame long, ts timestamp, i int, s double, c int, x1 double, y1 double, x2 double, y2 double, cut boolean"
FRAME = "source long, frame long, histogram array<double>"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def batches(spark, tmp_path, schema, parts):
    """A stream that brings each part as a micro-batch of its own, in order."""
    for k, rows in enumerate(parts):
        folder = tmp_path / f"in{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
        (file,) = [f for f in folder.iterdir() if f.suffix == ".parquet"]
        (tmp_path / "all").mkdir(exist_ok=True)
        file.rename(tmp_path / "all" / f"{k:03d}.parquet")
        import os

        os.utime(tmp_path / "all" / f"{k:03d}.parquet", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))


def run(stream, tmp_path):
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def detections(seed, n=60):
    rng, out = random.Random(seed), []
    for source in (1, 2, 3):
        for frame in range(n if source != 3 else n // 4):  # source 3 falls silent
            if rng.random() < 0.15:
                continue
            ts = START + dt.timedelta(seconds=frame * 10 + source)
            cut = rng.random() < 0.04
            for i in range(4):
                if rng.random() < 0.7:
                    x, y = i * 60 + frame * 1.5 + rng.randint(0, 6), 40 * source + rng.randint(0, 6)
                    out.append((source, frame, ts, i, rng.randint(0, 100) / 100, 0, float(x), float(y), float(x + 40), float(y + 30), cut))
    return out


CONFIG = tracker.TrackerConfig(high=0.5, low=0.2, new=0.6, overlap=0.2, weak_overlap=0.4, buffer_seconds=45.0)


def plain(rows, config, watermark):
    """The rules frame by frame; watermark: what the stream has reached at its end."""
    out = []
    for source in sorted({r[0] for r in rows}):
        own, tracks, number, before = [r for r in rows if r[0] == source], {}, 1, None
        for ts, frame in sorted({(r[2], r[1]) for r in own}):
            dets = {r[3]: r for r in own if (r[2], r[1]) == (ts, frame)}
            if any(r[10] for r in dets.values()):
                out += [(source, "cut", t, None) for t in tracks]
                tracks = {}
            for t in [t for t, v in tracks.items() if (ts - v["ts"]).total_seconds() > config.buffer_seconds]:
                out.append((source, "lost", t, None))
                del tracks[t]
            taken = {}
            for least, score, able in ((config.overlap, lambda s: s >= config.high, lambda v: True), (config.weak_overlap, lambda s: config.low <= s < config.high, lambda v: v["ts"] == before)):
                free = sorted([(-tracker.overlap(v["box"], r[6:10]), t, i) for t, v in tracks.items() for i, r in dets.items() if t not in taken.values() and able(v) and score(r[4])])
                for o, t, i in free:
                    if -o >= least and t not in taken.values() and i not in taken:
                        taken[i] = t
            for i in sorted(dets):
                if i not in taken and dets[i][4] >= config.new:
                    taken[i], number = number, number + 1
                if i in taken:
                    tracks[taken[i]] = {"box": dets[i][6:10], "ts": ts}
                    out.append((source, "seen", taken[i], (frame, i)))
            before = ts
        out += [(source, "lost", t, None) for t, v in tracks.items() if v["ts"] + dt.timedelta(seconds=config.buffer_seconds, milliseconds=1) <= watermark]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 4])
def test_tracks_over_batches(spark, tmp_path, n):
    rows = detections(5)
    edges = [START + dt.timedelta(seconds=600 * k / n) for k in range(n)] + [START + dt.timedelta(days=1)]
    parts = [[r for r in rows if a <= r[2] < b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    got = run(tracker.associate(batches(spark, tmp_path, DETECTION, parts), CONFIG, "20 seconds"), tmp_path)
    told = sorted([(r.source, r.event, r.track, (r.frame, r.i) if r.event == "seen" else None) for r in got], key=str)
    want = plain(rows, CONFIG, max(r[2] for r in rows) - dt.timedelta(seconds=20))
    assert told == want
    assert {e for _, e, _, _ in want} == {"seen", "lost", "cut"} and any(s == 3 and e == "lost" for s, e, _, _ in want)
    seen = {}
    for r in sorted((r for r in got if r.event == "seen"), key=lambda r: r.ts):
        seen[r.source, r.track] = seen.get((r.source, r.track), 0) + 1
        assert r.seen == seen[r.source, r.track]


def test_tracker_configuration(tmp_path):
    file = tmp_path / "tracker.yaml"
    file.write_text("﻿high: 0.4\nlow: 0.3\nbuffer_seconds: 0.5\ndecay: null\n", encoding="utf-8")
    config = tracker.TrackerConfig.from_yaml(file)
    assert (config.high, config.low, config.new) == (0.4, 0.3, 0.25)
    lower = config.with_confidence(0.2)
    assert (lower.high, lower.new, lower.low) == (0.2, 0.2, 0.2)
    assert [tracker.TrackerConfig(buffer_seconds=s).buffer_frames(f) for s, f in ((1.0, 15), (0.0, 30), (0.1, 25), (0.5, 3))] == [15, 1, 2, 2]
    file.write_text("")
    assert tracker.TrackerConfig.from_yaml(file) == tracker.TrackerConfig()
    for text in ("- 1", "hi: 0.3", "high: 2", "low: 0.9", "overlap: 1", "buffer_seconds: -1", "decay: 1", "cut_correlation: -2", "cut_difference: 0", "hysteresis: -0.1", "high: yes", "new: .nan"):
        file.write_text(text)
        with pytest.raises(ValueError):
            tracker.TrackerConfig.from_yaml(file)
    with pytest.raises(ValueError):
        tracker.TrackerConfig().buffer_frames(0)


def test_scene_cuts_over_batches_equal_the_batch_query(spark, tmp_path):
    rng = random.Random(2)
    rows, now = [], {}
    for frame in range(80):
        for source in (1, 2):
            now[source] = [float(rng.randint(0, 9)) for _ in range(6)] if rng.random() < 0.2 else now.get(source, [1.0] * 6)
            rows.append((source, frame, now[source]))
    parts = [[r for r in rows if r[1] // 20 == k] for k in range(4)]
    parts[2] += [(1, 5, [9.0] * 6), (2, 19, [0.0, 9.0] * 3)]  # late: before what the sources have had
    got = run(frames.scene_cuts(batches(spark, tmp_path, FRAME, parts), 0.3, 2.5), tmp_path)
    want = evidence.scene_cuts(spark.createDataFrame(rows, FRAME), "source", "frame", "histogram", 0.3, 2.5).collect()
    assert sorted((r.source, r.frame, r.cut) for r in got if not r.late) == sorted((r.source, r.frame, r.cut) for r in want)
    assert sorted((r.source, r.frame, r.cut) for r in got if r.late) == [(1, 5, False), (2, 19, False)]
    assert any(r.cut for r in want)


def test_first_frames_and_rates(spark, tmp_path):
    parts = [[(s, f, [0.0]) for f in range(k * 7, k * 7 + 7) for s in (1, 2) if s == 1 or f % 5 == 0] for k in range(4)]
    stream = frames.first_frames(batches(spark, tmp_path, FRAME, parts), 10)
    told = []
    rows, log = frames.logged(stream, "limited", str(tmp_path / "out"), str(tmp_path / "rates"), str(tmp_path / "log"), lambda *x: told.append(x))
    got = sorted(map(tuple, rows.collect()))
    assert got == [(1, f, f + 1) for f in range(10)] + [(2, f * 5, f + 1) for f in range(6)]
    lines = sorted(log.collect(), key=lambda r: r.batch)
    assert [r.n_rows for r in lines if r.n_rows] == [len(p) for p in parts] == [n for _, n, _ in told if n]
    assert {r.stream for r in lines} == {"limited"} and all(r.duration_ms >= 0 for r in lines)
