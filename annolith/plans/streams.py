"""Named queries over streams of frames and detections, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.plans.registry import query
from annolith.sources.work import Work
from annolith.streaming import frames, tracker, votes

#: Four objects that drift through the frames (events) of each source (user), each missing in every fifth frame; some frames are cuts.
_DETECTIONS = (
    "user_id as source, event_id as frame, ts, i, ((event_id * 7 + i * 31) % 100) / 100 as s, cast((user_id * 37 + i * 61) % 300 + (event_id * (1 + i % 2) - event_id * (1 + i % 2) % 50) / 50 as double) as x1,"
    " cast((user_id * 53 + i * 29) % 200 + event_id % 4 as double) as y1, cast((user_id * 37 + i * 61) % 300 + (event_id * (1 + i % 2) - event_id * (1 + i % 2) % 50) / 50 + 40 + event_id % 3 as double) as x2,"
    " cast((user_id * 53 + i * 29) % 200 + event_id % 4 + 30 as double) as y2, event_type = 'error' and event_id % 7 = 0 as cut"
)
_SEEN = "(event_id + i * 3) % 5 <> 0"
CONFIG = tracker.TrackerConfig(high=0.4, low=0.15, new=0.5, overlap=0.2, weak_overlap=0.5, buffer_seconds=72_000.0)
LEAST_CORRELATION, MOST_DIFFERENCE, FIRST = -0.4, 4.5, 20


def _detections(spark, sf_dir):
    rows = votes._events(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return rows.where(_SEEN).selectExpr(*_split(_DETECTIONS))


def _split(columns: str) -> list[str]:
    """At commas outside parentheses."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:k].strip())
            at = k + 1
    return [*out, columns[at:].strip()]


@query
def stream_tracks(spark, sf_dir):
    """Detections to tracks, with the ends of tracks."""
    return votes._run(tracker.associate(_detections(spark, sf_dir), CONFIG), Work(spark, "tracks"), "tracks", "append").drop("ts")


@query
def stream_lost_tracks(spark, sf_dir):
    """Every time a raw id of a source was not seen for longer than 20 hours: an event-time session that the watermark has closed."""
    rows = votes._events(spark, sf_dir).selectExpr("user_id as source", "event_id % 5 as raw", "ts").withWatermark("ts", "10 minutes")
    gap = f"{round(CONFIG.buffer_seconds * 1_000_000) + 1} microseconds"  # a sight exactly 20 hours later still belongs to the track
    lost = rows.groupBy(F.session_window("ts", gap), "source", "raw").agg(F.count("*").alias("seen"))
    out = lost.select("source", "raw", "seen", F.col("session_window.start").alias("first_seen"), (F.col("session_window.end") - F.expr(f"interval {gap}")).alias("last_seen"))
    return votes._run(out, Work(spark, "lost"), "lost", "append")


@query
def stream_buffered_ids(spark, sf_dir, buffer: int = 12):
    """Display ids where a track unseen for more than ``buffer`` frames is another one when it comes back."""
    rows = votes._events(spark, sf_dir).select(F.col("user_id").alias("source"), "ts", "event_id", (F.col("event_id") % 5).alias("raw"), (F.col("event_type") == "error").alias("cut"))
    return votes._run(votes.scene_tracks(rows, buffer), Work(spark, "buffered"), "buffered", "append")


def _frames(spark, sf_dir):
    histogram = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.col("event_id") * (k + 3) + F.col("user_id") * k) % 11).cast("double"))
    return votes._events(spark, sf_dir).select(F.col("user_id").alias("source"), F.col("event_id").alias("frame"), histogram.alias("histogram"))


@query
def stream_scene_cuts(spark, sf_dir):
    """Frames that a stream tells to be cuts."""
    return votes._run(frames.scene_cuts(_frames(spark, sf_dir), LEAST_CORRELATION, MOST_DIFFERENCE), Work(spark, "cuts"), "cuts", "append")


@query
def stream_first_frames(spark, sf_dir):
    """The first frames of each source."""
    return votes._run(frames.first_frames(_frames(spark, sf_dir), FIRST), Work(spark, "first"), "first", "append")


@query
def stream_rates(spark, sf_dir):
    """What the log of a stream's rates holds: rows read in all, and whether every batch has its number, time and a rate."""
    work = Work(spark, "rates")
    _, log = frames.logged(_frames(spark, sf_dir).select("source", "frame"), "frames", f"{work.path}/rows", f"{work.path}/log", f"{work.path}/state")
    return log.groupBy("stream").agg(F.sum("n_rows").alias("n_rows"), F.bool_and(F.expr("batch is not null and at is not null and rows_per_second >= 0")).alias("complete"))


def _overlap(a: str, b: str) -> str:
    inner = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0::double) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0::double))"
    return f"({inner} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inner}))"


def _pairs(tracks: str, boxes: str, least: float) -> str:
    """Lists ts and js of the pairs of tracks and boxes taken in order."""
    none = "'ts': []::bigint[], 'js': []::bigint[]"
    found = f"flatten([[{{'o': -{_overlap('x', 'y')}, 't': x.t, 'j': y.j, {none}}} for y in {boxes}] for x in {tracks}])"
    fold = f"lambda a, e: case when list_contains(a.ts, e.t) or list_contains(a.js, e.j) then a else {{'o': 0.0::double, 't': 0::bigint, 'j': 0::bigint, 'ts': list_append(a.ts, e.t), 'js': list_append(a.js, e.j)}} end"
    return f"list_reduce(list_sort(list_filter({found}, lambda e: -e.o >= {least} and e.o < 0)), {fold}, {{'o': 0.0::double, 't': 0::bigint, 'j': 0::bigint, {none}}})"


_BOX = "x1 double, y1 double, x2 double, y2 double"
_US = round(CONFIG.buffer_seconds * 1e6)
_TRACKS = f"""with recursive det as (select {_DETECTIONS} from events, (select unnest(range(0, 4)) as i) q where {_SEEN}),
 f as (select source, ts, frame, bool_or(cut) as cut, list({{'j': i::bigint, 's': s, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by i) as d, row_number() over (partition by source order by ts, frame) as k from det group by source, ts, frame),
 t(source, k, tracks, number, told) as (
 select distinct source, 0::bigint, []::struct(t bigint, {_BOX}, us bigint, frame bigint, k bigint, seen bigint)[], 1::bigint, []::struct(event varchar, track bigint, frame bigint, i bigint, seen bigint)[] from f union all
 select source, k, list_concat(list_filter(op, lambda x: not list_contains(al.ts, x.t)), [{{'t': al.ts[w.q], 'x1': w.b.x1, 'y1': w.b.y1, 'x2': w.b.x2, 'y2': w.b.y2, 'us': us, 'frame': frame, 'k': k, 'seen': w.n}} for w in z]),
  number + len(fresh), list_concat(list_concat([{{'event': 'cut', 'track': x.t, 'frame': x.frame, 'i': null::bigint, 'seen': x.seen}} for x in ended], [{{'event': 'lost', 'track': x.t, 'frame': x.frame, 'i': null::bigint, 'seen': x.seen}} for x in gone]),
  [{{'event': 'seen', 'track': al.ts[w.q], 'frame': frame, 'i': al.js[w.q], 'seen': w.n}} for w in z])
 from (select *, [{{'b': list_filter(d, lambda y: y.j = al.js[q])[1], 'n': coalesce(list_filter(op, lambda x: x.t = al.ts[q])[1].seen, 0) + 1, 'q': q}} for q in range(1, len(al.ts) + 1)] as z
 from (select *, {{'ts': list_concat(list_concat(m1.ts, m2.ts), [number + q for q in range(0, len(fresh))]), 'js': list_concat(list_concat(m1.js, m2.js), [y.j for y in fresh])}} as al
 from (select *, list_filter(d, lambda y: y.s >= {CONFIG.new} and not list_contains(m1.js, y.j) and not list_contains(m2.js, y.j)) as fresh
 from (select *, {_pairs('rest', 'weak', CONFIG.weak_overlap)} as m2
 from (select *, list_filter(op, lambda x: not list_contains(m1.ts, x.t) and x.k = k - 1) as rest, list_filter(d, lambda y: y.s >= {CONFIG.low} and y.s < {CONFIG.high}) as weak
 from (select *, {_pairs('op', 'strong', CONFIG.overlap)} as m1
 from (select *, list_filter(tr, lambda x: us - x.us <= {_US}) as op, list_filter(tr, lambda x: us - x.us > {_US}) as gone, list_filter(d, lambda y: y.s >= {CONFIG.high}) as strong
 from (select f.source, f.k, f.frame, epoch_us(f.ts) as us, f.d, t.number, case when f.cut then [] else t.tracks end as tr, case when f.cut then t.tracks else [] end as ended from t join f on f.source = t.source and f.k = t.k + 1) a0) a1) a2) a3) a4) a5) a6) a7),
 e as (select source, unnest(told) as x from t union all
 select source, {{'event': 'lost', 'track': x.t, 'frame': x.frame, 'i': null::bigint, 'seen': x.seen}} from (select source, unnest(arg_max(tracks, k)) as x from t group by 1) q where (x.us + {_US}) // 1000 + 1 <= (select epoch_ms(max(ts)) - 600000 from det))
 select source, x.event as event, x.track as track, x.frame as frame, x.i as i, x.seen as seen from e"""

_EVENTS = "select user_id as source, ts, event_id, event_id % 5 as raw, event_type = 'error' as cut from events"
ORACLES = {
    "stream_tracks": _TRACKS,
    "stream_lost_tracks": f"""with e as (select source, raw, ts, epoch_us(ts) - lag(epoch_us(ts)) over w > {_US} as new from ({_EVENTS}) q window w as (partition by source, raw order by ts)),
 s as (select *, sum(coalesce(new, true)::int) over (partition by source, raw order by ts rows unbounded preceding) as k from e)
 select source, raw, count(*) as seen, min(ts) as first_seen, max(ts) as last_seen from s group by source, raw, k having epoch_us(max(ts)) + {_US} + 1 <= (select epoch_us(max(ts)) - 600000000 from events)""",
    "stream_buffered_ids": f"""with e as (select *, row_number() over (partition by source order by ts, event_id) as frame, sum(cut::int) over (partition by source order by ts, event_id rows unbounded preceding)::bigint as generation from ({_EVENTS}) q),
 s as (select *, coalesce(frame - lag(frame) over (partition by source, generation, raw order by frame) > 12, true) as new from e),
 n as (select *, sum(new::int) over (partition by source order by frame rows unbounded preceding) as number from s)
 select source, event_id, generation, max(number) filter (new) over (partition by source, generation, raw order by frame rows unbounded preceding)::bigint as display_id from n""",
    "stream_first_frames": f"select * from (select user_id as source, event_id as frame, row_number() over (partition by user_id order by event_id) as number from events) q where number <= {FIRST}",
    "stream_rates": "select 'frames' as stream, count(*) as n_rows, true as complete from events",
    "stream_scene_cuts": f"""with f as (select user_id, event_id, [((event_id * (k + 3) + user_id * k) % 11)::double for k in range(0, 8)] as h from events), l as (select *, lag(h) over (partition by user_id order by event_id) as b from f),
 m as (select *, list_avg(h) as mx, list_avg(b) as my from l), s as (select *, list_sum([(h[k] - mx) * (b[k] - my) for k in range(1, 9)]) as xy, list_sum([(x - mx) * (x - mx) for x in h]) as xx, list_sum([(x - my) * (x - my) for x in b]) as yy, list_sum([abs(h[k] - b[k]) for k in range(1, 9)]) / 8 as gap from m)
 select user_id as source, event_id as frame, b is not null and (case when xx * yy = 0 then (case when h = b then 1 else 0 end) else xy / sqrt(xx * yy) end < {LEAST_CORRELATION} or gap > {MOST_DIFFERENCE}) as cut, false as late from s""",
}
