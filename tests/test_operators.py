"""Hand-built cases of the library's operators, and random cases against short Python versions."""

import bisect
import itertools
import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import geometry, text
from annolith.operators import audit, checks, compare, curation, duplicates, evidence, matching, parse, ranges, review, sampling, sweep, tracking
from annolith.sources import tables
from annolith.streaming import votes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


GT, PRED = "img long, j int, c int, x1 double, y1 double, x2 double, y2 double", "img long, i int, c int, s double, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    size = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    u = size(a) + size(b) - w * h
    return w * h / u if u else 0.0


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(7)
    gt, pred = [], []
    for img in range(60):
        for j in range(rng.randint(0, 6)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            gt.append((img, j, rng.randint(0, 1), float(x), float(y), float(x + rng.randint(4, 10)), float(y + rng.randint(4, 10))))
        for i in range(rng.randint(0, 7)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            near = [g for g in gt if g[0] == img]
            if near and rng.random() < 0.7:
                g = rng.choice(near)
                pred.append((img, i, g[2] if rng.random() < 0.7 else 1 - g[2], rng.randint(0, 20) / 20, g[3] + rng.randint(0, 2), g[4], g[5], g[6] + rng.randint(0, 2)))
            else:
                pred.append((img, i, rng.randint(0, 1), rng.randint(0, 20) / 20, float(x), float(y), float(x + 6), float(y + 6)))
    return gt, pred


def python_match(gt, pred):
    """The rules in words: predictions by falling score take the best free object of their class; leftovers pair across classes by falling (overlap, j, i)."""
    taken, used = {}, set()
    for p in sorted(pred, key=lambda p: (-p[3], p[1])):
        best = max(((overlap(g[3:], p[4:]), -g[1]) for g in gt if g[2] == p[2] and g[1] not in taken), default=(0, 0))
        if best[0] >= 0.5:
            taken[-best[1]] = (p[1], best[0])
            used.add(p[1])
    cross = {}
    for v, j, i in sorted(((overlap(g[3:], p[4:]), g[1], p[1]) for g in gt for p in pred if g[2] != p[2] and g[1] not in taken and p[1] not in used), reverse=True):
        if v >= 0.5 and j not in cross and i not in {x for x, _ in cross.values()}:
            cross[j] = (i, v)
    return taken, cross


def by_image(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_matching_equals_the_rules(spark, boxes):
    gt, pred = boxes
    g, p = frame(spark, gt, GT), frame(spark, pred, PRED)
    got = {(r.img, r.j): (r.outcome, r.i) for r in matching.object_outcomes(g, p).collect()}
    images, predictions = by_image(gt), by_image(pred)
    want = {}
    for img, objects in images.items():
        taken, cross = python_match(objects, predictions[img])
        for o in objects:
            want[img, o[1]] = ("CORRECT", taken[o[1]][0]) if o[1] in taken else ("CLASS_CONFUSION", cross[o[1]][0]) if o[1] in cross else ("MISSED", None)
    assert got == want
    shuffled = matching.object_outcomes(g.repartition(5), p.orderBy(F.rand(1)))
    assert {(r.img, r.j): (r.outcome, r.i) for r in shuffled.collect()} == want


def test_sweep_equals_matching_at_every_threshold(spark, boxes):
    gt, pred = boxes
    got = {(r.scope, r.threshold): (r.tp, r.fp, r.fn) for r in sweep.sweep(frame(spark, gt, GT), frame(spark, pred, PRED)).collect()}
    objects = by_image(gt)
    for t in sorted({p[3] for p in pred}):
        kept = by_image([p for p in pred if p[3] >= t])
        tp = sum(len(python_match(objects[img], kept[img])[0]) for img in objects)
        assert got["Overall", t] == (tp, sum(map(len, kept.values())) - tp, len(gt) - tp)


def test_difficulty_equals_the_rules(spark, boxes):
    gt, pred = boxes
    got = {(r.img, r.j): (r.category, r.duplicates) for r in matching.difficulty(frame(spark, gt, GT), frame(spark, pred, PRED)).collect()}
    objects, predictions = by_image(gt), by_image(pred)
    for img, own in objects.items():
        ps = predictions[img]
        taken, cross = python_match(own, ps)
        score = {p[1]: p[3] for p in ps}
        cat = {j: "EASY_CORRECT" if score[i] >= 0.25 else "LOW_CONFIDENCE_CORRECT" for j, (i, _) in taken.items()} | {j: "CLASS_CONFUSION" for j in cross}
        used = {i for i, _ in [*taken.values(), *cross.values()]}
        for p in sorted(ps, key=lambda p: (-p[3], p[1])):
            options = [(overlap(g[3:], p[4:]), -g[1]) for g in own if g[1] not in cat and g[2] == p[2]] if p[1] not in used else []
            if options and 0.1 <= max(options)[0] < 0.5:
                cat[-max(options)[1]] = "LOCALIZATION_FAILURE"
                used.add(p[1])
        twice = defaultdict(int)
        for p in ps:
            near = [(overlap(g[3:], p[4:]), -g[1]) for g in own if g[1] in taken and g[2] == p[2]]
            if p[1] not in used and p[3] >= 0.25 and near and max(near)[0] >= 0.5:
                twice[-max(near)[1]] += 1
        for g in own:
            best = max((overlap(g[3:], p[4:]) for p in ps if p[2] == g[2]), default=0)
            want = cat.get(g[1], "MATCH_COMPETITION" if best >= 0.1 else "MISSED_NO_CORRECT_CLASS_PROPOSAL")
            assert got[img, g[1]] == (want, twice[g[1]]), (img, g)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        m = n + int(rng.integers(0, 3))
        cost = rng.integers(0, 9, size=(n, m)).astype(float)
        best = min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        cols = matching.assign(cost)
        assert len(set(cols.tolist())) == n and cost[np.arange(n), cols].sum() == best


def test_assignment_by_image_is_optimal(spark, boxes):
    gt, pred = boxes
    got = defaultdict(float)
    for r in matching.hungarian(frame(spark, gt, GT), frame(spark, pred, PRED), -1.0).collect():
        got[r.img] += r.iou
    for img in {g[0] for g in gt} & {p[0] for p in pred}:
        g, p = [x for x in gt if x[0] == img], [x for x in pred if x[0] == img]
        few, many = sorted((g, p), key=len)
        box = lambda x: x[3:] if len(x) == 7 else x[4:]
        if len(many) <= 6:
            assert got[img] == pytest.approx(max(sum(overlap(box(x), box(y)) for x, y in zip(few, order, strict=False)) for order in itertools.permutations(many, len(few))))


def test_parsing_tells_each_failure(spark):
    cases = {
        "0 0.5 0.5 0.1 0.1": (0, []), "0.0 0.5 0.5 0.1 0.1": (0, []), "  1\t0.5 0.5 0.2  0.2 ": (1, []), "0 0.5": (None, ["FIELD_COUNT"]), "0 a 0.5 0.1 0.1": (None, ["NON_NUMERIC"]), "0 1d 0.5 0.1 0.1": (None, ["NON_NUMERIC"]), "0 0x1p3 0.5 0.1 0.1": (None, ["NON_NUMERIC"]),
        "0 nan 0.5 0.1 0.1": (None, ["NON_FINITE"]), "0 inf 0.5 0.1 0.1": (None, ["NON_FINITE"]), "0.5 0.5 0.5 0.1 0.1": (None, ["CLASS_NOT_INTEGER"]), "2 0.5 0.5 0.1 0.1": (None, ["INVALID_CLASS_ID"]), "-1 0.5 0.5 0.1 0.1": (None, ["INVALID_CLASS_ID"]),
        "0 0.5 0.5 0 0.1": (None, ["INVALID_COORDINATES"]), "0 0.5 0.5 1.1 0.1": (None, ["INVALID_COORDINATES"]), "0 0.05 0.5 0.1000001 0.1": (0, []), "0 0.05 0.5 0.2 0.1": (0, ["OUT_OF_BOUNDS"]), "0 0.5 0.5 0.00005 0.1": (0, ["NEAR_ZERO"]), "1_0 0.5 0.5 0.1 0.1": (None, ["INVALID_CLASS_ID"]),
    }
    got = {r.line: (r.class_id, r.issues) for r in parse.parse_lines(frame(spark, [(k,) for k in cases], "line string")).collect()}
    assert got == cases


def test_expressions(spark):
    row = frame(spark, [(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    r = row.select(F.expr(geometry.iou("a", "b")).alias("v"), F.expr(geometry.iou_floored("a", "b")).alias("w"), F.expr(geometry.zoom("4", "5", 1.5)).alias("z")).first()
    assert (r.v, r.w, r.z) == (1 / 7, 1 / 7, 1.5)
    box = geometry.letterbox("400", "300", 640, 640)
    r = spark.range(1).select(*[F.expr(v).alias(k) for k, v in box.items()]).first()
    assert (r.left, r.top, r.width, r.height) == (0, 80, 640, 480)
    names = frame(spark, [("a/b/img.rf.0aF9.jpg",), ("x.rf.zz.png",), ("plain",)], "p string").select(text.source_group(text.stem(F.col("p"))).alias("g")).collect()
    assert [r.g for r in names] == ["img", "x.rf.zz", "plain"]
    import hashlib

    ids = frame(spark, [(json.dumps({"b": 1, "a": "é"}),), (None,)], "t string").select(text.canonical_id("t").alias("i")).collect()
    assert [r.i for r in ids] == [hashlib.sha256(json.dumps({"a": "é", "b": 1}, sort_keys=True).encode()).hexdigest()[:16], None]
    grey = [float((x * 7 + y * 3) % 50) for y in range(32) for x in range(32)]
    h = frame(spark, [(grey,), ([g + 10 for g in grey],), (grey[:5],)], "p array<double>").select(text.perceptual_hash("p").alias("h")).collect()
    assert h[0].h == h[1].h and len(h[0].h) == 16 and int(h[0].h, 16) < 1 << 63 and h[2].h is None


def test_near_pairs_lose_none(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(62) for _ in range(30)]
    rows = [(k, b ^ sum(1 << x for x in rng.sample(range(62), rng.randint(0, 10)))) for k, b in enumerate(base * 4)]
    got = {(r.a, r.b): r.distance for r in duplicates.near_pairs(frame(spark, rows, "key long, hash long"), 8).collect()}
    want = {(a, b): (x ^ y).bit_count() for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 8}
    assert got == want
    parts = {r.key: r.component for r in duplicates.near_components(spark, frame(spark, rows, "key long, hash long"), 8).collect()}
    assert all(parts[a] == parts[b] for a, b in want) and len(parts) == len(rows)


def test_components_of_a_long_chain(spark):
    from annolith.operators.components import components
    from annolith.sources.work import Work

    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in components(frame(spark, edges, "a long, b long"), Work(spark, "chain"), "c").collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}


def test_transition_table():
    got = {(a, b): t for a, b, t in compare.TRANSITIONS}
    assert len(got) == 9 and len(set(got.values())) == 7 and got["MISSED", "MISSED"] == got["CLASS_CONFUSION", "MISSED"] == "STILL_MISSED_BY_B" and got["CLASS_CONFUSION", "CORRECT"] == "A_CLASS_CONFUSION_B_CORRECT"


@pytest.mark.parametrize("seed", range(3))
def test_round_robin_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, float(rng.randint(0, 9))]), float(rng.randint(0, 5))) for k in range(30)]
    rankings = {name: sorted((r for r in rows if r[c] is not None), key=lambda r: (r[c], r[0])) for name, c in (("a", 1), ("b", 2))}
    taken, want, turn = set(), [], 0
    while len(want) < 17:
        turn += 1
        for name, ranking in rankings.items():
            found = next((r[0] for r in ranking if r[0] not in taken), None)
            if found is not None and len(want) < 17:
                taken.add(found)
                want.append((found, name, turn))
    got = review.round_robin(frame(spark, rows, "k long, x double, y double"), "k", {"a": F.col("x"), "b": F.col("y")}, 17)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    two = frame(spark, [("x", 1.0, 1.0), ("y", 2.0, None), ("z", 3.0, None), ("w", None, 2.0)], "k string, p double, q double")
    assert {r.k for r in review.round_robin(two, "k", {"A": F.col("p"), "B": F.col("q")}, 2).collect()} == {"x", "w"}


def test_weighted_draws_take_the_row_of_their_place(spark):
    rng = random.Random(3)
    rows = [(k * 7, rng.choice([1, 1, 2, 50_000])) for k in range(400)]
    total = sum(w for _, w in rows)
    draws = [(k, rng.randrange(total)) for k in range(3000)] + [(3000, 0), (3001, total - 1)]
    ends = list(itertools.accumulate(w for _, w in rows))
    got = {r.draw: r.key for r in sampling.weighted_draw(frame(spark, rows, "k long, w long"), "k", "w", frame(spark, draws, "draw long, u long")).collect()}
    assert got == {d: rows[bisect.bisect_right(ends, u)][0] for d, u in draws}


def test_running_values_by_blocks(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.choice([None, rng.randint(0, 99)])) for k in range(600)]
    blocked = ranges.even_blocks(frame(spark, rows, "k long, g string, v int"), "k", 16)
    last = {r.k: r.out for r in ranges.carried(blocked, ["g"], [F.col("k")], F.col("v"), "out").collect()}
    most = {r.k: r.out for r in ranges.carried(blocked, ["g"], [F.col("k")], F.col("v"), "out", largest=True).collect()}
    back = {r.k: r.out for r in ranges.carried(blocked, ["g"], [F.desc("k")], F.col("v"), "out", down=True).collect()}
    for k, g, _ in rows:
        before = [v for x, h, v in rows if h == g and x <= k and v is not None]
        after = [v for x, h, v in rows if h == g and x >= k and v is not None]
        assert (last[k], most[k], back[k]) == (before[-1] if before else None, max(before, default=None), after[0] if after else None)


def test_skyline_and_median(spark):
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 40, size=(3000, 3)).astype(float), axis=0)
    want = {tuple(p) for p in points if not ((points >= p).all(axis=1) & (points > p).any(axis=1)).any()}
    assert {tuple(points[i]) for i in sweep.skyline(points)} == want
    rows = [("a", float(x)) for x in rng.normal(0, 1e6, 501)] + [("b", float(x)) for x in rng.integers(-3, 3, 40)] + [("c", None), ("d", 0.0)]
    got = {r.g: r.median for r in audit.metric_statistics(frame(spark, rows, "g string, v double"), "g", ["v"]).collect()}
    for g in "abd":
        assert got[g] == np.median([v for h, v in rows if h == g])
    assert got["c"] is None


def test_hash_of_pixels_by_definition(spark):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, size=(32, 32)).astype(float)
    low = np.array([[sum(grey[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for v in range(8)] for u in range(8)]).reshape(-1)
    bits = "".join("1" if k and c > np.median(low[1:]) else "0" for k, c in enumerate(low))
    got = frame(spark, [(grey.reshape(-1).tolist(),)], "p array<double>").select(text.perceptual_hash("p").alias("h")).first().h
    assert got == f"{int(bits, 2):016x}"


def test_repeated_annotations_by_number(spark):
    lines = [(1, 1, "0 0.5 0.5 0.1 0.1"), (1, 2, "0 0.50 0.5 1e-1 .1"), (1, 3, "0 0.5 0.5 0.1 0.2"), (1, 4, "bad"), (1, 5, " bad "), (2, 1, "0 0.5 0.5 0.1 0.1")]
    parsed = parse.parse_lines(frame(spark, lines, "img long, n int, line string"))
    assert {(r.img, r.n) for r in parse.repeated_annotations(parsed, "img", "n").collect()} == {(1, 2), (1, 5)}


def test_streams_keep_state_between_batches(spark, tmp_path):
    """One source in five micro-batches: the numbering and votes are those of one pass."""
    rng = random.Random(11)
    rows = [(1, f"2024-01-01 00:00:{k:02d}", k, rng.randint(0, 3), rng.random() < 0.2, k % 2, rng.random()) for k in range(40)]
    schema = "source long, ts string, event_id long, raw long, cut boolean, c int, p double"
    for k in range(5):
        frame(spark, rows[8 * k : 8 * k + 8], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        (tmp_path / "in" / str(k)).touch()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    for buffer in (None, 3):
        out = votes.scene_tracks(stream, buffer).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log{buffer}").trigger(availableNow=True).start(f"{tmp_path}/out{buffer}")
        out.awaitTermination()
        assert out.lastProgress["batchId"] >= 4
        generation, number, known, want = 0, 1, {}, {}
        for f, (_, _, e, raw, cut, _, _) in enumerate(rows):
            if cut:
                generation, known = generation + 1, {}
            if raw not in known or (buffer is not None and f - known[raw][1] > buffer):
                known[raw] = (number, f)
                number += 1
            known[raw] = (known[raw][0], f)
            want[e] = (generation, known[raw][0])
        assert {r.event_id: (r.generation, r.display_id) for r in spark.read.parquet(f"{tmp_path}/out{buffer}").collect()} == want


def test_votes_keep_state_between_batches(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k % 2, f"2024-01-01 00:00:{k:02d}", k, rng.randint(0, 1), rng.random()) for k in range(40)]
    schema = "track long, ts string, event_id long, c int, p double"
    for k in range(4):
        frame(spark, rows[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", votes.PROVIDER)
    voted = stream.groupBy("track").transformWithStateInPandas(votes.ClassVote(0.7, 0.05), outputStructType="track long, event_id long, shown int", outputMode="append", timeMode="none")
    query = voted.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    want = {r.event_id: r.shown for r in tracking.smoothed_class(frame(spark, rows, schema), "track", ["ts", "event_id"], "c", "p", 0.7, 0.05).collect()}
    assert {r.event_id: r.shown for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and query.lastProgress["batchId"] >= 3


def test_review_and_gates(spark):
    decided = frame(spark, [("r1", "p", "q", "test", "train", "KEEP_B_EXCLUDE_A", ""), ("r2", "q", "s", "train", "train", "KEEP_A_EXCLUDE_B", "seen"), ("r3", "p", "t", "test", "valid", "KEEP_BOTH", ""), ("r4", "u", "v", "valid", "test", "PENDING", "")], "review_id string, a string, b string, split_a string, split_b string, decision string, notes string")
    states = {(r.image, r.state) for r in curation.correction_states(decided).collect()}
    assert states == {("p", "CONFLICT"), ("p", "MISMATCH"), ("p", "NEEDS_REVIEW"), ("s", "NEEDS_REVIEW"), ("u", "NEEDS_REVIEW"), ("v", "NEEDS_REVIEW")}
    assert {r.review_id for r in curation.mismatch_groups(decided).collect()} == {"r1", "r3"}
    images = frame(spark, [(x, "train") for x in "pqstuvz"], "image string, split string")
    manifest = {r.image: r for r in curation.curated_manifest(images, decided).collect()}
    assert [manifest[x].action for x in "pqstuvz"] == ["EXCLUDE", "KEEP", "EXCLUDE", "KEEP", "KEEP", "KEEP", "KEEP"]
    assert manifest["p"].review_id == "r1|r3" and manifest["q"].paired_with == "p|s" and manifest["z"].review_id == ""
    pairs = frame(spark, [("t", "p", "valid", "test"), ("q", "p", "train", "test"), ("q", "s", "train", "train")], "a string, b string, split_a string, split_b string")
    assert {(r.a, r.review_status[:8]) for r in curation.classified_pairs(pairs, decided).collect()} == {("t", "REVIEWED"), ("q", "UNREVIEW")}
    one, two = frame(spark, [(1,), (1,), (2,)], "x int"), frame(spark, [(1,), (3,)], "x int")
    assert {(r.x, r.side, r.times) for r in checks.table_difference(one, two).collect()} == {(1, "ONLY_LEFT", 1), (2, "ONLY_LEFT", 1), (3, "ONLY_RIGHT", 1)}
    gate = {r.name: r.passed for r in checks.gate(spark, {"a": one.where("x = 9"), "b": two}).collect()}
    assert gate == {"a": True, "b": False}


def test_outputs_and_strict_sources(spark, tmp_path):
    df = frame(spark, [(1, "x", 0.5), (2, None, None)], "k long, t string, v double")
    where = f"file://{tmp_path}/table"
    assert tables.publish(spark, df, where, "k").count() == 2
    assert tables.publish(spark, df.where("k = 1"), where, "k").count() == 1  # what stood there is archived
    assert sum("_archive_" in p.name for p in tmp_path.iterdir()) == 1 and not any("_stage_" in p.name for p in tmp_path.iterdir())
    with pytest.raises(FileExistsError):
        tables.prepare_output(spark, where)
    with pytest.raises(Exception, match="not finite"):
        tables.write_json_report(df.withColumn("v", F.lit(float("nan"))), f"{tmp_path}/bad.json")
    metrics = frame(spark, [(1, 0.25), (0, 0.75)], "class_id int, recall double")
    tables.write_metrics(frame(spark, [(0.5,)], "recall double"), metrics, f"{tmp_path}/m", ["recall"])
    assert [(r.scope, r.recall) for r in spark.read.csv(f"{tmp_path}/m/metrics.csv", header=True).collect()] == [("overall", "0.5"), ("class", "0.75"), ("class", "0.25")]
    images, lines = frame(spark, [(1,), (2,)], "img long"), frame(spark, [(1, "1 0.5 0.5 0.1 0.1"), (1, "")], "img long, line string")
    assert {(r.img, r.n0, r.n1) for r in tables.train_inventory(images, lines, "img").collect()} == {(1, 0, 1), (2, 0, 0)}
    for bad in ("1.0 0.5 0.5 0.1 0.1", "0 0.5 0.5 0 0.1", "0 nan 0.5 0.1 0.1", "0 0.5"):
        with pytest.raises(Exception, match="invalid annotation"):
            tables.train_inventory(images, frame(spark, [(1, bad)], "img long, line string"), "img").collect()
    parsed = parse.parse_lines(frame(spark, [(1, "0 0.5 0.5 0.5 0.5", 100, 200)], "img long, line string, width int, height int"))
    r = tables.pixel_boxes(parsed, "img").first()
    assert (r.x1, r.y1, r.x2, r.y2) == (25, 50, 75, 150)
    assert tables.evidence_by_image(lines, "img").first().evidence[0].line == ""
    assert evidence.lost_buffer("a", "b") is not None and spark.sql("select 2.5D as a, 1D as b").select(evidence.lost_buffer("a", "b").alias("n")).first().n == 2


def test_review_flow(spark):
    queue = frame(spark, [("a", "P0"), ("b", "P0"), ("c", "P1")], "review_id string, priority string")
    decisions = frame(spark, [("a", "KEEP_BOTH"), ("a", "KEEP_BOTH"), ("x", "PENDING"), ("b", "NO")], "review_id string, decision string")
    got = sorted(map(tuple, review.validate_decisions(queue, decisions).collect()))
    assert got == [("a", "DUPLICATE"), ("b", "INVALID_DECISION"), ("c", "MISSING"), ("x", "UNKNOWN_CASE")]
    pairs = frame(spark, [("p", "q", "KEEP_A_EXCLUDE_B"), ("q", "r", "KEEP_A_EXCLUDE_B"), ("s", "t", "KEEP_BOTH")], "a string, b string, decision string")
    acts = {r.image: r.action for r in review.image_actions(pairs).collect()}
    assert acts == {"p": "KEEP", "q": "CONFLICT", "r": "EXCLUDE", "s": "KEEP", "t": "KEEP"}
    log = frame(spark, [("a", "PENDING", 1), ("a", "KEEP_BOTH", 5), ("a", "PENDING", 3)], "review_id string, decision string, ts long")
    assert review.latest_decisions(log).first().decision == "KEEP_BOTH"


def test_policy_ties_and_pareto(spark):
    schema = "model string, threshold double, t_tp long, t_fp long, t_fn long, t_precision double, t_recall double, t_fp_per_image double, o_tp long, o_fp long, o_fn long, o_precision double, o_recall double, o_fp_per_image double"
    point = lambda t, r, p, of, tf: ("A", t, 5, tf, 5, p, r, 0.5, 5, of, 5, p, r, 0.5)
    rows = [point(0.1, 0.5, 0.8, 9, 4), point(0.2, 0.5, 0.8, 9, 4), point(0.3, 0.5, 0.8, 10, 1), point(0.4, 0.9, 0.7, 1, 1)]
    for order in itertools.permutations(rows):
        assert sweep.select_policy(frame(spark, list(order), schema), 0.8, 0.5, 0.5).first().threshold == 0.2
        break
    assert sweep.select_policy(frame(spark, rows, schema), 0.95, 0.5, 0.5).collect() == []
    pts = frame(spark, [(1, 1, 1), (1, 1, 2), (2, 0, 3), (0, 0, 4)], "x int, y int, k int")
    assert sorted((r.x, r.y, r.k, r.n_equal) for r in sweep.pareto(pts, ["x", "y"], "k").collect()) == [(1, 1, 2, 2), (2, 0, 3, 1)]


def test_smoothed_class(spark):
    shown = [0, 0, 0, 1, 0, 1, 1, 1, 1]
    rows = frame(spark, [(1, k, c, 0.8) for k, c in enumerate(shown)], "track long, f int, c int, p double")
    got = [r.shown for r in sorted(tracking.smoothed_class(rows, "track", ["f"], "c", "p", 0.7, 0.05).collect(), key=lambda r: r.f)]
    v, s, want = [0.0, 0.0], 0, []
    for c in shown:
        v = [0.7 * x + 0.3 * (0.8 if k == c else 0) for k, x in enumerate(v)]
        b = 1 if v[1] > v[0] else 0
        s = b if b != s and v[b] > v[s] + 0.05 else s
        want.append(s)
    assert got == want and want[3] == 0 and want[-1] == 1


def test_display_ids_are_never_used_again(spark):
    rows = frame(spark, [("s", 1, 1, False), ("s", 2, 1, True), ("s", 3, 1, False), ("s", 4, 2, False)], "source string, f int, raw int, cut boolean")
    out = tracking.display_ids(tracking.generations(rows, "source", ["f"], "cut"), "source", ["f"], "raw")
    assert [r.display_id for r in sorted(out.collect(), key=lambda r: r.f)] == [1, 2, 2, 3]


def test_early_stopping_and_summary(spark):
    rows = frame(spark, [("z", k, 0.0) for k in (1, 2, 3)] + [("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7)], "run string, epoch int, v double")
    got = {r.run: (r.best_fitness, r.best_epoch, r.stop) for r in tracking.early_stopping(rows, "run", "epoch", "v", 1).collect()}
    assert got == {"z": (0.0, 3, False), "r": (0.7, 2, True)}
    assert {r.run: r.best for r in tracking.curve_summary(rows, "run", "epoch", "v").collect()} == {"z": 1, "r": 2}


GT_ROWS = "img long, scene long, j int, object long, c int, x1 double, y1 double, x2 double, y2 double"
OUT_ROWS = "img long, i int, track long, c int, s double, x1 double, y1 double, x2 double, y2 double"


def tracking_score(gt, out, target=1):
    """The scores frame by frame, from the definitions; every assignment is tried."""
    n = {k: 0 for k in ("matched", "switch", "transfer", "scene", "flip", "right", "shown")}
    last_id, last_class, last_object, ids, spans = {}, {}, {}, defaultdict(set), defaultdict(set)
    for f in sorted({g[0] for g in gt}):
        g, o = [x for x in gt if x[0] == f], [x for x in out if x[0] == f]
        best = (-1.0, [])
        for order in itertools.permutations([*range(len(o)), *[None] * len(g)], len(g)):
            pairs = [(a, o[k], overlap(a[5:], o[k][5:])) for a, k in zip(g, order, strict=True) if k is not None]
            tie = sum(1e-9 * (a[2] / (a[2] + 1)) * (b[1] / (b[1] + 1)) for a, b, v in pairs if v > 0)
            best = max(best, (sum(p[2] for p in pairs) + tie, pairs), key=lambda x: x[0])
        for a, b, v in sorted(best[1], key=lambda p: p[0][2]):
            if v < 0.5:
                continue
            key, track = (a[1], a[3]), b[2]
            n["matched"] += 1
            if track is not None:
                n["switch"] += last_id.get(key, track) != track
                n["transfer"] += last_object.get(track, key) != key
                n["scene"] += last_object.get(track, key)[0] != key[0]
                last_id[key], last_object[track] = track, key
                ids[key].add(track)
                spans[track].add(key)
            n["flip"] += last_class.get(key, b[3]) != b[3]
            last_class[key] = b[3]
            n["right"] += a[4] == b[3]
            n["shown"] += a[4] == target == b[3]
    tracked = any(o[2] is not None for o in out)
    missed, extra = len(gt) - n["matched"], len(out) - n["matched"]
    of = lambda a, b: a / b if b else 0.0
    told = (n["switch"], n["transfer"], n["scene"], sum(len(x) > 1 for x in spans.values()), sum(map(len, ids.values())) / len(ids) if ids else None) if tracked else (None,) * 5
    return (tracked, len(gt), len({(g[1], g[3]) for g in gt}), len(out), n["matched"], extra, *told, n["flip"], of(n["matched"], len(gt)), of(n["matched"], len(out)), of(n["right"], n["matched"]), of(n["shown"], sum(g[4] == target for g in gt)), 1 - (missed + extra + (n["switch"] if tracked else 0)) / len(gt) if gt else None)


def test_tracking_counts(spark):
    # One object whose track is 5, unknown, 7: the unknown one is looked over, so that is one switch.
    gt = [(f, 0, 0, 7, 0, 0.0, 0.0, 10.0, 10.0) for f in range(3)] + [(3, 1, 0, 7, 0, 0.0, 0.0, 10.0, 10.0)]
    out = [(0, 0, 5, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, None, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 7, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (3, 0, 7, 0, 0.9, 0.0, 0.0, 10.0, 10.0)]
    r = tracking.tracking_metrics(frame(spark, gt, GT_ROWS), frame(spark, out, OUT_ROWS)).first()
    assert (r.matched, r.id_switches, r.id_transfers, r.scene_id_transfers, r.class_flips, r.ids_spanning_objects) == (4, 1, 1, 1, 2, 1)
    rng = random.Random(12)
    for k in range(6):
        gt, out = [], []
        for f in range(12):
            for j in range(rng.randint(0, 3)):
                x, y = rng.randint(0, 12), rng.randint(0, 12)
                gt.append((f, f // 5, j, rng.randint(0, 1) * 10 + j, rng.randint(0, 1), float(x), float(y), float(x + 10), float(y + 10)))
            for i in range(rng.randint(0, 4)):
                x, y = rng.randint(0, 12), rng.randint(0, 12)
                out.append((f, i, rng.choice([None, 1, 2, 3]) if k else None, rng.randint(0, 1), 0.5, float(x), float(y), float(x + 10), float(y + 10)))
        got = tracking.tracking_metrics(frame(spark, gt, GT_ROWS), frame(spark, out, OUT_ROWS)).first()
        assert tuple(got) == pytest.approx(tracking_score(gt, out))
    empty = tracking.tracking_metrics(frame(spark, [], GT_ROWS), frame(spark, [], OUT_ROWS)).first()
    assert (empty.matched, empty.recall, empty.mota, empty.tracked, empty.id_switches) == (0, 0.0, None, False, None)


def test_unequal_frames_are_an_error(spark):
    gt, out = frame(spark, [], GT_ROWS), frame(spark, [], OUT_ROWS)
    frames = spark.range(4).toDF("img"), spark.range(1, 6).toDF("img")
    assert sorted(map(tuple, tracking.frame_violations(*frames).collect())) == [(0, "ONLY_TRUTH"), (4, "ONLY_OUTPUT"), (5, "ONLY_OUTPUT")]
    with pytest.raises(ValueError, match="different frames"):
        tracking.tracking_metrics(gt, out, frames=frames)


def test_sampling_weights(spark):
    rows = frame(spark, [(k, 3 if k == 0 else 0) for k in range(100)], "img long, tier int")
    w = {r.img: r.weight for r in sampling.tier_weights(rows).collect()}
    assert w[0] == 2.0 and w[1] == 1.0
    s = sampling.plan_statistics(sampling.tier_weights(rows)).first()
    assert s.n == 100 and s.risk == "PASS"
    assert {r.weight for r in sampling.tier_weights(rows.where("tier = 0")).collect()} == {1.0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf0 0.5 0.5 0.1 0.1\r\n\n1 0.5 0.5 0.2 0.2\x0c0 1")
    got = sorted((r.line_number, r.line) for r in tables.label_lines(spark, str(tmp_path)).collect())
    assert got == [(1, "0 0.5 0.5 0.1 0.1"), (3, "1 0.5 0.5 0.2 0.2"), (4, "0 1")]
    folder = tmp_path / "cases"
    folder.mkdir()
    (folder / "c.json").write_text(json.dumps([{"image": "i", "width": 10, "height": 10, "ground_truth": [{"class_id": 1, "bbox": [0, 0, 4, 4]}], "predictions": [{"class_id": 1, "confidence": 0.9, "bbox": [0, 0, 4, 4]}]}]))
    gt, pred = tables.case_boxes(tables.json_cases(spark, str(folder)))
    assert [r.outcome for r in matching.object_outcomes(gt, pred).collect()] == ["CORRECT"]
    where = tables.write_version(gt, str(tmp_path), "v1")
    assert spark.read.parquet(where).count() == 1
    with pytest.raises(Exception, match="already exists"):
        tables.write_version(gt, str(tmp_path), "v1")
    config = tmp_path / "d.yaml"
    config.write_text("path: p\ntrain: a\nval: b\ntest: c\nnc: 2\nnames: {0: x, 1: y}\n")
    assert tables.dataset_config(str(config)).names == {0: "x", 1: "y"}
    config.write_text("path: p\n")
    with pytest.raises(ValueError):
        tables.dataset_config(str(config))
    with pytest.raises(PermissionError):
        tables.require_split("test", ("train",))


def test_snapshot_difference(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "key long, sha string"), frame(spark, [(2, "z"), (3, "w")], "key long, sha string")
    assert sorted(map(tuple, audit.snapshot_difference(a, b).collect())) == [(1, "REMOVED"), (2, "CHANGED"), (3, "ADDED")]
