"""Draws, plans, overlaps, nearest hashes and cosine hashes against short Python versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.functions import text
from annolith.operators import curation, draws


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def test_uniforms_depend_on_seed_epoch_and_number_alone(spark):
    one = {r.id: r.u for r in spark.range(0, 500, 1, 1).withColumn("u", draws.uniform(7, 2, F.col("id"))).collect()}
    many = {r.id: r.u for r in spark.range(0, 500, 1, 9).withColumn("u", draws.uniform(7, 2, F.col("id"))).collect()}
    assert one == many == {k: int(md5(f"7:2:{k}")[:13], 16) / 2**52 for k in range(500)}
    assert 0.45 < sum(one.values()) / 500 < 0.55
    assert one != {r.id: r.u for r in spark.range(500).withColumn("u", draws.uniform(7, 3, F.col("id"))).collect()}


def test_samples(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 3 else "big", rng.randint(0, 400)) for k in range(3000)] + [("few", 1), ("few", 2), (None, 5)]
    members = spark.createDataFrame(rows, "category string, key long").repartition(5)
    got = draws.category_sample(members, "category", "key", 10, 4)
    want = {(c, k, n + 1) for c in {c for c, _ in rows} for n, k in enumerate(sorted({k for x, k in rows if x == c}, key=lambda k: (md5(f"4:{c}:{k}") if c else md5(f"4:{k}"), k))[:10])}
    assert set(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # ranks beyond the tenth go before the shuffle and after it
    groups = spark.createDataFrame([(f"g{g}", g * 10 + k) for g in range(20) for k in range(g % 5)], "g string, key long")
    sizes, out, used = {f"g{g}": [g * 10 + k for k in range(g % 5)][:3] for g in range(20)}, [], 0
    for g in sorted(sizes, key=lambda g: (md5(f"4:{g}"), g)):
        if len(sizes[g]) > 1 and 8 - used >= 2:
            for x in sizes[g][: 8 - used]:
                used += 1
                out.append((g, x, used))
    assert sorted(map(tuple, draws.group_sample(groups, "g", "key", 8, 4).collect())) == sorted(out)
    pairs = spark.createDataFrame([(a, a + 1, a % 7 == 0) for a in range(40)], "a long, b long, cross_split boolean")
    taken = [(r.a, r.cross_split) for r in draws.pair_sample(pairs, 8, 4).collect()]
    assert taken == [(a, a % 7 == 0) for a in sorted(range(40), key=lambda a: (a % 7 != 0, md5(f"4:{a}:{a + 1}")))[:8]]
    assert [r.id for r in draws.shuffled(spark.range(50), "id", 5, 4).orderBy("place").collect()] == sorted(range(50), key=lambda k: md5(f"4:{k}"))[:5]


def plan(rows, excluded, seed):
    n, severity = len(rows), sum(t for i, t, *_ in rows if i not in excluded)
    step = min(0.1 * n / severity, 1 / 3) if severity else 0.0
    w = {i: 1.0 + (0 if i in excluded else t) * step for i, t, *_ in rows}
    total, fixed, upto = sum(w.values()), {}, 0
    for i in sorted(w):
        upto += max(1, round(w[i] * draws.UNIT))
        fixed[i] = upto
    drawn = Counter()
    for k in range(n):
        u = min(upto - 1, math.floor(int(md5(f"{seed}:0:{k}")[:13], 16) / 2**52 * upto))
        drawn[next(i for i in sorted(fixed) if fixed[i] > u)] += 1
    return {i: (i not in excluded, w[i], w[i] / total, w[i] / total * n, drawn[i]) for i in w}


@pytest.mark.parametrize("hard", [0.0, 0.02, 0.5])
def test_plans(spark, hard):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 3) if rng.random() < hard else 0, rng.randint(0, 3), rng.randint(0, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "img long, tier int, n0 int, n1 int")
    excluded = {i for i, *_ in rows if i % 9 == 1}
    images = draws.plan_images(df, "img", 11, spark.createDataFrame([(i,) for i in excluded], "img long")).cache()
    want = plan(rows, excluded, 11)
    got = {r.img: (r.eligible, r.weight, r.probability, r.expected, r.drawn) for r in images.collect()}
    assert {i: v[0::4] for i, v in got.items()} == {i: v[0::4] for i, v in want.items()}
    assert all(got[i][1:4] == pytest.approx(want[i][1:4]) for i in want)
    tiers = draws.plan_tiers(images)
    by_tier = {r.tier: r for r in tiers.collect()}
    assert sorted(by_tier) == [0, 1, 2, 3] and sum(r.n for r in by_tier.values()) == sum(r.drawn for r in by_tier.values()) == 200
    s = draws.plan_summary(images, tiers).first()
    p = [v[2] for v in want.values()]
    assert (s.n, s.max_drawn, s.unique_drawn, s.excluded) == (200, max(v[4] for v in want.values()), sum(v[4] > 0 for v in want.values()), len(excluded))
    assert (s.expected_unique, s.effective_size, s.max_expected) == pytest.approx((sum(1 - (1 - x) ** 200 for x in p), 1 / sum(x * x for x in p), 200 * max(p)))
    assert s.n1_expected == pytest.approx(sum(r[3] * want[r[0]][3] for r in rows)) and s.risk == "PASS"
    again = draws.plan_images(df, "img", 11, spark.createDataFrame([(i,) for i in excluded], "img long"))
    assert draws.plan_differences(images, again, "img").isEmpty()
    changed = images.where("img <> 3").withColumn("weight", F.expr("if(img = 4, weight + 0.001, weight)"))
    assert {(r.img, r.column) for r in draws.plan_differences(changed, again, "img").collect()} == {(3, None), (4, "weight")}


def test_risk_of_a_small_tier(spark):
    images = spark.createDataFrame([(i, 3 if i < 2 else 0, 1, 1, True, 1.0, 0.15 if i < 2 else 0.7 / 98, 1.0, 1) for i in range(100)], "img long, tier int, n0 int, n1 int, eligible boolean, weight double, probability double, expected double, drawn long")
    assert draws.plan_summary(images, draws.plan_tiers(images)).first().risk == "FAIL"


def test_overlaps(spark):
    rng = random.Random(3)
    rows = [tuple(rng.random() < 0.4 for _ in range(3)) for _ in range(300)] + [(None, True, False)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    got = {r.combination: (r.exact, r.at_least) for r in draws.overlap_counts(df, {x: F.col(x) for x in "abc"}).collect()}
    assert len(got) == 8
    for m in range(8):
        names = [x for k, x in enumerate("abc") if m >> k & 1]
        has = [{x for x, v in zip("abc", r, strict=True) if v} for r in rows]
        assert got["+".join(names) or "none"] == (sum(h == set(names) for h in has), sum(h >= set(names) for h in has))
    assert draws.overlap_counts(df.limit(0), {"a": F.col("a")}).count() == 2
    with pytest.raises(ValueError):
        draws.overlap_counts(df, {str(k): F.lit(True) for k in range(11)})


def test_least_distances_in_groups_of_any_size(spark):
    rng = np.random.default_rng(7)
    far = rng.integers(-(1 << 63), 1 << 63, 5000)
    close = (rng.integers(0, 1 << 20, 1001).astype(np.int64) << 30) ^ 5
    groups = {"far": far, "cap": rng.integers(-(1 << 63), 1 << 63, 1001), "close": np.unique(close), "copies": np.concatenate([far[:700], far[:1]]), "two": np.array([0, -1]), "one": far[:1], "apart": np.array([0, (1 << 40) - 1, -1 ^ ((1 << 20) - 1), 0x5555555555555555])}
    rows = [(g, k, int(h)) for g, hashes in groups.items() for k, h in enumerate(hashes)]
    members = spark.createDataFrame(rows, "g string, key long, hash long").repartition(4)
    want = {}
    for g, h in groups.items():
        if len(h) > 1:
            h, least = h.astype(np.uint64), 64
            for k in range(1, len(h)):
                least = min(least, int(np.bitwise_count(h[k:] ^ h[:-k]).min()))
            want[g] = (len(h), len(h) * (len(h) - 1) // 2, least)
    for most in (512, 1):
        use = members if most > 1 else members.where("g in ('two', 'apart', 'cap', 'copies')")
        got = {r.g: (r.n, r.n_pairs, r.least_distance) for r in curation.least_distances(spark, use, "g", "key", "hash", most).collect()}
        assert got == {g: v for g, v in want.items() if most > 1 or g in ("two", "apart", "cap", "copies")}


def test_cosine_hash_is_the_batched_one(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, 1024).astype(float).tolist() for _ in range(20)] + [[float((x * 7 + y * y) % 251) for x in range(32) for y in range(32)], [1.0] * 10]
    df = spark.createDataFrame([(x,) for x in images], "grey array<double>").select(text.cosine_hash(F.col("grey")).alias("a"), text.perceptual_hash("grey").alias("b"))
    rows = df.collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[-1].a is None and len(set(rows)) > 15
