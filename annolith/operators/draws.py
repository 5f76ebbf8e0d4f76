"""Draws that depend on a seed and on names or numbers alone: bounded samples, weighted epochs, sampling plans and their recomputation.

The order of a draw is the MD5 of ``seed:name``, a uniform number the first 52 bits of the MD5 of ``seed:epoch:number``.  Both are column
expressions: no row depends on its neighbours, on partitions or on how often a task runs.  Top-k samples are windows with a limit on the
rank, which Spark cuts to k rows for each group in every task before it shuffles, so no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.operators.sampling import weighted_draw
from annolith.sources.work import Work

#: Weights are cut to multiples of this for draws, so that cumulative weights are exact.
UNIT = 1_000_000


def drawn(seed: int, *name: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[n.cast("string") for n in name]))


def uniform(seed: int, epoch: int, number: Column) -> Column:
    """In [0, 1), a multiple of 2**-52."""
    return F.conv(F.substring(drawn(seed, F.lit(epoch), number), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def category_sample(members: DataFrame, category: str, key: str, k: int, seed: int) -> DataFrame:
    """category, key, place: k distinct keys of each category (all, where there are fewer) in drawn order."""
    w = Window.partitionBy(category).orderBy(drawn(seed, F.col(category), F.col(key)), key)
    return members.select(category, key).distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def group_sample(members: DataFrame, group: str, key: str, limit: int, seed: int, each: int = 3) -> DataFrame:
    """group, key, place of up to ``each`` members (by key) of drawn groups of two and more, ``limit`` in all; a group gets no place if not two are left.

    Every group takes two places at least, so the first limit / 2 groups are all that can be chosen.
    """
    w = Window.partitionBy(group).orderBy(key)
    firsts = members.select(group, key).distinct().withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= each)
    groups = firsts.groupBy(group).agg(F.count("*").alias("size_")).where("size_ > 1").withColumn("o_", drawn(seed, F.col(group)))
    chosen = groups.orderBy("o_", group).limit(-(-limit // 2))
    before = F.coalesce(F.sum("size_").over(Window.orderBy("o_", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # limit / 2 rows
    room = chosen.withColumn("before_", before).where(limit - F.col("before_") >= 2).select(F.col(group).alias("g_"), "before_")
    return firsts.join(F.broadcast(room), F.col(group) == F.col("g_")).where(F.col("before_") + F.col("n_") <= limit).select(group, key, (F.col("before_") + F.col("n_")).cast("int").alias("place"))


def pair_sample(pairs: DataFrame, limit: int, seed: int) -> DataFrame:
    """The first ``limit`` pairs (a, b, cross_split): those across splits before the others, each in drawn order."""
    return pairs.orderBy(~F.col("cross_split"), drawn(seed, F.col("a"), F.col("b")), "a", "b").limit(limit)


def shuffled(rows: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """``limit`` rows in drawn order, with their place."""
    first = rows.withColumn("o_", drawn(seed, F.col(key))).orderBy("o_", key).limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("o_", key))).drop("o_")  # ``limit`` rows


def epoch_draws(rows: DataFrame, key: str, weight: str, seed: int, epoch: int, k: int | None = None) -> DataFrame:
    """draw, key: k draws with replacement (as many as rows, if not given) by weight, the same whenever seed, epoch, keys and weights are."""
    spark = rows.sparkSession
    # Written once: the draw reads the weights for its ranges, its totals and its cumulative sums.
    fixed = Work(spark, "draws").table(rows.select(F.col(key), F.greatest(F.lit(1), F.round(F.col(weight) * UNIT).cast("long")).alias("w_")), "weights")
    numbers = spark.range(fixed.count() if k is None else k).toDF("draw")
    total = F.broadcast(fixed.agg(F.sum("w_").alias("total_")))  # one row
    u = numbers.crossJoin(total).select("draw", F.least(F.col("total_") - 1, F.floor(uniform(seed, epoch, F.col("draw")) * F.col("total_"))).cast("long").alias("u"))
    return weighted_draw(fixed, key, "w_", u).withColumnRenamed("key", key)


def plan_images(rows: DataFrame, key: str, seed: int, excluded: DataFrame | None = None) -> DataFrame:
    """key, tier, n0, n1, eligible, weight, probability, expected, drawn for each image (key, tier 0 to 3, n0, n1; each once).

    Weight 1 + tier * min(0.1 * n / sum of eligible tiers, 1 / 3); excluded images (column key) weigh 1.  drawn: how often epoch 0 takes the image.
    """
    if excluded is None:
        told = rows.withColumn("eligible", F.lit(True))
    else:
        out = excluded.select(F.col(key).alias("x_")).distinct()
        told = rows.join(out, F.col(key) == F.col("x_"), "left").withColumn("eligible", F.col("x_").isNull()).drop("x_")
    told = told.select(key, "tier", "n0", "n1", "eligible", F.when(F.col("eligible"), F.col("tier")).otherwise(0).alias("t_"))
    sums = told.agg(F.count("*").alias("n_"), F.sum("t_").alias("severity_"))
    step = F.expr("case when severity_ > 0 then least(0.1D * n_ / severity_, 1D / 3) else 0D end")
    weighted = told.crossJoin(F.broadcast(sums)).withColumn("weight", F.lit(1.0) + F.col("t_") * step)
    weighted = Work(rows.sparkSession, "plan").table(weighted, "images")
    total = weighted.agg(F.sum("weight").alias("total_"))
    counts = epoch_draws(weighted, key, "weight", seed, 0).groupBy(F.col(key).alias("d_")).agg(F.count("*").alias("drawn_"))
    p = F.col("weight") / F.col("total_")
    joined = weighted.crossJoin(F.broadcast(total)).join(counts, F.col(key) == F.col("d_"), "left")
    return joined.select(key, "tier", "n0", "n1", "eligible", "weight", p.alias("probability"), (p * F.col("n_")).alias("expected"), F.coalesce("drawn_", F.lit(0)).alias("drawn"))


def plan_tiers(images: DataFrame) -> DataFrame:
    """tier, n, weight (of its eligible images), fraction, expected, drawn, of all four tiers."""
    tiers = images.sparkSession.range(4).select(F.col("id").cast("int").alias("tier"))
    g = images.groupBy(F.col("tier").alias("t_")).agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.sum("probability").alias("fraction"), F.sum("expected").alias("expected"), F.sum("drawn").alias("drawn"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tiers.join(g, F.col("tier") == F.col("t_"), "left").select("tier", zero("n"), "weight", zero("fraction"), zero("expected"), zero("drawn"))


def plan_summary(images: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row: what a plan promises, what epoch 0 gives, and its risk.

    risk: FAIL if an image is expected more than 3 times or a tier of at most 5 % of the images has more than 20 % of the draws; WARNING above 2 times or
    with fewer than 60 % of the images expected in an epoch; else PASS.
    """
    n = images.agg(F.count("*").alias("m_"))
    g = images.crossJoin(F.broadcast(n)).agg(
        F.count("*").alias("n"), ((F.sum("weight") - F.count("*")) / F.count("*")).alias("extra_mass"), F.sum(F.when(F.col("probability") < 1, -F.expm1(F.col("m_") * F.log1p(-F.col("probability")))).otherwise(1.0)).alias("expected_unique"),
        (1 / F.sum(F.col("probability") * F.col("probability"))).alias("effective_size"), F.max("expected").alias("max_expected"), F.max("drawn").alias("max_drawn"), F.count_if(F.col("drawn") > 0).alias("unique_drawn"), F.count_if(F.expr("eligible and tier > 0")).alias("eligible_hard"), F.count_if(~F.col("eligible")).alias("excluded"),
        *[F.sum(c).alias(f"{c}_before") for c in ("n0", "n1")], *[F.sum(F.col(c) * F.col("expected")).alias(f"{c}_expected") for c in ("n0", "n1")],
    )
    tiny = tiers.crossJoin(F.broadcast(n)).agg(F.coalesce(F.bool_or((F.col("n") <= 0.05 * F.col("m_")) & (F.col("fraction") > 0.2)), F.lit(False)).alias("tiny_"))
    risk = F.expr("case when max_expected > 3 or tiny_ then 'FAIL' when max_expected > 2 or expected_unique < 0.6D * n then 'WARNING' else 'PASS' end")
    return g.crossJoin(tiny).select(*g.columns, risk.alias("risk"))  # one row each


def plan_differences(stored: DataFrame, recomputed: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """key, column, stored, recomputed of every value of a stored plan that does not reproduce, and of rows that one side lacks (column null)."""
    told = lambda df, c: F.round(c, digits).cast("string") if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
    columns = [c for c in recomputed.columns if c != key]
    side = lambda df: df.select(F.col(key).alias("k_"), F.lit(True).alias("there"), *[told(df, c).alias(c) for c in columns])
    a, b = side(stored).alias("a"), side(recomputed).alias("b")
    both = a.join(b, F.expr("a.k_ <=> b.k_"), "full_outer")
    lone = F.when(F.expr("a.there is null or b.there is null"), F.array(F.struct(F.lit(None).cast("string").alias("column"), F.when(F.expr("a.there"), "there").otherwise("missing").alias("stored"), F.when(F.expr("b.there"), "there").otherwise("missing").alias("recomputed"))))
    unlike = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("stored"), F.col(f"b.{c}").alias("recomputed")) for c in columns])
    found = F.coalesce(lone, F.filter(unlike, lambda x: ~x["stored"].eqNullSafe(x["recomputed"])))
    return both.select(F.coalesce("a.k_", "b.k_").alias(key), F.explode(found).alias("x")).select(key, "x.column", "x.stored", "x.recomputed")


def overlap_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """combination (names joined by +, "none"), exact, at_least for all combinations of the flags: rows with these alone, and rows with these and perhaps others.

    Rows are counted once by the set of their flags as bits; at_least is the sum over the supersets, of which there are 2**flags at most.
    """
    names = list(flags)
    if len(names) > 10:
        raise ValueError("at most ten flags: their combinations are all listed")
    bits = sum((F.when(test, F.lit(1 << k)).otherwise(0) for k, test in enumerate(flags.values())), F.lit(0))
    cells = rows.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1 << len(names)).select(F.col("id").cast("int").alias("m"))
    label = F.concat_ws("+", *[F.when(F.col("m").bitwiseAND(1 << k) > 0, name) for k, name in enumerate(names)])
    sums = every.join(F.broadcast(cells), F.expr("bits & m = m"), "left").groupBy("m").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("at_least"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("m"), F.col("n"))), F.lit(0)).alias("exact"))
    return sums.select(F.when(F.col("m") == 0, "none").otherwise(label).alias("combination"), "exact", "at_least")


def mining_summary(objects: DataFrame, images: DataFrame, categories: tuple[str, ...], target: int = 1) -> DataFrame:
    """metric, name, n: images and objects, classes, all four tiers, every category (of all objects and of class ``target``, 0 included), images with hard objects of the class, images of tier 3.

    objects: img, j, c, category, hard; images: img, tier, n_hard1.  Each table is read once.
    """
    of = lambda metric, name, test: (metric, name, F.count_if(test))
    spec = [of("classes", str(c), F.col("c") == c) for c in (0, 1)] + [of("objects", "all", F.lit(True))]
    spec += [of(m, c, (F.col("category") == c) & extra) for m, extra in (("all_difficulty", F.lit(True)), ("target_difficulty", F.col("c") == target)) for c in categories]
    over = [of("images", "all", F.lit(True)), of("hard_images", f"class {target}", F.col("n_hard1") > 0), of("critical_images", "tier 3", F.col("tier") == 3)] + [of("tiers", str(t), F.col("tier") == t) for t in range(4)]

    def long(df, what):
        one = df.agg(*[n.alias(f"v{k}") for k, (_, _, n) in enumerate(what)])
        cells = ", ".join(f"'{m}', '{name}', v{k}" for k, (m, name, _) in enumerate(what))
        return one.select(F.expr(f"stack({len(what)}, {cells}) as (metric, name, n)"))

    return long(objects, spec).unionByName(long(images, over))
