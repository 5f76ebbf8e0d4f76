"""Weighted sampling plans and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.operators.ranges import even_blocks


def tier_weights(rows: DataFrame, tier: str = "tier") -> DataFrame:
    """rows with weight 1 + tier * step, step = min(0.1 * n / sum of tiers, 1/3): at most a tenth of mass is added."""
    t = rows.agg(F.count("*").alias("n_"), F.sum(tier).alias("severity_"))
    step = F.expr("case when severity_ > 0 then least(0.1D * n_ / severity_, 1D / 3) else 0D end")
    return rows.crossJoin(F.broadcast(t)).withColumn("weight", F.lit(1.0) + F.col(tier) * step).drop("n_", "severity_")


def target_weights(rows: DataFrame, count: str, multiplier: float) -> DataFrame:
    """rows with weight ``multiplier`` where there is any object of the target class, else 1."""
    return rows.withColumn("weight", F.when(F.col(count) > 0, float(multiplier)).otherwise(1.0))


def plan_statistics(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: n, total, max_draws, expected_unique (n draws with replacement), effective_size, risk."""
    t = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("total"))
    p = rows.crossJoin(F.broadcast(t)).withColumn("p", F.col(weight) / F.col("total"))
    g = p.agg(F.max("n").alias("n"), F.max("total").alias("total"), F.max(F.col("p") * F.col("n")).alias("max_draws"), F.sum(-F.expm1(F.col("n") * F.log1p(-F.col("p")))).alias("expected_unique"), (1 / F.sum(F.col("p") * F.col("p"))).alias("effective_size"))
    return g.withColumn("risk", F.expr("case when max_draws > 3 then 'FAIL' when max_draws > 2 or expected_unique < 0.6D * n then 'WARNING' else 'PASS' end"))


def class_exposure(rows: DataFrame, counts: list[str], weight: str = "weight") -> DataFrame:
    """class, baseline, expected: objects seen in one pass, unweighted and under n weighted draws."""
    t = rows.agg(F.count("*").alias("n_"), F.sum(weight).alias("total_"))
    e = rows.crossJoin(F.broadcast(t)).withColumn("e_", F.col(weight) / F.col("total_") * F.col("n_"))
    pairs = ", ".join(f"'{c}', {c}" for c in counts)
    return e.select("e_", F.expr(f"stack({len(counts)}, {pairs}) as (class, k)")).groupBy("class").agg(F.sum("k").alias("baseline"), F.sum(F.col("k") * F.col("e_")).alias("expected"))


def weighted_draw(rows: DataFrame, key: str, weight: str, uniforms: DataFrame, cells: int = 4096) -> DataFrame:
    """draw, key: for each uniform (draw, u in [0, total)) the row whose cumulative weight first exceeds it; positive integer weights.

    Cumulative weights are running sums within ranges of the key plus the totals of the ranges before.  The line from 0 to
    the total is cut into ``cells``; a row lies in the cells that it covers, a draw in one, and within a cell both are
    put in order and each draw takes the next row.  No row or draw is compared with more than its neighbours.
    """
    cut = even_blocks(rows.select(F.col(key).alias("key"), F.col(weight).cast("long").alias("w")), "key")
    blocks = cut.groupBy("block").agg(F.sum("w").alias("block_w"))
    before = blocks.select("block", (F.sum("block_w").over(Window.orderBy("block")) - F.col("block_w")).alias("before"))  # BLOCKS rows at most
    run = F.sum("w").over(Window.partitionBy("block").orderBy("key"))
    total = F.broadcast(cut.agg(F.sum("w").alias("total")))  # one row
    cell = f"cast(({{}}) * {cells} div total as int)"
    ends = cut.join(before, "block").select("key", (F.col("before") + run).alias("upto"), "w").crossJoin(total)
    ends = ends.withColumn("cell", F.explode(F.expr(f"sequence({cell.format('upto - w')}, {cell.format('upto - 1')})")))
    u = uniforms.crossJoin(total).select("draw", "u", F.expr(cell.format("u")).alias("cell"))
    both = ends.select("cell", F.col("upto").alias("at"), F.lit(None).cast("long").alias("draw"), "key").unionByName(u.select("cell", F.col("u").cast("long").alias("at"), F.col("draw").cast("long").alias("draw"), F.lit(None).cast("long").alias("key")))
    # From the largest down: a row that ends where a draw lies comes after it, so the last row seen is the first that exceeds it.
    w = Window.partitionBy("cell").orderBy(F.desc("at"), F.col("draw").isNull(), "draw").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("hit", F.last("key", ignorenulls=True).over(w)).where("draw is not null").select("draw", F.col("hit").alias("key"))


def hash_sample(rows: DataFrame, key: str, k: int, seed: int, group: str | None = None) -> DataFrame:
    """k rows (of each group) in an order that depends on key and seed alone."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    if group is None:
        return rows.orderBy(order, key).limit(k)
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("place_") <= k).drop("place_")
