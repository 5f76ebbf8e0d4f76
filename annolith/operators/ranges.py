"""Running values over long ordered tables, by ranges of the order, so that no task sees a whole key.

Rows carry a block number that never falls along the order.  Each block is
summed up to one row; these rows (as many as there are blocks) are run over in
order, and every row combines what came before its block with what came before it inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks of an evenly cut range.
BLOCKS = 1024


def even_blocks(rows: DataFrame, value: str, blocks: int = BLOCKS) -> DataFrame:
    """Adds block: which of ``blocks`` equal parts of the range of ``value`` a row lies in."""
    ends = rows.agg(F.min(value).cast("double").alias("least_"), F.max(value).cast("double").alias("most_"))
    share = f"coalesce(try_divide({value} - least_, most_ - least_), 0D)"
    return rows.crossJoin(F.broadcast(ends)).withColumn("block", F.expr(f"least({blocks - 1}, cast(floor({share} * {blocks}) as int))")).drop("least_", "most_")  # one row


def carried(rows: DataFrame, keys: list[str], order: list[Column], value: Column, alias: str, *, down: bool = False, largest: bool = False) -> DataFrame:
    """Adds the last value that is not null (or the largest so far) up to and with each row; rows have a ``block``.

    down: the order goes from the highest block to the lowest.
    """
    own = rows.withColumn("value_", value)
    local = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nth = own.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order)))
    run = F.max("value_").over(local) if largest else F.last("value_", ignorenulls=True).over(local)
    inside = nth.withColumn("inside_", run)
    whole = F.max("value_") if largest else F.max_by("value_", F.when(F.col("value_").isNotNull(), F.col("nth_")))
    blocks = nth.groupBy(*keys, "block").agg(whole.alias("whole_"))
    step = F.desc("block") if down else F.asc("block")
    above = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before_", F.max("whole_").over(above) if largest else F.last("whole_", ignorenulls=True).over(above)).drop("whole_")
    joined = inside.join(before, [*keys, "block"])
    both = F.greatest("inside_", "before_") if largest else F.coalesce("inside_", "before_")
    if largest:  # greatest() takes no structs
        both = F.array_max(F.array("inside_", "before_"))
    return joined.withColumn(alias, both).drop("value_", "nth_", "inside_", "before_", "block")
