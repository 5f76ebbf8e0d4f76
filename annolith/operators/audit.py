"""Audit tables: duplicates, groups, distributions, statistics, coverage, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_duplicates(items: DataFrame, content: str, name: str, split: str, least: int = 2) -> DataFrame:
    """Members of groups of at least ``least`` items of equal content: sha256, name, representative (least name), n, splits, cross_split, severity.

    One row a member, so a group of any size is never gathered in one place.
    """
    hashed = items.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("sha256"), F.col(split).alias("split"), F.col(name).alias("name"))
    groups = hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("s"), F.min("name").alias("representative")).where(F.col("n") >= least)
    cross = F.size("s") > 1
    groups = groups.select(F.col("sha256").alias("g_sha"), "representative", "n", F.array_join("s", "|").alias("splits"), cross.alias("cross_split"), F.when(cross, "ERROR").otherwise("REVIEW").alias("severity"))
    return hashed.join(groups, F.col("sha256") == F.col("g_sha")).select("sha256", "name", "representative", "n", "splits", "cross_split", "severity")


def group_rollup(items: DataFrame, group: str, split: str) -> DataFrame:
    """Size and splits of every group whose key is not empty."""
    rows = items.where(F.col(group).isNotNull() & (F.col(group) != ""))
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("s"))
    return g.select(group, "n", F.array_join("s", "|").alias("splits"), (F.size("s") > 1).alias("cross_split"))


def class_distribution(boxes: DataFrame, split: str, cls: str, image: str) -> DataFrame:
    """Counts of two classes by split and overall (split null there); ratios are null on zero denominators."""
    g = boxes.rollup(split).agg(F.count_distinct(image).alias("n_images"), F.count("*").alias("n_objects"), F.count_if(F.col(cls) == 0).alias("n_class0"), F.count_if(F.col(cls) == 1).alias("n_class1"))
    return g.select(split, "n_images", "n_objects", "n_class0", "n_class1", F.expr("try_divide(cast(n_objects as double), n_images)").alias("objects_per_image"), F.expr("try_divide(cast(n_class0 as double), n_class1)").alias("ratio"))


def metric_statistics(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """count, minimum, maximum, mean and exact median of each metric by group.

    The median comes from counts of the distinct values: counts by range (64 a power of e) tell the ranges that hold the middle, and
    running counts within those alone the values, so no group's values meet in one buffer.
    """
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = rows.select(F.col(group).alias("group_"), F.expr(f"stack({len(metrics)}, {pairs}) as (metric, v)"))
    keys = ["group_", "metric"]
    values = long.groupBy(*keys, "v").agg(F.count("*").alias("k")).withColumn("range", F.expr("cast(signum(v) * floor(64 * log1p(abs(v))) as int)"))
    stats = long.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"))
    ranges = values.where("v is not null").groupBy(*keys, "range").agg(F.sum("k").alias("in_range"))
    upto = F.sum("in_range").over(Window.partitionBy(*keys).orderBy("range"))
    total = F.sum("in_range").over(Window.partitionBy(*keys))
    middle = ranges.withColumns({"before": upto - F.col("in_range"), "total": total}).where("before <= total div 2 and before + in_range > (total - 1) div 2")
    within = F.sum("k").over(Window.partitionBy(*keys, "range").orderBy("v"))
    near = values.alias("x").join(middle.alias("y"), F.expr("x.group_ <=> y.group_ and x.metric = y.metric and x.range = y.range")).select("x.group_", "x.metric", "x.range", "x.v", "x.k", "y.before", "y.total").withColumn("upto", F.col("before") + within)
    medians = near.where("upto - k <= total div 2 and upto > (total - 1) div 2").groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    out = stats.alias("s").join(medians.alias("m"), F.expr("s.group_ <=> m.group_ and s.metric = m.metric"), "left")
    return out.select(F.col("s.group_").alias(group), "s.metric", "n", "minimum", "maximum", "mean", "median")


def object_counts(images: DataFrame, split: str, n: str) -> DataFrame:
    """Images of zero, one, several and unknown numbers of objects, by split and overall."""
    c = F.col(n)
    return images.rollup(split).agg(F.count_if(c == 0).alias("n_zero"), F.count_if(c == 1).alias("n_one"), F.count_if(c > 1).alias("n_many"), F.count_if(c.isNull()).alias("n_unknown"))


def histogram(rows: DataFrame, key, alias: str) -> DataFrame:
    return rows.groupBy(key.alias(alias)).agg(F.count("*").alias("n"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone: ONLY_LEFT or ONLY_RIGHT.  Empty where the two cover the same keys."""
    a, b = left.select(F.col(key).alias("key")).distinct(), right.select(F.col(key).alias("key")).distinct()
    return a.join(b, "key", "left_anti").withColumn("side", F.lit("ONLY_LEFT")).union(b.join(a, "key", "left_anti").withColumn("side", F.lit("ONLY_RIGHT")))


def issue_status(issues: DataFrame, severity: str) -> DataFrame:
    """One row: FAIL if any issue is an ERROR, REVIEW_REQUIRED if there is any, else PASS."""
    row = issues.agg(F.count_if(F.col(severity) == "ERROR").alias("n_errors"), F.count("*").alias("n_issues"))
    return row.select("n_errors", "n_issues", F.expr("case when n_errors > 0 then 'FAIL' when n_issues > 0 then 'REVIEW_REQUIRED' else 'PASS' end").alias("status"))


def told_apart(items: DataFrame, *content: str) -> Column:
    """The contents as one text that no other contents give: each value with its length before it, nulls with a sign of their own, nested values as JSON."""
    kinds = {f.name: f.dataType.typeName() for f in items.schema.fields}
    parts = []
    for c in content:
        v = F.hex(c) if kinds[c] == "binary" else F.to_json(F.struct(c)) if kinds[c] in ("array", "map", "struct", "variant") else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("N;")))
    return F.concat(*parts)


def row_digest(*columns: str) -> Column:
    """A 64-bit hash of a row, nulls in their places."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def fingerprint(items: DataFrame, key: str, *content: str) -> DataFrame:
    """key, sha256 of the contents: different contents never give one text to hash."""
    return items.select(F.col(key).alias("key"), F.sha2(told_apart(items, *content), 256).alias("sha256"))


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys ADDED, REMOVED or CHANGED between two fingerprints."""
    j = before.toDF("key", "old").join(after.toDF("key", "new"), "key", "full_outer")
    return j.where("not (old <=> new)").select("key", F.expr("case when old is null then 'ADDED' when new is null then 'REMOVED' else 'CHANGED' end").alias("change"))


def argument_drift(actual: DataFrame, baseline: DataFrame, allowed: DataFrame) -> DataFrame:
    """Key and value tables compared: MATCH, EXPECTED_DIFFERENCE for the keys of ``allowed`` (one column), DRIFT."""
    j = actual.toDF("key", "actual").join(baseline.toDF("key", "baseline"), "key", "full_outer").join(allowed.toDF("allowed").distinct(), F.col("key") == F.col("allowed"), "left")
    same = F.expr("actual <=> baseline and actual is not null")
    status = F.when(F.col("allowed").isNotNull() & ~F.expr("actual <=> baseline"), "EXPECTED_DIFFERENCE").when(same, "MATCH").otherwise("DRIFT")
    return j.select("key", "actual", "baseline", status.alias("status"))
