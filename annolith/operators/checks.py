"""Gates: tables of violations (empty where all is well), and the checks made of them.

A check never ends a job half way: what breaks a rule is a row, and ``gate`` turns tables of violations into one row a check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def foreign_keys(rows: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows joined with their dimension row, rows that have none): an inner join that lets nothing vanish unseen."""
    d = dimension.withColumnRenamed(key, "d_key_")
    return rows.join(d, F.col(key) == F.col("d_key_")).drop("d_key_"), rows.join(d, F.col(key) == F.col("d_key_"), "left_anti")


def gate(spark, checks: dict[str, DataFrame]) -> DataFrame:
    """name, violations, passed: one row for each check."""
    counted = [v.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations") for name, v in checks.items()]
    return reduce(DataFrame.unionByName, counted).withColumn("passed", F.col("violations") == 0)


def table_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows (as often as they are too many) of one table alone, with side ONLY_LEFT or ONLY_RIGHT: a plan against its recomputation."""
    columns = one.columns
    both = one.select(*columns, F.lit(1).alias("n_")).unionByName(two.select(*columns, F.lit(-1).alias("n_")))
    off = both.groupBy(*columns).agg(F.sum("n_").alias("n_")).where("n_ <> 0")
    return off.select(*columns, F.when(F.col("n_") > 0, "ONLY_LEFT").otherwise("ONLY_RIGHT").alias("side"), F.abs("n_").alias("times"))


def out_of_range(rows: DataFrame, metrics: list[str], least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Rows in which a metric is missing, not finite or outside its range, with ``metric``."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = rows.select("*", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    return long.where(f"value is null or isnan(value) or value < {least}D or value > {most}D")


def drift(actual: DataFrame, reference: DataFrame, keys: list[str], value: str, most: float = 0.03) -> DataFrame:
    """keys, actual, reference, difference where two runs differ by more than ``most``."""
    a, b = actual.select(*keys, F.col(value).alias("actual")), reference.select(*keys, F.col(value).alias("reference"))
    return a.join(b, keys).withColumn("difference", F.abs(F.col("actual") - F.col("reference"))).where(F.col("difference") > most)


def weight_violations(images: DataFrame, weights: DataFrame, excluded: DataFrame, of_tier: dict[int, float], key: str = "img") -> DataFrame:
    """key, problem: MISSING (no weight), FOREIGN (weight of no image), REPEATED, WRONG_WEIGHT (not its tier's, or not 1 though excluded)."""
    tier_weight = F.create_map(*[F.lit(x) for kv in of_tier.items() for x in (kv[0], float(kv[1]))])
    want = images.join(excluded.select(F.col(key).alias("x_key")).distinct(), F.col(key) == F.col("x_key"), "left").select(key, F.when(F.col("x_key").isNotNull(), 1.0).otherwise(tier_weight[F.col("tier")]).alias("want"))
    got = weights.groupBy(F.col(key).alias("w_key")).agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    j = want.join(got, F.col(key) == F.col("w_key"), "full_outer")
    problem = F.when(F.col("w_key").isNull(), "MISSING").when(F.col(key).isNull(), "FOREIGN").when(F.col("n") > 1, "REPEATED").when(~F.col("weight").eqNullSafe(F.col("want")), "WRONG_WEIGHT")
    return j.select(F.coalesce(key, "w_key").alias(key), problem.alias("problem")).where("problem is not null")


def metric_table_violations(rows: DataFrame, expected: DataFrame, scopes: list[str], n_images: Column) -> DataFrame:
    """model, threshold, problem of a long metric table (model, threshold, scope, tp, fp, fn, precision, recall, f1, fp_per_image).

    FOREIGN_KEY (a model, threshold or scope that is not expected), DUPLICATE_SCOPE, INVALID_COUNT, ARITHMETIC (saved ratios are not those of
    the counts), MISSING_SCOPE, OVERALL_SUM (the overall counts are not the sums of the classes).  expected: model, threshold.
    Rows and expected keys are read once each: all checks come from one grouping by model and threshold.
    """
    known = expected.select("model", "threshold").distinct()
    off = lambda c: F.sum(F.when(F.col("scope") == "Overall", F.col(c)).otherwise(-F.col(c)))
    ratio = lambda a, b: f"coalesce(try_divide(cast({a} as double), {b}), 0D)"
    right = {"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "f1": ratio("2 * tp", "2 * tp + fp + fn")}
    wrong = F.expr(" or ".join(f"not (abs({c} - {e}) <= 1e-12D)" for c, e in right.items())) | ~(F.abs(F.col("fp_per_image") - F.try_divide(F.col("fp").cast("double"), n_images)) <= 1e-12)
    per = rows.groupBy(F.col("model").alias("r_model"), F.col("threshold").alias("r_threshold")).agg(
        F.count("*").alias("n"), F.count_distinct("scope").alias("k"), F.bool_or(F.expr("tp < 0 or fp < 0 or fn < 0")).alias("negative"), F.bool_or(wrong).alias("wrong"), F.bool_or(~F.col("scope").isin(*scopes, "Overall")).alias("foreign"),
        F.coalesce((off("tp") != 0) | (off("fp") != 0) | (off("fn") != 0), F.lit(False)).alias("unequal"),
    )
    both = known.join(per, F.expr("model = r_model and threshold = r_threshold"), "full_outer")
    told = {"FOREIGN_KEY": "model is null or foreign", "DUPLICATE_SCOPE": "n > k", "INVALID_COUNT": "negative", "ARITHMETIC": "wrong", "MISSING_SCOPE": f"model is not null and coalesce(k, 0) < {len(scopes) + 1}", "OVERALL_SUM": "unequal"}
    problems = F.array_compact(F.array(*[F.when(F.expr(test), name) for name, test in told.items()]))
    return both.select(F.coalesce("model", "r_model").alias("model"), F.coalesce("threshold", "r_threshold").alias("threshold"), F.explode(problems).alias("problem"))


def outside(paths: DataFrame, path: str, root: str) -> DataFrame:
    """Paths that do not lie below ``root`` once . and .. are resolved: relative ones, those that climb out and the root itself."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    climbed = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    clean = F.concat(F.lit("/"), F.array_join(climbed, "/"))
    inside = F.col(path).startswith("/") & clean.startswith(root.rstrip("/") + "/")
    return paths.where(~F.coalesce(inside, F.lit(False)))


def choices(rows: DataFrame, column: str, allowed: list[str], exclusive: list[tuple[str, str]], separator: str = r"\|") -> DataFrame:
    """rows with choices (distinct, in the order given) and problem: EMPTY, UNKNOWN, EXCLUSIVE (two that rule each other out) or null."""
    found = F.array_distinct(F.filter(F.transform(F.split(F.upper(F.coalesce(column, F.lit(""))), separator), lambda x: F.trim(x)), lambda x: x != ""))
    out = rows.withColumn("choices", found)
    both = reduce(lambda a, b: a | b, [F.array_contains("choices", x) & F.array_contains("choices", y) for x, y in exclusive], F.lit(False))
    problem = F.when(F.size("choices") == 0, "EMPTY").when(F.size(F.array_except("choices", F.array(*map(F.lit, allowed)))) > 0, "UNKNOWN").when(both, "EXCLUSIVE")
    return out.withColumn("problem", problem)


def aligned_inventory(order: DataFrame, inventory: DataFrame, key: str, position: str) -> tuple[DataFrame, DataFrame]:
    """(the inventory's rows with the positions that another system gives its keys, keys of one side alone or twice in either): only if the second is empty are they one set."""
    a = order.groupBy(F.col(key).alias("o_key")).agg(F.count("*").alias("n_a"), F.min(position).alias(position))
    b = inventory.groupBy(F.col(key).alias("i_key")).agg(F.count("*").alias("n_b"))
    off = a.join(b, F.col("o_key") == F.col("i_key"), "full_outer").where("not (n_a <=> 1 and n_b <=> 1)").select(F.coalesce("o_key", "i_key").alias(key))
    return inventory.join(a.select("o_key", position), F.col(key) == F.col("o_key")).drop("o_key"), off
