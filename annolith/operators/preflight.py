"""What must hold before a run or after it: recommendations and readiness from counts, provenance of frozen evidence, evidence of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Review categories that say what hides an object.
OBSCURED = ("OCCLUSION", "BLUR", "LOW_LIGHT", "OTHER")


def recommendation(images: DataFrame, keys: tuple[str, ...] = (), present: str = "n1") -> DataFrame:
    """keys, images, positive, negative, weight, recommendation from images with their number of objects of the target class.

    weight = negative / positive gives both strata one mass; CLASS_AWARE_SAMPLING if it is above 1, else DEFER (also without a positive image).
    """
    g = images.groupBy(*keys).agg(F.count("*").alias("images"), F.count_if(F.col(present) > 0).alias("positive"))
    weight = F.expr("try_divide(cast(images - positive as double), positive)")
    out = g.withColumn("negative", F.col("images") - F.col("positive")).withColumn("weight", weight)
    return out.select(*keys, "images", "positive", "negative", "weight", F.when(F.col("weight") > 1, "CLASS_AWARE_SAMPLING").otherwise("DEFER").alias("recommendation"))


def readiness(reviews: DataFrame, automatic: DataFrame, classes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, total, reviewed, suspicious, unknown, obscured, decision, design of each experiment.

    reviews: keys, categories (array), reviewed; automatic: keys, low_confidence, class_confusion; classes: keys, n0, n1 (objects).
    decision: REVIEW_REQUIRED unless all is reviewed and nothing is suspicious, unknown or obscured; then YES if there is automatic evidence and class 1 has fewer objects
    than class 0, else NO.  design: PASS if all is reviewed, nothing suspicious, both kinds of automatic evidence are there and class 1 has fewer objects.
    """
    has = lambda *names: F.count_if(F.col("reviewed") & F.coalesce(F.arrays_overlap("categories", F.array(*[F.lit(n) for n in names])), F.lit(False)))
    r = reviews.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), has("ANNOTATION_SUSPICIOUS").alias("suspicious"), has("UNKNOWN").alias("unknown"), has(*OBSCURED).alias("obscured"))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    on = lambda p: F.expr(" and ".join(f"{k} <=> {p}{k}" for k in keys))
    j = r.join(side(automatic, "a_"), on("a_"), "left").join(side(classes, "c_"), on("c_"), "left")
    some = "coalesce(a_low_confidence, 0) + coalesce(a_class_confusion, 0) > 0"
    fewer = "coalesce(c_n1 < c_n0, false)"
    decision = f"case when reviewed < total or suspicious > 0 or unknown > 0 or obscured > 0 then 'REVIEW_REQUIRED' when {some} and {fewer} then 'YES' else 'NO' end"
    design = f"case when reviewed = total and suspicious = 0 and coalesce(a_low_confidence, 0) > 0 and coalesce(a_class_confusion, 0) > 0 and {fewer} then 'PASS' else 'FAIL' end"
    return j.select(*keys, "total", "reviewed", "suspicious", "unknown", "obscured", F.expr(decision).alias("decision"), F.expr(design).alias("design"))


def provenance_violations(manifest: DataFrame, actual: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """key, problem of a frozen manifest (key and digests) against what is there: REPEATED, MISSING, FOREIGN, or CHANGED and the digest's name."""
    g = manifest.groupBy(F.col(key).alias("m_key")).agg(F.count("*").alias("n"), *[F.min(d).alias(f"m_{d}") for d in digests])
    j = g.join(actual.select(F.col(key).alias("a_key"), *[F.col(d).alias(f"a_{d}") for d in digests]), F.expr("m_key <=> a_key"), "full_outer")
    there = F.col("n").isNotNull() & F.exists(F.array(F.struct("a_key", *[f"a_{d}" for d in digests])), lambda x: x["a_key"].isNotNull())
    problems = F.array_compact(F.array(
        F.when(F.col("n") > 1, "REPEATED"), F.when(F.col("a_key").isNull() & F.col("m_key").isNotNull(), "MISSING"), F.when(F.col("n").isNull(), "FOREIGN"),
        *[F.when(there & ~F.col(f"m_{d}").eqNullSafe(F.col(f"a_{d}")), f"CHANGED {d}") for d in digests],
    ))
    return j.select(F.coalesce("m_key", "a_key").alias(key), F.explode(problems).alias("problem"))


def prediction_violations(pred: DataFrame, classes: int, floor: float, most: int) -> DataFrame:
    """img, problem of cached predictions: TOO_MANY in an image, UNKNOWN_CLASS, INVALID_SCORE (outside floor to 1) or INVALID_BOX (not finite)."""
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("x1", "y1", "x2", "y2"))
    g = pred.groupBy("img").agg(
        F.count("*").alias("n"), F.bool_or(~F.coalesce(F.col("c").between(0, classes - 1), F.lit(False))).alias("class_"),
        F.bool_or(~F.coalesce(F.col("s").between(floor, 1) & ~F.isnan("s"), F.lit(False))).alias("score_"), F.bool_or(~F.expr(finite)).alias("box_"),
    )
    told = F.array_compact(F.array(F.when(F.col("n") > most, "TOO_MANY"), F.when(F.col("class_"), "UNKNOWN_CLASS"), F.when(F.col("score_"), "INVALID_SCORE"), F.when(F.col("box_"), "INVALID_BOX")))
    return g.select("img", F.explode(told).alias("problem"))


def run_violations(required: DataFrame, evidence: DataFrame, epochs: DataFrame, samples: int | None = None) -> DataFrame:
    """run, item, problem of the evidence of runs.

    required, evidence: run, key, value (texts); epochs: run, epoch, samples, used, steps, expected.  A required key is MISSING or WRONG_VALUE (item: the key); an epoch (item: its number) is
    OUT_OF_SEQUENCE if epochs do not count from 1, WRONG_SAMPLES if it drew another number than expected, SAMPLER_NOT_USED, NO_STEPS.  A run without any evidence has one row, NOT_RUN.
    """
    e = evidence.select(F.col("run").alias("e_run"), F.col("key").alias("e_key"), F.col("value").alias("e_value"))
    ran = evidence.select(F.col("run").alias("r_run")).distinct()
    j = required.join(ran, F.col("run") == F.col("r_run"), "left").join(e, F.expr("run = e_run and key = e_key"), "left")
    values = j.where("r_run is not null").select("run", F.col("key").alias("item"), F.when(F.col("e_run").isNull(), "MISSING").when(~F.col("value").eqNullSafe(F.col("e_value")), "WRONG_VALUE").alias("problem")).where("problem is not null")
    absent = j.where("r_run is null").select("run", F.lit(None).cast("string").alias("item"), F.lit("NOT_RUN").alias("problem")).distinct()
    w = Window.partitionBy("run").orderBy("epoch")
    told = F.array_compact(F.array(F.when(F.col("nth") != F.col("epoch"), "OUT_OF_SEQUENCE"), F.when(~F.col("samples").eqNullSafe(F.col("expected")), "WRONG_SAMPLES"), F.when(~F.coalesce("used", F.lit(False)), "SAMPLER_NOT_USED"), F.when(~F.coalesce(F.col("steps") > 0, F.lit(False)), "NO_STEPS")))
    per = epochs.withColumn("nth", F.row_number().over(w)).select("run", F.col("epoch").cast("string").alias("item"), F.explode(told).alias("problem"))
    return values.unionByName(absent).unionByName(per)


def review_sample(images: DataFrame, objects: DataFrame, quotas: dict[int, int], categories: tuple[str, ...], each: int = 2, crowded: int = 3) -> DataFrame:
    """img, reasons (array, sorted): the targeted queue, each image once with all that it was chosen for.

    The first images of each tier (``tier_quota_sample``), the first ``each`` images by name in which a category occurs, and the first ``crowded`` crowded images with hard objects.
    """
    from annolith.operators.review import tier_quota_sample

    tiers = tier_quota_sample(images, quotas).select("img", F.concat(F.lit("tier "), F.col("tier").cast("string")).alias("reason"))
    w = Window.partitionBy("category").orderBy("img")
    covered = objects.where(F.col("category").isin(*categories)).select("img", "category").distinct().withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= each).select("img", F.col("category").alias("reason"))
    dense = images.where("crowded and n_hard > 0").orderBy("img").limit(crowded).select("img", F.lit("crowded").alias("reason"))
    return tiers.unionByName(covered).unionByName(dense).groupBy("img").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
