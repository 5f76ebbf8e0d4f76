"""Label lines to boxes, with the first failure or all warnings of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolith.functions.geometry import size_bucket

TOLERANCE, NEAR_ZERO = 1e-6, 1e-4
#: What counts as a number, before it is cast: engines differ in what else they accept.
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
NAMED = r"^[+-]?(nan|inf|infinity)$"


def parse_lines(lines: DataFrame, classes: tuple[int, ...] = (0, 1), line: str = "line") -> DataFrame:
    """Adds class_id, x, y, w, h, area, aspect_ratio, size_category (null unless the line gives a box) and issues, an array of codes.

    The first of FIELD_COUNT, NON_NUMERIC, NON_FINITE, CLASS_NOT_INTEGER,
    INVALID_CLASS_ID, INVALID_COORDINATES stands alone and gives no box;
    OUT_OF_BOUNDS and NEAR_ZERO are warnings on a box that is kept.
    """
    kept = lines.columns
    fields = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    number = F.transform(fields, lambda t: F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")).when(F.lower(t).rlike(NAMED), F.lit("NaN").cast("double")))
    # An array of one is exploded so that filters on what follows stay above: pushed below, each would read the line again wherever it names a number.
    v = lines.select(*kept, F.explode(F.array(number)).alias("v_")).select(*kept, F.size("v_").alias("n_"), *[F.get("v_", F.lit(k)).alias(n) for k, n in enumerate(("k_", "x_", "y_", "w_", "h_"))])
    finite = " and ".join(f"not isnan({c}_) and abs({c}_) < double('infinity')" for c in "kxywh")
    known = ", ".join(str(c) for c in classes)
    fatal = F.expr(f"""case
        when n_ <> 5 then 'FIELD_COUNT'
        when k_ is null or x_ is null or y_ is null or w_ is null or h_ is null then 'NON_NUMERIC'
        when not ({finite}) then 'NON_FINITE'
        when k_ <> floor(k_) then 'CLASS_NOT_INTEGER'
        when k_ not in ({known}) then 'INVALID_CLASS_ID'
        when not (x_ between 0 and 1 and y_ between 0 and 1 and w_ > 0 and w_ <= 1 and h_ > 0 and h_ <= 1) then 'INVALID_COORDINATES' end""")
    t = TOLERANCE
    edge = f"x_ - w_ / 2 < -{t}D or y_ - h_ / 2 < -{t}D or x_ + w_ / 2 > 1 + {t}D or y_ + h_ / 2 > 1 + {t}D"
    box = v.withColumn("fatal_", fatal)
    issues = F.expr(f"case when fatal_ is not null then array(fatal_) else array_compact(array(case when {edge} then 'OUT_OF_BOUNDS' end, case when least(w_, h_) < {NEAR_ZERO}D then 'NEAR_ZERO' end)) end")
    ok = lambda e: F.when(F.col("fatal_").isNull(), F.expr(e))
    return box.select(*kept, ok("cast(k_ as int)").alias("class_id"), ok("x_").alias("x"), ok("y_").alias("y"), ok("w_").alias("w"), ok("h_").alias("h"), ok("w_ * h_").alias("area"), ok("w_ / h_").alias("aspect_ratio"), ok(size_bucket("w_ * h_")).alias("size_category"), issues.alias("issues"))


def repeated_annotations(lines: DataFrame, key: str, number: str, line: str = "line") -> DataFrame:
    """Lines of a file that repeat an earlier one: boxes by their numbers (as ``parse_lines`` reads them), other lines by their trimmed text."""
    return _seen(lines, key, number, line).where("seen_ > 1").drop("seen_", "same_")


def _seen(lines: DataFrame, key: str, number: str, line: str = "line") -> DataFrame:
    """Adds same_, what makes lines of a file equal, and seen_, the how manyeth of its equals a line is."""
    same = F.when(F.col("class_id").isNotNull(), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("class_id", "x", "y", "w", "h")])).otherwise(F.concat(F.lit("text "), F.trim(line)))
    return lines.withColumn("same_", same).withColumn("seen_", F.row_number().over(Window.partitionBy(key, "same_").orderBy(number)))


def suspicious_boxes(boxes: DataFrame) -> DataFrame:
    """One row for each box and reason: TINY_BBOX, EXTREME_ASPECT_RATIO (outside 0.2 to 5), NEAR_ZERO."""
    reasons = F.expr("array_compact(array(case when size_category = 'tiny' then 'TINY_BBOX' end, case when aspect_ratio < 0.2D or aspect_ratio > 5D then 'EXTREME_ASPECT_RATIO' end, case when array_contains(issues, 'NEAR_ZERO') then 'NEAR_ZERO' end))")
    return boxes.withColumn("reason", F.explode(reasons))


#: Issues that are for review; all others are errors.
REVIEW_ISSUES = ("OUT_OF_BOUNDS", "NEAR_ZERO", "DUPLICATE_ANNOTATION")


def annotation_issues(lines: DataFrame, key: str, number: str) -> DataFrame:
    """key, number, issue, severity of parsed lines, repeated annotations among them."""
    # Only what is told is sorted; lines are parsed once for both kinds of issues.
    seen = _seen(lines, key, number).select(key, number, "issues", "seen_")
    found = F.when(F.col("seen_") > 1, F.concat("issues", F.array(F.lit("DUPLICATE_ANNOTATION")))).otherwise(F.col("issues"))
    return seen.select(key, number, F.explode(found).alias("issue")).withColumn("severity", F.when(F.col("issue").isin(*REVIEW_ISSUES), "REVIEW").otherwise("ERROR"))
