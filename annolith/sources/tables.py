"""Readers and writers: label folders, strict CSV, JSON cases, versioned outputs, dataset configuration."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a line of a label file; suffixes of image files.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
SPLITS = ("train", "valid", "test")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names)


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, length, sha256 of the image files below a folder; suffixes in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")).select("path", "length", F.sha2("content", 256).alias("sha256"))


def label_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, line_number (from 1), line: the lines of all label files that are not blank; a byte order mark is dropped."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = files.select("path", F.posexplode(F.split("value", LINE_BREAK)).alias("at", "line"))
    return lines.where(F.trim("line") != "").select("path", (F.col("at") + 1).alias("line_number"), "line")


def strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table of exactly these columns; a ragged row, a value of another type or another header is an error."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings whose header and values may be padded with blanks."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])


BOX = "struct<class_id:int,bbox:array<double>>"
CASES = f"image string, width int, height int, ground_truth array<{BOX}>, predictions array<struct<class_id:int,confidence:double,bbox:array<double>>>"


def json_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cases of JSON files that hold a document or an array of them, or of ``lines`` of documents (which many tasks can read)."""
    return spark.read.schema(CASES).json(path, multiLine=not lines)


def case_boxes(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground truth (img, j, c, x1 .. y2) and predictions (img, i, c, s, x1 .. y2) of nested cases."""
    xy = [F.col("b.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    gt = cases.select(F.col("image").alias("img"), F.posexplode("ground_truth").alias("j", "b")).select("img", "j", F.col("b.class_id").alias("c"), *xy)
    pred = cases.select(F.col("image").alias("img"), F.posexplode("predictions").alias("i", "b")).select("img", "i", F.col("b.class_id").alias("c"), F.col("b.confidence").alias("s"), *xy)
    return gt, pred


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """A new version of a table: written whole by Spark's committer; an existing version is never replaced."""
    where = f"{folder}/{version}"
    df.write.mode("errorifexists").parquet(where)
    return where


def write_report(df: DataFrame, path: str, fields: list[str]) -> None:
    """One CSV of the named columns, in order, with a header even when empty.  For summaries: it is written by one task."""
    df.select(*fields).coalesce(1).write.mode("errorifexists").csv(path, header=True, emptyValue="")


@dataclass(frozen=True)
class DatasetConfig:
    """Where the splits of a dataset lie and what its classes are called."""

    path: str
    splits: dict[str, str]
    names: dict[int, str]


def dataset_config(path: str) -> DatasetConfig:
    """Reads a YAML configuration; unknown or missing keys and class ids that do not count from 0 are errors."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    wanted = {"path", "train", "val", "test", "nc", "names"}
    if not isinstance(raw, dict) or set(raw) != wanted:
        raise ValueError(f"expected exactly the keys {sorted(wanted)}")
    names = {int(k): str(v) for k, v in raw["names"].items()}
    if sorted(names) != list(range(raw["nc"])):
        raise ValueError("class ids must count from 0 to nc - 1")
    return DatasetConfig(raw["path"], {"train": raw["train"], "valid": raw["val"], "test": raw["test"]}, names)


def raw_config(path: str, root: str) -> DatasetConfig:
    """A configuration whose dataset lies at ``root`` itself, and nowhere else."""
    found = dataset_config(path)
    if Path(found.path).resolve() != Path(root).resolve():
        raise ValueError(f"the dataset must lie at {root}")
    return found


def raising(test: Column, message: str) -> Column:
    """True where ``test`` holds; ends the job where it does not.  For a filter that lets no bad row pass unseen."""
    return F.coalesce(test, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean")


def pixel_boxes(parsed: DataFrame, key: str, width: str = "width", height: str = "height") -> DataFrame:
    """key, c, x1 .. y2 in pixels of parsed label lines joined with their image's size; a line that gives no box is an error."""
    from annolith.functions.geometry import corners

    fine = parsed.where(raising(F.col("class_id").isNotNull(), "invalid ground truth"))
    return fine.select(key, F.col("class_id").alias("c"), *corners("x", "y", "w", "h", width, height))


def train_inventory(images: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, n0, n1 of every image; stricter than the parser: the class is the character 0 or 1, coordinates are finite and lie in 0 to 1, sides above 0."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    number = F.transform(F.slice(fields, 2, 4), lambda t: t.try_cast("double"))
    ok = (F.size(fields) == 5) & fields[0].isin("0", "1") & F.forall(number, lambda v: v.isNotNull() & v.between(0, 1)) & (F.least(number[2], number[3]) > 0)
    own = lines.where(F.trim("line") != "").where(raising(ok, "invalid annotation"))
    g = own.groupBy(F.col(key).alias("l_key")).agg(F.count_if(fields[0] == "0").alias("k0"), F.count_if(fields[0] == "1").alias("k1"))
    return images.select(key).join(g, F.col(key) == F.col("l_key"), "left").select(key, F.coalesce("k0", F.lit(0)).alias("n0"), F.coalesce("k1", F.lit(0)).alias("n1"))


SEGMENTS = "split string, size array<int>, total_frames long, frames_per_image int, max_zoom double, segments array<struct<start_frame:long,frames:int,placement:struct<left:int,top:int,width:int,height:int>,objects:array<struct<c:int,x:double,y:double,w:double,h:double>>>>"


def manifest_truth(manifests: DataFrame, open_splits: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """img (frame), scene, object, c, x1 .. y2: boxes of demo videos frame by frame, from manifests (SEGMENTS) whose split is open."""
    from annolith.functions.geometry import projected, zoom

    own = manifests.where(raising(F.col("split").isin(*open_splits), "this split is locked"))
    scenes = own.select("size", "frames_per_image", "max_zoom", F.posexplode("segments").alias("scene", "s"))
    objects = scenes.select("size", "frames_per_image", "max_zoom", "scene", "s.start_frame", "s.frames", "s.placement", F.posexplode("s.objects").alias("object", "o"))
    frames = objects.withColumn("index", F.explode(F.expr("sequence(0, frames - 1)"))).where("frames > 0").withColumn("factor", F.expr(zoom("index", "frames_per_image", "max_zoom").replace("max_zoomD", "max_zoom")))
    box = frames.withColumn("b", F.expr(projected("placement", "size[0]", "size[1]", "factor", ("o.x", "o.y", "o.w", "o.h")))).where("b is not null")
    return box.select((F.col("start_frame") + F.col("index")).alias("img"), "scene", "object", "o.c", "b.*")


#: Rows of a summary that is written as one document.
SUMMARY_ROWS = 100_000


def evidence_by_image(rows: DataFrame, key: str) -> DataFrame:
    """key, evidence: the rows of each image (as many as it has objects) as an array of structs in a fixed order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("evidence"))


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON document, an array of the rows of a summary, as the file at ``path``; a number that JSON cannot say is an error.

    A summary has at most SUMMARY_ROWS rows: more are refused, not cut.  The file gets its name once it is whole, and never replaces another.
    """
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    fine = df
    for c in doubles:
        fine = fine.where(raising(F.col(c).isNull() | ~(F.isnan(c) | (F.abs(c) == float("inf"))), f"{c} is not finite"))
    lines = fine.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in fine.columns]), {"ignoreNullFields": "false"}).alias("line")).limit(SUMMARY_ROWS + 1).collect()
    if len(lines) > SUMMARY_ROWS:
        raise ValueError(f"more than {SUMMARY_ROWS} rows are no summary: write a table")
    spark = df.sparkSession
    fs, place = _file_system(spark, path)
    staged = _file_system(spark, f"{path}.{uuid.uuid4().hex}")[1]
    if fs.exists(place):
        raise FileExistsError(path)
    out = fs.create(staged, False)
    try:
        out.write(("[\n" + ",\n".join(r.line for r in lines) + "\n]\n").encode())
        out.close()
        if not fs.rename(staged, place):
            raise OSError(f"cannot put {path} in place")
    finally:
        fs.delete(staged, False)


def write_metrics(overall: DataFrame, classes: DataFrame, folder: str, keys: list[str]) -> None:
    """Metrics as JSON and as CSV: the overall row first, then the classes by id."""
    first = overall.select(F.lit("overall").alias("scope"), F.lit(None).cast("int").alias("class_id"), *keys)
    rows = first.unionByName(classes.select(F.lit("class").alias("scope"), F.col("class_id").cast("int").alias("class_id"), *keys))
    ordered = rows.coalesce(1).sortWithinPartitions(F.desc("scope"), "class_id")
    write_json_report(ordered, f"{folder}/metrics.json")
    write_report(ordered, f"{folder}/metrics.csv", ["scope", "class_id", *keys])


def _file_system(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def prepare_output(spark: SparkSession, where: str, overwrite: bool = False) -> str | None:
    """Makes room for an output folder: what stands there is refused, or with ``overwrite`` kept beside it as an archive, whose name is returned."""
    fs, path = _file_system(spark, where)
    if not fs.exists(path) or not fs.listStatus(path):
        return None
    if not overwrite:
        raise FileExistsError(where)
    archive = f"{where.rstrip('/')}_archive_{datetime.now(UTC):%Y%m%dT%H%M%S_%fZ}"
    if not fs.rename(path, _file_system(spark, archive)[1]):
        raise OSError(f"cannot archive {where}")
    return archive


def publish(spark: SparkSession, df: DataFrame, folder: str, key: str) -> DataFrame:
    """Writes a table beside ``folder``, reads it back, compares the digests of all rows, and only then puts it in place; on a difference nothing is left.

    What stood there before is archived first and put back if the last step fails.
    """
    from annolith.operators.audit import fingerprint, snapshot_difference

    stage = f"{folder.rstrip('/')}_stage_{uuid.uuid4().hex}"
    columns = [c for c in df.columns if c != key]
    fs, place = _file_system(spark, stage)
    try:
        df.write.parquet(stage)
        wrong = snapshot_difference(fingerprint(df, key, *columns), fingerprint(spark.read.parquet(stage), key, *columns))
        if not wrong.isEmpty():
            raise OSError("the copy differs from its source")
        archive = prepare_output(spark, folder, overwrite=True)
        if not fs.rename(place, _file_system(spark, folder)[1]):
            if archive:
                fs.rename(_file_system(spark, archive)[1], _file_system(spark, folder)[1])
            raise OSError(f"cannot put {folder} in place")
    finally:
        fs.delete(place, True)
    return spark.read.parquet(folder)


def require_split(split: str, allowed: tuple[str, ...]) -> None:
    """Refuses a locked split before anything is read."""
    if split not in allowed:
        raise PermissionError(f"split {split!r} is not open here; open: {', '.join(allowed)}")
