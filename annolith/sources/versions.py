"""Versioned sets of tables behind one pointer, and a decision log on top of them.

A store is a folder::

    data/<commit>/<table>/     Parquet files, written once and never changed
    log/<version>.json         create-only: what the tables of that version are

A commit writes and verifies all its tables first and then creates the one log file of the
next version.  Readers take the highest version, so they see whole sets alone, the old one
until that file exists.  Two writers that expect the same version race for its
file: the second cannot create it and loses with a ``Conflict``.  A failure
before the file leaves the old set, and the tables written so far are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annolith.operators.audit import row_digest


class Conflict(RuntimeError):
    """The expected version is not the current one any more."""


class Store:
    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.where).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.where}/log"))

    # --- reading

    def version(self) -> int:
        """0 before the first commit."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.where}/log"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def entry(self, version: int) -> dict:
        """What a version's log file says: version, parent, at, note, tables (name: folders, rows, digest)."""
        if version == 0:
            return {"version": 0, "parent": None, "at": None, "note": "", "tables": {}}
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of one version (the current one)."""
        tables = self.entry(self.version() if version is None else version)["tables"]
        if name not in tables:
            raise KeyError(name)
        folders = [f"{self.where}/{x}" for x in tables[name]["folders"]]
        return self.spark.read.schema(StructType.fromJson(tables[name]["schema"])).parquet(*folders)

    def history(self) -> DataFrame:
        """version, parent, at, note, table, n_rows of every version; one small row for each table."""
        rows = [(v, e["parent"], e["at"], e["note"], n, t["rows"]) for v in range(1, self.version() + 1) for e in [self.entry(v)] for n, t in sorted(e["tables"].items())]
        return self.spark.createDataFrame(rows, "version long, parent long, at string, note string, table string, n_rows long")

    # --- writing

    def commit(self, tables: Mapping[str, DataFrame], expected: int, note: str = "", append: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> int:
        """Publishes all tables at once as version expected + 1; tables not named stay as they are, those in ``append`` are added to.

        Raises Conflict, and leaves nothing behind, if ``expected`` is not the current version when the pointer is set.
        """
        before = self.entry(expected)["tables"] if self.version() >= expected else {}
        if self.version() != expected:
            raise Conflict(f"expected version {expected}, found {self.version()}")
        commit = f"data/{uuid.uuid4().hex}"
        try:
            held = {n: t for n, t in before.items() if n not in drop}
            for name, df in tables.items():
                held[name] = self._written(df, f"{commit}/{name}", before.get(name) if name in append else None)
            self._point({"version": expected + 1, "parent": expected, "at": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%S.%fZ}", "note": note, "tables": held})
        except BaseException:
            self._fs.delete(self._path(f"{self.where}/{commit}"), True)
            raise
        return expected + 1

    def restore(self, version: int, expected: int) -> int:
        """Goes back to the tables of an earlier version, as a new version."""
        entry = self.entry(version)
        self._point({"version": expected + 1, "parent": expected, "at": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%S.%fZ}", "note": f"restores {version}", "tables": entry["tables"]})
        return expected + 1

    def compact(self, name: str, expected: int) -> int:
        """Rewrites a table that has grown by many small commits as one."""
        return self.commit({name: self.read(name, expected)}, expected, note=f"compacts {name}")

    def _written(self, df: DataFrame, folder: str, onto: dict | None) -> dict:
        """Writes a table and reads it back; its rows are held against what was to be written."""
        where = f"{self.where}/{folder}"
        digest = lambda x: x.agg(F.count("*").alias("n"), F.bit_xor(row_digest(*x.columns)).alias("x"), F.sum(F.pmod(row_digest(*x.columns), F.lit(1 << 31))).alias("s")).first()
        want = digest(df)
        df.write.parquet(where)
        found = digest(self.spark.read.schema(df.schema).parquet(where))
        if found != want:
            raise OSError(f"{folder} differs from what was to be written")
        if onto is None:
            return {"folders": [folder], "rows": found.n, "schema": df.schema.jsonValue()}
        if StructType.fromJson(onto["schema"]).simpleString() != df.schema.simpleString():
            raise ValueError(f"{folder} has other columns than the table that it is added to")
        return {"folders": [*onto["folders"], folder], "rows": onto["rows"] + found.n, "schema": onto["schema"]}

    def _file(self, version: int) -> str:
        return f"{self.where}/log/{version:020d}.json"

    def _point(self, entry: dict) -> None:
        """Creates the log file of a version, whole and only if there is none."""
        final, staged = self._file(entry["version"]), f"{self.where}/log/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(staged), False)
        try:
            out.write(json.dumps(entry, sort_keys=True).encode())
            out.close()
            if not self._linked(staged, final):
                raise Conflict(f"version {entry['version']} was committed by another writer")
        finally:
            self._fs.delete(self._path(staged), False)

    def _linked(self, staged: str, final: str) -> bool:
        """Gives the staged file its name unless that is taken: by a hard link on local disks, by a rename that does not overwrite elsewhere."""
        jvm = self.spark._jvm
        if self._fs.getScheme() == "file":
            local = lambda x: jvm.java.nio.file.Paths.get(self._path(x).toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            try:
                jvm.java.nio.file.Files.createLink(local(final), local(staged))
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(final).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(staged), self._path(final), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


ENTRY = "review_id string, decision string, note string, author string, revision long"


class DecisionLog:
    """An append-only table of decisions in a store, for several writers at a time.

    cases: review_id of the frozen evidence.  A writer reads at a version, decides, and submits with that version.
    Every submission is checked as a whole and committed as a whole, or not at all.
    """

    def __init__(self, store: Store, cases: DataFrame, allowed: tuple[str, ...]):
        self.store, self.cases, self.allowed = store, cases.select("review_id").distinct(), allowed

    def rows(self, version: int | None = None) -> DataFrame:
        version = self.store.version() if version is None else version
        if "decisions" not in self.store.entry(version)["tables"]:
            return self.store.spark.createDataFrame([], ENTRY)
        return self.store.read("decisions", version)

    def state(self, version: int | None = None) -> DataFrame:
        """Every case with its latest decision (PENDING if none), its author and revision."""
        last = self.rows(version).groupBy(F.col("review_id").alias("of")).agg(F.max_by(F.struct("decision", "author", "revision"), "revision").alias("d"))
        return self.cases.join(last, F.col("review_id") == F.col("of"), "left").select("review_id", F.coalesce("d.decision", F.lit("PENDING")).alias("decision"), "d.author", "d.revision")

    def problems(self, decisions: DataFrame) -> DataFrame:
        """review_id, problem: DUPLICATE, UNKNOWN_CASE or INVALID_DECISION."""
        from annolith.operators.review import validate_decisions

        return validate_decisions(self.cases, decisions, self.allowed).where("problem <> 'MISSING'")

    def submit(self, decisions: DataFrame, author: str, read_at: int) -> DataFrame:
        """review_id, decision, status, other, revision for each submitted decision (review_id, decision, note).

        COMMITTED: all are in the log as ``revision``.  REFUSED (other: the problem) or CONFLICT (other: what another writer has decided for the
        case since ``read_at``): none is.  HELD_BACK: nothing is wrong with this one, but with another of the same submission.
        If others have committed meanwhile, but for other cases, the submission is committed on top of theirs.
        """
        own = decisions.select("review_id", "decision", "note")
        wrong = self.problems(own).groupBy(F.col("review_id").alias("of")).agg(F.array_join(F.array_sort(F.collect_set("problem")), "|").alias("other"))
        if not wrong.isEmpty():
            return self._told(own, wrong, "REFUSED")
        while True:
            now = self.store.version()
            since = self.rows(now).where(F.col("revision") > read_at).groupBy(F.col("review_id").alias("of")).agg(F.max_by("decision", "revision").alias("other"))
            clash = own.select("review_id").join(since, F.col("review_id") == F.col("of")).select("of", "other")
            if not clash.isEmpty():
                return self._told(own, clash, "CONFLICT")
            try:
                version = self.store.commit({"decisions": own.select("review_id", "decision", "note", F.lit(author).alias("author"), F.lit(now + 1).cast("long").alias("revision"))}, now, note=f"decisions of {author}", append=("decisions",))
            except Conflict:  # another writer was faster: look at what it has decided
                continue
            return own.select("review_id", "decision", F.lit("COMMITTED").alias("status"), F.lit(None).cast("string").alias("other"), F.lit(version).cast("long").alias("revision"))

    @staticmethod
    def _told(own: DataFrame, found: DataFrame, status: str) -> DataFrame:
        told = own.join(found, F.col("review_id") == F.col("of"), "left")
        return told.select("review_id", "decision", F.when(F.col("of").isNull(), "HELD_BACK").otherwise(status).alias("status"), "other", F.lit(None).cast("long").alias("revision"))
