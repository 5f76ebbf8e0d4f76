"""Versioned stores and decision logs: whole sets, lost races, failures halfway, conflicts."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from annolith.operators import audit
from annolith.sources.versions import Conflict, DecisionLog, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sets_are_published_whole(spark, store, tmp_path):
    assert store.version() == 0
    with pytest.raises(KeyError):
        store.read("a")
    assert store.commit({"a": spark.range(3), "b": spark.range(2)}, 0, "first") == 1
    bad = spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("broken"))).otherwise("id").cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"a": spark.range(9), "b": bad}, 1)
    assert store.version() == 1 and store.read("a").count() == 3  # readers stay on the old set
    assert len(os.listdir(tmp_path / "store" / "data")) == 1  # and nothing of the new one is left
    store.commit({"b": spark.range(7)}, 1, "b alone")
    assert (store.read("a").count(), store.read("b").count(), store.read("b", 1).count()) == (3, 7, 2)
    store.commit({}, 2, drop=("a",))
    with pytest.raises(KeyError):
        store.read("a")
    assert store.restore(1, 3) == 4 and rows(store.read("b")) == [(0,), (1,)]
    assert rows(store.history().select("version", "table", "n_rows")) == [(1, "a", 3), (1, "b", 2), (2, "a", 3), (2, "b", 7), (3, "b", 7), (4, "a", 3), (4, "b", 2)]
    assert not [f for f in os.listdir(tmp_path / "store" / "log") if f.endswith(".json") is False and not f.endswith(".crc")]


def test_a_copy_that_differs_is_not_published(spark, store):
    unsteady = spark.range(100).select(F.rand().alias("x"), F.monotonically_increasing_id().alias("id")).select((F.col("x") * F.expr("reflect('java.lang.System', 'nanoTime')").cast("double")).alias("x"))
    with pytest.raises(OSError, match="differs"):
        store.commit({"a": unsteady}, 0)
    assert store.version() == 0


def test_only_one_of_many_writers_gets_a_version(spark, store):
    told = []

    def write(k):
        try:
            told.append(("won", k, store.commit({"a": spark.range(k, k + 1)}, 0)))
        except Conflict:
            told.append(("lost", k, None))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (won,) = [k for how, k, _ in told if how == "won"]
    assert len(told) == 4 and store.version() == 1 and rows(store.read("a")) == [(won,)]


def test_additions_and_compaction(spark, store):
    part = lambda n, name="id": spark.range(n).toDF(name)
    for k in range(3):
        store.commit({"a": part(k + 1)}, k, append=("a",))
    assert rows(store.read("a")) == [(0,), (0,), (0,), (1,), (1,), (2,)] and len(store.entry(3)["tables"]["a"]["folders"]) == 3
    with pytest.raises(ValueError):
        store.commit({"a": part(2, "other")}, 3, append=("a",))
    store.compact("a", 3)
    assert len(store.entry(4)["tables"]["a"]["folders"]) == 1 and store.read("a").count() == 6
    store.commit({"none": part(0)}, 4)
    assert store.read("none").count() == 0


def test_decisions_of_two_writers(spark, store):
    cases = spark.createDataFrame([(x,) for x in "abcd"], "review_id string")
    log = DecisionLog(store, cases, ("KEEP", "DROP"))
    given = lambda *r: spark.createDataFrame([(i, d, None) for i, d in r], "review_id string, decision string, note string")
    out = lambda df: rows(df.select("review_id", "decision", "status", F.coalesce("other", F.lit("-")).alias("other")))
    assert rows(log.state().select("review_id", "decision")) == [(x, "PENDING") for x in "abcd"]
    assert out(log.submit(given(("a", "KEEP"), ("b", "KEEP")), "x", 0)) == [("a", "KEEP", "COMMITTED", "-"), ("b", "KEEP", "COMMITTED", "-")]
    assert out(log.submit(given(("b", "DROP"), ("c", "DROP")), "y", 0)) == [("b", "DROP", "CONFLICT", "KEEP"), ("c", "DROP", "HELD_BACK", "-")]
    assert store.version() == 1
    assert out(log.submit(given(("c", "DROP")), "y", 0)) == [("c", "DROP", "COMMITTED", "-")]  # on top of what others have decided for other cases
    assert out(log.submit(given(("b", "DROP")), "y", 2)) == [("b", "DROP", "COMMITTED", "-")]  # having read x's decision
    assert out(log.submit(given(("d", "KEEP"), ("d", "KEEP"), ("e", "KEEP"), ("a", "MAYBE")), "y", 3)) == [("a", "MAYBE", "REFUSED", "INVALID_DECISION"), ("d", "KEEP", "REFUSED", "DUPLICATE"), ("d", "KEEP", "REFUSED", "DUPLICATE"), ("e", "KEEP", "REFUSED", "UNKNOWN_CASE")]
    assert rows(log.state().select("review_id", "decision", F.coalesce("author", F.lit("-")), F.coalesce("revision", F.lit(0)))) == [("a", "KEEP", "x", 1), ("b", "DROP", "y", 3), ("c", "DROP", "y", 2), ("d", "PENDING", "-", 0)]
    assert rows(log.state(1).select("review_id", "decision")) == [("a", "KEEP"), ("b", "KEEP"), ("c", "PENDING"), ("d", "PENDING")]


def test_fingerprints_tell_contents_apart(spark):
    contents = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), (None, None), ("", ""), ("N;", None), ("1:a", None), ("a", "1:a")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(contents)], "k int, a string, b string")
    assert audit.fingerprint(df, "k", "a", "b").select("sha256").distinct().count() == len(contents)
    nested = spark.createDataFrame([(1, ["a, b"], bytearray(b"x")), (2, ["a", "b"], bytearray(b"x")), (3, None, bytearray(b"x")), (4, [], None)], "k int, a array<string>, b binary")
    assert audit.fingerprint(nested, "k", "a", "b").select("sha256").distinct().count() == 4
