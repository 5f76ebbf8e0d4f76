"""Plans of the steps that grew faster than their input, and that what replaced them says the same."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from annolith.operators import duplicates, matching, parse, sweep, tracking
from annolith.plans import catalogue
from annolith.sources.fixtures import ground_truth, line_boxes, predictions
from annolith.sources.work import Work
from annolith.streaming import tracker


def plan(df) -> str:
    """The plan before any of it has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_multiplied_hashes_are_not_broadcast(spark):
    hashes = spark.range(2000).select(F.col("id").alias("key"), F.expr("xxhash64(id) & 4611686018427387903L").alias("hash"))
    got = plan(duplicates.near_representatives(hashes))
    assert "SortMergeJoin" in got and "Broadcast" not in got


def test_lines_are_parsed_once_under_filters(spark):
    lines = spark.range(10).select("id", F.lit(1).alias("n"), F.concat(F.lit("1 0.5 0.5 0.1 0."), F.col("id").cast("string")).alias("line"))
    parsed = parse.parse_lines(lines)
    for df in (parsed.where("class_id is not null").groupBy("size_category").count(), parse.suspicious_boxes(parsed), parse.annotation_issues(parsed, "id", "n")):
        got = df._jdf.queryExecution().optimizedPlan().toString()
        assert got.count("split(") == 1, got


@pytest.fixture(scope="module")
def boxes(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the tables are not here")
    return ground_truth(spark, data), predictions(spark, data)


def shuffles(spark, make) -> int:
    """How often a plan without broadcasts shuffles rows, shuffles that are used again counted once."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        return plan(make()).count("- Exchange hashpartitioning")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_boxes_are_shuffled_by_image_alone(spark, boxes):
    assert shuffles(spark, lambda: sweep.scored_predictions(*boxes)) <= 2
    assert shuffles(spark, lambda: matching.difficulty(*boxes)) <= 3


def line_item_plans(spark, monkeypatch, name) -> list[str]:
    """The plans of all tables that a query writes on its way, and its own."""
    seen, write = [], Work.table
    monkeypatch.setattr(Work, "table", lambda self, df, *a, **b: seen.append(plan(df)) or write(self, df, *a, **b))
    own = plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
    return [*seen, own]


@pytest.mark.parametrize("name", ["metric_deltas", "model_selection", "precision_floor", "policy_select", "matched_cost_pair"])
def test_both_curves_come_from_one_shuffle_of_line_items(spark, boxes, monkeypatch, name):
    got = "\n".join(line_item_plans(spark, monkeypatch, name))
    assert got.count("Exchange hashpartitioning(l_orderkey") == 1, got
    assert got.count("FileScan parquet [l_") == 1 and got.count("- Sort [l_orderkey") == 1
    assert "l_extendedprice" not in got


def test_lines_give_the_boxes_of_the_tables(spark, boxes):
    """Also where an order has copies of a line, some of them the same in all that boxes come from."""
    lines = line_boxes(spark, "/root/testdata/sf0.001")
    tables = {"gt": boxes[0], "A": boxes[1], "B": predictions(spark, "/root/testdata/sf0.001", "B")}
    for name, table in tables.items():
        got = lines.select("img", f"{name}.*")
        assert got.columns == table.columns and got.exceptAll(table).isEmpty() and table.exceptAll(got).isEmpty()


def test_boxes_without_an_image_count_but_never_match(spark):
    g, p = "img long, j int, c int, x1 double, y1 double, x2 double, y2 double", "img long, i int, c int, s double, x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(None, 0, 1, 0.0, 0.0, 9.0, 9.0), (1, 0, 1, 0.0, 0.0, 9.0, 9.0), (2, 0, 0, 0.0, 0.0, 9.0, 9.0)], g)
    pred = spark.createDataFrame([(None, 0, 1, 0.5, 0.0, 0.0, 9.0, 9.0), (1, 0, 1, 0.5, 0.0, 0.0, 9.0, 9.0), (3, 0, 1, 0.25, 0.0, 0.0, 9.0, 9.0)], p)
    got = {(r.scope, r.threshold): (r.tp, r.fp, r.fn, r.fp_per_image) for r in sweep.sweep(gt, pred).collect()}
    assert got == {("1", 0.5): (1, 1, 1, 0.25), ("1", 0.25): (1, 2, 1, 0.5), ("Overall", 0.5): (1, 1, 2, 0.25), ("Overall", 0.25): (1, 2, 2, 0.5)}


def test_rows_without_a_track_do_not_meet_in_one_task(spark):
    rows = spark.createDataFrame([(k, 0, 0, k % 3, 1, None, 1) for k in range(50)], "img long, j int, scene long, object int, gc int, track long, oc int")
    got = plan(tracking.identity_changes(rows))
    assert "hashpartitioning(track#" in got and ", _w" in got.split("hashpartitioning(track#")[1].split(")")[0], got
    assert not tracking.identity_changes(rows).where("switch or transfer or scene_transfer").count()


def test_only_contested_images_are_solved_one_by_one(spark):
    """Images in which an object's best prediction is another's too still give the assignment of largest total overlap."""
    box = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    gt = [(1, 0, 0, *box(0)), (1, 1, 0, *box(4)), (2, 0, 0, *box(0)), (2, 1, 0, *box(50))]
    pred = [(1, 0, 0, 0.5, *box(3)), (1, 1, 0, 0.5, *box(8)), (2, 0, 0, 0.5, *box(50)), (2, 1, 0, 0.5, *box(1))]
    g, p = "img long, j int, c int, x1 double, y1 double, x2 double, y2 double", "img long, i int, c int, s double, x1 double, y1 double, x2 double, y2 double"
    got = {(r.img, r.i, r.j) for r in matching.hungarian(spark.createDataFrame(gt, g), spark.createDataFrame(pred, p), 0.1).collect()}
    assert got == {(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0)}


def test_frames_of_a_stream_make_no_tables(monkeypatch):
    """A frame costs no pandas table of its own."""

    class Held:
        def __init__(self):
            self.kept = {}

        exists = lambda self: bool(self.kept)
        get = lambda self: self.kept[None]
        update = lambda self, v: self.kept.update({None: v})
        updateValue = lambda self, k, v: self.kept.update({k: v})
        iterator = lambda self: iter(self.kept.items())
        clear = lambda self: self.kept.clear()
        listTimers = lambda self: []
        registerTimer = lambda self, at: None

    own = tracker.Associate(tracker.TrackerConfig())
    own.handle, own.last, own.open = Held(), Held(), Held()
    rows = pd.DataFrame([(f, pd.Timestamp(f, unit="s"), i, 0.9, 30.0 * i, 0.0, 30.0 * i + 10, 10.0, False) for f in range(3) for i in range(2)], columns=["frame", "ts", "i", "s", "x1", "y1", "x2", "y2", "cut"])
    monkeypatch.setattr(pd.DataFrame, "groupby", lambda *a, **b: pytest.fail("a table for each frame"))
    (got,) = own.handleInputRows((5,), iter([rows]), None)
    assert got[["event", "track", "frame", "i", "seen"]].values.tolist() == [["seen", i + 1, f, i, f + 1] for f in range(3) for i in range(2)]
