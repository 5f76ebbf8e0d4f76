"""Named queries over versioned stores, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolith.plans.registry import query
from annolith.sources.tables import tables
from annolith.sources.versions import Conflict, DecisionLog, Store
from annolith.sources.work import Work


def _summaries(docs, labels, least: int):
    by_lang = docs.where(F.col("doc_id") >= least).groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    by_quality = labels.where(F.col("doc_id") >= least).groupBy(F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    return {"languages": by_lang, "qualities": by_quality}


@query
def store_publish(spark, sf_dir):
    """Two tables published together; a second set whose last table fails leaves readers on the first, a third replaces it, and the first is restored."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    store = Store(spark, f"{Work(spark, 'store').path}/set")
    first = store.commit(_summaries(docs, labels, 0), 0, "first")
    broken = _summaries(docs, labels, 10)
    broken["qualities"] = broken["qualities"].withColumn("n", F.when(F.col("name").isNull(), 0).otherwise(F.raise_error(F.lit("the last table fails"))).cast("long"))
    try:
        store.commit(broken, first, "broken")
    except Exception as e:
        if "the last table fails" not in str(e):
            raise
    after_failure = store.version()
    second = store.commit(_summaries(docs, labels, 10), after_failure, "second")
    third = store.restore(first, second)
    rows = [store.read(t, v).select(F.lit(v).cast("long").alias("version"), F.lit(t).alias("table"), "name", "n") for v in (after_failure, second, third) for t in ("languages", "qualities")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query
def decision_conflicts(spark, sf_dir):
    """Two writers read the same version: the second loses with rows that say so, submits the rest again, and a third touches other cases alone."""
    (labels,) = tables(spark, sf_dir, "labels")
    cases = labels.select(F.col("doc_id").cast("string").alias("review_id"))
    log = DecisionLog(Store(spark, f"{Work(spark, 'decisions').path}/log"), cases, ("KEEP", "EXCLUDE"))
    pick = lambda test, decision: labels.where(test).select(F.col("doc_id").cast("string").alias("review_id"), F.lit(decision).alias("decision"), F.lit("").alias("note"))
    turns = []

    def turn(writer, rows, read_at):
        turns.append(log.submit(rows, writer, read_at).withColumn("turn", F.lit(f"{len(turns)} {writer}")))
        return turns[-1]

    start = log.store.version()
    turn("a", pick("doc_id % 3 = 0", "KEEP"), start)
    lost = turn("b", pick("doc_id % 2 = 0", "EXCLUDE"), start)
    turn("b", lost.where("status = 'HELD_BACK'").select("review_id", "decision", F.lit("again").alias("note")), start)
    turn("c", pick("doc_id % 6 = 1", "EXCLUDE"), start)  # others have committed since, but for other cases
    turn("d", pick("doc_id % 6 = 5", "MAYBE"), log.store.version())
    state = log.state().select("review_id", "decision", F.lit("STATE").alias("status"), F.col("author").alias("other"), "revision", F.lit("state").alias("turn"))
    for t in turns:
        state = state.unionByName(t)
    return state


@query
def store_history(spark, sf_dir):
    """What the log of a store says after a lost race and after a table of two commits was compacted."""
    (labels,) = tables(spark, sf_dir, "labels")
    store = Store(spark, f"{Work(spark, 'history').path}/set")
    part = lambda k: labels.where(F.col("doc_id") % 2 == k).select("doc_id", "quality")
    store.commit({"labels": part(0)}, 0, "even")
    try:
        store.commit({"labels": part(0)}, 0, "late")
    except Conflict:
        pass
    store.commit({"labels": part(1)}, 1, "odd", append=("labels",))
    store.compact("labels", 2)
    n = store.read("labels").agg(F.count("*").alias("now"))
    return store.history().crossJoin(n).select("version", "parent", "note", F.col("table"), "n_rows", "now")  # one row


_LEAST = "select 1 as version, 0 as least union all select 2, 10 union all select 3, 0"
ORACLES = {
    "store_publish": f"select version, 'languages' as \"table\", lang as name, count(*) as n from documents, ({_LEAST}) v where doc_id >= least group by 1, 3 union all select version, 'qualities', 'quality ' || quality, count(*) from labels, ({_LEAST}) v where doc_id >= least group by 1, 3",
    "decision_conflicts": """with c as (select distinct doc_id, doc_id::varchar as review_id from labels),
 t as (select review_id, 'KEEP' as decision, 'COMMITTED' as status, null as other, 1 as revision, '0 a' as turn from c where doc_id % 3 = 0
 union all select review_id, 'EXCLUDE', case when doc_id % 3 = 0 then 'CONFLICT' else 'HELD_BACK' end, case when doc_id % 3 = 0 then 'KEEP' end, null, '1 b' from c where doc_id % 2 = 0
 union all select review_id, 'EXCLUDE', 'COMMITTED', null, 2, '2 b' from c where doc_id % 2 = 0 and doc_id % 3 <> 0
 union all select review_id, 'EXCLUDE', 'COMMITTED', null, 3, '3 c' from c where doc_id % 6 = 1
 union all select review_id, 'MAYBE', 'REFUSED', 'INVALID_DECISION', null, '4 d' from c where doc_id % 6 = 5)
 select * from t union all select review_id, case when doc_id % 3 = 0 then 'KEEP' when doc_id % 6 = 5 then 'PENDING' else 'EXCLUDE' end, 'STATE', case when doc_id % 3 = 0 then 'a' when doc_id % 2 = 0 then 'b' when doc_id % 6 = 1 then 'c' end,
  case when doc_id % 3 = 0 then 1 when doc_id % 2 = 0 then 2 when doc_id % 6 = 1 then 3 end, 'state' from c""",
    "store_history": "with n as (select count(*) as n, count(*) filter (doc_id % 2 = 0) as even from labels) select * from (select 1 as version, 0 as parent, 'even' as note, 'labels' as \"table\", even as n_rows, n as now from n union all select 2, 1, 'odd', 'labels', n, n from n union all select 3, 2, 'compacts labels', 'labels', n, n from n) q",
}
