"""One-to-one matching of predictions and ground truth.

Every greedy matching here is a fold over the candidate edges of one image in a
total order: an edge is taken if neither end is taken.  Edges come from an
equi-join on image (and class), are gathered per image (their number is bounded by the boxes of
one image) and folded by ``aggregate`` inside the JVM.  Hungarian assignment has no such form and runs as a pandas UDF over the pairs of each image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.geometry import iou, iou_floored


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def edges(gt: DataFrame, pred: DataFrame, least: float, same_class: bool | None = True, measure: str | None = None) -> DataFrame:
    """img, i, j, gc, pc, s, iou of the pairs of an image at or above ``least``; classes equal, unequal (False) or any (None)."""
    g, p = prefixed(gt, "g_"), prefixed(pred, "p_")
    # Classes are compared within the measure: as a key of the join they would have boxes that lie together by image shuffled again.
    test = {True: "g_c = p_c", False: "g_c <> p_c", None: "true"}[same_class]
    joined = g.join(p, F.expr("g_img = p_img")).withColumn("iou", F.expr(f"case when {test} then {measure or iou('g_', 'p_')} end"))
    return joined.where(F.col("iou") >= least).select(F.col("g_img").alias("img"), F.col("p_i").alias("i"), F.col("g_j").alias("j"), F.col("g_c").alias("gc"), F.col("p_c").alias("pc"), F.col("p_s").alias("s"), "iou")


def greedy(candidates: DataFrame, order: list[Column], keys: tuple[str, ...] = ("img",), carry: tuple[str, ...] = ("iou",)) -> DataFrame:
    """keys, i, j and the carried columns of the edges taken in this order (each i and each j once)."""
    return taken_edges(candidates, order, keys, carry).select(*keys, F.explode("m").alias("m")).select(*keys, "m.i", "m.j", *[f"m.{c}" for c in carry])


def taken_edges(candidates: DataFrame, order: list[Column], keys: tuple[str, ...] = ("img",), carry: tuple[str, ...] = ("iou",)) -> DataFrame:
    """keys, m: what ``greedy`` takes as one array for each image."""
    fields = [*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("i").alias("i"), F.col("j").alias("j"), *[F.col(c).alias(c) for c in carry]]
    ranked = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("e"))
    return ranked.select(*keys, taken_of("e").alias("m"))


def taken_of(ranked: str) -> Column:
    """Of an array of edges in order those whose ends (i and j) are both free when their turn comes."""
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["i"] == x["i"]) | (t["j"] == x["j"]))
    return F.aggregate(ranked, F.filter(ranked, lambda x: F.lit(False)), lambda t, x: F.when(free(t, x), F.concat(t, F.array(x))).otherwise(t))


def match(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """img, i, j, iou: predictions by falling score (then index) each take the free ground truth of their class of largest overlap (then lowest index)."""
    return greedy(edges(gt, pred, least), [-F.col("s"), F.col("i"), -F.col("iou"), F.col("j")])


def leftovers(boxes: DataFrame, taken: DataFrame, index: str) -> DataFrame:
    return boxes.join(taken.select(F.col("img").alias("t_img"), F.col(index).alias("t_k")), (F.col("img") == F.col("t_img")) & (F.col(index) == F.col("t_k")), "left_anti")


def confusions(gt: DataFrame, pred: DataFrame, matches: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of unequal class among what ``matches`` leaves; ties of overlap go to the highest indices."""
    found = edges(leftovers(gt, matches, "j"), leftovers(pred, matches, "i"), least, same_class=False)
    return greedy(found, [-F.col("iou"), -F.col("j"), -F.col("i")])


def linked(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """img, i, j, iou, s, outcome: the pairs of ``match`` (CORRECT) and of ``confusions`` among what it leaves (CLASS_CONFUSION).

    The edges of an image, of equal and unequal classes, are gathered once and folded twice, the second time from what the first has taken.
    """
    return _linked(edges(gt, pred, least, same_class=None), least).select("img", F.explode("t").alias("t")).select("img", "t.i", "t.j", "t.iou", "t.s", "t.outcome")


def _linked(pairs: DataFrame, least: float, **more: Column) -> DataFrame:
    """img, t: the pairs that ``linked`` takes as one array for each image; more: aggregates of all pairs of an image."""
    same, close = F.col("gc") == F.col("pc"), F.col("iou") >= least
    fields = [F.col(c).alias(c) for c in ("i", "j", "iou", "s")]
    rows = lambda test, *order: F.sort_array(F.collect_list(F.when(test, F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *fields))))
    ranked = pairs.groupBy("img").agg(rows(same & close, -F.col("s"), F.col("i"), -F.col("iou"), F.col("j")).alias("e"), rows(~same & close, -F.col("iou"), -F.col("j"), -F.col("i")).alias("x"), *[v.alias(k) for k, v in more.items()])
    short = lambda x, outcome: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["iou"].alias("iou"), x["s"].alias("s"), F.lit(outcome).alias("outcome"))

    def fold(edges_: str, start: Column, outcome: str) -> Column:
        free = lambda taken, x: ~F.exists(taken, lambda t: (t["i"] == x["i"]) | (t["j"] == x["j"]))
        return F.aggregate(edges_, start, lambda t, x: F.when(free(t, x), F.concat(t, F.array(short(x, outcome)))).otherwise(t))

    none = F.transform(F.expr("filter(e, x -> false)"), lambda x: short(x, "CORRECT"))
    both = ranked.select("img", "x", fold("e", none, "CORRECT").alias("m"), *more)
    return both.select("img", fold("x", F.col("m"), "CLASS_CONFUSION").alias("t"), *more)


def object_outcomes(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """img, j, c, outcome (CORRECT, CLASS_CONFUSION, MISSED), i, iou of every ground truth."""
    l = prefixed(linked(gt, pred, least), "l_")
    return gt.join(l, F.expr("img = l_img and j = l_j"), "left").select("img", "j", "c", F.coalesce("l_outcome", F.lit("MISSED")).alias("outcome"), F.col("l_i").alias("i"), F.col("l_iou").alias("iou"))


def failure_events(gt: DataFrame, pred: DataFrame, active: float = 0.25, weak: float = 0.5, floor: float = 0.001, least: float = 0.5) -> DataFrame:
    """Events of each image: img, event, i, j, iou.

    FALSE_NEGATIVE (with the confused prediction, if any), LOW_CONFIDENCE (a missed object that a
    prediction below ``active`` fits, or a correct match below ``weak``), FALSE_POSITIVE, CLASS_CONFUSION, MULTIPLE_OBJECT_SCENE.
    """
    hot = pred.where(F.col("s") >= active)
    cold = pred.where((F.col("s") >= floor) & (F.col("s") < active))
    pairs = linked(gt, hot, least)
    m, x = pairs.where("outcome = 'CORRECT'"), pairs.where("outcome = 'CLASS_CONFUSION'")
    missed, extra = leftovers(gt, m, "j"), leftovers(hot, m, "i")
    low = match(missed, cold, least)
    xs = prefixed(x, "x_")
    part = lambda df, event, *cols: df.select("img", F.lit(event).alias("event"), *cols)
    none = F.lit(None)
    events = [
        part(missed.join(xs, F.expr("img = x_img and j = x_j"), "left"), "FALSE_NEGATIVE", F.col("x_i").alias("i"), "j", F.coalesce("x_iou", F.lit(0.0)).alias("iou")),
        part(low, "LOW_CONFIDENCE", "i", "j", "iou"),
        part(m.where(F.col("s") < weak), "LOW_CONFIDENCE", "i", "j", "iou"),
        part(extra.join(xs, F.expr("img = x_img and i = x_i"), "left"), "FALSE_POSITIVE", "i", F.col("x_j").alias("j"), F.coalesce("x_iou", F.lit(0.0)).alias("iou")),
        part(x, "CLASS_CONFUSION", "i", "j", "iou"),
        part(gt.groupBy("img").count().where("count > 1"), "MULTIPLE_OBJECT_SCENE", none.cast("int").alias("i"), none.cast("int").alias("j"), F.lit(0.0).alias("iou")),
    ]
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return out


def nearest_prediction(gt: DataFrame, pred: DataFrame, missed: DataFrame) -> DataFrame:
    """For each missed object the prediction of any class with the largest overlap (then score, then lowest index)."""
    objects = gt.join(missed.select(F.col("img").alias("m_img"), F.col("j").alias("m_j")), F.expr("img = m_img and j = m_j"), "left_semi")
    near = prefixed(objects, "g_").join(prefixed(pred, "p_"), F.expr("g_img = p_img")).withColumn("iou", F.expr(iou("g_", "p_")))
    best = near.groupBy(F.col("g_img").alias("img"), F.col("g_j").alias("j")).agg(F.max_by(F.struct("p_i", "iou", "p_c"), F.struct("iou", "p_s", -F.col("p_i"))).alias("b"))
    return best.select("img", "j", F.col("b.p_i").alias("i"), F.col("b.iou").alias("iou"), F.col("b.p_c").alias("predicted_class"))


def difficulty(gt: DataFrame, pred: DataFrame, active: float = 0.25, local: float = 0.1, least: float = 0.5) -> DataFrame:
    """img, j, c, category, hard, duplicates: six categories of each ground truth.

    Correct matches come first (EASY_CORRECT at or above ``active``, else LOW_CONFIDENCE_CORRECT), then confusions,
    then one-to-one localisation failures (overlap from ``local`` to below ``least``); the rest is MATCH_COMPETITION
    where some prediction of the class overlaps by ``local``, else MISSED_NO_CORRECT_CLASS_PROPOSAL.
    """
    # All pairs of an image are gathered once, as arrays that every step reads; nothing is joined by anything but the image.
    pairs = edges(gt, pred, 0.0, same_class=None).where(f"gc = pc or iou >= {least}D")
    own = F.when(F.col("gc") == F.col("pc"), F.struct((-F.col("s")).alias("o"), F.col("i").cast("long").alias("i"), (-F.col("iou")).alias("v"), F.col("j").cast("long").alias("j")))
    told = _linked(pairs, least, l=F.sort_array(F.collect_list(own)))
    # A prediction looks at its best free object only, and passes if that one overlaps too little or too much.
    told = told.select("img", "t", "l", localisation("filter(l, x -> not exists(t, y -> y.i = x.i or y.j = x.j))", local, least).alias("close"))
    # What is left of active predictions goes to the correctly matched object that it overlaps most.
    spare = f"filter(l, x -> -x.o >= {active}D and -x.v >= {least}D and not exists(t, y -> y.i = x.i) and not exists(close, y -> y.i = x.i) and exists(t, y -> y.j = x.j and y.outcome = 'CORRECT'))"
    owners = f"aggregate({spare}, named_struct('last', bigint(null), 'js', cast(array() as array<bigint>)), (a, x) -> if(a.last <=> x.i, a, named_struct('last', x.i, 'js', concat(a.js, array(x.j)))), a -> a.js)"
    told = told.select(F.col("img").alias("t_img"), "t", "l", "close", F.expr(owners).alias("owners"))
    category = f"""case when exists(t, y -> y.j = j_ and y.outcome = 'CORRECT' and y.s >= {active}D) then 'EASY_CORRECT' when exists(t, y -> y.j = j_ and y.outcome = 'CORRECT') then 'LOW_CONFIDENCE_CORRECT'
        when exists(t, y -> y.j = j_) then 'CLASS_CONFUSION' when exists(close, y -> y.j = j_) then 'LOCALIZATION_FAILURE' when exists(l, y -> y.j = j_ and -y.v >= {local}D) then 'MATCH_COMPETITION' else 'MISSED_NO_CORRECT_CLASS_PROPOSAL' end"""
    all_ = gt.select("img", "j", "c", F.col("j").cast("long").alias("j_")).join(told, F.expr("img = t_img"), "left")
    out = all_.select("img", "j", "c", F.expr(category).alias("category"), F.expr("coalesce(bigint(size(filter(owners, y -> y = j_))), 0L)").alias("duplicates"))
    return out.withColumn("hard", (F.col("category") != "EASY_CORRECT") | (F.col("duplicates") > 0))


def localisation(free: str, local: float, least: float) -> Column:
    """Array of i, j: predictions by falling score take their best free object, if local <= iou < least.

    free: expression of an array of pairs (o: -s, i, v: -iou, j) sorted by all of these, so that the pairs of a prediction lie together, the best first.
    """
    step = f"if(a.last <=> x.i or exists(a.taken, y -> y.j = x.j), a, named_struct('last', x.i, 'taken', if(x.v <= -{local}D and x.v > -{least}D, concat(a.taken, array(named_struct('i', x.i, 'j', x.j))), a.taken)))"
    return F.expr(f"aggregate({free}, named_struct('last', bigint(null), 'taken', cast(array() as array<struct<i:bigint,j:bigint>>)), (a, x) -> {step}, a -> a.taken)")


def image_difficulty(objects: DataFrame, images: DataFrame) -> DataFrame:
    """img, n_objects, n_hard, n_hard1, crowded, multi_class, tier (0 to 3) of every image, also of those without objects."""
    rank = F.when(F.col("category") == "MISSED_NO_CORRECT_CLASS_PROPOSAL", 3).when(F.col("category").isin("CLASS_CONFUSION", "MATCH_COMPETITION"), 2).when(F.col("hard"), 1).otherwise(0)
    g = objects.groupBy(F.col("img").alias("o_img")).agg(F.count("*").alias("n_objects"), F.count_if("hard").alias("n_hard"), F.count_if(F.col("hard") & (F.col("c") == 1)).alias("n_hard1"), F.count_distinct("c").alias("n_classes"), F.max(rank).alias("tier"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = images.join(g, F.col("img") == F.col("o_img"), "left").select("img", zero("n_objects"), zero("n_hard"), zero("n_hard1"), zero("n_classes"), zero("tier"))
    return out.select("img", "n_objects", "n_hard", "n_hard1", (F.col("n_objects") >= 3).alias("crowded"), (F.col("n_classes") > 1).alias("multi_class"), "tier")


TIE = 1e-9


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (rows <= columns): shortest augmenting paths with potentials, O(n^3)."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for r in range(n):
        reach, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, path = r, -1
        base = 0.0
        while True:
            slack = base + cost[at] - row_price[at] - col_price
            better = ~done & (slack < reach)
            reach[better], back[better] = slack[better], path
            path = int(np.argmin(np.where(done, np.inf, reach)))
            base = reach[path]
            done[path] = True
            if owner[path] < 0:
                break
            at = int(owner[path])
        seen = done.copy()
        seen[path] = False
        row_price[r] += base
        for c in np.flatnonzero(seen):
            row_price[owner[c]] += base - reach[c]
            col_price[c] -= base - reach[c]
        while path >= 0:
            before = int(back[path])
            owner[path] = r if before < 0 else owner[before]
            path = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def hungarian(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """img, i, j, iou: the assignment of largest total overlap of each image, of which pairs below ``least`` are dropped afterwards.

    Of equal totals the one that keeps the order of the indices is taken: TIE * i / (i + 1) * j / (j + 1) counts on top of a pair's overlap.
    """
    # Pairs without overlap add nothing to a total: they are left out, unless they would be told.
    pairs = edges(gt, pred, -1.0, same_class=None, measure=iou_floored("g_", "p_")).select("img", "i", "j", "iou")
    pairs = pairs.where("iou > 0") if least > 0 else pairs

    kinds = dict(pairs.dtypes)
    worth = F.expr(f"iou + {TIE}D * (i / (i + 1D)) * (j / (j + 1D))")
    frames = pairs.groupBy("img").agg(F.collect_list(F.struct("i", "j", "iou", worth.alias("v"))).alias("e"))  # the pairs of one image
    # Where each object's best prediction is its own and no other object's, no assignment is worth more; only other images are solved.
    frames = frames.withColumn("top", F.expr("filter(e, x -> not exists(e, y -> y.j = x.j and y.i <> x.i and y.v >= x.v))"))
    frames = frames.withColumn("clear", F.expr("size(top) = size(array_distinct(transform(e, x -> x.j))) and size(top) = size(array_distinct(transform(top, x -> x.i)))"))
    frames = frames.select("img", "clear", "top", *[F.expr(f"if(clear, filter(transform(e, x -> x.{c}), x -> false), transform(e, x -> x.{c}))").alias(c) for c in ("i", "j", "iou")])

    @F.pandas_udf(f"array<struct<i:{kinds['i']},j:{kinds['j']},iou:double>>")
    def solve(i: pd.Series, j: pd.Series, iou: pd.Series) -> pd.Series:
        out = []
        for a, b, v in zip(i, j, iou, strict=True):
            if not len(a):
                out.append([])
                continue
            cols, at_col = np.unique(a, return_inverse=True)
            rows, at_row = np.unique(b, return_inverse=True)
            table = np.zeros((len(rows), len(cols)))
            table[at_row, at_col] = v
            value = table.copy()
            value[at_row, at_col] += TIE * (cols / (cols + 1))[at_col] * (rows / (rows + 1))[at_row]
            flip = len(rows) > len(cols)
            best = assign(-value.T if flip else -value)
            other = np.arange(len(best))
            r, c = (best, other) if flip else (other, best)
            out.append([{"i": int(cols[y]), "j": int(rows[x]), "iou": float(table[x, y])} for x, y in zip(r, c, strict=True)])
        return pd.Series(out)

    clear = F.transform("top", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["iou"].alias("iou")))
    found = frames.withColumn("m", solve("i", "j", "iou")).select("img", F.explode(F.when(F.col("clear"), clear).otherwise(F.col("m"))).alias("m"))
    return found.select("img", "m.i", "m.j", "m.iou").where(F.col("iou") >= least)
