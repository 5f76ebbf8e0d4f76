"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base figures are computed for every text.  The rules are then asked one after
another, the one that rejects most texts per unit of cost first; a text
rejected by one rule is not shown to the next.  Cost and selectivity of each rule are
estimated in one aggregation over a sample (about SAMPLE rows, picked by a hash of doc_id, so that reruns agree), which fixes the
order alone: the verdict is the same under every order.  A rule's cost is the mean number of characters that it looks at
for a row of the sample, times what a character costs it; the base figures are already there and cost 1 each.

Edge cases: null text has no words (all figures 0, base_failed); repeated rows
are each judged; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD

SAMPLE = 2000
WINDOW = 5

#: Each rule rejects a text where it holds; they read the text and the base figures.
RULES = {
    "symbols": "100 * n_symbols > 25 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "shouting": "2 * length(regexp_replace(text, '[^A-Z]', '')) > word_chars",
    "exclamations": "10 * regexp_count(text, '!!') > n_words",
    "letters": "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < word_chars",
}
#: Cost of each rule for one row: base figures read, or characters read times the work for each
#: (a search for a literal: 1; a class of ASCII characters taken out: 2; a Unicode class: 4).
COSTS = {
    "symbols": "2",
    "word_length": "2",
    "repeated_lines": "2",
    "shouting": "1 + 2 * length(text)",
    "exclamations": "1 + length(text)",
    "letters": "1 + 4 * length(text)",
}


def _repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows found twice or more.

    Windows are compared by 64-bit hashes of their words.  Most texts repeat none, which one hash set
    tells; in the others windows are sorted by hash and neighbours compared, so no step is quadratic.
    """
    n = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    windows = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(WINDOW)])
    hashes = F.transform(windows, lambda w: F.xxhash64(w))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("at")))
        # transform over a one-element array binds the sorted array once for all its uses
        found = F.transform(F.array(ranked), lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])))[0]
        places = F.sort_array(F.transform(found, lambda x: x["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")), lambda a: a["total"])

    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), count(h)).otherwise(F.lit(0)))[0]


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for space in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(space), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    words = F.array_remove(F.split(text, SPACE), "")
    one = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        F.length(bare).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0].alias("lines"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))[0].alias("words"),
    )
    out = one.select("doc_id", "text", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"), F.col("lines.n").cast("long").alias("n_lines"), F.col("words.r").cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def rule_order(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, share rejected, cost of a row) on a sample, best rejection per cost first; texts that fail the base are not asked."""
    every = max(1, docs.count() // max(1, sample))
    drawn = base_figures(docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).where("not base_failed")
    figures = [F.count("*").alias("n")]
    for name, rule in RULES.items():
        figures += [F.count_if(F.expr(rule)).alias(f"{name}_rejected"), F.avg(F.expr(COSTS[name]).cast("double")).alias(f"{name}_cost")]
    row = drawn.agg(*figures).first()
    found = [(name, row[f"{name}_rejected"] / max(1, row.n), row[f"{name}_cost"] or 1.0) for name in RULES]
    return sorted(found, key=lambda f: (-f[1] / f[2], f[2], f[0]))


def cascade(order: list[str]) -> Column:
    """True where no rule rejects; CASE asks no rule after the first that does."""
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        verdict = verdict.when(F.expr(RULES[name]), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    figures = base_figures(docs)
    order = [name for name, _, _ in rule_order(docs)]
    return figures.withColumn("kept", cascade(order)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
