"""Near-duplicate hashes: pairs within a Hamming distance by an equi-join on chosen chunks, and their components."""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions.text import hamming, similarity
from annolith.operators.components import components
from annolith.sources.work import Work


def sign_hash(vectors: DataFrame, key: str, vector: str, bits: int = 62) -> DataFrame:
    """key, hash: one bit for the sign of each of the first dimensions."""
    total = " + ".join(f"case when {vector}[{k}] > 0 then shiftleft(1L, {k}) else 0L end" for k in range(bits))
    return vectors.select(F.col(key).alias("key"), F.expr(total).alias("hash"))


def near_pairs(hashes: DataFrame, most: int = 8, bits: int = 62, spare: int = 3) -> DataFrame:
    """Pairs a < b whose hashes differ in at most ``most`` bits: a, b, distance, similarity.

    Distinct hashes are compared, each once, and their keys put in afterwards; for groups of many copies see ``near_components``, which names representatives alone.
    """
    one = hashes.groupBy("hash").agg(F.min("key").alias("key"))
    found = near_representatives(one.select("key", "hash"), most, bits, spare)
    near = found.select(F.col("hash_a").alias("x"), F.col("hash_b").alias("y"), "distance").unionByName(one.select(F.col("hash").alias("x"), F.col("hash").alias("y"), F.lit(0).alias("distance")))
    a, b = hashes.select(F.col("key").alias("a"), F.col("hash").alias("h_a")), hashes.select(F.col("key").alias("b"), F.col("hash").alias("h_b"))
    pairs = near.join(a, F.col("x") == F.col("h_a")).join(b, F.col("y") == F.col("h_b")).where("x <> y or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", F.expr(similarity("distance")).alias("similarity"))


def near_representatives(hashes: DataFrame, most: int = 8, bits: int = 62, spare: int = 3) -> DataFrame:
    """a, b, hash_a, hash_b, distance of the pairs of distinct hashes (each with one key) that differ in at most ``most`` bits; a < b.

    Of most + spare chunks of the bits, ``spare`` at least are equal in such a pair, so hashes are joined on every choice of
    ``spare`` chunks (17 bits of 62 for a distance of 8).  A pair is reported from the choice of its first equal chunks
    alone, which spares a distinct over all pairs.

    A hash becomes a row for every choice, which Spark's estimate of the size leaves out: the join must not broadcast them, and hashes are
    dealt to as many tasks as shuffles have before they are multiplied.
    """
    chunks = most + spare
    edges = [k * bits // chunks for k in range(chunks + 1)]
    value = lambda h, k: f"(shiftrightunsigned({h}, {edges[k]}) & {(1 << (edges[k + 1] - edges[k])) - 1}L)"
    choices = list(combinations(range(chunks), spare))
    width = max(y - x for x, y in pairwise(edges))

    def key(choice: tuple[int, ...]) -> str:
        out = "0L"
        for k in choice:
            out = f"(shiftleft({out}, {width}) | {value('hash', k)})"
        return out

    tasks = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = hashes.repartition(tasks, "hash").select("key", "hash", F.posexplode(F.expr(f"array({', '.join(map(key, choices))})")).alias("choice", "value"))
    a, b = (keyed.select(*[F.col(c).alias(f"{c}_{side}") for c in keyed.columns]) for side in "ab")
    close = a.hint("merge").join(b.hint("merge"), F.expr("choice_a = choice_b and value_a = value_b and key_a < key_b")).withColumn("distance", F.expr(hamming("hash_a", "hash_b"))).where(F.col("distance") <= most)
    equal = ", ".join(f"case when {value('hash_a', k)} = {value('hash_b', k)} then {k} end" for k in range(chunks))
    first = F.expr(f"slice(array_compact(array({equal})), 1, {spare})")
    own = F.expr(f"array({', '.join('array(' + ', '.join(map(str, c)) + ')' for c in choices)})")
    found = close.withColumns({"first_": first, "own_": F.get(own, F.col("choice_a"))}).where("first_ = own_")
    return found.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "hash_a", "hash_b", "distance")


def near_components(spark: SparkSession, hashes: DataFrame, most: int = 8) -> DataFrame:
    """key, component (smallest key reachable, itself included), for all keys.  Keys of one hash share a representative, so they need no pairs."""
    one = hashes.groupBy("hash").agg(F.min("key").alias("rep"))
    found = components(near_representatives(one.select(F.col("rep").alias("key"), "hash"), most), Work(spark, "near"), "near")
    return hashes.join(one, "hash").join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"))
