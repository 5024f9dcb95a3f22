"""Items that appear together: pair counts, pointwise mutual information and lift.

Items are deduplicated per basket, ordered pairs are emitted from each basket,
counts are combined on the map side, and lift and PMI come from the marginals.

A basket is dealt with in blocks of ``BLOCK`` items: block pairs of a large
basket are spread over all tasks, so that no task ever emits a large basket
alone.  With ``min_count`` an item found in fewer baskets is left out before
pairs are emitted; a pair can't be in more baskets than its rarer item, so no
pair of the result is lost.

Defined cases: a null basket id is no basket; null, empty and blank items and
items made of signs only are none; a basket counts in ``n`` even without items;
repeated rows and repeated items count once; an empty table gives no pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a basket that one row of the pair stage holds.
BLOCK = 256


def normal_tag(tag: Column) -> Column:
    """Lower case, without blanks and signs at the ends."""
    return F.regexp_replace(F.lower(tag), r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")


def _dec(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def pairs(baskets: DataFrame, basket: str, items: str, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n, lift, pmi) of every pair in ``min_count`` baskets and ``min_lift``.

    ``items`` is a column of arrays; item_a < item_b by code points.
    """
    rows = baskets.select(F.col(basket).alias("_b"), F.col(items).alias("_i")).filter(F.col("_b").isNotNull())
    n = rows.agg(F.count_distinct("_b").alias("n"))
    single = (
        rows.select("_b", F.explode("_i").alias("_t"))
        .select("_b", normal_tag(F.col("_t")).alias("_t"))
        .filter(F.col("_t") != "")
        .distinct()
    )
    counts = single.groupBy("_t").agg(F.count("*").alias("c")).filter(F.col("c") >= min_count)
    kept = single.join(counts.select("_t"), "_t", "left_semi") if min_count > 1 else single
    sets = kept.groupBy("_b").agg(F.array_sort(F.collect_set("_t")).alias("s")).filter(F.size("s") > 1)

    last = F.floor((F.size("s") - 1) / F.lit(BLOCK)).cast("int")
    block = lambda k: F.slice("s", F.col(k) * BLOCK + 1, BLOCK)
    small = sets.filter(F.size("s") <= BLOCK).select(F.col("s").alias("x"), F.col("s").alias("y"))
    large = (
        sets.filter(F.size("s") > BLOCK)
        .select("_b", "s", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("m"))
        .select("_b", "s", "i", F.explode(F.sequence("i", "m")).alias("j"))
        .select("_b", "i", "j", block("i").alias("x"), block("j").alias("y"))
        .repartition("_b", "i", "j")
        .select("x", "y")
    )
    both = (
        small.unionByName(large)
        .select(F.explode("x").alias("item_a"), "y")
        .select("item_a", F.explode("y").alias("item_b"))
        .filter(F.col("item_a") < F.col("item_b"))
        .groupBy("item_a", "item_b")
        .agg(F.count("*").alias("n_ab"))
        .filter(F.col("n_ab") >= min_count)
    )
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b").cast("double"))
    return (
        both.join(counts.select(F.col("_t").alias("item_a"), F.col("c").alias("n_a")), "item_a")
        .join(counts.select(F.col("_t").alias("item_b"), F.col("c").alias("n_b")), "item_b")
        .withColumn("n", n.scalar())
        .filter(
            _dec("n_ab") * _dec("n") >= F.lit(str(min_lift)).cast("decimal(12,6)") * (_dec("n_a") * _dec("n_b")).cast("decimal(25,0)")
        )
        .select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
    )
