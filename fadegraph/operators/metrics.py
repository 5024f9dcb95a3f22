"""Quality metrics of retrieval, as aggregations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.functions import exprs


def hit(found: Column, wanted: Column) -> Column:
    """Either contains the other, whatever the case."""
    a, b = F.lower(found), F.lower(wanted)
    return a.contains(b) | b.contains(a)


def entity_recall(found: Column, gold: Column, k: int) -> Column:
    """(recall, hits, total): gold entities hit by one of the first k results; recall 0 without gold."""
    top = F.slice(found, 1, k)
    hits = F.size(F.filter(gold, lambda g: F.exists(top, lambda f: hit(f, g))))
    total = F.size(gold)
    return F.struct(F.when(total > 0, hits / total).otherwise(0.0).alias("recall"), hits.alias("hits"), total.alias("total"))


def recall_by(found: DataFrame, gold: DataFrame, by: str, k: int) -> DataFrame:
    """(by, recall, hits, total) of groups with results and gold; ``found`` has by, place (from 1) and label, ``gold`` by and wanted.

    Each wanted entity is judged in its own row, so a group's gold is never gathered; its results are only as far as ``k``.
    """
    top = found.filter(F.col("place") <= k).groupBy(by).agg(F.collect_list("label").alias("top"))
    judged = gold.filter("wanted IS NOT NULL").select(by, "wanted").distinct().join(top, by).withColumn(
        "hit", F.coalesce(F.exists("top", lambda f: hit(f, F.col("wanted"))), F.lit(False)).cast("int"))
    return judged.groupBy(by).agg(F.avg("hit").alias("recall"), F.sum("hit").cast("int").alias("hits"), F.count("*").cast("int").alias("total"))


def path_recall(found: Column, chain: Column) -> Column:
    """Share of a chain's links among the results."""
    hits = F.size(F.filter(chain, lambda c: F.exists(found, lambda f: hit(f, c))))
    return F.when(F.size(chain) > 0, hits / F.size(chain)).otherwise(0.0)


def _bag(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(exprs.answer_normal(x), " "), lambda w: w != ""))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two answers' sets of words; 1 if both are empty."""
    p, g = _bag(predicted), _bag(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def exact_match(predicted: Column, gold: Column) -> Column:
    """Normalised answers are equal."""
    return exprs.answer_normal(predicted) == exprs.answer_normal(gold)


def mean_reciprocal_rank(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """(mrr): mean of 1 / (rank + 1), 0 for none."""
    return rows.agg(F.avg(F.when(F.col(rank).isNull(), 0.0).otherwise(1.0 / (F.col(rank) + 1))).alias("mrr"))


def temporal_accuracy(rows: DataFrame) -> DataFrame:
    """(accuracy, n): the recent answer strictly before the stale one, or no stale one; rows with neither don't count."""
    judged = rows.filter("recent IS NOT NULL OR stale IS NOT NULL")
    right = F.col("recent").isNotNull() & (F.col("stale").isNull() | (F.col("recent") < F.col("stale")))
    return judged.agg(F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def report(rows: DataFrame, by: str = "preset") -> DataFrame:
    """Means per preset or suite of recall, f1, reciprocal rank and latency; ``rows`` has one row a question."""
    return rows.groupBy(by).agg(
        F.count("*").alias("questions"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0 / (F.col("rank") + 1))).alias("mrr"), F.avg("latency").alias("latency"),
    )
