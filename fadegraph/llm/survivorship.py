"""Best representative of each duplicate group, field by field.

Rows of a group are unpivoted to long rows (group, field, value, vote), votes are
combined per normalised value, ``max_by`` picks each field's winner, and ``golden``
pivots the winners back into one record.

A vote is two numbers: its *weight*, source trust times recency decay, summed per
value; and its *lead*, (trust, recency, -id) in that order, of which the largest is
kept per value.  ``votes`` picks by weight.  ``winners`` picks by lead, since a sum
of weights can't promise that one row of a more trusted source outranks any number
of others; both read the same ballot.

Only rows of groups of two and more are unpivoted: keys are hashed and counted
first, combined on the map side, so that a hot group costs a row a task, and
single rows, mostly the bulk, are never multiplied by four.

Defined cases: a row with a null part of the key or without id describes no edge and is left
out; a field without usable value in its group gives no row; NaN is not usable;
repeated rows count as rows of the group; an empty table gives no rows; further
columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Provenances from most to least trusted, in letters only.
TRUST = ("human", "aivalidated", "aiinferred", "automated")
#: Weight of a vote by provenance in ``votes``; unusable provenances weigh the last.
TRUST_WEIGHT = (1.0, 0.7, 0.4, 0.2, 0.05)
FIRST, BEYOND = "2023-01-01", "2026-01-01"
FIELDS = ("confidence", "provenance", "last_touch", "source")


def written(c: str) -> Column:
    """A key however written: no letter case, underscores or white space."""
    return F.lower(F.regexp_replace(c, r"[_\p{Z}\s]+", ""))


def trust_rank(c: str) -> Column:
    """0 for the most trusted; len(TRUST) for what is no provenance."""
    return F.array_position(F.array(*map(F.lit, TRUST)), F.lower(F.regexp_replace(c, r"[^A-Za-z]", ""))).cast("int")


def _rows(edges: DataFrame) -> DataFrame:
    """Key, rank, age and the usable values of each row; keys are two hashes."""
    place = F.coalesce(trust_rank("provenance"), F.lit(0))
    touch = F.when((F.col("last_touch") >= F.lit(FIRST).cast("timestamp_ntz")) & (F.col("last_touch") < F.lit(BEYOND).cast("timestamp_ntz")), F.col("last_touch"))
    key = [written("src"), written("dst"), written("channel")]
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND channel IS NOT NULL AND ord IS NOT NULL").select(
        F.xxhash64(*key).alias("k"), F.xxhash64(F.lit(7), *key).alias("j"), "ord",
        F.when(place > 0, place - 1).otherwise(len(TRUST)).alias("rank"),
        # microseconds from a row's last touch to the end of the usable years; large without one
        F.coalesce(F.timestamp_diff("MICROSECOND", touch, F.lit(BEYOND).cast("timestamp_ntz")), F.lit(1 << 57)).alias("age"),
        F.when(F.col("confidence").between(0, 1), F.col("confidence").cast("string")).alias("confidence"),
        F.when(place > 0, F.col("provenance")).alias("provenance"),
        touch.cast("string").alias("last_touch"),
        F.when(F.col("source").rlike(r"^\s*[^/\s]+/[^/\s]*[0-9]\s*$"), F.col("source")).alias("source"),
    )


def normal_value(attr: Column, value: Column) -> Column:
    """Values that count as one: numbers by their thousandths, provenances by their letters, the rest without case and blanks around."""
    return (
        F.when(attr == "confidence", (F.floor(value.try_cast("double") * 1000) / 1000).cast("string"))
        .when(attr == "provenance", F.lower(F.regexp_replace(value, "[^A-Za-z]", ""))).otherwise(F.lower(F.trim(value)))
    )


def ballot(edges: DataFrame, half_life_days: float = 90.0) -> DataFrame:
    """(group_ord, attr, normal, weight, lead, value, ord): the votes of each value of each field of each duplicate group.

    Weight sums trust times 2^(-age / half life), the age measured from the end of the usable years; lead is the largest (trust,
    recency, -ord), for last_touch of recency alone, and value and ord are of the row that leads.
    """
    rows = _rows(edges)
    groups = rows.groupBy("k", "j").agg(F.count("*").alias("n"), F.min("ord").alias("group_ord")).filter("n >= 2").drop("n")
    day = 86_400_000_000.0
    weight = F.element_at(F.array(*map(F.lit, TRUST_WEIGHT)), F.col("rank") + 1) * F.pow(F.lit(2.0), -F.least(F.col("age") / day, F.lit(3650.0)) / half_life_days)
    members = rows.join(groups, ["k", "j"]).withColumn("weight", weight)
    long = members.unpivot(["group_ord", "ord", "rank", "age", "weight"], list(FIELDS), "attr", "value").filter("value IS NOT NULL")
    lead = F.struct(F.when(F.col("attr") == "last_touch", 0).otherwise(-F.col("rank")).alias("trust"), (-F.col("age")).alias("recency"), (-F.col("ord")).alias("first"))
    voted = F.max(F.struct(lead.alias("lead"), F.col("value").alias("value"))).alias("v")
    return long.withColumn("normal", normal_value(F.col("attr"), F.col("value"))).groupBy("group_ord", "attr", "normal").agg(F.sum("weight").alias("weight"), voted).select(
        "group_ord", "attr", "normal", "weight", F.col("v.lead").alias("lead"), F.col("v.value").alias("value"), (-F.col("v.lead.first")).alias("ord"))


def _led(edges: DataFrame) -> DataFrame:
    return ballot(edges).groupBy("group_ord", "attr").agg(F.max_by(F.struct("ord", "value"), "lead").alias("w")).select("group_ord", "attr", "w.ord", "w.value")


def winners(edges: DataFrame) -> DataFrame:
    """(group_ord, attr, ord): the row each field of each duplicate group survives from."""
    return _led(edges).select("group_ord", "attr", "ord")


def golden(edges: DataFrame) -> DataFrame:
    """One row per duplicate group with the surviving value of each field."""
    return _led(edges).groupBy("group_ord").pivot("attr", list(FIELDS)).agg(F.max("value"))


def votes(edges: DataFrame, half_life_days: float = 90.0) -> DataFrame:
    """(group_ord, attr, value, weight): per field the normalised value with the largest sum of votes; ties go to the smaller value.

    Weights are compared to nine places, as the order of a sum is not fixed.
    """
    b = ballot(edges, half_life_days).withColumn("w", F.round("weight", 9))
    best = F.min(F.struct((-F.col("w")).alias("w"), F.col("normal").alias("value"))).alias("b")
    return b.groupBy("group_ord", "attr").agg(best).select("group_ord", "attr", "b.value", (-F.col("b.w")).alias("weight"))
