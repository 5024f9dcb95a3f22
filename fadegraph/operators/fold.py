"""Capped reinforcement as an ordered fold that combines.

One observation maps intensity x to min(1, x * decay + delta).  Such maps have
the form min(c, a * x + b) and are closed under composition:

    min(c2, a2 * min(c1, a1 * x + b1) + b2) = min(min(c2, a2 * c1 + b2), a2 * a1 * x + a2 * b1 + b2)

so the fold, though it does not commute, is associative.  Observations are
partitioned by range of (key, time, seq), so partitions are of one size whatever the
keys; what a partition has of a key is a slice, folded to (a, b, c) on its own, and
the few slices of a key are composed in order.  A key with a third of all
observations is thus spread over many tasks, and none holds more than its slice.

Defined cases: observations without time, src, dst or channel are ignored; equal
times are taken by seq; decay counts whole seconds; the first observation gives
the clamped confidence (0.8 without a usable one).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.functions import channels, exprs


def fold_edges(observed: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """keys, intensity, last_touch, uses of each edge; ``observed`` has keys, channel, ts, seq, confidence.

    ``slices`` is the number of range partitions, by default that of the session's shuffles.
    """
    conf = F.when(F.col("confidence").between(0, 1), F.col("confidence")).when(F.col("confidence") > 1, 1.0).when(
        F.col("confidence") < 0, 0.0
    ).otherwise(0.8)
    rows = observed.filter("ts IS NOT NULL AND channel IS NOT NULL").select(
        *keys, *([] if "channel" in keys else ["channel"]), "ts", "seq", F.when(F.isnan("confidence"), 0.8).otherwise(conf).alias("c"),
    )
    order = [*keys, "ts", "seq"]
    rows = (rows.repartitionByRange(slices, *order) if slices else rows.repartitionByRange(*order)).withColumn("slice", F.spark_partition_id())
    rate, gain = F.col("rate"), F.col("gain")
    sliced = rows.groupBy(*keys, "slice").agg(
        F.first(channels.tau(F.col("channel"))).alias("rate"), F.first(channels.delta(F.col("channel"))).alias("gain"),
        F.array_sort(F.collect_list(F.struct("ts", "seq", "c"))).alias("o"),
    )
    seconds = lambda x, y: F.greatest(F.lit(0), F.timestamp_diff("SECOND", x, y)) / F.lit(3600.0)
    step = lambda s, o: F.struct(
        o["ts"].alias("t"),
        (s["a"] * F.exp(-rate * seconds(s["t"], o["ts"]))).alias("a"),
        (s["b"] * F.exp(-rate * seconds(s["t"], o["ts"])) + gain).alias("b"),
        F.least(F.lit(1.0), s["cap"] * F.exp(-rate * seconds(s["t"], o["ts"])) + gain).alias("cap"),
    )
    # from the intensity on arrival at the slice's first observation, that one included
    start = F.struct(F.col("o")[0]["ts"].alias("t"), F.lit(1.0).alias("a"), gain.alias("b"), F.lit(1.0).alias("cap"))
    born = F.struct(F.col("o")[0]["ts"].alias("t"), F.lit(0.0).alias("a"), F.col("o")[0]["c"].alias("b"), F.lit(1.0).alias("cap"))
    rest = F.slice("o", F.lit(2), F.size("o"))
    parts = sliced.select(
        *keys, "rate", F.col("o")[0]["ts"].alias("from"), F.col("o")[0]["seq"].alias("from_seq"), F.size("o").cast("bigint").alias("n"),
        F.aggregate(rest, start, step).alias("f"), F.aggregate(rest, born, step).alias("g"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("from", "from_seq", "n", "f", "g")))
    whole = parts.groupBy(*keys).agg(F.first("rate").alias("rate"), ordered.alias("p"))
    first = F.col("p")[0]
    compose = lambda s, p: F.struct(
        F.least(p["f"]["cap"], p["f"]["a"] * (s["x"] * F.exp(-rate * seconds(s["t"], p["from"]))) + p["f"]["b"]).alias("x"),
        p["f"]["t"].alias("t"), (s["n"] + p["n"]).alias("n"),
    )
    done = F.aggregate(
        F.slice("p", F.lit(2), F.size("p")),
        F.struct(F.least(first["g"]["cap"], first["g"]["b"]).alias("x"), first["g"]["t"].alias("t"), first["n"].alias("n")), compose,
    )
    return whole.withColumn("d", done).select(
        *keys, F.col("d.x").alias("intensity"), F.col("d.t").alias("last_touch"), F.col("d.n").alias("uses")
    )
