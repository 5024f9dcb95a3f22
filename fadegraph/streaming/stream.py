"""The engine on streams: reinforcement with state, folders that are watched, windows.

State per edge is three numbers; late observations beyond the watermark are
dropped by the source.  A batch's observations of an edge are folded in order of
time, over all its Arrow frames; one that comes in a later batch than a younger one
counts as made at the time of the last (decay never runs backwards).
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.functions.channels import CHANNELS, CUSTOM, PRUNE_THRESHOLD
from fadegraph.sources.texts import EXTENSIONS, MOST_BYTES, checked_path

EDGE_STATE = "intensity double, last_touch timestamp, uses bigint"
EDGE_OUT = "key string, channel string, intensity double, last_touch timestamp, uses bigint"


def reinforce_stream(observed: DataFrame, late: str = "30 days", idle_hours: int = 24 * 365) -> DataFrame:
    """Edges as observations arrive: key, channel, intensity, last_touch, uses after each batch.

    ``observed`` has key, channel, ts (timestamp) and confidence.  An edge that stays
    untouched for ``idle_hours`` of event time leaves the state once it is dead.
    """
    idle_ms = idle_hours * 3_600_000

    def update(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        key, channel = group
        rate, gain, prunable = CHANNELS.get(channel, CUSTOM)
        x, last, uses = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            if prunable and x * math.exp(-rate * idle_hours) < PRUNE_THRESHOLD:
                state.remove()
            return
        # two numbers an observation, of one batch: all frames at once, since an order within each is none of the whole
        rows = pd.concat([f[["ts", "confidence"]] for f in frames]).sort_values(["ts", "confidence"], kind="stable")
        for ts, c in rows.itertuples(index=False):
            if x is None:
                x, last = min(1.0, max(0.0, 0.8 if c is None or math.isnan(c) else c)), ts
            else:
                hours = max(0, int((ts - last).total_seconds())) / 3600
                x, last = min(1.0, x * math.exp(-rate * hours) + gain), max(ts, last)
            uses += 1
        state.update((x, last, uses))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"key": [key], "channel": [channel], "intensity": [x], "last_touch": [last], "uses": [uses]})

    timed = observed.withWatermark("ts", late)
    return timed.groupBy("key", "channel").applyInPandasWithState(update, EDGE_OUT, EDGE_STATE, "update", "EventTimeTimeout")


def watch(spark: SparkSession, folder: str, forget: str = "7 days") -> DataFrame:
    """(path, text) of files as they appear, of the known extensions and up to ``MOST_BYTES``.

    A path counts once; it leaves the state when files are ``forget`` younger than it.
    """
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(checked_path(folder))
    named = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    known = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*EXTENSIONS)
    kept = named.filter(known & (F.octet_length("text") <= MOST_BYTES)).withWatermark("modified", forget)
    return kept.dropDuplicatesWithinWatermark(["path"]).select("path", "text")


def ingest_watched(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame], None], source: str = "watch"):
    """Ingest files as they appear; ``sink`` gets each batch's nodes and edges.  Ends when the folder is read."""
    from fadegraph.operators.text import ingest

    def batch(df: DataFrame, _: int) -> None:
        sink(*ingest(df, "path", "text", source))

    return watch(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(events: DataFrame, kinds: list[str]) -> DataFrame:
    """The graph events a webhook asked for; ``*`` asks for all."""
    return events if "*" in kinds else events.filter(F.col("kind").isin(*kinds))


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per key and window; ``late`` is the watermark on streams."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per key and session: runs of events less than ``gap`` apart."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
