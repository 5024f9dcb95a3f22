"""Jobs that recur, and what changed as a stream of events.

A job takes nodes and edges and a moment and gives them changed.  ``run_due`` runs
those whose interval has passed; ``every`` drives it from a rate stream, so a driver
that restarts from its checkpoint goes on where it was.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.operators import maintenance

State = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Job:
    """What a job is called, how many hours lie between its runs, and what it does to (nodes, edges) at a moment."""

    name: str
    hours: float
    run: Callable[[DataFrame, DataFrame, str], State]


def _consolidated(nodes: DataFrame, edges: DataFrame, as_of: str) -> State:
    made, links = maintenance.consolidate(nodes, as_of, "default")
    return nodes.unionByName(made.withColumn("last_seen", F.col("created_at")), allowMissingColumns=True), maintenance.apply_upserts(edges, links)


#: The usual jobs: much-used edges reinforced, recent events consolidated, dead edges and orphans removed.
JOBS = (
    Job("physarum", 1, lambda n, e, t: (n, maintenance.physarum(e, t))),
    Job("consolidation", 6, _consolidated),
    Job("pruning", 24, maintenance.daily_prune),
)


def run_due(nodes: DataFrame, edges: DataFrame, as_of: str, last: dict[str, str], jobs: tuple[Job, ...] = JOBS) -> tuple[State, dict[str, str]]:
    """State after the jobs that are due at ``as_of``, in order, and when each last ran; a job that never ran is due."""
    now, ran = dt.datetime.fromisoformat(as_of), dict(last)
    for job in jobs:
        if job.name not in last or now - dt.datetime.fromisoformat(last[job.name]) >= dt.timedelta(hours=job.hours):
            nodes, edges = job.run(nodes, edges, as_of)
            ran[job.name] = as_of
    return (nodes, edges), ran


def every(spark: SparkSession, interval: str, tick: Callable[[str], None], checkpoint: str):
    """Call ``tick`` with the moment of each trigger, again and again until the query is stopped."""

    def batch(df: DataFrame, _: int) -> None:
        tick(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds"))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def edge_events(before: DataFrame, after: DataFrame, as_of: str) -> DataFrame:
    """(kind, label, detail, timestamp): edge_created, edge_changed and edge_removed between two states of the edges."""
    keys = ["src", "dst", "channel"]
    side = lambda df, p: df.select(*keys, F.struct("intensity", "confidence", "uses").alias(p))
    both = side(before, "was").join(side(after, "now"), keys, "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "edge_created").when(F.col("now").isNull(), "edge_removed").otherwise("edge_changed")
    return both.select(kind.alias("kind"), F.concat_ws(">", "src", "dst").alias("label"), F.to_json(F.struct("channel", "was", "now")).alias("detail"), F.lit(as_of).alias("timestamp"))


def write_events(events: DataFrame, path: str, kinds: list[str], checkpoint: str | None = None):
    """Append the events a subscriber asked for as JSON lines; a stream needs a checkpoint and gives its query."""
    from fadegraph.streaming.stream import subscribe

    told = subscribe(events, kinds)
    if not events.isStreaming:
        return told.write.mode("append").json(path)
    return told.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
