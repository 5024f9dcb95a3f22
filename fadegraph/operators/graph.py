"""The graph's state: nodes and edges out of dirty observations.

Defined cases: an edge without src, dst or channel is none; a confidence out of
0..1 counts as 0.8, an unknown touch as the first day of 2023; a node without id
is none; of several observations of a node the first kind wins, its tags are
united in order, and the time it was last seen never precedes its creation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.functions import channels, exprs
from fadegraph.sources import materialise, table

UNKNOWN_TOUCH, AS_OF = "2023-01-01", "2025-07-01"
EDGE = ["workspace", "src", "dst", "channel", "intensity", "confidence", "last_touch", "uses", "source", "label", "provenance", "ord"]


def as_id(c: str | Column) -> Column:
    """An id without letter case, blanks and underscores."""
    return F.lower(F.regexp_replace(c, r"[_\s]+", ""))


def observed_edges(rows: DataFrame) -> DataFrame:
    """Edge rows in canonical writing."""
    conf = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.8)
    return rows.select(
        "workspace", as_id("src").alias("src"), as_id("dst").alias("dst"), channels.canonical(F.col("channel")).alias("channel"),
        exprs.clamped(F.col("intensity")).alias("intensity"), conf.alias("confidence"),
        F.coalesce("last_touch", exprs.ts(UNKNOWN_TOUCH)).alias("last_touch"), F.greatest("uses", F.lit(1)).alias("uses"),
        "source", "label", F.regexp_replace(F.lower(F.regexp_replace("provenance", r"[_\s]", "")), "^ai", "ai_").alias("provenance"), "ord",
    ).filter("src IS NOT NULL AND dst IS NOT NULL AND channel IS NOT NULL AND intensity IS NOT NULL")


def latest_edges(rows: DataFrame) -> DataFrame:
    """One row per (src, dst, channel): the observation touched last, then the earlier one."""
    rest = [c for c in EDGE if c not in ("src", "dst", "channel")]
    best = F.max_by(F.struct(*rest), F.struct("last_touch", -F.col("ord")))
    return observed_edges(rows).groupBy("src", "dst", "channel").agg(best.alias("b")).select(
        *(F.col(f"b.{c}").alias(c) if c in rest else F.col(c) for c in EDGE)
    )


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row per node: first label and kind, tags united in order of observation, first and last time seen."""
    first = lambda c: F.min_by(c, F.col("ord"))
    tags = F.array_distinct(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.when(F.size("tags") > 0, F.struct("ord", "tags")))), lambda x: x["tags"]
    )))
    return (
        rows.filter("node_id IS NOT NULL")
        .groupBy("node_id")
        .agg(
            first(F.col("workspace")).alias("workspace"), first(F.col("label")).alias("label"),
            F.min_by(F.lower("kind"), F.when(F.col("kind").isNotNull(), F.col("ord"))).alias("kind"),
            F.min("created_at").alias("created_at"),
            F.max(F.greatest("created_at", "last_seen")).alias("last_seen"),
            tags.alias("tags"), first(F.col("meta")).alias("meta"), F.min("ord").alias("ord"),
        )
    )


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the ``edges`` table."""
    return latest_edges(table(spark, sf_dir, "edges"))


def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the ``nodes`` table."""
    return upsert_nodes(table(spark, sf_dir, "nodes"))


def effective(edges: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Edges with their effective intensity ``eff``; an ``eff`` that says it is of this very moment is kept."""
    if "eff" in edges.columns and edges.schema["eff"].metadata.get("as_of") == as_of:
        return edges
    return edges.withColumn("eff", exprs.decayed(F.col("intensity"), F.col("channel"), F.col("last_touch"), exprs.ts(as_of)).alias("eff", metadata={"as_of": as_of}))


def adjacency(edges: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Edges with ``eff`` at one moment, written once for all walks that follow.

    The files are sorted by channel and last_touch, so filters on both skip row groups; filters on src, dst and eff reach the scan
    as well.  Operators that ask for another moment, or that change edges, compute ``eff`` anew.
    """
    return materialise(effective(edges, as_of).sortWithinPartitions("channel", "last_touch"), "adjacency")


class AdjacencyCache:
    """Adjacencies of one set of edges by their moment; the ``most`` last used are kept, the others deleted."""

    def __init__(self, edges: DataFrame, most: int = 4):
        self.edges, self.most, self._at = edges, most, {}

    def at(self, as_of: str) -> DataFrame:
        """The adjacency at a moment, written at the first call."""
        from fadegraph.sources import discard

        self._at[as_of] = self._at.pop(as_of, None) or adjacency(self.edges, as_of)
        while len(self._at) > self.most:
            discard(self._at.pop(next(iter(self._at))))
        return self._at[as_of]

    def clear(self) -> None:
        """Forget all, as after a change of the edges."""
        from fadegraph.sources import discard

        while self._at:
            discard(self._at.popitem()[1])


def touched_since(channel: str, minimum: float, as_of: str) -> Column | None:
    """A bound on last_touch every edge of the channel of at least ``minimum`` meets; on stored edges it reaches the file scan.

    Intensities are at most 1, so eff >= m needs last_touch >= as_of - ln(1/m)/tau hours; a
    second is added because time counts in whole seconds.
    """
    import math

    rate = channels.CHANNELS.get(channel, channels.CUSTOM)[0]
    if rate == 0 or minimum <= 0:
        return None
    seconds = math.ceil(math.log(1 / minimum) / rate * 3600) + 1
    return F.col("last_touch") >= exprs.ts(as_of) - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
