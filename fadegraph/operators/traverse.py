"""Walks over the graph, level by level.

A traversal keeps, per node and hop, only the best product of effective
intensities (``max`` combines on the map side), and drops a node's row if an
earlier hop did as well.  Filters on channel and time stand before the first
join; on stored edges (``graph.adjacency``) they reach the file scan, together with the
bound on last_touch that a least intensity implies.  Each level is written, so a
plan reads the edges once a hop.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fadegraph.functions import exprs
from fadegraph.operators.graph import AS_OF, effective, touched_since
from fadegraph.sources import materialise


def walkable(edges: DataFrame, channels: list[str] | None = None, minimum: float = 0.15, since: str | None = None,
             until: str | None = None, as_of: str = AS_OF) -> DataFrame:
    """(src, dst, channel, eff) of the edges a walk may use; without channels, all but alarms."""
    e = edges.filter(F.col("channel").isin(*channels) if channels else F.col("channel") != "alarm")
    if since:
        e = e.filter(F.col("last_touch") >= exprs.ts(since))
    if until:
        e = e.filter(F.col("last_touch") <= exprs.ts(until))
    bounds = {c: touched_since(c, minimum, as_of) for c in channels or []}
    if bounds and all(b is not None for b in bounds.values()):
        e = e.filter(reduce(lambda a, b: a | b, ((F.col("channel") == c) & b for c, b in bounds.items())))
    return effective(e, as_of).filter(F.col("eff") >= minimum).select("src", "dst", "channel", "eff")


def neighbours(edges: DataFrame, nodes: str | DataFrame, channels: list[str] | None = None, minimum: float = 0.0, as_of: str = AS_OF) -> DataFrame:
    """(src, dst, channel, eff) of the out-edges of a node, or of all of a table (node); without channels all, alarms too."""
    e = edges.filter(F.col("src") == nodes) if isinstance(nodes, str) else edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    if channels:
        e = e.filter(F.col("channel").isin(*channels))
    return effective(e, as_of).filter(F.col("eff") >= minimum).select("src", "dst", "channel", "eff")


def traverse(edges: DataFrame, starts: DataFrame, hops: int = 3, minimum: float = 0.15, limit: int | None = 10, paths: bool = True, **filters) -> DataFrame:
    """(seed, node, score, hops, path): for each start (column ``node``) the best-scored nodes within ``hops``.

    The start itself comes first with score 1 and hop 0.  ``limit`` counts per start.  Intensities are at most 1, so a walk that
    comes back never scores higher and needs no check; without ``paths`` no path is carried.
    """
    e = walkable(edges, minimum=minimum, **filters)
    keep = ["path"] if paths else []
    level = starts.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("score"), *([F.array("node").alias("path")] if paths else [])).distinct()
    best = level.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        longer = F.array_append("path", F.col("dst")) if paths else None
        walked = level.join(e, level.node == e.src).withColumn("s", F.col("score") * F.col("eff")).filter(F.col("s") >= minimum)
        step = walked.groupBy("seed", F.col("dst").alias("node")).agg(
            F.max("s").alias("score"), *([F.max_by(longer, F.struct("s", "path")).alias("path")] if paths else []))
        earlier = best.groupBy("seed", "node").agg(F.max("score").alias("before"))
        level = step.join(earlier, ["seed", "node"], "left").filter("before IS NULL OR score > before").drop("before")
        if hop < hops:
            level = materialise(level, "level")
        best = best.unionByName(level.withColumn("hops", F.lit(hop)))
    rows = best.groupBy("seed", "node").agg(F.max(F.struct("score", -F.col("hops"), "hops", *keep)).alias("b")).select(
        "seed", "node", F.col("b.score").alias("score"), F.col("b.hops").alias("hops"), *(F.col(f"b.{k}").alias(k) for k in keep)
    )
    if limit is None:
        return rows
    top = W.partitionBy("seed").orderBy(F.desc("score"), "hops", "node")
    return rows.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= limit).drop("_n")


def explain_paths(edges: DataFrame, source: str, target: str, hops: int = 3, minimum: float = 0.05, k: int = 3, **filters) -> DataFrame:
    """(path, score, hops): the ``k`` strongest simple paths between two nodes.

    A first walk backwards from the target finds, per node and number of hops left, the best product with which the target can
    still be reached; the walk from the source follows an edge only where that product keeps the path above ``minimum``.  So no
    path is made that can't end at the target.
    """
    e = walkable(edges, minimum=minimum, **filters).groupBy("src", "dst").agg(F.max("eff").alias("eff")).filter("src <> dst")
    e = materialise(e, "walkable")
    reach = e.sparkSession.range(1).select(F.lit(target).alias("node"), F.lit(1.0).alias("left"))
    lefts = [reach]
    for _ in range(hops - 1):
        back = e.join(reach, e.dst == reach.node).withColumn("p", F.col("eff") * F.col("left")).filter(F.col("p") >= minimum)
        reach = materialise(back.groupBy(F.col("src").alias("node")).agg(F.max("p").alias("left")).unionByName(reach).groupBy("node").agg(F.max("left").alias("left")), "reach")
        lefts.append(reach)
    level = e.sparkSession.range(1).select(F.lit(source).alias("at"), F.lit(1.0).alias("score"), F.array(F.lit(source)).alias("path"))
    found = level.limit(0)
    for hop in range(hops):
        ahead = lefts[hops - 1 - hop].withColumnRenamed("node", "dst")
        level = (
            level.filter(F.col("at") != target).join(e.join(ahead, "dst"), F.col("at") == F.col("src"))
            .withColumn("s", F.col("score") * F.col("eff"))
            .filter((F.col("s") >= minimum) & (F.col("s") * F.col("left") >= minimum * (1 - 1e-9)) & ~F.array_contains("path", F.col("dst")))
            .select(F.col("dst").alias("at"), F.col("s").alias("score"), F.array_append("path", F.col("dst")).alias("path"))
        )
        if hop < hops - 1:
            level = materialise(level, "level")
        found = found.unionByName(level.filter(F.col("at") == target))
    return found.select(F.array_join("path", ">").alias("path"), "score", (F.size("path") - 1).alias("hops")).orderBy(F.desc("score"), "path").limit(k)


def reached_most(edges: DataFrame, source: str, hops: int = 3, minimum: float = 0.05, **filters) -> DataFrame:
    """(node, paths): how many simple paths from a node end at each other, the most first."""
    e = materialise(walkable(edges, minimum=minimum, **filters).groupBy("src", "dst").agg(F.max("eff").alias("eff")).filter("src <> dst"), "walkable")
    level = e.filter(F.col("src") == source).select(F.col("dst").alias("node"), F.col("eff").alias("score"), F.array("src", "dst").alias("path"))
    counts = level.groupBy("node").agg(F.count("*").alias("n"))
    for _ in range(hops - 1):
        level = level.join(e, level.node == e.src).withColumn("s", F.col("score") * F.col("eff")).filter((F.col("s") >= minimum) & ~F.array_contains("path", F.col("dst"))).select(
            F.col("dst").alias("node"), F.col("s").alias("score"), F.array_append("path", F.col("dst")).alias("path"))
        level = materialise(level, "level")
        counts = counts.unionByName(level.groupBy("node").agg(F.count("*").alias("n")))
    return counts.groupBy("node").agg(F.sum("n").alias("paths")).orderBy(F.desc("paths"), "node")


def khop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, hops): nodes within ``hops`` of the starts, whatever the direction."""
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
    seen = materialise(starts.select("node").distinct().withColumn("hops", F.lit(0)), "level") if hops > 1 else starts.select("node").distinct().withColumn("hops", F.lit(0))
    level = seen
    for hop in range(1, hops + 1):
        step = both.join(level.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level = step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        if hop < hops:
            level = materialise(level, "level")
        seen = seen.unionByName(level)
    return seen


def resolve_start(nodes: DataFrame, query: str) -> DataFrame:
    """(node_id, label, stage): the node a query starts from.

    Exact label, else same but for case, else the shortest label that contains the
    query, else the longest label of three bytes or more the query contains.
    """
    low, q = F.lower("label"), query.lower()
    contained = (F.octet_length("label") >= 3) & F.lit(q).contains(low)
    stage = F.when(F.col("label") == query, 1).when(low == q, 2).when(low.contains(q), 3).when(contained, 4)
    n = F.length("label")
    return (
        nodes.select("node_id", "label", stage.alias("stage")).filter("stage IS NOT NULL")
        .orderBy("stage", F.when(F.col("stage") == 3, n).when(F.col("stage") == 4, -n).otherwise(0), "label", "node_id").limit(1)
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at each node, either end counted."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
