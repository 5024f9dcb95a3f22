"""Communities by local moving, and modularity.

Local moving is done in rounds over all nodes at once, a quarter of them (by
hash) free to move in each, which keeps neighbours from swapping for ever.  A
round is two joins and two sums, all combined on the map side: no community or
component is ever gathered in one task.  Ties go to the smaller community id.
"""
from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.operators.graph import AS_OF, effective
from fadegraph.sources import discard, materialise

TURNS = 4


def undirected(edges: DataFrame, as_of: str = AS_OF, minimum: float = 0.001) -> DataFrame:
    """(a, b, w): live edges seen from either end."""
    live = effective(edges, as_of).filter(F.col("eff") >= minimum)
    return live.select(F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))
    )).alias("e"), F.col("eff").alias("w")).select("e.a", "e.b", "w")


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node of each connected part, by passing minima and jumping pointers until none moves.

    With ``most_rounds`` it is an error if nodes still move after so many.
    """
    both = materialise(
        edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct(), "both"
    )
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    old = None
    for turn in count():
        if turn == most_rounds:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
        least = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(least, label.node == least.a, "left").select("node", "component", F.least("component", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = materialise(step.join(jump, "low", "left").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved")), "component")
        label = new.select("node", "component")
        if old is not None:
            discard(old)
        old = new
        if not new.filter("moved").limit(1).count():
            break
    discard(both)
    return label


def local_moving(edges: DataFrame, gamma: float = 2.0, most_rounds: int | None = None, as_of: str = AS_OF) -> DataFrame:
    """(node, community) once a whole cycle of rounds moves no node; gamma 1 is the textbook resolution.

    With ``most_rounds`` it is an error if nodes still move after so many.
    """
    adj = materialise(undirected(edges, as_of).groupBy("a", "b").agg(F.sum("w").alias("w")), "adjacent")
    strength = materialise(adj.groupBy("a").agg(F.sum("w").alias("k")), "strength")
    twice = strength.agg(F.sum("k")).scalar()
    comm = materialise(strength.select(F.col("a").alias("node"), "k", F.col("a").alias("community")), "community")
    old, quiet = comm, 0
    for turn in count():
        if turn == most_rounds:
            raise RuntimeError(f"communities have not settled after {most_rounds} rounds")
        sigma = comm.groupBy("community").agg(F.sum("k").alias("sigma"))
        # dealt anew in each cycle, so that neighbours do not stay in one turn and swap
        free = comm.filter(F.pmod(F.xxhash64("node", F.lit(turn // TURNS)), F.lit(TURNS)) == turn % TURNS)
        links = (
            adj.join(free.select(F.col("node").alias("a"), "k", F.col("community").alias("own")), "a")
            .join(comm.select(F.col("node").alias("b"), F.col("community").alias("to")), "b")
            .filter("a <> b").groupBy("a", "k", "own", "to").agg(F.sum("w").alias("w"))
        )
        scored = links.join(sigma.withColumnRenamed("community", "to"), "to").withColumn(
            "sigma", F.when(F.col("to") == F.col("own"), F.col("sigma") - F.col("k")).otherwise(F.col("sigma"))
        )
        # with m = twice / 2, moving from own to another: (w_to - w_own) / m - gamma k (s_to - s_own) / (2 m^2)
        stay = scored.filter("to = own").select("a", F.col("w").alias("w_own"))
        home = free.join(sigma, "community").select(F.col("node").alias("a"), (F.col("sigma") - F.col("k")).alias("s_own"))
        gains = (
            scored.filter("to <> own").join(stay, "a", "left").join(home, "a").withColumn("m", twice / 2)
            .withColumn("gain", (F.col("w") - F.coalesce("w_own", F.lit(0.0))) / F.col("m")
                        - gamma * F.col("k") * (F.col("sigma") - F.col("s_own")) / (2 * F.col("m") * F.col("m")))
            .filter("gain > 1e-12")
        )
        best = gains.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to"))["to"].alias("best"))
        moved = materialise(
            comm.join(best.withColumnRenamed("a", "node"), "node", "left").select("node", "k", F.coalesce("best", "community").alias("community"), F.col("best").isNotNull().alias("moved")), "community"
        )
        quiet = 0 if moved.filter("moved").limit(1).count() else quiet + 1
        discard(old)
        old, comm = moved, moved.drop("moved")
        if quiet == 2 * TURNS - 1:  # a whole cycle without a move
            break
    return comm.select("node", "community")


def modularity(edges: DataFrame, partition: DataFrame, as_of: str = AS_OF, textbook: bool = False) -> DataFrame:
    """(q): sum over linked pairs of one community of (w - k_i k_j / m) / m; with ``textbook`` the usual Q.

    ``partition`` has node and community.
    """
    adj = undirected(edges, as_of)
    k = adj.groupBy("a").agg(F.sum("w").alias("k"))
    m = k.agg((F.sum("k") / 2).alias("m")).scalar()
    side = lambda c, x: partition.select(F.col("node").alias(c), F.col("community").alias(f"c{x}")).join(
        k.select(F.col("a").alias(c), F.col("k").alias(f"k{x}")), c)
    inside = adj.join(side("a", 1), "a").join(side("b", 2), "b").filter("c1 = c2")
    if not textbook:
        return inside.withColumn("m", m).agg(F.coalesce(F.sum((F.col("w") - F.col("k1") * F.col("k2") / F.col("m")) / F.col("m")), F.lit(0.0)).alias("q"))
    within = inside.groupBy(F.col("c1").alias("community")).agg(F.sum("w").alias("w"))
    total = partition.join(k.withColumnRenamed("a", "node"), "node").groupBy("community").agg(F.sum("k").alias("k"))
    each = total.join(within, "community", "left").withColumn("m", m)
    return each.agg(F.sum(F.coalesce("w", F.lit(0.0)) / (2 * F.col("m")) - F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("q"))
