"""Ranks of nodes: Personalized PageRank and specificity.

Each PageRank round is one equi-join of ranks with transitions and one sum per
target, combined on the map side; transitions are written once and each
``CUT`` rounds the ranks are, so plans stay short and a lost executor costs a
few rounds.  Mass of nodes without out-edges is lost, as intended.
"""
from __future__ import annotations

import warnings
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.operators.graph import AS_OF, effective
from fadegraph.operators.traverse import degrees
from fadegraph.sources import discard, materialise

CUT = 5


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int | None = 50, tolerance: float | None = 1e-6, as_of: str = AS_OF) -> DataFrame:
    """(node, rank) above 1e-8; ``seeds`` has node and, if wanted, weight.

    With ``tolerance`` None exactly ``rounds`` rounds are run.  With ``rounds`` None they go on until the change is under
    ``tolerance``; as a round leaves at most 1 - alpha of it, that ends.  Rounds that end before the tolerance is met are warned of.
    """
    if rounds is None and (tolerance is None or tolerance <= 0 or not 0 < alpha <= 1):
        raise ValueError("without rounds, tolerance and alpha must be above 0")
    live = effective(edges, as_of).filter(F.col("eff") > 0.001).groupBy("src", "dst").agg(F.sum("eff").alias("w"))
    out = live.groupBy("src").agg(F.sum("w").alias("total"))
    moves = materialise(live.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "moves")
    start = seeds if "weight" in seeds.columns else seeds.withColumn("weight", F.lit(1.0))
    start = start.groupBy("node").agg(F.max("weight").alias("weight"))
    home = materialise(start.withColumn("home", F.col("weight") / start.agg(F.sum("weight")).scalar()).select("node", "home"), "home")
    rank = old = home.select("node", F.col("home").alias("rank"))
    for k in count(1) if rounds is None else range(1, rounds + 1):
        moved = rank.join(moves, rank.node == moves.src).select(F.col("dst").alias("node"), ((1 - alpha) * F.col("rank") * F.col("p")).alias("rank"))
        new = moved.unionByName(home.select("node", (alpha * F.col("home")).alias("rank"))).groupBy("node").agg(F.sum("rank").alias("rank"))
        if tolerance is not None:
            # the change rides along, so one shuffle gives both
            both = moved.withColumn("was", F.lit(0.0)).unionByName(home.select("node", (alpha * F.col("home")).alias("rank"), F.lit(0.0).alias("was"))).unionByName(
                rank.select("node", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
            new = materialise(both.groupBy("node").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "rank")
            moved_by = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            discard(old)
            old, rank = new, new.select("node", "rank")
            if (moved_by or 0.0) < tolerance:
                break
            if k == rounds:
                warnings.warn(f"PageRank changed by {moved_by:.3g} in its last round of {rounds}, tolerance {tolerance:g}", stacklevel=2)
        else:
            rank = materialise(new, "rank") if k % CUT == 0 and k < rounds else new
    return rank.filter(F.col("rank") > 1e-8)


def specificity(nodes: DataFrame, edges: DataFrame, threshold: float = 0.05, as_of: str = AS_OF) -> DataFrame:
    """(node_id, label, specificity): ln(n / (1 + degree)) + 1 over live edges, the largest made 1."""
    live = degrees(effective(edges, as_of).filter(F.col("eff") > threshold)).withColumnRenamed("node", "node_id")
    n = nodes.agg(F.count("*")).scalar()
    raw = nodes.select("node_id", "label").join(live, "node_id", "left").withColumn(
        "raw", F.ln(n / (1 + F.coalesce("degree", F.lit(0)))) + 1
    )
    top = raw.agg(F.max("raw")).scalar()
    return raw.select("node_id", "label", F.when(top > 0, F.col("raw") / top).otherwise(F.col("raw")).alias("specificity"))
