"""Question suites: search every question with every preset and report its quality."""
from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.operators import fusion, metrics


def run(nodes: DataFrame, edges: DataFrame, questions: DataFrame, presets: tuple[str, ...] = ("cli",), k: int = 10, as_of: str | None = None,
        vectors: DataFrame | None = None) -> DataFrame:
    """(preset, id, recall, path, rank, latency): one row a question and preset.

    ``questions`` has id, question, gold (its entities in the order of its chain).  A suite is small: its questions come to the driver, each
    search is a plan of its own.  Rank is the first hit's place from 0, null without one.
    """
    out = []
    for q in questions.select("id", "question", "gold").collect():
        for preset in presets:
            began = time.perf_counter()
            found = [r.label for r in fusion.hybrid_search(nodes, edges, q.question, k, preset, vectors, as_of).orderBy(F.desc(F.round("score", 9)), "label").collect()]
            out.append((preset, q.id, list(q.gold or []), found, time.perf_counter() - began))
    rows = questions.sparkSession.createDataFrame(out, "preset string, id string, gold array<string>, found array<string>, latency double")
    hits = F.transform("found", lambda f: F.exists("gold", lambda g: metrics.hit(f, g)))
    return rows.select(
        "preset", "id", metrics.entity_recall(F.col("found"), F.col("gold"), k)["recall"].alias("recall"), metrics.path_recall(F.col("found"), F.col("gold")).alias("path"),
        (F.nullif(F.array_position(hits, True), F.lit(0)) - 1).alias("rank"), "latency")


def ablation(runs: DataFrame) -> DataFrame:
    """(preset, questions, recall, path, mrr, latency): means per preset."""
    return runs.groupBy("preset").agg(
        F.count("*").alias("questions"), F.avg("recall").alias("recall"), F.avg("path").alias("path"),
        F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0 / (F.col("rank") + 1))).alias("mrr"), F.avg("latency").alias("latency"))


def gold_of(suite: DataFrame) -> DataFrame:
    """(id, question, gold) of a loaded suite: the titles of its supporting paragraphs in order."""
    return suite.select("id", "question", F.array_distinct(F.transform("supporting", lambda p: p["title"])).alias("gold"))
