"""Ranked lists and their fusion.

A ranked list is (list_no, source, label, score); ranks are counted per list from
0 by score, then label.  Lists are top-k results, so the windows that rank them
and the greedy diversification see bounded input.
"""
from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fadegraph.functions import exprs
from fadegraph.operators.text import capital_runs

K = 60


def fuzzy_search(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(label, score): labels that answer a query, best first; nothing for a blank query."""
    score = exprs.fuzzy_score(F.col("label"), query)
    return nodes.select("label", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "label").limit(limit)


def as_list(results: DataFrame, list_no: int, source: str) -> DataFrame:
    """Results (label, score) as a ranked list."""
    return results.select(F.lit(list_no).alias("list_no"), F.lit(source).alias("source"), "label", "score")


def _ranked(lists: DataFrame) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(W.partitionBy("list_no").orderBy(F.desc("score"), "label")) - 1)


def rrf(lists: DataFrame, k: int = K) -> DataFrame:
    """(label, score, sources): reciprocal ranks summed over the lists, sources in order of the lists."""
    gain = (1.0 / (k + F.col("rank") + 1)).alias("gain")
    return _ranked(lists).select("list_no", "source", "label", gain).groupBy("label").agg(
        F.sum("gain").alias("score"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("list_no", "source"))), lambda x: x["source"])).alias("sources"),
    )


def rrf_specificity(lists: DataFrame, specificity: DataFrame, k: int = K) -> DataFrame:
    """The same times 0.7 + 0.3 x specificity (0.5 where unknown)."""
    s = specificity.groupBy("label").agg(F.max("specificity").alias("s"))
    return rrf(lists, k).join(s, "label", "left").select(
        "label", (F.col("score") * (0.7 + 0.3 * F.coalesce("s", F.lit(0.5)))).alias("score"), "sources"
    )


def temporal_rerank(results: DataFrame, touched: DataFrame, as_of: str) -> DataFrame:
    """(label, score): times 1 + 0.5 e^(-hours / 168), times specificity; a week and 0.5 where unknown.

    ``touched`` has label, last_seen and specificity.
    """
    hours = F.coalesce(exprs.hours_since(F.col("last_seen"), exprs.ts(as_of)), F.lit(168.0))
    return results.join(touched, "label", "left").select(
        "label", (F.col("score") * (1 + 0.5 * F.exp(-hours / 168.0)) * F.coalesce("specificity", F.lit(0.5))).alias("score")
    )


def _overlap(a: set[str], b: set[str]) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def mmr(results: DataFrame, limit: int = 10, balance: float = 0.7, query: str = "query") -> DataFrame:
    """(query, label, score, place): greedy choice of relevance against likeness to what was chosen.

    Likeness is the Jaccard overlap of words.  ``results`` are top-k lists per query.
    """

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "label"], ascending=[False, True]).reset_index(drop=True)
        bags = [set(x.lower().split()) for x in f["label"]]
        alike = [0.0] * len(f)
        left, taken = list(range(len(f))), []
        while left and len(taken) < limit:
            gain = (lambda i: balance * f["score"][i] - (1 - balance) * alike[i]) if taken else (lambda i: f["score"][i])
            best = max(left, key=lambda i: (gain(i), -i))
            left.remove(best)
            taken.append(best)
            for i in left:
                alike[i] = max(alike[i], _overlap(bags[i], bags[best]))
        out = f.loc[taken, [query, "label", "score"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    kind = dict(results.dtypes)[query]
    return results.select(query, "label", "score").groupBy(query).applyInPandas(choose, f"{query} {kind}, label string, score double, place int")


# Words no query entity consists of, and words that join parts of a name.
QUERY_STOP = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for "
    "on with at by from as into through during before after above below between out off over under again further then once here there when where "
    "why how all both each few more most other some such no nor not only own same so than too very just because but and or if while what which who "
    "whom this that these those i me my myself we our you your he him his she her it its they them their".split()
)
JOINERS = frozenset("of the de von van del la le di".split())


def query_entities(query: str) -> list[str]:
    """What a query may be about: quoted parts, capitalised runs, long words, else word pairs and triples."""
    import re

    found: list[str] = []

    def add(x: str) -> None:
        if x and x not in found:
            found.append(x)

    for quoted in re.finditer(r"\"([^\"]*)\"|'([^']*)'", query):
        add((quoted[1] or quoted[2] or "").strip())
    words = [re.sub(r"^[^\w]+|[^\w]+$", "", w).strip("_") for w in query.split()]
    capital = lambda w: bool(w) and w[0].isupper()
    for i, j in capital_runs(words, QUERY_STOP, JOINERS):
        add(" ".join(words[i:j]))
    for w in words:
        if len(w.encode()) >= 4 and w.lower() not in QUERY_STOP and not any(w.lower() in e.lower() for e in found):
            found.append(w)
    if not any(capital(e) for e in found):
        content = [w for w in words if w and w.lower() not in QUERY_STOP]
        for n in (2, 3):
            for j in range(len(content) - n + 1):
                phrase = " ".join(content[j : j + n])
                if len(phrase.encode()) >= 4 and phrase.lower() not in {e.lower() for e in found}:
                    found.append(phrase)
    return found


#: Paths of a hybrid search and their presets.
PRESETS = {
    "rpc": ("graph", "hdc", "fuzzy"), "cli": ("graph", "hdc", "fuzzy", "ppr"), "bench": ("graph", "hdc", "fuzzy", "ppr", "ppr"),
    "graph_only": ("graph",), "hdc_only": ("hdc",), "fuzzy_only": ("fuzzy",), "ppr_only": ("ppr",),
    "graph_hdc": ("graph", "hdc"), "no_ppr": ("graph", "hdc", "fuzzy"), "no_graph": ("hdc", "fuzzy", "ppr"), "full": ("graph", "hdc", "fuzzy", "ppr"),
}


def hybrid_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 10, preset: str | tuple[str, ...] = "cli",
                  vectors: DataFrame | None = None, as_of: str | None = None, hops: int = 3, minimum: float = 0.15, rounds: int = 50) -> DataFrame:
    """(label, score, sources): lists of the chosen paths fused by reciprocal rank.

    ``vectors`` (term, vec) feeds the hdc path; without it that list is empty.
    Seeds of walks are the query's entities and its best fuzzy labels.
    """
    from functools import reduce

    from fadegraph.operators import hdc, rank, traverse
    from fadegraph.operators.graph import AS_OF, adjacency

    as_of = as_of or AS_OF
    paths = PRESETS[preset] if isinstance(preset, str) else preset
    if {"graph", "ppr"} & set(paths):
        edges = adjacency(edges, as_of)
    asked = [query, *query_entities(query)]
    fuzzy = reduce(DataFrame.unionByName, [fuzzy_search(nodes, q, limit) for q in asked]).groupBy("label").agg(F.max("score").alias("score"))
    named = nodes.select("node_id", "label")

    def seeds(least: float, n: int) -> DataFrame:
        near = fuzzy.filter(F.col("score") >= least).orderBy(F.desc("score"), "label").limit(n)
        return named.join(near, "label", "left_semi").select(F.col("node_id").alias("node")).distinct()

    lists, done = [], {}
    for i, path in enumerate(paths):
        if path == "fuzzy":
            got = fuzzy
        elif path == "graph":
            walked = traverse.traverse(edges, seeds(0.5, 3), hops, minimum, limit, paths=False, as_of=as_of)
            got = walked.join(named, F.col("node") == F.col("node_id")).groupBy("label").agg(F.max("score").alias("score"))
        elif path == "ppr":
            if "ppr" in done:  # the same list again weighs twice
                lists.append(done["ppr"].withColumn("list_no", F.lit(i)))
                continue
            ranked = rank.pagerank(edges, seeds(0.7, 5), rounds=rounds, as_of=as_of).orderBy(F.desc("rank"), "node").limit(limit)
            got = ranked.join(named, F.col("node") == F.col("node_id")).groupBy("label").agg(F.max("rank").alias("score"))
        elif path == "hdc" and vectors is not None:
            every = reduce(DataFrame.unionByName, [hdc.search_labels(vectors, q, limit) for q in dict.fromkeys(a.strip().lower() for a in asked)])
            got = every.groupBy("label").agg(F.max("score").alias("score"))
        else:
            continue
        done[path] = as_list(got.orderBy(F.desc("score"), "label").limit(limit), i, path)
        lists.append(done[path])
    if not lists:
        return rrf(as_list(fuzzy.limit(0), 0, "none"))
    return rrf(reduce(DataFrame.unionByName, lists)).orderBy(F.desc(F.round("score", 9)), "label").limit(limit)
