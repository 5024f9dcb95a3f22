"""Mixing sources to target weights by balanced sampling with the cube method.

The mixture is the largest one that meets every target share: its size in
tokens is min over sources of max_repeats x tokens / target_share.  A document
is then used ``e = size x share / tokens of its source`` times in expectation.
The whole part of e is certain; the fractional part is an inclusion probability
which the cube method rounds to 0 or 1 while it keeps the source's totals of
tokens and of documents.

Flight: probabilities move through the null space of the constraints, three
open documents at a time, until each is 0 or 1.  Sources are cut into blocks of
``BLOCK`` documents by hash, each block flies alone and leaves two documents
open at most; those fly again in fewer blocks, until one block a source is left.
Landing: the last open documents of a source are rounded to the outcome nearest
to the totals.  So a source with a third of all rows is spread over all tasks.

Randomness comes from a hash of the seed and the block, so recomputing a lost
task gives the same draw.

Defined cases: documents without tokens (null and empty texts) are never used;
sources without target, and a null source, aren't wanted; a target whose source
has no tokens leaves the mixture and its share is reported as 0 (the others keep
their proportions); repeated targets of a source count once, by the largest
share; a null or missing max_repeats means 1; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.sources import materialise

BLOCK = 8_192
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round ``p`` within [0, 1], keeping sum(p) and sum(p * size); at most two entries stay open.

    A random order, then three open entries at a time: their null direction is
    the cross product of the two constraint rows, and a random one of the two
    steps that reach a face is taken, with chances that keep expectations.
    """
    p = p.astype(float).copy()
    p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
    todo = [int(i) for i in rng.permutation(np.flatnonzero((p > 0) & (p < 1)))]
    draws = rng.random(len(todo) + 3)
    held: list[int] = []
    k = 0
    for i in todo:
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u[0] == u[1] == u[2] == 0:
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[x]) / d if d > 0 else -p[x] / d) for x, d in zip(held, u) if d)
            down = min((p[x] / d if d > 0 else (p[x] - 1) / d) for x, d in zip(held, u) if d)
            step = up if draws[k % len(draws)] < down / (up + down) else -down
            k += 1
            for x, d in zip(held, u):
                p[x] += step * d
                if p[x] < EPS:
                    p[x] = 0.0
                elif p[x] > 1 - EPS:
                    p[x] = 1.0
            held = [x for x in held if 0 < p[x] < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few open entries to the outcome whose totals come nearest."""
    p = p.copy()
    p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want = np.array([p[open_] @ size[open_], p[open_].sum()])
    unit = np.array([max(size[open_].max(), 1.0), 1.0])
    options = ((np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1).astype(float)
    miss = (np.stack([options @ size[open_], options.sum(1)], 1) - want) / unit
    p[open_] = options[np.argmin((miss**2).sum(1))]
    return p


def _fly(seed: int, last: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop(columns="block").sort_values(["h", "uid"]).reset_index(drop=True)
        p, size = f["p"].to_numpy(float), f["n_tokens"].to_numpy(float)
        p = flight(p, size, np.random.default_rng([seed, int(f["h"].iloc[0]) & 0x7FFFFFFF, len(f)]))
        if last:
            p = landing(p, size)
        return f.assign(p=p)

    return run


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every document used at least once.

    ``docs`` has doc_id, source and n_tokens.
    """
    goal = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")
    )
    sized = materialise(
        docs.filter("n_tokens > 0").join(goal, "source").select(
            F.col(doc_id).alias("uid"), "source", "n_tokens", "share", "cap",
            F.xxhash64(F.lit(seed), doc_id).alias("h"),
        ),
        "sized",
    )
    have = sized.groupBy("source").agg(
        F.sum("n_tokens").alias("have"), F.count("*").alias("docs"), F.max("share").alias("s"), F.max("cap").alias("c")
    )
    total = have.agg(F.min(F.col("c") * F.col("have") / F.col("s")).alias("t")).scalar()
    # one row a source of the targets
    plan = have.withColumn("e", F.least(total * F.col("s") / F.col("have"), F.col("c").cast("double"))).select(
        "source", "docs", F.col("e"), F.floor(F.col("e") + EPS).alias("whole")
    )
    state = sized.join(plan, "source").select(
        "uid", "source", "n_tokens", "h", "whole", "docs",
        F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)).alias("p"),
    )
    schema = "uid bigint, source string, n_tokens bigint, h bigint, whole bigint, docs bigint, p double"
    done = state.filter(f"p <= {EPS} OR p >= 1 - {EPS}").withColumn("p", F.round("p"))
    open_ = state.filter(f"p > {EPS} AND p < 1 - {EPS}")
    # the largest source tells how often the open documents, two a block, must fly again
    widest = plan.agg(F.max("docs")).first()[0] or 0
    while True:
        last = widest <= BLOCK
        blocks = F.lit(0) if last else F.pmod("h", F.ceil(F.col("docs") / BLOCK)).cast("int")
        # documents that fly again are dealt to fewer blocks
        flown = materialise(
            open_.withColumn("block", blocks).groupBy("source", "block")
            .applyInPandas(_fly(seed, last), schema),
            "flight",
        )
        done = done.unionByName(flown.filter("p = 0 OR p = 1"))
        if last:
            break
        open_ = flown.filter("p > 0 AND p < 1").withColumn("docs", F.ceil(F.col("docs") / BLOCK) * 2).withColumn(
            "h", F.xxhash64("h")
        )
        widest = -(-widest // BLOCK) * 2
    return done.select(
        F.col("uid").alias(doc_id), "source", "n_tokens", (F.col("whole") + F.col("p")).cast("int").alias("uses")
    ).filter("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, docs, most_uses): the shares reached, one row a target."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses")
    )
    whole = got.agg(F.sum("tokens")).scalar()
    want = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    return want.join(got, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
