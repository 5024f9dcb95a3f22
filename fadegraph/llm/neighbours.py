"""Most similar vectors for every vector: score-aware quantisation and exact reranking.

Per space: unit vectors are cut into subspaces of two dimensions, each coded by
one of 16 centres (four bits).  Centres and codes are chosen under the
anisotropic loss |r|^2 + (eta - 1) (r . x)^2, which weighs the part of the
residual along the vector ``eta`` times the part across it, since only the former
shifts large inner products.  Leaves come from spherical k-means.  Each vector's
code goes to its ``SPILL`` nearest leaves; each vector stays, whole, in its one
nearest leaf and scans the codes there by table lookup (the tables of a block of
queries are applied at once, as a product with the decoded centres, which gives
the same sums).  What reaches the threshold is reranked by exact cosine.

A leaf is a pair of a coarse centre and a centre of what the coarse ones leave, so
that there are up to ``MAX_LEAVES`` times ``MAX_FINE`` leaves of a model of
``MAX_LEAVES`` + ``MAX_FINE`` rows; the second kind is used when the first alone would
give leaves of over ``LEAF`` vectors.  Queries and codes of a leaf are both dealt in
blocks of bounded size, and the best of the blocks are merged, so that a leaf with a
third of all vectors is many small tasks.

Model and leaves are fit on a sample of at most ``SAMPLE`` vectors a space,
a share by hash.  Every vector is indexed and every vector is a query.  The
number of leaves follows the number of vectors (about ``LEAF`` a leaf), and the
broadcast model stays under 2 MB a space of 96 dimensions.

Copies: vectors that agree to six digits after normalisation are one point.
Its first k + 1 ids take part; any further copy has the point's first k ids as
its neighbours, which is exact as ties go to the smaller id.

A candidate is kept when its approximate score reaches ``min_score - SLACK`` and
the query's k-th best approximate score minus twice the slack; no other cap.

Defined cases: vectors that are null, not n_dim long, all zero, or hold null,
NaN or infinity take no part; nor do rows with null id or space; repeated ids
count once; ties go to the smaller id; an empty table gives no rows; a space
with one vector gives none.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fadegraph.sources import materialise

SAMPLE, LEAF, MAX_LEAVES, MAX_FINE, SPILL, NEAR = 16_384, 400, 2_048, 512, 8, 16
CENTRES, SUB = 16, 2
SLACK, QUERY_BLOCK, CODE_BLOCK, ANISOTROPY_T = 0.15, 2_048, 65_536, 0.2
POINTS = "id bigint, space string, leaf int, spill array<int>, code binary, v array<float>"


def eta(dim: int, t: float = ANISOTROPY_T) -> float:
    """Weight of the parallel residual for scores of ``t`` and more."""
    return max(1.0, (dim - 1) * t * t / (1 - t * t))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; empty leaves are seeded anew."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        empty = norm[:, 0] < 1e-9
        c = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), c)
        if empty.any():
            c[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return c.astype(np.float32)


def encode(x: np.ndarray, book: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes (n, subspaces) that lower the anisotropic loss, by coordinate descent."""
    m, _, s = book.shape
    n, h = len(x), eta(x.shape[1]) - 1
    xs = x.reshape(n, m, s)
    codes = np.empty((n, m), np.uint8)
    par = np.zeros((n, m), np.float32)
    for j in range(m):
        d = ((xs[:, j, None] - book[j][None]) ** 2).sum(2)
        codes[:, j] = d.argmin(1)
        par[:, j] = (xs[:, j] * (xs[:, j] - book[j][codes[:, j]])).sum(1)
    total = par.sum(1)
    for _ in range(rounds):
        for j in range(m):
            diff = xs[:, j, None] - book[j][None]
            along = (xs[:, j, None] * diff).sum(2)
            rest = (total - par[:, j])[:, None]
            best = ((diff**2).sum(2) + h * (rest + along) ** 2).argmin(1)
            codes[:, j] = best
            now = along[np.arange(n), best]
            total += now - par[:, j]
            par[:, j] = now
    return codes


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Plain k-means of residuals; centre 0 is the origin."""
    c = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x[rng.choice(len(x), k - 1, replace=len(x) < k)]])
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, 1)
        s, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).astype(np.float32)
        c[0] = 0
    return c


def leaves_of(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray, k: int) -> np.ndarray:
    """The k nearest leaves of each vector, nearest first: coarse centre times the number of fine ones, plus fine centre.

    Pairs are sought below the ``NEAR`` nearest coarse centres; products with a pair are the sum of products with its parts.
    """
    a, b = x @ coarse.T, x @ fine.T
    m = min(max(NEAR, -(-k // len(fine))), len(coarse))
    top = np.argpartition(-a, m - 1, 1)[:, :m]
    cross = coarse @ fine.T
    half = 0.5 * (1 + 2 * cross + (fine * fine).sum(1)[None])  # half the square of a pair's sum, coarse centres being of length one
    score = np.take_along_axis(a, top, 1)[:, :, None] + b[:, None] - half[top]
    flat = score.reshape(len(x), -1)
    k = min(k, flat.shape[1])
    best = np.argpartition(-flat, k - 1, 1)[:, :k]
    order = np.take_along_axis(best, np.argsort(-np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
    return np.take_along_axis(top, order // len(fine), 1) * len(fine) + order % len(fine)


def fit(x: np.ndarray, leaves: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coarse centres, fine centres and the codebook (subspaces, 16, 2) of unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    few = min(leaves, MAX_LEAVES, len(x))
    c = _kmeans(x, few, 8, rng)
    near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])
    f = _means(x - c[near], int(np.clip(-(-leaves // few), 1, MAX_FINE)), 6, rng)
    n, m, h = len(x), -(-x.shape[1] // SUB), eta(x.shape[1]) - 1
    xs = np.pad(x, ((0, 0), (0, m * SUB - x.shape[1]))).reshape(n, m, SUB)
    book = np.stack([xs[rng.choice(n, CENTRES, replace=n < CENTRES), j] for j in range(m)]).astype(np.float32)
    flat = np.ascontiguousarray(xs.reshape(n, m * SUB))
    for _ in range(6):
        codes = encode(flat, book, 1)
        part = np.stack([(xs[:, j] * (xs[:, j] - book[j][codes[:, j]])).sum(1) for j in range(m)], 1)
        total = part.sum(1)
        for j in range(m):
            rest = total - part[:, j]
            for k in range(CENTRES):
                sel = codes[:, j] == k
                if sel.any():
                    v = xs[sel, j].astype(float)
                    # the centre with least loss: (n I + h sum v v') c = sum v + h sum v (rest + |v|^2)
                    a = sel.sum() * np.eye(SUB) + h * v.T @ v
                    b = v.sum(0) + h * v.T @ (rest[sel] + (v * v).sum(1))
                    book[j, k] = np.linalg.solve(a, b)
    return c, f, book


def _decoded(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    m = len(book)
    return book[np.arange(m)[None], codes].reshape(len(codes), -1)


def _pack(codes: np.ndarray) -> list[bytes]:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return [r.tobytes() for r in (codes[:, ::2] | (codes[:, 1::2] << 4))]


def _unpack(rows: list[bytes], m: int) -> np.ndarray:
    b = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.stack([b & 15, b >> 4], 2).reshape(len(rows), -1)[:, :m]


def _padded(x: np.ndarray, m: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, m * SUB - x.shape[1])))


def usable(df: DataFrame, vec: str, n_dim: str) -> DataFrame:
    """Rows with a usable vector: ``v`` and its length ``norm``."""
    v = F.col(vec)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (
        df.filter(v.isNotNull() & (F.size(v) == F.col(n_dim)) & (F.size(v) > 0))
        .withColumns({"v": v.cast("array<float>"), "norm": F.sqrt(square)})
        .filter(F.col("norm").isNotNull() & ~F.isnan("norm") & (F.col("norm") > 0) & (F.col("norm") < float("inf")))
    )


def _six_digits(v: str, norm: str) -> Column:
    """A vector at length one, in whole millionths.

    The length goes through a struct: inlined into the lambda it would be computed for each element.
    """
    one = F.array(F.struct(F.col(v).alias("v"), F.col(norm).alias("n")))
    return F.transform(one, lambda s: F.transform(s["v"], lambda x: F.round(x.cast("double") / s["n"] * 1e6).cast("int")))[0]


def _units(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack(frame["v"].to_numpy()).astype(np.float32)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _index(models):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for space, g in f.groupby("space"):
                coarse, fine, book = models.value[space]
                x = _units(g)
                top = np.concatenate([leaves_of(x[i : i + 1024], coarse, fine, SPILL) for i in range(0, len(x), 1024)])
                codes = encode(_padded(x, len(book)), book)
                yield pd.DataFrame({
                    "id": g["id"].to_numpy(), "space": space, "leaf": top[:, 0].astype(np.int32),
                    "spill": list(top.astype(np.int32)), "code": _pack(codes), "v": list(x),
                })

    return run


def _scan(models, k: int, min_score: float):
    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(codes):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "near": pd.Series(dtype="float32"), "kth": pd.Series(dtype="float32")})
        book = models.value[queries["space"].iloc[0]][2]
        x = _decoded(_unpack(list(codes["c_code"]), len(book)), book)
        q = _padded(np.stack(queries["v"].to_numpy()).astype(np.float32), len(book))
        qi, ci = queries["id"].to_numpy(), codes["c_id"].to_numpy()
        out = []
        for s in range(0, len(q), 256):
            score = q[s : s + 256] @ x.T
            score[qi[s : s + 256][:, None] == ci[None]] = -2
            kth = -np.partition(-score, k - 1, 1)[:, k - 1] if score.shape[1] > k else np.full(len(score), -2.0)
            i, j = np.nonzero(score >= np.maximum(min_score - SLACK, kth - 2 * SLACK)[:, None])
            out.append(pd.DataFrame({"a": qi[s + i], "b": ci[j], "near": score[i, j].astype(np.float32), "kth": kth[i].astype(np.float32)}))
        return pd.concat(out)

    return run


def most_similar(df: DataFrame, vec_id: str, space: str, vec: str, n_dim: str, k: int = 5, min_score: float = -1.0) -> DataFrame:
    """(id, other, score, place): the k most similar of every vector with at least ``min_score``, place from 1."""
    spark = df.sparkSession
    rows = usable(df.filter(F.col(vec_id).isNotNull() & F.col(space).isNotNull()), vec, n_dim).select(
        F.col(vec_id).alias("id"), F.col(space).alias("space"), "v", "norm", _six_digits("v", "norm").alias("six")
    )
    rows = rows.withColumn("point", F.struct(F.xxhash64("six"), F.xxhash64(F.lit(7), "six"), F.size("six"))).drop("six")
    rows = materialise(rows.dropDuplicates(["space", "id"]), "vectors")
    by_id = W.partitionBy("space", "point").orderBy("id")
    placed = materialise(rows.withColumn("rn", F.row_number().over(by_id)).filter(F.col("rn") <= k + 1), "points")
    stats = placed.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).collect()
    models = {}
    for s in stats:
        # a share of all by hash that holds SAMPLE at most, but for chance; the limit makes it sure
        share = min(1.0, 0.97 * SAMPLE / s.n)
        some = placed.filter(
            (F.col("space") == s.space) & (F.size("v") == s.dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        ).limit(SAMPLE).select("id", "v").toPandas().sort_values("id")
        x = _units(some) if len(some) else np.eye(s.dim, dtype=np.float32)
        models[s.space] = fit(x, int(np.clip(s.n // LEAF, 1, MAX_LEAVES * MAX_FINE)))
    shared = spark.sparkContext.broadcast(models)
    index = materialise(placed.select("id", "space", "v").mapInPandas(_index(shared), POINTS), "index")

    # queries and codes of a leaf in blocks of bounded size; each block of the one meets each of the other
    spilt = index.select("id", "space", F.explode("spill").alias("leaf"), "code")
    many = lambda c, of: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / of)).cast("int")
    sizes = index.groupBy("space", "leaf").agg(F.count("*").alias("nq")).join(spilt.groupBy("space", "leaf").agg(F.count("*").alias("nc")), ["space", "leaf"]).select(
        "space", "leaf", many(F.col("nq"), QUERY_BLOCK).alias("qs"), many(F.col("nc"), CODE_BLOCK).alias("cs"))
    sizes = materialise(sizes, "leaves")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = index.join(sizes, ["space", "leaf"]).select(
        "id", "space", "leaf", F.pmod(F.xxhash64("id"), F.col("qs")).cast("int").alias("block"), every("cs").alias("other"), "v"
    )
    codes = spilt.join(sizes, ["space", "leaf"]).select(
        F.col("id").alias("c_id"), F.col("space").alias("c_space"), F.col("leaf").alias("c_leaf"),
        every("qs").alias("c_block"), F.pmod(F.xxhash64("id"), F.col("cs")).cast("int").alias("c_other"), F.col("code").alias("c_code"),
    )
    keys = ["space", "leaf", "block", "other"]
    scanned = queries.groupBy(*keys).cogroup(codes.groupBy(*(f"c_{c}" for c in keys))).applyInPandas(_scan(shared, k, min_score), "a bigint, b bigint, near float, kth float")
    if sizes.filter("cs > 1").limit(1).count():
        # a query's k-th best is at least that of its best block
        scanned = materialise(scanned, "scanned")
        floor = scanned.groupBy("a").agg(F.max("kth").alias("floor"))
        scanned = scanned.join(floor, "a").filter(F.col("near") >= F.col("floor") - 2 * SLACK)
    found = scanned.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = placed.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    y = placed.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    exact = found.join(x, "a").join(y, "b").select("a", "b", (dot / (F.col("na") * F.col("nb"))).alias("score")).filter(F.col("score") >= min_score)
    exact = materialise(exact, "pairs")
    sides = exact.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(
        exact.select(F.col("b").alias("id"), F.col("a").alias("other"), "score")
    )
    best = W.partitionBy("id").orderBy(F.desc("score"), "other")
    near = sides.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    # copies beyond the first k + 1 of a point: the point's first k ids, at score one
    late = rows.select("id", "space", "point").join(placed.select("space", "id"), ["space", "id"], "left_anti")
    head = placed.filter(F.col("rn") <= k).select("space", "point", F.col("id").alias("other"), F.col("rn").alias("place"))
    copies = late.join(head, ["space", "point"]).select("id", "other", F.lit(1.0).alias("score"), "place")
    return near.unionByName(copies)


def pairs(nearest: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of which one is among the other's neighbours."""
    return nearest.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()
