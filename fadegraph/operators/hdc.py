"""Hyperdimensional vectors in sparse long form: (token, dim, val).

A token's base vector has ``nonzero`` positions derived from md5, so any engine
can rebuild it.  Context vectors sum the base vectors of neighbours within a
window, weighted by idf; neighbour pairs are counted first (map-side), so each
pair is expanded once however often it occurs.

A pair is expanded only where its token is summed: the draws of a token are
packed in one value (two bytes a draw), joined to the pairs by a merge (sizes
guessed from the files are far too small here, and a broadcast of all draws kills
the driver), and the pairs of a token are summed in the order they are read into
one array of ``dims`` places.  Of tokens with at least one in ``HOT`` of all
document frequencies, at most ``HOT`` of them, no draws are sent; they are drawn anew in
each task.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from fadegraph.functions import exprs

#: Tokens without sent draws at most; codes expanded, and bytes of vectors given out, at a time.
HOT, BLOCK, BYTES = 2_048, 1_000_000, 4_000_000


def token_lists(sentences: DataFrame, sent_id: str, text: str) -> DataFrame:
    """(sent, tokens) of texts."""
    return sentences.select(F.col(sent_id).alias("sent"), exprs.tokens(F.col(text)).alias("tokens"))


def document_frequency(sents: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(N / (df + 1)) + 1 over sentences with tokens."""
    full = sents.filter(F.size("tokens") > 0)
    n = full.agg(F.count("*")).scalar()
    return full.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).withColumn(
        "idf", F.ln(n / (F.col("df") + 1)) + 1
    )


def base_vectors(tokens: DataFrame, dims: int = 10_000, nonzero: int | None = None) -> DataFrame:
    """(token, dim, val) with val 1 or -1; a position drawn twice keeps the later draw."""
    n = nonzero or max(1, dims // 100)
    digest = F.md5(F.concat("token", F.lit(":"), F.col("i").cast("string")))
    drawn = tokens.select("token", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(
        "token", "i",
        F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int").alias("dim"),
        F.when(F.pmod(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("val"),
    )
    return drawn.groupBy("token", "dim").agg(F.max_by("val", "i").alias("val"))


def neighbour_counts(sents: DataFrame, window: int = 5) -> DataFrame:
    """(token, other, n): how often ``other`` stands within ``window`` places of ``token``."""
    t = sents.select("tokens", F.posexplode("tokens").alias("i", "token"))
    near = F.slice("tokens", F.greatest(F.lit(1), F.col("i") + 1 - window), F.col("i") + 1 - F.greatest(F.lit(1), F.col("i") + 1 - window))
    after = F.slice("tokens", F.col("i") + 2, F.lit(window))
    return t.select("token", F.explode(F.concat(near, after)).alias("other")).groupBy("token", "other").agg(F.count("*").alias("n"))


def _kind(dims: int) -> type:
    return np.int16 if dims < 32_767 else np.int32


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // n)
    return (b.slice(i, step) for b in batches for i in range(0, len(b), step))


def _drawn(tokens: list[bytes], dims: int, n: int) -> np.ndarray:
    """A row of n codes for each token, the same draws as ``base_vectors``: place + 1 with the value's sign, 0 for a place that is drawn again later."""
    if not tokens:
        return np.zeros((0, n), _kind(dims))
    ends = [b":%d" % i for i in range(n)]
    raw = np.frombuffer(b"".join(hashlib.md5(t + e, usedforsecurity=False).digest() for t in tokens for e in ends), np.uint8).reshape(len(tokens), n, 16)
    place = np.ascontiguousarray(raw[:, :, :4]).view(">u4")[:, :, 0].astype(np.int64) % dims
    code = np.where(raw[:, :, 4] % 2 == 0, place + 1, -place - 1).astype(_kind(dims))
    order = np.argsort(place, axis=1, kind="stable")
    ranked = np.take_along_axis(place, order, 1)
    row, at = np.nonzero(ranked[:, :-1] == ranked[:, 1:])
    code[row, order[row, at]] = 0
    return code


def _with_draws(df: DataFrame, dims: int, n: int) -> DataFrame:
    """``df`` with the packed draws of its column other; null where hot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, n):
            hot, names = b.column("hot").to_pylist(), b.column("other").cast(pa.binary()).to_pylist()
            codes = iter(_drawn([x for x, h in zip(names, hot) if not h], dims, n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if h else next(codes).tobytes() for h in hot], pa.binary())], [*b.schema.names, "draws"])

    return df.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField("draws", T.BinaryType())]))


def _weighted(sents: DataFrame, window: int, dims: int, n: int, only: str | None = None) -> DataFrame:
    """(token, w, word, draws): each token's neighbours with their weight, and each token itself with a null weight; draws, or the word to draw for. ``only``: of that token alone."""
    frequency = document_frequency(sents).filter("token IS NOT NULL")
    hot = F.col("df") * HOT >= frequency.agg(F.sum("df")).scalar()
    known = frequency.select(F.col("token").alias("other"), "idf", (hot if only is None else F.lit(False)).alias("hot"))
    own = frequency.select("token", F.col("token").alias("other"), F.lit(None).cast("bigint").alias("n"))
    pairs = neighbour_counts(sents, window).filter("token IS NOT NULL AND other IS NOT NULL").unionByName(own)
    if only is None:
        rows = pairs.join(_with_draws(known, dims, n).hint("merge"), "other")
    else:
        rows = _with_draws(pairs.filter(F.col("token") == only).join(known.hint("merge"), "other"), dims, n)
    return rows.select("token", (F.col("n") * F.col("idf")).alias("w"), F.when(F.col("draws").isNull(), F.col("other")).alias("word"), "draws")


def _summed(batches: Iterator[pa.RecordBatch], dims: int, n: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(token, its places, the values there), of length one, of rows of ``_weighted`` that come sorted by token."""
    hot: dict[bytes, np.ndarray] = {}
    name, total, met, base, more = None, np.zeros(dims), np.zeros(dims, np.int64), None, False

    def ended() -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        if name is None:
            return
        if more:
            places = np.flatnonzero(met)
            values = total[places]
        else:
            kept = base[base != 0].astype(np.int64)
            places, values = np.abs(kept) - 1, np.sign(kept).astype(float)
        norm = np.sqrt(values @ values)
        if norm > 0:
            yield name, places, values / norm

    for b in _slices(batches, n):
        tokens, draws = b.column("token").cast(pa.binary()).dictionary_encode(), b.column("draws")
        words = b.column("word").cast(pa.binary()).filter(draws.is_null()).to_pylist()
        new = [x for x in dict.fromkeys(words) if x not in hot]
        hot.update(zip(new, _drawn(new, dims, n)))
        codes = np.zeros((len(b), n), _kind(dims))
        bare = draws.is_null().to_numpy(zero_copy_only=False)
        codes[~bare] = np.frombuffer(b"".join(draws.drop_null().to_pylist()), codes.dtype).reshape(-1, n)
        if words:
            codes[bare] = np.stack([hot[x] for x in words])
        w = b.column("w").to_numpy(zero_copy_only=False).astype(float)
        own = np.isnan(w)
        places, values = np.abs(codes).astype(np.int64), np.sign(codes) * np.where(own, 0.0, w)[:, None]
        places[own] = 0
        begins = np.searchsorted(tokens.indices.to_numpy(), np.arange(len(tokens.dictionary) + 1))
        for k, token in enumerate(tokens.dictionary.to_pylist()):
            if token != name:
                yield from ended()
                name, total, met, base, more = token, np.zeros(dims), np.zeros(dims, np.int64), None, False
            i, j = begins[k], begins[k + 1]
            mine = np.flatnonzero(own[i:j])
            if len(mine):
                base = codes[i + mine[0]].copy()
            if len(mine) < j - i:
                more, at = True, places[i:j].ravel()
                total += np.bincount(at, values[i:j].ravel(), dims + 1)[1:]
                met += np.bincount(at, None, dims + 1)[1:]
    yield from ended()


def _by_token(rows: DataFrame) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token")


def context_vectors(sents: DataFrame, window: int = 5, dims: int = 10_000, nonzero: int | None = None, only: str | None = None) -> DataFrame:
    """(token, dim, val) of length one: idf-weighted sums of neighbours' base vectors; with ``only``, of that token.

    A token that never has a neighbour keeps its base vector.
    """
    n = nonzero or max(1, dims // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            names, places, values = zip(*held)
            each = pa.array(np.repeat(np.arange(len(names), dtype=np.int32), list(map(len, places))))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(each).view(pa.string()), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(values))], ["token", "dim", "val"])

        held, size = [], 0
        for name, at, values in _summed(batches, dims, n):
            step = max(1, BYTES // (len(name) + 16))  # a long token stands in each of its rows
            for i in range(0, len(at), step):
                held.append((name, at[i : i + step], values[i : i + step]))
                size += len(held[-1][1]) * (len(name) + 16)
                if size >= BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return _by_token(_weighted(sents, window, dims, n, only)).mapInArrow(run, "token string, dim int, val double")


def most_similar_contexts(sents: DataFrame, token: str, k: int = 10, window: int = 5, dims: int = 10_000, nonzero: int | None = None) -> DataFrame:
    """``most_similar`` over ``context_vectors``: each vector is compared where it is summed. The one token's vector, at most ``dims`` rows, comes to the driver first."""
    n = nonzero or max(1, dims // 100)
    one = context_vectors(sents, window, dims, nonzero, token).select("dim", "val").toArrow()
    places, q = one["dim"].to_numpy(), np.zeros(dims)
    q[places] = one["val"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(dims, bool)
        there[places] = True
        near = ((name, float(values @ q[at])) for name, at, values in _summed(batches, dims, n) if there[at].any())
        while some := list(islice(near, 1_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.binary()).view(pa.string()), pa.array([x for _, x in some])], ["token", "score"])

    return _by_token(_weighted(sents, window, dims, n)).mapInArrow(run, "token string, score double").filter(F.col("token") != token).orderBy(F.desc(F.round("score", 9)), "token").limit(k)


def most_similar(vectors: DataFrame, token: str, k: int = 10) -> DataFrame:
    """(token, score): sparse cosine with unit vectors, the token itself left out."""
    q = vectors.filter(F.col("token") == token).select("dim", F.col("val").alias("q"))
    return (
        vectors.filter(F.col("token") != token).join(q, "dim").groupBy("token").agg(F.sum(F.col("val") * F.col("q")).alias("score"))
        .orderBy(F.desc(F.round("score", 9)), "token").limit(k)
    )


def encode_sentences(sents: DataFrame, vectors: DataFrame, idf: DataFrame) -> DataFrame:
    """(sent, dim, val): idf-weighted sum of the tokens' vectors, of length one."""
    t = sents.select("sent", F.explode("tokens").alias("token")).groupBy("sent", "token").agg(F.count("*").alias("n"))
    s = t.join(idf.select("token", "idf"), "token").join(vectors, "token").groupBy("sent", "dim").agg(F.sum(F.col("n") * F.col("idf") * F.col("val")).alias("val"))
    norm = s.groupBy("sent").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return s.join(norm, "sent").filter("norm > 0").select("sent", "dim", (F.col("val") / F.col("norm")).alias("val"))


def search(encoded: DataFrame, sent, k: int = 10) -> DataFrame:
    """(sent, score): the encoded sentences most like one of them (its id, a value or a column), itself left out."""
    q = encoded.filter(F.col("sent") == sent).select("dim", F.col("val").alias("q"))
    return encoded.filter(F.col("sent") != sent).join(q, "dim").groupBy("sent").agg(F.sum(F.col("val") * F.col("q")).alias("score")).orderBy(F.desc(F.round("score", 9)), "sent").limit(k)


def similarity(a: str, b: str, neural: DataFrame, context: DataFrame, name: str = "term", vec: str = "vec") -> DataFrame:
    """(score): likeness of two keys: dense cosine if both have a neural vector, else the sparse one of their context vectors, 0 without."""
    x, y = a.strip().lower(), b.strip().lower()
    one = lambda k, c: neural.filter(F.lower(name) == k).agg(F.min_by(vec, name).alias(c))
    dense = one(x, "va").select("va", one(y, "vb").scalar().alias("vb"))
    sparse = context.filter(F.col("token") == x).select("dim", F.col("val").alias("p")).join(context.filter(F.col("token") == y).select("dim", F.col("val").alias("q")), "dim").agg(F.sum(F.col("p") * F.col("q")))
    both = F.col("va").isNotNull() & F.col("vb").isNotNull() & (F.size("va") == F.size("vb"))
    return dense.select(F.when(both, exprs.cosine(F.col("va"), F.col("vb"))).otherwise(F.coalesce(sparse.scalar(), F.lit(0.0))).alias("score"))


def save_vectors(context: DataFrame, neural: DataFrame, frequency: DataFrame, path: str) -> None:
    """A snapshot of vectors and document frequencies; a path is written once."""
    context.repartition("token").sortWithinPartitions("token", "dim").write.parquet(f"{path}/context")
    neural.write.parquet(f"{path}/neural")
    frequency.write.parquet(f"{path}/frequency")


def load_vectors(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Context vectors, neural vectors and frequencies of a snapshot."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("context", "neural", "frequency"))


def dense_top(vectors: DataFrame, query_vec: list[float], k: int, name: str = "term", vec: str = "vec") -> DataFrame:
    """(name, score): dense cosine with one query vector, best first."""
    q = F.array(*map(F.lit, map(float, query_vec)))
    ok = vectors.filter(F.size(vec) == len(query_vec))
    score = exprs.cosine(F.col(vec), q)
    return ok.select(F.col(name), score.alias("score")).filter(~F.isnan("score")).orderBy(F.desc(F.round("score", 9)), name).limit(k)


def search_labels(vectors: DataFrame, query: str, limit: int = 10, name: str = "term", vec: str = "vec") -> DataFrame:
    """(label, score) above 0.01 for the vector stored under the whole lower-cased query; nothing if there is none."""
    key = query.strip().lower()
    q = vectors.filter(F.lower(name) == key).select(F.col(vec).alias("q"), F.col(name).alias("qn")).orderBy("qn").limit(1)
    scored = vectors.join(F.broadcast(q), F.size(vec) == F.size("q")).filter(F.lower(name) != key)  # one query row
    return scored.groupBy(F.lower(name).alias("label")).agg(F.max(exprs.cosine(F.col(vec), F.col("q"))).alias("score")).filter(
        "score > 0.01 AND NOT isnan(score)"
    ).orderBy(F.desc("score"), "label").limit(limit)


def modulate(vectors: DataFrame, factor: Column) -> DataFrame:
    """Vectors scaled by ``factor`` and brought back to length one."""
    scaled = vectors.withColumn("val", F.col("val") * factor)
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy("token")))
    return scaled.withColumn("val", F.col("val") / norm)


def missing(labels: DataFrame, stored: DataFrame) -> DataFrame:
    """Labels without a stored vector, for incremental embedding; both sides have ``key``."""
    return labels.join(stored.select("key").distinct(), "key", "left_anti")
