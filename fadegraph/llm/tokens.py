"""Encoding a corpus with a public tokenizer by a global distinct-word shuffle.

Texts are cut into pre-tokens with Spark's regular expressions, each distinct
pre-token is encoded once, ids are joined back and put together by position.

The dictionary of distinct pre-tokens is written to the shared folder.  Its
``HOT`` most frequent entries of at most ``HOT_BYTES`` bytes are joined on the
map side: that table is bounded by ``HOT`` rows of under 1 KB whatever the
corpus.  Only the rest is shuffled, and no word of the rest is more frequent
than the last hot one, so the shuffle has no hot key.

``tokenizer_path`` is the rank file (one base64 piece and its rank a line); it
is read by the Python workers and never copied.

Defined cases: null and empty texts give an empty list; blank texts are encoded
as they are; rows alike in doc_id and text are one document; different texts
under one doc_id give one row each; a null doc_id is kept; further columns are
ignored.
"""
from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.sources import materialise

TOKENIZERS = os.environ.get("FADEGRAPH_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
HOT, HOT_BYTES = 16_384, 64

# White space of Unicode, and the tokenizer's pattern with it spelt out
# (the JVM's \s knows ASCII only).
_S = r"\u0009-\u000D \u0085   -     　"
PRE_TOKEN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


def ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str):
    import tiktoken

    # the pattern never cuts: words arrive as single pieces
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def pre_tokens(text: Column) -> Column:
    """The pre-tokens of a text in order."""
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def _encode(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        encode, known = encoding._encode_single_piece, encoding._mergeable_ranks
        for f in frames:
            out = []
            for w in f["word"]:
                b = w.encode()
                one = known.get(b)
                out.append(encode(b) if one is None else [one])
            yield pd.DataFrame({"word": f["word"], "n": f["n"], "ids": out})

    return run


def dictionary(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """(word, n, ids) of the distinct pre-tokens of ``pieces.word``, written to the shared folder."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    counts = pieces.filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    return materialise(counts.mapInPandas(_encode(path), "word string, n bigint, ids array<int>"), "words")


def _pieces(docs: DataFrame, text: str) -> DataFrame:
    """One row per pre-token, and one without word for texts that have none; _key tells documents apart.

    Texts are cut once: their words are written to the shared folder, a row a document, and read from there.
    """
    cut = docs.select("*", F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("_key"), pre_tokens(F.col(text)).alias("_words")).drop(text)
    return materialise(cut, "pieces").select("*", F.posexplode_outer("_words").alias("pos", "word")).drop("_words")


def _resolved(docs: DataFrame, text: str, path: str | None, value: Column) -> DataFrame:
    """The pieces with ``value`` of their dictionary entry."""
    pieces = _pieces(docs, text)
    words = dictionary(pieces, path)
    entry = words.select("word", "n", value.alias("v"))
    hot = F.broadcast(
        entry.filter(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(HOT).select("word", "v")
    )
    near = pieces.join(hot, "word", "left")
    far = pieces.join(hot, "word", "left_anti").filter("word IS NOT NULL").join(entry.drop("n"), "word")
    return near.filter("v IS NOT NULL OR word IS NULL").unionByName(far)


def _once(a: str) -> Column:
    """Sorted (pos, ...) entries with each position once: repeated rows bring every position again."""
    return F.filter(a, lambda x, i: (i == 0) | (x["pos"] != F.get(a, i - 1)["pos"]))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every document."""
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = _resolved(slim, "_text", path, F.col("ids"))
    parts = rows.groupBy("_id", "_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "v")))).alias("a")
    )
    return parts.select(F.col("_id").alias(doc_id), F.flatten(F.transform(_once("a"), lambda x: x["v"])).alias("ids"))


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """Columns ``keep`` (which tell documents apart) and n_tokens; sums are combined on the map side."""
    rows = _resolved(docs.select(*keep, F.col(text).alias("_text")), "_text", path, F.size("ids").alias("v"))
    return rows.groupBy(*keep).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n_tokens"))


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """(id, piece): the token-byte table, as many rows as the vocabulary has pieces."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    r = ranks(path)
    return spark.createDataFrame(pd.DataFrame({"id": list(r.values()), "piece": list(r)}), "id int, piece binary")


def decode(encoded: DataFrame, doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, text) from ids; the byte table is broadcast, it is bounded by the vocabulary."""
    pieces = F.broadcast(token_bytes(encoded.sparkSession, path))
    long = encoded.select(doc_id, F.xxhash64("ids").alias("_row"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = long.join(pieces, "id", "left").groupBy(doc_id, "_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("a")
    )
    whole = F.array_join(F.transform(_once("a"), lambda x: x["h"]), "")
    return joined.select(doc_id, F.decode(F.unhex(whole), "UTF-8").alias("text"))
