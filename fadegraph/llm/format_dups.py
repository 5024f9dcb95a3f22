"""Duplicates hidden by formatting: sort canonical records, scan adjacent runs.

Each record becomes a canonical key of its fields' letters and digits.  Records
are range-partitioned and sorted by (key, id) with Spark's external sort, and one
streaming pass over each partition compares full keys of neighbours.  Since the
id is part of the range, a key with a third of all rows is spread over several
partitions; the first and last key of each partition (two rows a partition, so
bounded by the number of partitions) then tell which runs continue across a
border and where such a run began.

Defined cases: null and empty fields are alike; records with only empty fields
equal each other; a record with null id is left out; payloads that are not
a complete JSON object equal nothing; repeated rows with the same id are one record; an
empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCANNED = "tbl string, key string, id bigint, keep bigint, n bigint, part int, edge boolean"


def letters(c: str | Column) -> Column:
    """Letters and digits of a text, in lower case; nothing for null."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[^\p{L}\p{M}\p{N}]+", ""))


def canonical(df: DataFrame, tbl: str, id_col: str, fields: list[str | Column]) -> DataFrame:
    """(tbl, key, id) of each record; fields are kept apart by a control character."""
    return df.select(
        F.lit(tbl).alias("tbl"),
        F.concat_ws("\u0001", F.lit(tbl), *(f if isinstance(f, Column) else letters(f) for f in fields)).alias("key"),
        F.col(id_col).cast("bigint").alias("id"),
    ).filter("id IS NOT NULL")


def canonical_json(df: DataFrame, tbl: str, id_col: str, payload: str) -> DataFrame:
    """The same of JSON objects with subject, relation, object and confidence, keys in any case and order."""
    fields = df.select(
        F.col(id_col), F.expr(f"try_variant_get(try_parse_json({payload}), '$', 'map<string,string>')").alias("_m")
    ).filter("_m IS NOT NULL").select(
        id_col, F.map_from_arrays(F.array_distinct(F.transform(F.map_keys("_m"), F.lower)),
                                  F.transform(F.array_distinct(F.transform(F.map_keys("_m"), F.lower)),
                                              lambda k: F.element_at(F.filter(F.map_entries("_m"), lambda e: F.lower(e["key"]) == k), 1)["value"])).alias("_m")
    )
    number = F.coalesce(F.col("_m")["confidence"].try_cast("double").cast("string"), letters(F.col("_m")["confidence"]))
    return canonical(fields, tbl, id_col, [letters(F.col("_m")[k]) for k in ("subject", "relation", "object")] + [number])


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in a sorted partition.

    Every row gets the first id of its run; the rows that open the partition's
    first run and end its last are marked as edges.
    """
    key = keep = None
    first: str | None = None
    last_id, last_row, part = None, None, 0
    for f in frames:
        if not len(f):
            continue
        part = int(f["part"].iloc[0])
        new = f["key"].ne(f["key"].shift())
        if key is not None and f["key"].iloc[0] == key:
            new.iloc[0] = False
        start = f["id"].where(new)
        if not new.iloc[0]:
            start.iloc[0] = keep
        f["keep"] = start.ffill().astype("int64")
        again = f["id"].eq(f["id"].shift()) & ~new
        if not new.iloc[0] and f["id"].iloc[0] == last_id:
            again.iloc[0] = True
        f["n"] = 1
        f["edge"] = False
        if first is None:
            first = f["key"].iloc[0]
            yield f.iloc[:1].assign(edge=True)
        key, keep, last_id = f["key"].iloc[-1], int(f["keep"].iloc[-1]), int(f["id"].iloc[-1])
        last_row = f.iloc[-1:].assign(edge=True)
        # a row that opens its run is no copy of anything in this partition, unless the run is the partition's first
        yield f[(f["keep"].ne(f["id"]) | f["key"].eq(first)) & ~again]
    if last_row is not None:
        yield last_row


def copies(records: DataFrame) -> DataFrame:
    """(tbl, keep_id, copy_id) of records with equal keys; ``records`` as from ``canonical``."""
    from fadegraph.sources import materialise

    spark = records.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = materialise(
        records.repartitionByRange(n, "key", "id")
        .sortWithinPartitions("key", "id")
        .select("tbl", "key", "id", F.lit(0).cast("bigint").alias("keep"), F.lit(1).cast("bigint").alias("n"),
                F.spark_partition_id().alias("part"), F.lit(False).alias("edge"))
        .mapInPandas(lambda it: _scan(it), SCANNED),
        "runs",
    )
    # where each key that touches a border began: two rows a partition
    began = scanned.filter("edge").groupBy("key").agg(F.min("keep").alias("began"), F.count_distinct("part").alias("parts")).filter("parts > 1").select("key", "began")
    return (
        scanned.filter("NOT edge")
        .join(F.broadcast(began), "key", "left")
        .select("tbl", F.coalesce("began", "keep").alias("keep_id"), F.col("id").alias("copy_id"))
        .filter("keep_id <> copy_id")
    )


def counted(records: DataFrame) -> DataFrame:
    """(tbl, keep_id, copies): one row per distinct record with how many records it stands for."""
    c = copies(records)
    n = c.groupBy("tbl", "keep_id").agg((F.count("*") + 1).alias("copies"))
    single = records.select("tbl", F.col("id").alias("keep_id")).distinct().join(
        c.select("tbl", F.col("copy_id").alias("keep_id")), ["tbl", "keep_id"], "left_anti"
    )
    return single.join(n, ["tbl", "keep_id"], "left").select("tbl", "keep_id", F.coalesce("copies", F.lit(1)).alias("copies"))
