"""The folder all executors share, for tables that cut lineage.

The cluster names it in ``spark.checkpoint.dir``.  Only on a single machine (master
``local``) a temporary folder is made where that setting is absent, and removed at
exit; anywhere else its absence is an error, as executors would lose data silently.

Tables written here are deleted by ``discard`` as soon as an operator needs them no
more, the rest by ``release`` or at exit, while the session lives.
"""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_written: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder in a local session without it."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="fadegraph-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A path of the shared folder nobody else uses; deleted at exit."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Later reads neither recompute it nor depend on an executor that computed it.
    The schema is handed over, so no file is opened to infer it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``materialise`` wrote for this very table; nothing may read it any more."""
    from fadegraph.sources import hadoop

    path = getattr(table, "_scratch", None)
    if path in _written:
        hadoop.delete(table.sparkSession, path)
        _written.discard(path)


def release(spark: SparkSession) -> int:
    """Delete all tables this process wrote to the shared folder; results that read them must have been used."""
    from fadegraph.sources import hadoop

    n = len(_written)
    while _written:
        hadoop.delete(spark, _written.pop())
    return n


@atexit.register
def _at_exit() -> None:
    if _written and SparkContext._active_spark_context is not None:
        try:
            release(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
        except Exception:  # the session may be half gone
            pass
