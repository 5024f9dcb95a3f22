"""Queries of every kind against their SQL in DuckDB, over the whole tables of the smallest size."""
import glob
import importlib
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
NAMES = ["p2_state", "top_live_edges", "edge_upsert_fold", "traverse_2hop", "khop_undirected", "explain_paths", "connected_components", "cypher_create", "cypher_delete",
         "cypher_set", "engine_relate", "pattern_counts", "ner_entities", "rrf_sources", "recall_at_k", "tumbling_events"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    entry = importlib.import_module("__spark_entry__")
    df = entry.queries()[name](spark, FOLDER)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    r = con.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(repr([plain(row[cols.index(c)]) for c in sorted(cols)]) for row in r.fetchall())


def test_every_query_is_listed():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 80
