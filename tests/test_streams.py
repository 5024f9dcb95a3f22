"""Streams, recurring jobs, events, plugins and the suite runner on small input."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fadegraph.engine import Engine
from fadegraph.operators import hdc, suite
from fadegraph.sources import hadoop, shared, texts
from fadegraph.sources.plugins import Plugin, Registry
from fadegraph.streaming import jobs, stream

T0 = "2024-01-01"


def test_reinforcement_is_ordered_over_frames(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in (9, 1, 5, 7, 3, 0, 2, 8)]
        spark.createDataFrame([("k", "episodic", x, 0.5) for x in t], "key string, channel string, ts timestamp, confidence double").coalesce(1).write.parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("key string, channel string, ts timestamp, confidence double").parquet(str(tmp_path / "in"))
        rows = []
        q = stream.reinforce_stream(src).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(
            lambda b, i: rows.extend(b.collect())).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import math

    x, last = None, None
    for h in sorted((9, 1, 5, 7, 3, 0, 2, 8)):
        x, last = (0.5 if x is None else min(1.0, x * math.exp(-0.05 * (h - last)) + 0.1)), h
    assert rows[-1].intensity == pytest.approx(x) and rows[-1].uses == 8 and rows[-1].last_touch.hour == 9


def test_watched_folder_is_ingested_once(spark, tmp_path):
    (tmp_path / "a.md").write_text("ChromoQ derives from EGFP.")
    (tmp_path / "b.exe").write_text("X causes Y.")
    seen = []
    for _ in range(2):
        stream.ingest_watched(spark, str(tmp_path), str(tmp_path) + "-c", lambda n, e: seen.extend(r.src for r in e.collect())).awaitTermination(120)
    assert seen == ["ChromoQ"]


def test_jobs_and_events(spark, tmp_path):
    g = Engine.empty(spark).relate("A", "B", "episodic", T0).relate("C", "D", "derives_de", T0)
    (n, e), ran = jobs.run_due(g.nodes, g.edges, "2024-03-01 00:00:00", {"physarum": "2024-02-29 23:30:00", "consolidation": "2024-02-29 23:30:00"})
    assert set(ran) == {"physarum", "consolidation", "pruning"} and e.count() == 1 and n.count() == 2
    told = jobs.edge_events(g.edges, e, "2024-03-01")
    assert [r.kind for r in told.collect()] == ["edge_removed"]
    jobs.write_events(told, str(tmp_path / "ev"), ["edge_removed"])
    jobs.write_events(told, str(tmp_path / "ev"), ["edge_created"])
    assert spark.read.json(str(tmp_path / "ev")).count() == 1


def test_files_plugins_log_and_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.TRI").write_text("p>q")
    (tmp_path / "in/y.txt").write_text("ChromoQ derives from EGFP.")
    split = lambda df: df.select(F.split("text", ">")[0].alias("subject"), F.split("text", ">")[1].alias("object"), F.lit("trail").alias("channel"), F.lit(0.6).alias("confidence"))
    r = Registry()
    r.register(Plugin("tri", (".tri",), split))
    g = Engine.empty(spark).ingest_files(str(tmp_path / "in"), T0, r)
    assert {(x.channel, x.source) for x in g.edges.collect()} == {("trail", "tri"), ("derives_de", "files")}
    (tmp_path / "in/z.txt").write_bytes(b"x" * (texts.MOST_BYTES + 1))
    with pytest.raises(Exception, match="too large"):
        texts.files(spark, str(tmp_path / "in")).collect()
    g.export(str(tmp_path / "page"), "html")
    page = spark.read.text(str(tmp_path / "page"), wholetext=True).first().value
    assert "ChromoQ" in page and page.startswith("<!doctype html>")
    log = spark.createDataFrame([(1, "node_upsert"), (2, "node_upsert")], "seq bigint, op string")
    texts.append_log(log, str(tmp_path / "log"))
    texts.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(texts.truncate_log(spark, str(tmp_path / "log"), 1)).count() == 2


def test_suite_and_context(spark):
    g = Engine.empty(spark).relate("ChromoQ", "EGFP", "derives_de", T0).relate("EGFP", "GFP", "derives_de", T0).alarm("GFP", "bleaches", T0)
    q = spark.createDataFrame([("1", "ChromoQ", ["ChromoQ", "nothing"])], "id string, question string, gold array<string>")
    runs = suite.run(g.nodes, g.edges, q, ("fuzzy_only",), 5, T0)
    assert [(r.recall, r.path, r.rank) for r in runs.collect()] == [(0.5, 0.5, 0)]
    assert [(r.questions, r.mrr) for r in suite.ablation(runs).collect()] == [(1, 1.0)]


def test_workspaces_labels_and_errors(spark, tmp_path):
    g = Engine.create(spark, str(tmp_path), "w1")
    assert Engine.workspaces(spark, str(tmp_path)) == ["w1"] and g.labels().count() == 0
    with pytest.raises(FileExistsError):
        Engine.create(spark, str(tmp_path), "w1")
    g = g.relate("A", "B", "trail", T0)
    for f in (lambda: g.reinforce("A", "nobody", T0), lambda: g.show("nobody", T0), lambda: g.validate("nobody", "A", T0)):
        with pytest.raises(KeyError):
            f()
    assert [tuple(r) for r in g.between("A", "B").collect()] == [("trail", 0.8, 1)]
    assert [r.uses for r in g.update("MATCH (a {label: 'A'}), (b {label: 'B'}) CREATE (a)-[:trail]->(b)", T0).edges.collect()] == [2]


def test_vectors_search_and_snapshot(spark, tmp_path):
    s = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c", "d"])], "sent bigint, tokens array<string>")
    c = hdc.context_vectors(s, 5, 500, 5)
    enc = hdc.encode_sentences(s, c, hdc.document_frequency(s))
    assert [r.sent for r in hdc.search(enc, 1, 1).collect()] == [2]
    neural = spark.createDataFrame([("x", [1.0, 0.0]), ("Y", [1.0, 1.0])], "term string, vec array<float>")
    assert hdc.similarity("X", "y", neural, c).first().score == pytest.approx(0.5**0.5)
    assert hdc.similarity("a", "nope", neural, c).first().score == 0.0
    hdc.save_vectors(c, neural, hdc.document_frequency(s), str(tmp_path / "v"))
    assert hdc.load_vectors(spark, str(tmp_path / "v"))[1].count() == 2


def test_scratch_is_deleted(spark):
    t = shared.materialise(spark.range(3), "t")
    assert t.count() == 3 and hadoop.names(spark, t._scratch)
    shared.discard(t)
    assert not hadoop.names(spark, t._scratch)
