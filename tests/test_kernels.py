"""Scalar kernels and the fold."""
import math
import uuid

import pytest
from pyspark.sql import functions as F

from fadegraph.functions import channels, exprs
from fadegraph.operators import fold, fusion, metrics, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def eff(spark, x, channel, hours):
    t = exprs.ts("2024-01-01")
    return one(spark, exprs.decayed(F.lit(x), F.lit(channel), t, t + F.expr(f"make_dt_interval(0, {hours})")))[0]


def test_node_id(spark):
    got = one(spark, exprs.node_id(F.lit("ws"), F.lit("Café x")))[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_OID, "ws:Café x"))


def test_decay(spark):
    assert eff(spark, 0.8, "derives_de", 24 * 365) == 0.8
    assert 0.25 < eff(spark, 1.0, "episodic", 24) < 0.35
    assert eff(spark, 1.0, "trail", 24) > 0.95
    assert eff(spark, 0.5, "trail", -24) == 0.5


def test_dead_and_reinforced(spark):
    t, later = exprs.ts("2024-01-01"), exprs.ts("2024-01-06")
    assert one(spark, exprs.dead(F.lit(0.01), F.lit("episodic"), t, later))[0]
    assert not one(spark, exprs.dead(F.lit(0.01), F.lit("derives_de"), t, later))[0]
    assert one(spark, exprs.reinforced(F.lit(0.9), F.lit("causal"), t, t))[0] == 1.0


def test_channel_names(spark):
    for written in ("DerivesDe", "derives_de ", "DERIVES_DE", "derivesde"):
        assert one(spark, channels.canonical(F.lit(written)))[0] == "derives_de"
    assert one(spark, channels.canonical(F.lit("custom:7")))[0] == "custom:7"
    assert channels.is_known("custom:7") and not channels.is_known("custom:x") and not channels.is_known("likes")


def test_fuzzy(spark):
    score = lambda label, q: one(spark, exprs.fuzzy_score(F.lit(label), q))[0]
    assert score("ChromoQ", "chromoq") == 1.0
    assert score("ChromoQ-variant", "chromoq") == 0.9
    assert score("something ChromoQ", "chromoq") == 0.7
    assert score("Spéléologie", "speleo") == 0.85
    assert score("créé", "cree") == 0.95
    assert score("x", " ") == 0.0


def test_sentences_and_chunks(spark):
    s = one(spark, exprs.sentences(F.lit("First one. Second one! No\nA longer line here\nend")))[0]
    assert s == ["First one.", "Second one!", "A longer line here"]
    c = one(spark, exprs.chunk_windows(F.array(*map(F.lit, "abcd")), 2, 1))[0]
    assert c == ["a b", "b c", "c d"]
    assert one(spark, exprs.chunk_windows(F.array().cast("array<string>")))[0] == []


def test_fold_equals_sequence(spark):
    """Slices composed give what observation after observation gives, for every slice width."""
    rows = [("k", "episodic", f"2024-01-{1 + i // 3:02d} {(i * 7) % 24:02d}:00:00", i, 0.3 + 0.01 * i) for i in range(40)] + [("n", "trail", None, 1, 0.5)]
    df = spark.createDataFrame(rows, "key string, channel string, t string, seq bigint, confidence double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    import datetime

    x = None
    for _, _, t, _, c in sorted(rows[:-1], key=lambda r: (r[2], r[3])):
        t = datetime.datetime.fromisoformat(t)
        x = c if x is None else min(1.0, x * math.exp(-0.05 * (t - last).total_seconds() / 3600) + 0.1)
        last = t
    for days in (1, 4, 400):
        r = fold.fold_edges(df, ["key", "channel"], days).collect()
        assert len(r) == 1 and r[0].uses == 40 and r[0].intensity == pytest.approx(x, abs=1e-12)


def test_patterns(spark):
    def found(t):
        df = spark.createDataFrame([(1, t)], "id int, text string")
        return {(r.subject, r.object, r.channel) for r in text.extract_triplets(df, ["id"]).collect()}

    assert ("EGFP", "a fluorescent protein"[2:], "trail") in found("EGFP is a fluorescent protein.")
    assert ("ChromoQ", "EGFP", "derives_de") in found("ChromoQ derives from EGFP")
    assert ("Heat", "denaturation", "causal") in found("Heat causes denaturation")
    assert ("mixture A", "strong acid", "alarm") in found("AVOID combining mixture A with strong acid")
    assert ("X1", "WARNING", "alarm") in found("ÉVITER X1")
    assert ("A", "B", "derives_de") in found("A replaces B")
    assert ("Foo", "Bar", "trail") in found("Foo uses Bar")
    assert ("EGFP", "509nm", "causal") in found("EGFP emission=509nm")
    assert ("ZGFP", "510 nm", "causal") in found("ZGFP engineered to emit at exactly 510 nm")
    assert ("Model", "94.2", "trail") in found("Model pLDDT=94.2")
    assert ("Foo", "tail", "trail") in found("Foo has a tail.")
    assert ("Foo", "Bar", "trail") in found("Foo depends on Bar")
    assert ("Foo", "light", "causal") in found("Foo produces light")
    assert ("Foo", "90% recall", "trail") in found("Foo achieves 90% recall.")
    assert ("Foo", "wasm", "trail") in found("Foo compiles to wasm")
    assert ("Box", "red lid", "trail") in found("Box with a red lid.")
    assert found("Hello world, this is just random text.") == set()


def test_named_entities(spark):
    texts = ["we met Marie Curie at the University of Cambridge. Then nothing", "The cat", None, "", "so Ludwig Van der Berg and The Hague met. Relay ran; then Relay, RELAY and Anna-Lena stayed", "a " * 3000]
    got = [r.e for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", text.ner("t").alias("e")).orderBy("i").collect()]
    assert got == [["Marie Curie", "University of Cambridge"], [], None, [], ["Ludwig Van", "Berg and The Hague", "Relay RELAY and Anna-Lena"], []]


def test_repair():
    t = [{"subject": "a", "relation": "r", "object": "b", "confidence": 0.5}]
    import json

    j = json.dumps(t)
    for answer in (j, f'{{"triplets": {j}}}', f'{{"x": {j}}}', f"```json\n{j}\n```", f"<think>hm</think>Sure: {j} done"):
        assert text.repaired(answer) == t
    assert text.repaired("no json") == [] and text.repaired(None) == []


def test_query_entities():
    assert fusion.query_entities('who wrote "Foo Bar"')[0] == "Foo Bar"
    assert "Marie Curie" in fusion.query_entities("where did Marie Curie work")
    assert "acme corp" in fusion.query_entities("who founded acme corp?")


def test_rrf_and_mmr(spark):
    df = spark.createDataFrame([(0, "x", "A", 2.0), (0, "x", "B", 1.0), (1, "y", "B", 2.0), (1, "y", "C", 1.0)], "list_no int, source string, label string, score double")
    r = fusion.rrf(df).orderBy(F.desc("score")).first()
    assert r.label == "B" and r.sources == ["x", "y"] and r.score == pytest.approx(1 / 62 + 1 / 61)
    rows = spark.createDataFrame([("q", "red fox", 1.0), ("q", "red fox den", 0.9), ("q", "blue sea", 0.8)], "query string, label string, score double")
    assert [x.label for x in fusion.mmr(rows, 2, 0.5).orderBy("place").collect()] == ["red fox", "blue sea"]


def test_metrics(spark):
    assert one(spark, metrics.token_f1(F.lit("The cat."), F.lit("the dog")))[0] == 0.5
    assert one(spark, metrics.exact_match(F.lit("A, b"), F.lit("a b")))[0]
    a = F.array(F.lit("Marie Curie"), F.lit("x"))
    assert one(spark, metrics.entity_recall(a, F.array(F.lit("curie"), F.lit("zzz")), 2))[0].recall == 0.5
    assert spark.createDataFrame([(0,), (None,), (1,)], "rank int").transform(metrics.mean_reciprocal_rank).first().mrr == pytest.approx(0.5)
    t = spark.createDataFrame([(1, 2), (3, None), (2, 1), (None, None)], "recent int, stale int")
    assert metrics.temporal_accuracy(t).first().accuracy == pytest.approx(2 / 3)


def test_code_symbols(spark):
    src = "pub struct Foo {}\nimpl Bar for Foo {}\ntrait Bar {}\nfn a() { b(); if x {} }\nfn b() -> Foo {}\n"
    df = spark.createDataFrame([("x.rs", src)], "path string, text string")
    symbols, edges = text.code_symbols(df)
    assert {(r.kind, r.name) for r in symbols.collect()} == {("struct", "Foo"), ("trait", "Bar"), ("fn", "a"), ("fn", "b")}
    e = {(r.src, r.dst, r.label) for r in edges.collect()}
    assert {("a", "b", "calls"), ("Foo", "Bar", "implements"), ("b", "Foo", "uses_type"), ("x.rs", "a", "contains")} <= e


def test_sql_functions(spark):
    from fadegraph.functions.sql import register

    register(spark)
    r = spark.sql("""SELECT kg_node_id('ws', 'Café x') AS i, kg_eff(1D, 'episodic', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-02') AS e,
      kg_fuzzy('Spéléologie', 'speleo') AS f, kg_cosine(array(1D, 0D), array(1D, 1D)) AS c""").first()
    assert r.i == str(uuid.uuid5(uuid.NAMESPACE_OID, "ws:Café x")) and r.e == pytest.approx(math.exp(-1.2)) and r.f == 0.85 and r.c == pytest.approx(0.5**0.5)


def test_gold_and_links(spark):
    rows = spark.createDataFrame([("Title", "x", "we met Marie Curie there"), ("T", "y" * 200, None), (None, None, "saw title Title")], "t string, a string, b string")
    assert [r.g for r in rows.select(text.gold_entities(F.col("t"), F.col("a"), F.col("b")).alias("g")).collect()] == [["Title", "x", "Marie Curie"], ["T"], ["Title"]]
    df = spark.createDataFrame([("A", "we met Marie Curie"), ("B", "saw Marie Curie"), ("C", "no one")], "title string, text string")
    assert [(r.a, r.b) for r in text.link_titles(df).collect()] == [("A", "B")]


def test_recall_takes_all_gold(spark, monkeypatch):
    from fadegraph.plans import search_queries

    nodes = spark.createDataFrame([("w", i, f"label{i:02}") for i in range(50)], "workspace string, ord bigint, label string")
    subjects = ["label03", "LABEL19", "label20", "absent", None, "label03", "label05", "label45", "zzz"]  # ids 1 to 9; 7 is one of them
    triplets = spark.createDataFrame([(i, "w", x) for i, x in enumerate(subjects, 1)], "triplet_id bigint, workspace string, subject string")
    monkeypatch.setattr(search_queries, "kg_nodes", lambda *_: nodes)
    monkeypatch.setattr(search_queries, "table", lambda *_: triplets)
    assert [tuple(r) for r in search_queries.recall_at_k(spark, "").collect()] == [("w", round(3 / 7, 6), 3, 7)]


def test_context_vectors_of_full_size(spark, monkeypatch):
    import hashlib
    from fadegraph.plans import search_queries

    sents = [["membrane", "ion", "pump"], ["ion", "channel", "gate", "membrane"], ["lonely"], ["gate", "pump", "ion"]]
    monkeypatch.setattr(search_queries, "_records", lambda *_: spark.createDataFrame(list(enumerate(sents)), "sent bigint, tokens array<string>"))
    words = {w for s in sents for w in s}
    idf = {w: math.log(len(sents) / (sum(w in s for s in sents) + 1)) + 1 for w in words}
    base = {}
    for w in words:
        for i in range(100):
            h = hashlib.md5(f"{w}:{i}".encode()).hexdigest()
            base.setdefault(w, {})[int(h[:8], 16) % 10_000] = 1.0 if int(h[8:10], 16) % 2 == 0 else -1.0
    want = {}
    for w in words:
        v = {}
        for s in sents:
            for i, j in ((i, j) for i in range(len(s)) for j in range(len(s)) if i != j and s[i] == w and abs(i - j) <= 5):
                for dim, x in base[s[j]].items():
                    v[dim] = v.get(dim, 0.0) + idf[s[j]] * x
        v = v or base[w]
        norm = math.sqrt(sum(x * x for x in v.values()))
        want[w] = {dim: x / norm for dim, x in v.items() if abs(x) > 1e-9}
    got = {}
    for r in search_queries.hdc_context_sparse(spark, "").collect():
        got.setdefault(r.token, {})[r.dim] = r.val
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w], abs=2e-6) for w in want)
    score = {w: sum(x * want["membrane"].get(dim, 0.0) for dim, x in want[w].items()) for w in words}
    near = {r.token: r.score for r in search_queries.hdc_most_similar(spark, "").collect()}
    assert near == {w: pytest.approx(score[w], abs=2e-6) for w in near} and near.keys() >= {w for w in words - {"membrane"} if abs(score[w]) > 1e-6}


def _written(spark, sentences, path):
    """A written table of records, whose size the optimiser can only guess."""
    from datetime import datetime

    rows = [(i, datetime(2025, 1, 1), s) for i, s in enumerate(sentences)]
    spark.createDataFrame(rows, "rec_id bigint, trained_at timestamp, tokens array<string>").coalesce(1).write.parquet(f"{path}/hdc_records.parquet")


SENTENCES = [["membrane", "ion", "pump", None, "membrane"], ["ion", "channel", "gate", "membrane"], ["lonely"], ["gate", "pump", "ion"], ["caf\u00e9", "\u6f22\u5b57", "gate"], ["far", "away"], []]


def test_context_vectors_broadcast_no_draws(spark, tmp_path, monkeypatch):
    from fadegraph.operators import hdc
    from fadegraph.plans import search_queries

    _written(spark, SENTENCES, tmp_path)
    assert "Broadcast" not in search_queries.hdc_context_sparse(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    got = []
    for most in (1, 2048):  # draws sent, draws made anew
        monkeypatch.setattr(hdc, "HOT", most)
        got.append(sorted(map(tuple, search_queries.hdc_context_sparse(spark, str(tmp_path)).collect())))
    assert got[0] == got[1] and {r[0] for r in got[0]} == {w for s in SENTENCES for w in s if w}
    s = search_queries._records(spark, str(tmp_path))
    base = {(r.token, r.dim): r.val for r in hdc.base_vectors(hdc.document_frequency(s).select("token")).collect()}
    assert {(t, d): v for t, d, v in got[0] if t == "lonely"} == {k: pytest.approx(v / math.sqrt(sum(k[0] == "lonely" for k in base)), abs=1e-6) for k, v in base.items() if k[0] == "lonely"}
    whole = {tuple(r) for r in hdc.context_vectors(s, 5).filter("token = 'membrane'").collect()}
    assert whole == {tuple(r) for r in hdc.context_vectors(s, 5, only="membrane").collect()} and whole
    assert hdc.context_vectors(s.limit(0), 5).collect() == []
    long = spark.createDataFrame([(1, ["y" * 200_000, "ion"])], "sent bigint, tokens array<string>")  # many batches of one token
    assert hdc.context_vectors(long, 5).groupBy(F.length("token")).count().orderBy("count").count() == 2


@pytest.mark.parametrize("dims, n", [(10_000, 100), (50, 40), (40_000, 3)])
def test_draws_and_sums_cut_anywhere(spark, monkeypatch, dims, n):
    import numpy as np
    import pyarrow as pa
    from fadegraph.operators import hdc

    words = ["ab", "caf\u00e9", "\u6f22\u5b57", "x" * 300]
    want = {(r.token, r.dim): r.val for r in hdc.base_vectors(spark.createDataFrame([(w,) for w in words], "token string"), dims, n).collect()}
    codes = dict(zip(words, hdc._drawn([w.encode() for w in words], dims, n)))
    assert {(w, abs(int(c)) - 1): float(np.sign(c)) for w in words for c in codes[w] if c} == want and sum(int((c != 0).sum()) for c in codes.values()) == len(want)
    rows = [("ab", None, None, "ab"), ("ab", 2.0, "x" * 300, None), ("ab", 0.5, None, "caf\u00e9"), ("ab", 3.0, None, "ab"), ("caf\u00e9", None, "caf\u00e9", None), ("zz", 1.5, "ab", None), ("zz", None, None, "ab")]
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string()), pa.array([codes[r[3]].tobytes() if r[3] else None for r in rows], pa.binary())], ["token", "w", "word", "draws"])
    parts = {"ab": [(2.0, "x" * 300), (0.5, "caf\u00e9"), (3.0, "ab")], "caf\u00e9": [(1.0, "caf\u00e9")], "zz": [(1.5, "ab")]}
    for block, cuts in ((1_000_000, [0, 7]), (n, [0, 7]), (1_000_000, [0, 0, 1, 3, 6, 7])):
        monkeypatch.setattr(hdc, "BLOCK", block)
        got = {t.decode(): dict(zip(p.tolist(), v.tolist())) for t, p, v in hdc._summed((b.slice(i, j - i) for i, j in zip(cuts, cuts[1:])), dims, n)}
        assert list(got) == list(parts)
        for t, of in parts.items():
            v = {}
            for w, x in of:
                for (y, d), sign in want.items():
                    if x == y:
                        v[d] = v.get(d, 0.0) + w * sign
            norm = math.sqrt(sum(x * x for x in v.values()))
            assert got[t] == {d: pytest.approx(x / norm, abs=1e-12) for d, x in v.items()}


def test_most_similar_makes_no_rows_of_places(spark, tmp_path):
    from fadegraph.operators import hdc
    from fadegraph.plans import search_queries

    _written(spark, SENTENCES, tmp_path)
    df = search_queries.hdc_most_similar(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "dim#" not in plan
    s = search_queries._records(spark, str(tmp_path))
    for token in ("membrane", "lonely", "absent"):
        want = hdc.most_similar(hdc.context_vectors(s, 5), token, 4).collect()
        got = hdc.most_similar_contexts(s, token, 4).collect()
        assert [r.token for r in got] == [r.token for r in want] and [r.score for r in got] == pytest.approx([r.score for r in want], abs=1e-12)
        assert (not got) == (token == "absent") or token == "lonely"
    assert len(df.collect()) > 4
