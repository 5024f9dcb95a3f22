"""The change feed, the graph operators, Cypher, streams and the engine on small graphs."""
import pytest
from pyspark.sql import functions as F

from fadegraph.engine import Engine
from fadegraph.operators import changefeed, community, rank, traverse
from fadegraph.operators.graph import AS_OF
from fadegraph.plans.cypher import CypherError, parse, run

T0 = "2024-01-01"
FEED = "ts timestamp_ntz, seq bigint, op string, workspace string, edge_id string, src string, dst string, channel string, kind string, tags array<string>, confidence double, delta double, source string, label string, arrived_at timestamp_ntz, item string, bucket int"


def feed(spark, rows):
    full = [(None, s, op, "w", e, n, None, None, None, None, None, None, None, None, None, "clash", 9) for s, op, e, n in rows]
    return spark.createDataFrame(full, FEED)


def items(df):
    return {(r.item, r.seq) for r in df.collect()}


ROWS = [
    (1, "node_upsert", None, "n1"), (2, "EdgeUpsert", "e1", "n1"), (3, "EDGE_REINFORCE", "e1", None), (4, "edge_prune", "e1", None), (5, "edge_upsert", "e1", "n1"),
    (6, "node_archive", None, "n1"), (7, "edge_reinforce", "e2", None), (8, "node_upsert", None, "n2"), (8, "node_upsert", None, "n2"),
    (None, "node_upsert", None, "n3"), (9, "bogus", None, "n4"), (10, "node_upsert", None, " "), (11, "node_upsert", None, None), (12, None, "e1", None),
]
WANT = {("e1", 5), ("n2", 8)}


def test_changefeed_whole(spark):
    assert items(changefeed.replay(feed(spark, ROWS), n_buckets=3)) == WANT


def test_changefeed_any_order_and_batches(spark):
    import random

    for seed in range(2):
        rows = ROWS * 2
        random.Random(seed).shuffle(rows)
        t = changefeed.BucketedTable.create(spark, n_buckets=3)
        for i in range(0, len(rows), 10):
            t.apply(feed(spark, rows[i : i + 10]))
        assert items(t.snapshot()) == WANT


def test_changefeed_query_merges_batches(spark, monkeypatch):
    from fadegraph.plans import core_queries

    log = feed(spark, ROWS * 2).withColumn("arrived_at", F.timestamp_seconds(F.pmod(F.xxhash64("seq", "op"), F.lit(7))).cast("timestamp_ntz"))
    monkeypatch.setattr(core_queries, "table", lambda *_: log.withColumn("arrived_at", F.when(F.col("op") != "edge_prune", F.col("arrived_at"))))
    merged = []
    monkeypatch.setattr(changefeed.BucketedTable, "_read", lambda t, folders, f=changefeed.BucketedTable._read: merged.append(len(folders)) or f(t, folders))
    assert {(r.item, r.seq) for r in core_queries.p2_found(spark, "").collect()} == WANT
    assert len(merged) == 3 and merged[1] > 0  # old buckets to weigh and to merge, then the snapshot


def test_changefeed_touches_only_its_buckets(spark):
    t = changefeed.BucketedTable.create(spark, n_buckets=8)
    first = t.apply(feed(spark, [(i, "node_upsert", None, f"n{i}") for i in range(40)]))
    second = t.apply(feed(spark, [(99, "node_archive", None, "n7")]))
    moved = [b for b in first["buckets"] if first["buckets"][b] != second["buckets"][b]]
    assert len(moved) == 1 and len(items(t.snapshot())) == 39 and len(items(t.snapshot(1))) == 40


def test_changefeed_empty_and_lost_race(spark):
    t = changefeed.BucketedTable.create(spark, n_buckets=2)
    assert t.apply(feed(spark, []))["version"] == 0 and items(t.snapshot()) == set()
    with pytest.raises(FileExistsError):
        t._commit({"version": 0, "n_buckets": 2, "buckets": {}})


def test_changefeed_reinforcements(spark, monkeypatch):
    """Once a seq, whatever the order, batches, repeats and slices; only those after the last upsert."""
    import random

    monkeypatch.setattr(changefeed, "SLICE", 3)
    up = lambda s, c: (None, s, "edge_upsert", "w", "e1", "a", "b", "trail", None, None, c, None, None, None, None, "clash", 9)
    on = lambda s, d, e="e1": (None, s, "EdgeReinforce", "w", e, None, None, None, None, None, None, d, None, None, None, "clash", 9)
    rows = [up(2, 0.2), up(5, 0.1), on(3, 0.5), on(1, 0.5), on(6, 0.1), on(7, 0.05), on(7, 0.02), on(9, None), on(10, float("nan")), on(11, -1.0), on(12, 0.3, "never"), on(20, 0.2)]
    for seed in range(2):
        every = rows * 3
        random.Random(seed).shuffle(every)
        t = changefeed.build([spark.createDataFrame(every[i : i + 18], FEED) for i in range(0, len(every), 18)], n_buckets=4)
        got = [tuple(r) for r in t.strengths().collect()]
        assert [(g[0], g[1], g[2], round(g[3], 9), g[4]) for g in got] == [("e1", 20, 0.1, 0.45, 3)]
        assert t.states().filter("size(steps) > 3").count() == 0


def test_changefeed_of_two_writers_one_commits(spark):
    from concurrent.futures import ThreadPoolExecutor

    t = changefeed.BucketedTable.create(spark, n_buckets=2)

    def write(i):
        try:
            changefeed.hadoop.write_text_once(spark, f"{t.path}/manifest/v00000001.json", '{"version": 1, "n_buckets": 2, "buckets": {}, "by": %d}' % i)
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(write, range(8)) if i is not None]
    assert len(won) == 1 and t.manifest()["by"] == won[0]


def test_changefeed_grown_table_is_split_and_vacuumed(spark, monkeypatch):
    rows = [(i, "node_upsert", None, f"n{i}") for i in range(200)]
    t = changefeed.build([feed(spark, rows[:100])], n_buckets=1)
    monkeypatch.setattr(changefeed, "BUCKET_BYTES", 1_000)
    m = t.apply(feed(spark, rows[100:101]))
    assert m["n_buckets"] > 1 and len(m["buckets"]) > 1 and len(items(t.snapshot())) == 101
    assert t.vacuum() == 1 and len(items(t.snapshot())) == 101


def test_changefeed_bears_an_unfinished_manifest(spark):
    t = changefeed.build([feed(spark, [(1, "node_upsert", None, "n1")])], n_buckets=1)
    changefeed.hadoop.write_text_once(spark, f"{t.path}/manifest/v00000002.json", '{"vers')
    assert items(t.snapshot()) == {("n1", 1)}
    t.apply(feed(spark, [(2, "node_upsert", None, "n2")]))
    assert items(t.snapshot()) == {("n1", 1), ("n2", 2)}


def graph(spark, edges):
    rows = [("w", s, d, c, w, w, 1, "t", None, "automated", i) for i, (s, d, c, w) in enumerate(edges)]
    e = spark.createDataFrame(rows, "workspace string, src string, dst string, channel string, intensity double, confidence double, uses bigint, source string, label string, provenance string, ord bigint")
    return e.withColumn("last_touch", F.lit(T0).cast("timestamp_ntz"))


def nodes(spark, spec):
    rows = [("w", i, i, k, t, None, n) for n, (i, k, t) in enumerate(spec)]
    df = spark.createDataFrame(rows, "workspace string, node_id string, label string, kind string, tags array<string>, meta string, ord bigint")
    return df.withColumns({"created_at": F.lit(T0).cast("timestamp_ntz"), "last_seen": F.lit(T0).cast("timestamp_ntz")})


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_traverse_chain_and_filter(spark):
    e = graph(spark, [("ChromoQ", "EGFP", "derives_de", 0.95), ("EGFP", "GFP", "derives_de", 0.90)])
    r = {x.node: (round(x.score, 4), x.hops) for x in traverse.traverse(e, start(spark, "ChromoQ"), 3, as_of=T0).collect()}
    assert r == {"ChromoQ": (1.0, 0), "EGFP": (0.95, 1), "GFP": (0.855, 2)}
    e = graph(spark, [("A", "B", "trail", 0.8), ("A", "C", "alarm", 0.9)])
    assert {x.node for x in traverse.traverse(e, start(spark, "A"), as_of=T0).collect()} == {"A", "B"}


def test_traverse_keeps_shorter_weaker_path(spark):
    e = graph(spark, [("A", "B", "trail", 0.3), ("A", "C", "trail", 0.9), ("C", "B", "trail", 0.9), ("B", "D", "trail", 0.9)])
    r = {x.node: round(x.score, 4) for x in traverse.traverse(e, start(spark, "A"), 2, 0.0, as_of=T0).collect()}
    assert r == {"A": 1.0, "C": 0.9, "B": 0.81, "D": 0.27}


def test_explain_and_khop(spark):
    e = graph(spark, [("A", "B", "trail", 0.9), ("B", "D", "trail", 0.9), ("A", "D", "trail", 0.5), ("D", "A", "trail", 0.9)])
    assert [(x.path, x.hops) for x in traverse.explain_paths(e, "A", "D", as_of=T0).collect()] == [("A>B>D", 2), ("A>D", 1)]
    assert {(x.node, x.hops) for x in traverse.khop(e, start(spark, "B"), 1).collect()} == {("B", 0), ("A", 1), ("D", 1)}


def test_pagerank_and_specificity(spark):
    e = graph(spark, [("Alice", "Company", "trail", 0.9), ("Company", "Industry", "trail", 0.9)])
    r = [x.node for x in rank.pagerank(e, start(spark, "Alice"), as_of=T0).orderBy(F.desc("rank")).collect()]
    assert r == ["Alice", "Company", "Industry"]
    assert rank.pagerank(e, start(spark), as_of=T0).count() == 0
    e = graph(spark, [("hub", x, "trail", 0.9) for x in "abc"])
    s = {x.label: x.specificity for x in rank.specificity(nodes(spark, [(x, "entity", []) for x in ("hub", "a", "b", "c", "alone")]), e, as_of=T0).collect()}
    assert s["alone"] > s["a"] > s["hub"] and s["alone"] == 1.0


def test_communities(spark):
    tri = lambda *n: [(n[i], n[j], "trail", 0.9) for i in range(3) for j in range(i + 1, 3)]
    e = graph(spark, tri("A", "B", "C") + tri("D", "E", "F") + [("C", "D", "trail", 0.1)])
    c = {x.node: x.community for x in community.local_moving(e, gamma=1.0, as_of=T0).collect()}
    assert len({c[x] for x in "ABC"}) == 1 and len({c[x] for x in "DEF"}) == 1 and c["A"] != c["F"]
    parts = spark.createDataFrame(list(c.items()), "node string, community string")
    assert community.modularity(e, parts, T0).first().q > 0 and 0 < community.modularity(e, parts, T0, True).first().q < 1
    assert {x.component for x in community.components(e).collect()} == {"A"}


CYPHER_E = [("ChromoQ", "fluorescence", "trail", 0.9), ("ChromoQ", "Rust", "causal", 0.7), ("Rust", "Base", "trail", 0.8)]
CYPHER_N = [("ChromoQ", "entity", []), ("fluorescence", "concept", []), ("Rust", "entity", ["language"]), ("Base", "entity", [])]


def test_cypher(spark):
    n, e = nodes(spark, CYPHER_N), graph(spark, CYPHER_E)
    q = lambda text, **k: [tuple(r) for r in run(text, n, e, T0, **k).collect()]
    assert q("MATCH (n:Concept) RETURN n.label") == [("fluorescence",)]
    assert q("MATCH (n:language) RETURN n.label") == [("Rust",)]
    assert set(q("MATCH (a {label: 'ChromoQ'})-[:trail]->(b) RETURN b.label")) == {("fluorescence",)}
    assert set(q("MATCH (a {label: 'ChromoQ'})-[*1..2]->(b) RETURN b.label")) == {("fluorescence",), ("Rust",), ("Base",)}
    assert q("MATCH (b {label: 'Base'})<-[r:trail]-(a) RETURN a.label, r") == [("Rust", "trail")]
    assert q("MATCH (n) WHERE n.label CONTAINS 'chrom' OR n.kind = 'concept' RETURN n.label ORDER BY n.label DESC LIMIT 1") == [("fluorescence",)]
    assert q("MATCH (a)-[:trail]->(b) RETURN COUNT(a)") == [(2,)]
    assert set(q("MATCH (a)-[:causal]->(b), (b)-[:trail]->(c) RETURN a.label, c.label")) == {("ChromoQ", "Base")}
    assert q("MATCH (a {label: 'Base'}), (b {label: 'Rust'}) CREATE (a)-[:causal {confidence: 0.4}]->(b)") == [("Base", "Rust", "causal", 0.4, "cypher", None)]
    assert q("MATCH (n {label: 'Rust'}) DELETE n") == [("Rust",)]
    assert q("MATCH (n {label: 'Rust'}) SET n.rev = 3") == [("Rust", "rev", "3")]
    assert len(q("MATCH (a)-[:likes]->(b) RETURN a.label")) == 3
    with pytest.raises(CypherError):
        q("MATCH (a)-[:likes]->(b) RETURN a.label", strict=True)
    for bad in ("MATCH (n", "RETURN 1", "MATCH (n) RETURN n.label LIMIT 0", "MATCH (n) WHERE n.x ~ 1 RETURN n", "MATCH (a)-[]->(b) WHERE a.x = 1 CREATE (a)-[:trail]->(b)"):
        with pytest.raises(CypherError):
            parse(bad)


def test_engine(spark):
    g = Engine.empty(spark).relate("A", "B", "trail", T0, 0.6).relate("A", "B", "Trail", T0, 0.9).alarm("A", "hot", T0)
    e = {(r.channel, round(r.intensity, 6), r.confidence, r.uses) for r in g.edges.collect()}
    assert e == {("trail", 0.9, 0.6, 2), ("alarm", 0.9, 0.9, 1)}
    with pytest.raises(ValueError):
        g.relate("A", "B", "likes", T0)
    assert g.stats(T0).first().nodes == 3
    g2 = g.correct("A", "B", 0.2, "wrong", T0)
    assert {r.intensity for r in g2.edges.filter("channel = 'trail'").collect()} == {0.2}
    assert g.forget("B").edges.count() == 1
    assert {r.label for r in g.traverse("a", T0).collect()} == {"A", "B"}
    assert "hot" in g.context("what about A and B", T0)
    assert [r.label for r in g.compact("s1", "about B", T0, ("B",), ("ship",)).session_restore("session", T0).collect()] == ["session_s1_summary"]
    g3 = Engine.empty(spark).add("ChromoQ derives from EGFP.", T0)
    assert g3.edges.filter("channel = 'derives_de'").count() == 1
    assert g.relate("C", "B", "trail", T0).merge("B", "C").nodes.filter("label = 'C'").count() == 0


def test_snapshot_round_trip(spark, tmp_path):
    g = Engine.empty(spark, "ws").relate("A", "B", "trail", T0)
    g.save(str(tmp_path), 1)
    back = Engine.load(spark, str(tmp_path), "ws")
    assert back.nodes.count() == 2 and back.edges.count() == 1
    g.export(str(tmp_path / "x"), "json")
    assert g.load_export(str(tmp_path / "x"), merge=True).edges.count() == 1
    with pytest.raises(ValueError):
        g.__class__.empty(spark, "../x")


def movable(links, c, gamma=2.0):
    """Nodes of a partition that would still gain by a move to a neighbour's community."""
    k = {n: sum(w for a, b, w in links if n in (a, b)) for n in c}
    m = sum(k.values()) / 2
    to = lambda n, x: sum(w for a, b, w in links if (a == n and c[b] == x) or (b == n and c[a] == x))
    total = lambda n, x: sum(k[i] for i in c if c[i] == x and i != n)
    value = lambda n, x: to(n, x) / m - gamma * k[n] * total(n, x) / (2 * m * m)
    return {n for n in c for x in set(c.values()) if to(n, x) > 0 and value(n, x) > value(n, c[n]) + 1e-9}


def test_communities_settle(spark, monkeypatch):
    import random

    from fadegraph.plans import graph_queries

    r = random.Random(0)  # a graph on which 12 rounds leave four nodes that would still move
    links = sorted({tuple(sorted(r.sample(range(150), 2))) for _ in range(300)})
    links = [(f"n{a:03}", f"n{b:03}", round(r.uniform(0.2, 0.9), 2)) for a, b in links]
    e = graph(spark, [(a, b, "trail", w) for a, b, w in links]).withColumn("last_touch", F.lit(AS_OF).cast("timestamp_ntz"))
    monkeypatch.setattr(graph_queries, "kg_edges", lambda *_: e)
    c = {x.node: x.community for x in graph_queries.communities(spark, "").collect()}
    assert len(c) == len({x for a, b, _ in links for x in (a, b)}) and not movable(links, c)
    with pytest.raises(RuntimeError):
        community.local_moving(e, most_rounds=2, as_of=AS_OF)


def test_pagerank_settles(spark, monkeypatch):
    from fadegraph.plans import graph_queries

    # no mass is lost on a ring, so the change shrinks by 0.85 a round only
    e = graph(spark, [(f"n{i}", f"n{(i + 1) % 30}", "trail", 0.9) for i in range(30)]).withColumn("last_touch", F.lit(AS_OF).cast("timestamp_ntz"))
    monkeypatch.setattr(graph_queries, "kg_edges", lambda *_: e)
    monkeypatch.setattr(graph_queries, "hub", lambda _: start(spark, "n0"))
    got = {x.node: x.rank for x in graph_queries.ppr_converged(spark, "").collect()}
    assert got == {f"n{i}": pytest.approx(0.15 * 0.85**i / (1 - 0.85**30), abs=1e-5) for i in range(30)}
    with pytest.warns(UserWarning, match="PageRank changed by"):
        rank.pagerank(e, start(spark, "n0"), rounds=2, as_of=AS_OF)
