"""Queries over the graph: state, decay, maintenance, walks, ranks and communities."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.functions import channels, exprs
from fadegraph.operators import community, fold, maintenance, rank, traverse
from fadegraph.operators.graph import AS_OF, adjacency, effective, kg_edges, kg_nodes, observed_edges
from fadegraph.plans.base_sql import AS_OF as T
from fadegraph.plans.base_sql import DELTA, EDGES, GRAPH, TAU
from fadegraph.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _r(c: str, places: int = 6):
    return (F.round(c, places) + 0.0).alias(c)


#: SQL of the start node of walks: the source with most live out-edges.
_HUB = "hub AS (SELECT src AS node FROM kg_eff WHERE channel <> 'alarm' AND eff >= 0.15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def hub(edges: DataFrame) -> DataFrame:
    """(node): the source with most live out-edges."""
    top = traverse.walkable(edges).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    one = edges.sparkSession.range(1 if top else 0)
    return one.select(F.lit(top.src if top else None).cast("string").alias("node"))


def walks(spark: SparkSession, d: str) -> DataFrame:
    """The edges, written once for a query that reads them more than once."""
    return adjacency(kg_edges(spark, d))


@query(f"WITH {EDGES} SELECT src, dst, channel, round(eff, 6) AS eff FROM kg_eff")
def eff_intensity(spark: SparkSession, d: str) -> DataFrame:
    """Effective intensity of every edge."""
    return effective(kg_edges(spark, d)).select("src", "dst", "channel", _r("eff"))


@query(f"""WITH {EDGES}, r AS (
  SELECT src, dst, channel, round(eff, 6) AS eff, row_number() OVER (PARTITION BY src ORDER BY round(eff, 6) DESC, dst, channel) AS rn
  FROM kg_eff WHERE NOT (channel <> 'derives_de' AND eff < 0.05)
) SELECT src, dst, channel, eff, rn::INT AS rn FROM r WHERE rn <= 10""")
def top_live_edges(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest live out-edges of every node."""
    from pyspark.sql import Window as W

    e = effective(kg_edges(spark, d)).filter(~(channels.prunable(F.col("channel")) & (F.col("eff") < 0.05))).select("src", "dst", "channel", _r("eff"))
    w = W.partitionBy("src").orderBy(F.desc("eff"), "dst", "channel")
    return e.withColumn("rn", F.row_number().over(w)).filter("rn <= 10")


@query(f"WITH {EDGES} SELECT src, dst, channel FROM kg_eff WHERE channel <> 'derives_de' AND eff < 0.05")
def dead_edges(spark: SparkSession, d: str) -> DataFrame:
    """Prunable edges below the threshold."""
    e = kg_edges(spark, d)
    return e.filter(exprs.dead(F.col("intensity"), F.col("channel"), F.col("last_touch"), exprs.ts(AS_OF))).select("src", "dst", "channel")


@query(f"WITH {EDGES} SELECT src, dst, channel FROM kg_eff WHERE NOT (channel <> 'derives_de' AND eff < 0.05)")
def prune_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Edges a pruning leaves."""
    return maintenance.prune(kg_edges(spark, d), AS_OF).select("src", "dst", "channel")


@query(GRAPH + """ SELECT (SELECT count(*) FROM kg_nodes) AS nodes, count(*) AS edges,
  count(*) FILTER (WHERE channel <> 'derives_de' AND eff < 0.05) AS dead_edges, round(avg(eff), 6) AS avg_intensity FROM kg_eff""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of the graph, dead edges, mean intensity."""
    return maintenance.stats(kg_nodes(spark, d), kg_edges(spark, d), AS_OF).withColumn("avg_intensity", _r("avg_intensity"))


@query(GRAPH + " SELECT node_id, workspace, label, kind, created_at::VARCHAR AS created_at, last_seen::VARCHAR AS last_seen FROM kg_nodes")
def node_upsert_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Nodes after all observations: the first kind wins."""
    n = kg_nodes(spark, d)
    return n.select("node_id", "workspace", "label", "kind", F.col("created_at").cast("string"), F.col("last_seen").cast("string"))


@query("""WITH t AS (SELECT node_id, ord, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM nodes WHERE node_id IS NOT NULL),
f AS (SELECT node_id, coalesce(tag, '<null>') AS tag, min((ord, i)) AS p FROM t GROUP BY 1, 2)
SELECT node_id, string_agg(tag, '|' ORDER BY p) AS tags FROM f GROUP BY node_id""")
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    """Tags of every node, united in order of observation."""
    n = kg_nodes(spark, d).filter(F.size("tags") > 0)
    return n.select("node_id", F.array_join("tags", "|", "<null>").alias("tags"))


@query(f"""WITH RECURSIVE o AS (
  SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 'alarm' ELSE 'episodic' END AS channel, ts, least(1.0, value / 100) AS c,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT user_id, event_type, channel, ts, c AS x, n FROM o WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.event_type, o.channel, o.ts,
    least(1.0, x * exp(-({TAU.replace('CASE channel', 'CASE o.channel')}) * greatest(0, date_sub('second', f.ts, o.ts)) / 3600.0) + ({DELTA.replace('CASE channel', 'CASE o.channel')})), o.n
  FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.n = f.n + 1
), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC) AS rn FROM f)
SELECT user_id, event_type, channel, round(x, 6) AS intensity, ts::VARCHAR AS last_touch, n AS uses FROM l WHERE rn = 1""")
def edge_fold_reinforce(spark: SparkSession, d: str) -> DataFrame:
    """Users' edges to event types after the ordered, capped reinforcement of all events."""
    e = table(spark, d, "events").select(
        "user_id", "event_type", F.when(F.col("event_type") == "error", "alarm").otherwise("episodic").alias("channel"), "ts",
        F.col("event_id").alias("seq"), (F.col("value") / 100).alias("confidence"),
    )
    return fold.fold_edges(e, ["user_id", "event_type", "channel"]).select(
        "user_id", "event_type", "channel", _r("intensity"), F.col("last_touch").cast("string"), "uses")


@query(f"""WITH RECURSIVE {EDGES}, o AS (
  SELECT src, dst, channel, last_touch AS ts, confidence AS c, row_number() OVER (PARTITION BY src, dst, channel ORDER BY last_touch, ord) AS n FROM e0
), f AS (
  SELECT src, dst, channel, ts, c AS x, n FROM o WHERE n = 1
  UNION ALL
  SELECT o.src, o.dst, o.channel, o.ts,
    least(1.0, x * exp(-({TAU.replace('CASE channel', 'CASE o.channel')}) * greatest(0, date_sub('second', f.ts, o.ts)) / 3600.0) + ({DELTA.replace('CASE channel', 'CASE o.channel')})), o.n
  FROM f JOIN o ON o.src = f.src AND o.dst = f.dst AND o.channel = f.channel AND o.n = f.n + 1
), l AS (SELECT *, row_number() OVER (PARTITION BY src, dst, channel ORDER BY n DESC) AS rn FROM f)
SELECT src, dst, channel, round(x, 6) AS intensity, n AS uses FROM l WHERE rn = 1""")
def edge_upsert_fold(spark: SparkSession, d: str) -> DataFrame:
    """Edges as repeated upserts leave them: the first inserts, later ones reinforce."""
    e = observed_edges(table(spark, d, "edges")).withColumnsRenamed({"last_touch": "ts", "ord": "seq"})
    return fold.fold_edges(e, ["src", "dst", "channel"]).select("src", "dst", "channel", _r("intensity"), "uses")


@query(f"WITH {EDGES}, {_HUB} SELECT dst, channel, round(eff, 6) AS eff FROM kg_eff, hub WHERE src = node AND channel IN ('derives_de', 'causal') AND eff >= 0.1")
def neighbors_channel(spark: SparkSession, d: str) -> DataFrame:
    """Out-neighbours of the busiest node over two channels."""
    e = walks(spark, d)
    return traverse.neighbours(e, hub(e), ["derives_de", "causal"], 0.1).select("dst", "channel", _r("eff"))


@query(f"WITH {EDGES} SELECT channel, count(*) AS n FROM kg_eff WHERE channel <> 'alarm' AND eff >= 0.15 GROUP BY channel")
def default_channel_excludes_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Edges a walk without channel filter may use, by channel."""
    return traverse.walkable(kg_edges(spark, d)).groupBy("channel").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES} SELECT src, dst, channel FROM kg_eff
WHERE last_touch >= TIMESTAMP '2024-01-01' AND last_touch <= TIMESTAMP '2024-06-30' AND channel <> 'alarm' AND eff >= 0.0""")
def since_until(spark: SparkSession, d: str) -> DataFrame:
    """Edges touched in a span of time, both ends included."""
    return traverse.walkable(kg_edges(spark, d), minimum=0.0, since="2024-01-01", until="2024-06-30").select("src", "dst", "channel")


@query(GRAPH + " SELECT node_id FROM kg_nodes WHERE node_id NOT IN (SELECT src FROM kg_edges UNION SELECT dst FROM kg_edges)")
def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at no edge."""
    return maintenance.orphans(kg_nodes(spark, d), kg_edges(spark, d)).select("node_id")


@query(GRAPH + """, p AS (SELECT src FROM kg_edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 2),
k AS (SELECT min(src) AS keep, max(src) AS absorb FROM p)
SELECT CASE WHEN src = absorb THEN keep ELSE src END AS src, CASE WHEN dst = absorb THEN keep ELSE dst END AS dst, channel, ord
FROM kg_edges, k WHERE NOT (src IN (keep, absorb) AND dst IN (keep, absorb))""")
def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the two busiest sources became one."""
    e = kg_edges(spark, d)
    two = [r.src for r in e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(2).collect()]
    _, moved = maintenance.merge_nodes(kg_nodes(spark, d), e, min(two), max(two))
    return moved.select("src", "dst", "channel", "ord")


@query(f"""WITH {EDGES}, a AS (SELECT avg(uses) AS u FROM kg_edges)
SELECT src, dst, channel, round(CASE WHEN uses > 1.5 * u THEN least(1.0, eff + ({DELTA})) ELSE intensity END, 6) AS intensity,
  uses + CASE WHEN uses > 1.5 * u THEN 1 ELSE 0 END AS uses FROM kg_eff, a""")
def physarum_reinforce(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the much-used ones were reinforced."""
    return maintenance.physarum(kg_edges(spark, d), AS_OF).select("src", "dst", "channel", _r("intensity"), "uses")


@query(GRAPH + """, t AS (SELECT max(created_at) AS t FROM kg_nodes WHERE kind = 'event'),
r AS (SELECT node_id FROM kg_nodes, t WHERE kind = 'event' AND created_at >= date_trunc('day', t) - INTERVAL 720 HOUR)
SELECT node_id AS src, 'derives_de' AS channel, 0.7::DOUBLE AS confidence FROM r WHERE (SELECT count(*) FROM r) >= 3""")
def consolidate_recent(spark: SparkSession, d: str) -> DataFrame:
    """Edges from recent events to the concept that consolidates them."""
    n = kg_nodes(spark, d)
    last = n.filter(F.col("kind") == "event").agg(F.date_trunc("day", F.max("created_at")).cast("string")).first()[0] or AS_OF
    return maintenance.consolidate(n, last, "commons", hours=720)[1].select("src", "channel", "confidence")


@query(f"""WITH {EDGES}, d AS (SELECT src AS node FROM kg_edges UNION ALL SELECT dst FROM kg_edges)
SELECT node, count(*) AS degree FROM d GROUP BY node ORDER BY degree DESC, node LIMIT 50""")
def degree_topn(spark: SparkSession, d: str) -> DataFrame:
    """The fifty busiest nodes."""
    return traverse.degrees(kg_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(50)


@query(f"""WITH {EDGES}, {_HUB}, b AS (SELECT src, dst FROM kg_edges UNION SELECT dst, src FROM kg_edges),
h1 AS (SELECT DISTINCT dst AS node FROM b, hub WHERE src = hub.node), h2 AS (SELECT DISTINCT b.dst AS node FROM b JOIN h1 ON b.src = h1.node),
a AS (SELECT node, 0 AS h FROM hub UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)
SELECT node, min(h)::INT AS hops FROM a GROUP BY node""")
def khop_undirected(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two hops of the busiest, whatever the direction."""
    e = walks(spark, d)
    return traverse.khop(e, hub(e), 2)


_WALK = """, w AS (
  SELECT node AS seed, node, 1.0::DOUBLE AS score, 0 AS hops, [node] AS path FROM {start}
  UNION ALL
  SELECT w.seed, e.dst, w.score * e.eff, w.hops + 1, list_append(w.path, e.dst)
  FROM w JOIN kg_eff e ON e.src = w.node
  WHERE w.hops < {hops} AND e.channel <> 'alarm' {more} AND e.eff >= {least} AND w.score * e.eff >= {least} AND NOT list_contains(w.path, e.dst)
), best AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY score DESC, hops) AS rn FROM w)
"""


@query(GRAPH + ", " + _HUB + _WALK.format(start="hub", hops=2, least=0.15, more="") + "SELECT seed, node, round(score, 6) AS score, hops::INT AS hops FROM best WHERE rn = 1")
def traverse_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Best products of intensities within two hops of the busiest node."""
    e = walks(spark, d)
    return traverse.traverse(e, hub(e), 2, limit=None, paths=False).select("seed", "node", _r("score"), "hops")


@query(GRAPH + ", s AS (SELECT DISTINCT src AS node FROM kg_eff WHERE channel = 'derives_de' AND eff >= 0.15)"
       + _WALK.format(start="s", hops=3, least=0.15, more="AND e.channel = 'derives_de'")
       + ", t AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 6) DESC, hops, node) AS n FROM best WHERE rn = 1)"
       + " SELECT seed, node, round(score, 6) AS score, hops::INT AS hops FROM best WHERE rn = 1")
def traverse_3hop_channel(spark: SparkSession, d: str) -> DataFrame:
    """Three hops over derivations from every node that has one."""
    e = walks(spark, d)
    starts = traverse.walkable(e, ["derives_de"]).select(F.col("src").alias("node")).distinct()
    return traverse.traverse(e, starts, 3, limit=None, paths=False, channels=["derives_de"]).select("seed", "node", _r("score"), "hops")


@query(GRAPH + ", " + _HUB + """, e AS (SELECT src, dst, max(eff) AS eff FROM kg_eff WHERE channel <> 'alarm' AND eff >= 0.05 GROUP BY 1, 2),
w AS (
  SELECT dst AS node, eff AS score, [src, dst] AS path FROM e, hub WHERE src = hub.node AND src <> dst
  UNION ALL
  SELECT e.dst, score * eff, list_append(path, e.dst) FROM w JOIN e ON e.src = w.node WHERE len(path) < 4 AND score * eff >= 0.05 AND NOT list_contains(path, e.dst)
), g AS (SELECT node FROM w GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)
SELECT path, score, hops FROM (SELECT array_to_string(path, '>') AS path, round(score, 6) AS score, (len(path) - 1)::INT AS hops FROM w JOIN g USING (node)
  WHERE NOT list_contains(path[1:-2], g.node)) ORDER BY score DESC, path LIMIT 3""")
def explain_paths(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest simple paths from the busiest node to the one most paths reach."""
    e = walks(spark, d)
    start = hub(e).first()
    goal = traverse.reached_most(e, start.node).first() if start else None
    return traverse.explain_paths(e, start.node if start else "", goal.node if goal else "").withColumn("score", _r("score"))


@query(GRAPH + """, c AS (SELECT node_id, label, CASE WHEN label = 'Relay' THEN 1 WHEN lower(label) = 'relay' THEN 2 WHEN contains(lower(label), 'relay') THEN 3
  WHEN strlen(label) >= 3 AND contains('relay', lower(label)) THEN 4 END AS stage FROM kg_nodes)
SELECT node_id, label, stage::INT AS stage FROM c WHERE stage IS NOT NULL ORDER BY stage, CASE stage WHEN 3 THEN length(label) WHEN 4 THEN -length(label) ELSE 0 END, label, node_id LIMIT 1""")
def start_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The node a loose query starts from."""
    return traverse.resolve_start(kg_nodes(spark, d), "Relay")


@query(GRAPH + """, dg AS (SELECT node, count(*) AS g FROM (SELECT src AS node FROM kg_eff WHERE eff > 0.05 UNION ALL SELECT dst FROM kg_eff WHERE eff > 0.05) GROUP BY node),
r AS (SELECT node_id, label, ln((SELECT count(*) FROM kg_nodes) / (1 + coalesce(g, 0))) + 1 AS x FROM kg_nodes LEFT JOIN dg ON node = node_id)
SELECT node_id, label, round(CASE WHEN max(x) OVER () > 0 THEN x / max(x) OVER () ELSE x END, 6) AS specificity FROM r""")
def node_specificity(spark: SparkSession, d: str) -> DataFrame:
    """How specific each node is: the fewer live edges, the more."""
    return rank.specificity(kg_nodes(spark, d), kg_edges(spark, d)).withColumn("specificity", _r("specificity"))


def _ppr_sql(rounds: int) -> str:
    step = "".join(
        f""", r{k} AS (SELECT node, sum(rank) AS rank FROM (
  SELECT t.dst AS node, 0.85 * r.rank * t.p AS rank FROM r{k - 1} r JOIN t ON t.src = r.node UNION ALL SELECT node, 0.15 FROM hub) GROUP BY node)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH {EDGES}, {_HUB}, l AS (SELECT src, dst, sum(eff) AS w FROM kg_eff WHERE eff > 0.001 GROUP BY 1, 2),
t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM l), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM hub){step}
SELECT node, round(rank, 6) AS rank FROM r{rounds} WHERE rank > 1e-8"""


@query(_ppr_sql(5))
def ppr_k5(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds of Personalized PageRank from the busiest node."""
    e = walks(spark, d)
    return rank.pagerank(e, hub(e), rounds=5, tolerance=None).withColumn("rank", _r("rank"))


@query()
def ppr_converged(spark: SparkSession, d: str) -> DataFrame:
    """Personalized PageRank until a round changes it by less than 1e-6."""
    e = walks(spark, d)
    return rank.pagerank(e, hub(e), rounds=None).withColumn("rank", _r("rank"))


@query(f"""WITH {EDGES}, a AS (SELECT src AS a, dst AS b, eff AS w FROM kg_eff WHERE eff >= 0.001 UNION ALL SELECT dst, src, eff FROM kg_eff WHERE eff >= 0.001),
k AS (SELECT a, sum(w) AS k FROM a GROUP BY a), m AS (SELECT sum(k) / 2 AS m FROM k), p AS (SELECT a AS node, k, substr(a, 1, 1) AS c FROM k)
SELECT round(coalesce(sum((w - x.k * y.k / m) / m), 0), 6) AS q FROM a JOIN p x ON x.node = a.a JOIN p y ON y.node = a.b, m WHERE x.c = y.c""")
def modularity_fixed_partition(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the partition by an id's first digit."""
    e = kg_edges(spark, d)
    parts = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.substring("node", 1, 1))
    return community.modularity(e, parts).withColumn("q", _r("q"))


def _components_sql(rounds: int) -> str:
    step = "".join(
        f", c{k} AS MATERIALIZED (SELECT c.node, least(c.component, min(n.component)) AS component FROM c{k - 1} c JOIN b ON b.src = c.node JOIN c{k - 1} n ON n.node = b.dst GROUP BY c.node, c.component)"
        for k in range(1, rounds + 1)
    )
    return f"""WITH {EDGES}, b AS MATERIALIZED (SELECT src, dst FROM kg_edges UNION SELECT dst, src FROM kg_edges),
c0 AS (SELECT DISTINCT src AS node, src AS component FROM b){step} SELECT node, component FROM c{rounds}"""


@query(_components_sql(40))
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """The connected part of each node."""
    return community.components(kg_edges(spark, d))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities by local moving, until no node moves."""
    return community.local_moving(kg_edges(spark, d))


@query(f"""WITH {EDGES}, n AS (SELECT src, dst, channel, row_number() OVER (ORDER BY ord) AS i FROM kg_edges)
SELECT src, dst, channel, round(least(1.0, eff + ({DELTA})), 6) AS intensity, uses + 1 AS uses FROM kg_eff WHERE channel = 'causal'""")
def reinforce_causal(spark: SparkSession, d: str) -> DataFrame:
    """Causal edges after one reinforcement."""
    e = kg_edges(spark, d).filter(F.col("channel") == "causal")
    return maintenance.reinforce(e, AS_OF).select("src", "dst", "channel", _r("intensity"), "uses")


@query(f"""WITH {EDGES}, {_HUB} SELECT e.src, e.dst, e.channel FROM kg_edges e, hub WHERE e.src <> node AND e.dst <> node""")
def forget_node(spark: SparkSession, d: str) -> DataFrame:
    """Edges left when the busiest node is forgotten."""
    e = walks(spark, d)
    h = hub(e).first()
    return maintenance.forget(kg_nodes(spark, d), e, h.node if h else "")[1].select("src", "dst", "channel")


@query(GRAPH + """, live AS (SELECT * FROM kg_eff WHERE NOT (channel <> 'derives_de' AND eff < 0.05))
SELECT node_id FROM kg_nodes WHERE node_id IN (SELECT src FROM live UNION SELECT dst FROM live)""")
def daily_prune_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes left when dead edges and then orphans are gone."""
    return maintenance.daily_prune(kg_nodes(spark, d), kg_edges(spark, d), AS_OF)[0].select("node_id")
