"""Queries in the Cypher dialect, with their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.operators.graph import kg_edges, kg_nodes
from fadegraph.plans.base_sql import GRAPH
from fadegraph.engine import Engine
from fadegraph.functions import exprs
from fadegraph.operators.graph import AS_OF
from fadegraph.plans.base_sql import AS_OF as T
from fadegraph.plans.cypher import run, update

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, cypher: str, columns: list[str], sql: str, rounded: tuple[str, ...] = ()) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        out = run(cypher, kg_nodes(spark, d), kg_edges(spark, d)).toDF(*columns)
        return out.withColumns({c: F.round(c, 6) + 0.0 for c in rounded}) if rounded else out

    f.__name__, f.__doc__ = name, cypher
    QUERIES[name], SQL[name] = f, f"{GRAPH}, live AS (SELECT * FROM kg_eff WHERE channel <> 'alarm'), ot AS (SELECT src, max(eff) AS intensity, max(confidence) AS confidence, sum(uses) AS uses FROM kg_eff GROUP BY src){sql if sql.startswith(",") else " " + sql}"


_PAIR = "JOIN live e ON e.src = a.node_id JOIN kg_nodes b ON b.node_id = e.dst"
_add("cypher_scan", "MATCH (n:Event) RETURN n.label, n.kind", ["label", "kind"], "SELECT label, kind FROM kg_nodes WHERE kind = 'event'")
_add("cypher_where_bool", "MATCH (n) WHERE n.kind = 'concept' AND n.uses > 3 OR NOT n.confidence < 0.9 RETURN n.label, n.uses", ["label", "uses"],
     "SELECT label, uses::BIGINT AS uses FROM kg_nodes LEFT JOIN ot ON src = node_id WHERE coalesce(kind = 'concept', false) AND coalesce(uses > 3, false) OR NOT coalesce(confidence < 0.9, false)")
_add("cypher_contains", "MATCH (n) WHERE n.label CONTAINS 'RELAY' RETURN n.label", ["label"], "SELECT label FROM kg_nodes WHERE contains(lower(label), 'relay')")
_add("cypher_1hop", "MATCH (a:Concept)-[r:causal]->(b) RETURN a.label, b.label, r", ["a", "b", "r"],
     f"SELECT DISTINCT a.label AS a, b.label AS b, e.channel AS r FROM kg_nodes a {_PAIR} WHERE a.kind = 'concept' AND e.channel = 'causal'")
_add("cypher_varlen", "MATCH (a:Event)-[:derives_de*1..2]->(b) RETURN a.label, b.label", ["a", "b"],
     """, w AS (SELECT src AS a, dst AS b, eff AS s, 1 AS h, [src, dst] AS p FROM live WHERE channel = 'derives_de' AND src <> dst
  UNION ALL SELECT w.a, e.dst, w.s * e.eff, h + 1, list_append(p, e.dst) FROM w JOIN live e ON e.src = w.b WHERE h < 2 AND e.channel = 'derives_de' AND NOT list_contains(p, e.dst))
  SELECT DISTINCT a.label AS a, b.label AS b FROM w JOIN kg_nodes a ON a.node_id = w.a JOIN kg_nodes b ON b.node_id = w.b WHERE a.kind = 'event'""".lstrip())
_add("cypher_two_patterns", "MATCH (a)-[:causal]->(b), (b)-[:trail]->(c) RETURN a.label, b.label, c.label", ["a", "b", "c"],
     """SELECT DISTINCT a.label AS a, b.label AS b, c.label AS c FROM kg_nodes a JOIN live e ON e.src = a.node_id JOIN kg_nodes b ON b.node_id = e.dst
  JOIN live f ON f.src = b.node_id JOIN kg_nodes c ON c.node_id = f.dst WHERE e.channel = 'causal' AND f.channel = 'trail'""")
_add("cypher_incoming", "MATCH (a:Warning)<-[:trail]-(b) RETURN a.label, b.label", ["a", "b"],
     "SELECT DISTINCT a.label AS a, b.label AS b FROM kg_nodes a JOIN live e ON e.dst = a.node_id JOIN kg_nodes b ON b.node_id = e.src WHERE a.kind = 'warning' AND e.channel = 'trail'")
_add("cypher_order_limit", "MATCH (n:Entity) RETURN n.label ORDER BY n.label DESC LIMIT 25", ["label"], "SELECT label FROM kg_nodes WHERE kind = 'entity' ORDER BY label DESC LIMIT 25")
_add("cypher_count", "MATCH (a)-[:trail]->(b) RETURN a.kind, COUNT(b)", ["kind", "n"],
     f"SELECT kind, count(*) AS n FROM (SELECT DISTINCT a.node_id, a.kind, b.node_id AS b FROM kg_nodes a {_PAIR} WHERE e.channel = 'trail') GROUP BY kind")
_add("cypher_out_props", "MATCH (n:Procedure) RETURN n.label, n.intensity, n.confidence, n.uses", ["label", "intensity", "confidence", "uses"],
     "SELECT label, round(intensity, 6) AS intensity, round(confidence, 6) AS confidence, uses::BIGINT AS uses FROM kg_nodes LEFT JOIN ot ON src = node_id WHERE kind = 'procedure'", ("intensity", "confidence"))


def _write(name: str, cypher: str, sql: str):
    """Register a statement that writes: its function gets nodes and edges after it."""

    def put(f):
        def q(spark: SparkSession, d: str) -> DataFrame:
            return f(*update(cypher, kg_nodes(spark, d), kg_edges(spark, d)))

        q.__name__, q.__doc__ = name, cypher
        QUERIES[name], SQL[name] = q, GRAPH + sql
        return f

    return put


@_write("cypher_create", "MATCH (a)-[:causal]->(b) CREATE (b)-[:trail {confidence: 0.6, source: 'review'}]->(a)",
        f""", p AS (SELECT DISTINCT e.dst AS src, e.src AS dst FROM kg_eff e JOIN kg_nodes a ON a.node_id = e.src JOIN kg_nodes b ON b.node_id = e.dst WHERE e.channel = 'causal')
SELECT p.src, p.dst, round(CASE WHEN e.eff IS NULL THEN 0.6 ELSE least(1.0, e.eff + 0.3) END, 6) AS intensity, coalesce(e.confidence, 0.6) AS confidence, coalesce(e.uses, 0) + 1 AS uses
FROM p LEFT JOIN kg_eff e ON e.src = p.src AND e.dst = p.dst AND e.channel = 'trail'
UNION ALL SELECT e.src, e.dst, round(intensity, 6), confidence, uses FROM kg_edges e WHERE channel = 'trail' AND last_touch = {T} AND NOT EXISTS (SELECT 1 FROM p WHERE p.src = e.src AND p.dst = e.dst)""")
def _made(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.filter((F.col("channel") == "trail") & (F.col("last_touch") == exprs.ts(AS_OF)))
    return e.select("src", "dst", (F.round("intensity", 6) + 0.0).alias("intensity"), "confidence", "uses")


@_write("cypher_delete", "MATCH (n:Warning) DELETE n",
        ", w AS (SELECT node_id FROM kg_nodes WHERE kind = 'warning') SELECT src, dst, channel FROM kg_edges WHERE src NOT IN (SELECT node_id FROM w) AND dst NOT IN (SELECT node_id FROM w)")
def _left(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "channel")


@_write("cypher_set", "MATCH (n:Procedure) SET n.reviewed = true",
        " SELECT node_id, CASE WHEN kind = 'procedure' THEN 'true' END AS reviewed FROM kg_nodes")
def _set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.lower(F.get_json_object("meta", "$.reviewed")).alias("reviewed"))


def engine_relate(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the first label's node after it was related to the last label's, in an opened graph of all workspaces."""
    g = Engine.open(spark, d)
    a, b = g.nodes.agg(F.min("label"), F.max("label")).first()
    after = g.relate(a, b, "causal", AS_OF, 0.7)
    return after.show(a, AS_OF).select("src", "dst", "channel", (F.round("eff", 6) + 0.0).alias("eff"), "uses").withColumn("nodes", after.nodes.agg(F.count("*")).scalar())


QUERIES["engine_relate"] = engine_relate
SQL["engine_relate"] = GRAPH + """, n AS (SELECT arg_min(node_id, label) AS a, arg_max(node_id, label) AS b FROM kg_nodes),
e AS (SELECT src, dst, channel, eff, uses FROM kg_eff, n WHERE src = a OR dst = a),
r AS (SELECT src, dst, channel, CASE WHEN src = a AND dst = b AND channel = 'causal' THEN least(1.0, eff + 0.5) ELSE eff END AS eff,
  uses + CASE WHEN src = a AND dst = b AND channel = 'causal' THEN 1 ELSE 0 END AS uses FROM e, n
  UNION ALL SELECT a, b, 'causal', 0.7, 1 FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = n.a AND e.dst = n.b AND e.channel = 'causal'))
SELECT src, dst, channel, round(eff, 6) AS eff, uses, (SELECT count(*) FROM kg_nodes) AS nodes FROM r"""
