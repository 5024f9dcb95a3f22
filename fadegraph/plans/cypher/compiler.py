"""Statements to plans.  Catalyst does the rest: patterns are equi-joins on node ids.

A binding is a row with one struct per node variable.  Variables shared by
patterns join; patterns that share none would be a cross product and are refused
unless one side is a single named node.  Predicates are two-valued: a comparison
with null is false.  An unknown relationship type puts no filter (``strict``
refuses it); a pattern key that a node's meta lacks passes (``strict`` does not).
"""
from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.functions import channels
from fadegraph.operators import maintenance
from fadegraph.operators.graph import AS_OF, effective
from fadegraph.operators.traverse import traverse, walkable
from fadegraph.plans.cypher.parser import CypherError, Node, Rel, Statement, parse

_OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_FIELDS = ("node_id", "label", "kind", "tags", "created_at", "last_seen", "meta")


@dataclass
class _Graph:
    nodes: DataFrame
    edges: DataFrame
    as_of: str
    strict: bool

    def pool(self) -> DataFrame:
        """Nodes as structs with a summary of their out-edges."""
        out = effective(self.edges, self.as_of).groupBy(F.col("src").alias("node_id")).agg(
            F.max("eff").alias("intensity"), F.max("confidence").alias("confidence"), F.sum("uses").alias("uses"))
        full = self.nodes.select(*_FIELDS).join(out, "node_id", "left")
        return full.select(F.struct(*_FIELDS, "intensity", "confidence", "uses").alias("n"))


def _prop(node: Column, name: str) -> Column:
    """A property of a node struct; else a key of its meta."""
    if name in ("label", "kind", "intensity", "confidence", "uses"):
        return node[name]
    if name in ("tags", "tag"):
        return F.array_join(node["tags"], ", ")
    if name in ("created_at", "last_seen"):
        return F.date_format(node[name], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if name == "id":
        return node["node_id"]
    return F.get_json_object(node["meta"], f"$.{name}")


def _fits(n: Column, pattern: Node, strict: bool) -> Column:
    tests = [F.lit(True)]
    if pattern.label:
        kind = pattern.label.lower()
        tests.append(n["kind"] == kind if kind in channels.KINDS else F.exists(n["tags"], lambda t: F.lower(t) == kind))
    for key, value in pattern.props.items():
        if key == "label":
            tests.append(n["label"] == value)
        elif key == "kind":
            tests.append(n["kind"] == str(value).lower())
        elif key == "tag":
            tests.append(F.array_contains(n["tags"], value))
        else:
            held = F.get_json_object(n["meta"], f"$.{key}")
            wanted = str(value).lower() if isinstance(value, bool) else str(value)
            tests.append(held == wanted if strict else held.isNull() | (held == wanted))
    return reduce(operator.and_, (F.coalesce(t, F.lit(False)) for t in tests))


def _types(rel: Rel, strict: bool) -> list[str] | None:
    if rel.type is None:
        return None
    if not channels.is_known(rel.type):
        if strict:
            raise CypherError(f"unknown relationship type {rel.type!r}")
        return None
    bare = rel.type.lower().replace("_", "")
    return [next((c for c in channels.CHANNELS if c.replace("_", "") == bare), rel.type.lower())]


def _steps(g: _Graph, rel: Rel, starts: DataFrame | None) -> DataFrame:
    """(a, b, r): pairs of node ids a relationship links, seen from its left end."""
    kinds = _types(rel, g.strict)
    flipped = g.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    seen = g.edges if rel.direction == "out" else flipped if rel.direction == "in" else g.edges.unionByName(flipped)
    if rel.low == rel.high == 1:
        e = walkable(seen, kinds, 0.0, as_of=g.as_of).groupBy("src", "dst").agg(F.max(F.struct("eff", "channel")).alias("m"))
        return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("m.channel").alias("r"), F.lit(1).alias("h"))
    from_ = starts if starts is not None else seen.select(F.col("src").alias("node")).distinct()
    walked = traverse(seen, from_, rel.high, 0.0, None, as_of=g.as_of, channels=kinds)
    kept = walked.filter((F.col("hops") >= max(1, rel.low)) & (F.col("hops") <= rel.high))
    return kept.select(F.col("seed").alias("a"), F.col("node").alias("b"), F.lit(rel.type or "*").alias("r"), F.col("hops").alias("h"))


def _match(g: _Graph, paths: list) -> tuple[DataFrame, set[str]]:
    """Bindings of all patterns, and the names of relationship variables."""
    pool, rows, bound, rels = g.pool(), None, set(), set()
    fresh = 0

    def candidates(n: Node, name: str) -> DataFrame:
        return pool.filter(_fits(F.col("n"), n, g.strict)).select(F.col("n").alias(name))

    for path in paths:
        names = []
        for n in path[::2]:
            fresh += 1
            names.append(n.var or f"_{fresh}")
        known = next((i for i, x in enumerate(names) if x in bound), None)
        if known is None:
            left = candidates(path[0], names[0])
            single = "label" in path[0].props
            if rows is not None and not single:
                if len(path) == 1 or not set(names) & bound:
                    raise CypherError("patterns that share no variable need a node given by its label")
            if rows is None:
                rows = left
            else:  # the new side is the one node of that label
                # of several nodes of a label, in different workspaces, the one of the smallest id
                rows = rows.withColumn(names[0], left.agg(F.min_by(names[0], f"{names[0]}.node_id")).scalar()).filter(F.col(names[0]).isNotNull())
            bound.add(names[0])
            known = 0
        else:
            rows = rows.filter(_fits(F.col(names[known]), path[2 * known], g.strict))
        order = [(i, i + 1) for i in range(known, len(names) - 1)] + [(i, i - 1) for i in range(known, 0, -1)]
        for i, j in order:
            rel: Rel = path[2 * min(i, j) + 1]
            if rel.var:
                rels.add(rel.var)
            if j < i:
                rel = Rel(rel.var, rel.type, rel.low, rel.high, {"out": "in", "in": "out"}.get(rel.direction, "both"), rel.props)
            starts = rows.select(F.col(f"{names[i]}.node_id").alias("node")).distinct() if rel.high > 1 or rel.low > 1 else None
            step = _steps(g, rel, starts).select(
                F.col("a").alias("_from"), F.col("b").alias("_to"), *([F.col("r").alias(rel.var)] if rel.var else []))
            rows = rows.join(step, F.col(f"{names[i]}.node_id") == F.col("_from")).drop("_from")
            if names[j] in bound:
                rows = rows.filter(F.col(f"{names[j]}.node_id") == F.col("_to")).filter(_fits(F.col(names[j]), path[2 * j], g.strict)).drop("_to")
            else:
                rows = rows.join(candidates(path[2 * j], names[j]), F.col("_to") == F.col(f"{names[j]}.node_id")).drop("_to")
                bound.add(names[j])
    return rows, rels


def _where(c: tuple) -> Column:
    if c[0] == "and":
        return _where(c[1]) & _where(c[2])
    if c[0] == "or":
        return _where(c[1]) | _where(c[2])
    if c[0] == "not":
        return ~_where(c[1])
    left, value = _prop(F.col(c[1][0]), c[1][1]), c[2]
    if value is None:
        return F.lit(False)
    if c[0] == "contains":
        return F.coalesce(F.lower(left).contains(str(value).lower()), F.lit(False))
    numeric = c[1][1] in ("intensity", "confidence", "uses")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not numeric:
        left = left.try_cast("double")
    if isinstance(value, bool):
        left, value = F.lower(left), str(value).lower()
    if numeric and isinstance(value, str):
        return F.lit(False)
    return F.coalesce(_OPS[c[0]](left, F.lit(value)), F.lit(False))


def _names(item: tuple) -> str:
    if item[0] == "call":
        return f"{item[1]}({item[2]}{'.' + item[3] if item[3] else ''})"
    return item[1] if item[0] == "var" else f"{item[1]}.{item[2]}"


def _returned(rows: DataFrame, s: Statement, rels: set[str]) -> DataFrame:
    value = lambda i: (
        _prop(F.col(i[1]), i[2]) if i[0] == "prop"
        else F.col(i[1]) if i[1] in rels
        else F.struct(*(F.col(f"{i[1]}.{f}").alias(f) for f in ("label", "kind", "tags", "meta")))
    )
    calls = [i for i in s.returns if i[0] == "call"]
    if any(i[1] != "COUNT" for i in calls):
        raise CypherError("COUNT is the only function")
    sort = None
    if s.order:
        key = _prop(F.col(s.order[0]), s.order[1])
        sort = key.asc_nulls_last() if s.order[2] == "asc" else key.desc_nulls_first()
    if calls:
        plain = [i for i in s.returns if i[0] != "call"]
        rows = rows.groupBy(*(value(i).alias(_names(i)) for i in plain)).agg(*(F.count("*").alias(_names(i)) for i in calls))
        out = rows.select(*(F.col(f"`{_names(i)}`") for i in s.returns))
        if s.order and f"{s.order[0]}.{s.order[1]}" in out.columns:
            c = F.col(f"`{s.order[0]}.{s.order[1]}`")
            out = out.orderBy(c.asc_nulls_last() if s.order[2] == "asc" else c.desc_nulls_first())
    else:
        out = (rows.orderBy(sort) if sort is not None else rows).select(*(value(i).alias(_names(i)) for i in s.returns))
    return out.limit(s.limit) if s.limit else out


def _created(g: _Graph, s: Statement, rows: DataFrame | None) -> DataFrame:
    """Observed edges (src, dst, channel, confidence, source, label) a CREATE makes."""
    out = []
    for path in s.create:
        for a, rel, b in zip(path[::2], path[1::2], path[2::2]):
            if rel.type is None or not channels.is_known(rel.type):
                raise CypherError(f"unknown channel {rel.type!r}")
            if rows is None or a.var not in rows.columns or b.var not in rows.columns:
                raise CypherError("both ends must be bound")
            a, b = (b, a) if rel.direction == "in" else (a, b)
            out.append(rows.select(
                F.col(f"{a.var}.node_id").alias("src"), F.col(f"{b.var}.node_id").alias("dst"), F.lit(_types(rel, True)[0]).alias("channel"),
                F.lit(float(rel.props.get("confidence", 0.7))).alias("confidence"), F.lit(str(rel.props.get("source", "cypher"))).alias("source"),
                F.lit(rel.props.get("label")).cast("string").alias("label")))
    if not out:
        raise CypherError("nothing to create")
    return reduce(DataFrame.unionByName, out)


def run(query: str, nodes: DataFrame, edges: DataFrame, as_of: str = AS_OF, strict: bool = False) -> DataFrame:
    """The rows of a RETURN; the observed edges of a CREATE; the ids a DELETE removes; the changes of a SET.

    Changes are (node_id, key, value); ``update`` applies them.
    """
    g, s = _Graph(nodes, edges, as_of, strict), parse(query)
    rows, rels = _match(g, s.paths) if s.paths else (None, set())
    if s.where:
        rows = rows.filter(_where(s.where))
    if s.create:
        return _created(g, s, rows)
    if s.delete:
        gone = [rows.select(F.col(f"{v}.node_id").alias("node_id")) for v in s.delete if v not in rels]
        return reduce(DataFrame.unionByName, gone).distinct() if gone else g.nodes.select("node_id").limit(0)
    if s.sets:
        return reduce(DataFrame.unionByName, [
            rows.select(F.col(f"{v}.node_id").alias("node_id"), F.lit(k).alias("key"), F.lit(None if x is None else str(x)).cast("string").alias("value")) for v, k, x in s.sets
        ]).distinct()
    return _returned(rows, s, rels)


def update(query: str, nodes: DataFrame, edges: DataFrame, as_of: str = AS_OF, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a CREATE, DELETE or SET.

    CREATE upserts: a known edge is reinforced at ``as_of``.  DELETE removes nodes with their edges.  SET adds tags or sets keys of meta.
    """
    s = parse(query)
    made = run(query, nodes, edges, as_of, strict)
    if s.create:
        seen = made.withColumn("ts", F.lit(as_of).cast("timestamp_ntz"))
        after = maintenance.apply_upserts(edges, seen, nodes)
        ends = nodes.groupBy("node_id").agg(F.min("workspace").alias("_w"))
        after = after.join(ends.withColumnRenamed("node_id", "src"), "src", "left")
        return nodes, after.withColumns({
            "workspace": F.coalesce("workspace", "_w"), "provenance": F.coalesce("provenance", F.lit("automated")), "ord": F.coalesce("ord", F.xxhash64("src", "dst", "channel")),
        }).select(*edges.drop("eff").columns)
    if s.delete:
        left = edges
        for end in ("src", "dst"):
            left = left.join(made.select(F.col("node_id").alias(end)), end, "left_anti")
        return nodes.join(made, "node_id", "left_anti"), left.select(*edges.columns)
    if s.sets:
        return maintenance.set_properties(nodes, made), edges
    raise CypherError("nothing to write; run() answers a RETURN")
