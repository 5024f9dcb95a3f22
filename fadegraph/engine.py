"""One object with the engine's verbs; each returns DataFrames or an engine with new state.

State is two DataFrames: nodes (workspace, node_id, label, kind, created_at,
last_seen, tags, meta, ord) and edges (workspace, src, dst, channel, intensity,
confidence, last_touch, uses, source, label, provenance, ord).  Nothing is
changed in place and nothing reads the clock: writing verbs take ``as_of``.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.functions import channels, exprs
from fadegraph.operators import community, fusion, hdc, maintenance, rank, text, traverse
from fadegraph.operators.graph import EDGE, effective, kg_edges, kg_nodes
from fadegraph.plans import cypher
from fadegraph.sources import texts
from fadegraph.sources.plugins import Registry

NODE = ["workspace", "node_id", "label", "kind", "created_at", "last_seen", "tags", "meta", "ord"]
NODE_SCHEMA = ("workspace string, node_id string, label string, kind string, created_at timestamp_ntz, last_seen timestamp_ntz, "
               "tags array<string>, meta string, ord bigint")
EDGE_SCHEMA = ("workspace string, src string, dst string, channel string, intensity double, confidence double, last_touch timestamp_ntz, "
               "uses bigint, source string, label string, provenance string, ord bigint")
# Words a context block does not search for.
CONTEXT_STOP = frozenset(
    "les des une est sont que qui pour par dans avec pas sur mais the and for you this that not fais fait quoi comment quel quelle ton tes mon mes "
    "dire dit dis peut veux elle nous vous ils toi moi".split()
)


@dataclass(frozen=True)
class Engine:
    """A workspace's graph."""

    nodes: DataFrame
    edges: DataFrame
    workspace: str = "default"

    # -- making one ---------------------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession, workspace: str = "default") -> Engine:
        """A graph without anything."""
        return cls(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), texts.workspace_name(workspace))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, workspace: str | None = None) -> Engine:
        """The graph of the tables nodes and edges of a folder: of one workspace, or of all (new nodes then go to ``commons``)."""
        n, e = kg_nodes(spark, folder).select(*NODE), kg_edges(spark, folder).select(*EDGE)
        if workspace is not None:
            n, e = n.filter(F.col("workspace") == workspace), e.filter(F.col("workspace") == workspace)
        return cls(n, e, texts.workspace_name(workspace or "commons"))

    @staticmethod
    def workspaces(spark: SparkSession, root: str) -> list[str]:
        """Names of the workspaces with snapshots under a root."""
        return texts.workspaces(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, workspace: str) -> Engine:
        """A new workspace under a root, saved empty; an error if it is there."""
        if workspace in texts.workspaces(spark, root):
            raise FileExistsError(workspace)
        made = cls.empty(spark, workspace)
        made.save(root, 0)
        return made

    @classmethod
    def load(cls, spark: SparkSession, root: str, workspace: str, version: int | None = None) -> Engine:
        """A snapshot."""
        return cls(*texts.load_snapshot(spark, root, workspace, version), workspace)

    def save(self, root: str, version: int) -> str:
        """Write a snapshot."""
        return texts.save_snapshot(self.nodes, self.edges, root, self.workspace, version)

    def export(self, path: str, form: str = "json") -> None:
        """Write the graph as json, csv or dot."""
        texts.export_graph(self.nodes, self.edges, path, form)

    def load_export(self, path: str, merge: bool = False) -> Engine:
        """The graph of a json export, or this one with it merged in (newer edges win)."""
        n, e = texts.import_graph(self.nodes.sparkSession, path, NODE_SCHEMA, EDGE_SCHEMA)
        if not merge:
            return replace(self, nodes=n, edges=e)
        from fadegraph.operators.graph import latest_edges, upsert_nodes

        return replace(self, nodes=upsert_nodes(self.nodes.unionByName(n)).select(*NODE), edges=latest_edges(self.edges.unionByName(e)).select(*EDGE))

    # -- writing ------------------------------------------------------------------------------

    @property
    def _spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def _id(self, label: Column) -> Column:
        return exprs.node_id(F.lit(self.workspace), label)

    def _known(self) -> DataFrame:
        """(label, known): the node of each label, the smallest id where several workspaces have it."""
        return self.nodes.groupBy("label").agg(F.min("node_id").alias("known"))

    def _pair(self, src: str, dst: str) -> Column:
        """The edges between two labels; an error where one names no node."""
        return (F.col("src") == self._one(src)) & (F.col("dst") == self._one(dst))

    def _observed(self, nodes: DataFrame, edges: DataFrame, as_of: str, source: str) -> Engine:
        """With observed nodes (label, kind, tags) and edges (src, dst as labels, channel, confidence)."""
        t = exprs.ts(as_of)
        first = nodes.filter("label IS NOT NULL").groupBy("label").agg(F.first("kind").alias("kind"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"))
        known = self._known()
        seen = first.join(known, "label", "left").select(F.coalesce("known", self._id(F.col("label"))).alias("i"), F.col("label").alias("l"), F.col("kind").alias("k"), F.col("tags").alias("g"))
        none = F.array().cast("array<string>")
        n = self.nodes.join(seen, F.col("node_id") == F.col("i"), "full").select(
            F.coalesce("workspace", F.lit(self.workspace)).alias("workspace"), F.coalesce("node_id", "i").alias("node_id"), F.coalesce("label", "l").alias("label"),
            F.coalesce("kind", "k").alias("kind"), F.coalesce("created_at", t).alias("created_at"), F.when(F.col("i").isNotNull(), t).otherwise(F.col("last_seen")).alias("last_seen"),
            F.array_union(F.coalesce("tags", none), F.coalesce("g", none)).alias("tags"), "meta", F.coalesce("ord", F.xxhash64("i")).alias("ord"))
        ends = lambda c: known.select(F.col("label").alias(c), F.col("known").alias(f"k_{c}"))
        up = edges.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left").select(
            F.coalesce("k_src", self._id(F.col("src"))).alias("src"), F.coalesce("k_dst", self._id(F.col("dst"))).alias("dst"), "channel",
            F.col("confidence").cast("double").alias("confidence")).withColumn("ts", t)
        e = maintenance.apply_upserts(self.edges, up)
        e = e.withColumns({
            "workspace": F.coalesce("workspace", F.lit(self.workspace)), "source": F.coalesce("source", F.lit(source)),
            "provenance": F.coalesce("provenance", F.lit("automated")), "ord": F.coalesce("ord", F.xxhash64("src", "dst", "channel")),
        }).select(*EDGE)
        return replace(self, nodes=n, edges=e)

    def _literals(self, nodes: list[tuple], edges: list[tuple], as_of: str, source: str) -> Engine:
        bad = next((c for *_, c, _ in edges if not channels.is_known(c)), None)
        if bad:
            raise ValueError(f"unknown channel {bad!r}")
        n = self._spark.createDataFrame(nodes, "label string, kind string, tags array<string>")
        e = self._spark.createDataFrame(edges, "src string, dst string, channel string, confidence double")
        return self._observed(n, e.withColumn("channel", channels.canonical(F.col("channel"))), as_of, source)

    def relate(self, src: str, dst: str, channel: str, as_of: str, confidence: float = 0.8, source: str = "api") -> Engine:
        """Both ends and an edge between them; a known edge is reinforced."""
        return self._literals([(src, "entity", []), (dst, "entity", [])], [(src, dst, channel, confidence)], as_of, source)

    def alarm(self, label: str, reason: str, as_of: str, source: str = "api") -> Engine:
        """A warning about something."""
        return self._literals([(label, "entity", []), (reason, "warning", [])], [(label, reason, "alarm", 0.9)], as_of, source)

    def think(self, thought: str, as_of: str, depends_on: tuple[str, ...] = (), conclusion: bool = False) -> Engine:
        """A thought and what it rests on."""
        channel = "causal" if conclusion else "reasoning"
        return self._literals([(thought, "concept", ["thought"]), *((d, "concept", []) for d in depends_on)], [(d, thought, channel, 0.8) for d in depends_on], as_of, "think")

    def compact(self, session: str, summary: str, as_of: str, entities: tuple[str, ...] = (), decisions: tuple[str, ...] = ()) -> Engine:
        """A session's summary, what it was about and what was decided."""
        label = f"session_{session}_summary"
        nodes = [(label, "event", ["session_summary", session]), *((e, "entity", []) for e in entities), *((d, "concept", []) for d in decisions)]
        made = self._literals(nodes, [*((label, e, "trail", 0.7) for e in entities), *((label, d, "causal", 0.8) for d in decisions)], as_of, f"session:{session}")
        meta = F.when(F.col("label") == label, F.to_json(F.struct(F.lit(summary).alias("summary")))).otherwise(F.col("meta"))
        return replace(made, nodes=made.nodes.withColumn("meta", meta))

    def ingest(self, docs: DataFrame, as_of: str, doc_id: str = "doc_id", column: str = "text", source: str = "ingest") -> Engine:
        """Triplets and entities of texts."""
        n, e = text.ingest(docs, doc_id, column, source, self.workspace)
        return self._observed(n.select("label", "kind", "tags"), e.select("src", "dst", "channel", "confidence"), as_of, source)

    def ingest_files(self, path: str, as_of: str, registry: Registry | None = None) -> Engine:
        """The files of a folder: each by the plugin for its extension, if there is one, else as text.

        A plugin gives subject, object, channel and confidence of the triplets it finds in (path, text).
        """
        docs, made = texts.files(self._spark, path), self
        rest = docs
        low = F.lower(F.col("path"))
        for plugin in registry.plugins if registry else ():
            mine = reduce(lambda a, b: a | b, (low.endswith("." + e.lower().lstrip(".")) for e in plugin.extensions))
            t = plugin.ingest(rest.filter(mine))
            ends = t.select(F.explode(F.array("subject", "object")).alias("label"), F.lit("entity").alias("kind"), F.array().cast("array<string>").alias("tags"))
            made = made._observed(ends, t.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "channel", "confidence"), as_of, plugin.name)
            rest = rest.filter(~mine)
        return made.ingest(rest, as_of, "path", "text", "files")

    def add(self, content: str, as_of: str, source: str = "api", tags: tuple[str, ...] = ()) -> Engine:
        """One text; without triplets it becomes an event."""
        docs = texts.raw_text(self._spark, content)
        made = self.ingest(docs, as_of, "path", "text", source)
        found = text.extract_triplets(text.chunks(docs, "path", "text"), ["path"]).limit(1).count()
        label = content if len(content.encode()) <= 80 else content[:77] + "..."
        return made if found else made._literals([(label, "event", list(tags))], [], as_of, source)

    def reinforce(self, src: str, dst: str, as_of: str) -> Engine:
        """All edges of a pair reinforced."""
        return replace(self, edges=maintenance.reinforce(self.edges, as_of, self._pair(src, dst)))

    def correct(self, src: str, dst: str, confidence: float, reason: str, as_of: str) -> Engine:
        """A pair's confidence set, and a warning that says why."""
        e = maintenance.correct(self.edges, self._one(src), self._one(dst), confidence)
        return replace(self, edges=e)._literals([(src, "entity", []), (f"correction: {reason}", "warning", [])], [(src, f"correction: {reason}", "alarm", 0.8)], as_of, "correct")

    def validate(self, src: str, dst: str, as_of: str) -> Engine:
        """A pair's edges reinforced and marked as validated."""
        return replace(self, edges=maintenance.validate(self.edges, self._one(src), self._one(dst), as_of))

    def _one(self, label: str) -> str:
        row = self.nodes.filter(F.col("label") == label).agg(F.min("node_id").alias("node_id")).first()
        if row.node_id is None:
            raise KeyError(label)
        return row.node_id

    def forget(self, label: str) -> Engine:
        """A node and its edges removed."""
        n, e = maintenance.forget(self.nodes, self.edges, self._one(label))
        return replace(self, nodes=n, edges=e)

    def merge(self, keep: str, absorb: str) -> Engine:
        """Two nodes made one."""
        n, e = maintenance.merge_nodes(self.nodes, self.edges, self._one(keep), self._one(absorb))
        return replace(self, nodes=n, edges=e)

    def sleep(self, as_of: str) -> tuple[Engine, DataFrame]:
        """Recent events consolidated, dead edges and orphans gone; and the stats before and after."""
        made, links = maintenance.consolidate(self.nodes, as_of, self.workspace)
        n = self.nodes.unionByName(made.select("node_id", "label", "kind", "created_at", F.col("created_at").alias("last_seen"), F.lit(self.workspace).alias("workspace")), allowMissingColumns=True)
        e = maintenance.apply_upserts(self.edges, links).withColumn("workspace", F.coalesce("workspace", F.lit(self.workspace)))
        after = replace(self, nodes=n, edges=e)
        after = replace(after, **dict(zip(("nodes", "edges"), maintenance.daily_prune(after.nodes, after.edges, as_of))))
        return after, self.stats(as_of).withColumn("when", F.lit("before")).unionByName(after.stats(as_of).withColumn("when", F.lit("after")))

    def physarum(self, as_of: str) -> Engine:
        """Much-used edges reinforced."""
        return replace(self, edges=maintenance.physarum(self.edges, as_of))

    # -- reading ------------------------------------------------------------------------------

    def stats(self, as_of: str) -> DataFrame:
        """Size, dead edges, mean intensity."""
        return maintenance.stats(self.nodes, self.edges, as_of)

    def list(self, kind: str | None = None, tag: str | None = None, limit: int = 50) -> DataFrame:
        """Nodes of a kind and tag, last seen first."""
        n = self.nodes
        n = n.filter(F.col("kind") == kind.lower()) if kind else n
        n = n.filter(F.array_contains("tags", tag)) if tag else n
        return n.orderBy(F.desc("last_seen"), "label").limit(limit)

    def show(self, label: str, as_of: str) -> DataFrame:
        """A node's edges, out and in, with what they weigh."""
        i = self._one(label)
        e = effective(self.edges.filter((F.col("src") == i) | (F.col("dst") == i)), as_of)
        return e.select("src", "dst", "channel", "eff", "confidence", "uses", "source").orderBy(F.desc("eff"), "src", "dst")

    def search(self, query: str, as_of: str, limit: int = 10, preset: str = "cli", vectors: DataFrame | None = None) -> DataFrame:
        """Hybrid search."""
        return fusion.hybrid_search(self.nodes, self.edges, query, limit, preset, vectors, as_of)

    def traverse(self, label: str, as_of: str, hops: int = 3, minimum: float = 0.15, limit: int = 10, **filters) -> DataFrame:
        """The strongest nodes around the one a label resolves to."""
        start = traverse.resolve_start(self.nodes, label).select(F.col("node_id").alias("node"))
        found = traverse.traverse(self.edges, start, hops, minimum, limit, as_of=as_of, **filters)
        return found.join(self.nodes.select(F.col("node_id").alias("node"), "label"), "node").select("label", "score", "hops", "path").orderBy(F.desc("score"), "hops", "label")

    def explain(self, src: str, dst: str, as_of: str, k: int = 3, hops: int = 5) -> DataFrame:
        """The strongest paths between two labels."""
        return traverse.explain_paths(self.edges, self._one(src), self._one(dst), hops, 0.05, k, as_of=as_of)

    def cypher(self, query: str, as_of: str, strict: bool = False) -> DataFrame:
        """The rows of a Cypher statement that returns; one that writes is for ``update``."""
        if not cypher.parse(query).returns:
            raise cypher.CypherError("a statement that writes is for update()")
        return cypher.run(query, self.nodes, self.edges, as_of, strict)

    def update(self, query: str, as_of: str, strict: bool = False) -> Engine:
        """This graph after a CREATE, DELETE or SET."""
        n, e = cypher.update(query, self.nodes, self.edges, as_of, strict)
        return replace(self, nodes=n.select(*NODE), edges=e.select(*EDGE))

    def between(self, src: str, dst: str) -> DataFrame:
        """(channel, confidence, uses) of the edges between two labels."""
        return maintenance.between(self.nodes, self.edges, src, dst)

    def labels(self) -> DataFrame:
        """All labels in order of insertion."""
        return self.nodes.orderBy("ord", "node_id").select("label")

    def pagerank(self, labels: list[str], as_of: str, **options) -> DataFrame:
        """Personalized PageRank from labels."""
        seeds = self.nodes.filter(F.col("label").isin(*labels)).select(F.col("node_id").alias("node"))
        ranked = rank.pagerank(self.edges, seeds, as_of=as_of, **options)
        return ranked.join(self.nodes.select(F.col("node_id").alias("node"), "label"), "node").select("label", "rank").orderBy(F.desc("rank"), "label")

    def communities(self, as_of: str, min_size: int = 3) -> DataFrame:
        """(label, community) of communities of ``min_size`` and more."""
        c = community.local_moving(self.edges, as_of=as_of)
        big = c.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
        return c.join(big, "community").join(self.nodes.select(F.col("node_id").alias("node"), "label"), "node").select("label", "community")

    def view(self, limit: int = 200, min_degree: int = 0, tag: str | None = None, center: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Nodes (with degree) and edges for drawing: the busiest, or those around a center."""
        n = self.nodes.join(traverse.degrees(self.edges).withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        if center:
            near = traverse.khop(self.edges, self.nodes.filter(F.col("label") == center).select(F.col("node_id").alias("node")), depth)
            n = n.join(near.select(F.col("node").alias("node_id")), "node_id", "left_semi")
        if tag:
            n = n.filter(F.exists("tags", lambda t: F.lower(t).contains(tag.lower())))
        n = n.filter(F.col("degree") >= min_degree).orderBy(F.desc("degree"), "label").limit(limit)
        ids = n.select("node_id")
        e = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return n, e

    def scored_context(self, query: str, as_of: str, limit: int = 20, vectors: DataFrame | None = None) -> str:
        """A block of the facts a search over four paths finds, with their scores, and the warnings."""
        hits = fusion.hybrid_search(self.nodes, self.edges, query, limit, "cli", vectors, as_of, minimum=0.1).orderBy(F.desc(F.round("score", 9)), "label").collect()
        warnings = [r.label for r in self.nodes.filter("kind = 'warning'").orderBy("label").limit(100).collect()]
        return "\n".join(["## Facts", *(f"- {r.label} ({r.score:.4f}; {', '.join(r.sources)})" for r in hits), "## Alarms", *(f"- {x}" for x in warnings)])

    def context(self, query: str, as_of: str, max_tokens: int = 2000) -> str:
        """A block of facts, relations and warnings about a query, cut at a line's end to four characters a token."""
        words = [w for w in dict.fromkeys(query.replace("'", " ").split()) if len(w) > 3 and w.lower() not in CONTEXT_STOP]
        lists = [fusion.as_list(fusion.hybrid_search(self.nodes, self.edges, query, 15, "rpc", as_of=as_of, minimum=0.1), 0, "search")]
        lists += [fusion.as_list(fusion.fuzzy_search(self.nodes, w, 15).withColumn("score", F.col("score") * 0.8), i + 1, "word") for i, w in enumerate(words)]
        facts = [r.label for r in fusion.rrf(reduce(DataFrame.unionByName, lists)).orderBy(F.desc(F.round("score", 9)), "label").limit(15).collect()]
        named = lambda c: self.nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"), F.col("kind").alias(f"{c}_kind"))
        ids = self.nodes.filter(F.col("label").isin(*facts) if facts else F.lit(False)).select("node_id")
        live = effective(self.edges, as_of).filter("eff >= 0.1")
        near = live.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").unionByName(live.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")).dropDuplicates(["src", "dst", "channel"])
        relations = near.join(named("src"), "src").join(named("dst"), "dst").orderBy(F.desc("eff"), "src_label", "dst_label").limit(30).collect()
        warnings = [r.label for r in self.nodes.filter("kind = 'warning'").orderBy("label").limit(100).collect()]
        lines = ["## Facts", *(f"- {x}" for x in facts), "## Relations", *(f"- {r.src_label} -{r.channel}-> {r.dst_label}" for r in relations), "## Alarms", *(f"- {x}" for x in warnings)]
        block = "\n".join(lines)
        return block if len(block) <= 4 * max_tokens else block[: block.rfind("\n", 0, 4 * max_tokens)]

    def session_restore(self, query: str, as_of: str, limit: int = 5, vectors: DataFrame | None = None) -> DataFrame:
        """(label, score, entities, decisions) of the sessions a query is about: fuzzy hits and, with vectors, similar labels, fused by reciprocal rank."""
        past = self.nodes.filter(F.array_contains("tags", "session_summary"))
        hits = past.select("label", F.greatest(exprs.fuzzy_score(F.col("label"), query), exprs.fuzzy_score(F.coalesce("meta", F.lit("")), query)).alias("score")).filter("score > 0")
        lists = [fusion.as_list(hits.orderBy(F.desc("score"), "label").limit(4 * limit), 0, "fuzzy")]
        if vectors is not None:
            alike = hdc.search_labels(vectors, query, 4 * limit)
            named = past.select("label", F.lower("label").alias("low")).join(alike.withColumnRenamed("label", "low"), "low").select("label", "score")
            lists.append(fusion.as_list(named, 1, "hdc"))
        fused = fusion.rrf(reduce(DataFrame.unionByName, lists)).select("label", "score")
        top = fused.join(past.select("node_id", "label"), "label").orderBy(F.desc(F.round("score", 9)), "label").limit(limit)
        e = self.edges.join(self.nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("to")), "dst")
        got = top.join(e.select("src", "channel", "to"), F.col("node_id") == F.col("src"), "left").groupBy("label", "score")
        return got.agg(
            F.array_sort(F.collect_set(F.when(F.col("channel") == "trail", F.col("to")))).alias("entities"),
            F.array_sort(F.collect_set(F.when(F.col("channel") == "causal", F.col("to")))).alias("decisions")).orderBy(F.desc("score"), "label")
