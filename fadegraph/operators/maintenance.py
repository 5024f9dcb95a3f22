"""Changes of the graph's state as DataFrame to DataFrame operators.

Each takes nodes and edges (or one of them) and an explicit ``as_of``; nothing
reads the clock.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadegraph.functions import channels, exprs
from fadegraph.operators.graph import effective


def stats(nodes: DataFrame, edges: DataFrame, as_of: str, threshold: float = channels.PRUNE_THRESHOLD) -> DataFrame:
    """One row: nodes, edges, dead_edges, avg_intensity (0 without edges)."""
    e = effective(edges, as_of).agg(
        F.count("*").alias("edges"),
        F.coalesce(F.sum((channels.prunable(F.col("channel")) & (F.col("eff") < threshold)).cast("bigint")), F.lit(0)).alias("dead_edges"),
        F.coalesce(F.avg("eff"), F.lit(0.0)).alias("avg_intensity"),
    )
    return e.select(nodes.agg(F.count("*")).scalar().alias("nodes"), "edges", "dead_edges", "avg_intensity")


def prune(edges: DataFrame, as_of: str, threshold: float = channels.PRUNE_THRESHOLD) -> DataFrame:
    """The edges that are not dead."""
    return edges.filter(~exprs.dead(F.col("intensity"), F.col("channel"), F.col("last_touch"), exprs.ts(as_of), threshold))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_anti")


def archive_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that are at some edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def daily_prune(nodes: DataFrame, edges: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after dead edges and then orphans are gone."""
    left = prune(edges, as_of)
    return archive_orphans(nodes, left), left


def reinforce(edges: DataFrame, as_of: str, where=None) -> DataFrame:
    """Edges with those that meet ``where`` (all by default) reinforced at ``as_of``."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    new = exprs.reinforced(F.col("intensity"), F.col("channel"), F.col("last_touch"), exprs.ts(as_of))
    return edges.drop("eff").withColumns({
        "intensity": F.when(hit, new).otherwise(F.col("intensity")),
        "last_touch": F.when(hit, exprs.ts(as_of)).otherwise(F.col("last_touch")),
        "uses": F.col("uses") + hit.cast("bigint"),
    })


def _between(src: str, dst: str):
    return (F.col("src") == src) & (F.col("dst") == dst)


def correct(edges: DataFrame, src: str, dst: str, confidence: float) -> DataFrame:
    """Confidence and intensity of all edges of a pair set, and the edges marked as validated; last_touch stays."""
    c, hit = min(1.0, max(0.0, confidence)), _between(src, dst)
    return edges.drop("eff").withColumns({
        "confidence": F.when(hit, c).otherwise(F.col("confidence")), "intensity": F.when(hit, c).otherwise(F.col("intensity")),
        "provenance": F.when(hit, "ai_validated").otherwise(F.col("provenance")),
    })


def validate(edges: DataFrame, src: str, dst: str, as_of: str) -> DataFrame:
    """All edges of a pair reinforced and marked as validated."""
    return set_provenance(reinforce(edges, as_of, _between(src, dst)), src, dst, "ai_validated")


def set_provenance(edges: DataFrame, src: str, dst: str, provenance: str) -> DataFrame:
    """Provenance of all edges of a pair."""
    return edges.withColumn("provenance", F.when(_between(src, dst), provenance).otherwise(F.col("provenance")))


def merge_nodes(nodes: DataFrame, edges: DataFrame, keep: str, absorb: str) -> tuple[DataFrame, DataFrame]:
    """``absorb`` becomes ``keep``: its edges are re-pointed, edges between the two dropped, tags united."""
    point = lambda c: F.when(F.col(c) == absorb, F.lit(keep)).otherwise(F.col(c))
    own = (F.col("src").isin(keep, absorb)) & (F.col("dst").isin(keep, absorb))
    moved = edges.filter(~own).withColumns({"src": point("src"), "dst": point("dst")})
    more = nodes.filter(F.col("node_id") == absorb).select(F.coalesce("tags", F.array().cast("array<string>")).alias("more")).limit(1).scalar()
    tags = F.when(F.col("node_id") == keep, F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))).otherwise(F.col("tags"))
    return nodes.filter(F.col("node_id") != absorb).withColumn("tags", tags), moved


def forget(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node and its edges removed."""
    return nodes.filter(F.col("node_id") != node), edges.filter((F.col("src") != node) & (F.col("dst") != node))


def physarum(edges: DataFrame, as_of: str, factor: float = 1.5) -> DataFrame:
    """Edges used more than ``factor`` times the mean are reinforced."""
    return reinforce(edges, as_of, F.col("uses") > factor * edges.agg(F.avg("uses")).scalar())


def recent_events(nodes: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """Event nodes made in the last ``hours``."""
    return nodes.filter((F.col("kind") == "event") & (F.col("created_at") >= exprs.ts(as_of) - F.expr(f"make_dt_interval(0, {hours})")))


def consolidate(nodes: DataFrame, as_of: str, workspace: str, hours: int = 6, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """New concept and its edges, if ``least`` events are recent; both empty otherwise."""
    recent = recent_events(nodes, as_of, hours)
    label = F.concat(F.lit("consolidated_"), F.date_format(exprs.ts(as_of), "yyyyMMdd_HHmmss"))
    concept = exprs.node_id(F.lit(workspace), label)
    enough = recent.agg(F.count("*")).scalar() >= least
    made = recent.agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(
        concept.alias("node_id"), label.alias("label"), F.lit("concept").alias("kind"), exprs.ts(as_of).alias("created_at")
    )
    links = recent.filter(enough).select(
        F.col("node_id").alias("src"), concept.alias("dst"), F.lit("derives_de").alias("channel"), F.lit(0.7).alias("confidence"), exprs.ts(as_of).alias("ts")
    )
    return made, links


def upserts(spark, rows: list[tuple], as_of: str) -> DataFrame:
    """Observations (src, dst, channel, confidence, ts) from literals, for relate, alarm, think and the like."""
    bad = [r for r in rows if not channels.is_known(r[2])]
    if bad:
        raise ValueError(f"unknown channel {bad[0][2]!r}")
    df = spark.createDataFrame(rows, "src string, dst string, channel string, confidence double")
    return df.withColumn("channel", channels.canonical(F.col("channel"))).withColumn("ts", exprs.ts(as_of))


def apply_upserts(edges: DataFrame, upserted: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges after the observations: a known edge is reinforced (confidence stays, a null label is filled), another is new.

    Repeated observations of one pair and channel at one time count once each, in order.  With ``nodes`` an observation of which an
    end is missing there is refused.
    """
    keys = ["src", "dst", "channel"]
    if nodes is not None:
        for end in ("src", "dst"):
            upserted = upserted.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    extra = {c: F.max(c).alias(f"_{c}") if c in upserted.columns else F.lit(None).cast("string").alias(f"_{c}") for c in ("label", "source")}
    new = upserted.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("ts"), F.first("confidence").alias("c"), *(e for c, e in extra.items() if c in upserted.columns))
    new = new.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", "ts", "c", *(F.col(f"_{c}") if c in upserted.columns else e for c, e in extra.items()))
    edges = edges.drop("eff")
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    both = edges.join(new, on, "full")
    known, hit = F.col("src").isNotNull(), F.col("n").isNotNull()
    again = F.col("n") - F.when(known, 0).otherwise(1)
    base = F.when(known, exprs.decayed(F.col("intensity"), F.col("channel"), F.col("last_touch"), F.col("ts"))).otherwise(exprs.clamped(F.col("c")))
    gain = channels.delta(F.coalesce("channel", "_channel"))
    return both.select(
        *(F.coalesce(k, f"_{k}").alias(k) for k in keys),
        F.when(hit, F.least(F.lit(1.0), base + gain * again)).otherwise(F.col("intensity")).alias("intensity"),
        F.coalesce("confidence", exprs.clamped(F.col("c"))).alias("confidence"),
        F.when(hit, F.col("ts")).otherwise(F.col("last_touch")).alias("last_touch"),
        (F.coalesce("uses", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("uses"),
        *(F.coalesce(c, f"_{c}").alias(c) if c == "label" or c == "source" else F.col(c)
          for c in edges.columns if c not in (*keys, "intensity", "confidence", "last_touch", "uses")),
    )


def set_properties(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes after changes (node_id, key, value): ``tags`` and ``tag`` add to the tags, any other key is set in meta; of several values of a key the largest holds."""
    one = changes.filter("key IS NOT NULL").groupBy("node_id", "key").agg(F.max("value").alias("value")).groupBy("node_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("key").isin("tag", "tags"), F.col("value")))).alias("_tags"),
        F.map_from_entries(F.collect_list(F.when(~F.col("key").isin("tag", "tags"), F.struct("key", "value")))).alias("_set"))
    none = F.array().cast("array<string>")
    held = F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(held, lambda k, v: ~F.map_contains_key("_set", k))
    merged = F.map_filter(F.map_concat(kept, F.col("_set")), lambda k, v: v.isNotNull())
    return nodes.join(one, "node_id", "left").withColumns({
        "tags": F.when(F.size("_tags") > 0, F.array_union(F.coalesce("tags", none), F.col("_tags"))).otherwise(F.col("tags")),
        "meta": F.when(F.size("_set") > 0, F.to_json(merged)).otherwise(F.col("meta")),
    }).select(*nodes.columns)


def set_touch(edges: DataFrame, source: str, when: str) -> DataFrame:
    """Edges of one source with their last touch set."""
    return edges.drop("eff").withColumn("last_touch", F.when(F.col("source") == source, exprs.ts(when)).otherwise(F.col("last_touch")))


def between(nodes: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(channel, confidence, uses) of the edges between two labels, whatever the channel."""
    end = lambda c, label: nodes.filter(F.col("label") == label).select(F.col("node_id").alias(c))
    return edges.join(end("src", src), "src", "left_semi").join(end("dst", dst), "dst", "left_semi").select("channel", "confidence", "uses")
