"""SQL of the canonical graph, to head the SQL of queries over it."""

AS_OF = "TIMESTAMP '2025-07-01'"


def as_id(c: str) -> str:
    """SQL of ``operators.graph.as_id``."""
    return rf"lower(regexp_replace({c}, '[_\s]+', '', 'g'))"


_BARE = as_id("channel")
CHANNEL = f"CASE {_BARE} WHEN 'derivesde' THEN 'derives_de' WHEN 'semanticsim' THEN 'semantic_sim' ELSE {_BARE} END"
TAU = (
    "CASE channel WHEN 'derives_de' THEN 0.0 WHEN 'causal' THEN 0.0001 WHEN 'trail' THEN 0.001 WHEN 'alarm' THEN 0.005 "
    "WHEN 'semantic_sim' THEN 0.02 WHEN 'episodic' THEN 0.05 WHEN 'reasoning' THEN 0.08 ELSE 0.01 END::DOUBLE"
)
DELTA = (
    "CASE channel WHEN 'derives_de' THEN 0.4 WHEN 'causal' THEN 0.5 WHEN 'trail' THEN 0.3 WHEN 'alarm' THEN 0.35 "
    "WHEN 'semantic_sim' THEN 0.2 WHEN 'episodic' THEN 0.1 WHEN 'reasoning' THEN 0.15 ELSE 0.2 END::DOUBLE"
)
EFF = f"intensity * exp(-({TAU}) * greatest(0, date_sub('second', last_touch, {AS_OF})) / 3600.0)"

EDGES = f"""e0 AS (
  SELECT workspace, {as_id('src')} AS src, {as_id('dst')} AS dst, {CHANNEL} AS channel,
    greatest(0.0, least(1.0, intensity)) AS intensity, CASE WHEN confidence >= 0 AND confidence <= 1 THEN confidence ELSE 0.8 END AS confidence,
    coalesce(last_touch, TIMESTAMP '2023-01-01') AS last_touch, greatest(uses, 1) AS uses, source, label,
    regexp_replace(lower(regexp_replace(provenance, '[_\\s]', '', 'g')), '^ai', 'ai_') AS provenance, ord
  FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND channel IS NOT NULL AND intensity IS NOT NULL
), kg_edges AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, channel ORDER BY last_touch DESC, ord) AS rn FROM e0) WHERE rn = 1
), kg_eff AS (SELECT *, {EFF} AS eff FROM kg_edges)"""
NODES = """kg_nodes AS (
  SELECT node_id, arg_min(workspace, ord) AS workspace, arg_min(label, ord) AS label,
    arg_min(lower(kind), ord) FILTER (WHERE kind IS NOT NULL) AS kind, min(created_at) AS created_at,
    max(greatest(created_at, last_seen)) AS last_seen, min(ord) AS ord
  FROM nodes WHERE node_id IS NOT NULL GROUP BY node_id
)"""
GRAPH = f"WITH RECURSIVE {EDGES}, {NODES}"
