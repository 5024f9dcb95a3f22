"""Queries of the general problems, with their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from fadegraph.operators.changefeed import build, halves, replay
from fadegraph.sources import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that exist at the end of the log, with the seq of their last entry; the log is applied in two batches by arrival."""
    return replay(table(spark, sf_dir, "mutations"), arrived="arrived_at").select("item", "seq")


def _rounded(states: DataFrame) -> DataFrame:
    return states.select("item", "seq", F.round("confidence", 6).alias("confidence"), F.round("strength", 6).alias("strength"), "reinforced")


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing items with the confidence of their last upsert and their strength after the reinforcements since."""
    return _rounded(build([table(spark, sf_dir, "mutations")]).strengths())


def p2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a base and two feeds: the later entries first, the earlier ones again with them, then all that is left."""
    early, late = halves(table(spark, sf_dir, "mutations"), "arrived_at")
    odd = F.coalesce(F.col("seq") % 2 == 1, F.lit(False))
    return _rounded(build([late.filter(odd), early, late]).strengths())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_state": p2_state, "p2_incremental": p2_incremental}

_STATE = """
WITH n AS (SELECT *, lower(regexp_replace(op, '[^A-Za-z]', '', 'g')) AS o FROM mutations WHERE seq IS NOT NULL),
i AS (SELECT *, CASE WHEN o LIKE 'edge%' THEN edge_id ELSE src END AS item FROM n WHERE o IN ('nodeupsert','nodearchive','edgeupsert','edgereinforce','edgeprune')),
g AS (SELECT item, max(seq) AS seq, max(seq) FILTER (WHERE o LIKE '%upsert') AS since, max(seq) FILTER (WHERE o IN ('nodearchive','edgeprune')) AS gone FROM i WHERE trim(item) <> '' GROUP BY item),
u AS (
  SELECT item, confidence, row_number() OVER (PARTITION BY item ORDER BY (workspace IS NOT NULL)::INT + (src IS NOT NULL)::INT + (dst IS NOT NULL)::INT + (channel IS NOT NULL)::INT
    + (kind IS NOT NULL)::INT + (tags IS NOT NULL)::INT + (confidence IS NOT NULL)::INT + (source IS NOT NULL)::INT + (label IS NOT NULL)::INT DESC,
    workspace DESC NULLS LAST, src DESC NULLS LAST, dst DESC NULLS LAST, channel DESC NULLS LAST, kind DESC NULLS LAST, tags DESC NULLS LAST, confidence DESC NULLS LAST) AS rn
  FROM i JOIN g USING (item) WHERE o LIKE '%upsert' AND i.seq = since
),
r AS (SELECT item, i.seq, max(delta) AS delta FROM i JOIN g USING (item) WHERE o = 'edgereinforce' AND delta > 0 AND NOT isnan(delta) AND i.seq > since GROUP BY 1, 2),
k AS (SELECT item, count(*) AS k, sum(delta) AS gain FROM r GROUP BY item)
SELECT g.item, g.seq, round(confidence, 6) AS confidence,
  round(least(1.0, CASE WHEN confidence >= 0 AND confidence <= 1 THEN confidence ELSE 0.8 END + coalesce(gain, 0)), 6)::DOUBLE AS strength, coalesce(k, 0) AS reinforced
FROM g JOIN u ON u.item = g.item AND rn = 1 LEFT JOIN k ON k.item = g.item WHERE gone IS NULL OR since > gone
"""

SQL: dict[str, str] = {
    "p2_state": _STATE, "p2_incremental": _STATE,
    "p2_found": """
WITH n AS (
  SELECT lower(regexp_replace(op, '[^A-Za-z]', '', 'g')) AS o, edge_id, src, seq FROM mutations WHERE seq IS NOT NULL
), i AS (
  SELECT CASE WHEN o LIKE 'edge%' THEN edge_id ELSE src END AS item, seq, o FROM n
  WHERE o IN ('nodeupsert','nodearchive','edgeupsert','edgereinforce','edgeprune')
)
SELECT item, max(seq) AS seq FROM i WHERE trim(item) <> ''
GROUP BY item
HAVING coalesce(arg_max(CASE WHEN o LIKE '%upsert' THEN 1 ELSE 0 END, seq) FILTER (WHERE o <> 'edgereinforce'), 0) = 1
""",
}
