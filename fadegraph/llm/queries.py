"""Queries of the training-data problems, with their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.llm import cooccurrence, distinctive, format_dups, mixture, names, neighbours, residue, survivorship, tokens
from fadegraph.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags on six or more nodes together, at five times chance or more."""
    return cooccurrence.pairs(table(spark, sf_dir, "nodes"), "node_id", "tags", 6, 5).select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b")
    )


@query
def p1_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, lift and PMI of all pairs of tags on two or more nodes together."""
    return cooccurrence.pairs(table(spark, sf_dir, "nodes"), "node_id", "tags", 2).select(
        "item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi")
    )


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of a map with a cosine of 0.9 or more, one among the other's five most similar."""
    near = neighbours.most_similar(table(spark, sf_dir, "hdc_vectors"), "vec_id", "vspace", "vec", "n_dim", 5, 0.9)
    return neighbours.pairs(near)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row each field of each duplicate edge survives from."""
    return survivorship.winners(table(spark, sf_dir, "edges"))


@query
def p4_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each field with the largest sum of trust times recency."""
    return survivorship.votes(table(spark, sf_dir, "edges")).withColumn("weight", F.round("weight", 6))


@query
def p4_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per duplicate group."""
    return survivorship.golden(table(spark, sf_dir, "edges"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "llm_triplets")
    every = table(spark, sf_dir, "nodes").select(F.col("label").alias("name")).unionByName(
        t.select(F.explode(F.array("subject", "object")).alias("name"))
    )
    return names.entities(every, table(spark, sf_dir, "name_forms"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of the same person or organisation."""
    return names.pairs(_named(spark, sf_dir))


@query
def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a name with the canonical form it belongs to."""
    return _named(spark, sf_dir)


def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "triplets")
    l = table(spark, sf_dir, "llm_triplets")  # noqa: E741
    r = table(spark, sf_dir, "llm_raw")
    return (
        format_dups.canonical(t, "triplets", "triplet_id", ["workspace", "subject", "object", "channel"])
        .unionByName(format_dups.canonical(l, "llm_triplets", "triplet_id", ["workspace", "subject", "relation", "object"]))
        .unionByName(format_dups.canonical_json(r, "llm_raw", "raw_id", "payload"))
    )


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ only in how they are written."""
    return format_dups.copies(_formatted(spark, sf_dir))


@query
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return format_dups.counted(_formatted(spark, sf_dir))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term of highest weight of each record: occurrences times (ln(R / (d + 1)) + 1)."""
    return distinctive.top_term(distinctive.counted(table(spark, sf_dir, "hdc_records"))).select("rec_id", "term")


@query
def p7_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score of the log-odds ratio of each term of each record."""
    return distinctive.scores(table(spark, sf_dir, "hdc_records")).select("rec_id", "term", F.round("z", 6).alias("weight"))


@query
def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many records the leader by z-score is the term of p7_found."""
    return distinctive.agreement(distinctive.scores(table(spark, sf_dir, "hdc_records")))


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return tokens.encode(table(spark, sf_dir, "documents"))


@query
def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded from its ids, compared with its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id", "full").select("doc_id", F.coalesce(F.col("text") == F.col("decoded"), F.lit(False)).alias("same"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mixture.mixture(counts, table(spark, sf_dir, "mix_targets"))


@query
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixed(spark, sf_dir)


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens each source reached."""
    return mixture.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or script notices."""
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


@query
def p10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring messages with the number of their occurrences and sources."""
    return residue.messages(table(spark, sf_dir, "documents"))


@query
def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain when residue is left out."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(residue.residue(docs).select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


_TAGS = r"""
WITH b AS (
  SELECT DISTINCT node_id, regexp_replace(lower(t), '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g') AS tag
  FROM (SELECT node_id, unnest(tags) AS t FROM nodes WHERE node_id IS NOT NULL)
), s AS (SELECT * FROM b WHERE tag <> ''),
m AS (SELECT tag, count(*) AS c FROM s GROUP BY tag),
n AS (SELECT count(DISTINCT node_id) AS n FROM nodes),
p AS (
  SELECT x.tag AS a, y.tag AS b, count(*) AS c FROM s x JOIN s y ON x.node_id = y.node_id AND x.tag < y.tag GROUP BY 1, 2
)
"""
_EDGES = r"""
WITH r AS (
  SELECT ord, confidence, provenance, last_touch, source,
    lower(regexp_replace(src, '[_\s]+', '', 'g')) AS a, lower(regexp_replace(dst, '[_\s]+', '', 'g')) AS b,
    lower(regexp_replace(channel, '[_\s]+', '', 'g')) AS c,
    coalesce(list_position(['human','aivalidated','aiinferred','automated'], lower(regexp_replace(provenance, '[^A-Za-z]', '', 'g'))), 5) AS tr,
    CASE WHEN year(last_touch) BETWEEN 2023 AND 2025 THEN last_touch END AS lt
  FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND channel IS NOT NULL
), g AS (SELECT a, b, c, min(ord) AS group_ord FROM r GROUP BY a, b, c HAVING count(*) > 1),
u AS (
  SELECT group_ord, 'confidence' AS attr, r.*, confidence >= 0 AND confidence <= 1 AS ok FROM r JOIN g USING (a, b, c)
  UNION ALL SELECT group_ord, 'provenance', r.*, tr < 5 FROM r JOIN g USING (a, b, c)
  UNION ALL SELECT group_ord, 'last_touch', r.*, lt IS NOT NULL FROM r JOIN g USING (a, b, c)
  UNION ALL SELECT group_ord, 'source', r.*, regexp_matches(source, '^\s*[^/\s]+/[^/\s]*[0-9]\s*$') FROM r JOIN g USING (a, b, c)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY group_ord, attr
    ORDER BY CASE WHEN attr = 'last_touch' THEN 0 ELSE tr END, lt DESC NULLS LAST, ord) AS rn
  FROM u WHERE ok
)
"""
_TERMS = r"""
WITH d AS (SELECT rec_id, min((trained_at, tokens)) AS t FROM hdc_records WHERE rec_id IS NOT NULL GROUP BY rec_id),
e AS (SELECT rec_id, regexp_replace(lower(k), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS term FROM (SELECT rec_id, unnest(t[2]) AS k FROM d)),
tf AS (SELECT rec_id, term, count(*) AS tf FROM e WHERE term <> '' GROUP BY 1, 2),
st AS (SELECT term, count(*) AS d, sum(tf) AS c FROM tf GROUP BY term)
"""
_WRITTEN = r"""
WITH k AS (
  SELECT 'triplets' AS tbl, triplet_id AS id, concat_ws(chr(1), {t}) AS k FROM triplets
  UNION ALL SELECT 'llm_triplets', triplet_id, concat_ws(chr(1), {l}) FROM llm_triplets
  UNION ALL SELECT 'llm_raw', raw_id, concat_ws(chr(1), {r}, coalesce(CAST(TRY_CAST(m['confidence'] AS DOUBLE) AS VARCHAR), ''))
    FROM (SELECT raw_id, map_from_entries(list_transform(json_keys(payload), lambda x: (lower(x), json_extract_string(payload, '$."' || x || '"')))) AS m
          FROM llm_raw WHERE json_valid(payload))
), g AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, k) AS keep, count(*) OVER (PARTITION BY tbl, k) AS n FROM k)
""".format(
    **{
        n: ", ".join(rf"lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'))" for c in cols)
        for n, cols in {
            "t": ["workspace", "subject", "object", "channel"], "l": ["workspace", "subject", "relation", "object"],
            "r": ["m['subject']", "m['relation']", "m['object']"],
        }.items()
    }
)

SQL: dict[str, str] = {
    "p1_found": _TAGS + """SELECT a AS tag_a, p.b AS tag_b FROM p JOIN m x ON x.tag = a JOIN m y ON y.tag = p.b, n
WHERE p.c >= 6 AND p.c::HUGEINT * n.n >= 5 * x.c::HUGEINT * y.c""",
    "p1_lift": _TAGS + """SELECT a AS item_a, p.b AS item_b, x.c AS n_a, y.c AS n_b, p.c AS n_ab,
  round(p.c * n.n / (x.c * y.c::DOUBLE), 6) AS lift, round(log2(p.c * n.n / (x.c * y.c::DOUBLE)), 6) AS pmi
FROM p JOIN m x ON x.tag = a JOIN m y ON y.tag = p.b, n WHERE p.c >= 2""",
    "p4_found": _EDGES + "SELECT group_ord, attr, ord FROM w WHERE rn = 1",
    "p4_golden": _EDGES + """SELECT group_ord,
  CAST(max(confidence) FILTER (WHERE attr = 'confidence') AS VARCHAR) AS confidence, max(provenance) FILTER (WHERE attr = 'provenance') AS provenance,
  CAST(max(last_touch) FILTER (WHERE attr = 'last_touch') AS VARCHAR) AS last_touch, max(source) FILTER (WHERE attr = 'source') AS source
FROM w WHERE rn = 1 GROUP BY group_ord""",
    "p4_votes": _EDGES + """, l AS (
  SELECT group_ord, attr, CASE attr WHEN 'confidence' THEN CAST(floor(confidence * 1000) / 1000 AS VARCHAR) WHEN 'provenance' THEN lower(regexp_replace(provenance, '[^A-Za-z]', '', 'g'))
    WHEN 'last_touch' THEN CAST(last_touch AS VARCHAR) ELSE lower(trim(source)) END AS value,
    [1.0, 0.7, 0.4, 0.2, 0.05][tr] * pow(2.0, -least(coalesce(date_diff('microsecond', lt, TIMESTAMP '2026-01-01') / 86400000000.0, 3650.0), 3650.0) / 90.0) AS w
  FROM u WHERE ok
), s AS (SELECT group_ord, attr, value, round(sum(w), 9) AS w FROM l GROUP BY 1, 2, 3)
SELECT group_ord, attr, value, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY group_ord, attr ORDER BY w DESC, value) AS rn FROM s) WHERE rn = 1""",
    "p6_found": _WRITTEN + "SELECT tbl, keep AS keep_id, id AS copy_id FROM g WHERE id <> keep",
    "p6_counts": _WRITTEN + "SELECT tbl, id AS keep_id, n AS copies FROM g WHERE id = keep",
    "p7_found": _TERMS + """, w AS (
  SELECT rec_id, term, tf * (ln((SELECT count(*) FROM d) / (st.d + 1)) + 1) AS w FROM tf JOIN st USING (term)
), r AS (SELECT *, row_number() OVER o AS rn, lead(w) OVER o AS nx FROM w WINDOW o AS (PARTITION BY rec_id ORDER BY w DESC, term))
SELECT rec_id, term FROM r WHERE rn = 1 AND (nx IS NULL OR w - nx > 1e-9)""",
    "p8_round_trip": "SELECT doc_id, TRUE AS same FROM documents",
    "p7_log_odds": _TERMS + """, s AS (SELECT rec_id, sum(tf) AS sz FROM tf GROUP BY rec_id),
n AS (SELECT sum(c) AS n FROM st),
x AS (SELECT rec_id, term, sz, n, tf + 0.1 * c AS i, c - tf + 0.1 * c AS j FROM tf JOIN st USING (term) JOIN s USING (rec_id), n)
SELECT rec_id, term, round((ln(i / greatest(sz + 0.1 * n - i, 1e-9)) - ln(j / greatest(n - sz + 0.1 * n - j, 1e-9))) / sqrt(1 / i + 1 / j), 6) AS weight FROM x""",
}
