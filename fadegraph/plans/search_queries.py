"""Queries of search, fusion, vectors and metrics."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fadegraph.functions import exprs
from fadegraph.operators import fusion, hdc, metrics, rank
from fadegraph.operators.graph import AS_OF, kg_edges, kg_nodes
from fadegraph.plans.base_sql import AS_OF as T
from fadegraph.plans.base_sql import GRAPH, NODES
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


_PLAIN = f"translate(lower(label), '{exprs.ACCENTED}', '{exprs.PLAIN}')"


def _fuzzy(q: str) -> str:
    b = q.translate(str.maketrans(exprs.ACCENTED, exprs.PLAIN))
    return (
        f"CASE WHEN lower(label) = '{q}' THEN 1.0 WHEN {_PLAIN} = '{b}' THEN 0.95 WHEN starts_with(lower(label), '{q}') THEN 0.9 "
        f"WHEN starts_with({_PLAIN}, '{b}') THEN 0.85 WHEN contains(lower(label), '{q}') THEN 0.7 WHEN contains({_PLAIN}, '{b}') THEN 0.65 ELSE 0 END::DOUBLE"
    )


def _top(q: str, n: int) -> str:
    return f"SELECT label, score FROM (SELECT label, {_fuzzy(q)} AS score FROM kg_nodes) WHERE score > 0 ORDER BY score DESC, label LIMIT {n}"


@query(f"WITH {NODES} {_top('archive', 50)}")
def fuzzy_label(spark: SparkSession, d: str) -> DataFrame:
    """Labels that answer a word."""
    return fusion.fuzzy_search(kg_nodes(spark, d), "archive", 50)


@query(f"SELECT doc_id, translate(lower(text), '{exprs.ACCENTED}', '{exprs.PLAIN}') AS folded FROM documents WHERE text IS NOT NULL")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    """Texts without accents."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", exprs.fold_accents(F.col("text")).alias("folded"))


def _two(spark: SparkSession, d: str) -> DataFrame:
    n = kg_nodes(spark, d)
    return fusion.as_list(fusion.fuzzy_search(n, "archive", 40), 0, "fuzzy").unionByName(fusion.as_list(fusion.fuzzy_search(n, "relay", 40), 1, "other")).unionByName(
        fusion.as_list(fusion.fuzzy_search(n, "ar", 40), 2, "third"))


_THREE = f"""WITH {NODES}, x0 AS ({_top('archive', 40)}), x1 AS ({_top('relay', 40)}),
x2 AS (SELECT label, score FROM (SELECT label, CASE WHEN lower(label) = 'ar' THEN 1.0 WHEN starts_with(lower(label), 'ar') THEN 0.9 WHEN contains(lower(label), 'ar') THEN 0.7 ELSE 0 END::DOUBLE AS score
  FROM kg_nodes) WHERE score > 0 ORDER BY score DESC, label LIMIT 40),
l AS (SELECT 0 AS list_no, 'fuzzy' AS source, * FROM x0 UNION ALL SELECT 1, 'other', * FROM x1 UNION ALL SELECT 2, 'third', * FROM x2),
g AS (SELECT *, 1.0 / (60 + row_number() OVER (PARTITION BY list_no ORDER BY score DESC, label)) AS gain FROM l),
f AS (SELECT label, sum(gain::DOUBLE) AS score, string_agg(source, ',' ORDER BY list_no) AS sources FROM g GROUP BY label)
"""


@query(_THREE + "SELECT label, round(score, 9) AS score FROM f")
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists fused by reciprocal rank."""
    return fusion.rrf(_two(spark, d)).select("label", _r("score", 9))


@query(_THREE + "SELECT label, round(score, 9) AS score, sources FROM f")
def rrf_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same with the lists each label came from."""
    return fusion.rrf(_two(spark, d)).select("label", _r("score", 9), F.array_join("sources", ",").alias("sources"))


_SPEC = GRAPH.replace("WITH RECURSIVE", "") + """, dg AS (SELECT node, count(*) AS g FROM (SELECT src AS node FROM kg_eff WHERE eff > 0.05 UNION ALL SELECT dst FROM kg_eff WHERE eff > 0.05) GROUP BY node),
sr AS (SELECT node_id, label, ln((SELECT count(*) FROM kg_nodes) / (1 + coalesce(g, 0))) + 1 AS x, last_seen FROM kg_nodes LEFT JOIN dg ON node = node_id),
sp AS (SELECT label, max(x / (SELECT max(x) FROM sr)) AS s, max(last_seen) AS last_seen FROM sr GROUP BY label)"""
_FUSED = _THREE.replace(f"WITH {NODES}, x0", f"WITH {_SPEC}, x0")


@query(_FUSED + "SELECT label, round(score * (0.7 + 0.3 * coalesce(s, 0.5)), 9) AS score FROM f LEFT JOIN sp USING (label)")
def rrf_specificity(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists weighted by how specific a label is."""
    s = rank.specificity(kg_nodes(spark, d), kg_edges(spark, d))
    return fusion.rrf_specificity(_two(spark, d), s).select("label", _r("score", 9))


@query(_FUSED + f"""SELECT label, round(score * (1 + 0.5 * exp(-coalesce(greatest(0, date_sub('second', last_seen, {T})) / 3600.0, 168.0) / 168.0)) * coalesce(s, 0.5), 9) AS score
FROM f LEFT JOIN sp USING (label)""")
def temporal_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists reranked by recency."""
    n = kg_nodes(spark, d)
    s = rank.specificity(n, kg_edges(spark, d)).join(n.select("node_id", "last_seen"), "node_id").groupBy("label").agg(
        F.max("specificity").alias("specificity"), F.max("last_seen").alias("last_seen"))
    return fusion.temporal_rerank(fusion.rrf(_two(spark, d)), s, AS_OF).select("label", _r("score", 9))


@query("""WITH p AS (SELECT triplet_id, list_distinct(list_filter(regexp_split_to_array(lower(subject), '\\s+'), lambda w: w <> '')) AS a,
  list_distinct(list_filter(regexp_split_to_array(lower(object), '\\s+'), lambda w: w <> '')) AS b FROM triplets),
q AS (SELECT triplet_id, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM p)
SELECT triplet_id, round(CASE WHEN u = 0 THEN 1.0 ELSE i / u END, 6) AS jaccard FROM q""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the ends of each triplet."""
    return table(spark, d, "triplets").select("triplet_id", exprs.jaccard(F.col("subject"), F.col("object")).alias("jaccard")).withColumn("jaccard", _r("jaccard"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "hdc_records").filter("rec_id IS NOT NULL").groupBy("rec_id").agg(F.min(F.struct("trained_at", "tokens"))["tokens"].alias("t"))
    clean = F.filter(F.transform("t", lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (F.octet_length(x) >= 2))
    return r.select(F.col("rec_id").alias("sent"), clean.alias("tokens"))


_REC = """r0 AS (SELECT rec_id, min((trained_at, tokens)) AS m FROM hdc_records WHERE rec_id IS NOT NULL GROUP BY rec_id),
r AS (SELECT rec_id AS sent, list_filter(list_transform(m[2], lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND strlen(x) >= 2) AS tokens FROM r0),
idf AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM r WHERE len(tokens) > 0) / (count(*) + 1)) + 1 AS idf
  FROM (SELECT sent, unnest(list_distinct(tokens)) AS token FROM r) GROUP BY token),
tk AS (SELECT sent, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM r)"""


@query(f"WITH {_REC} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every token."""
    return hdc.document_frequency(_records(spark, d)).select("token", "df", _r("idf"))


_PAIRS = "pr AS (SELECT a.token, b.token AS other, count(*) AS n FROM tk a JOIN tk b ON a.sent = b.sent AND a.i <> b.i AND abs(a.i - b.i) <= 5 GROUP BY 1, 2)"


@query(f"WITH {_REC}, {_PAIRS} SELECT token, other, n FROM pr")
def cooc_window(spark: SparkSession, d: str) -> DataFrame:
    """How often tokens stand within five places of each other."""
    return hdc.neighbour_counts(_records(spark, d), 5)


#: SQL of the context vectors: 10,000 dimensions, 100 draws a token.
_HDC = f"""{_REC}, {_PAIRS}, dr AS (SELECT token, i, ('0x' || substr(md5(token || ':' || i), 1, 8))::UBIGINT % 10000 AS dim,
  CASE WHEN ('0x' || substr(md5(token || ':' || i), 9, 2))::UBIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS val FROM idf, range(100) t(i)),
b AS (SELECT token, dim, arg_max(val, i) AS val FROM dr GROUP BY 1, 2),
s AS (SELECT pr.token, dim, sum(n * idf * val) AS val FROM pr JOIN idf ON idf.token = other JOIN b ON b.token = other GROUP BY 1, 2
  UNION ALL SELECT token, dim, val FROM b WHERE token NOT IN (SELECT token FROM pr)),
n AS (SELECT token, sqrt(sum(val * val)) AS norm FROM s GROUP BY token),
cv AS (SELECT token, dim::INT AS dim, val / norm AS val FROM s JOIN n USING (token) WHERE norm > 0)"""


@query(f"WITH {_HDC} SELECT token, dim, round(val, 6) + 0.0 AS val FROM cv WHERE abs(val) > 1e-12")
def hdc_context_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Context vectors of all tokens."""
    v = hdc.context_vectors(_records(spark, d), 5)
    return v.filter(F.abs("val") > 1e-12).select("token", "dim", _r("val"))


@query(f"""WITH {_HDC} SELECT c.token, round(sum(c.val * q.val), 6) + 0.0 AS score FROM cv c JOIN cv q ON q.token = 'membrane' AND q.dim = c.dim WHERE c.token <> 'membrane'
GROUP BY c.token ORDER BY round(sum(c.val * q.val), 9) DESC, c.token LIMIT 20""")
def hdc_most_similar(spark: SparkSession, d: str) -> DataFrame:
    """Tokens whose contexts are most like that of a frequent one."""
    return hdc.most_similar_contexts(_records(spark, d), "membrane", 20, 5).withColumn("score", _r("score"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, q WHERE vec_id <> (SELECT min(vec_id) FROM embeddings)
ORDER BY score DESC, vec_id LIMIT 20""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty embeddings most like the first."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).first()
    score = F.round(exprs.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, q.embedding)))), 5)
    return e.filter(F.col("vec_id") != q.vec_id).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Graph, vectors, labels and PageRank fused for one query."""
    v = table(spark, d, "hdc_vectors").filter("vspace = 'neural' AND size(vec) = n_dim").select("term", "vec")
    return fusion.hybrid_search(kg_nodes(spark, d), kg_edges(spark, d), "archive", 20, "cli", v).select("label", _r("score", 9), F.array_join("sources", ",").alias("sources"))


@query()
def mmr_diversify(spark: SparkSession, d: str) -> DataFrame:
    """Fused results, diversified."""
    return fusion.mmr(fusion.rrf(_two(spark, d)).select(F.lit("q").alias("query"), "label", "score"), 20)


_FOUND = """f AS (SELECT workspace, list(label) AS top FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ord) AS rn FROM kg_nodes) WHERE rn <= 20 GROUP BY workspace),
g AS (SELECT DISTINCT workspace, subject AS x FROM triplets WHERE subject IS NOT NULL)"""


@query(f"""WITH {NODES}, {_FOUND},
h AS (SELECT workspace, len(list_filter(top, lambda t: contains(lower(t), lower(x)) OR contains(lower(x), lower(t)))) > 0 AS hit FROM f JOIN g USING (workspace))
SELECT workspace, round(avg(hit::INT), 6) AS recall, count(*) FILTER (WHERE hit)::INT AS hits, count(*)::INT AS total FROM h GROUP BY workspace""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall of gold entities among a workspace's first twenty labels: every subject of a triplet is gold."""
    place = F.row_number().over(W.partitionBy("workspace").orderBy("ord"))
    found = kg_nodes(spark, d).select("workspace", place.alias("place"), "label")
    r = metrics.recall_by(found, table(spark, d, "triplets").select("workspace", F.col("subject").alias("wanted")), "workspace", 20)
    return r.select("workspace", F.round("recall", 6).alias("recall"), "hits", "total")


_NORM = """trim(regexp_replace(regexp_replace(lower({c}), '[.,!?;:''"()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query(f"""WITH b AS (SELECT triplet_id, list_distinct(list_filter(string_split({_NORM.format(c='subject')}, ' '), lambda w: w <> '')) AS p,
  list_distinct(list_filter(string_split({_NORM.format(c='object')}, ' '), lambda w: w <> '')) AS g, {_NORM.format(c='subject')} = {_NORM.format(c='object')} AS em FROM llm_triplets)
SELECT triplet_id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END::DOUBLE, 6) AS f1, em FROM b""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """F1 and exact match of the ends of each triplet as answers."""
    return table(spark, d, "llm_triplets").select("triplet_id", metrics.token_f1(F.col("subject"), F.col("object")).alias("f1"),
                                                  metrics.exact_match(F.col("subject"), F.col("object")).alias("em")).withColumn("f1", _r("f1"))


@query("""SELECT round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 / (r + 1) END::DOUBLE), 6) AS mrr FROM (SELECT CASE WHEN uses % 11 = 0 THEN NULL ELSE uses % 10 END AS r FROM edges)""")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of synthetic ranks."""
    r = table(spark, d, "edges").select(F.when(F.col("uses") % 11 == 0, None).otherwise(F.col("uses") % 10).alias("rank"))
    return metrics.mean_reciprocal_rank(r).withColumn("mrr", _r("mrr"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events),
q AS (SELECT user_id, min(r) FILTER (WHERE event_type = 'click') AS recent, min(r) FILTER (WHERE event_type = 'view') AS stale FROM e GROUP BY user_id)
SELECT round(avg(CASE WHEN recent IS NOT NULL AND (stale IS NULL OR recent < stale) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy, count(*) AS n FROM q WHERE recent IS NOT NULL OR stale IS NOT NULL""")
def temporal_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often the recent fact ranks before the stale one."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("r"))
    q = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "click", F.col("r"))).alias("recent"), F.min(F.when(F.col("event_type") == "view", F.col("r"))).alias("stale"))
    return metrics.temporal_accuracy(q).withColumn("accuracy", _r("accuracy"))
