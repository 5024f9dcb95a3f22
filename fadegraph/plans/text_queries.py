"""Queries of text ingestion, sources and streams."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.functions import exprs
from fadegraph.operators import text
from fadegraph.sources import scratch_path, table
from fadegraph.sources.texts import conversations
from fadegraph.streaming import stream

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


_SENT = r"""s0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+')) AS p, generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, i, p LIKE '%' || chr(10) AS line, regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM s0),
s AS (SELECT doc_id, i, s FROM s1 WHERE strlen(s) >= CASE WHEN line THEN 10 ELSE 5 END),
sl AS (SELECT doc_id, list(s ORDER BY i) AS l FROM s GROUP BY doc_id)"""


@query(f"WITH {_SENT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s AS sentence FROM s")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", F.posexplode(exprs.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


_CHUNK = f"""{_SENT}, c AS (SELECT doc_id, unnest(range(greatest(0, ceil((len(l) - 5) / 4.0)::BIGINT) + 1)) AS chunk_no, l FROM sl),
ch AS (SELECT doc_id, chunk_no::INT AS chunk_no, array_to_string(l[chunk_no * 4 + 1 : chunk_no * 4 + 5], ' ') AS text FROM c)"""


@query(f"WITH {_CHUNK} SELECT * FROM ch")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of five sentences that share one."""
    return text.chunks(table(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH {_CHUNK}, m AS (SELECT doc_id, chunk_no, unnest(regexp_extract_all(text, '(?i)(\S+)\s+(?:remplace|replaces?)\s+(\S+)', 1)) AS subject,
  unnest(regexp_extract_all(text, '(?i)(\S+)\s+(?:remplace|replaces?)\s+(\S+)', 2)) AS object FROM ch) SELECT doc_id, chunk_no, subject, object FROM m""")
def pattern_replaces(spark: SparkSession, d: str) -> DataFrame:
    """What replaces what, by pattern."""
    c = text.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.explode(text.matches(F.col("text"), *(text.PATTERNS[4][0], 5, "derives_de"))).alias("m")).select("doc_id", "chunk_no", "m.subject", "m.object")


@query(rf"""WITH {_CHUNK}, m AS (SELECT doc_id, chunk_no, unnest(regexp_extract_all(text, '(?i)(\S+(?:\s\S+)?)\s+(?:dépend de|depends? on|requires?)\s+(\S+(?:\s\S+)?)', 1)) AS subject,
  unnest(regexp_extract_all(text, '(?i)(\S+(?:\s\S+)?)\s+(?:dépend de|depends? on|requires?)\s+(\S+(?:\s\S+)?)', 2)) AS object FROM ch) SELECT doc_id, chunk_no, subject, object FROM m""")
def pattern_depends(spark: SparkSession, d: str) -> DataFrame:
    """What depends on what, by pattern."""
    c = text.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.explode(text.matches(F.col("text"), text.PATTERNS[10][0], 11, "trail")).alias("m")).select("doc_id", "chunk_no", "m.subject", "m.object")


def _groups(pattern: str, g: int) -> str:
    return f"regexp_extract_all(text, '(?i){pattern}', {g})".replace("\\z", "$")


#: SQL of all patterns: the same expressions by DuckDB's engine, whose \\s, \\S and case know ASCII and Unicode as given.
_ALL = "pt AS (" + " UNION ALL ".join(
    f"SELECT doc_id, chunk_no, {i + 1} AS no, '{c}' AS channel, unnest({_groups(p, 1)}) AS s, unnest({_groups(p, 2)}) AS o FROM ch" for i, (p, c) in enumerate(text.PATTERNS)
) + r"""), pn AS (SELECT doc_id, chunk_no, no, channel, trim(regexp_replace(s, '\s+$|^\s+', '', 'g')) AS subject, coalesce(nullif(trim(regexp_replace(o, '\s+$|^\s+', '', 'g')), ''), 'WARNING') AS object FROM pt)"""


@query(f"WITH {_CHUNK}, {_ALL} SELECT no::INT AS no, channel, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM pn WHERE subject <> '' GROUP BY 1, 2")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each of the fifteen patterns over all chunks, repetitions included."""
    c = text.chunks(table(spark, d, "documents"), "doc_id", "text")
    t = c.select(F.explode(text.triplets(F.col("text"))).alias("t")).select("t.*")
    return t.groupBy("no", "channel").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"))


@query()
def triplet_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Triplets of all patterns."""
    return text.extract_triplets(text.chunks(table(spark, d, "documents"), "doc_id", "text"), ["doc_id", "chunk_no"])


@query("""SELECT triplet_id, CASE channel WHEN 'episodic' THEN 'event' ELSE 'entity' END AS subject_kind,
CASE channel WHEN 'alarm' THEN 'warning' WHEN 'episodic' THEN 'event' WHEN 'derives_de' THEN 'entity'
  WHEN 'causal' THEN CASE WHEN contains(object, 'nm') OR contains(object, 'pLDDT') OR regexp_matches(object, '[0-9]') THEN 'measurement' ELSE 'entity' END ELSE 'concept' END AS object_kind FROM triplets""")
def triplet_kind_case(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the ends of triplets."""
    s, o = exprs.kinds_of(F.col("channel"), F.col("object"))
    return table(spark, d, "triplets").select("triplet_id", s.alias("subject_kind"), o.alias("object_kind"))


@query("""SELECT triplet_id, CASE WHEN regexp_matches(lower(relation), 'derive|based on|version') THEN 'derives_de' WHEN regexp_matches(lower(relation), 'cause|trigger|produce') THEN 'causal'
WHEN regexp_matches(lower(relation), 'avoid|incompatible|error') THEN 'alarm' ELSE 'trail' END AS channel FROM llm_triplets""")
def relation_channel(spark: SparkSession, d: str) -> DataFrame:
    """Channels of relations given by a model."""
    return table(spark, d, "llm_triplets").select("triplet_id", exprs.relation_channel(F.col("relation")).alias("channel"))


@query("""SELECT session_key, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL AND session_key IS NOT NULL GROUP BY session_key""")
def conversation_source(spark: SparkSession, d: str) -> DataFrame:
    """Texts joined per session."""
    t = table(spark, d, "documents").filter("session_key IS NOT NULL")
    return conversations(t, "session_key", "doc_id", "text")


#: SQL of the entity runs; the word lists are the operator's.
_NER = (
    r"""nw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> '') AS raw FROM documents WHERE text IS NOT NULL),
nb AS (SELECT doc_id, raw, list_transform(raw, lambda w: regexp_replace(w, '^[^\p{L}\p{N}''-]+|[^\p{L}\p{N}''-]+$', '', 'g')) AS bare FROM nw),
nl AS (SELECT doc_id, array_to_string(list_transform(range(1, len(raw) + 1), lambda i:
  CASE WHEN regexp_matches(bare[i], '^\p{Lu}') AND lower(bare[i]) NOT IN STOPS THEN CASE WHEN lower(bare[i]) IN JOINS THEN 'M' ELSE 'N' END
    WHEN regexp_matches(bare[i], '^\p{Lu}') THEN CASE WHEN lower(bare[i]) IN JOINS THEN 'T' ELSE 'S' END WHEN lower(bare[i]) IN JOINS THEN 'k' ELSE 'o' END
  || CASE WHEN i = 1 OR regexp_matches(raw[i - 1], '[.!?]$') THEN 'b' ELSE 'w' END || CASE WHEN strlen(bare[i]) >= 4 THEN 'L' ELSE 's' END || bare[i] || chr(10)), '') AS line FROM nb),
nr AS (SELECT doc_id, unnest(regexp_extract_all(line, '(?m)^[NM][^\n]*\n(?:[MTk][^\n]*\n[NMST][^\n]*\n|[NM][^\n]*\n)*')) AS r FROM nl),
nt AS (SELECT doc_id, regexp_replace(regexp_replace(rtrim(r, chr(10)), '(?m)^.{3}', '', 'g'), '\n', ' ', 'g') AS entity FROM nr
  WHERE len(r) - len(replace(r, chr(10), '')) > 1 OR regexp_matches(r, '^.wL'))"""
    .replace("STOPS", "(" + ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS)) + ")").replace("JOINS", "(" + ", ".join(f"'{w}'" for w in sorted(text.CONNECTIVES)) + ")")
)


@query(f"WITH {_NER} SELECT DISTINCT doc_id, lower(entity) AS entity FROM nt")
def ner_entities(spark: SparkSession, d: str) -> DataFrame:
    """Named entities of all documents."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(text.ner("text")).alias("entity")).withColumn("entity", F.lower("entity"))


@query()
def ingest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges the ingestion of all documents observes."""
    return text.ingest(table(spark, d, "documents"), "doc_id", "text", "corpus")[1].select("src", "dst", "channel", "confidence", "doc_id", "chunk_no")


@query()
def llm_json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Triplets of model answers wrapped as an array."""
    a = F.concat(F.lit("<think>x</think>```json\n["), "payload", F.lit("]\n```"))
    return table(spark, d, "llm_raw").select("raw_id", F.explode(text.parse_answer(a)).alias("t")).select("raw_id", "t.subject", "t.relation", "t.object", "t.confidence")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b(?:if|else|match|for|while|loop)\b|&&|\|\||\?')) + 1 AS complexity FROM documents WHERE text IS NOT NULL")
def complexity_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Branching words of a text, and one."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", text.complexity(F.col("text")).cast("bigint").alias("complexity"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and six hours."""
    w = stream.tumbling(table(spark, d, "events"), "ts", "6 hours", ["event_type"])
    return w.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows_events(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, parted by two quiet hours."""
    s = stream.sessions(table(spark, d, "events"), "ts", "2 hours", ["user_id"])
    return s.select("user_id", F.col("start").cast("string").alias("start"), "n")


@query("""WITH RECURSIVE o AS (
  SELECT concat_ws('>', user_id, event_type) AS key, ts, least(1.0, value / 100) AS c, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, least(1.0, value / 100)) AS n FROM events
), f AS (
  SELECT key, ts, greatest(0.0, coalesce(c, 0.8)) AS x, n FROM o WHERE n = 1
  UNION ALL
  SELECT o.key, o.ts, least(1.0, x * exp(-0.05 * greatest(0, date_sub('second', f.ts, o.ts)) / 3600.0) + 0.1), o.n FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1
), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS rn FROM f)
SELECT key, 'episodic' AS channel, round(x, 6) AS intensity, n AS uses FROM l WHERE rn = 1""")
def stream_reinforce(spark: SparkSession, d: str) -> DataFrame:
    """Users' edges after their events streamed through the stateful reinforcement."""
    out = scratch_path(spark, "stream")
    e = table(spark, d, "events")
    src = spark.readStream.schema(e.schema).parquet(d, pathGlobFilter="events.parquet")
    o = src.select(F.concat_ws(">", "user_id", "event_type").alias("key"), F.lit("episodic").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))
    q = stream.reinforce_stream(o).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(
        lambda b, i: b.write.mode("append").parquet(f"{out}/rows")).start()
    q.awaitTermination()
    last = spark.read.schema(stream.EDGE_OUT).parquet(f"{out}/rows")
    return last.groupBy("key", "channel").agg(F.max_by("intensity", "uses").alias("intensity"), F.max("uses").alias("uses")).withColumn("intensity", F.round("intensity", 6))
