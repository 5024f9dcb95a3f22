"""Texts as tables: files, conversations, question sets, JSON; and what is written out.

A file over ``MOST_BYTES`` is an error, as is a path that climbs out of its folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024
# Extensions a watched folder takes.
EXTENSIONS = ("txt", "md", "rst", "json", "csv", "log", "rs", "py", "js", "toml", "yaml")


def checked_path(path: str) -> str:
    """The path, unless it climbs."""
    if ".." in path.split("/") or "\0" in path:
        raise ValueError(f"path {path!r} is not allowed")
    return path


def workspace_name(name: str) -> str:
    """The name, unless it could leave its folder."""
    if not name or any(x in name for x in ("..", "/", "\\", "\0")):
        raise ValueError(f"workspace {name!r} is not allowed")
    return name


def raw_text(spark: SparkSession, text: str) -> DataFrame:
    """(path, text) of a literal."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("text is too large")
    return spark.createDataFrame([("inline", text)], "path string, text string")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files of a folder, each whole; one that is too large is an error when it is read."""
    rows = spark.read.text(checked_path(path), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    told = F.raise_error(F.concat(F.lit("file is too large: "), "path"))
    return rows.withColumn("text", F.when(F.octet_length("text") > MOST_BYTES, told.cast("string")).otherwise(F.col("text")))


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to a mutation log; entries already there stay."""
    entries.write.mode("append").parquet(path)


def truncate_log(spark: SparkSession, path: str, upto: int) -> str:
    """The path of a new log without the entries up to a seq, as after a snapshot; the old one is not touched."""
    kept = f"{path.rstrip('/')}-after-{upto}"
    spark.read.parquet(path).filter(F.col("seq").isNull() | (F.col("seq") > upto)).write.parquet(kept)
    return kept


def conversations(turns: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """(conv, text): the turns of each conversation in order, parted by blank lines; turns without text are left out."""
    t = turns.filter(F.col(text).isNotNull()).groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, text))).alias("t"))
    return t.select(conv, F.array_join(F.transform("t", lambda x: x[text]), "\n\n").alias("text"))


def pretty_json(rows: DataFrame) -> DataFrame:
    """(text): rows as indented JSON."""
    return rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("text"))


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their visible text in ``text``."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.withColumn("text", F.trim(F.regexp_replace(bare, r"\s+", " ")))


_QUESTION = "id string, question string, answer string, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>"


def musique(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, question, answer, supporting, paragraphs, num_hops, dataset) of JSON lines."""
    rows = spark.read.schema(_QUESTION).json(checked_path(path))
    rows = rows.limit(limit) if limit else rows
    every = F.transform("paragraphs", lambda p: F.struct(p["title"].alias("title"), p["paragraph_text"].alias("text")))
    support = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: F.struct(p["title"].alias("title"), p["paragraph_text"].alias("text")))
    return rows.select("id", "question", "answer", support.alias("supporting"), every.alias("paragraphs"), F.greatest(F.lit(1), F.size(support)).alias("num_hops"), F.lit("musique").alias("dataset"))


def hotpot(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The same of a JSON array whose contexts are [title, [sentence]] pairs."""
    schema = "_id string, question string, answer string, supporting_facts array<array<string>>, context array<array<string>>"
    rows = spark.read.schema(schema).json(checked_path(path), multiLine=True)
    rows = rows.limit(limit) if limit else rows
    text = lambda c: F.array_join(F.from_json(c[1], "array<string>"), "")
    every = F.transform("context", lambda c: F.struct(c[0].alias("title"), text(c).alias("text")))
    titles = F.array_distinct(F.transform("supporting_facts", lambda f: f[0]))
    support = F.filter(every, lambda p: F.array_contains(titles, p["title"]))
    return rows.select(F.col("_id").alias("id"), "question", "answer", support.alias("supporting"), every.alias("paragraphs"), F.greatest(F.lit(1), F.size(support)).alias("num_hops"), F.lit("hotpotqa").alias("dataset"))


HTML_ROWS = 10_000
_PAGE = ("<!doctype html><meta charset=utf-8><title>graph</title><ul id=list></ul><script>const rows=",
         ";for(const r of rows){const li=document.createElement('li');li.textContent=r.what=='node'?r.label+' ('+r.kind+')':r.src+' -'+r.channel+'-> '+r.dst;list.append(li)}</script>")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "json") -> None:
    """Write the graph as json (two folders), csv (edges) or dot (lines)."""
    named = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    full = edges.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    a, b = F.coalesce("src_label", "src"), F.coalesce("dst_label", "dst")
    if form == "json":
        nodes.write.mode("overwrite").json(f"{path}/nodes")
        edges.write.mode("overwrite").json(f"{path}/edges")
    elif form == "csv":
        full.select(a.alias("from"), b.alias("to"), "channel", "intensity", "uses", "source").write.mode("overwrite").csv(path, header=True)
    elif form == "dot":
        quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', "'"), F.lit('"'))
        full.select(F.concat(quoted(a), F.lit(" -> "), quoted(b), F.lit(' [label="'), "channel", F.lit('"];')).alias("value")).write.mode("overwrite").text(path)
    elif form == "html":
        # one page holds what a reader can look at: the caller's view, of bounded size
        row = lambda what, *cols: F.to_json(F.struct(F.lit(what).alias("what"), *cols))
        lines = [r.value for r in nodes.select(row("node", "node_id", "label", "kind").alias("value")).limit(HTML_ROWS).collect()]
        lines += [r.value for r in full.select(row("edge", "src", "dst", "channel", "intensity").alias("value")).limit(HTML_ROWS).collect()]
        data = ",\n".join(x.replace("<", "\\u003c") for x in lines)
        page = f"{_PAGE[0]}[{data}]{_PAGE[1]}"
        nodes.sparkSession.range(1).select(F.lit(page).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def import_graph(spark: SparkSession, path: str, node_schema, edge_schema) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that ``export_graph`` wrote as json."""
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/edges")


def save_snapshot(nodes: DataFrame, edges: DataFrame, root: str, workspace: str, version: int) -> str:
    """Write state as a new version of a workspace; a version is never written twice."""
    path = f"{root}/{workspace_name(workspace)}/v{version:08d}"
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    return path


def load_snapshot(spark: SparkSession, root: str, workspace: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A version of a workspace's state, or the newest that is whole."""
    from fadegraph.sources import hadoop

    base = f"{root}/{workspace_name(workspace)}"
    if version is None:
        whole = [v for v in hadoop.names(spark, base) if "_SUCCESS" in hadoop.names(spark, f"{base}/{v}/edges")]
        version = int(whole[-1][1:])
    path = f"{base}/v{version:08d}"
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def workspaces(spark: SparkSession, root: str) -> list[str]:
    """Names of the workspaces of a root, sorted, hidden ones left out."""
    from fadegraph.sources import hadoop

    return [n for n in hadoop.names(spark, root) if not n.startswith((".", "_"))]
