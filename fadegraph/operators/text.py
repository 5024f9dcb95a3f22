"""From text to triplets: sentences, chunks, patterns, named entities, code symbols.

Everything stays in the JVM but the repair of model answers, which is Arrow-batched.
"""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadegraph.functions import exprs

# Extraction patterns in order of evaluation, with their channel.
PATTERNS = [
    (r"(\S+(?:\s\S+){0,2})\s+(?:est un|est une|is a|is an)\s+(.+?)(?:\.|\z)", "trail"),
    (r"(\S+(?:\s\S+)?)\s+(?:dérive de|derives? from|derived from|based on)\s+(\S+(?:\s\S+)?)", "derives_de"),
    (r"(\S+(?:\s\S+)?)\s+(?:cause[sd]?|provoque|triggers?)\s+(\S+(?:\s\S+)?)", "causal"),
    (r"(?:ÉVITER|AVOID)\s+(?:combining\s+)?(\S+(?:\s\S+)?)(?:\s+(?:avec|with|due)\s+(\S+(?:\s\S+)?))?", "alarm"),
    (r"(\S+)\s+(?:remplace|replaces?)\s+(\S+)", "derives_de"),
    (r"(\S+(?:\s\S+){0,2})\s+(?:utilise|uses?)\s+(\S+(?:\s\S+)?)", "trail"),
    (r"(\S+)\s+(?:émission|emission|emit|emits?)\s*(?:at|[=:])\s*([\d.]+\s*nm)", "causal"),
    (r"(\S+)\s+(?:has been engineered to|engineered to)\s+emit\s+at\s+(?:exactly\s+)?([\d.]+\s*nm)", "causal"),
    (r"(\S+)\s+(?:.*\s)?pLDDT\s*[=:>]\s*([\d.]+)", "trail"),
    (r"(\S+(?:\s\S+)?)\s+(?:has|a un|possède)\s+(?:a |an )?(.+?)(?:\.|,|\z)", "trail"),
    (r"(\S+(?:\s\S+)?)\s+(?:dépend de|depends? on|requires?)\s+(\S+(?:\s\S+)?)", "trail"),
    (r"(\S+(?:\s\S+)?)\s+(?:produit|produces?|generates?|creates?)\s+(\S+(?:\s\S+)?)", "causal"),
    (r"(\S+(?:\s\S+)?)\s+(?:achieves?|atteint|reaches?)\s+(.+?)(?:\.|,|\z)", "trail"),
    (r"(\S+(?:\s\S+)?)\s+(?:compile[sd]?\s+(?:to|vers)|runs?\s+(?:on|in))\s+(\S+(?:\s\S+)?)", "trail"),
    (r"(\S+)\s+(?:with a|with an|avec un|avec une)\s+(.+?)(?:\.|,|\z)", "trail"),
]
# One of these words must be in a text for the pattern of the same place to match; plain searches are cheap.
TRIGGERS = [
    "est une?|is an?", "dérive|derive|based on", "cause|provoque|trigger", "éviter|avoid", "remplace|replace", "utilise|uses?", "émission|emi(?:t|ssion)",
    "engineered to", "plddt", "has|a un|possède", "dépend|depend|require", "produi|produce|generate|create", "achieve|atteint|reach", "compile|runs?",
    "with an?|avec une?",
]
# Words that join parts of a name, and words that are no names.
CONNECTIVES = frozenset("of de du des von van di da del la le les el al ibn bin the and und et y e".split())
STOPWORDS = frozenset(
    "the a an and or but in on at to for is it by as he she they this that was were has had have been are his her its from with not also who which "
    "when where what how after before during between into over under their these those then than some such only other more most many much each every "
    "both few all any own same so no nor if just about up out one two three four five six le la les un une des du de ce cette ces il elle ils elles "
    "est sont dans pour avec sur par plus mais donc car qui que dont however although because since while meanwhile therefore furthermore moreover "
    "according following several various another first second third later early earlier recent recently".split()
)
WARNING = "WARNING"


def matches(text: Column, pattern: str, no: int, channel: str) -> Column:
    """(no, pos, subject, object, channel) of a pattern's matches in order."""
    # a subject starts at a word or where the last match ended, and its words are never cut: same matches, far fewer tries
    if pattern.startswith(r"(\S+"):
        head, rest = pattern.split(")\\s+(", 1) if ")\\s+(" in pattern else (pattern, "")
        pattern = r"(?:(?<!\S)|\G)" + head.replace(r"\S+", r"\S++") + (")\\s+(" + rest if rest else "")
    p = F.lit(f"(?iud){pattern}")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+\z|\A\s+", ""))
    # the text is searched once; both groups are read from the short match, which ends where the match did
    return F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m, i: F.struct(
        F.lit(no).alias("no"), i.alias("pos"), tidy(F.regexp_extract(m, f"(?iud){pattern}", 1)).alias("subject"),
        F.coalesce(F.nullif(tidy(F.regexp_extract(m, f"(?iud){pattern}", 2)), F.lit("")), F.lit(WARNING)).alias("object"), F.lit(channel).alias("channel"),
    ))


_ANY = "|".join(TRIGGERS)


def triplets(text: Column, low: Column | None = None) -> Column:
    """All triplets of a text in order of pattern and place; ``low`` is the text in lower case, where it is at hand."""
    low = F.lower(text) if low is None else low
    none = F.array().cast("array<struct<no:int,pos:int,subject:string,object:string,channel:string>>")
    every = F.flatten(F.array(*(F.when(low.rlike(TRIGGERS[i]), matches(text, p, i + 1, c)).otherwise(none) for i, (p, c) in enumerate(PATTERNS))))
    return F.filter(every, lambda t: t["subject"] != "")


def extract_triplets(chunks: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, seq, subject, object, channel of each triplet of each chunk; a repetition of the one before is left out."""
    told = chunks.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_c"), F.lower(text).alias("_l")).filter(F.col("_l").rlike(_ANY))
    every = told.select(*keep, triplets(F.col("_c"), F.col("_l")).alias("_t")).filter(F.size("_t") > 0)
    bare = lambda t: F.struct(t["subject"].alias("subject"), t["object"].alias("object"), t["channel"].alias("channel"))
    kept = F.filter("_t", lambda t, i: (i == 0) | (bare(t) != bare(F.get("_t", i - 1))))
    t = every.select(*keep, F.posexplode(kept).alias("seq", "t"))
    return t.select(*keep, "seq", "t.subject", "t.object", "t.channel")


def chunks(docs: DataFrame, doc_id: str, text: str, size: int = 5, overlap: int = 1) -> DataFrame:
    """(doc_id, chunk_no, text) windows of sentences."""
    windows = exprs.chunk_windows(exprs.sentences(F.col(text)), size, overlap)
    return docs.filter(F.col(text).isNotNull()).select(doc_id, F.posexplode(windows).alias("chunk_no", "text"))


#: A run of a name: a capitalised word, then words of a name, or a connective and any capitalised word.
#: Each word stands as a letter for what it is, two flags and itself.  N: part of a name; M: the same and a connective;
#: S: a capitalised stop word; T: the same and a connective; k: a small connective; o: anything else.
_RUN = r"(?m)^[NM][^\n]*\n(?:[MTk][^\n]*\n[NMST][^\n]*\n|[NM][^\n]*\n)*"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: written out in a lambda it would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def _first_writings(names: Column) -> Column:
    """Each name once whatever its case, as first written."""
    return _let(F.transform(names, lambda n: F.struct(n.alias("n"), F.lower(n).alias("l"))), lambda a: _let(
        F.transform(a, lambda x: x["l"]), lambda lows: F.transform(F.filter(a, lambda x, i: F.array_position(lows, x["l"]) == i + 1), lambda x: x["n"])))


def ner(text: Column | str) -> Column:
    """Named entities of a text: its capitalised runs in order, each once whatever its case.

    Connectives join two capitalised words; a run starts at no stop word; a single word needs four bytes and a place inside its sentence.
    """
    raw = F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"[\s\p{Z}]+"), lambda w: w != "")
    seen = lambda w: F.struct(w.alias("b"), F.lower(w).alias("l"))
    bare = F.transform(raw, lambda w: F.struct(F.regexp_replace(w, r"^[^\p{L}\p{N}'-]+|[^\p{L}\p{N}'-]+$", "").alias("b"), w.rlike(r"[.!?]$").alias("ends")))
    words = F.transform(bare, lambda w: F.struct(w["ends"].alias("ends"), seen(w["b"]).alias("w")))

    def kind(b: Column, low: Column) -> Column:
        joins = low.isin(*sorted(CONNECTIVES))
        return F.when(b.rlike(r"^\p{Lu}"), F.when(low.isin(*sorted(STOPWORDS)), F.when(joins, "T").otherwise("S")).otherwise(F.when(joins, "M").otherwise("N"))).when(
            joins, "k").otherwise("o")

    def lines(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda x, i: F.concat(
            kind(x["w"]["b"], x["w"]["l"]), F.when((i == 0) | F.get(ws, i - 1)["ends"], "b").otherwise("w"), F.when(F.octet_length(x["w"]["b"]) >= 4, "L").otherwise("s"),
            x["w"]["b"], F.lit("\n"))), "")

    runs = F.regexp_extract_all(_let(words, lines), F.lit(_RUN), F.lit(0))
    told = F.filter(runs, lambda r: (F.regexp_count(r, F.lit("\n")) > 1) | r.rlike(r"^.wL"))
    return _first_writings(F.transform(told, lambda r: F.regexp_replace(F.regexp_replace(r, r"(?m)^.{3}|\n\z", ""), "\n", " ")))


def capital_runs(words: list[str], stop: frozenset[str], joiners: frozenset[str]) -> list[tuple[int, int]]:
    """(start, end) of the capitalised runs of one text's words, by the same rule as ``ner``'s."""
    letter = lambda w: ("N" if w.lower() not in stop else "S") if w[:1].isupper() else "k" if w.lower() in joiners else "o"
    return [m.span() for m in re.finditer(r"N(?:k[NS]|N)*", "".join(map(letter, words)))]


def cooccurring(entities: DataFrame, keep: list[str], names: str = "entities") -> DataFrame:
    """keep, a, b of each pair of a chunk's entities in order; a chunk has few, as its text is bounded."""
    e = entities.select(*keep, F.col(names).alias("n"), F.posexplode(names).alias("i", "a"))
    return e.select(*keep, "a", F.explode(F.slice("n", F.col("i") + 2, F.size("n"))).alias("b"))


def fallback_label(chunk: Column) -> Column:
    """A chunk as an event's label: whole up to 80 bytes, else its start and dots."""
    return F.when(F.octet_length(chunk) <= 80, chunk).otherwise(F.concat(F.substring(chunk, 1, 77), F.lit("...")))


def ingest(docs: DataFrame, doc_id: str, text: str, source: str, workspace: str = "default") -> tuple[DataFrame, DataFrame]:
    """Observed nodes and edges of texts.

    Nodes: workspace, label, kind, tags, seq; edges: src, dst (labels), channel,
    confidence, source, seq.  Patterns weigh 0.7, entities of one chunk 0.5; a chunk
    of over 50 bytes with fewer than three triplets becomes an event.
    """
    c = chunks(docs, doc_id, text).withColumn("source", F.lit(source))
    t = extract_triplets(c, [doc_id, "chunk_no", "source"])
    e = c.withColumn("entities", ner("text")).filter(F.size("entities") > 0)
    pairs = cooccurring(e, [doc_id, "chunk_no", "source"])
    edges = t.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "channel", F.lit(0.7).alias("confidence"), "source", doc_id, "chunk_no").unionByName(
        pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("trail").alias("channel"), F.lit(0.5).alias("confidence"), "source", doc_id, "chunk_no"))
    s_kind, o_kind = exprs.kinds_of(F.col("channel"), F.col("object"))
    ends = t.select(doc_id, "chunk_no", F.explode(F.array(
        F.struct(F.col("subject").alias("label"), s_kind.alias("kind")), F.struct(F.col("object").alias("label"), o_kind.alias("kind")))).alias("x"))
    few = c.join(t.groupBy(doc_id, "chunk_no").agg(F.count("*").alias("n")), [doc_id, "chunk_no"], "left").filter(
        (F.coalesce("n", F.lit(0)) < 3) & (F.octet_length("text") > 50))
    nodes = (
        ends.select(doc_id, "chunk_no", "x.label", "x.kind", F.array().cast("array<string>").alias("tags"))
        .unionByName(e.select(doc_id, "chunk_no", F.explode("entities").alias("label"), F.lit("entity").alias("kind"), F.array().cast("array<string>").alias("tags")))
        .unionByName(few.select(doc_id, "chunk_no", fallback_label(F.col("text")).alias("label"), F.lit("event").alias("kind"), F.array("source").alias("tags")))
        .withColumn("workspace", F.lit(workspace))
    )
    return nodes, edges


def repaired(answer: str | None) -> list[dict]:
    """Triplets of a model's answer, however wrapped; none if there is no array of objects with the four fields."""
    s = re.sub(r"<think>.*?(?:</think>|\Z)", "", answer or "", flags=re.S).strip()

    def load(x: str):
        try:
            return json.loads(x)
        except ValueError:
            return None

    def good(v) -> bool:
        return isinstance(v, list) and all(isinstance(t, dict) and isinstance(t.get("subject"), str) and isinstance(t.get("object"), str) for t in v)

    whole = load(s)
    if good(whole):
        return whole
    if isinstance(whole, dict):
        for v in [whole.get("triplets"), *whole.values()]:
            if good(v) and v:
                return v
    fence = re.match(r"```(?:json)?\s*(.*?)\s*`*\Z", s, re.S)
    if fence and good(load(fence[1])):
        return load(fence[1])
    a, b = s.find("["), s.rfind("]")
    inner = load(s[a : b + 1]) if 0 <= a < b else None
    return inner if good(inner) else []


@F.pandas_udf(T.ArrayType(T.StructType([
    T.StructField("subject", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("object", T.StringType()), T.StructField("confidence", T.DoubleType())
])))
def parse_answer(answer: pd.Series) -> pd.Series:
    """Triplets of each answer."""

    def number(x) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.8

    return answer.map(lambda s: [
        {"subject": t["subject"], "relation": str(t.get("relation", "")), "object": t["object"], "confidence": number(t.get("confidence", 0.8))} for t in repaired(s)
    ])


# Weights of edges between code symbols.
CONTAINS, IMPLEMENTS, USES_TYPE, CALLS = 0.95, 0.95, 0.6, 0.8
_BRANCH = r"\b(?:if|else|match|for|while|loop)\b|&&|\|\||\?"
_ITEM = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod)\s+(\w+)"


def complexity(body: Column) -> Column:
    """1, and one more for each branching keyword or operator."""
    return F.regexp_count(body, F.lit(_BRANCH)) + 1


def code_symbols(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Symbols (path, kind, name, complexity) and edges (src, dst, channel, confidence) of Rust sources.

    Complexity is 1 and one more for each branching keyword of the file's item.
    """
    body = F.split(F.col(text), r"(?m)^(?=\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod)\s+\w+)")
    items = files.select(path, F.explode(F.filter(F.transform(body, lambda b: F.struct(
        F.regexp_extract(b, _ITEM, 1).alias("kind"), F.regexp_extract(b, _ITEM, 2).alias("name"), b.alias("body"))), lambda x: x["name"] != "")).alias("i")).select(path, "i.*")
    symbols = items.select(path, "kind", "name", complexity(F.col("body")).alias("complexity"))
    contains = items.select(F.col(path).alias("src"), F.col("name").alias("dst"), F.lit("derives_de").alias("channel"), F.lit(CONTAINS).alias("confidence"), F.lit("contains").alias("label"))
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"impl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\s+(\w+)"), F.lit(1)).alias("t"),
                        F.regexp_extract_all(text, F.lit(r"impl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\s+(\w+)"), F.lit(2)).alias("s"))
    implements = files.select(F.explode(pair).alias("p")).select(F.col("p.s").alias("src"), F.col("p.t").alias("dst"), F.lit("causal").alias("channel"), F.lit(IMPLEMENTS).alias("confidence"), F.lit("implements").alias("label"))
    names = symbols.select("name", F.col("kind").alias("k")).distinct()
    called = items.filter("kind = 'fn'").select(F.col("name").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("name"))
    calls = called.join(names.filter("k = 'fn'"), "name").filter("src <> name").select("src", F.col("name").alias("dst"), F.lit("trail").alias("channel"), F.lit(CALLS).alias("confidence"), F.lit("calls").alias("label"))
    used = items.select(F.col("name").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Z]\w+)"), F.lit(1)))).alias("name"))
    uses = used.join(names.filter("k in ('struct', 'enum', 'trait')"), "name").filter("src <> name").select("src", F.col("name").alias("dst"), F.lit("trail").alias("channel"), F.lit(USES_TYPE).alias("confidence"), F.lit("uses_type").alias("label"))
    return symbols, contains.unionByName(implements).unionByName(calls).unionByName(uses)


def gold_entities(title: Column, answer: Column, body: Column) -> Column:
    """What a supporting paragraph is about: its title, an answer under 100 bytes, and its capitalised runs, each once whatever its case."""
    short = F.when(F.octet_length(answer) < 100, answer)
    parts = F.filter(F.concat(F.array(title, short), F.coalesce(ner(body), F.array().cast("array<string>"))), lambda p: F.trim(p) != "")
    return _first_writings(parts)


def link_titles(paragraphs: DataFrame) -> DataFrame:
    """(a, b): titles that share a named entity, whatever its case; ``paragraphs`` has title and text.

    Pairs come from an equality join on entities; an entity's titles are distinct.  ``title_stars`` gives the same links without pairs.
    """
    e = title_entities(paragraphs)
    return e.select(F.col("title").alias("a"), "e").join(e.select(F.col("title").alias("b"), "e"), "e").filter("a < b").select("a", "b").distinct()


def title_entities(paragraphs: DataFrame) -> DataFrame:
    """(title, e): the entities of each title's text in lower case, each once."""
    return paragraphs.filter("title IS NOT NULL").select("title", F.explode(ner("text")).alias("e")).select("title", F.lower("e").alias("e")).distinct()


def title_stars(paragraphs: DataFrame) -> DataFrame:
    """(e, hub, title): each entity's titles hung on its smallest one, a row a title, however many share it."""
    e = title_entities(paragraphs)
    hub = e.groupBy("e").agg(F.min("title").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return e.join(hub.drop("n"), "e").filter("title <> hub").select("e", "hub", "title")
