"""Scalar kernels as Catalyst expressions; none of them leaves the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fadegraph.functions import channels

OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
ACCENTED, PLAIN = "àâäáãéèêëîïíôöóõùûüúÿýçñ", "aaaaaeeeeiiioooouuuuyycn"


def ts(value: str) -> Column:
    """A timestamp without zone."""
    return F.lit(value).cast("timestamp_ntz")


def node_id(workspace: Column, label: Column) -> Column:
    """Version-5 UUID of ``workspace:label`` in the OID namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(F.concat(workspace, F.lit(":"), label), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def hours_since(last_touch: Column, as_of: Column) -> Column:
    """Whole seconds since, as hours; 0 for the future."""
    return F.greatest(F.lit(0), F.timestamp_diff("SECOND", last_touch, as_of)) / F.lit(3600.0)


def decayed(intensity: Column, channel: Column, last_touch: Column, as_of: Column) -> Column:
    """Effective intensity at ``as_of``."""
    return intensity * F.exp(-channels.tau(channel) * hours_since(last_touch, as_of))


def dead(intensity: Column, channel: Column, last_touch: Column, as_of: Column, threshold: float = channels.PRUNE_THRESHOLD) -> Column:
    """Prunable and strictly below the threshold."""
    return channels.prunable(channel) & (decayed(intensity, channel, last_touch, as_of) < threshold)


def reinforced(intensity: Column, channel: Column, last_touch: Column, as_of: Column) -> Column:
    """Intensity after one reinforcement, at most 1."""
    return F.least(F.lit(1.0), decayed(intensity, channel, last_touch, as_of) + channels.delta(channel))


def clamped(x: Column) -> Column:
    """Between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fold_accents(text: Column) -> Column:
    """Lower case without the accents of Western European letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fuzzy_score(label: Column, query: str) -> Column:
    """How well a label answers a query: exact, prefix, contained; then the same without accents."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    low, bare = F.lower(label), fold_accents(label)
    bare_q = q.translate(str.maketrans(ACCENTED, PLAIN))
    score = F.when(low == q, 1.0)
    if len(q.encode()) >= 3:
        score = score.when(bare == bare_q, 0.95)
    score = score.when(low.startswith(q), 0.9)
    if len(q.encode()) >= 3:
        score = score.when(bare.startswith(bare_q), 0.85)
    score = score.when(low.contains(q), 0.7)
    if len(q.encode()) >= 3:
        score = score.when(bare.contains(bare_q), 0.65)
    return score.otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a length is as good as 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    denominator = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(denominator < 1e-10, 0.0).otherwise(dot(a, b) / denominator)


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 1 for two empty texts."""
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def tokens(text: Column) -> Column:
    """Runs of letters, digits, _ and - of two bytes or more, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda t: F.octet_length(t) >= 2)


def sentences(text: Column) -> Column:
    """Sentences: up to a stop (five bytes or more) or a line end (ten or more), and the rest (five or more)."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+"), F.lit(0))
    trimmed = F.transform(pieces, lambda p: F.struct(p.endswith("\n").alias("line"), F.regexp_replace(p, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("s")))
    kept = F.filter(trimmed, lambda p: F.octet_length(p["s"]) >= F.when(p["line"], 10).otherwise(5))
    return F.transform(kept, lambda p: p["s"])


def chunk_windows(sents: Column, size: int = 5, overlap: int = 1) -> Column:
    """Windows of ``size`` sentences that share ``overlap``; the last one reaches the end."""
    step = max(1, size - overlap)
    n = F.size(sents)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.array_join(F.slice(sents, i * step + 1, F.lit(size)), " "))
    )


def kinds_of(channel: Column, obj: Column) -> tuple[Column, Column]:
    """Kinds of subject and object of a triplet."""
    subject = F.when(channel == "episodic", "event").otherwise("entity")
    measured = obj.contains("nm") | obj.contains("pLDDT") | obj.rlike(r"[0-9]")
    target = (
        F.when(channel == "alarm", "warning").when(channel == "episodic", "event").when(channel == "derives_de", "entity")
        .when(channel == "causal", F.when(measured, "measurement").otherwise("entity")).otherwise("concept")
    )
    return subject, target


def relation_channel(relation: Column) -> Column:
    """The channel a relation's words speak for."""
    r = F.lower(relation)
    has = lambda *w: r.rlike("|".join(w))
    return (
        F.when(has("derive", "based on", "version"), "derives_de").when(has("cause", "trigger", "produce"), "causal")
        .when(has("avoid", "incompatible", "error"), "alarm").otherwise("trail")
    )


def answer_normal(text: Column) -> Column:
    """An answer in lower case, punctuation as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"""[.,!?;:'"()\[\]]""", " "), r"\s+", " "))
