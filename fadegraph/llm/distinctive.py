"""How distinctive a term is per record, from counts of the whole collection.

``scores`` gives each term of each record its z-score: the log-odds ratio of the
record against the rest under an informative Dirichlet prior made from the
collection's counts (``PRIOR`` of all tokens), divided by its standard error.

``top_term`` gives the term a record's result is defined by, the heaviest by
occurrences times (ln(R / (d + 1)) + 1).  No z-score has a part in it, so it takes
``counted`` rows, without z-scores.  ``agreement`` compares the two: in how many
records the leader by z-score is the heaviest term.

Records are read and their terms counted once, into a table of (record, term,
count) in the shared folder; term statistics are combined on the map side and
joined back.  The ``HOT`` most frequent terms are joined on the map side (a bounded
table), so no term is a hot key of a shuffle.

Defined cases: a null rec_id is no record; a repeated rec_id counts once, by
its earliest row (then the smaller token array); null and blank tokens are no
terms; a record without terms counts in R and gives no row; an empty table
gives no rows; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.sources import materialise

PRIOR, TIE, HOT, HOT_BYTES = 0.1, 1e-9, 16_384, 64
# White space of Unicode.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def term(token: Column) -> Column:
    """A token in lower case without blanks around it."""
    return F.lower(F.trim(token, F.lit(BLANKS)))


def records(df: DataFrame) -> DataFrame:
    """(rec_id, tokens), one row per rec_id."""
    return (
        df.filter("rec_id IS NOT NULL")
        .groupBy("rec_id")
        .agg(F.min(F.struct("trained_at", "tokens"))["tokens"].alias("tokens"))
    )


def term_counts(recs: DataFrame, *of_record: str) -> DataFrame:
    """(rec_id, term, tf) of the terms of each record; with "size" also the number of all its terms."""
    clean = F.filter(F.transform("tokens", term), lambda t: t != "")
    return recs.select("rec_id", clean.alias("t")).select("rec_id", F.size("t").alias("size"), F.explode("t").alias("term")).groupBy("rec_id", *of_record, "term").agg(F.count("*").alias("tf"))


def counted(df: DataFrame, *of_record: str) -> DataFrame:
    """(rec_id, term, tf, d, c, n, records) for every term of every record, and what ``of_record`` names.

    d records hold the term, c times in all; n is the number of all terms of all records.
    """
    tf = materialise(term_counts(records(df), *of_record), "terms")
    stats = tf.groupBy("term").agg(F.count("*").alias("d"), F.sum("tf").alias("c"))
    hot = F.broadcast(stats.filter(F.octet_length("term") <= HOT_BYTES).orderBy(F.desc("d"), "term").limit(HOT))
    joined = tf.join(hot, "term").unionByName(tf.join(hot.select("term"), "term", "left_anti").join(stats, "term"))
    n = tf.agg(F.sum("tf").alias("n")).scalar()
    return joined.withColumns({"n": n, "records": df.agg(F.count_distinct("rec_id")).scalar()})


def scores(df: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(rec_id, term, tf, d, records, z) for every term of every record.

    ``prior`` is the Dirichlet prior's total mass as a share of all tokens, shared out by the collection's counts.
    """
    rows = counted(df, "size")
    mass = F.lit(prior) * F.col("n")
    a = F.lit(prior) * F.col("c")
    here, rest = F.col("tf") + a, F.col("c") - F.col("tf") + a
    other = lambda x, whole: F.greatest(whole + mass - x, F.lit(1e-9))
    delta = F.ln(here / other(here, F.col("size"))) - F.ln(rest / other(rest, F.col("n") - F.col("size")))
    return rows.select("rec_id", "term", "tf", "d", "records", (delta / F.sqrt(1 / here + 1 / rest)).alias("z"))


def weight() -> Column:
    """Occurrences times (ln(R / (d + 1)) + 1)."""
    return F.col("tf") * (F.ln(F.col("records") / (F.col("d") + 1)) + 1)


def top_term(rows: DataFrame, *also: Column) -> DataFrame:
    """(rec_id, term): the heaviest term of each record; one whose two heaviest terms weigh the same gives none.

    ``also`` are further aggregates over a record's terms, kept as columns.
    """
    # a record came in one row, so its terms fit one
    heavy = F.sort_array(F.collect_list(F.struct(weight().alias("w"), "term")), asc=False)
    best = rows.groupBy("rec_id").agg(F.slice(heavy, 1, 2).alias("two"), *also)
    first, second = F.col("two")[0], F.get("two", F.lit(1))
    clear = best.filter(second.isNull() | (first["w"] - second["w"] > TIE))
    return clear.withColumn("term", first["term"]).drop("two")


def agreement(scored: DataFrame) -> DataFrame:
    """(records, agreed): how many records have a heaviest term, and in how many the leader by z-score is that term."""
    leader = F.max(F.struct("z", "term"))["term"].alias("leader")
    return top_term(scored, leader).agg(F.count("*").alias("records"), F.count_if(F.col("leader") == F.col("term")).alias("agreed"))
