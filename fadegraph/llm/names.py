"""Variant spellings of person and organisation names: noisy-channel attribution.

1. Distinct spellings are counted over the whole input; everything after works on
   those.  Words with ``PARTNERS`` or more different partner words are role words, unless they are
   one edit from a word with ``SLIP`` times their partners:
   given names and words of organisations if mostly capitalised, else names of
   things.  A word that stands after "Surname," more often than before a comma is
   a given name with any number of partners.  The rest are the rare words that tell entities apart.
2. Each spelling is parsed into a rare word (surname, or an organisation's own
   word) and a spelling of its role part (given name, short form, initial,
   abbreviation; field and type of an organisation).  Spellings with digits or
   words of things are no names.
3. Channel: P(spelling | canonical role part), from known short forms, initials,
   abbreviations, single typos, and short forms learned from surnames that two
   given names share far more often than chance.
4. Candidates are (rare word, canonical role part), ranked by how much of all
   spellings supports them (the frequency prior).  A candidate one edit from a
   better supported one with the same role part is itself a variant of it.
5. Every spelling goes to the candidate of largest prior x typo likelihood x
   channel likelihood, and with it to that candidate's root.

One edit is an insertion, deletion, substitution or swap of neighbours; such
pairs share a word with one letter deleted, so candidates meet by equality
joins on (deleted form, role part).  The parser's tables hold at most
``ROLE_WORDS`` words or short forms of a kind and ten times as many spellings of
role parts; more of them is an error, none is dropped.

Defined cases: null, empty and blank names are none; a spelling of more than
eight words is no name; a surname or organisation word alone belongs to
nothing; of equally good candidates the smaller one by code points wins.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.sources import materialise

PARTNERS, ROLE_WORDS, WORDS_MOST, SLIP = 12, 20_000, 8, 8
TYPO = 0.05

# Words of organisations, titles and legal forms, and common short forms.
ORG_TYPES = (
    "institute university foundation group company works association laboratory corporation center centre society "
    "agency college bank council committee union federation academy museum hospital department ministry trust"
).split()
ORG_FIELDS = "research marine volcanic polar transport seismic optical botanical genomic heritage data".split()
ORG_SHORT = {
    "co": "company", "corp": "corporation", "wks": "works", "fdn": "foundation", "grp": "group", "assoc": "association",
    "univ": "university", "inst": "institute", "lab": "laboratory", "res": "research", "soc": "society", "dept": "department",
}
NOISE = frozenset("the ltd inc llc gmbh dr prof mr mrs ms sir".split())
GIVEN = (
    "robert william elizabeth margaret richard james alexander thomas edward susan anthony charles joseph theodora "
    "francisco jose johannes friedrich nicholas victoria michael patricia katherine genevieve ulrike viggo quentin "
    "xenia lucille zoltan wilma hedwig dagmar marisol ingrid odile laszlo yannick oscar john mary anna peter paul"
).split()
SHORT = {
    "robert": "bob rob bobby bert", "william": "bill will billy willy liam", "elizabeth": "liz beth betty eliza lisa",
    "margaret": "peggy maggie meg greta", "richard": "rick dick rich ricky", "james": "jim jamie jimmy",
    "alexander": "alex sasha xander sandy", "thomas": "tom tommy", "edward": "ted ed eddie ned", "susan": "sue suzie susie",
    "anthony": "tony ant", "charles": "chuck charlie", "joseph": "joe joey", "theodora": "thea dora",
    "francisco": "paco fran pancho", "jose": "pepe", "johannes": "hannes hans", "friedrich": "fritz fred",
    "nicholas": "nick klaus nico", "victoria": "vicky tori", "michael": "mike mick", "patricia": "pat trish patty",
    "katherine": "kate kathy kat", "genevieve": "eve ginny gen",
}
_LETTERS = r"\p{L}\p{M}"
_TOKEN = re.compile(r"[^\W\d_]+\.?|,")


def deletions(w: str) -> set[str]:
    """A word and all its forms with one letter less."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(b) - len(a) == 1:
        return a[i:] == b[i + 1 :]
    return len(a) == len(b) and (a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]))


class Lexicon:
    """What the parser knows: role words, and how role parts may be spelt."""

    def __init__(self, given: set[str], org: set[str], things: set[str], short: dict[str, set[str]]):
        fixed = set(ORG_TYPES) | set(ORG_FIELDS)
        # frequent abbreviations are no words of their own
        self.org = {w for w in org - set(ORG_SHORT) if not any(x != w and x.startswith(w) for x in org | fixed)} | fixed
        self.types = set(ORG_TYPES)
        self.things = things - self.org
        self.short = defaultdict(set, {k: set(v) for k, v in short.items()})
        sure = set(GIVEN) | set(short) | {g for v in short.values() for g in v}
        self.given = {w for w in given - sure if not any(x.startswith(w) for x in sure)} | sure - set(short) | set(GIVEN)
        self.given -= self.org
        self.words = self.given | set(self.short)
        self.typo = self._fuzzy(w for w in self.words if len(w) > 3)
        self.org_typo = self._fuzzy(w for w in self.org if len(w) > 3)

    @staticmethod
    def _fuzzy(words) -> dict[str, list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for w in sorted(words):
            for d in deletions(w):
                out[d].append(w)
        return out

    @staticmethod
    def _guess(w: str, table: dict[str, list[str]]) -> str | None:
        if len(w) < 3:
            return None
        hits = {x for d in deletions(w) for x in table.get(d, ()) if near(w, x)}
        return min(hits) if hits else None

    def _org_word(self, w: str, dotted: bool) -> str | None:
        if w in self.org:
            return w
        if w in ORG_SHORT and (dotted or len(w) > 2):
            return ORG_SHORT[w]
        if dotted and len(w) > 1:
            starts = [x for x in self.org if x.startswith(w)]
            if starts:
                return min(starts, key=lambda x: (x not in ORG_TYPES and x not in ORG_FIELDS, len(x), x))
        return None

    def parse(self, name: str) -> tuple[str, str, str, float] | None:
        """(kind, rare word, role spelling, typo factor) or None."""
        raw = _TOKEN.findall(name)
        tokens = [(t.rstrip(".").lower(), t.endswith("."), t) for t in raw]
        words = [t for t in tokens if t[2] != "," and (t[0] not in NOISE or (len(t[2]) == 2 and t[2].isupper()))]
        if not 2 <= len(words) <= WORDS_MOST or any(w in self.things for w, _, _ in words):
            return None
        return self._organisation(words, name) or self._person(tokens, words)

    def _organisation(self, words, name) -> tuple[str, str, str, float] | None:
        last = words[-1]
        if len(words) == 2 and len(last[0]) == 2 and last[2].isupper() and not name.isupper() and len(words[0][0]) > 3:
            return ("o", words[0][0], last[2], 1.0) if words[0][0] not in self.words else None
        known = [self._org_word(w, d) for w, d, _ in words]
        if not any(known):
            return None
        factor = 1.0
        rare = [i for i, k in enumerate(known) if k is None]
        if len(rare) > 1:
            for i in rare:
                hit = self._guess(words[i][0], self.org_typo)
                if hit and len(rare) > 1:
                    known[i], factor = hit, TYPO
                    rare = [j for j in rare if j != i]
        if len(rare) != 1 or words[rare[0]][0] in self.words:
            return None
        parts = [k for k in known if k]
        # a research group is one type
        if "research" in parts and "group" in parts:
            parts = [p for p in parts if p not in ("research", "group")] + ["research group"]
        kinds = [p for p in parts if p in self.types or p == "research group"]
        fields = [p for p in parts if p not in kinds]
        if len(kinds) > 1 or len(fields) > 1:
            return None
        return "o", words[rare[0]][0], f"{''.join(fields)}|{''.join(kinds)}", factor

    def _given(self, token) -> tuple[str, float] | None:
        w, dotted, _ = token
        if len(w) == 1:
            return f"{w}.", 1.0
        if dotted and any(x.startswith(w) for x in self.given):
            return f"{w}.", 1.0
        if w in self.words:
            return w, 1.0
        hit = self._guess(w, self.typo)
        return (hit, TYPO) if hit else None

    def _person(self, tokens, words) -> tuple[str, str, str, float] | None:
        comma = next((i for i, t in enumerate(tokens) if t[2] == ","), None)
        exact = lambda t: len(t[0]) == 1 or t[0] in self.words or (t[1] and self._given(t) is not None)
        if comma is not None:
            before = [t for t in tokens[:comma] if t[0] not in NOISE and t[2] != ","]
            after = [t for t in tokens[comma + 1 :] if t[0] not in NOISE and t[2] != ","]
            if len(before) != 1 or not after:
                return None
            surname, given = before[0], after
        else:
            rare = [t for t in words if not exact(t)]
            if len(rare) == 2:
                slips = [t for t in rare if self._guess(t[0], self.typo)]
                rare = [t for t in rare if t is not slips[0]] if slips else rare
            if len(rare) != 1:
                return None
            surname = rare[0]
            given = [t for t in words if t is not surname]
        x = self._given(given[0]) if given else None
        if x is None or len(surname[0]) < 3 or surname[0] in self.words or len(given) > 3:
            return None
        return "p", surname[0], x[0], x[1]

    def channel(self, spelt: set[tuple[str, str]]) -> list[tuple[str, str, str, float]]:
        """(kind, role spelling, canonical role part, likelihood) for the spellings met."""
        out = []
        fulls = sorted(self.given - {s for s in self.short if s not in GIVEN})
        by_first: dict[str, list[str]] = defaultdict(list)
        for g in fulls:
            by_first[g[0]].append(g)
        fields = sorted(self.org - self.types)
        for kind, x in sorted(spelt):
            if kind == "p":
                if x.endswith("."):
                    w = x[:-1]
                    hits = [g for g in by_first[w[0]] if g.startswith(w)]
                    out += [("p", x, g, 0.1) for g in hits]
                    out += [("p", x, g, 0.03) for s in self.short if s.startswith(w) and len(w) > 1 for g in self.short[s] if g not in hits]
                    out.append(("p", x, f"{w[0]}?", 0.001))
                else:
                    out += [("p", x, g, 0.15) for g in sorted(self.short[x])] if x in self.short else []
                    out.append(("p", x, x, 0.6 if x not in self.short or x in GIVEN else 0.01))
                    out.append(("p", x, f"{x[0]}?", 0.0005))
            elif "|" in x:
                field, kind_ = x.split("|")
                if field and kind_:
                    out.append(("o", x, x, 0.6))
                elif field:
                    out += [("o", x, f"{field}|{t}", 0.05) for t in [*sorted(self.types), "research group"]]
                    out.append(("o", x, x, 0.001))
            else:
                a, b = x[0].lower(), x[1].lower()
                out += [
                    ("o", x, f"{f}|{t}", 0.05)
                    for f in fields if f[0] == a and f != "research"
                    for t in [*sorted(self.types - {"group"}), "research group"] if t[0] == b
                ]
        return out


def _bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table for the parser; an error if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}; the parser's tables would not hold them all")
    return rows


def spellings(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, n): distinct names and how often each occurs, written to the shared folder."""
    return materialise(
        names.select(F.col(column).alias("name")).filter(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n")), "names"
    )


def _words(sp: DataFrame) -> DataFrame:
    """(name, word, capital, org) of spellings that could be names."""
    raw = sp.select("name", F.regexp_extract_all("name", F.lit(rf"[{_LETTERS}]+"), F.lit(0)).alias("ws")).filter(
        F.size("ws").between(2, WORDS_MOST)
    )
    org = F.arrays_overlap(F.transform("ws", F.lower), F.array(*map(F.lit, [*ORG_TYPES, "inst", "univ", "fdn", "grp", "wks", "assoc", "ltd"])))
    return raw.select("name", F.transform("ws", F.lower).alias("low"), org.alias("org"), F.explode("ws").alias("w")).select(
        "name", "low", "org", F.lower("w").alias("word"), (F.col("w").rlike(r"^\p{Lu}") & (F.upper("name") != F.col("name"))).alias("capital")
    )


def _slips(partners: dict[str, int]) -> set[str]:
    """Frequent typos: words one edit from a word with ``SLIP`` times their partners."""
    fixed = {*GIVEN, *ORG_TYPES, *ORG_FIELDS, *SHORT, *(x for s in SHORT.values() for x in s.split())}
    forms: dict[str, list[str]] = defaultdict(list)
    for w in partners:
        if len(w) > 3:
            for d in deletions(w):
                forms[d].append(w)
    return {
        w for w, n in partners.items() if w not in fixed and len(w) > 2
        and any(near(w, u) for d in deletions(w) for u in forms.get(d, ()) if u != w and partners[u] >= SLIP * n)
    }


def role_words(sp: DataFrame) -> tuple[set[str], set[str], set[str]]:
    """Given names, words of organisations, and words of things, by their partners."""
    words = _words(sp)
    partners = (
        words.select("word", F.explode("low").alias("other")).filter("word <> other").distinct()
        .groupBy("word").agg(F.count("*").alias("partners")).filter(F.col("partners") >= PARTNERS)
    )
    use = words.groupBy("word").agg(F.avg(F.col("capital").cast("int")).alias("capital"), F.avg(F.col("org").cast("int")).alias("org"))
    top = partners.join(use, "word").orderBy(F.desc("partners"), "word")
    top = _bounded(top, ROLE_WORDS, "role words")
    given, org, things = set(), set(), set()
    slips = _slips({r.word: r.partners for r in top})
    for r in top:
        if len(r.word) > 1 and r.word not in NOISE and r.word not in slips:
            (things if r.capital <= 0.5 else org if r.org > 0.5 else given).add(r.word)
    return given, org, things


def given_by_position(sp: DataFrame, org: set[str], things: set[str]) -> set[str]:
    """Unlisted given names, however few their partners: words that stand alone after 'Surname,' in more spellings than before the comma."""
    at = r"^\s*(\p{Lu}[\p{L}\p{M}]+)\s*,\s*(\p{Lu}[\p{L}\p{M}]+)\s*$"
    two = sp.filter(F.col("name").rlike(at)).select(*(F.lower(F.regexp_extract("name", at, i)).alias(c) for i, c in ((1, "before"), (2, "after"))))
    n = two.distinct().select(F.explode(F.array(*(F.struct(F.col(c).alias("word"), F.lit(v).alias("v"), F.lit(v > 0).cast("int").alias("g")) for c, v in (("before", -1), ("after", 1))))).alias("e"))
    votes = n.groupBy("e.word").agg(F.sum("e.v").alias("more"), F.sum("e.g").alias("n")).filter("more > 0")
    rows = {r.word: r.n for r in _bounded(votes, ROLE_WORDS, "given names by position")}
    fixed = {*GIVEN, *SHORT, *(x for s in SHORT.values() for x in s.split())}
    known = Lexicon._fuzzy(w for w in fixed if len(w) > 3)
    slips = _slips(rows)
    return {
        w for w in rows if len(w) > 2 and w not in slips and w not in NOISE and w not in ORG_SHORT and w not in ORG_TYPES and w not in ORG_FIELDS
        and w not in org and w not in things and (w in fixed or Lexicon._guess(w, known) is None)
    }


def _parsed(sp: DataFrame, lex: Lexicon) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = lex.parse
        for f in frames:
            rows = [(n, *p) for n in f["name"] if (p := parse(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "rare", "x", "slip"])

    no_digit = sp.filter(~F.col("name").rlike(r"\p{N}")).select("name")
    return materialise(no_digit.mapInPandas(run, "name string, kind string, rare string, x string, slip double"), "parsed")


def learned_short(parsed: DataFrame) -> dict[str, set[str]]:
    """Short forms met beside a full name at so many surnames that chance can't explain it."""
    seen = parsed.filter((F.col("kind") == "p") & (F.col("slip") == 1) & ~F.col("x").endswith(".")).select("rare", "x").distinct()
    n = seen.groupBy("x").agg(F.count("*").alias("n"))
    both = seen.alias("a").join(seen.select("rare", F.col("x").alias("g")).alias("b"), "rare").filter("x <> g").groupBy("x", "g").agg(F.count("*").alias("c"))
    rows = (
        both.join(n, "x").join(n.select(F.col("x").alias("g"), F.col("n").alias("ng")), "g")
        .filter((F.col("c") >= 4) & (F.col("c") >= 0.25 * F.col("n")) & (F.col("ng") > 2 * F.col("n")) & F.col("x").isin(GIVEN).eqNullSafe(False))
        .orderBy(F.desc("c"), "x", "g")
    )
    out: dict[str, set[str]] = defaultdict(set)
    for r in _bounded(rows, ROLE_WORDS, "learned short forms"):
        out[r.x].add(r.g)
    return out


def _forms(w: Column) -> Column:
    """A word and its forms with one letter less."""
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), cut))


def _one_edit(a: Column, b: Column) -> Column:
    """Words that share a form are one edit apart."""
    d = F.levenshtein(a, b)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def entities(names: DataFrame, forms: DataFrame, column: str = "name") -> DataFrame:
    """(name, kind, rare, role): every spelling with the canonical form it is attached to.

    ``forms`` has given and short_form: known short forms.
    """
    spark = names.sparkSession
    sp = spellings(names, column)
    given, org, things = role_words(sp)
    given |= given_by_position(sp, org, things)
    short: dict[str, set[str]] = defaultdict(set)
    for full, s in SHORT.items():
        for x in s.split():
            short[x].add(full)
    known = forms.filter("given IS NOT NULL AND short_form IS NOT NULL").select("given", "short_form").distinct()
    for r in _bounded(known, ROLE_WORDS, "known short forms"):
        short[r.short_form.strip().lower()].add(r.given.strip().lower())
    given |= {g for s in short.values() for g in s}
    lex = Lexicon(given, org, things, short)
    parsed = _parsed(sp, lex)
    for x, gs in learned_short(parsed).items():
        if x not in lex.short:
            lex.short[x] |= {g for g in gs if g not in lex.short}
    spelt = {(r.kind, r.x) for r in _bounded(parsed.select("kind", "x").distinct(), 10 * ROLE_WORDS, "spellings of role parts")}
    channel = spark.createDataFrame(lex.channel(spelt) or [("p", "", "", 0.0)], "kind string, x string, role string, fit double")
    # spelt out enough to make a candidate
    full = F.when(F.col("kind") == "p", ~F.col("x").endswith(".")).otherwise(F.col("x").rlike(r"[^|]\|[^|]"))
    rows = parsed.join(channel, ["kind", "x"]).select(
        "name", "kind", "rare", "role", (F.col("fit") * F.col("slip")).alias("fit"), (full | F.col("role").rlike(r"[?|]$")).alias("full")
    )
    rows = materialise(rows.filter("fit > 0"), "forms")

    key = ["kind", "rare", "role"]
    cand = materialise(
        rows.groupBy(*key).agg(F.sum("fit").alias("support"), F.max("full").alias("full")).filter("full"), "candidates",
    )
    by_form = cand.select(*key, "support", F.explode(_forms(F.col("rare"))).alias("form"))
    other = by_form.select("kind", "role", "form", F.col("rare").alias("to"), F.col("support").alias("to_support"))
    better = (F.col("to_support") > F.col("support")) | ((F.col("to_support") == F.col("support")) & (F.col("to") < F.col("rare")))
    parent = (
        by_form.join(other, ["kind", "role", "form"]).filter((F.col("rare") != F.col("to")) & better & _one_edit(F.col("rare"), F.col("to")))
        .groupBy(*key).agg(F.max(F.struct("to_support", F.col("to")))["to"].alias("root"))
    )
    roots = cand.join(parent, key, "left").select(*key, "support", F.coalesce("root", "rare").alias("root"))
    while True:  # a variant's variant: pointers are doubled until none moves; they go up in support, so there is no ring
        up = roots.select("kind", "role", F.col("rare").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(up, ["kind", "role", "root"]).select(*key, "support", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if not roots.filter("moved").limit(1).count():
            break
    roots = roots.drop("moved")

    spread = rows.select("name", *key, "fit", F.explode(_forms(F.col("rare"))).alias("form"))
    target = roots.select("kind", "role", F.col("rare").alias("to"), "support", "root", F.explode(_forms(F.col("rare"))).alias("form"))
    score = F.log("support") + F.log("fit") + F.when(F.col("rare") == F.col("to"), 0.0).otherwise(F.log(F.lit(TYPO)))
    return (
        spread.join(target, ["kind", "role", "form"]).filter(_one_edit(F.col("rare"), F.col("to")))
        .withColumn("score", F.round(score, 9))
        .groupBy("name", "kind")
        .agg(F.max_by(F.struct("root", "role"), F.struct("score", "root", "role")).alias("e"))
        .select("name", "kind", F.col("e.root").alias("rare"), F.col("e.role").alias("role"))
    )


def pairs(attached: DataFrame) -> DataFrame:
    """(name_a, name_b): different spellings attached to the same canonical form."""
    a = attached.select("kind", "rare", "role", F.col("name").alias("name_a"))
    b = attached.select("kind", "rare", "role", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "rare", "role"]).filter("name_a < name_b").select("name_a", "name_b")
