"""The training-data operators against brute force and on dirty input."""
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fadegraph.llm import cooccurrence, distinctive, format_dups, mixture, names, neighbours, residue, survivorship, tokens

# -- 1 --------------------------------------------------------------------------------------------


def brute_pairs(rows, least, lift):
    bags = defaultdict(set)
    for node, tags in rows:
        if node is None:
            continue
        bags[node] |= {re.sub(r"^\W+|\W+$", "", t.lower()) for t in tags or [] if t} - {""}
    n, one, two = len(bags), Counter(), Counter()
    for b in bags.values():
        one.update(b)
        two.update(combinations(sorted(b), 2))
    return {(a, b, c) for (a, b), c in two.items() if c >= least and c * n >= lift * one[a] * one[b]}


def test_pairs(spark, monkeypatch):
    r = random.Random(1)
    rows = [(f"n{r.randrange(60)}", [r.choice(["a", "B", " b", "#c", "d-e", "", None, "é", "F ", "g"]) for _ in range(r.randrange(5))]) for _ in range(300)]
    rows += [(None, ["a", "b"]), ("big", [f"t{i}" for i in range(23)]), ("big", None), ("none", None)]
    df = spark.createDataFrame([(n, t, "clash", 1) for n, t in rows], "node_id string, tags array<string>, item_a string, c int")
    for block in (256, 4):
        monkeypatch.setattr(cooccurrence, "BLOCK", block)
        for least, lift in ((1, 0), (3, 1.2)):
            got = {(x.item_a, x.item_b, x.n_ab) for x in cooccurrence.pairs(df, "node_id", "tags", least, lift).collect()}
            assert got == brute_pairs(rows, least, lift)
    assert cooccurrence.pairs(df.limit(0), "node_id", "tags").count() == 0


# -- 3 --------------------------------------------------------------------------------------------

VEC = "vec_id bigint, vspace string, n_dim int, vec array<float>, id string, unit string"


def test_most_similar(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(40, 16))
    x = np.concatenate([base + 0.1 * g.normal(size=base.shape) for _ in range(9)])
    rows = [(i, "m", 16, [float(v) for v in row * g.uniform(0.1, 9)], "z", "z") for i, row in enumerate(x)]
    rows += [(1000 + i, "m", 16, rows[0][3], "z", "z") for i in range(9)] + [(5, "m", 16, rows[5][3], "z", "z")]
    rows += [(2001, "m", 16, None, "", ""), (2002, "m", 16, [], "", ""), (2003, "m", 16, [1.0], "", ""), (2004, "m", 16, [0.0] * 16, "", ""), (2005, "m", 16, [float("nan")] * 16, "", ""),
             (2006, "m", 16, [None] + [1.0] * 15, "", ""), (None, "m", 16, [1.0] * 16, "", ""), (3000, "lone", 16, [1.0] * 16, "", "")]
    df = spark.createDataFrame(rows, VEC)
    got = neighbours.most_similar(df, "vec_id", "vspace", "vec", "n_dim", 5, 0.5).collect()
    v = {r[0]: np.array(r[3], np.float32).astype(float) for r in rows if r[0] is not None and r[0] < 2000}
    v = {k: a / np.linalg.norm(a) for k, a in v.items()}
    ids = sorted(v)
    s = np.array([v[i] for i in ids]) @ np.array([v[i] for i in ids]).T
    want = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= 0.5), key=lambda j: (-round(s[i, j], 9), ids[j]))[:5]
        want |= {(a, ids[j]) for j in order}
    found = {(r.id, r.other) for r in got}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    assert {(r.other, r.score) for r in got if r.id == 1008} == {(0, 1.0), (1000, 1.0), (1001, 1.0), (1002, 1.0), (1003, 1.0)}
    assert neighbours.most_similar(df.limit(0), "vec_id", "vspace", "vec", "n_dim").count() == 0


def test_leaves_in_two_levels_and_blocks_lose_nothing(spark, monkeypatch):
    g = np.random.default_rng(5)
    base = g.normal(size=(120, 24))
    x = np.concatenate([base + 0.3 * g.normal(size=base.shape) for _ in range(8)])
    df = spark.createDataFrame([(i, "m", 24, [float(v) for v in row], "z", "z") for i, row in enumerate(x)], VEC)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}

    def recall():
        return len({(r.id, r.other) for r in neighbours.most_similar(df, "vec_id", "vspace", "vec", "n_dim", 5).collect()} & want) / len(want)

    monkeypatch.setattr(neighbours, "LEAF", 40)
    assert recall() >= 0.9
    for name, value in (("MAX_LEAVES", 6), ("CODE_BLOCK", 50), ("QUERY_BLOCK", 16)):
        monkeypatch.setattr(neighbours, name, value)
    assert recall() >= 0.9


def test_quantiser_weighs_parallel_error():
    g = np.random.default_rng(0)
    x = g.normal(size=(600, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    *_, book = neighbours.fit(x, 8)
    plain = np.stack([((x.reshape(600, 32, 1, 2) - book[None])[:, j] ** 2).sum(2).argmin(1) for j in range(32)], 1).astype(np.uint8)
    along = lambda c: np.abs(((x - neighbours._decoded(c, book)) * x).sum(1)).mean()
    assert along(neighbours.encode(x, book)) < along(plain)
    codes = neighbours.encode(x, book)
    assert (neighbours._unpack(neighbours._pack(codes), 32) == codes).all()


# -- 4 --------------------------------------------------------------------------------------------

EDGE = "ord bigint, src string, dst string, channel string, confidence double, last_touch timestamp_ntz, source string, provenance string, k string, n int"


def test_survivors(spark):
    import datetime as d

    t = lambda y, m=1: d.datetime(y, m, 1)
    rows = [
        (3, "A-1", "b", "Trail", 0.5, t(2024), "x/y1", "automated", "k", 1), (1, "a-1 ", "B", "trail", 2.0, t(2025), "n/a", "Human", "k", 1),
        (2, "a-1", "b", "TRAIL", 0.9, t(2031), "q/w2", "ai_inferred", "k", 1), (7, "a-1", "b", "tra_il", float("nan"), t(2025), "", "tbd", "k", 1),
        (4, "z", "b", "trail", 0.5, None, None, None, None, None), (5, None, "b", "trail", 0.5, None, None, None, None, None), (6, None, "b", "trail", 0.5, None, None, None, None, None),
        (8, "e", "f", "alarm", None, None, None, None, None, None), (9, "e", "f", "alarm", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, EDGE)
    got = {(r.group_ord, r.attr, r.ord) for r in survivorship.winners(df).collect()}
    assert got == {(1, "confidence", 2), (1, "provenance", 1), (1, "last_touch", 1), (1, "source", 2)}
    g = survivorship.golden(df).collect()
    assert len(g) == 1 and g[0].confidence == "0.9" and g[0].provenance == "Human" and g[0].source == "q/w2"
    v = {(r.attr, r.value) for r in survivorship.votes(df).collect()}
    assert ("provenance", "human") in v
    assert survivorship.winners(df.limit(0)).count() == 0


# -- 5 --------------------------------------------------------------------------------------------


def test_one_edit():
    assert names.near("abc", "abc") and names.near("abc", "acb") and names.near("abc", "ab") and names.near("abc", "abxc") and names.near("abc", "axc")
    assert not names.near("abc", "axx") and not names.near("abc", "cab")


def test_names(spark):
    groups = [
        ["Robert Kanezuvo", "Bob Kanezuvo", "Kanezuvo, Robert", "R. Kanezuvo", "Robe. Kanezuvo", "robert kanezuvo", "Dr Robert Kanezuvo", "Robert Q. Kanezuvo", "Robert Kanzuvo", "Roebrt Kanezuvo", "KANEZUVO, Robert"],
        ["Susan Kanezuvo", "Kanezuvo, Sue"],
        ["Melodiru Polar Institute", "The Melodiru Polar Institute", "Melodiru Polar Inst.", "Melodiru PI", "Institute Melodiru Polar", "Melodriu Polar Institute", "MELODIRU POLAR INSTITUTE", "Melodiru Polar"],
        ["Melodiru Marine Works", "Melodiru Mar. Wks."],
    ]
    other = ["Kanezuvo", "Melodiru", "probe kanezuvo 2", "Kanezuvo probe 3", None, "", "  ", "x" * 500, "a b c d e f g h i j k"]
    df = spark.createDataFrame([(n,) for g in groups for n in g + g[:1]] + [(n,) for n in other], "name string")
    forms = spark.createDataFrame([("Robert", "Bob"), (None, "x"), ("Susan", "Sue")], "given string, short_form string")
    got = {(r.name_a, r.name_b) for r in names.pairs(names.entities(df, forms)).collect()}
    assert got == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    assert names.pairs(names.entities(df.limit(0), forms.limit(0))).count() == 0


def test_rare_given_names_by_position(spark):
    groups = [["Ottokar Kanezuvo", "Kanezuvo, Ottokar", "O. Kanezuvo"], ["Robert Melodiru", "Melodiru, Robert", "Roebrt Melodiru", "Melodiru, Roebrt"]]
    df = spark.createDataFrame([(n,) for g in groups for n in g + g[:1]], "name string")
    got = {(r.name_a, r.name_b) for r in names.pairs(names.entities(df, spark.createDataFrame([], "given string, short_form string"))).collect()}
    assert got == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}


def test_names_drop_no_words(spark, monkeypatch):
    df = spark.createDataFrame([("Robert Kanezuvo",), ("Bob Kanezuvo",)], "name string")
    forms = spark.createDataFrame([("Robert", "Bob"), ("Susan", "Sue"), ("Susan", "Suze")], "given string, short_form string")
    monkeypatch.setattr(names, "ROLE_WORDS", 2)
    with pytest.raises(ValueError, match="known short forms"):
        names.entities(df, forms)
    assert names.pairs(names.entities(df, forms.limit(2))).count() == 1


# -- 6 --------------------------------------------------------------------------------------------


def test_format_copies(spark):
    r = random.Random(2)
    words = ["Ab", "a_b", "A-B ", "cd", "C,d", "", None, "é1"]
    rows = [(i, r.choice(words), r.choice(words[:3])) for i in range(400)] + [(i, "hot", "hot") for i in range(1000, 1400)] + [(None, "a", "a"), (3, "a", "b")]
    df = spark.createDataFrame([(*x, "tbl", 1) for x in rows], "id bigint, a string, b string, key string, keep int")
    rec = format_dups.canonical(df, "t", "id", ["a", "b"])
    norm = lambda x: re.sub(r"[\W_]+", "", (x or "").lower())
    g = defaultdict(set)
    for i, a, b in rows:
        if i is not None:
            g[norm(a), norm(b)].add(i)
    want = {(min(v), x) for v in g.values() for x in v if x != min(v)}
    got = [(x.keep_id, x.copy_id) for x in format_dups.copies(rec).collect()]
    assert set(got) == want and len(got) == len(want)
    assert format_dups.copies(rec.limit(0)).count() == 0
    counts = {x.keep_id: x.copies for x in format_dups.counted(rec.filter("id >= 1000")).collect()}
    assert counts == {1000: 400}


def test_json_copies(spark):
    rows = [(1, '{"subject":"A b","relation":"r","object":"o","confidence":0.90}'), (2, '{ "Object":"(o)", "CONFIDENCE":9e-1,\n"subject":"a_B","Relation":"R."}'),
            (3, '{"subject":"A b","relation":"r","object":"o","confidence":0.91}'), (4, '{"subject":"A b","relation":"r"'), (5, '{"subject":"A b","relation":"r"'), (6, None), (7, "[]")]
    df = spark.createDataFrame(rows, "raw_id bigint, payload string")
    assert [(x.keep_id, x.copy_id) for x in format_dups.copies(format_dups.canonical_json(df, "r", "raw_id", "payload")).collect()] == [(1, 2)]


# -- 7 --------------------------------------------------------------------------------------------


def test_distinctive(spark):
    rows = [(1, ["a", "A ", "b", None, " "]), (1, ["a", "A ", "b", None, " "]), (2, ["b", "c"]), (3, []), (4, None), (None, ["z"]), (5, ["b"])]
    df = spark.createDataFrame([(i, None, t, "x", 1) for i, t in rows], "rec_id bigint, trained_at timestamp_ntz, tokens array<string>, term string, d int")
    w = {(r.rec_id, r.term): r.w for r in distinctive.scores(df).withColumn("w", distinctive.weight()).collect()}
    assert w[1, "a"] == pytest.approx(2 * (math.log(5 / 2) + 1)) and w[5, "b"] == pytest.approx(math.log(5 / 4) + 1) and len(w) == 5
    for prior in (0.1, 50.0):  # the rows hold whatever the prior
        top = {(r.rec_id, r.term) for r in distinctive.top_term(distinctive.scores(df, prior)).collect()}
        assert top == {(1, "a"), (2, "c"), (5, "b")}
    tie = spark.createDataFrame([(1, None, ["p", "q"])], "rec_id bigint, trained_at timestamp_ntz, tokens array<string>")
    assert distinctive.top_term(distinctive.scores(tie)).count() == 0
    z = {(r.rec_id, r.term): r.z for r in distinctive.scores(df).collect()}
    assert z[1, "a"] > z[1, "b"]
    assert distinctive.scores(df.limit(0)).count() == 0


def test_top_term_needs_no_z_score(spark, monkeypatch, tmp_path):
    from fadegraph.llm.queries import QUERIES

    # in record 1 x is in fewer records, so the heaviest; y has the higher z-score, as record 2 holds x fifty times
    rows = [(1, ["x", "y"]), (2, ["x"] * 50), (3, ["y"]), (4, ["Y "]), (4, ["y"]), (5, ["p", "q"]), (6, None), (None, ["x"])]
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "rec_id bigint, trained_at timestamp_ntz, tokens array<string>")
    df.write.parquet(f"{tmp_path}/hdc_records.parquet")
    want = [(1, "x"), (2, "x"), (3, "y"), (4, "y")]
    z = {(r.rec_id, r.term): r.z for r in distinctive.scores(df).collect()}
    assert z[1, "y"] > z[1, "x"]
    agreed = QUERIES["p7_agreement"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in agreed] == [(4, 3)]  # in p7_agreement the z-score counts
    monkeypatch.setattr(distinctive, "scores", None)  # p7_found must do without
    found = QUERIES["p7_found"](spark, str(tmp_path))
    assert found.columns == ["rec_id", "term"] and sorted(map(tuple, found.collect())) == want
    rare = distinctive.counted(df)
    assert "size" not in rare.columns  # only the z-score asks for it
    assert {tuple(r) for r in rare.filter("term = 'x'").select("rec_id", "tf", "d", "c", "n", "records").collect()} == {(1, 1, 2, 51, 56, 6), (2, 50, 2, 51, 56, 6)}


# -- 8 --------------------------------------------------------------------------------------------

TEXTS = ["", None, "   ", " a  b\n\n c", "I'm don't we'LL", "héé 日本  x y", "🙂🙂 tail ", "x" * 3000, "a\tb\r\n", "123 456abc", "\u0085​﻿z", "<|endoftext|>", " \n \n"]


def test_encode_and_decode(spark, monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, x, 0, "w") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:4] + [(99, "two", 0, "w"), (99, "texts", 0, "w")], "doc_id bigint, text string, pos int, word string")
    for hot in (16_384, 3):
        monkeypatch.setattr(tokens, "HOT", hot)
        got = tokens.encode(df).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            if r.doc_id < 99:
                assert list(r.ids) == t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df.filter("doc_id < 99"))).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    n = {r.doc_id: r.n_tokens for r in tokens.token_counts(df.filter("doc_id = 4"), ["doc_id"]).collect()}
    assert n == {4: len(t.encode(TEXTS[4]).ids)}
    assert tokens.encode(df.limit(0)).count() == 0


# -- 9 --------------------------------------------------------------------------------------------


def test_flight_keeps_totals():
    g = np.random.default_rng(5)
    p, size = g.uniform(0, 1, 500), g.integers(1, 900, 500).astype(float)
    q = mixture.flight(p, size, np.random.default_rng(1))
    open_ = ((q > 0) & (q < 1)).sum()
    assert open_ <= 2 and q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)
    assert set(mixture.landing(q, size)) <= {0.0, 1.0}
    mean = np.mean([mixture.landing(mixture.flight(p[:12], size[:12], np.random.default_rng(i)), size[:12]) for i in range(3000)], 0)
    assert np.abs(mean - p[:12]).max() < 0.12


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 32)
    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else "cold", r.randrange(1, 400)) for i in range(900)] + [(9000 + i, "tiny", 50) for i in range(4)] + [(9999, None, 5), (9998, "other", 5), (9997, "hot", 0)]
    docs = spark.createDataFrame([(*x, "p", "h") for x in rows], "doc_id bigint, source string, n_tokens bigint, uid string, h string")
    targets = spark.createDataFrame([("hot", 0.5, 1), ("cold", 0.48, 2), ("tiny", 0.02, 9), ("tiny", 0.01, 3), (None, 0.1, 1), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixture.mixture(docs, targets)
    got = m.collect()
    assert len({x.doc_id for x in got}) == len(got) and all(x.uses <= {"hot": 1, "cold": 2, "tiny": 9}[x.source] for x in got)
    s = {x.source: x.share for x in mixture.shares(m, targets).collect()}
    assert s["gone"] == 0 and abs(s["hot"] - 0.5) < 0.01 and abs(s["cold"] - 0.48) < 0.01 and abs(s["tiny"] - 0.02) < 0.005
    assert sorted((x.doc_id, x.uses) for x in mixture.mixture(docs, targets).collect()) == sorted((x.doc_id, x.uses) for x in got)
    assert mixture.mixture(docs.limit(0), targets).count() == 0


# -- 10 -------------------------------------------------------------------------------------------

RESIDUE = [
    "Dear {{first_name}}, the node was merged on 2024-01-01.", "Report on x\nOwner: [owner to be added]", "This page describes XXXX.", "The value is $[unit] nm.",
    "# Title here\n\nLorem ipsum dolor sit amet. Labore magna aliqua sed tempor.", "<h1>404 Not Found</h1>\n<p>Request id 12</p>", "beacon digifosa Please enable JavaScript to continue. [Back] [Retry]",
    "Zugriff verweigert\nHome > Notes > lumen", "TBD. TBD. TBD.", "Texte à venir. À rédiger.", '{"error": "Internal Server Error", "status": 500}',
]
CONTENT = [
    "", None, "  \n ", "The parser of x fails on `{{name}}` when a brace is missing.", "In the mail builder, write ${user} for the reader's name and keep %DATE% untouched.",
    'Readers without JavaScript see the line "Please enable JavaScript" instead of the graph view; the probe now draws it on the server.',
    "Reviewers swapped the lorem ipsum paragraph for measured values on 2023-02-06.", "The crawler stored a page reading \"404 Not Found\" under the relay; the edge was dropped by hand.",
    "```\nfn f(edges: &[Edge], k: usize) -> Vec<f32> { }\n```\nThe measured value was 3 nm and the second reading confirmed it.", "No alarm was raised, though memory pressure went on for 68 minutes.",
    "Template fields such as [PROJECT NAME] are filled by the relay before the note is saved.",
]


def test_residue(spark, monkeypatch):
    rows = [(i, x, "s", "c", 1) for i, x in enumerate(RESIDUE)] + [(100 + i, x, None, "c", 1) for i, x in enumerate(CONTENT)] + [(500, RESIDUE[0] + " " + "y " * 50_000, "s", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, seg string, n int")
    for hot in (8_192, 2):
        monkeypatch.setattr(residue, "HOT", hot)
        got = {r.doc_id for r in residue.residue(df).collect()}
        assert got == {*range(len(RESIDUE)), 500}
    assert residue.residue(df.limit(0)).count() == 0
    again = spark.createDataFrame([(i, "TBD.", "s") for i in range(4)], "doc_id bigint, text string, source string")
    assert [(r.message, r.n) for r in residue.messages(again).collect()] == [("TBD.", 4)]


def test_message_sources_are_exact(spark):
    docs = spark.createDataFrame([(i, "TBD.", f"s{i % 1999}") for i in range(4000)], "doc_id bigint, text string, source string")
    assert [tuple(r) for r in residue.messages(docs).collect()] == [("TBD.", 4000, 1999)]


def test_scan_carries_runs_over_batches():
    key = ["a", "a", "b", "b", "b", "c"]
    f = pd.DataFrame({"tbl": "t", "key": key, "id": [1, 2, 3, 4, 9, 5], "keep": 0, "n": 1, "part": 0, "edge": False})
    whole = pd.concat(format_dups._scan(iter([f.copy()])))
    split = pd.concat(format_dups._scan(iter([f.iloc[:1].copy(), f.iloc[1:3].copy(), f.iloc[3:].copy()])))
    pick = lambda x: sorted(map(tuple, x[~x["edge"].astype(bool)][["key", "id", "keep"]].values.tolist()))
    assert pick(whole) == pick(split) and ("b", 9, 3) in pick(whole)
