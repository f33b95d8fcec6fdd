"""Retrieval, evaluation, checks, tags, reports and replies against golden cases and brute force."""

import json
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clausewise.functions import replies
from clausewise.functions.words import words
from clausewise.plans import evaluation, lexical, matching, reports, retrieval, tags
from clausewise.sources import cases


def test_words(spark):
    want = {"Ab, c1-d": ["ab", "c1", "d"], "招标文件abc 中 中国": ["招标", "标文", "文件", "abc", "中", "中国"], "Größe été": ["größe", "été"], "件件件": ["件件", "件件"], "": [], "!?": [], "x中": ["x", "中"]}
    d = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.w for r in d.select("t", words(F.col("t")).alias("w")).collect()} == want


def cover_score(words_, terms):
    """Shortest runs that have every term and contain no shorter such run."""
    at = [i for i, w in enumerate(words_) if w in terms]
    runs = [(a, b) for a in at for b in at if a <= b and set(terms) <= set(words_[a : b + 1])]
    covers = [r for r in runs if not any(s != r and r[0] <= s[0] and s[1] <= r[1] for s in runs)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= i <= b for i in at) - 1)) for a, b in covers)


def test_lexical(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(60, None), (61, "zz")]
    queries = [(1, "a b c"), (2, "a"), (3, "e, f!"), (4, "nowhere a"), (5, ""), (6, None), (7, "b B b"), (8, "zz")]
    d, q = spark.createDataFrame(docs, "k int, text string"), spark.createDataFrame(queries, "q int, text string")
    got = {(r.q, r.k): r.score for r in lexical.covered(lexical.matches(d, "k", q, "q"), "q", "k").collect()}
    split = lambda t: re.findall("[a-z]+", (t or "").lower())
    want = {(i, k): cover_score(split(t), set(split(x))) for i, x in queries for k, t in docs if split(x) and set(split(x)) <= set(split(t))}
    assert got == pytest.approx(want)
    ranks = {}
    for r in lexical.ranked(d, "k", q, "q", 3).collect():
        ranks.setdefault(r.q, {})[r["rank"]] = r.k
    for i in ranks:
        best = sorted(((-round(s, 9), k) for (x, k), s in want.items() if x == i))[:3]
        assert [ranks[i][n + 1] for n in range(len(best))] == [k for _, k in best]


def brute_context(chain, i, short, most):
    text = (chain[i][1] or "").strip()
    if len(text) >= short:
        return text
    parts, total = [text], len(text)
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(chain) and (chain[j][0] or "") == (chain[i][0] or "") and (t := (chain[j][1] or "").strip()) and total + len(t) + 1 <= most:
            parts = [t, *parts] if step < 0 else [*parts, t]
            total += len(t) + 1
            j += step
    return "\n".join(parts)


def test_neighbours(spark):
    rng = random.Random(3)
    docs = {d: [(rng.choice([None, "A"]) if rng.random() < 0.1 else "B", rng.choice(["", None]) if rng.random() < 0.08 else "x" * rng.randint(1, 60)) for _ in range(rng.randint(1, 60))] for d in range(8)}
    rows = [(d, i, s, t) for d, c in docs.items() for i, (s, t) in enumerate(c)]
    chain = spark.createDataFrame(rows, "doc int, i int, s string, t string")
    got = {(r.doc, r.i): r.context for r in retrieval.with_neighbours(chain.select("doc", "i"), chain, ["doc"], "i", "s", "t", 40, 120).collect()}
    assert got == {(d, i): brute_context(docs[d], i, 40, 120) for d, i, _, t in rows if (t or "").strip()} | {(d, i): "" for d, i, _, t in rows if not (t or "").strip()}


def test_contained(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK", 2)
    docs = ["one e two e three", "onee twoe three", None, "", "e three e", "abc", "the very same e text e here", "the very same e text e here"]
    needles = ["e two e", "e very same e", "abc", "z", "o n e", "the verysamee texte", "the verysamee texte"]
    c = spark.createDataFrame(list(enumerate(needles)), "item_id int, text string")
    d = spark.createDataFrame([(None, t) for t in docs], "doc_id int, text string")
    flat = lambda t: t.replace(" ", "")
    want = {i: sum(flat(n) in flat(t) for t in docs if t is not None) for i, n in enumerate(needles)}
    assert {r.item_id: r.n_docs for r in evaluation.contained(c, d).collect()} == want


def test_golden_recall(spark):
    gold = {"requirements": [{"id": "a", "page": 1, "category": "x", "mandatory": True, "term_groups": [["One", "two"], ["three"]]}, {"id": "b", "page": 2, "category": "x", "term_groups": [["four"]]}], "project_fields": [{"id": "f", "page": 3, "field_code": "c", "terms": ["five", "six"]}], "thresholds": {"requirement_recall": 0.5, "mandatory_recall": 0.9}}
    g = spark.createDataFrame([(1, json.dumps(gold)), (2, None)], "k int, data string")
    terms = cases.golden_terms(g, "k", "data")
    assert [(r.kind, r.item, r.group, r.terms) for r in terms.orderBy("item", "group").collect()] == [("REQUIREMENT", "a", 0, ["One", "two"]), ("REQUIREMENT", "a", 1, ["three"]), ("REQUIREMENT", "b", 0, ["four"]), ("FIELD", "f", 0, ["five"]), ("FIELD", "f", 1, ["six"])]
    d = spark.createDataFrame([("s", "two three"), ("s", "four"), ("t", "one"), ("t", "three four five six"), ("u", None)], "scope string, text string")
    got = {r.scope: (r.n, r.found, r.recall, r.mandatory_recall, r.passed) for r in evaluation.golden_recall(terms, cases.thresholds(g, "k", "data"), d, "scope").collect()}
    assert got == {"s": (3, 2, 0.6667, 1.0, True), "t": (3, 2, 0.6667, 0.0, False), "u": (3, 0, 0.0, 0.0, False)}


@pytest.mark.parametrize("first,block", [(1, 4096), (3, 4096), (64, 4096), (3, 1)])
def test_golden_recall_brute(spark, monkeypatch, first, block):
    """Against brute force, with a scope that is null, equal items, missing texts and terms of any characters."""
    monkeypatch.setattr(evaluation, "FIRST", first, raising=False)
    monkeypatch.setattr(evaluation, "BLOCK", block)
    rng = random.Random(first)
    words = ["Ab", "bc d", "É", "ee", "x.y", "zz", "q"]
    gold = {f"i{i}": (i % 2 == 0, [rng.sample(words, rng.randint(1, 2)) for _ in range(rng.randint(1, 3))]) for i in range(12)}
    gold["same"] = (True, gold["i1"][1])
    docs = [(rng.choice(["s", "t", None]), " ".join(rng.sample(words + ["é", "ABC D"], 3))) for _ in range(14)] + [("u", None), (None, "")]
    terms = spark.createDataFrame([(i, m, k, g) for i, (m, groups) in gold.items() for k, g in enumerate(groups)], "item string, mandatory boolean, group int, terms array<string>")
    least = spark.createDataFrame([("requirement_recall", 0.3)], "name string, least double")
    got = {r.scope: (r.n, r.found, r.recall, r.mandatory_recall) for r in evaluation.golden_recall(terms, least, spark.createDataFrame(docs, "scope string, text string"), "scope").collect()}
    want = {}
    for scope in {s for s, _ in docs}:
        hit = {i: any(t is not None and all(any(x.lower() in t.lower() for x in g) for g in groups) for s, t in docs if s == scope) for i, (_, groups) in gold.items()}
        must = [i for i, (m, _) in gold.items() if m]
        want[scope] = (len(gold), sum(hit.values()), round(sum(hit.values()) / len(gold), 4), round(sum(hit[i] for i in must) / len(must), 4))
    assert got == want and any(0 < w[1] < len(gold) for w in want.values()) and want[None][1]


def test_eval_cases(spark):
    d = spark.createDataFrame([(1, json.dumps([{"scope": "project", "question": " q ", "expect": ["a", " "]}, {"scope": "x", "question": "", "expect": ["a"]}, {"question": "r", "expect": []}])), (2, "nonsense")], "k int, data string")
    assert [tuple(r) for r in cases.eval_cases(d, "k", "data").collect()] == [(1, 0, "project", "q", ["a"])]


PERSONS = "array<struct<role:string,certificate:string,years:int>>"


@pytest.mark.parametrize("persons,wanted,want", [
    ([("lead", "A", 12)], [("lead", "A", 8)], True), ([("lead", "A", 5)], [("lead", "A", 8)], False), ([("lead", "", 12)], [("lead", "A", 8)], None),
    ([("lead", "B", 12)], [("lead", "A", 8)], None), ([("lead", "A", None)], [("lead", "A", 8)], None), ([("other", "A", 12)], [("lead", "A", 8)], False),
    ([("x", "A", 1), ("lead", "A", 9)], [(" ", "A", 8)], True), ([("lead", "A", 9)], [("lead", "A", 8), ("boss", None, None)], False),
    ([("lead", "B", 9)], [("lead", "A", 8), ("boss", None, None)], None), ([], [("lead", None, None)], None), (None, [("lead", None, None)], None), ([("lead", "A", 9)], [], None), ([("lead", "A", 9)], None, None),
    ([("lead", "A", 1), ("lead", "A", 9)], [("lead", "A", 8)], True),
])
def test_personnel(spark, persons, wanted, want):
    d = spark.createDataFrame([Row(p=persons, w=wanted)], f"p {PERSONS}, w {PERSONS}")
    assert d.select(matching.personnel(F.lit("PERSONNEL"), F.col("p"), F.col("w")).alias("x")).first().x is want
    assert d.select(matching.personnel(F.lit("OTHER"), F.col("p"), F.col("w")).alias("x")).first().x is False
    assert d.select(matching.personnel(F.lit("PERSONNEL"), F.col("p"), F.col("w"), F.lit(False)).alias("x")).first().x is False


@pytest.mark.parametrize("have,asked,want", [
    ((100.0, 0.4, 3), (50.0, 0.5, 2), True), ((None, 0.9, 3), (50.0, 0.5, 2), None), ((10.0, None, 3), (50.0, 0.5, 2), False), ((100.0, 0.6, None), (50.0, 0.5, 2), False),
    ((100.0, 0.4, None), (50.0, 0.5, 2), None), ((1.0, 1.0, 1), (None, None, None), None), ((None, None, 2), (None, None, 2), True),
])
def test_financial(spark, have, asked, want):
    c = [F.lit(x).cast("double") for x in (*have, *asked)]
    assert spark.range(1).select(matching.financial(F.lit("FINANCE"), *c).alias("x")).first().x is want


@pytest.mark.parametrize("have,wanted,want", [
    ((5, 100.0, "road"), [(3, 50.0, "road")], True), ((2, 100.0, "road"), [(3, 50.0, "road")], False), ((None, 100.0, "road"), [(3, 50.0, None)], None),
    ((5, None, "road"), [(3, 50.0, None)], False), ((5, 100.0, "rail"), [(3, 50.0, "road")], None), ((5, 100.0, ""), [(3, None, "road")], None),
    ((None, 10.0, ""), [(3, None, "road"), (None, 50.0, None)], False), ((5, 1.0, "x"), None, None), ((5, 1.0, "x"), [None], None), ((5, 1.0, "x"), [], True),
])
def test_experience(spark, have, wanted, want):
    d = spark.createDataFrame([Row(n=have[0], a=have[1], s=have[2], w=wanted)], "n int, a double, s string, w array<struct<projects:int,amount:double,type:string>>")
    assert d.select(matching.experience(F.lit("PROJECT_EXPERIENCE"), F.col("n"), F.col("a"), F.col("s"), F.col("w")).alias("x")).first().x is want


def test_tags(spark):
    d = spark.createDataFrame([("工期要求", "look for “竣工日期” or \"工期\" or 「x」"), (None, None)], "n string, p string")
    assert [r.k for r in d.select(tags.keywords(F.col("n"), F.col("p")).alias("k")).collect()] == [["竣工日期", "工期"], []]
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c"), (3, 1, "d"), (3, 2, "a")], "place int, rank int, k string")
    assert sorted((r.place, r["rank"]) for r in tags.capped(found, "k", 3).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    c, s = spark.createDataFrame([(1, "x")], "code int, name string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "a")], "code int, name string")
    assert sorted(map(tuple, tags.seeded(c, s).collect())) == [(1, "x"), (2, "a")] and tags.seeded(tags.seeded(c, s), s).count() == 2
    v, p = spark.createDataFrame([("k", 1, True), ("k", 2, True), ("k", 3, False), ("m", 1, False)], "k string, v int, ok boolean"), spark.createDataFrame([("k", 1), ("m", 7)], "k string, v int")
    assert sorted(map(tuple, tags.activated(v, p, "k", "v", F.col("ok")).collect())) == [("k", 2), ("m", 7)]


def test_quotes(spark):
    ids = [f"0000000{i}-aaaa-bbbb-cccc-00000000000{i}" for i in range(3)]
    text = f"a【Evidence: {ids[0]}】b【Evidence:{ids[1]}】c【Evidence: {ids[2]}】 see {ids[0]}."
    quotes = {ids[0]: ("doc 第 3 页", "x  y\nz", None), ids[1]: ("doc", "q", "|t|")}
    d = spark.createDataFrame([Row(t=text, q=quotes), Row(t="", q={}), Row(t="x" + f"【Evidence: {ids[0]}】", q={ids[0]: ("d", "long " * 200, None)})], "t string, q map<string,struct<source:string,quote:string,table:string>>")
    got = [r.x for r in d.select(reports.render_quotes(F.col("t"), F.col("q")).alias("x")).collect()]
    assert got[0] == "a\n\n> 原文依据（doc 第 3 页）：x y zb\n\n**原文依据（doc）**\n\n|t|c see ." and got[1] == ""
    assert got[2] == "x\n\n> 原文依据（d）：" + ("long " * 200)[:500] + "……"


def test_replies(spark):
    good = [('{"items": [1, "a"]}', ["1", "a"]), ('```json\n{"items": ["say "hi" to", {"k": "v"}]}\n```', ['say "hi" to', '{"k":"v"}']), ('{"items": ["a \\"b\\" c"]}', ['a "b" c']), ('{"items": ["x" , "y"y" ]}', ["x", 'y"y']), ('{"items": {}}', None), ("[1]", None), ("no", None), (None, None), ('{"items": []}', []), ('{"items": ["cut', None)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(good)], "i int, t string")
    got = {r.i: r.x for r in d.select("i", replies.items(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(good))] == [w for _, w in good]


def test_lineage_backfill_as_its_sql(spark, tmp_path):
    """Null keys as in NOT IN, keys of several nations, and no join of customers with suppliers."""
    import duckdb

    import __spark_entry__

    tables = {
        "customer": ([(1, 1), (2, 2), (2, 3), (3, None), (4, 9)], "c_custkey long, c_nationkey long"),
        "supplier": ([(1, 1), (2, 2), (3, 3), (4, None), (5, 8)], "s_suppkey long, s_nationkey long"),
        "orders": ([(i, c) for i, c in enumerate([1, 2, 3, 4, 7, None])], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, s) for o in range(6) for s in [1, 2, 3, 4, 5, 6, None, 1]], "l_orderkey long, l_suppkey long"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["lineage_backfill"]).fetchall()
    got = __spark_entry__.queries()["lineage_backfill"](spark, str(tmp_path))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect()) and len(want) > 10
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
