"""Golden cases and brute force for plans that SQL can't express, and for edge cases of those it can."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clausewise.functions import text as T
from clausewise.functions import values as V
from clausewise.operators import ranking, scores, visibility
from clausewise.plans import chunking, evaluation, findings, matching, rules, states
from clausewise.streaming import flows


@pytest.mark.parametrize("sizes,most_items,most,overhead,want", [([1800] * 10, 6, 9000, 0, [5, 5]), ([1500] * 16, 10, 10_000, 160, [6, 6, 4]), ([20_000, 1], 6, 9000, 0, [1, 1])])
def test_packs(spark, sizes, most_items, most, overhead, want):
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k int, i int, n long")
    got = chunking.pack_batches(d, "k", "i", "n", most_items, most, overhead).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == want


def test_diverse_prefers_what_differs(spark):
    d = spark.createDataFrame([(1, 1, 0.95, ["a", "b", "c"]), (1, 2, 0.94, ["a", "b", "c"]), (1, 3, 0.80, ["x", "y"]), (2, 9, 0.0, ["a"])], "q int, id int, score double, words array<string>")
    got = {(r.q, r.place): r.id for r in chunking.diverse(d, "q", 3).collect()}
    assert got == {(1, 0): 1, (1, 1): 3, (1, 2): 2, (2, 0): 9}


def test_budget(spark):
    d = spark.createDataFrame([(1, 1, "abcdefgh"), (1, 2, "ijklmnop"), (1, 3, "q")], "k int, i int, t string")
    assert [r.t for r in ranking.clip_to_budget(d, ["k"], ["i"], "t", 12, 100).orderBy("i").collect()] == ["abcdefgh", "ijkl"]
    assert [r.t for r in ranking.clip_to_budget(d, ["k"], [F.desc("i")], "t", 4, 100, from_end=True).orderBy("i").collect()] == ["nop", "q"]


@pytest.mark.parametrize("conditions,confirmed,to,want", [
    ([], True, None, "MATCHED"), ([True, None], True, None, "UNCERTAIN"), ([None, False], True, None, "MISSING"),
    ([True], False, None, "MISSING"), ([True], True, "2020-01-01", "MISSING"), ([True, True], True, "2030-01-01", "MATCHED"),
])
def test_evaluate(spark, conditions, confirmed, to, want):
    c = [F.lit(x).cast("boolean") for x in conditions]
    status = matching.evaluate(c, F.lit(confirmed), F.lit(to).cast("date"), F.lit("2024-01-01").cast("date"))
    assert spark.range(1).select(status.alias("s")).first().s == want


def test_best_material_of_missing_is_none(spark):
    d = spark.createDataFrame([(1, 10, "MISSING"), (1, 11, "MISSING"), (2, 12, "UNCERTAIN"), (2, 13, "MATCHED"), (2, 14, "MATCHED")], "r int, m int, status string")
    assert {(x.r, x.m, x.status) for x in matching.best_material(d, "r", "m").collect()} == {(1, None, "MISSING"), (2, 13, "MATCHED")}


def test_decisions(spark):
    m = spark.createDataFrame([(1, "MATCHED"), (2, "MATCHED"), (3, "MISSING")], "k int, final_status string")
    r = spark.createDataFrame([(1, "HIGH", "OPEN"), (2, "HIGH", "CLOSED"), (4, "LOW", "OPEN")], "k int, severity string, status string")
    assert {x.k: (x.score, x.decision) for x in matching.decision(m, r, "k").collect()} == {1: (100.0, "NO_BID"), 2: (100.0, "BID"), 3: (0.0, "PENDING"), 4: (0.0, "PENDING")}


def condition(**c):
    return {"all": [{"source": "project", **c}], "message_template": "m", "evidence_selector": {"source": "project"}}


@pytest.mark.parametrize("c,want", [
    ({"field": "a", "op": "GT", "value": "3"}, [4]), ({"field": "a", "op": "LTE", "value": 2}, [1, 2]), ({"field": "a", "op": "GT", "value": "x"}, []),
    ({"field": "a", "op": "EXISTS"}, [1, 2, 4]), ({"field": "a", "op": "NOT_EXISTS"}, [None]), ({"field": "a", "op": "IN", "value": [1, 4]}, [1, 4]),
    ({"field": "a", "op": "IN", "value": 1}, []), ({"field": "a", "op": "NE", "value": 1}, [2, 4, None]), ({"field": "a", "op": "EQ", "value": {"source": "project", "field": "b"}}, [2]),
    ({"field": "at", "op": "LT_NOW"}, [1]), ({"field": "at", "op": "DATE_BEFORE", "value": "2030-01-01"}, [1]), ({"source": "material", "field": "to", "op": "DATE_BEFORE", "value": {"source": "project", "field": "at"}}, [1, 2]),
])
def test_rules(spark, c, want):
    d = spark.createDataFrame([(1, 9, "2001-01-01"), (2, 2, "2999-01-01"), (4, None, None), (None, 1, "no date")], "a int, b int, at string")
    rule = condition(**c)
    rules.validate(rule, {"a", "b", "at"}, builtin=True)
    if c["op"] == "DATE_BEFORE":
        with pytest.raises(rules.InvalidRule):
            rules.validate(rule, {"a", "b", "at"})
    d = d.withColumn("material", F.struct(F.lit("2000-05-05").alias("to")))
    assert sorted((r.a for r in d.where(rules.compile_rule(rule)).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bad", [{}, condition(field="z", op="EQ", value=1), condition(field="a", op="LIKE", value=1), {**condition(field="a", op="EQ"), "all": []}, {**condition(field="a", op="EQ"), "more": 1}, condition(field="a", op="EQ", extra=1), condition(field="a", op="EQ"), condition(field="a", op="EQ", value={"x": 1}), condition(field="a", op="IN", value=[{}]), {**condition(field="a", op="EXISTS"), "message_template": " "}, {**condition(field="a", op="EXISTS"), "evidence_selector": {}}, condition(source="material", field="a", op="EXISTS")])
def test_invalid_rules(bad):
    with pytest.raises(rules.InvalidRule):
        rules.validate(bad, {"a"})


def test_reviewed_risks_keep_their_status(spark):
    found = spark.createDataFrame([(1,), (2,)], "k int")
    kept = spark.createDataFrame([(2, "ACCEPTED"), (3, "OPEN")], "k int, status string")
    assert {(r.k, r.status) for r in rules.merge_reviewed(found, kept, ["k"]).collect()} == {(1, "OPEN"), (2, "ACCEPTED")}


def test_values(spark):
    d = spark.createDataFrame([("5000万元", "12％"), ("3,000", "0.5"), ("2亿", "45"), ("none", None)], "m string, r string")
    got = d.select(V.money(F.col("m")).cast("double").alias("m"), V.ratio(F.col("r")).alias("r"), V.whole(F.col("m")).alias("w")).collect()
    assert [(x.m, x.r, x.w) for x in got] == [(5e7, 0.12, None), (3000.0, 0.5, None), (2e8, 0.45, None), (None, None, None)]


def test_times(spark):
    want = {"2024-05-01": ("2024-05-01 00:00:00", "2024-04-30 16:00:00"), "2024-05-01T10:00:00Z": ("2024-05-01 10:00:00",) * 2, "2024-05-01 10:00:30+08:00": ("2024-05-01 02:00:30",) * 2, "2024-05-01T10:00-0530": ("2024-05-01 15:30:00",) * 2, "2024-05-01T10:00": ("2024-05-01 10:00:00", "2024-05-01 02:00:00"), "2024-05-01T10:00:00.250z": ("2024-05-01 10:00:00.25",) * 2, "2024-13-01": (None, None), "May": (None, None)}
    d = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: (r.a, r.b) for r in d.select("t", V.iso_time(F.col("t")).cast("string").alias("a"), V.deadline(F.col("t")).cast("string").alias("b")).collect()}
    assert got == want


def test_places(spark):
    rows = [("a", i) for i in (5, 1, 90, 91, 250, 251, 252)] + [(None, i) for i in (3, 400)]
    d = spark.createDataFrame(rows, "k string, i int")
    got = {(r.k, r.i): r.place for r in ranking.placed(d, ["k"], "i", "place", width=100).collect()}
    assert got == {(k, i): sorted(j for x, j in rows if x == k).index(i) + 1 for k, i in rows}


def test_normal_forms(spark):
    d = spark.createDataFrame([("Ａ​ b\r\n\r\n  c\t\td  ",), (None,)], "t string")
    assert [r.t for r in d.select(T.normalized(F.col("t")).alias("t")).collect()] == ["A b\nc d", None]
    assert [r.t for r in d.select(T.normalized(F.col("t"), drop_format=False).alias("t")).collect()] == ["A​ b\nc d", None]


def test_states(spark):
    log = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "A"), (2, 1, "B")], "k int, i int, s string")
    assert [(r.k, r.i, r.prev) for r in states.illegal(log, ["k"], ["i"], "s", [("A", "B")]).collect()] == [(1, 3, "B")]


def test_findings(spark):
    d = spark.createDataFrame([("Late  bid", 1, 2, "x"), (" late bid", 2, 5, "longer"), ("other", 3, 1, "y")], "title string, id int, severity int, description string")
    got = {r.title: (r.n_ids, r.ids, r.severity, r.description) for r in findings.merge(d).collect()}
    assert got == {"late bid": (2, [1, 2], 5, "longer"), "other": (1, [3], 1, "y")}
    v = spark.createDataFrame([(1, "p", 0.8, 1), (1, "q", 0.9, 2), (1, "p", 0.1, 3)], "k int, v string, c double, i int")
    got = findings.merge_values(v.withColumn("v", F.to_variant_object(F.array("v"))), ["k"], "v", "c", ["i"]).first()
    assert (got["values"], got.confidence, len(got.sources)) == (['"p"', '"q"'], 0.9, v.count())


@pytest.mark.parametrize("block", [1, 10])
def test_contained_short_and_long(spark, monkeypatch, block):
    monkeypatch.setattr(evaluation, "BLOCK", block)
    cases = spark.createDataFrame([(1, "short one"), (2, "a text of more than twenty four characters"), (3, "never")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx short  one"), (2, "a text of more thantwenty four characters!"), (3, ""), (4, None)], "doc_id long, text string")
    assert {r.item_id: r.n_docs for r in evaluation.contained(cases, docs).collect()} == {1: 1, 2: 1, 3: 0}


def test_visibility(spark):
    d = spark.createDataFrame([(1, "50%_x"), (2, "500"), (3, None)], "k int, c string")
    assert [r.k for r in d.where(visibility.any_like(["c"], "%_")).collect()] == [1]
    assert d.where(visibility.any_like(["c"], "")).count() == 3
    assert visibility.visible(d, d.where("k = 2"), "k", admin=False).count() == 1


def test_jaccard_of_nothing(spark):
    d = spark.createDataFrame([([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r.j for r in d.select(scores.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.0, 0.0]


def stream(spark, tmp_path, rows, schema, files=1):
    parts = [rows[i::files] for i in range(files)] if files > 1 else [rows]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")


def test_reasoning_is_hidden_across_chunks(spark, tmp_path):
    chunks = ["Hello <th", "ink>secret", " more</thi", "nk> wor", "ld <b"]
    s = stream(spark, tmp_path, [(1, i, c) for i, c in enumerate(chunks)], "message long, seq long, text string")
    got = flows.drained(spark, flows.visible_text(s)).orderBy("seq").collect()
    assert "".join(r.shown for r in got) == "Hello  world <b"


def test_limits_and_once(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, i, t) for i, t in enumerate((0, 10, 20, 30, 301, 302))], "user_id long, event_id long, at long")
    got = flows.drained(spark, flows.limited(s, 2, 300)).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True]


def test_stream_windows_equal_batch(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    live = flows.read_table(spark, sf, "events")
    want = sorted(map(str, flows.tumbling(batch, "1 day").select("window.start", "event_type", "n").collect()))
    got = flows.drained(spark, flows.tumbling(live, "1 day").select("window.start", "event_type", "n"), mode="complete").collect()
    assert sorted(map(str, got)) == want


def test_stream_of_part_files(spark, sf, tmp_path):
    """A table that is a folder of part files or one file, by a local path and by a URI."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (f"{tmp_path}", f"file://{tmp_path}", sf, f"file://{sf}"):
        assert flows.drained(spark, flows.read_table(spark, folder, "events").select("event_id")).count() == events.count()
