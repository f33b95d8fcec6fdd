"""Extraction, facts, snapshots, risks, findings, citations, budgets, uploads and answer streams against their rules."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from clausewise.functions import text as T
from clausewise.operators import ranking
from clausewise.plans import citations, extraction, facts, lifecycle, risks, snapshots
from clausewise.sources import uploads
from clausewise.streaming import answers


def flow(log):
    status, refused = "NONE", 0
    for _, kind, live in sorted(log, key=lambda x: x[0]):
        to = None
        if kind == "CREATE" and live and status == "NONE" or kind == "RESUBMIT" and live and status == "STALE":
            to = "PENDING_REVIEW"
        elif kind == "CONFIRM" and live and status == "PENDING_REVIEW":
            to = "CONFIRMED"
        elif kind == "DISMISS" and status == "PENDING_REVIEW":
            to = "DISMISSED"
        elif kind == "CHANGE" and status != "NONE":
            to = "STALE"
        status, refused = to or status, refused + (to is None)
    return status, refused


@pytest.mark.parametrize("width", [2, 7, 4096])
def test_lifecycle(spark, monkeypatch, width):
    """Folded by ranges, and ranges of ranges, as one after the other."""
    monkeypatch.setattr(lifecycle, "RANGE", width)
    rng = random.Random(width)
    log = [(f"f{rng.randint(0, 5)}", i, rng.choice(["CREATE", "CONFIRM", "DISMISS", "CHANGE", "RESUBMIT", "other"]), rng.choice([True, True, False, None])) for i in range(300)]
    d = spark.createDataFrame(log, "k string, at long, kind string, live boolean").repartition(3)
    got = {r.k: (r.status, r.refused) for r in lifecycle.states(d, "k", "at", "kind", "live").collect()}
    assert got == {k: flow([(i, kind, live) for f, i, kind, live in log if f == k]) for k in {x[0] for x in log}}
    assert lifecycle.states(d.limit(0), "k", "at", "kind", "live").count() == 0


def test_risk_run(spark, tmp_path):
    found = spark.createDataFrame([(1, "A", "s", "t1", "d"), (1, "A", "s2", "t2", "d"), (1, "OFF", "s", "t", "d"), (2, "A", "s", "new", "d"), (1, "A", "s", "t0", "d")], "project long, rule string, subject string, title string, description string")
    versions = spark.createDataFrame([("A", 12, "type", "HIGH", True), ("A", 11, "type", "LOW", False), ("OFF", 20, "type", "LOW", False)], "rule string, version long, risk_type string, severity string, active boolean")
    there = spark.createDataFrame([(1, 12, "s", "A", "old", "LOW", "o", "o", "ACCEPTED"), (1, 11, "s2", "A", "old", "LOW", "o", "o", "OPEN"), (3, 12, "s", "A", "old", "LOW", "o", "o", "OPEN")], "project long, version long, subject string, rule string, risk_type string, severity string, title string, description string, status string")
    out = risks.run(found, there, versions)
    got = {(r.project, r.version, r.subject): (r.severity, r.title, r.status, r.change) for r in out.collect()}
    assert got == {(1, 12, "s"): ("HIGH", "t1", "ACCEPTED", "KEPT"), (1, 12, "s2"): ("HIGH", "t2", "OPEN", "NEW"), (2, 12, "s"): ("HIGH", "new", "OPEN", "NEW"), (1, 11, "s2"): ("LOW", "o", "OPEN", "GONE"), (3, 12, "s"): ("LOW", "o", "OPEN", "GONE")}
    base = str(tmp_path / "risks")
    risks.publish(out, base, "one")
    assert risks.published(spark, base).count() == 3
    # a run that fails leaves what is read as it was
    broken = out.withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        risks.publish(broken, base, "two")
    assert {r.title for r in risks.published(spark, base).collect()} == {"t1", "t2", "new"}
    risks.publish(out.where("project = 2"), base, "three")
    assert risks.published(spark, base).count() == 1


TAGS = [extraction.Tag("N", "number", required=True), extraction.Tag("M", "string", multi=True), extraction.Tag("B", "string", pattern="a["), extraction.Tag("P", "string", pattern="[a-z]+")]


def test_types(spark):
    cases = {
        "string": (['"a"', '" a "'], ['" "', "1", "null", "[]", '""']),
        "number": (["1", "1.5", '"2"', '" -1e5 "', '"nan"', '"1_000"', "1e400"], ['"x"', "true", "null", '""', "[1]", '"1d"']),
        "datetime": (['"2024-01-01"', '"2024-01-01T10:00:00Z"'], ['"2024-02-30"', "1", '"soon"', "null"]),
        "boolean": (["true", "false"], ['"true"', "1", "null"]),
        "array": (["[1]", "[null]"], ["[]", "{}", '"[1]"']),
        "json": (["[1]", '{"a":null}'], ["[]", "{}", '"{}"', "1"]),
        "other": ([], ['"a"', "1"]),
    }
    for kind, (good, bad) in cases.items():
        d = spark.createDataFrame([(x,) for x in good + bad], "j string").select("j", F.parse_json("j").alias("v"))
        got = {r.j: r.ok for r in d.select("j", extraction.has_type(F.col("v"), kind).alias("ok")).collect()}
        assert got == {x: x in good for x in good + bad}, kind
    d = spark.createDataFrame([("M", '["a","b"]', True), ("M", '["a"," "]', False), ("M", '"a"', False), ("M", "[]", False), ("N", "null", False), ("B", '"a["', False), ("P", '"ab"', True), ("P", '"ab\\n"', False), ("P", '"aB"', False), ("X", '"a"', False)], "c string, j string, want boolean")
    for r in d.select("*", extraction.checks(F.col("c"), F.parse_json("j"), TAGS).alias("ok")).collect():
        assert r.ok == r.want, r


def test_accepted_and_best(spark):
    items = [
        {"code": "N", "value": 1, "confidence": 0.5, "source_evidence_id": "e1", "source_text": "in the text"},
        {"code": "N", "value": 2, "confidence": 0.9, "source_evidence_id": "e1", "source_text": "not there"},
        {"code": "N", "value": 3, "confidence": 0.9, "source_evidence_id": "e1"},
        {"code": "X", "value": 3, "confidence": 0.9, "source_evidence_id": "e1"},
        {"code": "N", "value": 3, "confidence": 0.9, "source_evidence_id": "e9"},
        {"code": "N", "value": 3, "confidence": 0.9, "source_evidence_id": "e2"},
        {"code": "N", "value": 3, "confidence": 1.1, "source_evidence_id": "e1"},
        {"code": "N", "value": 3, "confidence": "0.9", "source_evidence_id": "e1"},
        {"code": "N", "value": " ", "confidence": True, "source_evidence_id": "e1"},
        {"value": 1},
    ]
    d = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(items)], "run int, i int, j string").select("run", "i", F.parse_json("j").alias("item"))
    evidence = spark.createDataFrame([("e1", "words in the text", None), ("e2", "w", ["M"])], "evidence string, text string, codes array<string>")
    got = extraction.accepted(d, evidence, TAGS)
    rows = {r.i: (r.issue, r.source_text) for r in got.collect()}
    assert [rows[i][0] for i in range(10)] == [None, None, None, "CODE", "EVIDENCE", "CANDIDATE", "CONFIDENCE", "CONFIDENCE", "VALUE", "CODE"]
    assert rows[0][1] == "in the text" and rows[1][1] == ""
    one = extraction.best(got, "run", "i").select("code", F.to_json("value").alias("v"), "confidence").collect()
    assert [tuple(r) for r in one] == [("N", "2", 0.9)]


def test_validated(spark):
    reviewed, relations = ["N", "T1", "T2"], [("BEFORE", "T1", "T2"), ("DEPENDS_ON", "M", "P"), ("DEPENDS_ON", "N", "P"), ("EQUAL_OR_BEFORE", "T2", "T1")]
    tags = [*TAGS, extraction.Tag("T1", "datetime", required=True), extraction.Tag("T2", "datetime")]
    rows = [(1, "N", '"x"', "见附件", None), (1, "T1", '"2024-01-02"', None, None), (1, "T2", '"2024-01-02"', None, "附录"), (1, "M", '["a"]', None, None), (2, "N", "1", None, None), (2, "T1", '"2024-01-01"', None, None), (2, "T2", '"2024-01-02"', None, None), (2, "P", '"a"', None, None)]
    d = spark.createDataFrame(rows, "run int, code string, j string, source_text string, section string").withColumn("value", F.parse_json("j")).drop("j")
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    failures = spark.createDataFrame([(3, 10), (3, 2)], "run int, batch int")
    got = {r.run: r for r in extraction.validated(d, runs, "run", tags, reviewed, relations, failures).collect()}
    assert got[1].issues == ["MISSING_REQUIRED:N", "ATTACHMENT_REFERENCE:N", "ATTACHMENT_REFERENCE:T2", "RELATION_BEFORE:T1:T2", "RELATION_DEPENDS_ON:N:P"]
    assert got[1].review == ["N", "T1", "T2"] and got[1].approved == ["M"]
    assert got[2].issues == ["RELATION_EQUAL_OR_BEFORE:T2:T1"] and got[2].review == ["T1", "T2"] and got[2].approved == ["N", "P"]
    assert got[3].issues == ["MISSING_REQUIRED:N", "MISSING_REQUIRED:T1", "EXTRACTION_BATCH_FAILED:2", "EXTRACTION_BATCH_FAILED:10"] and got[3].approved == []


def test_facts(spark):
    reviewed = spark.createDataFrame([(1, 1, "QUAL_CREDIT", '"v"', True, "", "said", 10, 5), (1, 1, "PROJECT_NAME", '{"a":1}', False, None, None, 99, 6), (1, 1, "QUAL_TAX", "[1]", False, "note", "said", None, None)], "project int, version int, code string, j string, human_edited boolean, note string, source_text string, evidence int, node int").withColumn("value", F.parse_json("j")).drop("j")
    evidence = spark.createDataFrame([(1, 1, 10), (1, 2, 99)], "project int, version int, evidence int")
    nodes = spark.createDataFrame([(1, 1, 6, 40, 2), (1, 1, 6, 41, 1), (1, 1, 5, 50, 1)], "project int, version int, node int, evidence int, ordinal int")
    tags = spark.createDataFrame([("QUAL_CREDIT", "Credit")], "code string, name string")
    got = {(r.kind, r.code): tuple(r)[3:] for r in facts.projected(reviewed, evidence, nodes, tags).collect()}
    assert got["FIELD", "QUAL_CREDIT"] == (None, None, '"v"', None, "PIPELINE_HUMAN", 10, "OWN")
    assert got["FIELD", "PROJECT_NAME"] == (None, None, '{"a":1}', None, "PIPELINE_AUTO", 41, "NODE")
    assert got["REQUIREMENT", "QUAL_CREDIT"] == ("Credit", "said", '{"items":[{"dimension":"QUAL_CREDIT","value":"v"}]}', True, "PIPELINE_HUMAN", 10, "OWN")
    assert got["REQUIREMENT", "QUAL_TAX"] == ("QUAL_TAX", "note", '{"items":[{"dimension":"QUAL_TAX","value":[1]}]}', True, "PIPELINE_AUTO", None, None)
    assert len(got) == 5 and len(facts.MATCHABLE) == 11
    previous = spark.createDataFrame([(1, 7, "PIPELINE_HUMAN", "A"), (1, 7, "MANUAL", "B"), (1, 8, "PIPELINE_HUMAN", "C"), (1, None, None, "D")], "project int, document int, source string, code string")
    kept = facts.replaced(previous, previous.limit(0), spark.createDataFrame([(1, 7)], "project int, document int")).collect()
    assert sorted(r.code for r in kept) == ["B", "C", "D"]


def test_snapshot_hash(spark):
    """One hash for 1 and 64 partitions; findings without available evidence are left out."""

    def made(parts):
        table = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(parts)
        return snapshots.snapshot(
            table([(1, "p", None), (2, "q", "2030")], "project int, name string, deadline string"),
            table([(1, 10 + i, "k", f"t{i}", "d", "HIGH", "CONFIRMED" if i else "DISMISSED") for i in range(6)], "project int, finding int, kind string, title string, description string, severity string, status string"),
            table([(10 + i, 100 + i + j) for i in range(5) for j in range(2)], "finding int, evidence int"),
            table([(1, 100 + i, "text" if i < 4 else " ", i != 1) for i in range(8)], "project int, evidence int, text string, current boolean"),
            table([(1, 200 + i, f"note {i}") for i in range(9)] + [(1, 102, "again")], "project int, evidence int, text string"),
            table([(1, 1, "r", None, "QUALIFICATION", True, 103), (1, 2, "r2", "d", "OTHER", False, None)], "project int, requirement int, title string, description string, category string, mandatory boolean, evidence int"),
            table([(1, 5, "e", False), (1, 6, "a", True)], "project int, enterprise int, name string, lead boolean"),
            table([(1, 5, "m", True), (2, 6, "m2", False)], "material int, enterprise int, name string, confirmed boolean"),
            table([(1, 1, "MATCHED", "r", 1), (1, 9, "??", "r", None)], "project int, requirement int, status string, reason string, material int"),
            table([(1, "R", "HIGH", "OPEN", "t")], "project int, rule string, severity string, status string, title string"),
            table([(1, "GO", 80.5, None)], "project int, decision string, score double, summary string"),
        )

    one, many = ({r.project: r for r in made(n).collect()} for n in (1, 64))
    assert {k: r.hash for k, r in one.items()} == {k: r.hash for k, r in many.items()}
    body = json.loads(one[1].snapshot)
    assert [f["finding_id"] for f in body["findings"]] == ["11", "12", "13"]  # 14 has only blank evidence
    assert [e["evidence_id"] for e in body["evidence"]] == ["102", "103", "200", "201", "202", "203", "204"]
    assert [e["is_lead"] for e in body["enterprises"]] == [True, False] and body["enterprises"][1]["confirmed_material_count"] == 1
    assert [m["status"] for m in body["matches"]] == ["匹配", "待核验"] and body["matches"][0]["enterprise_name"] == "e" and body["matches"][1]["requirement_title"] == "已删除或未确认的需求"
    assert body["qualification_requirements"][0]["evidence_ids"] == ["103"] and body["decision"]["value"] == "GO" and body["project"]["deadline"] is None
    assert json.loads(one[2].snapshot)["findings"] == [] and json.loads(one[2].snapshot)["decision"] is None


@pytest.mark.parametrize("few,again", [(1024, False), (0, False), (1024, True)])
def test_snapshot_by_ids(spark, monkeypatch, few, again):
    """With texts and teams of their own the snapshots are those of texts and enterprises that each project has."""
    monkeypatch.setattr(snapshots, "TEXTS", few, raising=False)
    table = spark.createDataFrame
    projects = table([(i, f"p{i}", None) for i in range(1, 5)], "project int, name string, deadline string")
    found = table([(1 + i % 3, 10 + i, "k", f"t{i}", "d", "HIGH", "CONFIRMED") for i in range(6)], "project int, finding int, kind string, title string, description string, severity string, status string")
    links = table([(10 + i, 100 + (i + j) % 5) for i in range(6) for j in range(2)], "finding int, evidence int")
    texts = table([(False, 100 + i, "x" * 1990 + f"text {i} and more" if i != 3 else " ") for i in range(5)] + [(True, 102 + i, f"note {i}" if i else "") for i in range(9)] + [(False, 101, "again")] * again, "note boolean, evidence int, text string")
    evidence = table([(p, 100 + i, (p + i) % 4 > 0) for p in range(1, 5) for i in range(5)], "project int, evidence int, current boolean")
    notes = table([(p, 102 + i) for p in range(1, 4) for i in range(8)], "project int, evidence int")
    needs = table([(p, p, "r", None, "OTHER", True, 100 + p) for p in range(1, 5)], "project int, requirement int, title string, description string, category string, mandatory boolean, evidence int")
    teams = table([(1, "a"), (2, "b"), (3, "a")], "project int, team string")
    own = table([("a", 5, "e", False), ("a", 6, "f", True), ("b", 6, "f", True), ("c", 7, "g", True)], "team string, enterprise int, name string, lead boolean")
    materials = table([(1, 5, "m", True), (2, 6, "m2", True), (3, 6, "m3", False), (4, 7, "m4", True)], "material int, enterprise int, name string, confirmed boolean")
    matches = table([(p, p, "MATCHED", "r", m) for p in range(1, 5) for m in (1, 2, 3, 4, None)], "project int, requirement int, status string, reason string, material int")
    risks_ = table([(1, "R", "HIGH", "OPEN", "t")], "project int, rule string, severity string, status string, title string")
    decided = table([(1, "GO", 80.5, None)], "project int, decision string, score double, summary string")
    with_text = lambda rows, note: rows.join(texts.where(F.col("note") == note).select("evidence", "text"), "evidence")
    each = snapshots.snapshot(projects, found, links, with_text(evidence, False), with_text(notes, True), needs, own.join(teams, "team").drop("team"), materials, matches, risks_, decided)
    shared = snapshots.snapshot(projects, found, links, evidence, notes, needs, own, materials, matches, risks_, decided, texts, teams)
    want = {r.project: json.loads(r.snapshot) for r in each.collect()}
    assert want == {r.project: json.loads(r.snapshot) for r in shared.collect()}
    assert len(want[1]["enterprises"]) == 2 and not want[4]["enterprises"] and want[1]["evidence"] and any(m["material_name"] == "m2" for m in want[2]["matches"])


def test_citations(spark):
    u = lambda n: f"00000000-0000-0000-0000-{n:012d}"
    mark = lambda kind, n: f"【{kind}: {u(n)}】"
    answer = f" a{mark('Legal', 2)}b{mark('Evidence', 1)}{mark('Evidence', 9)} c{mark('Evidence', 1)}【Report: x】 \n"
    d = spark.createDataFrame([(1, answer), (2, "none"), (3, None), (4, "x" + mark("Evidence", 1))], "message int, answer string")
    allowed = spark.createDataFrame([(1, "Evidence", u(1), 5, "q1"), (1, "Legal", u(2), 1, "q2"), (1, "Evidence", u(2), 2, "q"), *((2, "Report", u(i), 20 - i, "r") for i in range(12))], "message int, kind string, id string, place int, quote string")
    got = {r.message: r for r in citations.verified(d, allowed).collect()}
    assert got[1].answer == f"a{mark('Legal', 2)}b{mark('Evidence', 1)} c{mark('Evidence', 1)}"
    assert [tuple(c) for c in got[1].citations] == [("Evidence", u(1), "q1"), ("Legal", u(2), "q2")]
    assert got[2].citations == [] and (got[3].answer, got[3].citations) == ("", []) and (got[4].answer, got[4].citations) == ("x", [])
    first = {r.message: r for r in citations.verified(d, allowed, fallback=True).collect()}
    assert [c.id for c in first[2].citations] == [u(i) for i in range(11, 3, -1)] and len(first[1].citations) == 2 and first[4].citations == []


def test_charged(spark):
    def take(texts, budget, each):
        out = []
        for t in texts:
            cut = (t or "")[: min(each, budget)].strip() if budget > 0 else ""
            budget -= len(cut)
            out.append(cut)
        return out

    rng = random.Random(3)
    cases = [[rng.choice(["ab  cd　", "  ", None, "x" * 30, "a b c d e f", " \n\tq\n"]) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x array<string>")
    for r in d.select("i", ranking.charged(F.col("x"), 25, 9).alias("got")).collect():
        assert r.got == take(cases[r.i], 25, 9)


def office(*names):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in names:
            z.writestr(n, "x" * 100)
    return data.getvalue()


def test_uploads(spark, tmp_path):
    files = {
        "a.pdf": b"%PDF-1.7 x", "b.pdf": b"PK\x03\x04", "c.docx": office("[Content_Types].xml", "word/document.xml"), "d.xlsx": office("[Content_Types].xml", "word/document.xml"), "e.PPTX": b"head" + office("[Content_Types].xml", "ppt/s.xml"),
        "f.docx": office("word/document.xml"), "g.docx": office("[Content_Types].xml", "word/d.xml")[:-30], "h.docx": b"", "i.txt": b"text", "j.pdf": b"%PDF-" + b"x" * 5000, "k": b"%PDF-", "l.xlsx": b"PK\x05\x06" + b"\xff" * 18,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r.issue for r in uploads.checked(uploads.read(spark, str(tmp_path / "*"), 4000, spark.createDataFrame([(n,) for n in files], "name string")), 4000).collect()}
    assert got == {"a.pdf": None, "b.pdf": "CONTENT", "c.docx": None, "d.xlsx": "CONTENT", "e.PPTX": None, "f.docx": "CONTENT", "g.docx": "CONTENT", "h.docx": "EMPTY", "i.txt": "TYPE", "j.pdf": "TOO_LARGE", "k": "TYPE", "l.xlsx": "CONTENT"}
    assert uploads.zip_names(office("a", "é")) == ["a", "é"]


def test_streamed_prefixes():
    """What is shown only grows, and is the stripped answer at the end where all blocks are closed."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["<think>", "</think>", "</THINK>", "a", "<", "th", " b "]) for _ in range(rng.randint(0, 12)))
        shown = ""
        for n in range(len(text) + 1):
            now = answers.streamed(text[:n])
            assert now.startswith(shown)
            shown = now
    assert answers.streamed("a<think>x</think>b") == "ab" and answers.streamed("a<thi") == "a" and answers.stripped("a<think>b") == "ab"


def events_of(spark, chunks, tmp_path, name, batches, **options):
    """Events of chunks that come in batches of files, in the order given."""
    rows = spark.createDataFrame(chunks, "message long, seq long, text string, last boolean")
    folder = str(tmp_path / name)
    per = -(-len(chunks) // batches)
    for b in range(batches):
        spark.createDataFrame(chunks[b * per : (b + 1) * per] or [], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = answers.answer_events(stream, patience=None, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    out = {}
    for r in spark.table(name).collect():
        out.setdefault(r.message, {})[r.n] = (r.type, r.content)
    return {m: [x[i] for i in sorted(x)] for m, x in out.items()}


def test_answer_events(spark, tmp_path):
    """Shuffled batches, repeated chunks among them, end as the batch strip; tokens and replacements add up to it."""
    rng = random.Random(6)
    texts = {1: ["a<th", "ink>b</thi", "nk>c ", "d"], 2: ["x<think>never", " closed"], 3: ["plain"], 4: ["", None, "</think>q"], 5: ["not", " ended"]}
    chunks = [(m, i, t, i == len(x) - 1 and m != 5) for m, x in texts.items() for i, t in enumerate(x)]
    chunks += chunks[:3]
    rng.shuffle(chunks)
    got = events_of(spark, chunks, tmp_path, "shuffled", 3)
    whole = {m: "".join(t or "" for t in x) for m, x in texts.items()}
    batch = {r.m: r.t for r in spark.createDataFrame(list(whole.items()), "m long, t string").select("m", T.without_reasoning(F.col("t")).alias("t")).collect()}
    for m in (1, 2, 3, 4):
        assert got[m][-1] == ("done", batch[m])
        shown = ""
        for kind, content in got[m]:
            shown = shown + content if kind == "token" else content
        assert shown == batch[m]
    assert ("replace", batch[2]) in got[2] and all(k == "token" for k, _ in got.get(5, []))
    long = [(1, 0, "x" * 30, False), (1, 1, "y" * 30, True), (2, 5, "z" * 60, False), (3, 0, "ok", True)]
    got = events_of(spark, long, tmp_path, "long", 1, longest=50)
    assert got[1] == [("error", "ANSWER_TOO_LONG")] and got[2] == [("error", "ANSWER_TOO_LONG")] and got[3][-1] == ("done", "ok")
