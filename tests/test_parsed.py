"""Chunks, clauses, residues and parsed sources: golden cases and brute force over random documents."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clausewise.functions import clauses as C
from clausewise.plans import chunking
from clausewise.sources import parsed

NODE = "doc string, order_no int, kind string, section string, page int, content string"


def chunks(spark, nodes, **sizes):
    d = spark.createDataFrame([("d", i, *n) for i, n in enumerate(nodes)], NODE)
    return chunking.chunk_nodes(d, "doc", **sizes).orderBy("chunk", "part").collect()


def test_golden_chunks(spark):
    p = "PARAGRAPH"
    got = chunks(spark, [(p, "A", 1, "first"), (p, "A", 1, "second"), (p, "A", 2, "3.2.1 a clause"), (p, "A", 3, "more of it"), ("TABLE", "A", 3, "<table>"), (p, "B", 4, "other"), ("SECTION", "C", 5, "head"), (p, "C", 5, " ")])
    assert [(r.first, r.last, r.n_nodes, r.page_first, r.page_last, r.section) for r in got] == [(0, 1, 2, 1, 1, "A"), (2, 3, 2, 2, 3, "A"), (4, 4, 1, 3, 3, "A"), (5, 5, 1, 4, 4, "B")]
    assert got[1].text == "3.2.1 a clause\nmore of it" and got[1].clauses == ["3.2.1"] and got[1].parents == ["3.2"] and got[2].kinds == ["TABLE"]
    got = chunks(spark, [(p, "A", 1, x) for x in ("1.4.1 bids", "(1) sealed", "（二）signed", "(3) dated", "1.4.2 " + "x" * 400)])
    assert [(r.n_nodes, r.clauses, r.parents) for r in got] == [(4, ["1.4.1", "1.4.1.1", "1.4.1.2", "1.4.1.3"], ["1.4", "1.4.1"]), (1, ["1.4.2"], ["1.4"])]
    got = chunks(spark, [(p, "A", 1, f"1.1.{i} short") for i in range(1, 5)] + [(p, "B", 1, "1.2.1 other")])
    assert [(r.n_nodes, r.parents) for r in got] == [(4, ["1.1"]), (1, ["1.2"])]


def brute_keys(nodes):
    out, active, last = [], None, ""
    for _, section, _, text in nodes:
        text, section = (text or "").strip(), section or ""
        if section != last:
            active, last = None, section
        number, chinese, item = re.match(r"(\d{1,3}(?:\.\d{1,3}){1,4})(?=\s|[、.．:：])", text), re.match(r"第[一二三\d]+[编章节条]", text), re.match(r"[（(]([一二三四五六七八九十\d]{1,2})[）)]", text)
        if number or chinese:
            active = (number or chinese)[0]
        up = active.rsplit(".", 1)[0] if active and "." in active and not chinese else None
        if item and active and not number and not chinese:
            out.append((f"{active}.{dict(zip('一二三四五六七八九十', map(str, range(1, 11)))).get(item[1], item[1])}", active))
        else:
            out.append((active, up))
    return out


def brute_chunks(nodes, target, most):
    keys, groups, current = brute_keys(nodes), [], None
    for i, (kind, section, _, text) in enumerate(nodes):
        text = (text or "").strip()
        if not text or kind == "SECTION":
            continue
        if kind in ("TABLE", "IMAGE"):
            groups.append([i])
            current = None
            continue
        fits = False
        if current:
            before = [(nodes[j][3] or "").strip() for j in current]
            size = sum(len(b) + 1 for b in before)
            number = lambda t: re.match(r"\d{1,3}(\.\d{1,3}){1,4}(?=\s|[、.．:：])", t)
            up = keys[i][1]
            item = up is not None and re.match(r"[（(][一二三四五六七八九十\d]{1,2}[）)]", text) and len(text) <= 360 and any(up in keys[j] for j in current)
            sibling = up is not None and number(text) and len(text) <= 360 and keys[current[-1]][1] == up and number(before[-1]) and len(before[-1]) <= 360
            start = re.match(r"第[一二三\d]+[编章节条]|\d{1,3}(\.\d{1,3}){1,4}(?!\d)|[（(]([一二三四五六七八九十]|\d{1,2})[）)]|[①②]", text)
            fits = (nodes[current[0]][1] or "") == (section or "") and not (start and not item and not sibling) and size < target and size + len(text) + 1 <= most and not (sibling and size + len(text) + 1 > 1000)
        if fits:
            current.append(i)
        else:
            current = [i]
            groups.append(current)
    return groups


@pytest.mark.parametrize("seed", range(3))
def test_random_chunks(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for d in range(20):
        n, major, minor = [], 1, 0
        for _ in range(rng.randint(0, 60)):
            minor += 1
            start = rng.choice(["", "", f"{major}.{minor} ", f"{major}.1.{minor} ", f"({minor % 12}) ", "（三）", "第二章 ", "① ", "12.5"])
            major += rng.random() < 0.1
            n.append((rng.choice(["PARAGRAPH"] * 8 + ["TABLE", "IMAGE", "SECTION", "LIST"]), rng.choice([None, "A", "A", "A", "B"]) if rng.random() < 0.2 else "A", rng.choice([None, 1, 2, 3]), rng.choice([None, " ", "x"]) if rng.random() < 0.1 else f" {start}{'word ' * rng.choice([1, 5, 30, 80, 200])}"))
        docs[str(d)] = n
    d = spark.createDataFrame([(k, i, *x) for k, n in docs.items() for i, x in enumerate(n)], NODE)
    got = {}
    for r in chunking.chunk_nodes(d, "doc", 900, 1200, 60).where("part = 0").collect():
        got.setdefault(r.doc, []).append((r.chunk, r.first, r.last, r.n_nodes, r.clauses, r.page_first))
    for k, n in docs.items():
        keys, want = brute_keys(n), []
        for c, g in enumerate(brute_chunks(n, 900, 1200)):
            want.append((c, g[0], g[-1], len(g), list(dict.fromkeys(keys[i][0] for i in g if keys[i][0])), min((n[i][2] for i in g if n[i][2]), default=None)))
        assert sorted(got.get(k, [])) == want


def brute_parts(text, most, overlap):
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    units = [u.strip() for u in re.split(r"(?<=[。！？；;])\s*|\n{2,}|\n", text) if u.strip()] or [text]
    out, open_ = [], ""
    for u in units:
        if len(u) > most:
            out += [open_] * bool(open_) + [u[i : i + most].strip() for i in range(0, len(u), most - overlap)]
            open_ = ""
        elif open_ and len(open_) + 1 + len(u) > most:
            out.append(open_)
            tail = open_[len(open_) - overlap :].strip() if len(open_) > overlap else open_.strip()
            open_ = f"{tail}\n{u}" if tail else u
        else:
            open_ = f"{open_}\n{u}" if open_ else u
    return [x.strip() for x in [*out, open_] if x.strip()]


def test_oversized_parts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", "  ", "a。b；" * 400, "long" * 900, "x。" + "y" * 700 + "。z\n\nw", "short"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in d.select("i", C.oversized_parts(F.col("t"), 300, 40).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_parts(t, 300, 40), t[:50]


def test_clause_parts(spark):
    cases = {
        "12 1.1 first。1.2 second；(1) item：（二）other": ["1.1 first。", "1.2 second；", "(1) item：", "（二）other"],
        "nothing here 1.2 inside": ["nothing here 1.2 inside"],
        "第一条 甲方第一次支付：十 第二次支付：百": ["第一条 甲方", "第一次支付：十", "第二次支付：百"],
        "1.1 第一次支付：十": ["1.1 第一次支付：十"], "": [], "  \n ": [], "a\n 第三条 b": ["a", "第三条 b"],
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in d.select("t", C.clause_parts(F.col("t")).alias("p")).collect()} == cases


def test_residues(spark):
    p = "PARAGRAPH"
    rows = [("v", 1, 1, p, "a sentence that goes on and on for"), ("v", 2, 1, p, "ever and"), ("v", 3, 1, p, "ever。"), ("v", 4, 1, p, "short"), ("v", 5, 2, p, "tail"), ("v", 6, 2, "TABLE", "<t>"), ("v", 7, 2, p, "after"), ("v", 8, 2, p, "1.1 no"), ("v", 9, 2, p, "ends。"), ("v", 10, 2, p, "以内"), ("v", 11, 2, p, " "), ("v", 12, 2, p, "x" * 29)]
    d = spark.createDataFrame(rows, "v string, order_no int, page int, kind string, content string")
    assert [r.into for r in chunking.merge_residues(d, "v").orderBy("order_no").collect()] == [1, 1, 1, 4, 5, 6, 7, 8, 8, 8, 11, 12]


MARKDOWN = "# One\ntext a\n### Deep\nb\n### Deeper\nc\n\n## Two\n#\n####### Seven\n d \ne\n# Last"


def test_markdown_nodes(spark):
    """The path is a list of places: a heading of level n keeps n - 1 of those before it, however many there are."""
    rng = random.Random(5)
    texts = [MARKDOWN, None, "", "plain"] + ["\r\n".join(rng.choice(["#" * rng.randint(1, 8) + rng.choice([" ", ""]) + rng.choice("ABC"), "line", " ", "#"]) for _ in range(40)) for _ in range(20)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {}
    for r in parsed.markdown_nodes(d, "i", "t").orderBy("i", "order_no").collect():
        got.setdefault(r.i, []).append((r.kind, r.section, r.content))
    for i, t in enumerate(texts):
        want, path = [], []
        for line in filter(None, (x.strip() for x in (t or "").splitlines())):
            marks = len(line) - len(line.lstrip("#"))
            if marks:
                level = min(6, marks)
                if title := line[level:].strip():
                    path = [*path[: level - 1], title]
                    want.append(("SECTION", " / ".join(path), title))
            else:
                want.append(("PARAGRAPH", " / ".join(path) or None, line))
        assert got.get(i, []) == want


def test_markdown_atoms(spark):
    d = spark.createDataFrame([(1, "# One\na\nb\n\nc\n1.1 clause\n(1) item\n### Deep\nd\n## Two\ne\r\nf"), (2, None), (3, "x")], "i int, t string")
    got = [(r.i, r.order_no, r.section, r.content) for r in parsed.markdown_atoms(d, "i", "t").orderBy("i", "order_no").collect()]
    assert got == [(1, 1, "One", "a\nb"), (1, 2, "One", "c"), (1, 3, "One", "1.1 clause"), (1, 4, "One", "(1) item"), (1, 5, "One / Deep", "d"), (1, 6, "One / Two", "e\nf"), (3, 1, None, "x")]


PAGES = [
    [{"type": "title", "content": {"title_content": [{"content": "Top"}], "level": 1}}, {"type": "paragraph", "content": {"paragraph_content": [{"text": "a"}, {"value": "b"}, 1]}}, {"type": "page_number", "content": "7"}],
    [{"type": "title", "content": {"title_content": "Sub", "level": 3}, "page_idx": 4}, {"type": "table", "content": {"html": "<td></td>", "table_body": "<td>x y</td>"}}, {"type": "list", "content": {"list_items": [" i ", "", {"content": "j"}]}}, {"type": "title", "content": "No level"}, {"type": "image", "content": {"text": "img"}}, {"type": "text", "content": None}, 3],
    "no page",
]
WANT = [("SECTION", 1, 1, "Top", False, "Top"), ("PARAGRAPH", None, 1, "Top", False, "ab1"), ("PARAGRAPH", None, 1, "Top", True, "7"), ("SECTION", 3, 5, "Top / Sub", False, "Sub"), ("TABLE", None, 2, "Top / Sub", False, "<td>x y</td>"), ("LIST", None, 2, "Top / Sub", False, "i\nj"), ("SECTION", None, 2, "No level", False, "No level"), ("IMAGE", None, 2, "No level", False, "img")]


def test_content_lists(spark):
    d = spark.createDataFrame([(1, json.dumps(PAGES)), (2, "{"), (3, None), (4, '{"a": 1}')], "i int, t string")
    got = parsed.content_list_nodes(d, "i", "t").orderBy("order_no").collect()
    assert [(r.i, r.kind, r.level, r.page, r.section, r.marginal, r.content) for r in got] == [(1, *w) for w in WANT]


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_archives(spark):
    rows = [(1, archive(a__md="# M\nx", b_content_list_v2__json=json.dumps(PAGES))), (2, archive(a_content_list_v2__json="[[]]", z__MD="# M\nx")), (3, b"no zip"), (4, None), (5, archive(a__txt="x")), (6, archive(**{f"f{i}__txt": "" for i in range(9)})), (7, archive(a__md="y" * 2000))]
    d = spark.createDataFrame([Row(i=i, data=b) for i, b in rows], "i int, data binary")
    faults = {r.i: r.fault for r in parsed.archive_members(d, "i", "data", files=8, total=10_000, member=1500).collect()}
    assert faults == {1: None, 2: None, 3: "no archive", 4: "no archive", 5: "nothing to read", 6: "too large", 7: "too large"}
    got = parsed.archive_nodes(d, "i", "data").orderBy("i", "order_no").collect()
    assert [(r.kind, r.content) for r in got if r.i == 1] == [(w[0], w[5]) for w in WANT]
    assert [(r.kind, r.section, r.content) for r in got if r.i == 2] == [("SECTION", "M", "M"), ("PARAGRAPH", "M", "x")]


def test_table_rows(spark):
    from clausewise.sources.html import table_rows

    pages = ["<table><tr><th>A &amp; B</th><td class='x'> 1 <b>2</b>\n3&nbsp;</td></tr><TR></TR><tr><td></td></tr></table>", "no table", None, "<tr><td>&lt;i&gt; &#23383;</td></tr>"]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.rows for r in d.select("i", table_rows(F.col("html")).alias("rows")).collect()}
    assert got[0] == [["A & B", "1 2 3"], [""]] and got[1] == [] and got[3] == [["<i> 字"]] and not got[2]


RULES = dict(heading="^目\\s*录$", entry=r"^第([一二三四五六七八九十\d]+)章", artifact=r"^[\s\d/-]*$", ordinary=r"\p{L}\p{N}.,:;!?。，；：（）()、 -", title="^contents of")


def test_toc_golden(spark):
    from clausewise.plans import cleaning

    rules = cleaning.Rules(**RULES)
    texts = ["目录", "第一章 总则 1", "第二章 投标 5", "第十章 其他 9", "第一章 总则", "body text of the chapter", "", "第二章 again"]
    d = spark.createDataFrame([("d", i, t, i == 99) for i, t in enumerate(texts)], "doc string, order_no int, content string, marginal boolean")
    got = {r.order_no: r.reason for r in cleaning.knowledge_cleaned(d, "doc", rules).collect()}
    assert got == {0: "CONTENTS", 1: "CONTENTS", 2: "CONTENTS", 3: "CONTENTS", 4: None, 5: None, 6: "EMPTY", 7: None}


def test_kb_clean_as_its_sql(spark, tmp_path):
    """Ordinals of more than 32 bits rise as others do; only ASCII white space is blank."""
    import duckdb

    import __spark_entry__

    texts = ["The list\n4703443633947811 a\nA4703443633947812 b\n3000000000 c\n5 d", "The list\n2147483648 a\n7 b", "The\xa0list\n\xa0\n \t\n1 a\x0b\n\x0b", "", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["kb_clean"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in __spark_entry__.queries()["kb_clean"](spark, str(tmp_path)).collect())


def brute_clean(nodes, rules):
    numerals = {c: i for i, c in enumerate("一二三四五六七八九十", 1)}
    fragment = lambda t: re.sub(r"#+|\s+", "", t).lower()
    counts = {}
    for _, section, _, text, _, _ in nodes:
        counts[section or "", fragment(text)] = counts.get((section or "", fragment(text)), 0) + 1
    out, seen, inside, last, base, end = [], set(), False, None, None, ""
    for i, (kind, section, page, text, marginal, template) in enumerate(nodes):
        m = re.match(r"第([一二三四五六七八九十\d]+)章", text)
        n = None if not m else int(m[1]) if m[1].isdecimal() else numerals.get(m[1])
        reason = None
        if re.fullmatch(r"目\s*录", text):
            reason, inside, last = "CONTENTS_HEADING", True, None
        elif inside and n is not None and (last is None or n > last):
            reason, last = "CONTENTS_ENTRY", n
        else:
            inside = False
        visible = re.sub(r"\s+", "", text)
        where = (section or "", fragment(text))
        if reason is None:
            odd = sum(c in "@^~" for c in visible)
            if marginal:
                reason = "LAYOUT_ARTIFACT"
            elif kind == "TABLE" and template:
                reason = "EMPTY_TABLE_TEMPLATE"
            elif re.fullmatch(r"[\s\d/-]*", text):
                reason = "PAGE_ARTIFACT"
            elif not visible or round(odd / len(visible), 4) > 0.35:
                reason = "GARBLED_TEXT"
            elif text.startswith("contents of"):
                reason = "CONTENTS_PAGE"
            else:
                if 0 < len(where[1]) <= 120 and counts[where] >= 3:
                    reason = "DUPLICATE_FRAGMENT" if where in seen else None
                    seen.add(where)
                if reason is None and sum(c.isalnum() for c in visible) < 8:
                    reason = "TOO_SHORT"
        into = None
        if reason is None:
            base, end, into = i, text, i
        elif reason == "TOO_SHORT" and base is not None and nodes[base][2] == page and nodes[base][0] not in ("TABLE", "IMAGE") and kind not in ("TABLE", "IMAGE") and not re.match(r"\d{1,3}(\.\d{1,3}){1,4}(?!\d)|[（(]\d{1,2}[）)]|第[一二三四五六七八九十\d]+章", text) and (not re.search(r"[。！？；：;:]\s*$", end) or re.match("[，、；。）)]|以上|且", text)):
            reason, end, into = "MERGED_SHORT_RESIDUE", text, base
        out.append((i, reason, into))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_cleaning(spark, seed):
    from clausewise.plans import cleaning

    rng = random.Random(seed)
    pool = ["a long enough sentence", "it is closed here。", "tail", "ends。", "且 on", "，so", "1.1 x", "以上", "目录", "第一章 a b", "第二章 c d", "第3章 long enough", "12 / 3", "@@@@^^^^~~", "contents of the whole", "repeated fragment", "repeated  fragment", "(2) y", "", "b；"]
    docs = {str(k): [(rng.choice(["PARAGRAPH"] * 6 + ["TABLE", "IMAGE"]), rng.choice([None, "A", "A", "B"]), rng.choice([1, 1, 2]), rng.choice(pool) if rng.random() < 0.8 else f"unique words {rng.random()}", rng.random() < 0.05, rng.random() < 0.5) for _ in range(rng.randint(0, 60))] for k in range(25)}
    d = spark.createDataFrame([(k, i, *n) for k, x in docs.items() for i, n in enumerate(x)], "doc string, order_no int, kind string, section string, page int, content string, marginal boolean, template boolean")
    got = {}
    for r in cleaning.cleaned(d, "doc", cleaning.Rules(**RULES)).collect():
        got.setdefault(r.doc, []).append((r.order_no, r.reason, r.into, r.text))
    for k, nodes in docs.items():
        want = brute_clean(nodes, RULES)
        text = lambda i: " ".join(nodes[j][3] for j, _, into in want if into == i)
        assert sorted(got.get(k, [])) == [(i, r, into, text(i) if r is None else None) for i, r, into in want], k
