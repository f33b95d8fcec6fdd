"""Text and value functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewise.functions import text as T
from clausewise.functions import values as V
from clausewise.functions.clauses import starts_clause
from clausewise.queries.registry import Tables, query

ORDINARY = r"\p{L}\p{N}.,;:!?'\"()\[\]/&%$#*@+_-"
LINES = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


def _lines(t: Tables):
    """Documents as nodes: a row a line, positions from 1."""
    return t.documents.select("doc_id", "source", "lang", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query()
def txt_normalize(t: Tables):
    return t.documents.select("doc_id", T.normalized(F.col("text")).alias("normalized"))


@query()
def txt_normalize_kb(t: Tables):
    return t.documents.select("doc_id", T.normalized(F.col("text"), drop_format=False).alias("normalized"))


@query(f"SELECT doc_id, pos, replace(replace(lower(regexp_replace(line, '#+|\\s+', '', 'g')), 'ß', 'ss'), 'ς', 'σ') AS key FROM ({LINES})")
def txt_dup_key(t: Tables):
    return _lines(t).select("doc_id", "pos", T.duplicate_key(F.col("line")).alias("key"))


@query(rf"""SELECT doc_id, pos, CAST(length(v) AS BIGINT) AS visible, CASE WHEN length(v) = 0 THEN 1.0::DOUBLE
ELSE round_even(length(regexp_replace(v, '[\p{{L}}\p{{N}}.,;:!?''"()\[\]/&%$#*@+_-]', '', 'g'))::DOUBLE / length(v), 4) END AS ratio FROM (SELECT *, regexp_replace(line, '\s+', '', 'g') AS v FROM ({LINES}))""")
def txt_quality(t: Tables):
    rows, bare = _lines(t).withColumn("bare", T.bare(F.col("line"))), F.col("bare")
    return rows.select("doc_id", "pos", F.length(bare).cast("long").alias("visible"), T.garbled_ratio(F.col("line"), ORDINARY, bare).alias("ratio"))


@query(rf"""WITH q AS (SELECT doc_id, pos, line, regexp_replace(line, '\s+', '', 'g') AS v, length(line) - length(regexp_replace(line, '\.{{4,}}', '', 'g')) AS dots FROM ({LINES}))
SELECT coalesce(CASE WHEN length(v) = 0 OR round_even(length(regexp_replace(v, '[\p{{L}}\p{{N}}.,;:!?''"()\[\]/&%$#*@+_-]', '', 'g'))::DOUBLE / length(v), 4) > 0.35 THEN 'GARBLED_TEXT'
WHEN regexp_matches(line, '^\s*(?i:contents)\s*$') OR (dots >= 60 AND dots >= 0.12 * length(v)) THEN 'CONTENTS_PAGE' WHEN length(v) > 1200 THEN 'OVERSIZED_CHUNK' END, 'KEPT') AS reason, count(*) AS n FROM q GROUP BY 1""")
def txt_gate(t: Tables):
    reason = F.coalesce(T.gate(F.col("line"), ORDINARY, r"^\s*(?i:contents)\s*$", seen=F.col("bare")), F.lit("KEPT"))
    return _lines(t).withColumn("bare", T.bare(F.col("line"))).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(rf"""WITH q AS (SELECT regexp_replace(line, '\s+', '', 'g') AS v FROM ({LINES}))
SELECT round_even(sum(length(regexp_replace(v, '[\p{{L}}\p{{N}}.,;:!?''"()\[\]/&%$#*@+_-]', '', 'g')))::DOUBLE / greatest(sum(length(v)), 1), 4) AS ratio FROM q""")
def clean_garbled_ratio(t: Tables):
    v = F.regexp_replace("line", r"\s+", "")
    return _lines(t).agg(F.bround(F.sum(F.length(F.regexp_replace(v, f"[{ORDINARY}]", ""))) / F.greatest(F.sum(F.length(v)), F.lit(1)), 4).alias("ratio"))


@query(rf"SELECT doc_id, pos, regexp_matches(line, '^(?:\s*[0-9]+\s*|\s*[Pp]age [0-9]+.*)$') AS artifact FROM ({LINES})")
def txt_page_artifact(t: Tables):
    return _lines(t).select("doc_id", "pos", F.col("line").rlike(r"^(?:\s*[0-9]+\s*|\s*[Pp]age [0-9]+.*)$").alias("artifact"))


@query(rf"SELECT doc_id, pos, TRY_CAST(nullif(regexp_extract(line, '^\s*([0-9]{{1,6}})', 1), '') AS BIGINT) AS ordinal FROM ({LINES})")
def txt_ordinal(t: Tables):
    return _lines(t).select("doc_id", "pos", F.nullif(F.regexp_extract("line", r"^\s*([0-9]{1,6})", 1), F.lit("")).try_cast("bigint").alias("ordinal"))


@query(f"""SELECT doc_id, pos, CAST(contains(lower(line), 'the') AS INT) + CAST(contains(lower(line), 'tion') AS INT) + CAST(contains(lower(line), 'und') AS INT) + 3 * CAST(regexp_matches(line, 'License|must') AS INT) AS score FROM ({LINES})""")
def keyword_score(t: Tables):
    return _lines(t).select("doc_id", "pos", T.keyword_score(F.col("line"), ["the", "tion", "und"], "License|must").alias("score"))


@query(f"SELECT doc_id, pos, contains(lower(line), 'license') AS mandatory, CASE WHEN contains(lower(line), 'license') THEN 'LICENSE' ELSE 'GENERAL' END AS clause_type FROM ({LINES})")
def clause_mandatory(t: Tables):
    hit = F.lower("line").contains("license")
    return _lines(t).select("doc_id", "pos", hit.alias("mandatory"), F.when(hit, "LICENSE").otherwise("GENERAL").alias("clause_type"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def hash_text(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


# Numbers of clauses before lines, by their place.
_MARKS = ["3.1 ", "第三条 ", "（二）", "2.1.4、", "①", "12 ", "(15)", ""]


@query(rf"""SELECT doc_id, pos, regexp_matches({_MARKS}[pos % {len(_MARKS)} + 1] || line, '^\s*(第[一二三四五六七八九十百千\d]+[编章节条]|\d{{1,3}}(\.\d{{1,3}}){{1,4}}(\D|$)|[（(]([一二三四五六七八九十]|\d{{1,2}})[）)]|[①②③④⑤⑥⑦⑧⑨⑩])') AS starts FROM ({LINES})""")
def clause_start(t: Tables):
    marked = F.concat(F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("pos") % len(_MARKS) + 1).cast("int")), F.col("line"))
    return _lines(t).select("doc_id", "pos", starts_clause(marked).alias("starts"))


@query("""SELECT doc_id, i // 350 AS place, substring(text, CAST(i + 1 AS INT), 400) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 350)) AS i FROM documents)""")
def hard_window(t: Tables):
    return t.documents.select("doc_id", F.posexplode(T.windows(F.col("text"), 400, 50)).alias("place", "piece")).withColumn("place", F.col("place").cast("long"))


@query("""SELECT doc_id, concat_ws(' / ', source, lang) || chr(10) || text AS context FROM documents""")
def ctx_text(t: Tables):
    return t.documents.select("doc_id", T.contextual([F.col("source"), F.col("lang"), F.col("source")], F.col("text")).alias("context"))


@query("""SELECT page_id, kind, count(*) AS n, sum(length(trim(regexp_replace(cell, '<[^>]*>', '', 'g')))) AS n_chars FROM (
SELECT page_id, 'p' AS kind, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS cell FROM pages
UNION ALL SELECT page_id, 'li', unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) FROM pages) GROUP BY ALL""")
def html_cells(t: Tables):
    from clausewise.sources.html import cells

    return cells(t.pages, "page_id", ["p", "li"]).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("cell")).alias("n_chars"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(concat_ws(' / ', source, 'Contents', lang), ' / '), lambda x: lower(x) <> 'contents'), ' / ') AS path FROM documents""")
def path_strip(t: Tables):
    return t.documents.select("doc_id", T.without_component(F.concat_ws(" / ", "source", F.lit("Contents"), "lang"), "contents").alias("path"))


@query(f"""SELECT doc_id, section, min(pos) AS first_line, count(*) AS n_lines FROM (SELECT doc_id, pos, sum(CASE WHEN regexp_replace(line, '^An', '## An') LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM ({LINES})) GROUP BY ALL""")
def md_sections(t: Tables):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.sum(F.regexp_replace("line", "^An", "## An").startswith("## ").cast("int")).over(w)
    return _lines(t).withColumn("section", section).groupBy("doc_id", "section").agg(F.min("pos").alias("first_line"), F.count("*").alias("n_lines"))


@query(f"""WITH n AS (SELECT doc_id, pos, lang, replace(replace(lower(regexp_replace(line, '#+|\\s+', '', 'g')), 'ß', 'ss'), 'ς', 'σ') AS key FROM ({LINES})),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM n)
SELECT doc_id, pos, n >= 3 AND length(key) <= 120 AND length(key) > 0 AND r > 1 AS duplicate FROM c""")
def win_dup_fragment(t: Tables):
    rows = _lines(t).select("doc_id", "pos", T.duplicate_key(F.col("line")).alias("key"))
    # counted before anything moves; lines meet only the fragments that repeat
    often = rows.where(F.length("key").between(1, 120)).groupBy("doc_id", F.md5("key").alias("h")).agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n >= 3")
    return rows.select("doc_id", "pos", F.md5("key").alias("h")).join(often, ["doc_id", "h"], "left").select("doc_id", "pos", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("duplicate"))


@query(f"""WITH n AS (SELECT doc_id, source, pos, CAST(contains(lower(line), 'the') AS INT) + 3 * CAST(regexp_matches(line, 'License|must') AS INT) AS score FROM ({LINES}))
SELECT doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY substring(source, 1, 160) ORDER BY score DESC, doc_id DESC, pos DESC) AS r FROM n WHERE score > 0) WHERE r <= 20""")
def win_top20_section(t: Tables):
    from clausewise.operators.ranking import first_per

    n = _lines(t).withColumn("score", T.keyword_score(F.col("line"), ["the"], "License|must")).where("score > 0").withColumn("section", F.substring("source", 1, 160))
    return first_per(n, ["section"], [F.desc("score"), F.desc("doc_id"), F.desc("pos")], 20).select("doc_id", "pos", "score")


@query(f"""WITH n AS (SELECT doc_id, pos, CASE WHEN contains(line, 'of') THEN 1 WHEN contains(line, 'and') THEN 2 WHEN contains(line, 'der') THEN 3 END AS level FROM ({LINES})),
r AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2, max(CASE WHEN level = 3 THEN pos END) OVER w AS p3 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, concat_ws(' / ', CAST(p1 AS VARCHAR), CASE WHEN p2 > coalesce(p1, 0) THEN CAST(p2 AS VARCHAR) END, CASE WHEN p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) THEN CAST(p3 AS VARCHAR) END) AS path FROM r""")
def win_section_path(t: Tables):
    from clausewise.plans.sections import section_path

    line = F.col("line")
    level = F.when(line.contains("of"), 1).when(line.contains("and"), 2).when(line.contains("der"), 3)
    return section_path(_lines(t).withColumn("level", level).withColumn("title", F.col("pos").cast("string")), ["doc_id"], "pos", 3).select("doc_id", "pos", "path")


@query(rf"""WITH n AS (SELECT doc_id, pos, nullif(regexp_extract(line, '([0-9]{{2,}})', 1), '') AS key, CASE WHEN contains(line, ',') THEN 1 ELSE 0 END AS cut FROM ({LINES})),
r AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
SELECT doc_id, pos, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY pos) AS active FROM r""")
def win_clause_key(t: Tables):
    from clausewise.plans.sections import active_key

    rows = _lines(t).withColumn("key", F.nullif(F.regexp_extract("line", "([0-9]{2,})", 1), F.lit(""))).withColumn("cut", F.col("line").contains(","))
    return active_key(rows, ["doc_id"], "pos", "key", F.col("cut")).select("doc_id", "pos", "active")


@query(rf"""WITH n AS (SELECT doc_id, pos, length(line) AS ordinal, contains(line, 'the') AS heading FROM ({LINES})),
s AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM n),
v AS (SELECT *, CASE WHEN NOT heading AND ordinal <= coalesce(lag(CASE WHEN NOT heading THEN ordinal END) OVER (PARTITION BY doc_id, seg ORDER BY pos), -1) THEN 1 ELSE 0 END AS bad FROM s)
SELECT doc_id, pos, seg > 0 AND max(bad) OVER (PARTITION BY doc_id, seg ORDER BY pos) = 0 AS contents FROM v""")
def win_toc_strip(t: Tables):
    from clausewise.plans.sections import contents_run

    rows = _lines(t).select("doc_id", "pos", F.length("line").alias("ordinal"), F.col("line").contains("the").alias("heading"))
    return contents_run(rows, ["doc_id"], "pos").select("doc_id", "pos", "contents")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'what|why|how') THEN 'QUESTION' WHEN regexp_matches(lower(text), 'please|show|list') THEN 'REQUEST'
WHEN regexp_matches(text, '[0-9]') THEN 'FACT' ELSE 'CASUAL' END AS intent FROM conversations WHERE role = 'user'""")
def query_intent(t: Tables):
    from clausewise.functions.queries import intent

    return t.conversations.where("role = 'user'").select("conv_id", "turn", intent(F.lower("text"), [("what|why|how", "QUESTION"), ("please|show|list", "REQUEST"), ("[0-9]", "FACT")], "CASUAL").alias("intent"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) <= 90 AND (contains(t, 'the') OR contains(t, 'que')) AND prev IS NOT NULL THEN substring(prev || chr(10) || '追问：' || t, 1, 2000) ELSE t END AS query FROM (
SELECT *, trim(text) AS t, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations) WHERE role = 'user'""")
def followup_query(t: Tables):
    from clausewise.functions.queries import with_previous

    return with_previous(t.conversations, "conv_id", "turn", "role", "text", 90, 2000, ["the", "que"]).select("conv_id", "turn", "query")


@query(r"""SELECT doc_id, array_to_string(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2)), ' ') IS NOT NULL AS ok, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2))) AS n, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS words FROM documents""")
def tokens(t: Tables):
    from clausewise.functions.words import words
    from clausewise.operators.scores import tokens as distinct

    return t.documents.select("doc_id", distinct(F.col("text")).isNotNull().alias("ok"), F.size(distinct(F.col("text"))).cast("long").alias("n"), F.array_join(words(F.col("text")), " ").alias("words"))


@query(r"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents),
m AS (SELECT item_id, doc_id, count(*) AS m FROM (SELECT item_id, unnest(w) AS w FROM q) JOIN d USING (w) GROUP BY ALL)
SELECT item_id, doc_id FROM m JOIN q USING (item_id) WHERE m = len(w)""")
def lex_and_match(t: Tables):
    from clausewise.plans.lexical import matches, stored

    return matches(t.documents, "doc_id", t.benchmark, "item_id", index=stored(t.documents, "doc_id")).select("item_id", "doc_id")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(the|der|la) ', '<think>', 'g'), '\b(of|und|el) ', '</THINK>', 'g'), '(?is)<think>.*?</think>', '', 'g'), '(?i)</?think>', '', 'g') AS hash FROM documents""".replace("AS hash", "AS stripped"))
def strip_reasoning(t: Tables):
    said = F.regexp_replace(F.regexp_replace("text", r"\b(the|der|la) ", "<think>"), r"\b(of|und|el) ", "</THINK>")
    return t.documents.select("doc_id", T.without_reasoning(said).alias("stripped"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\|', '\\|', 'g'), '\s*\n\s*', ' ', 'g') AS cell FROM documents")
def md_cell(t: Tables):
    return t.documents.select("doc_id", T.cell(F.col("text")).alias("cell"))


@query("SELECT doc_id, coalesce(source, 'unknown') || ' page ' || CAST(n_chars // 1000 + 1 AS VARCHAR) AS label FROM documents")
def source_label(t: Tables):
    return t.documents.select("doc_id", F.concat(F.coalesce("source", F.lit("unknown")), F.lit(" page "), (F.floor(F.col("n_chars") / 1000) + 1).cast("string")).alias("label"))


@query(r"SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority, '\b1-URGENT\b', 'urgent', 'g'), '\b5-LOW\b', 'low', 'g') AS label FROM orders")
def replace_codes(t: Tables):
    from clausewise.functions.queries import replace_codes as replaced

    return t.orders.select("o_orderkey", replaced(F.col("o_orderpriority"), {"1-URGENT": "urgent", "5-LOW": "low"}).alias("label"))


@query("""SELECT doc_id, substring(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^#+\\s*', ''))), lambda x: x <> ''), chr(10)), 1, 800) AS summary FROM documents""")
def md_summary(t: Tables):
    kept = F.filter(F.transform(T.lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, r"^#+\s*", ""))), lambda x: x != "")
    return t.documents.select("doc_id", F.substring(F.array_join(kept, "\n"), 1, 800).alias("summary"))


# --- values ---


@query(r"""SELECT doc_id, CAST(TRY_CAST(nullif(regexp_extract(regexp_replace(text, '[,，]', '', 'g'), '-?[0-9]+(?:\.[0-9]+)?'), '') AS DECIMAL(30,6)) * CASE WHEN contains(text, '亿') THEN 100000000 WHEN contains(text, '万') THEN 10000 ELSE 1 END AS DOUBLE) AS amount FROM documents""")
def val_money(t: Tables):
    return t.documents.select("doc_id", V.money(F.col("text")).cast("double").alias("amount"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_discount * 100) AS INT) / 100.0::DOUBLE AS ratio FROM lineitem""")
def val_ratio(t: Tables):
    text = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", V.ratio(text).alias("ratio"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS BIGINT) AS years FROM documents")
def val_years(t: Tables):
    return t.documents.select("doc_id", V.years(F.col("text")).alias("years"))


@query(r"SELECT o_orderkey, CASE WHEN regexp_matches(x, '^\s*[+-]?[0-9]+\s*$') THEN TRY_CAST(trim(x) AS BIGINT) END AS number FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' 12 ' WHEN o_orderkey % 3 = 1 THEN '1.5' ELSE CAST(o_custkey AS VARCHAR) END AS x FROM orders)")
def val_int(t: Tables):
    x = F.when(F.col("o_orderkey") % 3 == 0, " 12 ").when(F.col("o_orderkey") % 3 == 1, "1.5").otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", V.whole(x).alias("number"))


@query("SELECT event_id, coalesce(value >= TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), false) AS enough FROM events")
def val_at_least(t: Tables):
    return t.events.select("event_id", V.at_least(F.col("value"), F.get_json_object("props", "$.k")).alias("enough"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d')::TIMESTAMP END AS at FROM events""")
def val_iso_ts(t: Tables):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    return t.events.select("event_id", V.iso_time(text).alias("at"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP - INTERVAL 8 HOUR AS deadline FROM events""")
def val_deadline(t: Tables):
    return t.events.select("event_id", V.deadline(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("deadline"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS valid FROM orders""")
def val_uuid(t: Tables):
    h = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return t.orders.select("o_orderkey", V.is_uuid(F.when(F.col("o_orderkey") % 2 == 0, F.upper(uuid)).otherwise(h)).alias("valid"))
