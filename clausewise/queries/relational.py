"""Filters, joins, aggregates, rankings and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewise.operators import ranking, scores, visibility
from clausewise.queries.registry import Tables, query

# --- predicates ---


@query("""SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1
WHERE d.source IS NULL OR l.doc_id IS NOT NULL""")
def current_rows(t: Tables):
    return visibility.current(t.documents.select("doc_id", "source"), t.labels, "doc_id", F.col("quality") == 1)


@query("""SELECT o_orderkey, o_orderstatus FROM orders o WHERE o_orderstatus <> 'P'
OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def exists_or(t: Tables):
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("hit", F.lit(True))
    return t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").where((F.col("o_orderstatus") != "P") | F.col("hit")).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def acl_visible(t: Tables):
    members = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return visibility.visible(t.customer, members, "c_custkey", admin=False).select("c_custkey", "c_name")


@query("SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality = 1 AND l.toxic = 0")
def published_only(t: Tables):
    return t.documents.where("lang = 'en'").join(t.labels.where("quality = 1 and toxic = 0"), "doc_id").select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def in_list(t: Tables):
    return t.part.where(F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_type), 'promo')""")
def ilike_or(t: Tables):
    cols = ["p_name", "p_brand", "p_type"]
    return t.part.where(visibility.any_like(cols, "red") | visibility.any_like(["p_type"], "Promo")).select("p_partkey", *cols)


@query("""SELECT doc_id, substring(text, 1, 200) AS note FROM documents
WHERE regexp_matches(text, '(?i)license|copyright|licence') ORDER BY doc_id LIMIT 6""")
def keyword_notes_top6(t: Tables):
    return t.documents.where(F.col("text").rlike("(?i)license|copyright|licence")).orderBy("doc_id").limit(6).select("doc_id", F.substring("text", 1, 200).alias("note"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 50")
def optional_filters(t: Tables):
    return visibility.conjunction(t.events.where("value > 50"), event_type="click", user_id=None).select("event_id", "user_id")


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_path_int(t: Tables):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT c.conv_id, c.turn, coalesce(p.text, c.text) AS context FROM conversations c
LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def parent_context(t: Tables):
    c, p = t.conversations.alias("c"), t.conversations.alias("p")
    on = (F.col("p.conv_id") == F.col("c.conv_id")) & (F.col("p.turn") == F.col("c.turn") - 1)
    return c.join(p, on, "left").select("c.conv_id", "c.turn", F.coalesce("p.text", "c.text").alias("context"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality ASC NULLS LAST, d.doc_id")
def nulls_last_sort(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality").orderBy(F.asc_nulls_last("quality"), "doc_id")


@query("""SELECT event_id, ts FROM events WHERE event_type = 'view' OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-10')
ORDER BY ts, event_id LIMIT 100""")
def stale_jobs(t: Tables):
    status = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "RUNNING").otherwise("DONE")
    return visibility.stale(t.events.withColumn("status", status), "status", "ts", F.lit("2024-01-10").cast("timestamp"), 100, ["ts", "event_id"]).select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def point_lookup(t: Tables):
    return t.orders.where("o_custkey = 7").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, substring(text, 1, 500) AS clipped, CAST(length(substring(text, 1, 2400)) AS BIGINT) AS n FROM documents")
def clip_text(t: Tables):
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("clipped"), F.length(F.substring("text", 1, 2400)).cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders""")
def label_map(t: Tables):
    labels = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(labels, F.col("o_orderstatus")), F.lit("other")).alias("label"))


_DOCUMENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'FAILED' WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'P' THEN 'PARSING' ELSE 'READY' END WHEN '5-LOW' THEN 'UPLOADED' ELSE 'READY' END"


# Documents are the orders of one day of the month each; a customer's report and analysis come from its last order.
@query(f"""WITH d AS (SELECT o_custkey, list(DISTINCT {_DOCUMENT}) AS docs FROM orders WHERE day(o_orderdate) = 3 GROUP BY 1),
l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p, max(o_orderkey) AS k FROM orders GROUP BY 1),
x AS (SELECT c_custkey, c_acctbal < 0 AS archived, docs, CASE WHEN k % 3 = 0 THEN CASE s WHEN 'F' THEN 'READY' WHEN 'O' THEN 'GENERATING' ELSE 'FAILED' END END AS report, p = '2-HIGH' AS stale,
CASE WHEN k % 4 <> 1 THEN CASE p WHEN '3-MEDIUM' THEN 'RUNNING' WHEN '5-LOW' THEN 'FAILED' ELSE 'SUCCEEDED' END END AS analysis FROM customer LEFT JOIN d ON d.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN archived THEN 'ARCHIVED' WHEN docs IS NULL THEN 'NO_DOCUMENT' WHEN list_contains(docs, 'PARSING') THEN 'DOCUMENT_PROCESSING' WHEN list_contains(docs, 'FAILED') THEN 'DOCUMENT_FAILED'
WHEN report IS NOT NULL THEN CASE WHEN stale THEN 'REPORT_STALE' ELSE CASE report WHEN 'GENERATING' THEN 'REPORT_GENERATING' ELSE 'REPORT_' || report END END
WHEN analysis IS NOT NULL THEN CASE analysis WHEN 'RUNNING' THEN 'ANALYSIS_RUNNING' WHEN 'FAILED' THEN 'ANALYSIS_FAILED' ELSE 'ANALYSIS_FINISHED' END WHEN list_contains(docs, 'READY') THEN 'DOCUMENT_READY' ELSE 'DOCUMENT_UPLOADED' END AS phase FROM x""")
def project_phase(t: Tables):
    from clausewise.plans.states import phase

    document = F.when(F.col("o_orderpriority") == "1-URGENT", "FAILED").when(F.col("o_orderpriority") == "2-HIGH", F.when(F.col("o_orderstatus") == "P", "PARSING").otherwise("READY")).when(F.col("o_orderpriority") == "5-LOW", "UPLOADED").otherwise("READY")
    docs = t.orders.where(F.dayofmonth("o_orderdate") == 3).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(document).alias("docs"))
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max_by("o_orderpriority", "o_orderkey").alias("p"), F.max("o_orderkey").alias("k"))
    x = t.customer.join(docs, "c_custkey", "left").join(last, "c_custkey", "left")
    report = F.when(F.col("k") % 3 == 0, F.when(F.col("s") == "F", "READY").when(F.col("s") == "O", "GENERATING").otherwise("FAILED"))
    analysis = F.when(F.col("k") % 4 != 1, F.when(F.col("p") == "3-MEDIUM", "RUNNING").when(F.col("p") == "5-LOW", "FAILED").otherwise("SUCCEEDED"))
    return x.select("c_custkey", phase(F.col("c_acctbal") < 0, F.col("docs"), report, F.col("p") == "2-HIGH", analysis).alias("phase"))


# --- joins ---


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(t: Tables):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("""SELECT o_orderkey, l_linenumber, p_name, s_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def join_left_chain(t: Tables):
    return (
        t.orders.join(t.lineitem.where("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t.part.where("p_size > 25"), F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select("o_orderkey", "l_linenumber", "p_name", "s_name")
    )


@query("""SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def join_self_parent(t: Tables):
    c, p = t.conversations.alias("c"), t.conversations.alias("p")
    return c.join(p, (F.col("p.conv_id") == F.col("c.conv_id")) & (F.col("p.turn") == F.col("c.turn") - 1), "left").select("c.conv_id", "c.turn", F.col("p.role").alias("parent_role"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def join_anti_unindexed(t: Tables):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def join_semi(t: Tables):
    return t.part.join(t.lineitem.where("l_returnflag = 'A'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def exists_corr(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def not_exists_corr(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def not_in_null_aware(t: Tables):
    t.documents.createOrReplaceTempView("_docs")
    t.labels.createOrReplaceTempView("_labels")
    return t.spark.sql("SELECT doc_id FROM _docs WHERE doc_id NOT IN (SELECT doc_id FROM _labels WHERE toxic = 1)")


@query("""SELECT d.doc_id, d.source, l.quality, b.item_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.text = d.text""")
def join_left_optional(t: Tables):
    b = t.benchmark.select("item_id", F.col("text").alias("b_text"))
    return t.documents.join(t.labels, "doc_id", "left").join(b, F.col("text") == F.col("b_text"), "left").select("doc_id", "source", "quality", "item_id")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer""")
def join_exists_flag(t: Tables):
    pending = t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return t.customer.join(pending, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_pending"))


@query("""SELECT k.kw AS keyword, count(*) AS n_docs FROM documents d JOIN (SELECT unnest(['license', 'example.com', 'the', 'und', 'aeiou']) AS kw) k ON contains(lower(d.text), k.kw) GROUP BY 1""")
def theta_keyword_hits(t: Tables):
    # keywords are a short fixed list, so each is a predicate of one scan
    words = ["license", "example.com", "the", "und", "aeiou"]
    hit = F.array(*[F.when(F.lower("text").contains(w), F.lit(w)) for w in words])
    return t.documents.select(F.explode(F.array_compact(hit)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n_docs"))


@query("""SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d
ON contains(replace(replace(d.text, ' ', ''), chr(12288), ''), replace(replace(b.text, ' ', ''), chr(12288), '')) GROUP BY 1""")
def theta_contains_benchmark(t: Tables):
    from clausewise.plans.evaluation import contained

    return contained(t.benchmark, t.documents)


@query("""SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS piece, generate_subscripts(string_split(o_orderpriority, '-'), 1) AS ordinal FROM orders""")
def lateral_ordinality(t: Tables):
    return t.orders.select("o_orderkey", F.posexplode(F.split("o_orderpriority", "-")).alias("ordinal", "piece")).select("o_orderkey", "piece", (F.col("ordinal") + 1).cast("long").alias("ordinal"))


@query("""SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def update_from(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0)).alias("quality"))


@query("""SELECT c_custkey, r_name FROM customer CROSS JOIN region """)
def rule_cross(t: Tables):
    # the region table has one row a region; the cross product stays with a side of fixed size
    return t.customer.select("c_custkey").join(F.broadcast(t.region.select("r_name")))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def count_joined(t: Tables):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey AS k, l_orderkey AS a, l_linenumber AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o1.o_orderkey AS source_key, o2.o_orderkey AS target_key, o2.o_orderkey IS NULL AS missing
FROM orders o1 LEFT JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1 AND o2.o_orderstatus = 'F' WHERE o1.o_orderstatus = 'P'""")
def relation_validate(t: Tables):
    source = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source_key"))
    target = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("target_key"))
    out = source.join(target, F.col("target_key") == F.col("source_key") + 1, "left")
    return out.withColumn("missing", F.col("target_key").isNull())


# --- aggregates ---


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events")
def agg_count(t: Tables):
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def agg_count_join(t: Tables):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_count(t: Tables):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT source, coalesce(max(doc_id), 0) + 1 AS next_version FROM documents GROUP BY source")
def agg_next_version(t: Tables):
    return t.documents.groupBy("source").agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_version"))


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 1")
def agg_top_group(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(1)


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def agg_distinct(t: Tables):
    big = t.orders.join(t.lineitem.where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS urgent_open,
count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY o_custkey""")
def agg_conditional(t: Tables):
    return t.orders.groupBy("o_custkey").agg(
        F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")).alias("urgent_open"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
    )


@query("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS matched, count(*) FILTER (WHERE l_returnflag = 'N') AS uncertain,
count(*) FILTER (WHERE l_returnflag = 'R') AS missing FROM lineitem GROUP BY l_suppkey""")
def agg_pivot_status(t: Tables):
    status = F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "N", "uncertain").otherwise("missing")
    return t.lineitem.select("l_suppkey", status.alias("status")).groupBy("l_suppkey").pivot("status", ["matched", "uncertain", "missing"]).count().na.fill(0)


@query("""SELECT l_orderkey, round_even(100.0 * count(*) FILTER (WHERE l_returnflag = 'A') / count(*)::DOUBLE, 2) AS score FROM lineitem GROUP BY l_orderkey""")
def decision_score(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(scores.share(F.count_if(F.col("l_returnflag") == "A"), F.count("*")).alias("score"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events) WHERE r = 1""")
def argmax_first(t: Tables):
    return ranking.first_per(t.events, ["user_id"], [F.desc("value"), "ts", "event_id"]).select("user_id", "event_id", "value")


@query("""SELECT user_id, max(TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(38,6)))::DOUBLE AS best FROM events GROUP BY user_id""")
def agg_try_max(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.get_json_object("props", "$.k").try_cast("decimal(38,6)")).cast("double").alias("best"))


@query("""SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT doc_id) FROM documents) AS n_ids,
(SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts""")
def preflight_counts(t: Tables):
    return t.documents.agg(F.count("*").alias("n_docs"), F.countDistinct("doc_id").alias("n_ids"), F.count("text").alias("n_texts"))


@query("""WITH n AS (SELECT lower(trim(regexp_replace(p_type || ' ' || p_brand, '\\s+', ' ', 'g'))) AS title, p_partkey, p_size, p_name FROM part)
SELECT title, count(*) AS n_ids, max(p_size) AS severity, arg_max(p_name, (length(p_name), p_name)) AS description FROM n GROUP BY title""")
def finding_merge(t: Tables):
    from clausewise.plans.findings import merge

    rows = t.part.select(F.concat_ws(" ", "p_type", "p_brand").alias("title"), F.col("p_partkey").alias("id"), F.col("p_size").alias("severity"), F.col("p_name").alias("description"))
    return merge(rows).select("title", "n_ids", "severity", "description")


# --- sorting and limits ---


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_totalprice ASC, o_orderkey")
def sort_multi(t: Tables):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id OFFSET 40 LIMIT 20")
def page_offset(t: Tables):
    return ranking.page(t.events, [F.desc("ts"), "event_id"], 40, 20).select("event_id", "ts")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def last_n_messages(t: Tables):
    return ranking.first_per(t.conversations, ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("""SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 9) AS distance
FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), vec_id LIMIT 20""")
def knn_cosine(t: Tables):
    from clausewise.plans.retrieval import nearest

    asked = t.embeddings.where("vec_id = 3").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return nearest(t.embeddings, asked, 20).select("vec_id", F.round("distance", 9).alias("distance"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey FROM lineitem
ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 12""")
def priority_sort(t: Tables):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.orderBy(rank, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(12).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END,
CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r <= 5""")
def decisive_top5(t: Tables):
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), "o_orderkey"]
    return ranking.first_per(t.orders.where("o_orderstatus <> 'F'"), ["o_custkey"], order, 5).select("o_custkey", "o_orderkey")


@query("SELECT event_type, event_id FROM events ORDER BY event_type, event_id")
def severity_lex(t: Tables):
    return t.events.orderBy("event_type", "event_id").select("event_type", "event_id")


@query("""SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source""")
def latest_one(t: Tables):
    return t.documents.groupBy("source").agg(F.max_by("doc_id", "doc_id").alias("doc_id"))


# --- windows ---


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def win_keep_latest(t: Tables):
    return ranking.first_per(t.orders, ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def win_demote(t: Tables):
    return ranking.demote_others(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderstatus", "X", F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderstatus")


@query("""SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey""")
def win_distinct_on(t: Tables):
    return ranking.first_per(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def win_latest_run(t: Tables):
    return ranking.first_per(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey")
def win_first_evidence(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"))


@query("""SELECT user_id, event_type, min(r) AS best FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) GROUP BY ALL""")
def lex_best_rank(t: Tables):
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long")
    return t.events.withColumn("r", r).groupBy("user_id", "event_type").agg(F.min("r").alias("best"))


@query("""WITH b AS (SELECT conv_id, turn, text, least(length(text), 400) AS want, 600 - coalesce(sum(least(length(text), 400)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM conversations)
SELECT conv_id, turn, substring(text, 1, CAST(greatest(0, least(want, remaining)) AS INT)) AS text FROM b WHERE least(want, remaining) > 0""")
def win_budget_clip(t: Tables):
    return ranking.clip_to_budget(t.conversations, ["conv_id"], ["turn"], "text", 600, 400).select("conv_id", "turn", "text")


@query("""WITH b AS (SELECT conv_id, turn, text, length(text) AS want, 500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM conversations)
SELECT conv_id, turn, right(text, CAST(greatest(0, least(want, remaining)) AS INT)) AS text FROM b WHERE least(want, remaining) > 0""")
def win_history_budget(t: Tables):
    return ranking.clip_to_budget(t.conversations, ["conv_id"], [F.desc("turn")], "text", 500, 1 << 30, from_end=True).select("conv_id", "turn", "text")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id FROM events""")
def win_parent_section(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("parent_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey) > 1 THEN 'FAILED' ELSE o_orderstatus END AS status,
coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN 'kept' END, CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey) > 1 THEN 'DUPLICATE' END) AS error FROM orders""")
def win_fail_duplicates(t: Tables):
    rank = F.row_number().over(Window.partitionBy("o_custkey", F.col("o_orderstatus") == "O").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    late = (F.col("o_orderstatus") == "O") & (rank > 1)
    return t.orders.select("o_orderkey", F.when(late, "FAILED").otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce(F.when(F.col("o_orderpriority") == "5-LOW", "kept"), F.when(late, "DUPLICATE")).alias("error"))


# --- sets ---


@query("SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except(t: Tables):
    return t.orders.select("o_custkey").distinct().join(t.orders.where("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_anti")


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(t: Tables):
    a, r = (t.lineitem.where(f"l_returnflag = '{x}'").select("l_suppkey") for x in "AR")
    return a.intersect(r)


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size > 48")
def set_union(t: Tables):
    return t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).union(t.part.where("p_size > 48").select("p_partkey")).distinct()


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS both_present FROM orders GROUP BY o_custkey")
def set_subset(t: Tables):
    need = F.array(F.lit("F"), F.lit("O"))
    return t.orders.groupBy("o_custkey").agg((F.size(F.array_except(need, F.collect_set("o_orderstatus"))) == 0).alias("both_present"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels l WHERE toxic = 1 AND quality <> 1")
def set_append_missing(t: Tables):
    first = t.labels.where("quality = 1").select("doc_id")
    return first.unionByName(t.labels.where("toxic = 1").select("doc_id").join(first, "doc_id", "left_anti"))


@query("""SELECT p_partkey, array_to_string(list_distinct([p_type, p_brand, p_type]), '|') IS NOT NULL AS ok, len(list_distinct([p_type, p_brand, p_type])) AS n FROM part""")
def set_ordered_union(t: Tables):
    u = F.array_distinct(F.array("p_type", "p_brand", "p_type"))
    return t.part.select("p_partkey", F.array_join(u, "|").isNotNull().alias("ok"), F.size(u).cast("long").alias("n"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2)) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE END, 9) AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccard(t: Tables):
    w = t.conversations.select("conv_id", "turn", scores.tokens(F.col("text")).alias("w"))
    a, b = w.alias("a"), w.alias("b")
    pair = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return pair.select("a.conv_id", "a.turn", F.round(scores.jaccard(F.col("a.w"), F.col("b.w")), 9).alias("similarity"))
