"""Cleaning of a document's nodes: why a node isn't used, which short residues join the node before, what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions import text as T
from clausewise.functions.clauses import starts_clause
from clausewise.plans.chunking import ATOMIC, GOES_ON, SENTENCE_CLOSED
from clausewise.plans.sections import contents_run


@dataclass(frozen=True)
class Rules:
    """Patterns and limits of a language: a contents' heading (whole), an entry with its ordinal as group 1, a page's own marks (whole), ordinary characters, a contents page's title."""

    heading: str
    entry: str
    artifact: str
    ordinary: str
    title: str
    meaningful: int = 8
    repeated: int = 3
    short_key: int = 120
    residue: int = 28


def _ordinal(text: Column, rules: Rules) -> Column:
    """The ordinal of an entry of a contents (64 bits, as a line may begin with a card's number), -1 for other texts; 一 to 十 count as 1 to 10."""
    found = F.nullif(F.regexp_extract(text, rules.entry, 1), F.lit(""))
    numerals = F.create_map(*[F.lit(x) for i, c in enumerate("一二三四五六七八九十", 1) for x in (c, i)])
    return F.coalesce(found.try_cast("long"), F.try_element_at(numerals, found), F.lit(-1))


def cleaned(nodes: DataFrame, key: str, rules: Rules) -> DataFrame:
    """(key, order_no, reason, into, text) of nodes (key, order_no, kind, section, page, content, marginal, template), normal forms already.

    The first reason counts, in this order: contents (a heading, then entries while their ordinals
    rise), a marginal node, a table without values, nothing or a page's own mark, what can't be indexed, a fragment that
    its section has three times or more (but for the first that comes so far), too little text, garbled text. What is too short joins
    the last node in use of its page, unless that or itself is a table or image, it begins a clause, or the sentence is closed and doesn't go on:
    `into` is the order_no it joins, `text` what a node in use has with its residues.
    """
    text = F.coalesce("content", F.lit(""))
    w = Window.partitionBy(key).orderBy("order_no")
    rows = nodes.withColumn("content", text).withColumn("heading", F.col("content").rlike(rules.heading)).withColumn("ordinal", _ordinal(F.col("content"), rules))
    rows = contents_run(rows, [key], "order_no")
    early = F.when(F.col("heading"), "CONTENTS_HEADING").when(F.col("contents"), "CONTENTS_ENTRY").when(F.col("marginal"), "LAYOUT_ARTIFACT").when((F.upper("kind") == "TABLE") & F.col("template"), "EMPTY_TABLE_TEMPLATE")
    early = early.when((F.col("content") == "") | F.col("content").rlike(rules.artifact), "PAGE_ARTIFACT")
    rows = rows.withColumn("bare", T.bare(F.col("content"))).withColumn("early", F.coalesce(early, T.gate(F.col("content"), rules.ordinary, rules.title, seen=F.col("bare"))))
    rows = rows.drop("bare").withColumn("fragment", T.duplicate_key(F.col("content"))).withColumn("place", F.coalesce("section", F.lit("")))
    same = Window.partitionBy(key, "place", "fragment")
    often = (F.length("fragment").between(1, rules.short_key)) & (F.count("*").over(same) >= rules.repeated)
    reached = F.sum(F.col("early").isNull().cast("int")).over(same.orderBy("order_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("again", often & (reached > 1))
    little = F.length(F.regexp_replace("content", r"[^\p{L}\p{N}]", "")) < rules.meaningful
    rows = rows.withColumn("reason", F.coalesce("early", F.when(F.col("again"), "DUPLICATE_FRAGMENT").when(little, "TOO_SHORT")))

    # of nodes in use and short ones: whether what came last leaves its sentence open
    use, short = F.col("reason").isNull(), F.col("reason") == "TOO_SHORT"
    closed, goes_on, block = F.col("content").rlike(SENTENCE_CLOSED), F.col("content").rlike(GOES_ON), F.upper("kind").isin(*ATOMIC)
    base = F.last(F.when(use, F.struct("order_no", "page", block.alias("block"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("base", base)
    may = short & F.col("base").isNotNull() & F.col("base.page").eqNullSafe(F.col("page")) & ~F.col("base.block") & ~block & ~starts_clause(F.col("content")) & (F.length(F.regexp_replace("content", r"(?U)\s+", "")) <= rules.residue)
    rows = rows.withColumn("may", F.coalesce(may, F.lit(False)))
    # a node in use, or a residue that joins whatever came before, sets the state anew; other residues can only close it
    sets = use | (F.col("may") & goes_on)
    rows = rows.withColumn("run", F.sum(F.coalesce(sets, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy(key, "run").orderBy("order_no").rowsBetween(Window.unboundedPreceding, -1)
    first_closed = F.last(F.when(sets, closed), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    shut = first_closed | F.coalesce(F.max(F.when(F.col("may") & ~goes_on, closed)).over(before), F.lit(False))
    joins = F.col("may") & (goes_on | ~shut)
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False)))
    into = F.when(F.col("joins"), F.col("base.order_no")).when(use, F.col("order_no"))
    rows = rows.select(key, "order_no", "content", F.when(F.col("joins"), "MERGED_SHORT_RESIDUE").otherwise(F.col("reason")).alias("reason"), into.alias("into"))
    parts = rows.where("into is not null").groupBy(key, "into").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_no", "content"))), lambda x: x["content"]), " ").alias("text"))
    whole = parts.withColumnRenamed("into", "order_no").withColumn("reason", F.lit(None).cast("string"))
    return rows.select(key, "order_no", "reason", "into").join(whole.select(key, "order_no", "text"), [key, "order_no"], "left")


def summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, total, indexable, reasons) of cleaned nodes; reasons is a sorted text of `reason=count`."""
    each = rows.groupBy(key, "reason").agg(F.count("*").alias("n"))
    said = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("n").cast("string"))))), ",")
    return each.groupBy(key).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("indexable"), said.alias("reasons"))


def knowledge_cleaned(nodes: DataFrame, key: str, rules: Rules) -> DataFrame:
    """The nodes (key, order_no, content, marginal, and more) that stay of a knowledge text, with the reason of the others: marginal, empty, or of the contents."""
    rows = nodes.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("_gone", F.coalesce("marginal", F.lit(False)) | (F.col("content") == ""))
    left = rows.where(~F.col("_gone")).withColumn("heading", F.col("content").rlike(rules.heading)).withColumn("ordinal", _ordinal(F.col("content"), rules))
    left = contents_run(left, [key], "order_no").withColumn("reason", F.when(F.col("contents"), "CONTENTS"))
    return rows.where("_gone").withColumn("reason", F.lit("EMPTY")).select(*nodes.columns, "reason").unionByName(left.select(*nodes.columns, "reason"))
