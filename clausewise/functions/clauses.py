"""Clause numbers: where clauses start, keys and parents, splits at boundaries the text itself has. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of clause numbers, list items, staged items and sentence ends.
NUMERIC = r"(?U)^\s*(\d{1,3}(?:\.\d{1,3}){1,4})(?=\s|[、.．:：])"
CHINESE = r"(?U)^\s*(第[一二三四五六七八九十百千\d]+[编章节条])"
ITEM = r"(?U)^\s*[（(]([一二三四五六七八九十\d]{1,2})[）)]"
START = r"(?U)^\s*(?:第[一二三四五六七八九十百千\d]+[编章节条]|\d{1,3}(?:\.\d{1,3}){1,4}(?!\d)|[（(](?:[一二三四五六七八九十]|\d{1,2})[）)]|[①②③④⑤⑥⑦⑧⑨⑩])"
LEADING_PAGE = r"(?U)^\s*\d{1,3}\s+(?=(?:第[一二三四五六七八九十百]+条|\d{1,2}\.))"
NUMBERED_AT = r"(?U)(?:^|(?<=[。；：\n]))\s*(?=(?:第[一二三四五六七八九十百]+条|\d{1,2}(?:\.\d{1,2}){1,3})\s*)"
ITEM_AT = r"(?U)(?:^|(?<=[。；：\n]))\s*(?=[（(](?:[一二三四五六七八九十]|\d{1,2})[）)])"
STAGED_AT = r"(?U)(?<!(?:第[一二三四五六七八九十百]{1,18}条|\d\.\d{1,2}|\d\.\d{1,2}\.\d{1,2})\s{0,16})(?=第[一二三四五六七八九十]+次\s*(?:支付|交付|验收|结算)[：:])"
SENTENCE_END = r"(?U)(?<=[。！？；;])\s*|\n{2,}|\n"
_NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")
_CUT = "\x1e"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def starts_clause(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(START)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def item_value(item: Column) -> Column:
    """一 is 1 and so on to 十; digits stay."""
    names = F.create_map(*[F.lit(x) for i, c in enumerate(_NUMERALS, 1) for x in (c, str(i))])
    return F.coalesce(F.try_element_at(names, item), item)


def parent_of(key: Column) -> Column:
    """The key without its last part, null if it has one part."""
    return F.nullif(F.regexp_extract(key, r"^(.*)\.[^.]*$", 1), F.lit(""))


def with_clauses(nodes: DataFrame, keys: list[str], order: str, section: str = "section", text: str = "content") -> DataFrame:
    """Adds `clause` and `parent`, the keys of a node's clause and of the one above it.

    A numbered clause is in force until the next one or another section; a list item under it has
    its number below the clause's, other nodes have the clause's own.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    here, before = (F.coalesce(x, F.lit("")) for x in (F.col(section), F.lag(section).over(w)))
    body = stripped(F.col(text))
    numeric, chinese, item = _found(body, NUMERIC), _found(body, CHINESE), _found(body, ITEM)
    rows = nodes.withColumn("_new", (here != before).cast("int")).withColumn("_key", F.coalesce(numeric, chinese)).withColumn("_item", F.when(numeric.isNull() & chinese.isNull(), item)).withColumn("_top", numeric.isNull() & chinese.isNotNull())
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_new").over(so_far))
    active = F.last("_key", ignorenulls=True).over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_active", active)
    below = F.col("_key").isNull() & F.col("_item").isNotNull() & F.col("_active").isNotNull()
    clause = F.when(below, F.concat_ws(".", "_active", item_value(F.col("_item")))).otherwise(F.col("_active"))
    parent = F.when(below, F.col("_active")).when(~F.col("_top"), parent_of(F.col("_active")))
    return rows.withColumn("clause", clause).withColumn("parent", parent).drop("_new", "_key", "_item", "_top", "_run", "_active")


def clause_parts(text: Column) -> Column:
    """The text cut where numbered clauses, stages or list items begin; whole if nothing begins."""
    body = F.regexp_replace(stripped(text), LEADING_PAGE, "")
    cut = reduce(lambda t, p: F.regexp_replace(t, p, f"$0{_CUT}"), (NUMBERED_AT, ITEM_AT, STAGED_AT), body)
    return F.filter(F.transform(F.split(cut, _CUT), stripped), lambda x: x != "")


def windows(text: Column, most: int, overlap: int) -> Column:
    """Pieces of at most `most` characters, each beginning `overlap` before the end of the last."""
    step = max(1, most - (overlap if overlap < most else most // 8))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: stripped(F.substring(text, i + 1, F.lit(most))))


def oversized_parts(text: Column, most: int, overlap: int) -> Column:
    """Sentences put together to parts of at most `most` characters; a part begins with the end of the last one.

    A longer sentence is cut into windows, with nothing from before it.
    """
    sentences = F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda x: x != "")
    units = F.when(F.size(sentences) == 0, F.array(text)).otherwise(sentences)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def add(acc: Column, unit: Column) -> Column:
        longer = F.when(acc["open"] != "", F.concat_ws("\n", acc["open"], unit)).otherwise(unit)
        tail = stripped(F.right(acc["open"], F.lit(overlap))) if overlap else F.lit("")
        next_ = F.when(tail != "", F.concat_ws("\n", tail, unit)).otherwise(unit)
        done = F.when(F.length(unit) > most, F.concat(closed(acc), windows(unit, most, overlap))).when((acc["open"] != "") & (F.length(longer) > most), closed(acc)).otherwise(acc["done"])
        open_ = F.when(F.length(unit) > most, F.lit("")).when((acc["open"] != "") & (F.length(longer) > most), next_).otherwise(longer)
        return F.struct(done.alias("done"), open_.alias("open"))

    parts = F.aggregate(units, start, add, closed)
    return F.filter(F.transform(F.when(F.length(text) <= most, F.array(text)).otherwise(parts), stripped), lambda x: x != "")
