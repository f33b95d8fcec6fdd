"""Order-dependent structure of documents, as windows over their lines or nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions.clauses import clause_parts


def _so_far(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def section_path(nodes: DataFrame, keys: list[str], order: str, depth: int, sep: str = " / ") -> DataFrame:
    """Adds `path`: the titles of the headings in force. `level` is 1 .. depth at a heading, null elsewhere.

    A heading is in force until one of its level or above follows.
    """
    w = _so_far(keys, order)
    at = [F.last(F.when(F.col("level") == i, F.struct(F.col(order).alias("at"), F.col("title").alias("title"))), ignorenulls=True).over(w) for i in range(1, depth + 1)]
    out = nodes.select("*", *(a.alias(f"_h{i}") for i, a in enumerate(at)))
    parts, above = [], None
    for i in range(depth):
        here = F.col(f"_h{i}.at")
        parts.append(F.col(f"_h{i}.title") if above is None else F.when(here > F.coalesce(above, F.lit(-1)), F.col(f"_h{i}.title")))
        above = here if above is None else F.greatest(above, here)
    return out.withColumn("path", F.concat_ws(sep, *parts)).drop(*(f"_h{i}" for i in range(depth)))


def active_key(nodes: DataFrame, keys: list[str], order: str, key: str, cut: Column) -> DataFrame:
    """Adds `active`: the last key of the run; a run begins where `cut` holds."""
    runs = nodes.withColumn("_run", F.sum(cut.cast("int")).over(_so_far(keys, order)))
    return runs.withColumn("active", F.last(key, ignorenulls=True).over(_so_far([*keys, "_run"], order))).drop("_run")


def contents_run(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `contents`: a table of contents begins at a heading and lasts while ordinals rise.

    Needs the columns heading and ordinal.
    """
    s = nodes.withColumn("_seg", F.sum(F.col("heading").cast("int")).over(_so_far(keys, order)))
    before = F.lag(F.when(~F.col("heading"), F.col("ordinal"))).over(Window.partitionBy(*keys, "_seg").orderBy(order))
    bad = F.when(~F.col("heading") & (F.col("ordinal") <= F.coalesce(before, F.lit(-1))), 1).otherwise(0)
    s = s.withColumn("_bad", bad)
    return s.withColumn("contents", (F.col("_seg") > 0) & (F.max("_bad").over(_so_far([*keys, "_seg"], order)) == 0)).drop("_seg", "_bad")


def rebuilt_clauses(nodes: DataFrame, links: DataFrame, key: str, mandatory: str) -> DataFrame:
    """(key, clause_no, order_no, section, content, context, hash, mandatory, type, evidence) of nodes (key, order_no, kind, section, content).

    Headings and blank nodes have no clauses, tables and lists are one each, other nodes are cut
    where their text says that a clause begins; numbers go through the document. A clause has its node's
    evidence from `links` (key, order_no, place, evidence), each once, in order.
    """
    parts = F.when(F.upper("kind").isin("TABLE", "LIST"), F.array("content")).otherwise(clause_parts(F.col("content")))
    each = nodes.where((F.upper("kind") != "SECTION") & F.col("content").isNotNull()).select(key, "order_no", "section", F.posexplode(parts).alias("_part", "content"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("order_no", "_part"))
    first = links.groupBy(key, "order_no", "evidence").agg(F.min("place").alias("place"))
    evidence = first.groupBy(key, "order_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    must = F.col("content").rlike(mandatory)
    out = each.withColumn("clause_no", number).join(evidence, [key, "order_no"], "left")
    context = F.concat(F.coalesce(F.concat(F.lit("章节："), "section", F.lit("\n")), F.lit("")), "content")
    return out.select(key, "clause_no", "order_no", "section", "content", context.alias("context"), F.sha2("content", 256).alias("hash"), must.alias("mandatory"), F.when(must, "REQUIREMENT").otherwise("TEXT").alias("type"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
