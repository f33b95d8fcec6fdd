"""Top rows, latest rows and budgets by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Catalyst limits groups before the shuffle."""
    r = rank or "_rank"
    out = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= n)
    return out if rank else out.drop(r)


def placed(df: DataFrame, keys: list[str], order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds the place of a row among those of its key, from 1, by `order`, a whole number without repeats.

    Places are counted in ranges of `width` numbers, and ranges by their sizes, so no task has all rows of a key.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / width))
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), before.alias("_before"))
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return rows.join(starts, same).withColumn(name, F.col("_before") + inside).select(*df.columns, name)


def demote_others(df: DataFrame, keys: list[str], order: list, status: str, to: str, where: Column) -> DataFrame:
    """Among the rows where `where` holds, all but the first of each key get the status `to`."""
    rank = F.row_number().over(Window.partitionBy(*keys, where).orderBy(*order))
    return df.withColumn(status, F.when(where & (rank > 1), F.lit(to)).otherwise(F.col(status)))


def clip_to_budget(df: DataFrame, keys: list[str], order: list, text: str, budget: int, each: int, from_end: bool = False) -> DataFrame:
    """Texts in order, each cut to `each` and to what earlier ones have left of the budget; empty ones go.

    `from_end` keeps the end of a text that doesn't fit, for histories read backwards.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.length(text), F.lit(each))
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(want).over(w), F.lit(0)))
    n = F.least(want, left).cast("int")
    piece = F.when(n > 0, F.right(F.col(text), n)).otherwise("") if from_end else F.substring(F.col(text), F.lit(1), n)
    return df.withColumn(text, piece).where(F.length(text) > 0)


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def charged(texts: Column, budget: int, each: int) -> Column:
    """The texts of an array, cut to `each` and to what is left of the budget, then stripped; what is charged is the length that stays.

    A text that is cut at blanks leaves room for the next one, so that what is left depends on what was kept: a fold. Texts beyond
    the budget are empty, nulls too.
    """
    begin = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("kept"))

    def take(s, text):
        cut = F.when(s.left > 0, stripped(F.substring(F.coalesce(text, F.lit("")), F.lit(1), F.least(s.left, F.lit(each))))).otherwise("")
        return F.struct((s.left - F.length(cut)).alias("left"), F.concat(s.kept, F.array(cut)).alias("kept"))

    return F.aggregate(texts, begin, take, lambda s: s.kept)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
