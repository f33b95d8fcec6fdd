"""Text cells of web pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references by their characters; Spark has no function for them."""
    return text.map(html.unescape, na_action="ignore")


def inner(page: Column, tag: str) -> Column:
    """Contents of every element of a kind, inner markup dropped."""
    found = F.regexp_extract_all(page, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def cells(pages: DataFrame, key: str, tags: list[str], page: str = "html") -> DataFrame:
    """(key, kind, place, cell) of the elements of all kinds; one pass over the pages."""
    found = F.concat(*[_tagged(F.col(page), tag) for tag in tags])
    return pages.select(key, F.explode(found).alias("c")).select(key, "c.kind", "c.place", "c.cell")


def _tagged(page: Column, tag: str) -> Column:
    return F.transform(inner(page, tag), lambda x, i: F.struct(F.lit(tag).alias("kind"), i.alias("place"), x.alias("cell")))


_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"


def table_rows(page: Column) -> Column:
    """Rows of cells of the tables of a page: markup dropped, character references resolved, white space folded; rows without cells go."""
    fold = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"(?U)\s+", " "))
    rows = F.transform(F.regexp_extract_all(page, F.lit(_ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(1)), fold))
    # all cells of a page are resolved as one text, between signs that no page has
    joined = F.array_join(F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.array_join(r, "\x1f")), "\x1e")
    whole = F.when(joined.contains("&"), unescaped(joined)).otherwise(joined)
    cells = F.transform(F.split(whole, "\x1e"), lambda r: F.transform(F.split(r, "\x1f"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    return F.when(F.size(F.filter(rows, lambda r: F.size(r) > 0)) > 0, cells).otherwise(F.array().cast("array<array<string>>"))
