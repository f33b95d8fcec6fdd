"""Tables in texts: rows of cells as arrays of arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.text import cell

PLACEHOLDER = r"^(?:[\s0-9.。…_—-]*)$"


def is_empty_template(rows: Column) -> Column:
    """Two rows at least, and no cell after the header row says anything."""
    data = F.flatten(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    return (F.size(rows) >= 2) & F.forall(data, lambda x: F.coalesce(x.rlike(PLACEHOLDER), F.lit(True)))


def markdown(rows: Column) -> Column:
    """A Markdown table: rows are cut or filled up to the header's width, pipes escaped; no rows: empty."""
    width = F.size(F.element_at(rows, 1))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(cell(F.get(r, i - 1)), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    whole = F.concat(F.array(line(F.element_at(rows, 1)), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(whole, "\n")).otherwise("")


def retrieval_text(rows: Column) -> Column:
    """The header, then each row as "header: value" pairs of its filled cells."""
    header = F.element_at(rows, 1)
    pair = lambda h, v: F.when((F.coalesce(v, F.lit("")) != ""), F.concat(h, F.lit(": "), v))
    line = lambda r: F.array_join(F.array_compact(F.zip_with(header, r, pair)), "; ")
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.array_join(header, " | ")), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise("")
