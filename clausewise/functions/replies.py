"""Replies of language models: fences, quotes that break JSON, items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What may follow the end of a JSON string.
_AFTER = ",}]:"


def _repaired(text: str | None) -> str | None:
    """JSON with the quotes inside its strings escaped: a quote ends a string only where a structure sign or nothing follows."""
    if text is None:
        return None
    out, pieces = [], text.split('"')
    inside = escaped = False
    for i, piece in enumerate(pieces):
        out.append(piece)
        if i == len(pieces) - 1:
            break
        slashes = len(piece) - len(piece.rstrip("\\"))
        escaped = inside and slashes % 2 == 1
        if escaped or not inside:
            inside = True
            out.append('"')
            continue
        rest = '"'.join(pieces[i + 1 : i + 2]).lstrip(" \t\r\n")
        last = not rest and i + 2 >= len(pieces)
        if last or rest[:1] and rest[0] in _AFTER:
            inside = False
            out.append('"')
        else:
            out.append('\\"')
    return "".join(out)


@F.pandas_udf(StringType())
def repaired(text: pd.Series) -> pd.Series:
    """See `_repaired`: where a string ends depends on all before it, which no expression tells."""
    return text.map(_repaired, na_action="ignore")


def unfenced(text: Column) -> Column:
    """Without a Markdown fence around it."""
    return F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*|\s*```$", "")


def items(text: Column) -> Column:
    """The array `items` of a reply as JSON texts, as it is or repaired; null if there is none."""
    plain = unfenced(text)
    fixed = repaired(plain)
    read = lambda t: F.from_json(F.get_json_object(t, "$.items"), "array<string>")
    valid = lambda t: F.try_parse_json(t).isNotNull()
    whole = F.when(valid(plain), plain).when(valid(fixed), fixed)
    return F.when(F.substring(F.get_json_object(whole, "$.items"), 1, 1) == "[", read(whole))
