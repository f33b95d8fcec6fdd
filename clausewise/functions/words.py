"""Words of texts of any script. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of letters and digits; Han characters are words of one or two.
HAN, PLAIN = r"\p{IsHan}", r"[\p{L}\p{N}]+"
WORD = r"\p{IsHan}(?=(\p{IsHan}))|\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def words(text: Column) -> Column:
    """The words of a text in order: runs of letters and digits, pairs of neighbouring Han characters."""
    text = F.lower(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(HAN), _with_han(text)).otherwise(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)))


def _with_han(text: Column) -> Column:
    one, after = (F.regexp_extract_all(text, F.lit(WORD), F.lit(i)) for i in (0, 1))
    pairs = F.zip_with(one, after, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    # the last Han character of a longer run is in the pair before it
    last = lambda x, i: (F.length(x) == 1) & x.rlike(r"^\p{IsHan}$") & (i > 0) & F.coalesce(F.get(pairs, i - 1).endswith(x) & F.get(pairs, i - 1).rlike(r"^\p{IsHan}{2}$"), F.lit(False))
    return F.filter(pairs, lambda x, i: ~last(x, i))
