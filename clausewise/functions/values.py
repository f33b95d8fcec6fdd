"""Values in texts: money, ratios, years, whole numbers, times, ids; and comparisons that know "unknown"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese units of money.
UNITS = {"亿": 100_000_000, "万": 10_000}


def first_number(text: Column) -> Column:
    """The first number without grouping commas, as a decimal; null if there is none."""
    n = F.regexp_extract(F.regexp_replace(text, "[,，]", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return F.nullif(n, F.lit("")).try_cast("decimal(30,6)")


def money(text: Column) -> Column:
    """Amount in units; 万 and 亿 count as ten thousand and a hundred million."""
    scale = F.lit(1)
    for unit, times in reversed(UNITS.items()):
        scale = F.when(text.contains(unit), F.lit(times)).otherwise(scale)
    return (first_number(text) * scale).cast("decimal(38,6)")


def ratio(text: Column) -> Column:
    """A share of 1: per cent signs, and plain numbers over 1, are divided by 100."""
    n = first_number(text).cast("double")
    return F.when(text.rlike("[%％]") | (n > 1), n / 100).otherwise(n)


def years(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit("")).try_cast("bigint")


def whole(text: Column) -> Column:
    """Strictly a whole number, white space around it aside."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))


def at_least(value: Column, least: Column) -> Column:
    """Unknown counts as no."""
    return F.coalesce(value.try_cast("double") >= least.try_cast("double"), F.lit(False))


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


_OFFSET = r"(?i:Z|[+-][0-9]{2}:?[0-9]{2})$"


def iso_time(text: Column) -> Column:
    """An ISO date or time, in UTC if it has no offset; null if it is none."""
    t = F.trim(text)
    ok = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(?i:Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    whole = F.regexp_replace(F.regexp_replace(t, r"([T ][0-9]{2}:[0-9]{2})(?![:0-9])", "$1:00"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    zoned = F.when(~t.contains(":"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(_OFFSET), whole).otherwise(F.concat(F.regexp_replace(t, r"([T ][0-9]{2}:[0-9]{2})(?![:0-9])", "$1:00"), F.lit("Z")))
    return F.when(ok, F.try_to_timestamp(F.upper(zoned)))


def deadline(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """Times without an offset are local to `zone`."""
    return F.when(F.trim(text).rlike(_OFFSET) & text.contains(":"), iso_time(text)).otherwise(F.to_utc_timestamp(iso_time(text), zone))
