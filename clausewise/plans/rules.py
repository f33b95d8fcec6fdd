"""Declarative rules: a definition becomes one Column, so a rule is a filter that Catalyst sees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators of a condition, those that need no value, what conditions may read.
OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE", "IN", "EXISTS", "NOT_EXISTS", "LT_NOW", "DATE_BEFORE")
ALONE = ("EXISTS", "NOT_EXISTS", "LT_NOW")
SOURCES = ("project", "requirement", "material")
MOST = 32


class InvalidRule(ValueError):
    """A definition that can't be a rule."""


def _plain(value) -> bool:
    return value is None or isinstance(value, (bool, int, float, str))


def validate(definition: dict, fields: set[str], builtin: bool = False) -> None:
    """Rules of users read the project's `fields` only, and compare no dates; built-in ones also read requirements and materials."""
    if not isinstance(definition, dict) or set(definition) != {"all", "message_template", "evidence_selector"}:
        raise InvalidRule("a rule has all, message_template and evidence_selector")
    if not isinstance(definition["all"], list) or not 1 <= len(definition["all"]) <= MOST:
        raise InvalidRule(f"a rule has 1 to {MOST} conditions")
    if not isinstance(definition["message_template"], str) or not definition["message_template"].strip():
        raise InvalidRule("a rule has a message")
    if not isinstance(definition["evidence_selector"], dict) or not definition["evidence_selector"]:
        raise InvalidRule("a rule selects its evidence")
    for c in definition["all"]:
        if not isinstance(c, dict) or not {"source", "field", "op"} <= set(c) <= {"source", "field", "op", "value"}:
            raise InvalidRule("a condition has source, field, op and maybe value")
        if c["source"] not in (SOURCES if builtin else SOURCES[:1]) or c["op"] not in OPERATORS:
            raise InvalidRule(f"unknown operator or source in {c}")
        if c["source"] == "project" and c["field"] not in fields:
            raise InvalidRule(f"unknown field in {c}")
        if c["op"] == "DATE_BEFORE" and not builtin:
            raise InvalidRule("DATE_BEFORE is for built-in rules")
        if c["op"] not in ALONE and "value" not in c:
            raise InvalidRule(f"no value in {c}")
        v = c.get("value")
        other = isinstance(v, dict) and set(v) == {"source", "field"} and v["source"] == "project" and v["field"] in fields
        if not (_plain(v) or other or (isinstance(v, list) and all(map(_plain, v)))):
            raise InvalidRule(f"a value is plain, a list or a project's field, not {v}")


def _column(source: str, field: str) -> Column:
    """Fields of the project are columns, those of requirements and materials of the structs named so."""
    return F.col(field) if source == "project" else F.col(source)[field]


def _condition(c: dict, now: Column) -> Column:
    actual, op, value = _column(c["source"], c["field"]), c["op"], c.get("value")
    if op in ("EXISTS", "NOT_EXISTS"):
        return actual.isNotNull() if op == "EXISTS" else actual.isNull()
    if op == "LT_NOW":
        return F.coalesce(actual.try_cast("timestamp") < now, F.lit(False))
    if op == "IN":
        return F.coalesce(actual.isin(value), F.lit(False)) if isinstance(value, list) else F.lit(False)
    expected = _column(value["source"], value["field"]) if isinstance(value, dict) else F.lit(value)
    if op in ("EQ", "NE"):
        same = actual.eqNullSafe(expected)
        return same if op == "EQ" else ~same
    if op == "DATE_BEFORE":
        return F.coalesce(actual.try_cast("date") < expected.try_cast("date"), F.lit(False))
    a, b = (x.cast("string").try_cast("decimal(38,6)") for x in (actual, expected))
    hit = {"GT": a > b, "GTE": a >= b, "LT": a < b, "LTE": a <= b}[op]
    return F.coalesce(hit, F.lit(False))


def compile_rule(definition: dict, now: Column | None = None) -> Column:
    """True where every condition holds; values that can't be compared don't hit."""
    now = F.current_timestamp() if now is None else now
    return reduce(lambda a, b: a & b, (_condition(c, now) for c in definition["all"]))


def merge_reviewed(found: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Risks found now, with the status that a person gave to those that were there before; others are open."""
    old = kept.select(*keys, F.col("status").alias("_status"))
    return found.join(old, keys, "left").withColumn("status", F.coalesce("_status", F.lit("OPEN"))).drop("_status")
