"""What a model extracted, held against the catalogue of tags, the evidence and the relations of tags.

Values are VARIANTs: a value's type is its JSON type, not what its text looks like.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.values import iso_time

# Words that point to an attachment.
ATTACHMENT = "附件|附表|附录|详见"
_NUMBER = r"^\s*[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
#: Characters of a source text that are kept.
QUOTE = 4000


@dataclass(frozen=True)
class Tag:
    """A tag of the catalogue; `pattern` must match the whole of a text value."""

    code: str
    data_type: str
    multi: bool = False
    required: bool = False
    pattern: str | None = None


def _kind(value: Column) -> Column:
    """The JSON type of a value as the engine names it; null and JSON's null are VOID."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text(value: Column) -> Column:
    return F.when(_kind(value).startswith("STRING"), F.try_variant_get(value, "$", "string"))


def _elements(value: Column) -> Column:
    return F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def is_blank(value: Column) -> Column:
    """No value, JSON's null, or a text of white space."""
    return (_kind(value) == "VOID") | F.coalesce(_text(value).rlike(r"^(?U)\s*$"), F.lit(False))


def has_type(value: Column, data_type: str) -> Column:
    """Whether a value has one of the six types of tags; of others none has."""
    kind = _kind(value)
    filled = (kind.startswith("ARRAY") & (F.size(_elements(value)) > 0)) if data_type == "array" else None
    if data_type == "string":
        test = kind.startswith("STRING") & ~is_blank(value)
    elif data_type == "number":
        numeric = reduce(lambda a, b: a | b, (kind.startswith(k) for k in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")))
        test = numeric | F.coalesce(_text(value).rlike(_NUMBER), F.lit(False))
    elif data_type == "datetime":
        test = iso_time(_text(value)).isNotNull()
    elif data_type == "boolean":
        test = kind == "BOOLEAN"
    elif data_type == "array":
        test = filled
    elif data_type == "json":
        test = (kind.startswith("OBJECT") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY") & (F.size(_elements(value)) > 0))
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


def has_pattern(value: Column, pattern: str) -> Column:
    """Whether a text matches as a whole; a pattern that is none matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce(_text(value).rlike(f"^(?:{pattern})\\z"), F.lit(False))


def _single(value: Column, tag: Tag) -> Column:
    ok = has_type(value, tag.data_type)
    return ok if tag.pattern is None else ok & has_pattern(value, tag.pattern)


def matches(value: Column, tag: Tag) -> Column:
    """Whether a value fits a tag; with several values, an array that isn't empty of which all do."""
    if not tag.multi:
        return _single(value, tag)
    found = _elements(value)
    return F.coalesce((F.size(found) > 0) & F.forall(found, lambda x: _single(x, tag)), F.lit(False))


def checks(code: Column, value: Column, catalogue: list[Tag]) -> Column:
    """The catalogue as one condition: the value fits the tag of this code; codes that aren't in it have none that fits."""
    return reduce(lambda rest, tag: F.when(code == tag.code, matches(value, tag)).otherwise(rest), catalogue, F.lit(False))


def accepted(candidates: DataFrame, evidence: DataFrame, catalogue: list[Tag]) -> DataFrame:
    """The `candidates` (item VARIANT, and more) with code, value, confidence, evidence, source_text and `issue`, null if accepted.

    `evidence` (evidence, text, codes): an evidence may be named by ids that aren't repeated; `codes` are those it was offered for, null: all.
    Issues, first one named: CODE, EVIDENCE, CANDIDATE (not offered for the code), CONFIDENCE (no number from 0 to 1; true and
    false count as 1 and 0), VALUE (none). A source text that its evidence doesn't have is dropped, others are cut to `QUOTE`.
    """
    get = lambda path, kind: F.try_variant_get("item", path, kind)
    number = F.try_variant_get("item", "$.confidence", "variant")
    kind = _kind(number)
    confidence = F.when(kind == "BOOLEAN", F.try_variant_get(number, "$", "boolean").cast("int").cast("double")).when(~kind.startswith("STRING"), F.try_variant_get(number, "$", "double"))
    rows = candidates.select(*candidates.columns, get("$.code", "string").alias("code"), get("$.value", "variant").alias("value"), confidence.alias("confidence"), get("$.source_evidence_id", "string").alias("evidence"), F.trim(F.coalesce(get("$.source_text", "string"), F.lit(""))).alias("said"))
    known = evidence.select(F.col("evidence").cast("string").alias("evidence"), F.col("text").alias("_text"), F.col("codes").alias("_codes"), F.lit(True).alias("_known"))
    both = rows.join(known, "evidence", "left")
    codes = [tag.code for tag in catalogue]
    offered = F.col("_codes").isNull() | F.array_contains("_codes", F.col("code"))
    issue = (
        F.when(~F.coalesce(F.col("code").isin(codes), F.lit(False)), "CODE").when(F.col("_known").isNull(), "EVIDENCE").when(~offered, "CANDIDATE")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "CONFIDENCE").when(is_blank(F.col("value")), "VALUE")
    )
    kept = F.when(F.coalesce(F.col("_text"), F.lit("")).contains(F.col("said")), F.substring("said", 1, QUOTE)).otherwise("")
    return both.select(*candidates.columns, "code", "value", "confidence", "evidence", kept.alias("source_text"), issue.alias("issue"))


def best(rows: DataFrame, run: str, order: str) -> DataFrame:
    """(run, code, value, confidence, evidence, source_text): of each code's accepted rows the most confident, the first of equal ones."""
    place = F.struct((-F.col("confidence")).alias("c"), F.col(order).alias("o"))
    kept = F.min_by(F.struct(F.to_json("value").alias("value"), "confidence", "evidence", "source_text"), place)
    return rows.where("issue is null").groupBy(run, "code").agg(kept.alias("x")).select(run, "code", F.parse_json("x.value").alias("value"), "x.confidence", "x.evidence", "x.source_text")


def validated(extracted: DataFrame, runs: DataFrame, run: str, catalogue: list[Tag], reviewed: list[str], relations: list[tuple[str, str, str]], failures: DataFrame | None = None) -> DataFrame:
    """(run, issues, review, approved) of every row of `runs`: issues in order, and the codes that people must see or that pass without.

    `extracted` (run, code, value, source_text, section) has a row a code. Issues: MISSING_REQUIRED and
    ATTACHMENT_REFERENCE of the codes `reviewed`, by code; RELATION_* of the relations (kind, source, target) in their order, where one of the two is
    reviewed; EXTRACTION_BATCH_FAILED of `failures` (run, batch), by batch. A relation DEPENDS_ON asks for the target; BEFORE and
    EQUAL_OR_BEFORE compare times, if both are ones.
    """
    tags = {tag.code: tag for tag in catalogue}
    required = [c for c in sorted(tags) if c in reviewed and tags[c].required]
    rows = extracted.withColumn("_ok", checks(F.col("code"), F.col("value"), catalogue)).withColumn("_time", iso_time(_text(F.col("value"))))
    points = F.concat_ws("\n", F.coalesce("section", F.lit("")), F.coalesce("source_text", F.lit(""))).rlike(ATTACHMENT)
    rows = rows.withColumn("_points", points & F.col("code").isin(reviewed))
    one = lambda c: F.map_from_entries(F.collect_list(F.struct("code", c)))  # noqa: E731  codes are as many as the catalogue has
    by_run = rows.groupBy(run).agg(one("_ok").alias("ok"), one("_time").alias("time"), F.array_sort(F.collect_list(F.when(F.col("_points"), F.col("code")))).alias("points"))
    both = runs.select(run).join(by_run, run, "left")
    if failures is not None:
        both = both.join(failures.groupBy(run).agg(F.array_sort(F.collect_list(F.col("batch").cast("long"))).alias("failed")), run, "left")
    else:
        both = both.withColumn("failed", F.lit(None).cast("array<bigint>"))
    has = lambda c: F.coalesce(F.map_contains_key("ok", F.lit(c)), F.lit(False))
    fits = lambda c: F.coalesce(F.element_at("ok", F.lit(c)), F.lit(False))
    at = lambda c: F.element_at("time", F.lit(c))
    found = [F.when(~fits(c), F.lit(f"MISSING_REQUIRED:{c}")) for c in required]
    relates = []
    for kind, source, target in relations:
        if source in reviewed or target in reviewed:
            broken = {"DEPENDS_ON": has(source) & ~has(target), "BEFORE": at(source) >= at(target), "EQUAL_OR_BEFORE": at(source) > at(target)}[kind]
            relates.append(F.when(broken, F.lit(f"RELATION_{kind}:{source}:{target}")))
    texts = lambda c, name: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{name}:"), x))
    issues = F.array_compact(F.concat(F.array(*found).cast("array<string>"), texts(F.col("points"), "ATTACHMENT_REFERENCE"), F.array(*relates).cast("array<string>"), texts(F.col("failed").cast("array<string>"), "EXTRACTION_BATCH_FAILED")))
    told = both.withColumn("issues", issues)
    named = F.array_distinct(F.flatten(F.transform("issues", lambda x: F.slice(F.split(x, ":"), 2, 2))))
    review = F.array_sort(F.array_intersect(named, F.array(*map(F.lit, reviewed))))
    valid = F.array_sort(F.map_keys(F.map_filter(F.coalesce("ok", F.create_map().cast("map<string,boolean>")), lambda k, v: v)))
    return told.withColumn("review", review).select(run, "issues", "review", F.array_except(valid, F.col("review")).alias("approved"))
