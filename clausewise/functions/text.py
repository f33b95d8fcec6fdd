"""Text columns: normal forms, quality, classification and splitting. All JVM-side unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GARBLED = 0.35
MAX_VISIBLE = 1200


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalized(text: Column, drop_format: bool = True) -> Column:
    """NFKC, line feeds only, no format characters (unless kept), blanks collapsed, lines trimmed, no empty lines."""
    t = F.regexp_replace(nfkc(text), r"\r\n?", "\n")
    if drop_format:
        t = F.regexp_replace(t, r"\p{Cf}", "")
    t = F.regexp_replace(t, r"[ \t\u000B\f]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^(?U:\s)+|(?U:\s)+$", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


def duplicate_key(text: Column) -> Column:
    """Without `#` runs and white space, in one case: lower case, with ß as ss and the final sigma as any other."""
    return F.translate(F.replace(F.lower(F.regexp_replace(text, r"#+|\s+", "")), F.lit("ß"), F.lit("ss")), "ς", "σ")


def lower_each(text: Column) -> Column:
    """Lower case, each character by itself: no final sigma, no dot of its own for İ, so that no length changes."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def count_of(text: Column, pattern: str) -> Column:
    """Characters of the text that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def bare(text: Column) -> Column:
    """Without white space. What asks for it more than once takes it as a column of its own."""
    return F.regexp_replace(text, r"\s+", "")


def visible(text: Column) -> Column:
    return F.length(bare(text))


def garbled_ratio(text: Column, ordinary: str, seen: Column | None = None) -> Column:
    """Share of visible characters that aren't in the class `ordinary`, four digits; 1 if nothing is visible. `seen` is the bare text, if there is a column of it."""
    seen = bare(text) if seen is None else seen
    odd = F.length(F.regexp_replace(seen, f"[{ordinary}]+", ""))
    return F.when(seen == "", 1.0).otherwise(F.bround(odd / F.length(seen), 4))


def gate(text: Column, ordinary: str, title: str, leader: str = r"\.{4,}", seen: Column | None = None) -> Column:
    """Why a text can't be indexed, if so: garbled, a contents page (by title, or by dot leaders), too long."""
    seen = bare(text) if seen is None else seen
    dots = F.length(text) - F.length(F.regexp_replace(text, leader, ""))
    return (
        F.when(garbled_ratio(text, ordinary, seen) > GARBLED, "GARBLED_TEXT")
        .when(text.rlike(title) | (text.contains("....") & (dots >= 60) & (dots >= 0.12 * F.length(seen))), "CONTENTS_PAGE")
        .when(F.length(seen) > MAX_VISIBLE, "OVERSIZED_CHUNK")
    )


def keyword_score(text: Column, keywords: list[str], obligation: str) -> Column:
    """Number of keywords present, and 3 for a word of obligation."""
    score = F.lit(0)
    for k in keywords:
        score = score + F.lower(text).contains(k).cast("int")
    return score + 3 * text.rlike(obligation).cast("int")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of `size` characters that overlap; an overlap of the size or more counts as an eighth of it."""
    step = size - (size // 8 if overlap >= size else overlap)
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(at, lambda i: F.substring(text, i + 1, F.lit(size)))


def contextual(parts: list[Column], text: Column) -> Column:
    """Distinct parts, " / " between them, a line feed, the text."""
    head = F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), " / ")
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n"), text))


def without_component(path: Column, component: str, sep: str = " / ") -> Column:
    return F.array_join(F.filter(F.split(path, sep), lambda x: F.lower(x) != component.lower()), sep)


def citations(text: Column, marker: str) -> Column:
    """Distinct ids of the markers, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(marker), 1))


def without_fences(text: Column) -> Column:
    """Without a code fence around the whole."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def without_reasoning(text: Column, tag: str = "think") -> Column:
    """Without reasoning between tags, and without tags that are left over."""
    return F.regexp_replace(F.regexp_replace(text, f"(?is)<{tag}>.*?</{tag}>", ""), f"(?i)</?{tag}>", "")


def cell(text: Column) -> Column:
    """Safe in a Markdown table."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\s*\n\s*", " ")
