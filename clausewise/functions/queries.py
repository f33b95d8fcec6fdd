"""Understanding questions: intents, follow-ups, labels for codes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Words of questions that refer to what was said, and what stands before such a question.
FOLLOW_UPS, FOLLOW_UP_MARK = ("它", "这个", "那个", "上述", "前面", "刚才", "那", "呢", "还有"), "追问："


def intent(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first rule whose pattern the text has."""
    (pattern, name), *rest = rules
    out = F.when(text.rlike(pattern), name)
    for pattern, name in rest:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def with_previous(turns: DataFrame, conv: str, turn: str, role: str, text: str, short: int, cap: int, words: Sequence[str] = FOLLOW_UPS) -> DataFrame:
    """User turns with `query`: a short one that has one of `words` follows the user's last turn that isn't empty; all without blanks at their ends."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    own = F.trim(F.coalesce(text, F.lit("")))
    before = F.last(F.when((F.col(role) == "user") & (own != ""), own), ignorenulls=True).over(w)
    rows = turns.withColumn("_before", before).where(F.col(role) == "user")
    joined = F.substring(F.concat(F.col("_before"), F.lit("\n" + FOLLOW_UP_MARK), own), 1, cap)
    refers = F.exists(F.array(*map(F.lit, words)), lambda x: own.contains(x))
    return rows.withColumn("query", F.when((F.length(own) <= short) & refers & F.col("_before").isNotNull(), joined).otherwise(own)).drop("_before")


def replace_codes(text: Column, labels: dict[str, str]) -> Column:
    """Codes at word boundaries become labels."""
    for code, label in labels.items():
        text = F.regexp_replace(text, rf"\b{re.escape(code)}\b", label)
    return text


def variants(text: Column, stop_words: list[str], most: int = 5) -> Column:
    """Lexical forms of a question: itself, quoted phrases, clauses, itself without question words; no synonyms."""
    t = F.trim(text)
    quoted = F.regexp_extract_all(t, F.lit('"([^"]+)"'), 1)
    clauses = F.split(t, "[、，,；;。.！!？?]+")
    concise = t
    for w in stop_words:
        concise = F.trim(F.replace(concise, F.lit(w), F.lit("")))
    every = F.transform(F.concat(F.array(t), quoted, clauses, F.array(concise)), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2)), 1, most)


def plan(text: Column, casual: list[str], fit: list[str], report: list[str], legal: list[str], project: list[str]) -> Column:
    """Mode of retrieval: casual talk, enterprise fit, report, law, both with project facts, or project facts alone."""
    low = F.lower(F.trim(text))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    bare = F.regexp_replace(low, r"[\s，。！？!?、,.]+", "")
    mixed = has(legal) | has(project)
    return (
        F.when(bare.isin(*casual), "CASUAL").when(has(fit), "ENTERPRISE_FIT")
        .when(has(report), F.when(mixed, "HYBRID").otherwise("REPORT"))
        .when(has(legal), F.when(has(project), "HYBRID").otherwise("LEGAL")).otherwise("PROJECT")
    )


def global_plan(mode: Column, text: Column, history: Column, project: Sequence[str]) -> Column:
    """The mode of a conversation without a project: law where the plan asks for it or something was said before, unless the question names project matters; questions of fit stay."""
    low = F.lower(F.trim(text))
    named = F.exists(F.array(*map(F.lit, project)), lambda w: low.contains(w))
    asks = mode.isin("LEGAL", "HYBRID")
    return F.when(mode == "ENTERPRISE_FIT", mode).when((asks | history) & ~named, "LEGAL").otherwise(mode)
