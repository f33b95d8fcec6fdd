"""Evaluation cases and golden sets from JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CASES = "array<struct<scope:string,question:string,expect:array<string>>>"
_GOLDEN = "struct<requirements:array<struct<id:string,page:int,category:string,mandatory:boolean,term_groups:array<array<string>>>>,project_fields:array<struct<id:string,page:int,field_code:string,term_groups:array<array<string>>,terms:array<string>>>,thresholds:map<string,double>>"


def eval_cases(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, place, scope, question, expected) of the cases of a set; cases without a question or expectation are left out."""
    each = df.select(key, F.posexplode(F.from_json(data, _CASES)).alias("place", "_case"))
    return each.select(key, "place", "_case.scope", F.trim("_case.question").alias("question"), F.filter("_case.expect", lambda x: F.trim(x) != "").alias("expected")).where("question != '' and size(expected) > 0")


def golden_terms(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, kind, item, page, mandatory, group, terms) of a golden set: an item is found where each of its groups has a term; plain terms are a group each."""
    g = df.select(key, F.from_json(data, _GOLDEN).alias("_g"))
    alone = lambda f: F.coalesce(f["term_groups"], F.transform(f["terms"], lambda t: F.array(t)))
    items = F.concat(
        F.coalesce(F.transform("_g.requirements", lambda r: F.struct(F.lit("REQUIREMENT").alias("kind"), r["id"].alias("item"), r["page"].alias("page"), F.coalesce(r["mandatory"], F.lit(False)).alias("mandatory"), r["term_groups"].alias("groups"))), F.array()),
        F.coalesce(F.transform("_g.project_fields", lambda f: F.struct(F.lit("FIELD").alias("kind"), F.coalesce(f["id"], f["field_code"]).alias("item"), f["page"].alias("page"), F.lit(False).alias("mandatory"), alone(f).alias("groups"))), F.array()),
    )
    return g.select(key, F.inline(items)).select(key, "kind", "item", "page", "mandatory", F.posexplode("groups").alias("group", "terms"))


def thresholds(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, name, least) of a golden set's thresholds."""
    return df.select(key, F.explode(F.from_json(data, _GOLDEN)["thresholds"]).alias("name", "least"))
