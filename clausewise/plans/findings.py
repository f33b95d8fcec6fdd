"""Merging findings that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(rows: DataFrame, cap: int = 20) -> DataFrame:
    """One finding a title, white space folded and in lower case: ids united (n_ids; `ids` has the first `cap`), greatest severity, longest description."""
    title = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    return rows.groupBy(title.alias("title")).agg(
        F.countDistinct("id").alias("n_ids"),
        F.slice(F.array_sort(F.collect_set("id")), 1, cap).alias("ids"),
        F.max("severity").alias("severity"),
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
    )


def merge_values(rows: DataFrame, keys: list[str], value: str, confidence: str, order: list[str], source: list[str] | None = None) -> DataFrame:
    """(keys, values, confidence, sources, best): all distinct values of a key, in order of first appearance, and where they come from.

    `value` is a VARIANT, an array of which counts as many; values are told apart by their canonical JSON, objects by sorted
    keys, and given as such. Nulls and empty texts are none; a row without a value is no source. `sources` lists the columns `source` of
    every row in order, `best` has those of the most confident one, the first of equal ones.
    """
    place, of = F.struct(*order), F.struct(*(source or order))
    many = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(F.col(value)))
    signs = F.filter(F.transform(many, lambda x: F.to_json(x)), lambda x: x.isNotNull() & (x != "null") & (x != '""'))
    told = rows.select(*keys, place.alias("_at"), of.alias("_of"), F.col(confidence).alias("_c"), signs.alias("_signs")).where(F.size("_signs") > 0)
    firsts = told.select(*keys, "_at", F.posexplode("_signs").alias("_i", "_sign")).groupBy(*keys, "_sign").agg(F.min(F.struct("_at", "_i")).alias("_first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_first", "_sign"))), lambda x: x["_sign"])
    values = firsts.groupBy(*keys).agg(listed.alias("values"))
    every = told.groupBy(*keys).agg(
        F.max("_c").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_of"))), lambda x: x["_of"]).alias("sources"),
        F.min_by("_of", F.struct((-F.col("_c")).alias("c"), "_at")).alias("best"),
    )
    return values.join(every, keys)
