"""Tags: keywords of a catalogue, evidence recalled for each tag, rows a catalogue is seeded with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators.ranking import first_per

# What stands in quotes in a prompt, words that names go without.
QUOTED = r"[“\"「『]([^”\"」』]{2,24})[”\"」』]"
DROPPED = r"要求|条款"
#: Evidences of a tag and of all tags, and how early a text of identity tags stands.
EACH, ALL, EARLY = 3, 48, 12
#: Tags of a catalogue.
CATALOGUE = 1 << 14


def keywords(name: Column, prompt: Column) -> Column:
    """The trimmed name and what the prompt has in quotes, of two characters at least, longest first, then by text."""
    found = F.concat(F.array(F.regexp_replace(F.coalesce(name, F.lit("")), DROPPED, "")), F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(QUOTED), F.lit(1)))
    kept = F.filter(F.array_distinct(F.transform(found, F.trim)), lambda x: F.length(x) >= 2)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("word")))), lambda x: x["word"])


def recalled(tags: DataFrame, texts: DataFrame, key: str, order: str, early: Column) -> DataFrame:
    """(code, key, score, rank) of the texts (key, order, text) with keywords of a tag (code, place, words), `EACH` a tag; `early` tags also take the first texts."""
    held = tags.select("code", "place", "words", early.alias("_early"))
    if held.count() > CATALOGUE:
        raise ValueError(f"a catalogue of more than {CATALOGUE} tags")  # people write it; each text is held against all of it
    pairs = texts.join(F.broadcast(held))
    hits = F.size(F.filter("words", lambda w: F.col("text").contains(w)))
    scored = pairs.withColumn("score", F.when(F.col("_early") & (F.col(order) <= EARLY), F.greatest(hits, F.lit(1))).otherwise(hits)).where("score > 0")
    return first_per(scored, ["code"], [F.desc("score"), F.asc(order), F.desc(key)], EACH, "rank").select("code", "place", key, "score", "rank")


def capped(found: DataFrame, key: str, most: int = ALL) -> DataFrame:
    """The rows of `found` (place, rank, key) in order of tags and ranks until `most` different keys were taken; at most `EACH` rows a tag."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("place", "rank")) == 1
    so_far = Window.orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_first", first.cast("int")).withColumn("_taken", F.coalesce(F.sum("_first").over(so_far), F.lit(0))).where(F.col("_taken") < most).drop("_first", "_taken")


def seeded(catalogue: DataFrame, seeds: DataFrame, key: str = "code") -> DataFrame:
    """The catalogue with the seeds whose key it doesn't have; of seeds with one key the first by all columns."""
    new = first_per(seeds, [key], [c for c in seeds.columns if c != key] or [key])
    return catalogue.unionByName(new.join(catalogue.select(key), key, "left_anti"))


def activated(versions: DataFrame, pointers: DataFrame, key: str, version: str, ready: Column) -> DataFrame:
    """(key, version): each key's newest version that is ready; a key without one keeps its pointer."""
    newest = versions.where(ready).groupBy(key).agg(F.max(version).alias("_new"))
    return pointers.select(key, version).join(newest, key, "full").select(key, F.coalesce("_new", version).alias(version))
