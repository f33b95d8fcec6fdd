"""Lexical search: every term of a query must occur; texts rank by how close together the terms stand.

Texts are tokenised once, into postings: a row for each text and term, with the places of the term. Stored
postings are sorted by term in every file, so that a search reads the parts of the files that have its
terms; the places go as differences (Parquet's delta encoding).

A cover is a shortest run of a text that has every term; it adds `WEIGHT` / (1 + words in it that are no terms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions.words import words
from clausewise.sources.stored import kept, written

#: A cover without other words; rows of a table that may be broadcast; terms that go to the scan as a list.
WEIGHT, BROADCAST_ROWS, LISTED = 0.1, 1 << 17, 1 << 10


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(texts: DataFrame, key: str, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(term, key, places) of every text, or of the terms `known` (term) only; places count words from 0.

    Texts with one key are one text to a search; keys should be unique.
    """
    rows = texts.select(key, F.posexplode(words(F.col(text))).alias("pos", "term"))
    if known is not None:
        rows = rows.join(_small(known), "term", "left_semi")
    return rows.groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("places"))


def stored(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Postings of a table of files, written the first time they are asked for in a session."""
    options = {"parquet.writer.version": "v2", "parquet.enable.dictionary#places.list.element": "false", "parquet.block.size": str(16 << 20)}
    return kept(texts, f"postings-{key}-{text}", lambda: written(postings(texts, key, text).sortWithinPartitions("term", key), "postings", **options))


def _of(index: DataFrame, known: DataFrame) -> DataFrame:
    """The postings of the terms `known` (term); few terms reach the scan."""
    listed = [r.term for r in known.limit(LISTED + 1).collect()]
    return index.where(F.col("term").isin(listed)) if len(listed) <= LISTED else index.join(_small(known), "term", "left_semi")


def matches(texts: DataFrame, key: str, queries: DataFrame, query: str, text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(query, key, n, hits) of the texts that have every of the n terms of a query; queries without terms match nothing.

    `index` has the postings of `texts`; without it those of the queries' terms are made. Candidates come from each
    query's rarest term only, so that a word that is everywhere brings no pairs of its own; its
    postings are joined to candidates by term and text.
    """
    asked = queries.select(query, F.array_distinct(words(F.col(text))).alias("terms"))
    each = written(asked.select(query, F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term")), "asked")
    known = each.select("term").distinct()
    rows = _of(index, known) if index is not None else written(postings(texts, key, text, known), "postings")
    counts = rows.groupBy("term").agg(F.count("*").alias("n_texts"))
    few = _small(each)
    # a term that is nowhere is the rarest: no candidates
    rarest = few.join(counts, "term", "left").groupBy(query).agg(F.min_by("term", F.struct(F.coalesce("n_texts", F.lit(0)), "term")).alias("term"))
    pairs = rows.select("term", key).join(rarest, "term").select(query, key)
    wanted = pairs.join(few, query)
    found = wanted.join(rows, ["term", key]).groupBy(query, key, "n").agg(F.collect_list(F.struct("i", "places")).alias("hits"))
    return found.where(F.size("hits") == F.col("n"))


def covered(found: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score) of matches: the sum over the covers of a text.

    The hits of a text are folded in order. The shortest run that ends at a hit begins at the least of the places
    where each term was last; of the runs with one beginning the first is a cover.
    """
    hits = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(h.places, lambda p: F.struct(p.alias("pos"), h.i.alias("i"))))))
    at = lambda pos, nth: F.struct(pos.alias("pos"), nth.alias("nth"))
    begin = F.struct(F.array_repeat(at(F.lit(-1), F.lit(0)), F.col("n")).alias("last"), F.lit(0).alias("nth"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))

    def step(s, hit):
        nth = s.nth + 1
        last = F.transform(s.last, lambda x, i: F.when(i == hit.i, at(hit.pos, nth)).otherwise(x))
        return F.struct(last.alias("last"), nth.alias("nth"), F.array_min(last).alias("first"), hit.pos.alias("pos"), s.start.alias("start"), s.score.alias("score"))

    def cover(x):
        new = (x["first"].pos >= 0) & (x["first"].pos != x.start)
        others = x.pos - x["first"].pos - (x.nth - x["first"].nth)
        return F.struct(x.last.alias("last"), x.nth.alias("nth"), F.when(new, x["first"].pos).otherwise(x.start).alias("start"), (x.score + F.when(new, F.lit(WEIGHT) / (1 + others)).otherwise(0.0)).alias("score"))

    # a lambda's value that is used twice goes through an array of one, so that it is made once
    fold = F.aggregate(hits, begin, lambda s, hit: F.transform(F.array(step(s, hit)), cover)[0], lambda s: s.score)
    return found.select(query, key, fold.alias("score"))


def ranked(texts: DataFrame, key: str, queries: DataFrame, query: str, k: int, text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank) of the k best texts of each query, equal scores by key."""
    scored = covered(matches(texts, key, queries, query, text, index), query, key)
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
