"""Dense, hybrid and ranked search of a table of queries over all rows; neighbours of what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators.scores import fuse, tokens
from clausewise.plans import lexical
from clausewise.plans.chunking import diverse
from clausewise.plans.vectors import nearest

#: Hits shorter than this get neighbours, up to so many characters.
SHORT, CONTEXT = 600, 2000


def hybrid(dense: DataFrame, lexical_: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """(query, key, score, rank) of two ranked lists, fused by weighted reciprocal ranks."""
    fused = fuse(dense, lexical_, [query, key])
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), key)
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def candidates(texts: DataFrame, vectors: DataFrame, queries: DataFrame, query: str, key: str, k: int, keep: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank): the k nearest and the k best lexical hits of each of `queries` (query, q, text), fused."""
    dense = nearest(vectors, queries.select(query, "q"), k, key=key, query=query)
    return hybrid(dense, lexical.ranked(texts, key, queries.select(query, "text"), query, k, index=index), query, key, keep or 2 * k)


def pool(limit: int) -> int:
    """Candidates asked for, for so many results."""
    return max(20, min(60, 3 * limit))


def with_neighbours(hits: DataFrame, chain: DataFrame, keys: list[str], order: str, section: str, text: str, short: int = SHORT, most: int = CONTEXT) -> DataFrame:
    """Adds `context` to `hits` (keys, order, and more): the text with whole neighbours of its section, first those before, then those after.

    A hit of `short` characters or more is its own context. Neighbours are taken one by one away from the hit until the section changes, a text is
    empty or the next one doesn't fit into `most`, line feeds counted.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = chain.select(*keys, order, F.coalesce(section, F.lit("")).alias("_s"), body.alias("_t"))
    cut = F.coalesce(F.lag("_s").over(w) != F.col("_s"), F.lit(True)) | (F.col("_t") == "") | F.coalesce(F.lag("_t").over(w) == "", F.lit(True))
    rows = rows.withColumn("_run", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # total length up to and with each node of its run, line feeds counted
    rows = rows.withColumn("_n", F.length("_t") + 1).withColumn("_sum", F.sum("_n").over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    mine = hits.join(rows, [*keys, order])
    near = rows.select(*keys, "_run", F.col(order).alias("_o"), F.col("_sum").alias("_to"), F.col("_n").alias("_m"), F.col("_t").alias("_near"), F.floor(F.col("_sum") / most).alias("_place"))
    # what fits stands within `most` characters: in the same place of the run's length or one beside it
    wide = mine.where((F.length("_t") < short) & (F.col("_t") != "")).select(*keys, order, "_run", "_n", "_sum", F.explode(F.sequence(F.floor(F.col("_sum") / most) - 1, F.floor(F.col("_sum") / most) + 1)).alias("_place")).distinct()
    pairs = wide.join(near, [*keys, "_run", "_place"])
    before = F.col("_o") < F.col(order)
    # characters that the neighbours from the hit to this one have together
    room = F.when(before, F.col("_sum") - F.col("_n") - F.col("_to") + F.col("_m")).when(F.col("_o") > F.col(order), F.col("_to") - F.col("_sum"))
    pairs = pairs.withColumn("_before", before).withColumn("_room", room).where(F.col("_room").isNotNull() & (F.col("_n") - 1 + F.col("_room") <= most))
    used = F.coalesce(F.max(F.when(F.col("_before"), F.col("_room"))).over(Window.partitionBy(*keys, order)), F.lit(0))
    pairs = pairs.withColumn("_used", used).where(F.col("_before") | (F.col("_n") - 1 + F.col("_used") + F.col("_room") <= most))
    lists = pairs.groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.when(F.col("_before"), F.struct("_o", "_near")))).alias("_b"), F.array_sort(F.collect_list(F.when(~F.col("_before"), F.struct("_o", "_near")))).alias("_a"))
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x["_near"]), F.array().cast("array<string>"))
    out = mine.join(lists, [*keys, order], "left")
    context = F.array_join(F.concat(texts("_b"), F.array("_t"), texts("_a")), "\n")
    return out.select(*(F.col(c) for c in hits.columns), context.alias("context"))


def ranked_retrieve(texts: DataFrame, vectors: DataFrame, chain: DataFrame, queries: DataFrame, query: str, key: str, limit: int, keys: list[str], order: str, section: str, index: DataFrame | None = None) -> DataFrame:
    """(query, key, place, score, context) of the `limit` most relevant and diverse hits of each query, short ones with their neighbours.

    `chain` has texts with key, keys, order and section.
    """
    k = max(20, 3 * limit)
    found = candidates(texts, vectors, queries, query, key, k, k, index).join(texts.select(key, "text"), key)
    listed = found.select(query, F.col(key).alias("id"), "score", tokens(F.col("text")).alias("words"))
    chosen = diverse(listed, query, limit).withColumnRenamed("id", key)
    placed = chosen.join(found.select(query, key, "score"), [query, key]).join(chain.select(key, *keys, order), key)
    return with_neighbours(placed, chain, keys, order, section, "text").select(query, key, "place", "score", "context")


def knowledge_retrieve(texts: DataFrame, vectors: DataFrame, queries: DataFrame, query: str, key: str, limit: int, index: DataFrame | None = None) -> DataFrame:
    """(query, key, similarity, rank): hybrid search without diversification; the similarity is the fused score."""
    return candidates(texts, vectors, queries, query, key, pool(limit), limit, index).withColumnRenamed("score", "similarity")
