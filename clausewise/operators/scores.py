"""Distances, rank fusion, recall and other scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions.words import words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fuse(dense: DataFrame, lexical: DataFrame, keys: list[str], k: int = 60, weights: tuple[float, float] = (0.65, 0.35)) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lists (keys, rank): weight / (k + rank), summed."""
    score = lambda df, w: df.select(*keys, (F.lit(w) / (k + F.col("rank"))).alias("score"))
    return score(dense, weights[0]).unionByName(score(lexical, weights[1])).groupBy(*keys).agg(F.sum("score").alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct words of at least `least` characters."""
    return F.array_distinct(F.filter(words(text), lambda x: F.length(x) >= least))


def share(part: Column, whole: Column, scale: float = 100.0, digits: int = 2) -> Column:
    """scale * part / whole, half-even; 0 if there is no whole."""
    return F.when(whole > 0, F.bround(scale * part / whole, digits)).otherwise(F.lit(0.0))


def rank_of_first(hits: DataFrame, case: str, rank: str, hit: Column) -> DataFrame:
    """(case, first): the least rank at which `hit` holds, null if at none."""
    return hits.groupBy(case).agg(F.min(F.when(hit, F.col(rank))).alias("first"))


def running(df: DataFrame, keys: list[str], order: list, what: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(what).over(w))
