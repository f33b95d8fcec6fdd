"""Nearest vectors by cosine distance: exact in blocks, and by an inverted file.

Exact search multiplies matrices: few queries (`FEW`) go to every task, which keeps k rows a query; more are
dealt into blocks against blocks of rows. The inverted file has `lists` centroids of a bounded sample; every
row is in the list of its nearest one, and a query is held against the rows of its nearest lists only (as many as
find the `TARGET` share of the neighbours of a part of the sample within it), in blocks as well, so that a list that has a third of all rows is no task of its own.

Null, empty and zero vectors have no direction: they are near nothing and find nothing. Equal distances (to 12
digits) are ordered by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from clausewise.sources.stored import kept, new_path, written

#: Queries that go to every task; rows and queries of one block.
FEW, ROWS, QUERIES = 1024, 8192, 1024
#: Rows of the sample, times it is assigned anew, lists at most.
SAMPLE, TURNS, LISTS = 1 << 15, 15, 4096
#: Queries of the sample that tell how many lists a search looks into, neighbours of each, and the share of these that it finds.
TRIED, NEIGHBOURS, TARGET = 512, 10, 0.95
_DIGITS = 12


def unit(df: DataFrame, vector: str, name: str, *keep: str) -> DataFrame:
    """The columns `keep` and the vector at length 1; rows whose vector has no direction go."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))).withColumn("_size", size).where("_size > 0")
    return rows.select(*keep, F.transform(wide, lambda x: x / F.col("_size")).alias(name))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(distance: np.ndarray, keys: list, k: int) -> list[tuple[float, object]]:
    """The k least (distance, key) of one query."""
    at = np.arange(len(keys))
    if len(keys) > k:
        at = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1] + 10.0**-_DIGITS)
    return sorted(zip(np.round(distance[at], _DIGITS).tolist(), (keys[i] for i in at.tolist())))[:k]


def _rows(found: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=names)


def _to_all(vectors: DataFrame, queries: DataFrame, k: int, key: str, query: str) -> DataFrame:
    """The k nearest rows that each task has to each of a few queries."""
    rows = queries.collect()
    ids, q = [r[0] for r in rows], np.array([r[1] for r in rows])
    held = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            keys, e = batch.column(key).to_pylist(), _matrix(batch.column("e"))
            for j, d in enumerate(1 - q @ e.T if len(keys) and len(ids) else ()):
                best[j] = sorted(best[j] + _best(d, keys, k))[:k]
        found = [(ids[j], x, d) for j, own in enumerate(best) for d, x in own]
        yield from _rows(found, types, [query, key, "distance"]).to_batches()

    schema = StructType([queries.schema[query], vectors.schema[key], StructField("distance", DoubleType())])
    types = [_arrow(f) for f in schema]
    return vectors.mapInArrow(run, schema)


def _arrow(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def _in_blocks(vectors: DataFrame, queries: DataFrame, k: int, key: str, query: str) -> DataFrame:
    """The k nearest rows of each block to each query: `vectors` (key, list, e), `queries` (query, list, q), within lists."""
    n = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = written(n(vectors, ROWS, "of").join(n(queries, QUERIES, "qof"), "list"), "blocks")
    v = vectors.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64(key), "of").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qof").cast("long") - 1)).alias("qblock"), key, "e")
    q = queries.join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of").cast("long") - 1)).alias("block"), F.pmod(F.xxhash64(query), "qof").alias("qblock"), query, "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            keys = left.column(key).to_pylist()
            e, m = (_matrix(t.column(c).combine_chunks()) for t, c in ((left, "e"), (right, "q")))
            for i, d in zip(right.column(query).to_pylist(), 1 - m @ e.T):
                found += [(i, x, y) for y, x in _best(d, keys, k)]
        return _rows(found, types, [query, key, "distance"])

    schema = StructType([queries.schema[query], vectors.schema[key], StructField("distance", DoubleType())])
    types = [_arrow(f) for f in schema]
    by = ["list", "block", "qblock"]
    return v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, schema)


def _first(found: DataFrame, k: int, key: str, query: str) -> DataFrame:
    w = Window.partitionBy(query).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "query") -> DataFrame:
    """(query, key, distance, rank) of the k nearest rows to each of `queries` (query, q): exact."""
    v, q = unit(vectors, vector, "e", key), unit(queries, "q", "q", query)
    if queries.limit(FEW + 1).count() <= FEW:
        return _first(_to_all(v, q, k, key, query), k, key, query)
    whole = F.lit(0).alias("list")
    return _first(_in_blocks(v.select(whole, key, "e"), q.select(whole, query, "q"), k, key, query), k, key, query)


@dataclass
class Index:
    """An inverted file: `rows` (list, key, e) as Parquet by list, the lists' centroids, and how many lists a search looks into."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    path: str

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        found = sorted((r.list, r.centroid, r.probes) for r in spark.read.parquet(f"{path}/centroids").collect())
        return cls(spark.read.parquet(f"{path}/rows"), np.array([c for _, c, _ in found]), found[0][2] if found else 0, path)


def centroids(sample: np.ndarray, lists: int, turns: int = TURNS, seed: int = 1) -> np.ndarray:
    """Centroids of rows of length 1, themselves of length 1; a list without rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(turns):
        near = sample @ c.T
        own = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, target: float = TARGET, seed: int = 2) -> int:
    """The nearest lists of a query that have the target share of its neighbours, for queries and neighbours of the sample."""
    tried = np.random.default_rng(seed).choice(len(sample), min(TRIED, len(sample)), replace=False)
    own = (sample @ c.T).argmax(1)
    place = np.argsort(np.argsort(-(sample[tried] @ c.T), 1, kind="stable"), 1)
    near = sample[tried] @ sample.T
    k = min(NEIGHBOURS, len(sample))
    neighbours = np.argpartition(-near, k - 1, 1)[:, :k]
    at = np.sort(np.take_along_axis(place, own[neighbours], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))))]) + 1


def _assigned(rows: DataFrame, e: str, c: np.ndarray, n: int) -> DataFrame:
    """`rows` with `lists`, the n nearest centroids' numbers."""
    held = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column(e)) @ held.value.T), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "lists"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("lists", ArrayType(LongType()))]))


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, path: str | None = None) -> Index:
    """An inverted file of all rows; centroids are fitted on at most about `SAMPLE` of them, the lists are about the root of their number."""
    spark = vectors.sparkSession
    rows = unit(vectors, vector, "e", key)
    n = vectors.count()
    some = rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))).orderBy(F.xxhash64(key), key).limit(2 * SAMPLE)
    sample = np.array([r.e for r in some.select("e").collect()])
    lists = lists or max(1, min(LISTS, int(n**0.5)))
    c = centroids(sample, lists) if len(sample) else np.zeros((0, 1))
    probes = probes_for(sample, c) if len(sample) else 0
    path = path or new_path(spark, "vectors")
    placed = _assigned(rows, "e", c, 1) if len(c) else rows.withColumn("lists", F.array(F.lit(0).cast("long")))
    # rebalance: large lists are split over tasks, small ones share files
    placed.select(F.col("lists")[0].alias("list"), key, "e").hint("rebalance", "list").sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, x.tolist(), probes) for i, x in enumerate(c)], "list long, centroid array<double>, probes long").write.parquet(f"{path}/centroids")
    schema = StructType([vectors.schema[key], StructField("e", ArrayType(DoubleType())), StructField("list", LongType())])
    return Index(spark.read.schema(schema).parquet(f"{path}/rows"), c, probes, path)


def stored(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Index:
    """An inverted file of a table of files, built the first time it is asked for in a session."""
    return kept(vectors, f"vectors-{key}-{vector}", lambda: build(vectors, key, vector))


def search(index: Index, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query", probes: int | None = None) -> DataFrame:
    """(query, key, distance, rank) of the k nearest rows of the `probes` lists that are nearest to each of `queries` (query, q)."""
    probes = probes or index.probes
    asked = unit(queries, "q", "q", query)
    if not len(index.centroids):
        return _first(_in_blocks(index.rows, asked.withColumn("list", F.lit(0).cast("long")), k, key, query), k, key, query)
    asked = written(_assigned(asked, "q", index.centroids, probes).select(query, "q", F.explode("lists").alias("list")), "probes")
    lists = [r.list for r in asked.select("list").distinct().collect()]  # as many as there are centroids at most
    return _first(_in_blocks(index.rows.where(F.col("list").isin(lists)), asked, k, key, query), k, key, query)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", query: str = "query") -> float:
    """The share of the exact search's rows that are found."""
    both = exact.select(query, key).join(found.select(query, key, F.lit(1).alias("hit")), [query, key], "left")
    return float(both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)
