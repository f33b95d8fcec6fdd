"""Connected components of a table of links, by alternating large and small stars.

Links of a bounded number are joined by one task, which saves the rounds; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import written


#: Nodes whose least neighbours may be broadcast.
BROADCAST_ROWS = 1 << 20
#: Links that one task may join.
AT_ONCE = 1 << 17


def _kept(least: DataFrame) -> DataFrame:
    """Written first: a hub has one row here, and joins of two tables let Spark split the hub's links."""
    least = written(least, "least")
    return F.broadcast(least) if least.count() <= BROADCAST_ROWS else least


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; `edges` has u > v."""
    least = _kept(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of a task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node that can be reached."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    if e.count() <= AT_ONCE:
        return written(e.coalesce(1).mapInArrow(_joined, "node long, root long"), "joined")
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        e = written(_small(written(_large(e).distinct(), "large")).distinct(), "links")
    raise RuntimeError("components did not settle")
