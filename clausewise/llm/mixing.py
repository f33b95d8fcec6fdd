"""Mixing sources to target weights by blocks.

Each source's words, its documents in a pseudorandom order, are packed into blocks of `BLOCK`
words. Targets are the sources' weighted shares of the mix, none above `most` times its source's
size; what is above goes to the others by weight until none is above. The mix is a sequence of
output shards of `SLOTS` blocks; each shard draws its blocks' sources from a multinomial
distribution with the targets' shares. Shards form groups of `GROUP` with quotas of their own, equal
parts of the whole; draws beyond a group's quota of a source go to sources that have fewer, so
totals are exact and no group waits for another. A source's n-th slot takes the block that a pseudorandom
permutation of its block indices maps n to, a new permutation each time round, and blocks are
joined by (source, index) to the documents that lie in them.

Running sums are taken in chunks of bounded size, and over chunks, so a source with a third of
all rows is nobody's single task. Only one row a source reaches the driver. All draws follow from
`SEED` and the documents' contents, so reruns agree.

Edge cases: null text has size 0; a null source is a source of its own, after all others; documents
of size 0 are in no block and taken 0 times; an empty table gives an empty mix. Repeated rows
are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import byte_view, no_null, small_batches, steps, written

BLOCK = 64
SLOTS = 4096
GROUP = 64  # shards of a group
CHUNK = 8192  # documents of a chunk, on average
SEED = 20240229
#: Sources whose rows may be broadcast.
BROADCAST_ROWS = 1 << 17
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0

# ASCII white space, which separates words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(arr: pa.Array) -> np.ndarray:
    """Words (runs between ASCII white space) of each text of a column without nulls."""
    raw, off = byte_view(arr)
    if not len(raw):
        return np.zeros(len(arr), np.int64)
    start = ~_BLANK[raw]
    before = np.concatenate(([True], ~start[:-1]))
    before[off[:-1][off[:-1] < len(raw)]] = True
    sums = np.concatenate(([0], np.cumsum(start & before)))
    return sums[off[1:]] - sums[off[:-1]]


def with_sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by `size`, its number of words."""
    small_batches(df.sparkSession)
    keep = [f for f in df.schema if f.name not in (text, "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(word_counts(no_null(batch.column(text))))], names=[*(f.name for f in keep), "size"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "size long"]))


def _with_size(docs: DataFrame) -> DataFrame:
    """`docs` with `size`, the text kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_counts(no_null(batch.column("text"))))], names=[*batch.schema.names, "size"])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "size long"]))


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Weighted shares of `total`, at most `most` times the size; the excess is reshared by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, most * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the indices i in pseudorandom permutations of 0 .. n-1: a Feistel network, walked until it is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, out, open_ = i.astype(np.uint64), np.zeros(len(i), np.int64), np.arange(len(i))
    while len(open_):
        h, m, k = half[open_], low[open_], key[open_]
        a, b = x[open_] >> h, x[open_] & m
        for r in range(4):
            a, b = b, a ^ _mix64(b + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & m
        x[open_] = a << h | b
        done = x[open_] < n[open_].astype(np.uint64)
        out[open_[done]] = x[open_[done]].astype(np.int64)
        open_ = open_[~done]
    return out


def draws(quotas: np.ndarray, group: int, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sources (columns) in a group's shards (rows), and each source's slots before the group."""
    before, after = group * quotas // n_groups, (group + 1) * quotas // n_groups
    mine = after - before
    total = int(mine.sum())
    left = [min(SLOTS, total - k) for k in range(0, total, SLOTS)]
    rng = np.random.default_rng([SEED, group])
    n = np.array([rng.multinomial(k, mine / total) for k in left], np.int64).reshape(-1, len(quotas))
    over = n - np.clip(mine - (np.cumsum(n, 0) - n), 0, n)  # draws beyond the quota
    n -= over
    short = np.cumsum(mine - n.sum(0))
    ends = np.cumsum(over.sum(1))
    for k, (a, b) in enumerate(zip(ends - over.sum(1), ends)):
        n[k] += np.clip(short, a, b) - np.clip(np.concatenate(([0], short[:-1])), a, b)
    return n, before


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`docs` (doc_id, text, source) without texts, with size, source_size, target, taken, `row` (a number of the row) and `pieces`: (first word, words, times taken) of each."""
    spark = docs.sparkSession
    sized = with_sizes(docs.select("doc_id", "text", "source"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()).withColumn("order", F.xxhash64(F.lit(SEED), "doc_id")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).toPandas()  # a row for each source
    sources["sort"] = [(s is None, (s or "").encode("utf-32-be", "surrogatepass")) for s in sources.source]
    sources = sources.sort_values("sort").reset_index(drop=True)
    w = [weights[i % len(weights)] for i in range(len(sources))]
    sources["target"] = np.array(targets(sources.source_size.tolist(), w, share * sources.source_size.sum(), most), float)
    sources["s"] = np.arange(len(sources))
    sources["n_blocks"] = -(-sources.source_size // BLOCK)
    each = np.where(sources.n_blocks > 0, sources.source_size / np.maximum(sources.n_blocks, 1), 1.0)
    sources["quota"] = np.minimum(np.rint(sources.target / each), np.floor(most) * sources.n_blocks).astype("int64")
    info = spark.createDataFrame(list(zip(*(sources[c].tolist() for c in ("s", "source", "source_size", "n_docs", "target", "n_blocks")))), "s int, source string, source_size long, n_docs long, target double, n_blocks long") if len(sources) else None
    if info is None:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, source string, size long, row long, source_size long, target double, taken long, pieces array<struct<a:long,n:long,times:long>>")

    # where each document starts among its source's words: running sums inside chunks, and over chunks
    d = sized.join(F.broadcast(info) if len(sources) <= BROADCAST_ROWS else info, sized.source.eqNullSafe(info.source)).drop(info.source)
    d = d.withColumn("chunk", F.pmod("order", F.ceil(F.col("n_docs") / CHUNK)))
    chunks = d.groupBy("s", "chunk").agg(F.sum("size").alias("chunk_size"))
    chunks = chunks.withColumn("chunk_start", F.sum("chunk_size").over(Window.partitionBy("s").orderBy("chunk")) - F.col("chunk_size"))
    inside = Window.partitionBy("s", "chunk").orderBy("order", "doc_id", "size", "row")
    d = d.join(chunks.drop("chunk_size"), ["s", "chunk"]).withColumn("start", F.col("chunk_start") + F.sum("size").over(inside) - F.col("size"))
    d = written(d.select("row", "doc_id", "source", "s", "size", "source_size", "target", "start"), "starts")

    taken = plan(spark, sources).groupBy("s", "index").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    parts = d.where("size > 0").select("row", "s", "start", "size", F.explode(F.sequence(first, last)).alias("index"))
    a = F.greatest(F.col("start"), F.col("index") * BLOCK)
    n = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * BLOCK) - a
    parts = parts.select("row", "s", "index", (a - F.col("start")).alias("a"), n.alias("n")).join(taken.hint("merge"), ["s", "index"])
    by_row = parts.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"), F.sort_array(F.collect_list(F.struct("a", "n", "times"))).alias("pieces"))
    out = d.join(by_row, "row", "left")
    return out.select("doc_id", "source", "size", "row", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("pieces", F.array().cast("array<struct<a:bigint,n:bigint,times:bigint>>")).alias("pieces"))


def plan(spark: SparkSession, sources: pd.DataFrame) -> DataFrame:
    """The mix: a row (shard, s, slot, index) for every slot of every output shard, `index` being the source's block."""
    used = sources[sources.quota > 0]
    q = used.quota.to_numpy(np.int64)
    total = int(q.sum())
    if not total:
        return spark.createDataFrame([], "shard long, s int, slot long, index long")
    n_groups = -(-total // (SLOTS * GROUP))
    s, n_blocks = used.s.to_numpy(np.int32), used.n_blocks.to_numpy(np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                n, before = draws(q, g, n_groups)
                lo = before + np.cumsum(n, 0) - n
                shard, u = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(g * (GROUP + len(q)) + shard), pa.array(s[u]), pa.array(n_blocks[u]), pa.array(lo[shard, u]), pa.array(n[shard, u])], names=["shard", "s", "n_blocks", "lo", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, slot, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "slot", "n_blocks"))
            key = _mix64(src.astype(np.uint64) << np.uint64(32) ^ (slot // n).astype(np.uint64) ^ np.uint64(SEED))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("s"), batch.column("slot"), pa.array(permuted(slot % n, n, key))], names=["shard", "s", "slot", "index"])

    parts = max(1, min(n_groups, 4 * spark.sparkContext.defaultParallelism))
    drawn = spark.range(0, n_groups, 1, parts).mapInArrow(draw, "shard long, s int, n_blocks long, lo long, n long")
    slots = drawn.select("shard", "s", "n_blocks", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("slot"))
    return slots.mapInArrow(places, "shard long, s int, slot long, index long")


def mixed_words(docs: DataFrame) -> DataFrame:
    """Contract of op5."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them: a row for each time round, with the words of the document's blocks that this round takes.

    Texts are cut between words; n_chars, where there is such a column, is the new length.
    """
    small_batches(docs.sparkSession)
    parts = mix(docs).where("taken > 0").select("doc_id", "source", "size", F.transform("pieces", lambda p: F.struct(p["a"], p["n"], p["times"])).alias("pieces"))
    # equal rows of a document take turns: the n-th row has the n-th list of pieces
    number = lambda w: F.row_number().over(w)
    left = parts.withColumn("nth", number(Window.partitionBy("doc_id", "source", "size").orderBy("pieces")))
    # columns go under names of their own, whatever theirs are
    plain = docs.select("doc_id", "source", "text", *(docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns) if c != "text"))
    right = _with_size(plain).withColumn("nth", number(Window.partitionBy("doc_id", "source", "size").orderBy("text")))
    on = [left[c].eqNullSafe(right[c]) for c in ("doc_id", "source", "size", "nth")]
    names = docs.columns
    rows = right.join(left, on).select(right.text, left.pieces, *(right[f"_c{i}"] for i, c in enumerate(names) if c != "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            at, texts = [], []
            for i, (text, pieces) in enumerate(zip(batch.column("text").to_pylist(), batch.column("pieces").to_pylist())):
                for part in taken_texts(text, [(p["a"], p["n"], p["times"]) for p in pieces]):
                    at.append(i)
                    texts.append(part)
            rows_ = pa.array(at, pa.int64())
            cols = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(f"_c{i}").take(rows_) for i, n in enumerate(names)], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {'long' if n == 'n_chars' else t}" for n, t in docs.dtypes))


def taken_texts(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """The text of each time round: the pieces' words, with the white space between words that follow each other."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    word = ~_BLANK[raw]
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    ends = np.flatnonzero(word & np.concatenate((~word[1:], [True]))) + 1
    out = []
    for turn in range(1, max((t for *_, t in pieces), default=0) + 1):
        spans: list[list[int]] = []
        for a, n, times in sorted(pieces):
            if times >= turn:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = a + n
                else:
                    spans.append([a, a + n])
        out.append(b" ".join(data[starts[a] : ends[b - 1]] for a, b in spans).decode())
    return out
