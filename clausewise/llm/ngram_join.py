"""Self-join of documents by the Jaccard similarity of their word n-grams.

1. A text's set is its distinct word n-grams as 64-bit hashes. Texts with equal sets form a
   class, which is one entry from here on.
2. All sets are ordered alike, by how frequent an n-gram is in a bounded sample (this only sets
   the order; any order is right) and by hash. With a set of n and least overlap t, two similar
   sets share at least l of the first n - t + l n-grams of both (the prefix). Every set has
   l = n / 10 + 1 at least; a set whose prefix is costly, by the sampled frequencies, gets a prefix
   that is longer by two or four times as much, and needs as many more matches.
3. A set goes on only if enough of its shortest prefix occurs in another set's prefix. That takes
   one aggregation with partial sums, and lets through little but near copies.
4. Pairs that share enough prefix n-grams are candidates. N-grams in more than `DENSE` sets
   emit no pairs. Sets of whose matches half could be such n-grams get a second prefix, in the order
   of how many of these sets exactly have an n-gram: texts that only share a common passage have prefixes of
   their own words then, and only copies of one text still have dense ones. Two sets that share many of
   these join one cluster. Clusters are the components of both.
5. Within a cluster sets are compared exactly, in blocks of `SIDE` sets against each other,
   as one matrix product; a block pair returns links enough to connect what it found linked. In a
   cluster of more than `SIDE` sets all are first compared with about `PIVOTS` of them. The most sets that links
   with pivots connect are done among themselves; the others are compared with each other,
   and with those unless they are too far from all pivots for that (one minus the similarity is a metric).
6. Components of the links; every document gets its class's component.

No pair is dropped, and no task holds more than two blocks. A cluster of m sets of which r aren't connected by
pivots is read r / SIDE + 2 times.

Edge cases: null text, text without words: empty set, no links, component_id is the own doc_id.
Fewer words than n: the whole sequence is the one element. A null doc_id takes part; components
have the smallest id that isn't null, or null. Repeated rows are in one class. Null or repeated ids cost
no more than others: texts are found again by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import small_batches, steps, written
from clausewise.llm.components import components

#: Documents of the sample that sets the order, least count in it of a frequent n-gram, and how many of these are told apart.
SAMPLE, FREQUENT, ORDERED = 1 << 15, 8, 1 << 17
#: n-grams in more sets than this emit no pairs; sets of one side of an exact comparison.
DENSE, SIDE = 48, 512
#: Sets of a large cluster that all others are compared with, and dense n-grams that are told apart in the second order.
PIVOTS, TOLD = 24, 1 << 20
#: Sets whose ids may be broadcast.
BROADCAST_ROWS = 1 << 20
#: Bytes of sets in one task of small clusters, on average.
BIN = 1 << 25
_REMEMBERED = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word k-grams; of fewer words, of the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > _REMEMBERED:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        x = np.array([len(h)], np.uint64)
        for w in h:
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
        return x
    m = len(h) - k + 1
    x = np.full(m, k + 1000, np.uint64)
    for j in range(k):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m])
    return np.unique(x)


def least_overlap(n, percent: int):
    """What a set of n shares with any similar one at least."""
    return -(-n * percent // 100)


def _least_matches(n, percent: int, least=min):
    """Matches that every prefix of a set of n asks for at least; it doesn't fall as n grows."""
    overlap = F.ceil(n * percent / 100) if least is not min else least_overlap(n, percent)
    return least((F.floor(n / 10) if least is not min else n // 10) + 1, overlap)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams of a bounded sample, most frequent last, and their counts in it."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 16 << 20):
            sets = [shingles(t, k) for t in batch.column("text").to_pylist()]
            grams, count = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(grams[count > 1])), pa.array(count[count > 1])], names=["gram", "n"])

    top = part.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(ORDERED).toPandas()
    return top.gram.to_numpy(np.int64).view(np.uint64)[::-1], top.n.to_numpy(np.int64)[::-1]


class Order:
    """Ranks of frequent n-grams; all others come before them."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        by = np.argsort(grams)
        self.grams, self.ranks = grams[by], by.astype(np.int64) + 1
        self.counts = np.concatenate(([1], counts))  # by rank

    def rank(self, x: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(x), np.int64)
        i = np.minimum(np.searchsorted(self.grams, x), len(self.grams) - 1)
        return np.where(self.grams[i] == x, self.ranks[i], 0)

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The prefix of a set in this order, and the matches it asks for."""
        rank = self.rank(s)
        s = s[np.argsort(rank, kind="stable")]
        slack = len(s) - int(least_overlap(len(s), percent))
        least = _least_matches(len(s), percent)
        sums = np.cumsum(self.counts[np.sort(rank)])
        # scanning a prefix costs its length, verifying what matches: at most the sum of frequencies over l
        cost = {l: slack + l + int(sums[min(slack + l, len(s)) - 1]) // l for l in (least, 2 * least, 4 * least) if slack + l <= len(s)}
        l = min(cost, key=lambda x: (cost[x], x))
        return s[: slack + l], l


def _sets(docs: DataFrame, k: int, percent: int, order: Order) -> DataFrame:
    """(doc_id, n, key, l, prefix) of every document, and its further columns."""
    model = docs.sparkSession.sparkContext.broadcast(order)
    own = [f for f in docs.schema if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            n, key, match, prefix = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, k)
                p, l = model.value.prefix(s, percent) if len(s) else (s, 0)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                match.append(l)
                prefix.append(_signed(p))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(match, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), *(batch.column(f.name) for f in own)], names=["doc_id", "n", "key", "l", "prefix", *(f.name for f in own)])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, l int, prefix array<long>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in own))


def _full_sets(rows: DataFrame, k: int) -> DataFrame:
    """`rows` (cid, key, text, and more) whose text has the key's set, with `grams`, the set, in place of key and text."""
    more = [f for f in rows.schema if f.name not in ("cid", "key", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = [shingles(t, k).tobytes() for t in batch.column("text").to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(s) == key for s, key in zip(sets, batch.column("key").to_pylist())])
            out = pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary()), *(batch.column(f.name) for f in more)], names=["cid", "grams", *(f.name for f in more)])
            yield out.filter(same)

    return rows.mapInArrow(run, "cid long, grams binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of two lists of sets, or within one."""
    sets = a + (b or [])
    side = len(a)
    n = np.array([len(s) for s in sets])
    grams, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    inter = np.zeros((side, len(sets) - side if b else side), np.float32)
    step = 4096
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(col, (lo, lo + step))
        m = np.zeros((len(sets), step), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m[:side] @ (m[side:] if b else m).T
    other = n[side:] if b else n
    inter = inter.astype(np.int64)
    return inter, n[:side, None] + other[None, :] - inter


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the similar pairs of two lists of sets, or within one."""
    i, j = _places(*_overlaps(a, b), percent)
    return (i, j) if b else (i[i < j - len(a)], j[i < j - len(a)] - len(a))


def _places(inter: np.ndarray, union: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the similar pairs of two lists, those of the second after the first."""
    i, j = np.nonzero((100 * inter >= percent * union) & (union > 0))
    return i, j + len(inter)


def _forest(ids: list[int], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect, at most one a node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = find(x), find(y)
        if a != b:
            parent[a] = b
            out.append((ids[x], ids[y]))
    return out


def _shared(pre: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of `pre` (cid, n, l, gram, pos): links (u, v) of pairs that may be similar, and (gram, cid) of the dense n-grams by which others are found.

    Of l matches, half are of n-grams in few sets, or more than half are of n-grams in many.
    """
    counted = pre.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    rows = written(pre.join(counted, "gram"), "shared")
    # many: of q such n-grams, rarest first, two sets that have d in common share one of the first q - d + 1
    dense = rows.where(F.col("df") > DENSE)
    d = F.floor(_least_matches(F.ceil(F.col("n") * percent / 100), percent, F.least) / 2) + 1
    by_set = Window.partitionBy("cid")
    place = F.row_number().over(by_set.orderBy("df", "gram"))
    first = dense.withColumn("q", F.count("*").over(by_set)).withColumn("place", place).where(F.col("place") <= F.col("q") - d + 1).select("gram", "cid")
    # few: pairs, counted
    sparse = rows.where(F.col("df") <= DENSE).select("gram", "cid", "n", "l", "pos", (F.col("n") - F.ceil(F.col("n") * percent / 100)).alias("slack"))
    a, b = sparse.alias("a"), sparse.alias("b")
    low = F.least("a.l", "b.l")
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.cid") < F.col("b.cid"))).where(
        (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent) & (F.col("a.pos") < F.col("a.slack") + low) & (F.col("b.pos") < F.col("b.slack") + low)
    )
    enough = pairs.groupBy(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).agg(F.count("*").alias("n"), F.min(low).alias("low")).where("n >= low - floor(low / 2)")
    return enough.select("u", "v"), first


def _told(text: Column) -> Column:
    """Tells texts of one id apart; what it can't, `_full_sets` does."""
    return F.xxhash64(text)


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (cid, key, doc, told, and more) with the texts of their documents.

    Documents are found by id and text: a document joins one row at most, also where ids are null or repeated.
    """
    small = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return docs.select("doc_id", "text").join(small, docs.doc_id.eqNullSafe(small.doc) & (_told(docs.text) == small.told)).drop("doc_id", "doc", "told")


def _dense(sets: DataFrame) -> Order:
    """The n-grams in more than `DENSE` of `sets` (cid, grams), the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = dict(zip(batch.column("cid").to_pylist(), batch.column("grams").to_pylist()))
            grams, count = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in seen.values()] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(grams)), pa.array(count)], names=["gram", "n"])

    counts = sets.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > DENSE)
    top = counts.orderBy(F.desc("n"), "gram").limit(TOLD).toPandas()
    return Order(top.gram.to_numpy(np.int64).view(np.uint64)[::-1], top.n.to_numpy(np.int64)[::-1])


def _again(sets: DataFrame, percent: int, order: Order) -> DataFrame:
    """(cid, n, l, prefix) of `sets` (cid, grams) in another order."""
    model = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.uint64) for x in batch.column("grams").to_pylist()]
            prefixes = [model.value.prefix(x, percent) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([len(x) for x in found], pa.int64()), pa.array([l for _, l in prefixes], pa.int32()), pa.array([_signed(p) for p, _ in prefixes], pa.list_(pa.int64()))], names=["cid", "n", "l", "prefix"])

    return sets.mapInArrow(run, "cid long, n long, l int, prefix array<long>")


def _candidates(pre: DataFrame, docs: DataFrame, keys: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between sets that may be similar, of `pre` (cid, n, l, gram, pos)."""
    pairs, first = _shared(pre, percent)
    entangled = written(first.select("cid").distinct(), "entangled")
    if not entangled.limit(1).count():
        return pairs
    of = keys.join(entangled, "cid")
    whole = written(_full_sets(_texts(docs, of), k).dropDuplicates(["cid"]), "whole")
    again = written(_again(whole, percent, _dense(whole)), "prefixes-again")
    others, first = _shared(again.select("cid", "n", "l", F.posexplode("prefix").alias("pos", "gram")), percent)
    first = written(first, "dense")
    hubs = first.groupBy("gram").agg(F.min("cid").alias("hub"))
    stars = first.join(hubs, "gram").where("cid != hub").select(F.col("cid").alias("u"), F.col("hub").alias("v")).distinct()
    return pairs.unionByName(others).unionByName(stars)


def _placed(clusters: DataFrame, keys: DataFrame) -> DataFrame:
    """(cid, key, doc, told, n, root, m, sides, side) of the sets in clusters of m: which of a cluster's sides each is on."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m")).withColumn("sides", F.ceil(F.col("m") / SIDE).cast("int"))
    rows = clusters.join(sizes, "root").join(keys, clusters.node == keys.cid).select("cid", "key", "doc", "told", "n", "root", "m", "sides")
    return rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("sides")).cast("int"))


_LINKS = "u long, v long"


def _block(group: pa.Table) -> dict[tuple, tuple[dict, dict]]:
    """The sets of a task's blocks, two sides each: {(root, p, q): ({cid: set}, {cid: set})}."""
    by: dict[tuple, tuple[dict, dict]] = {}
    for root, cid, data, p, q, second in zip(*(group.column(c).to_pylist() for c in ("root", "cid", "grams", "p", "q", "second"))):
        by.setdefault((root, p, q), ({}, {}))[int(second)][cid] = np.frombuffer(data, np.uint64)
    return by


def _in_blocks(tasks: DataFrame, percent: int, spread) -> DataFrame:
    """Links (u, v) of `tasks` (root, p, q, second, cid, grams): of a block's first side with its second, or within the first if it has no other."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        for (_, p, q), (a, b) in _block(group).items():
            ids = [*a, *b]
            if a and (b or p == q) and len(ids) > 1:
                out += _forest(ids, *_linked([*a.values()], [*b.values()] if p != q else None, percent))
        u, v = zip(*out) if out else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return tasks.withColumn("task", spread).select("task", "root", "p", "q", "second", "cid", "grams").groupBy("task").applyInArrow(run, _LINKS)


def _bins(grams: int, spark: SparkSession) -> int:
    """Tasks that clusters of one side share: `BIN` bytes of sets each on average, and enough for all executors."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * grams // BIN))


def _verify(sets: DataFrame, percent: int, bins: int) -> DataFrame:
    """Links (u, v) between similar sets of a cluster, all compared with all; `sets` as from _full_sets, repeated rows allowed."""
    # each set goes to the pairs of its side with every side of its cluster; small clusters share tasks
    tasks = sets.select("root", "sides", "cid", "grams", "side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    tasks = tasks.select("root", "cid", "grams", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "sides", (F.col("side") > F.col("other")).alias("second"))
    spread = F.when(F.col("sides") > 1, F.xxhash64("root", "p", "q")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins)))
    return _in_blocks(tasks, percent, spread)


_NEAR = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cid", pa.int64())])


def _to_pivots(sets: DataFrame, percent: int) -> DataFrame:
    """Of large clusters: links (u, v) with pivots, and the `cid` of the sets that can't be linked to any set that a pivot is linked to."""
    pivot = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30)) < F.lit(PIVOTS * (1 << 30)) / F.col("m")
    chosen = sets.where(pivot).select("root", "cid", "grams", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("p"), F.lit(True).alias("second"))
    tasks = sets.select("root", "cid", "grams", F.col("side").alias("p"), F.lit(False).alias("second")).unionByName(chosen).withColumn("q", F.lit(-1))

    def run(group: pa.Table) -> pa.Table:
        links, far = [], []
        for a, b in _block(group).values():
            if a and b:
                ids = [*a]
                inter, union = _overlaps([*a.values()], [*b.values()])
                links += _forest([*ids, *b], *_places(inter, union, percent))
                # linked sets are (100 - percent) / 100 apart at most, so what is twice as far from a pivot isn't linked to any that the pivot is
                far += [ids[x] for x in np.flatnonzero((100 * inter < (2 * percent - 100) * union).all(1)).tolist()]
        u, v = zip(*links) if links else ((), ())
        columns = ([*u, *[None] * len(far)], [*v, *[None] * len(far)], [*[None] * len(u), *far])
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)

    return tasks.withColumn("task", F.xxhash64("root", "p")).groupBy("task").applyInArrow(run, "u long, v long, cid long")


def _verify_large(sets: DataFrame, percent: int, bins: int) -> DataFrame:
    """Links (u, v) that connect what is linked in large clusters; `sets` (cid, grams, root, m, sides, side), each once."""
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    found = written(_to_pivots(sets, percent), "pivots")
    links = found.where("u is not null").select("u", "v")
    near = components(links).select(F.col("node").alias("cid"), F.col("root").alias("part"))
    parts = written(sets.select("cid", "root", "sides").join(small(near), "cid", "left").join(small(found.where("cid is not null").select("cid").withColumn("far", F.lit(True))), "cid", "left"), "parts")
    most = parts.where("part is not null").groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
    rest = parts.join(small(written(most, "most")), "root", "left").where(~F.col("part").eqNullSafe(F.col("most")) | F.col("part").isNull()).select("cid", "root", "sides", (F.col("part").isNotNull() | F.col("far").isNull()).alias("near"))
    sizes = rest.groupBy("root").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("rsides"))
    rest = written(rest.join(sizes, "root").withColumn("rside", F.pmod(F.xxhash64("cid"), F.col("rsides")).cast("int")), "rest")
    if not rest.limit(1).count():
        return links
    alone = sets.select("cid", "grams").join(small(rest), "cid")
    among = _verify(alone.select("cid", "grams", "root", F.col("rsides").alias("sides"), F.col("rside").alias("side")), percent, bins)
    # the others that are near a pivot against those connected, in blocks of a side each; q below 0: never a side with itself
    first = alone.where("near").select("root", "cid", "grams", F.col("rside").alias("p"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("q"), F.lit(False).alias("second"))
    clusters = rest.where("near").select("root", "rsides").distinct()
    done = sets.join(small(rest.select("cid")), "cid", "left_anti").join(small(clusters), "root")
    second = done.select("root", "cid", "grams", F.explode(F.sequence(F.lit(0), F.col("rsides") - 1)).alias("p"), F.col("side").alias("q"), F.lit(True).alias("second"))
    tasks = first.unionByName(second).withColumn("q", -1 - F.col("q"))
    return links.unionByName(among).unionByName(_in_blocks(tasks, percent, F.xxhash64("root", "p", "q")))


def join(docs: DataFrame, k: int = 5, percent: int = 80, row_key: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text): links where 100 * intersection >= percent * union.

    With `row_key`, a value that tells rows apart, also that and `group`: a number of the row's component that no other
    component has, which ids don't give where they are null or repeated.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = [] if row_key is None else [row_key.alias("row_key")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own)
    sets = written(_sets(docs.withColumn("told", _told(docs.text)), k, percent, Order(*frequent(docs, k))).withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = written(sets.where("n > 0").groupBy("key").agg(F.min("row").alias("cid"), F.min("doc_id").alias("doc"), F.min("n").alias("n")), "classes")

    # step 3: prefix n-grams that no other class has, by class
    own = F.xxhash64("key")
    grams = sets.select(own.alias("own"), F.explode("prefix").alias("gram")).groupBy("gram").agg(F.min("own").alias("own"), F.max("own").alias("to"))
    alone = grams.where("own = to").groupBy("own").agg(F.count("*").alias("alone"))
    asked = _least_matches(F.ceil(F.col("n") * percent / 100), percent, F.least)  # of the smallest set that can be similar
    some = sets.where("n > 0").select("key", own.alias("own"), "n", "l", F.size("prefix").alias("size")).distinct()
    keys = some.join(alone, "own", "left").where(F.col("size") - F.coalesce("alone", F.lit(0)) >= asked).select("key")
    keys = written(classes.join(keys, "key").select("cid"), "going")

    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    going = written(sets.join(small, F.col("row") == F.col("cid")).select("cid", "key", F.col("doc_id").alias("doc"), "told", "n", "l", "prefix").hint("rebalance"), "prefixes")
    keys = going.select("cid", "key", "doc", "told", "n")
    pre = going.select("cid", "n", "l", F.posexplode("prefix").alias("pos", "gram"))
    placed = written(_placed(components(_candidates(pre, docs, keys, k, percent)), keys), "placed")
    bins = _bins(placed.agg(F.sum("n")).first()[0] or 0, spark)
    links = _verify(_full_sets(_texts(docs, placed.where("sides = 1")), k), percent, bins)
    large = placed.where("sides > 1")
    if large.limit(1).count():
        links = links.unionByName(_verify_large(written(_full_sets(_texts(docs, large), k).dropDuplicates(["cid"]), "large"), percent, bins))
    roots = components(links)

    by_class = classes.select("key", "cid", "doc").join(roots, classes.cid == roots.node, "left").select("key", "doc", F.coalesce("root", "cid").alias("root"))
    named = by_class.groupBy("root").agg(F.min("doc").alias("component"))
    more = [] if row_key is None else ["row_key", F.coalesce("root", "row").alias("group")]  # a root is the row of one of its sets
    of_class = by_class.join(named, "root").select("key", "component", *(["root"] if more else []))
    out = sets.select("doc_id", "n", "key", *(["row", "row_key"] if more else [])).join(of_class, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), *more)
