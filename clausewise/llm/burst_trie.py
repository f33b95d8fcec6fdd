"""Prefix trie of conversations by bursting containers of suffixes.

1. Turns are numbered within their conversation by range partitions and counts of the partitions before, so
   that no conversation is sorted in one task. Texts don't move: a turn goes on as the 128-bit digest of its
   role and text, its id, and its length.
2. A conversation's turn ids, 16 bytes each, are one value. Equal sequences become one suffix with a count.
3. The trie starts with one head, the root, whose container has all suffixes. A container of more than
   `LIMIT` suffixes bursts: its head runs along the turns that all its suffixes share, to where they part, and
   there a container is made for each next turn id. This goes on until no container is too large.
4. The containers left are sorted and swept: the common prefix of neighbours tells which nodes are open. Each
   gives its nodes and the sums of its subtree.
5. From the last burst to the first, a head takes the sums of its containers and heads and gives the nodes of its run.

Numbers of rounds are those in which a container over the limit parts along one path. A task holds one
bin of containers of about `BIN` turns, or one container.

Ends: ids of equal conversations are packed by ranges of ids, some thousands a row, and hashed in order as a stream.

Edge cases: rows with a null conv_id belong to no conversation. Null turns come first; equal turns are ordered by
role, then by the MD5 digest of the text; repeated rows count each. Null roles and texts are empty ones. `c - c % 100`
rounds towards zero. An empty table has no nodes. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from clausewise.llm.common import small_batches, written

#: Suffixes, and their turns, of which a container may have more than one; turns of the containers that share a task.
LIMIT, TURNS, BIN = 64, 1 << 20, 1 << 18
#: Ids of one packed row.
PACKED = 8192
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 1 << 17
#: Bytes of a turn's id.
ID = 16


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, tid, chars): turns of `turns` (conv_id, turn, role, text) in order, at from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.md5(text)
    tid = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, told)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), told.alias("told"), tid.alias("tid"), F.length(text).alias("chars"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("told")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.select("conv_id", "tid", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    # a conversation has a row here for each partition that it reaches
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("m"), F.min("row").alias("first"))
    conv = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("m").over(conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("conv_id", "part", (before - F.col("first")).alias("shift")), "starts")
    return ranged.join(_small(starts), ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "tid", "chars")


def shared_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation has from the first of its hundred, at most."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, n, ids, chars) of every rebuilt conversation: its turns' ids in one value, and their lengths."""
    rows = written(numbered(turns), "numbered")
    convs = rows.where("at = 0").select("conv_id", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    turn = F.struct(F.col("at").cast("int").alias("at"), "tid", "chars")
    heads = rows.where("at < 5 and conv_id % 100 = 0").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    # own turns come after those of the head; their order is all that counts
    own = rows.where(F.col("at") >= shared_turns(F.col("conv_id"))).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("own"))
    both = convs.join(heads, "base", "left").join(own, "conv_id", "left")
    empty = F.array().cast("array<struct<at:int,tid:binary,chars:int>>")
    all_turns = F.concat(F.when(F.col("h") > 0, F.slice(F.coalesce("head", empty), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(empty), F.coalesce("own", empty))
    out = both.select("conv_id", all_turns.alias("turns"))
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.tid)), ""))
    return out.select("conv_id", F.size("turns").alias("n"), ids.alias("ids"), F.transform("turns", lambda t: t.chars).alias("chars"))


def ends(convs: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the ids of all conversations of `convs` (conv_id, key) with a key."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["key", "first", "ids"])

        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or len(ids) >= PACKED:
                    if ids:
                        yield done()
                    key, ids = k, []
                ids.append(conv)
        if ids:
            yield done()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key or state is None:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends_sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    ranged = convs.repartitionByRange(parts, "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return ranged.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


_NODES = "conv_id long, depth long, parent_conv_id long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ended binary"
_NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("up", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ended", pa.binary())])


def sweep(suffixes: list[tuple[bytes, list[int], int, int, bytes]], top: int) -> list[list]:
    """Nodes of a container whose first is at depth `top`, that one last: rows as in _NODE without `up`.

    A suffix is (ids, lengths of texts, least conv_id, conversations, key), all with the same first `top` turns.
    """
    out: list[list] = []
    stack: list[list] = []  # open nodes: [conv_id, n, children, leaves, saved, key of those that end, chars, rows of children]

    def close() -> None:
        conv, n, children, leaves, saved, key, chars, rows = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * chars
        for row in rows:
            row[2] = conv
        out.append([conv, top + len(stack), None, n, children, leaves, saved, key])
        if stack:
            up = stack[-1]
            up[0], up[1], up[2], up[3], up[4] = min(up[0], conv), up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved
            up[7].append(out[-1])

    last = b""
    for ids, chars, conv, n, key in sorted(suffixes, key=lambda x: x[0]):
        same = top  # depth to which this one and the last agree
        if stack:
            most = min(len(ids), len(last)) // ID
            while same < most and ids[same * ID : (same + 1) * ID] == last[same * ID : (same + 1) * ID]:
                same += 1
            while len(stack) > same - top + 1:
                close()
        else:
            stack.append([conv, 0, 0, 0, 0, None, chars[top - 1] if top else 0, []])
        for d in range(top + len(stack), len(ids) // ID + 1):
            stack.append([conv, 0, 0, 0, 0, None, chars[d - 1], []])
        at = stack[-1]
        at[0], at[1], at[5] = min(at[0], conv), at[1] + n, key
        last = ids
    while stack:
        close()
    return out


def _swept(left: DataFrame) -> DataFrame:
    """All nodes of the containers `left` (head, up, top, ids, chars, conv_id, m, key); the first node of each has `up`."""
    total = left.agg(F.sum(F.col("n") - F.col("top") + 1)).first()[0] or 0
    bins = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BIN))

    def run(group: pa.Table) -> pa.Table:
        by: dict[bytes, list] = {}
        for head, up, top, *suffix in zip(*(group.column(c).to_pylist() for c in ("head", "up", "top", "ids", "chars", "conv_id", "m", "key"))):
            by.setdefault(head, [up, top]).append(tuple(suffix))
        rows = []
        for up, top, *suffixes in by.values():
            found = sweep(suffixes, top)
            rows += [(*r[:3], None, *r[3:]) for r in found[:-1]]
            r = found[-1]
            rows.append((*r[:3], up, *r[3:]))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), _NODE)], schema=_NODE)

    return left.withColumn("bin", F.pmod(F.xxhash64("head"), F.lit(bins))).select("bin", "head", "up", "top", "ids", "chars", "conv_id", "m", "key").groupBy("bin").applyInArrow(run, _NODES)


@F.udf(IntegerType(), useArrow=True)
def agreed(low: bytes, high: bytes) -> int:
    """The turns that the least and the greatest sequence, and so all between them, share."""
    return len(os.path.commonprefix([low, high])) // ID


def _prefix(turns: Column | str) -> Column:
    return F.unhex(F.md5(F.expr(f"substring(ids, 1, {ID} * ({turns}))")))


def nodes(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Contract of op12: all nodes of the trie of the rebuilt conversations."""
    spark = turns.sparkSession
    small_batches(spark)
    convs = written(rebuilt(turns).withColumn("key", F.unhex(F.md5("ids"))), "rebuilt")
    least = convs.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("m"))
    classes = convs.join(least, ["key", "conv_id"]).select("key", "conv_id", "m", "n", "ids", "chars")
    ended = written(ends(convs.select("conv_id", "key")), "ends")

    # `top` is the depth of a container's first node, `up` its parent's head; the root comes first and always bursts
    left = written(classes.select("*", F.unhex(F.md5(F.lit(""))).alias("head"), F.lit(None).cast("binary").alias("up"), F.lit(0).alias("top")), "container")
    done, bursts = [], []
    while True:
        sizes = left.groupBy("head").agg(F.count("*").alias("suffixes"), F.sum(F.col("n") - F.col("top")).alias("turns"), F.min("ids").alias("low"), F.max("ids").alias("high"))
        over = F.lit(True) if not bursts else (F.col("suffixes") > limit) | ((F.col("suffixes") > 1) & (F.col("turns") > TURNS))
        large = written(sizes.where(over).select("head", agreed("low", "high").alias("to")), "large")
        if not large.limit(1).count():
            break
        sided = _small(large)
        if bursts:
            done.append(left.join(sided, "head", "left_anti"))
        burst = written(left.join(sided, "head"), "burst")
        bursts.append(burst)
        # those that go on, by their next turn
        left = written(
            burst.where("n > to").select("key", "conv_id", "m", "n", "ids", "chars", _prefix("to + 1").alias("head"), F.col("head").alias("up"), (F.col("to") + 1).alias("top")), "container"
        )
    swept = written(_swept(reduce(DataFrame.unionByName, [left, *done])), "swept")

    below = swept.where("up is not null").select("up", "conv_id", "n_convs", "n_leaves", "saved_tokens")
    runs = []
    for burst in reversed(bursts):
        mine = burst.select("head", "up", "top", "to", "conv_id", "m", "n", "key", "chars")
        of = mine.groupBy("head").agg(
            F.first("up").alias("up"), F.first("top").alias("top"), F.first("to").alias("to"), F.min("conv_id").alias("conv_id"), F.sum("m").alias("n_convs"),
            F.max(F.when(F.col("n") == F.col("to"), F.col("key"))).alias("ended"), F.max_by(F.expr("slice(chars, greatest(top, 1), to - greatest(top, 1) + 1)"), -F.col("conv_id")).alias("run"),
        )
        sums = below.groupBy(F.col("up").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        of = written(of.join(sums, "head", "left").select("*", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("under")).drop("leaves", "saved"), "heads")
        runs.append(of)
        first = F.col("under") + (F.col("n_convs") - 1) * F.aggregate("run", F.lit(0).cast("long"), lambda a, x: a + x)
        below = below.unionByName(of.where("up is not null").select("up", "conv_id", "n_convs", "n_leaves", first.alias("saved_tokens")))
    if not runs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    heads = reduce(DataFrame.unionByName, runs)
    heads = written(heads, "all-heads")
    # what is saved at each node of a run: the node's and of all below
    steps = F.expr("transform(sequence(top, to), (d, i) -> struct(cast(d as long) as depth, under + (n_convs - 1) * aggregate(slice(run, if(top = 0, greatest(i, 1), i + 1), size(run)), 0L, (a, x) -> a + x) as saved))")
    path = heads.withColumn("s", F.explode(steps)).select(
        "conv_id", F.col("s.depth").alias("depth"), F.when(F.col("s.depth") > F.col("top"), F.col("conv_id")).alias("parent_conv_id"), F.when(F.col("s.depth") == F.col("top"), F.col("up")).alias("up"), "n_convs",
        F.when(F.col("s.depth") < F.col("to"), F.lit(1)).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"), "n_leaves", F.col("s.saved").alias("saved_tokens"), F.when(F.col("s.depth") == F.col("to"), F.col("ended")).alias("ended"),
    )
    every = swept.unionByName(path)
    named = heads.select(F.col("head").alias("up"), F.col("conv_id").alias("of"))
    every = every.join(_small(named), "up", "left").join(ended.withColumnRenamed("key", "ended"), "ended", "left")
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "of").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
