"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each is the longest known phrase plus
one byte). The phrases' hashes, least first, are the fingerprint: a minimum-hash signature of
`SIGNATURE` 32-bit values. Two signatures are alike by the share of the least hashes of their
union that both have, which estimates the Jaccard similarity of the phrase sets, exactly so
while the sets are small. Phrases grow as text repeats, so likeness follows what compression
of one text by the other's dictionary would save.

The edited text of the contract needs the next document by id. Documents are dealt into ranges
of ids, each range's first document also goes to the range before it, and each range is walked
in order: one shuffle of the texts, no task with more than a range.

Edge cases: null text counts as empty, an empty text has an empty fingerprint; two empty ones
are alike by 1, an empty and another by 0. Rows with equal ids are ordered by text; null ids
come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import small_batches, steps

SIGNATURE = 128
_B = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2 to the 64
_B_INVERSE = pow(_B, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 17)
        for i, b in enumerate((_B, _B_INVERSE)):
            steps_ = np.full(n, b, np.uint64)
            steps_[0] = 1
            _powers[i] = np.multiply.accumulate(steps_)
    return _powers[0], _powers[1]


class Parse:
    """A parse that can be continued: phrase ends so far, the dictionary, and the node of the open phrase."""

    def __init__(self):
        self.nodes: dict[int, int] = {}
        self.ends: list[int] = []
        self.node = 0
        self.at = 0

    def copy(self) -> Parse:
        out = Parse()
        out.nodes, out.ends, out.node, out.at = self.nodes.copy(), self.ends.copy(), self.node, self.at
        return out

    def feed(self, data: bytes) -> Parse:
        nodes, ends, node, at = self.nodes, self.ends, self.node, self.at
        get = nodes.get
        for at, byte in enumerate(data, at + 1):
            key = node << 8 | byte
            node = get(key, 0)
            if not node:
                nodes[key] = len(nodes) + 1
                ends.append(at)
        self.node, self.at = node, at
        return self

    def signature(self, data: bytes, k: int = SIGNATURE) -> np.ndarray:
        """The k least hashes of the phrases; the phrase that the end cuts off counts too."""
        if not data:
            return np.zeros(0, np.uint32)
        ends = np.array(self.ends if self.ends and self.ends[-1] == len(data) else [*self.ends, len(data)])
        starts = np.concatenate(([0], ends[:-1]))
        up, down = _power(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + 1) * up[: len(data)])))
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h = np.unique((h >> np.uint64(32)).astype(np.uint32))
        return h[:k]


def signature(text: str) -> np.ndarray:
    data = text.encode()
    return Parse().feed(data).signature(data)


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Estimated Jaccard similarity of the phrase sets of two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, times = np.unique(np.concatenate((a, b)), return_counts=True)
    return float((times[:k] == 2).mean())


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each text, as hexadecimal digits."""
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            got = [_hex(signature(t or "")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(got, pa.string())], names=[*(f.name for f in keep), out])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out}` string")


def _ranges(docs: DataFrame, pieces: int) -> list[int]:
    """Ids that cut the documents into ranges of about equal rows (numbers only reach the driver)."""
    cuts = docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.1 / pieces) if pieces > 1 else []
    return sorted({int(c) for c in cuts})


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Contract of op4: fingerprints of each text, its edited text, and the likeness to the next document."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    pieces = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = np.array(_ranges(rows, pieces), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).astype(np.int64))))

    # the least id of each range that has rows, in order of the ranges: as many numbers as ranges
    least = rows.select("doc_id", range_of("doc_id").alias("part")).groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).toPandas().sort_values("part")
    if not len(least):
        return spark.createDataFrame([], OUT)
    first_id = {p: None if null else int(i) for p, i, null in zip(least.part, least.least, least.nulls)}
    before = dict(zip(least.part[1:], least.part)) | ({int(least.part.iloc[0]): int(least.part.iloc[-1])} if len(least) > 1 else {})  # after the last document comes the first

    @F.pandas_udf("int")
    def host_of(ids: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([before.get(p, -1) if (None if pd.isna(i) else int(i)) == first_id[p] else -1 for i, p in zip(ids.astype("Int64"), part)], dtype="int32")

    rows = rows.withColumn("part", range_of("doc_id"))
    rows = rows.withColumn("host", host_of("doc_id", "part"))
    own = F.struct("part", F.lit(False).alias("guest"))
    sent = F.when(F.col("host") >= 0, F.array(own, F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.explode(sent).alias("s")).select("s.part", "s.guest", "doc_id", "text")
    alone = len(least) == 1
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows_of() -> Iterator[tuple]:
            for batch in steps(batches, "text"):
                yield from zip(*(batch.column(n).to_pylist() for n in ("part", "guest", "doc_id", "text")))

        def end(doc: tuple, nxt: tuple | None) -> None:
            (doc_id, text, mine, kept), other = doc, nxt if nxt else doc
            n = len(text)
            k = n // 4
            head, tail = text[: n - k].encode(), other[1][:k].encode()
            edited = head + tail
            changed = kept.feed(tail).signature(edited)
            out.append((doc_id, n, hashlib.sha256(edited).hexdigest(), _hex(mine), _hex(changed), likeness(mine, changed), likeness(mine, other[2])))

        def begin(doc_id, text: str, full: bool) -> tuple:
            n = len(text)
            head = Parse().feed(text[: n - n // 4].encode())
            kept = head.copy() if full else None
            return doc_id, text, head.feed(text[n - n // 4 :].encode()).signature(text.encode()), kept

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

        part, last, first, guest_seen = None, None, None, False
        for p, guest, doc_id, text in rows_of():
            if p != part:
                if last is not None:
                    end(last, first if alone else None)
                part, last, first, guest_seen = p, None, None, False
            if guest and guest_seen:
                continue  # of equal first ids only the first text is next
            doc = begin(doc_id, text, not guest)
            if last is not None:
                end(last, doc)
            if first is None:
                first = doc
            last, guest_seen = (None, True) if guest else (doc, False)
            if len(out) >= 500:
                yield flush()
        if last is not None:
            end(last, first if alone else None)
        if out:
            yield flush()

    return ordered.mapInArrow(run, OUT)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
