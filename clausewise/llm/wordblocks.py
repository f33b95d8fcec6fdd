"""The distinct-word shuffle that byte-level BPE and language-model scoring share.

`blocks` splits texts into words and numbers each block's distinct words (a block is some MB of
text of one partition); documents become sequences of these numbers. `lookup` deals the blocks'
distinct words over buckets by hash, works on each distinct word of the corpus once, and answers
every block. `assemble` joins the answers back to the documents of each block by position.

What moves is each block's dictionary (a few per cent of its words) and the packed sequences,
never a row for each word of each text. A block has a bounded size, and there is a bucket for every
`BUCKET_BYTES` of text: a word that is in every text is one entry in each block.

Dictionaries and documents of a block are made by one function. `blocks` can write both to the
shared folder, or leave them as two lazy halves that cut a partition alike: then `docs` must be
rows that come again in the same order, as from files, if a task is repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import no_null, release, small_batches, steps, written

#: Text bytes of a block, and words of one packed row of documents.
BLOCK_BYTES = 16 << 20
#: Text bytes whose distinct words one bucket has.
BUCKET_BYTES = 256 << 20
ROW_WORDS = 1 << 18

#: Texts (without nulls) to their words, one after another, and each text's number of them; words as a list, or as an Arrow array.
Split = Callable[[pa.Array], tuple[list | pa.Array, np.ndarray]]


def pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) if len(x) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(words)), pack(np.fromiter(map(len, words), np.uint32, len(words)))


def unpack_words(data: bytes, lengths: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lengths, np.uint32), dtype=np.int64).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data) if ends else b""
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


BLOCKS = "block long, bucket int, words binary, lengths binary, ranks binary, counts binary, ids array<long>, sizes array<int>, counted array<boolean>, seq binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("ranks", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("counted", pa.list_(pa.bool_())), ("seq", pa.binary())])


def n_buckets(docs: DataFrame, text_bytes: int) -> int:
    """One bucket for so many bytes of text, but no fewer than shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // text_bytes))


def blocks(docs: DataFrame, split: Split, counted: Column | None = None, keep: bool = True, block_bytes: int = BLOCK_BYTES, write: Callable[[DataFrame, str], DataFrame] = written) -> tuple[DataFrame, DataFrame]:
    """The blocks of `docs` (doc_id, text): dictionary rows by bucket, and rows of documents.

    `counts` has how often a word occurs in rows for which `counted` holds (all, if it is left out).
    With `keep` both are one table, made once by `write`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"))
    buckets = n_buckets(docs, BUCKET_BYTES)
    make = lambda dictionaries, texts: rows.mapInArrow(_maker(split, buckets, block_bytes, dictionaries, texts), BLOCKS)
    if keep:
        table = write(make(True, True), "blocks")
        return table.where(F.col("bucket").isNotNull()), table.where(F.col("bucket").isNull())
    return make(True, False), make(False, True)


def _maker(split: Split, buckets: int, block_bytes: int, dictionaries: bool, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        numbers, ids, sizes, seqs, uses, held = _Numbers(), [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if seqs and isinstance(seqs[0], pa.Array):  # numbered by Arrow, all at once
                coded = pa.concat_arrays(seqs).cast(pa.binary()).dictionary_encode()
                words, seq = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            else:
                words = [w if isinstance(w, bytes) else w.encode() for w in numbers]
                seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
            n_words = np.array(sizes, np.int64)
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            counts = np.bincount(seq, np.repeat(np.array(uses, bool), n_words), len(words)).astype(np.int64)
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
            by = np.lexsort((rank, bucket))
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if dictionaries and len(by) else []:
                data, lengths = pack_words([words[i] for i in part.tolist()])
                yield _row(block, int(bucket[part[0]]), data, lengths, pack(np.diff(rank[part], prepend=np.int32(0))), pack(counts[part]), None, None, None, None)
            seq = rank[seq] if len(seq) else seq
            ends = np.cumsum(n_words)
            at = 0 if texts else len(ids)
            while at < len(ids):
                start = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, start + ROW_WORDS, "right")))
                yield _row(block, None, None, None, None, None, ids[at:to], sizes[at:to], uses[at:to], pack(seq[start : int(ends[to - 1])]))
                at = to

        for batch in steps(batches, "text", 1 << 20):
            words, counts = split(no_null(batch.column("text")))
            ids += batch.column("doc_id").to_pylist()
            uses += batch.column("counted").to_pylist()
            sizes += counts.tolist()
            if isinstance(words, pa.Array):
                seqs.append(words)
                held += pc.sum(pc.binary_length(words)).as_py() or 0
            else:
                seqs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                held += batch.get_total_buffer_size() if batch.num_rows == 1 else sum(map(len, words))
            if held >= block_bytes:
                yield from flush()
                block += 1
                numbers, ids, sizes, seqs, uses, held = _Numbers(), [], [], [], [], 0
        if ids:
            yield from flush()
        numbers, ids, sizes, seqs, uses = _Numbers(), [], [], [], []
        release()

    return run


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)


class Bucket:
    """A bucket's words: the distinct ones with the sum of their counts, and each block's as places among them."""

    def __init__(self, table: pa.Table):
        numbers = _Numbers()
        self.number = table.column("bucket")[0].as_py()
        self.blocks = table.column("block").to_pylist()
        self.ranks = table.column("ranks").to_pylist()
        self.places, counts = [], []
        for words, lengths, n in zip(table.column("words").to_pylist(), table.column("lengths").to_pylist(), table.column("counts").to_pylist()):
            w = unpack_words(words, lengths)
            self.places.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
            counts.append(unpack(n, np.int64))
        self.words = list(numbers)
        self.counts = np.bincount(np.concatenate(self.places), np.concatenate(counts), len(self.words)).astype(np.int64)


def lookup(dictionaries: DataFrame, answer: Callable[[Bucket], Callable[[np.ndarray], list[bytes]]], n_values: int) -> DataFrame:
    """Rows (block, ranks, v0, v1, ...): what `answer` of a bucket packs for a block's places."""
    names = [f"v{i}" for i in range(n_values)]

    def run(group: pa.Table) -> pa.Table:
        bucket = Bucket(group)
        give = answer(bucket)
        values = [give(p) for p in bucket.places]
        release()
        return pa.table([pa.array(bucket.blocks, pa.int64()), pa.array(bucket.ranks, pa.binary()), *(pa.array([v[i] for v in values], pa.binary()) for i in range(n_values))], names=["block", "ranks", *names])

    rows = dictionaries.select("block", "bucket", "words", "lengths", "ranks", "counts")
    return rows.groupBy("bucket").applyInArrow(run, "block long, ranks binary, " + ", ".join(f"{n} binary" for n in names))


def vocabulary(dictionaries: DataFrame) -> DataFrame:
    """Rows (words, lengths, counts) by bucket: each distinct word of the corpus once."""

    def run(group: pa.Table) -> pa.Table:
        bucket = Bucket(group)
        data, lengths = pack_words(bucket.words)
        return pa.table([[data], [lengths], [pack(bucket.counts)]], schema=pa.schema([("words", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())]))

    rows = dictionaries.select("block", "bucket", "words", "lengths", "ranks", "counts")
    return rows.groupBy("bucket").applyInArrow(run, "words binary, lengths binary, counts binary")


def assemble(texts: DataFrame, answers: DataFrame, each: Callable[[list, int], Callable[[list, np.ndarray, np.ndarray, list], pa.Table]], schema: str, empty: pa.Schema) -> DataFrame:
    """Joins a block's answers to its documents.

    `each` gets the rows of answers with their ranks and the number of words of the block; what it
    returns is called for every packed row with ids, sizes, word numbers and which texts are counted.
    """

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty.empty_table()
        ranks = [np.cumsum(unpack(r, np.int32)) for r in found.column("ranks").to_pylist()]
        release()
        make = each([ranks, found], sum(map(len, ranks)))
        return pa.concat_tables([make(i, np.array(s, np.int64), unpack(q, np.int32), u) for i, s, q, u in zip(*(docs.column(c).to_pylist() for c in ("ids", "sizes", "seq", "counted")))])

    rows = texts.select("block", "ids", "sizes", "seq", "counted")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
