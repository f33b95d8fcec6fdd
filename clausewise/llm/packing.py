"""Token ids packed into fixed-length rows: best-fit-decreasing, without loss.

Documents are encoded (distinct pre-tokens of an Arrow step once), split into pieces of at most
`LENGTH` tokens, and the pieces of a window are packed longest first into the open row with the
least room that still fits, found in a segment tree over the capacities. A window is a bounded number
of tokens of a partition, so packing needs no shuffle and bounded memory, and only the last rows of
a window stay short. Each row has its ids as a padded matrix row, the segments' cumulative
lengths, position ids that start again with each segment, and which document and offset each
segment is from, so every document can be put together again.

Edge cases: null and empty texts have no tokens and are in no row; a text longer than a row is split
into pieces whose offsets follow each other; repeated rows are packed each; a null doc_id stays null. An
empty table gives no rows. Other columns are left out. ids have 16 bits if all of the vocabulary and the padding fit, else 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.byte_bpe import library, ranks_of, spread
from clausewise.llm.common import no_null, small_batches, steps
from clausewise.llm.pretokens import pretokens

#: Tokens of a row, tokens of a packing window, and the id that pads (none of the vocabulary's).
LENGTH, WINDOW, PAD = 2048, 1 << 21, 50256
_REMEMBERED = 1 << 18


class Capacities:
    """A segment tree: for each room from 0 to n, how many open rows have it; finds the least room of at least k."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.has = np.zeros(2 * self.leaves, bool).tolist()
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i and not self.has[i]:
            self.has[i] = True
            i //= 2

    def take(self, k: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least k."""
        i = k + self.leaves
        if not self.has[i]:
            while i > 1 and (i % 2 or not self.has[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.has[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.has[i] = False
            while i > 1:
                i //= 2
                self.has[i] = self.has[2 * i] or self.has[2 * i + 1]
        return room, row


def pack(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Best-fit-decreasing: the pieces of each row."""
    tree, rows = Capacities(length), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        k = int(sizes[piece])
        found = tree.take(k)
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > k:
            tree.add(room - k, row)
    return rows


_known: dict[tuple, dict[str, list[int]]] = {}


def encode_texts(texts: list[str], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts in order, and each text's number of them; each distinct pre-token is encoded once."""
    known = _known.setdefault((path, pattern), {})
    if len(known) > _REMEMBERED:
        known.clear()
    enc = library(path, pattern).encode_ordinary
    words, counts = pretokens(texts)
    number: dict[str, int] = {}
    seq = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    ids = []
    for w in number:
        got = known.get(w)
        if got is None:
            got = enc(w)
            if len(w) <= 64:
                known[w] = got
        ids.append(got)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    n = sizes[seq]
    total = np.concatenate(([0], np.cumsum(n)))
    ends = np.cumsum(counts)
    return flat[spread(starts[seq], n)], total[ends] - total[ends - counts]


OUT = "window long, row int, input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, offsets array<long>"
_SCHEMA = pa.schema([("window", pa.int64()), ("row", pa.int32()), ("input_ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])


def id_type(path: str, pad: int = PAD) -> str:
    """The type of the packed ids of a vocabulary."""
    return "<u2" if max(pad, *ranks_of(path).values()) < 1 << 16 else "<u4"


def packed(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, window: int = WINDOW, pad: int = PAD) -> DataFrame:
    """Rows of `length` ids: little-endian unsigned `input_ids` (see id_type) and 16-bit `position_ids`, `cu_seqlens` from 0, segments' `doc_ids` and `offsets`."""
    if not 0 < length <= 1 << 16 or not 0 <= pad < 1 << 32:
        raise ValueError("rows must fit 16 bits, ids 32")
    small_batches(docs.sparkSession)
    kind = id_type(path, pad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            doc = [d for h in held for d in h[2]]
            first = np.cumsum(n) - n
            pieces = -(-n // length)
            own = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, k = first[own] + nth * length, np.minimum(length, n[own] - nth * length)
            rows = pack(k, length)
            for at in range(0, len(rows), 256):
                out: list[list] = [[] for _ in _SCHEMA]
                for j, row in enumerate(rows[at : at + 256], at):
                    sizes = k[row]
                    whole, place = np.full(length, pad, kind), np.zeros(length, "<u2")
                    total = int(sizes.sum())
                    whole[:total] = ids[spread(start[row], sizes)]
                    place[:total] = spread(np.zeros(len(row), np.int64), sizes)
                    values = (number, j, whole.tobytes(), total, [0, *np.cumsum(sizes).tolist()], place.tobytes(), [doc[own[i]] for i in row], (nth[row] * length).tolist())
                    for col, v in zip(out, values):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)

        for batch in steps(batches, "text", 1 << 20):
            ids, n = encode_texts(no_null(batch.column("text")).to_pylist(), path, pattern)
            held.append((ids, n, batch.column("doc_id").to_pylist()))
            size += len(ids)
            if size >= window:
                yield from flush()
                number, held, size = number + 1, [], 0
        if size:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def write_packed(df: DataFrame, path: str) -> None:
    """The packed rows as Parquet; the matrix of a file is its input_ids, one row after another."""
    df.write.option("compression", "zstd").parquet(path)
