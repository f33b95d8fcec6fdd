"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

`encode` splits texts into pre-tokens with positions, encodes each distinct pre-token of the
corpus once, joins the ids back and reassembles every text by position (see wordblocks).
`decode` joins the ids of a column with the table of token bytes, which is as long as the
vocabulary, and strings the bytes together.

Edge cases: null texts count as empty; an empty text has no ids and decodes to no bytes; an id
outside the vocabulary makes the decoded bytes null. Rows with equal ids stay separate rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import release, small_batches
from clausewise.llm.pretokens import pretokens
from clausewise.llm.wordblocks import BLOCK_BYTES, Bucket, assemble, blocks, lookup, pack, unpack

#: ids that are decoded at once.
STEP_IDS = 1 << 20


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def library(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, ids) with the ids of every text under the ranks at `path`; `docs` as from files (see wordblocks)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _encoded(docs, path, pattern, text, block_bytes, lambda ids, lists: pa.table([ids, lists], schema=schema), "doc_id long, ids array<int>", schema)


def _encoded(docs: DataFrame, path: str, pattern: str, text: str, block_bytes: int, rows_of: Callable[[pa.Array, pa.Array], pa.Table], columns: str, empty: pa.Schema) -> DataFrame:
    """What `rows_of` makes of the texts' doc_id and lists of ids."""
    dictionaries, texts = blocks(docs.select("doc_id", F.col(text).alias("text")), lambda texts: pretokens(texts.to_pylist()), keep=False, block_bytes=block_bytes)

    def answer(bucket: Bucket):
        enc = library(path, pattern).encode_ordinary
        ids = [enc(w.decode()) for w in bucket.words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes

        def give(places: np.ndarray) -> list[bytes]:
            n = sizes[places]
            return [pack(n.astype(np.uint32)), pack(flat[spread(starts[places], n)])]

        return give

    def each(found, n_words):
        ranks, rows = found
        sizes = np.zeros(n_words, np.int64)
        parts = [(r, unpack(n, np.uint32).astype(np.int64), unpack(v, np.uint32)) for r, n, v in zip(ranks, rows.column("v0").to_pylist(), rows.column("v1").to_pylist())]
        for r, n, _ in parts:
            sizes[r] = n
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        for r, n, v in parts:
            flat[spread(starts[r], n)] = v

        def make(ids: list, counts: np.ndarray, seq: np.ndarray, _: list) -> pa.Table:
            n = sizes[seq]
            out = flat[spread(starts[seq], n)].astype(np.int32)
            total = np.concatenate(([0], np.cumsum(n)))
            ends = np.concatenate(([0], np.cumsum(counts)))
            lists = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(out))
            return rows_of(pa.array(ids, pa.int64()), lists)

        return make

    return assemble(texts, lookup(dictionaries, answer, 2), each, columns, empty)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at `starts`, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class TokenBytes:
    """The table of token bytes as one array, for lookups of many ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values(), default=-1) + 1
        self.sizes = np.full(self.n, -1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        self.data = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes | None:
        out = []
        for at in range(0, len(ids), STEP_IDS):
            part = ids[at : at + STEP_IDS].astype(np.int64)
            if part.min() < 0 or part.max() >= self.n or (self.sizes[part] < 0).any():
                return None
            out.append(self.data[spread(self.starts[part], self.sizes[part])].tobytes())
        return b"".join(out)


@cache
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(ranks_of(path))


def _each_list(col: pa.Array) -> Iterator[np.ndarray | None]:
    values, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        yield values[a:b] if col[i].is_valid else None


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replaces the column of ids by the bytes they stand for."""
    small_batches(df.sparkSession)
    keep = [f for f in df.schema if f.name not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_bytes(path)
        for batch in batches:
            got = [None if x is None else t.decode(x) for x in _each_list(batch.column(ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(got, pa.binary())], names=[*(f.name for f in keep), out])
        release()

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out}` binary")


def round_trip(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replaces the ids by their number and hash (little-endian unsigned 32-bit integers) and the hash of the bytes they decode to."""
    small_batches(df.sparkSession)
    keep = [f for f in df.schema if f.name not in (ids, *_DIGEST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_bytes(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *_digests(batch.column(ids), t)], names=[*(f.name for f in keep), *_DIGEST])
        release()

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string"]))


_DIGEST = ("n_tokens", "ids_sha256", "decoded_sha256")


def _digests(lists: pa.Array, t: TokenBytes) -> list[pa.Array]:
    """The columns of `_DIGEST` of lists of ids."""
    rows = []
    for x in _each_list(lists):
        data = None if x is None else t.decode(x)
        rows.append((None, None, None) if x is None else (len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), None if data is None else hashlib.sha256(data).hexdigest()))
    cols = list(zip(*rows)) or [(), (), ()]
    return [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contract of op3: `round_trip` of `encode`, in one function.

    One after the other, each task would hold two Python workers, which stay with the executor for all later stages.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    digested = lambda ids, lists: pa.table([ids, *_digests(lists, token_bytes(path))], schema=schema)
    return _encoded(docs, path, pattern, text, block_bytes, digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)
