"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are split at safe boundaries: where the tokenizer itself always splits before it merges
anything, so pieces encoded alone give the tokens of the whole. A special string in a text is one
token, as the library's default has it. Equal pieces of an Arrow step are encoded once, and new
ones go to the library in batches of about equal bytes; a task remembers the lengths of short
pieces up to a fixed number. A map without a shuffle: its work and memory follow the bytes of a
step, however long one text is.

Edge cases: a null or empty text has 0 tokens. Repeated rows are counted row by row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import byte_view, no_null, small_batches, steps
from clausewise.llm.pretokens import pretokens

#: Bytes of the pieces that go to the library at once.
BATCH_BYTES = 256 << 10
#: Piece lengths that a task remembers, and the longest piece that it remembers.
REMEMBERED, LONGEST = 1 << 18, 64

@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    return t, re.compile("|".join(map(re.escape, special))) if special else None


_known: dict[str, dict[str, int]] = {}


def _lengths(path: str, pieces: list[str]) -> dict[str, int]:
    """Number of tokens of each distinct piece."""
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    new = [p for p in dict.fromkeys(pieces) if p not in known]
    found = known
    batch: list[str] = []
    size = 0
    extra: dict[str, int] = {}

    def flush():
        for p, e in zip(batch, _library(path)[0].encode_batch_fast(batch, add_special_tokens=False)):
            (known if len(p) <= LONGEST else extra)[p] = len(e)

    for p in new:
        batch.append(p)
        size += len(p)
        if size >= BATCH_BYTES:
            flush()
            batch, size = [], 0
    if batch:
        flush()
    return found | extra if extra else found


def count_texts(path: str, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    special = _library(path)[1]
    out = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, t in enumerate(texts):
        if special is not None and (found := special.findall(t)):
            out[i] += len(found)
            parts += (x := special.split(t))
            owner += [i] * len(x)
        else:
            parts.append(t)
            owner.append(i)
    pieces, counts = pretokens(parts)
    lengths = _lengths(path, pieces)
    each = np.fromiter(map(lengths.__getitem__, pieces), np.int64, len(pieces))
    total = np.concatenate(([0], np.cumsum(each)))
    ends = np.cumsum(counts)
    np.add.at(out, owner, total[ends] - total[ends - counts])
    return out


def with_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `n_bytes` and `n_tokens` of each text by the byte-level BPE tokenizer at `path`."""
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name not in ("n_bytes", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            col = no_null(batch.column(text))
            n = count_texts(path, col.to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(np.diff(byte_view(col)[1])), pa.array(n)], names=[*(f.name for f in keep), "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Contract of op8."""
    return with_token_counts(docs.select("doc_id", "text"), path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
