"""Language identification by rank-order profiles.

Each language's profile is the list of its most frequent letter n-grams (1 to 3 letters of a
word, word ends as a blank) in training texts. A document's own list is compared with every
profile by out-of-place distance: the sum over its n-grams of how far apart the two ranks are,
`PROFILE` for those the language's list lacks. The least distance wins; equal distances go to
the smaller language name.

Training is one distributed count over all labelled training texts; only the finished profiles
(languages x PROFILE rows of 12 bytes) reach the driver and the tasks. Prediction is a map without a shuffle.

Edge cases: null text or text without a letter gives `und` with score 0; without any labelled
training text every prediction is `und`. Rows with a null language don't train.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from clausewise.llm.common import id_crc, small_batches, steps

#: n-grams of a profile.
PROFILE = 300
UNDETERMINED = "und"
_CHUNK = 1 << 20  # letters that are sorted at once
_FLUSH = 2_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(cp: np.ndarray) -> np.ndarray:
    """1-, 2- and 3-grams of letters as numbers (21 bits a letter); 0 stands for a word's end."""
    cp = np.where(_letters()[cp], cp, 0).astype(np.int64)
    cp = np.concatenate(([0], cp, [0]))
    cp = cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]
    one = cp[cp != 0]
    two = cp[:-1] | cp[1:] << 21
    three = (cp[:-2] | cp[1:-1] << 21 | cp[2:] << 42)[cp[1:-1] != 0] if len(cp) > 2 else cp[:0]
    return np.concatenate((one, two, three)) if len(one) else one


def _count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; long texts in pieces that end between words."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, at = [], 0
    while at < len(cp):
        to = min(len(cp), at + _CHUNK)
        if to < len(cp):
            blank = np.flatnonzero(~_letters()[cp[to : to + _CHUNK]])
            to += int(blank[0]) if len(blank) else min(_CHUNK, len(cp) - to)
        codes = _codes(cp[at:to])
        if len(codes):
            parts.append(_count(codes))
        at = to
    return _merge(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def top(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent, equal counts by number."""
    return grams[np.argsort(-counts, kind="stable")[:k]]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", k: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from all rows with text and language."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for name, parts in held.items():
                g, c = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(c)], names=["lang", "gram", "n"])

        for batch in steps(batches, "t"):
            by: dict[str, list[str]] = {}
            for t, name in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                part = ngrams(" ".join(texts))
                size += len(part[0])
                held.setdefault(name, []).append(part)
                if len(held[name]) >= 16:
                    held[name] = [_merge(held[name])]
            if size > _FLUSH * 8:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank - 1).where(F.col("rank") < k).select("lang", "gram", "rank").toPandas()
    return {name: g.sort_values("rank").gram.to_numpy(np.int64) for name, g in best.groupby("lang")}


class Profiles:
    """The languages and ranks of every profiled n-gram, for lookups of many n-grams at once; 12 bytes for each of a profile's n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], k: int = PROFILE):
        self.k, self.names = k, sorted(profiles)
        size = [len(profiles[n]) for n in self.names]
        grams = np.concatenate([profiles[n] for n in self.names]) if self.names else np.zeros(0, np.int64)
        by = np.argsort(grams, kind="stable")
        self.grams, start, count = np.unique(grams[by], return_index=True, return_counts=True)
        self.start, self.count = np.append(start, len(by)), np.append(count, 0)  # the last is of what no profile has
        self.lang = np.repeat(np.arange(len(size), dtype=np.int32), size)[by]
        self.rank = np.concatenate([np.arange(n, dtype=np.int32) for n in size])[by] if size else np.zeros(0, np.int32)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.names:
            return UNDETERMINED, 0.0
        mine = top(grams, counts, self.k)
        at = np.searchsorted(self.grams, mine)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        n = self.count[at]
        own = np.repeat(np.arange(len(mine)), n)
        found = np.arange(len(own)) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        nearer = self.k - np.abs(self.rank[found] - own)  # than an n-gram that the profile lacks
        far = self.k * len(mine) - np.bincount(self.lang[found], nearer, len(self.names))
        j = int(far.argmin())
        return self.names[j], 1.0 - float(far[j]) / (self.k * len(mine))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", k: int = PROFILE) -> DataFrame:
    """Adds `lang_pred` and `score` (1: same ranks as the profile, 0: nothing shared); columns of these names are replaced."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, k))
    keep = [f for f in docs.schema if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in steps(batches, text):
            got = [m.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*(f.name for f in keep), "lang_pred", "score"],
            )

    return docs.mapInArrow(run, StructType([*keep, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", id_crc() % 3 == 1)


def language_of(docs: DataFrame) -> DataFrame:
    """Contract of op1: learns from the documents that aren't held out, predicts all."""
    rows = held_out(docs.select("doc_id", "text", "lang"))
    profiles = train(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def accuracy(df: DataFrame) -> pd.DataFrame:
    """Share of right predictions by held_out of a frame with lang, lang_pred, held_out."""
    return df.where("lang is not null").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).toPandas()
