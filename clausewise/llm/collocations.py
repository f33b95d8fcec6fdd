"""Collocations of two to four words by mergeable Misra-Gries summaries.

A phrase counts where its words follow each other in a piece (a text without `.,;:!?` and line ends). Every
pass reads all texts:

1. Words are counted exactly.
2. N-grams as 64-bit hashes of language and words are counted by each task and go, by the leading bits of the
   hash, to hash partitions, with the next 32 bits (n-grams that agree in these count together, so none gets lost). There summaries are merged: a summary that holds more counters than its
   capacity, `SLACK` times mass over threshold, takes the next largest counter's value off all counters. The
   values taken off add up to `lost`, which stays below the threshold (the capacity gives way otherwise), so an n-gram as
   frequent as the threshold always survives. Survivors, those whose counter plus `lost` reaches the
   threshold, become a bitmap: one bit for each value of the hash's leading bits. Pairs come first, then
   phrases of three and four words of which all pairs survived.
3. What the bitmaps let through is counted exactly, by its words.

Bitmaps have at most 2^`BITS` bits whatever the corpus; where more survive they let more through, and results
stay the same. A frequent n-gram reaches a partition as one counter from each task that saw it. Hash
partitions are as many as the mass needs for `PART` n-grams each, so none grows with the corpus.

Scores come from the exact counts by joins; the longest list per language is taken in two steps, first among
phrases of one salt.

Edge cases: a null language counts as `und`, a null or empty text has no pieces; repeated rows count each;
other columns aren't read; an empty table gives no rows. Ties are ordered by count and phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import small_batches, steps, written

#: Least count of a candidate, longest phrase, percent of a phrase's count from which a longer candidate replaces it.
LEAST, LONGEST, COVERED = 30, 4, 80
#: Rows per language.
FIRST = 2000
#: Times mass over threshold that a summary holds before it gives up counters, and counters it may hold in any case.
SLACK, SMALL = 4, 1 << 16
#: n-grams that a hash partition gets on average at most; bits of a bitmap, as a power of two, at most.
PART, BITS = 1 << 22, 28
#: Text bytes counted at once, n-grams that a task gathers before it sends them on, words that it remembers.
STEP, GATHERED, REMEMBERED = 8 << 20, 1 << 22, 1 << 20
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 1 << 17
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Of each language of a step: its name, the words of all its texts, and the number of the piece that each word is in."""
    for batch in steps(batches, "text", STEP):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        for lang in list(by):
            data = "\n".join(by.pop(lang)).encode().lower().translate(_ENDS)
            raw = np.frombuffer(data, np.uint8)
            blank = (raw == 32) | (raw == 10)
            starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
            if len(starts):
                yield lang, data.split(), np.cumsum(raw == 10, dtype=np.int32)[starts]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _grams(lang: str, h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word, whether or not they stay in a piece."""
    x = np.full(max(len(h) - n + 1, 0), xxhash.xxh3_64_intdigest(lang.encode(), n), np.uint64)
    for j in range(n):
        x = _mixed(x * _MIX + h[j : j + len(x)])
    return x


class Bitmap:
    """The leading bits of hashes, as a set."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits), data

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _wanted(lang: str, h: np.ndarray, piece: np.ndarray, n: int, words: Bitmap, pairs: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams begin that may be frequent, and their hashes; longer ones need all their pairs."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if pairs is None:
        ok = words.has(_grams(lang, h, 1))
    else:
        ok = _paired(lang, h, piece, pairs)
    m = len(h) - n + 1
    of = n if pairs is None else n - 1
    fine = piece[:m] == piece[n - 1 :]
    for j in range(of):
        fine &= ok[j : j + m]
    at = np.flatnonzero(fine)
    return at, _grams(lang, h, n)[at]


def _paired(lang: str, h: np.ndarray, piece: np.ndarray, pairs: Bitmap) -> np.ndarray:
    return pairs.has(_grams(lang, h, 2)) & (piece[:-1] == piece[1:])


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(grams, kind="stable")
    grams, counts = grams[by], counts[by]
    at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[at], np.add.reduceat(counts, at) if len(at) else counts


class Summary:
    """A Misra-Gries summary: counters that are too low by at most `lost`."""

    def __init__(self, least: int, small: int = SMALL):
        self.least, self.small = least, small
        self.grams, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.mass = self.lost = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.mass += int(counts.sum())
        self.grams, self.counts = _merged(np.concatenate((self.grams, grams)), np.concatenate((self.counts, counts)))
        capacity = max(self.small, SLACK * self.mass // self.least + 1)
        if len(self.counts) > capacity:
            off = int(np.partition(self.counts, len(self.counts) - capacity - 1)[len(self.counts) - capacity - 1])
            off = min(off, self.least - 1 - self.lost)  # else a frequent n-gram could get lost
            if off > 0:
                self.lost += off
                keep = self.counts > off
                self.grams, self.counts = self.grams[keep], self.counts[keep] - off

    def survivors(self) -> np.ndarray:
        return self.grams[self.counts + self.lost >= self.least]


def _power(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def _collected(rows: DataFrame, bits: int) -> Bitmap:
    """The bitmap of rows (part, bits) that have a part each, of equal lengths; 2^bits / 8 bytes in all."""
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for part, data in rows.collect():
        whole[part * len(data) : (part + 1) * len(data)] = np.frombuffer(data, np.uint8)
    return Bitmap(bits, whole)


def _bits(survivors: np.ndarray, bits: int, part_bits: int) -> bytes:
    """The bits of one part, of the 32 bits of hashes after its own `part_bits`."""
    at = survivors >> np.uint32(32 - (bits - part_bits))
    out = np.zeros(1 << (bits - part_bits - 3), np.uint8)
    np.bitwise_or.at(out, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
    return out.tobytes()


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need."""
    most = int(counts.max())
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.int64).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.int64}[len(data) // n]).astype(np.int64)


def _survivors(texts: DataFrame, lengths: tuple[int, ...], mass: int, words: Bitmap, pairs: Bitmap | None, least: int) -> Bitmap:
    """Bitmap of the n-grams of `lengths` that may occur `least` times; `mass` n-grams there are at most."""
    spark = texts.sparkSession
    part_bits = max(_power(mass / PART), _power(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bits = max(part_bits + 3, min(BITS, max(20, _power(16 * mass / least))))
    model = spark.sparkContext.broadcast((words, pairs))
    small = SMALL

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = _Hashes(), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            grams, counts = _merged(*(np.concatenate(x) for x in zip(*held)))
            edge = np.searchsorted(grams, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)).tolist() + [len(grams)]
            grams = (grams << np.uint64(part_bits) >> np.uint64(32)).astype(np.uint32)
            rows = [(p, grams[a:b].tobytes(), _narrow(counts[a:b])) for p, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 256]), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "grams", "counts"])

        for lang, found, piece in _by_language(batches):
            h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
            for k in lengths:
                grams = _wanted(lang, h, piece, k, *model.value)[1]
                held.append(_merged(grams, np.ones(len(grams), np.int64)))
                n += len(held[-1][0])
            if n > GATHERED:
                yield from sent()
                held, n = [], 0
        if n:
            yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, summary = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_bits(summary.survivors(), bits, part_bits)], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "grams", "counts"))):
                if part != at:
                    if summary is not None:
                        yield done()
                    at, summary = part, Summary(least, small)
                grams = np.frombuffer(grams, np.uint32)
                summary.add(grams, _wide(counts, len(grams)))
        if summary is not None:
            yield done()

    sent = texts.mapInArrow(count, "part int, grams binary, counts binary")
    merged = sent.repartitionById(1 << part_bits, F.col("part")).sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")
    return _collected(written(merged, "bitmap"), bits)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found, _ in _by_language(batches):
            counts = pa.array(found, pa.binary()).value_counts()
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), counts.field("values").cast(pa.string()), counts.field("counts")], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _frequent_words(words: DataFrame, n: int, least: int) -> Bitmap:
    """Bitmap of the words that occur `least` times; n words there are in all."""
    bits = min(BITS, max(20, _power(16 * n / least)))
    part_bits = 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[int]] = {}
        for batch in batches:
            for lang, word in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                h = int(_grams(lang, np.array([xxhash.xxh3_64_intdigest(word.encode())], np.uint64), 1)[0])
                of.setdefault(h >> (64 - part_bits), []).append(h >> (64 - bits))
            if sum(map(len, of.values())) > GATHERED:
                yield from sent(of)
                of = {}
        yield from sent(of)

    def sent(of: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        for part, at in of.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.unique(np.array(at, np.uint64)).tobytes()], pa.binary())], names=["part", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist()):
                at = np.frombuffer(data, np.uint64) & np.uint64((1 << (bits - part_bits)) - 1)
                out = of.setdefault(part, np.zeros(1 << (bits - part_bits - 3), np.uint8))
                np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for part, out in of.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "bits"])

    found = words.where(F.col("n") >= least).mapInArrow(run, "part int, at binary")
    return _collected(found.repartitionById(1 << part_bits, F.col("part")).mapInArrow(merge, "part int, bits binary"), bits)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def _exact(texts: DataFrame, words: Bitmap, pairs: Bitmap, longer: Bitmap, least: int) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of two words and more that occur `least` times."""
    model = texts.sparkSession.sparkContext.broadcast((words, pairs, longer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, longer = model.value
        hashes = _Hashes()
        for lang, found, piece in _by_language(batches):
            h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
            number = _Numbers()
            ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
            names = [*number]
            at, grams = _wanted(lang, h, piece, 2, words, None)
            at = at[pairs.has(grams)]
            two, where, n = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True, return_counts=True)
            pair = np.full(len(ids), -1)
            pair[at] = where
            phrases = [names[a] + b" " + names[b] for a, b in zip((two >> 32).tolist(), (two & 0xFFFFFFFF).tolist())]
            out = [(phrases, n, 2)]
            for k in range(3, LONGEST + 1):
                at, grams = _wanted(lang, h, piece, k, words, pairs)
                at = at[longer.has(grams)]
                at = at[(pair[at] >= 0) & (pair[at + k - 2] >= 0)]
                code, n = np.unique(pair[at] << 32 | (ids[at + 2] if k == 3 else pair[at + 2]), return_counts=True)
                last = names if k == 3 else phrases
                out.append(([phrases[a] + b" " + last[b] for a, b in zip((code >> 32).tolist(), (code & 0xFFFFFFFF).tolist())], n, k))
            for phrase, n, k in out:
                for a in range(0, len(phrase), 1 << 16):
                    m = len(n[a : a + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(phrase[a : a + m], pa.binary()).cast(pa.string()), pa.array([k] * m, pa.int32()), pa.array(n[a : a + m], pa.int64())], names=["lang", "phrase", "size", "n"])

    counted = texts.mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Exact counts of `docs` (text, lang): of all words (lang, phrase, n), and of phrases that occur `least` times (lang, phrase, size, n)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = written(_word_counts(texts), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    single = _frequent_words(words, total, least)
    pairs = _survivors(texts, (2,), total, single, None, least)
    longer = _survivors(texts, tuple(range(3, LONGEST + 1)), (LONGEST - 2) * total, single, pairs, least)
    return words, written(_exact(texts, single, pairs, longer, least), "phrases")


def scored(words: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase: of the cut with the lowest score, the first of equal ones."""
    parts = written(words.where(F.col("n") >= LEAST).select("lang", "phrase", "n").unionByName(found.where(F.col("size") < LONGEST).select("lang", "phrase", "n")), "parts")
    small = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    split = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), split.alias("w"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    left = small.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = small.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # products of counts may pass 64 bits
    exact = F.expr("cast(cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) as decimal(28,0)) div cast(cast(l as decimal(19,0)) + cast(r as decimal(19,0)) as decimal(20,0))")
    best = both.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "size", "a", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "x.size", "x.a", "x.l", "x.r", "x.score")


def uncovered(found: DataFrame) -> DataFrame:
    """The (lang, phrase) of candidates that no longer candidate with `COVERED` percent of their count has in it."""
    spans = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(m).alias("size")) for m in range(2, LONGEST) for i in range(1, LONGEST - m + 2)])
    inner = found.where("size > 2").select("lang", "n", "size", F.split("phrase", " ").alias("w"), F.explode(spans).alias("s")).where("s.size < size and s.at + s.size <= size + 1")
    longest = inner.groupBy("lang", F.array_join(F.slice("w", F.col("s.at"), F.col("s.size")), " ").alias("phrase")).agg(F.max("n").alias("m"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    covered = F.lit(100).cast("decimal(3,0)") * wide("m") >= F.lit(COVERED).cast("decimal(3,0)") * wide("n")
    return found.join(longest, ["lang", "phrase"], "left").where(F.col("m").isNull() | ~covered).select("lang", "phrase")


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """Contract of op11: each language's `first` collocations (lang, rank, phrase, a, l, r, n, score)."""
    words, found = phrases(docs)
    kept = scored(words, found).join(uncovered(found), ["lang", "phrase"]).drop("size")
    kept = written(kept, "kept")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salts = max(8, kept.count() >> 16)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    among = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    top = among.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
