"""Language-model scoring by a probabilistic suffix tree over tokens.

Tokens are lower-cased words and one end a text. A context is one or more tokens before a token,
of any length. The root's next-token distribution is that of all training tokens with one added
to each count and to a single unseen token; every other context of the tree mixes its counts with its suffix's
distribution (`MU` pseudo-counts). A context is in the tree if its own counts n(x), N in all, predict its
next tokens better than the longest of its suffixes in the tree does, each occurrence left out of its own
prediction:

    sum over x of n(x) * log2((n(x) - 1) / p(x) + MU) - N * log2(N - 1 + MU)  >=  price(tokens).

p is rounded to 1/64 bit in this test. A longer context costs more, so that depth grows with the logarithm of what
the corpus has to tell. A context is extended by one token while some extension could pass: while the
sum of max(0, n(x) * log2(((n(x) - 1) / p(x) + MU) / (n(x) - 1 + MU))), which no single extension can
exceed, reaches the next price. A token is predicted from the longest suffix of what precedes it that
is in the tree.

The tree is never in one place. Level by level, each block of texts (see wordblocks) sends
how often its open contexts are followed by which tokens; these are dealt over buckets by hash of the context, so
that a bucket sums whole contexts, tests them and answers the blocks that asked. A context with
more than `SPLIT` occurrences is dealt over several buckets by next token, and their sums are added
up (there are at most tokens / `SPLIT` such contexts). The first `AGAIN` levels of a block are
made again from its texts and the answers for each level; after that only the texts that still have open contexts are
written and go on. Nothing is left out for size: words, contexts, next tokens and depth grow with the corpus.
A block leaves out only what bounds on counts and probabilities show can't pass: with a context that stays open comes
a cap on -log2 of the probabilities of what follows it twice or more, and what an extension of n occurrences can gain
is at most that of n tokens of this probability. By the same bound a text keeps before an open token only what its
contexts can still reach.

Edge cases: null text counts as empty and has one token, its end. A null doc_id counts as the
empty id and trains. Without training rows every token has probability 1 and all counts are 0. Contexts are told
apart by 64-bit hashes of their tokens; those of up to `SPELT` tokens by the tokens' numbers, if these fit 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import id_crc, passing, release, written
from clausewise.llm.wordblocks import Bucket, blocks, lookup, n_buckets, pack, unpack

#: Pseudo-counts that go to the suffix.
MU = 8.0
#: Occurrences from which a context is dealt over several buckets, and levels that are made again from the texts.
SPLIT, AGAIN = 1 << 21, 3
#: Longest contexts that are sent as their tokens, in order, which takes less than their hashes.
SPELT = 3
#: Text bytes of a block, and those whose contexts one bucket sums.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
#: Parts in which the texts are dealt by block, so that only one part's shuffle files are there beside both tables.
PARTS = 4
#: Numbers of a question from which they are packed by their lengths in bits.
CODED = 512
_UNIT = 64  # rounding of log2 probabilities in the test
CAP = 4  # steps of a bit in caps on log2 probabilities; 255 caps nothing
_UNKNOWN = np.int64(1 << 62)
_M = np.uint64(0x9E3779B97F4A7C15)


def price(tokens: int) -> float:
    """Bits that a context of so many tokens must gain."""
    return 12.0 + 2.0 ** (tokens + 1)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) runs between ASCII white space, and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()[: len(texts) + 1]
    full = pc.not_equal(pc.binary_length(flat), 0)  # there is an empty one before and after white space at the ends
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), np.diff(before[ends - ends[0]])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def short(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits (63 at most) mixed one to one, at the upper end of 64 bits: in order, they differ by less than hashes do."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    x = x.astype(np.uint64)
    for _ in range(2):
        x = x * _M & mask
        x ^= x >> half
    return x << np.uint64(64 - bits)


def _bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (a, b) in their order, and the first place of each pair."""
    n, low = len(a), _bits(b)
    place = max(n - 1, 0).bit_length()
    if _bits(a) + low + place > 64:  # rare: blocks of very many words
        _, first, number = np.unique(a.astype(np.uint64) << np.uint64(low) | b.astype(np.uint64), return_index=True, return_inverse=True)
        return number, first
    z = a.astype(np.uint64) << np.uint64(low + place)
    z |= b.astype(np.uint64) << np.uint64(place)
    z |= np.arange(n, dtype=np.uint64)
    z.sort()
    at = (z & np.uint64((1 << place) - 1)).astype(np.int64)
    z >>= np.uint64(place)
    new = np.ones(n, bool)
    new[1:] = z[1:] != z[:-1]
    number = np.empty(n, np.int64)
    number[at] = np.cumsum(new) - 1
    return number, at[new]


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they fit."""
    return x.astype(np.uint32) if not len(x) or int(x.max()) < 1 << 32 else x.astype(np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    x = _small(x)
    return bytes([x.itemsize]) + pack(x)


def pack_bits(x: np.ndarray) -> bytes:
    """Numbers of very different sizes: their lengths in bits, compressed, and what follows each one's leading bit. `unpack_counts` reads it."""
    if len(x) < CODED:
        return pack_counts(x)
    x = x.astype(np.uint64)
    every = int(np.bitwise_or.reduce(x))
    low = max((every & -every).bit_length() - 1, 0)  # zeros at the end of all
    x >>= np.uint64(low)
    length = np.frexp(x.astype(np.float64))[1].astype(np.int64)
    length -= (length > 0) & (x >> np.maximum(length - 1, 0).astype(np.uint64) == 0)  # rounded up
    width = np.maximum(length - 1, 0)
    x ^= (length > 0).astype(np.uint64) << width.astype(np.uint64)
    ends = np.cumsum(width)
    word, shift = (ends - width) >> 6, (ends - width) & 63
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(x << shift.astype(np.uint64), first)
    over = np.flatnonzero(shift + width > 64)
    out[word[over] + 1] |= x[over] >> (64 - shift[over]).astype(np.uint64)
    lengths = zstandard.ZstdCompressor(level=1).compress(length.astype(np.uint8).tobytes())
    return bytes([0, low]) + len(lengths).to_bytes(4, "little") + lengths + out.astype("<u8").tobytes()[: (int(ends[-1]) + 7) >> 3]


def unpack_counts(data: bytes) -> np.ndarray:
    if data[0]:
        return unpack(data[1:], np.uint32 if data[0] == 4 else np.uint64).astype(np.int64)
    at = 6 + int.from_bytes(data[2:6], "little")
    length = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[6:at]), np.uint8).astype(np.int64)
    width = np.maximum(length - 1, 0)
    start = np.cumsum(width) - width
    words = np.frombuffer(data[at:] + bytes((at - len(data)) % 8 + 16), "<u8")
    word, shift, width = start >> 6, (start & 63).astype(np.uint64), width.astype(np.uint64)
    x = words[word] >> shift | words[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
    x = x & ((np.uint64(1) << width) - np.uint64(1)) | (length > 0).astype(np.uint64) << width
    return (x << np.uint64(data[1])).astype(np.int64)


def ascending(x: np.ndarray) -> np.ndarray:
    """Places of numbers from the least on, equal ones in their order."""
    place = max(len(x) - 1, 0).bit_length()
    if _bits(x) + place > 63:
        return np.argsort(x, kind="stable")
    z = x << place | np.arange(len(x))
    z.sort()
    return z & ((1 << place) - 1)


def pack_spelt(columns: list[np.ndarray], dealt: np.ndarray) -> bytes:
    """Contexts in order of their tokens (nearest first, each a column), and the hashes of those that are dealt by next token (0: others)."""
    out, starts = [], np.zeros(1, np.int64)
    for x in columns:
        out.append(pack_bits(differences(x, starts)))
        starts = np.union1d(starts, 1 + np.flatnonzero(np.diff(x)))
    out.append(pack(dealt) if dealt.any() else b"")
    return b"".join(len(x).to_bytes(4, "little") + x for x in out)


def unpack_spelt(data: bytes, level: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : end])
        at = end
    columns, starts = [], np.zeros(1, np.int64)
    for part in parts[:level]:
        x = unpack_counts(part)
        columns.append(summed(x, np.diff(np.append(starts, len(x)))))
        starts = np.union1d(starts, 1 + np.flatnonzero(np.diff(columns[-1])))
    return columns, unpack(parts[level], np.uint64) if parts[level] else np.zeros(len(columns[0]), np.uint64)


def told_apart(columns: list[np.ndarray], dealt: np.ndarray) -> np.ndarray:
    """Even numbers of contexts by their tokens, hashes if these don't fit 63 bits; odd ones of those that are dealt by next token."""
    out, bits = np.zeros(len(dealt), np.uint64), [_bits(x) for x in columns]
    for x, n in zip(columns, bits):
        out = out << np.uint64(n) | x.astype(np.uint64) if sum(bits) < 64 else mixed(out * _M + mixed((x.astype(np.uint64) + np.uint64(1)) * _M))
    return np.where(dealt > 0, dealt, out << np.uint64(1) if sum(bits) < 64 else out & ~np.uint64(1))


def pack_told(p: np.ndarray, symbols: np.ndarray) -> bytes:
    """Rounded probabilities (0: not told) of next tokens; many go by token, as that is what they differ by most."""
    if len(p) < CODED:
        return pack(p)
    p = p[ascending(symbols)].astype(np.int64)
    told, out = np.flatnonzero(p), np.zeros(len(p), np.int64)
    step = np.diff(p[told], prepend=0)
    out[told] = 1 + (step << 1 ^ step >> 63)
    return pack_bits(out)


def unpack_told(data: bytes, symbols: np.ndarray) -> np.ndarray:
    if len(symbols) < CODED:
        return unpack(data, np.int16)
    x = unpack_counts(data)
    told, out = np.flatnonzero(x), np.zeros(len(x), np.int16)
    step = x[told] - 1
    out[ascending(symbols)[told]] = np.cumsum(step >> 1 ^ -(step & 1))
    return out


def differences(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending runs, which begin at `starts`, as their first values and what is added to these."""
    out = np.diff(x, prepend=x[:1])
    out[starts] = x[starts]
    return out


def summed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of these sizes from their differences."""
    out, starts = np.cumsum(x), np.cumsum(sizes) - sizes
    return out - np.repeat(out[starts] - x[starts], sizes)


def best_gain(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What a context gains that is followed by one token only, n times, twice at least; p: log2 probability by its suffix."""
    return n * np.log2(((n - 1) * np.exp2(-p) + MU) / (n - 1 + MU))


def least(level: int) -> np.ndarray:
    """By cap: occurrences from which a context of `level` tokens could pass, if none that follows it twice has less than 2 ** (-cap / CAP) of probability."""
    low, high = np.full(256, 1.0), np.full(256, 2.0**40)
    p = -np.arange(256) / CAP
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        ok = best_gain(middle, p) >= price(level) - 1e-6
        low, high = np.where(ok, low, middle), np.where(ok, middle, high)
    high[255] = 2
    return high.astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def dense(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Used numbers below `size`, and a number's place among them."""
    used = np.zeros(size, bool)
    used[x] = True
    return np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - 1


def rounded(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-_UNIT * p), 32767).astype(np.int16)


class Texts:
    """The tokens of a block's texts with what is known of each: log2 probability so far, bound on the count of its context and itself, open context."""

    def __init__(self, ids: list, sizes: np.ndarray, trains: np.ndarray, tokens: np.ndarray, symbols: np.ndarray, model: Model, place: np.ndarray | None = None, total: np.ndarray | None = None):
        """`sizes` and `tokens` with the ends; `symbols` has the numbers of the tokens in the corpus. Of tokens that are only a part, `place` has the places in the texts, `total` the texts' lengths."""
        self.ids, self.sizes, self.trains, self.tokens, self.symbols, self.split, self.reach, self.bits, self.buckets = ids, sizes, trains, tokens.astype(np.int32), symbols, model.split, model.reach, model.bits, model.buckets
        ends = np.cumsum(sizes)
        self.total = sizes if total is None else total
        self.place = (np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)).astype(np.int32) if place is None else place
        self.own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.train = np.repeat(trains, sizes)
        self.hash = mixed((symbols.astype(np.uint64) + np.uint64(1)) * _M)
        self.level, self.keys, self.caps, self.sums = 0, np.zeros(1, np.uint64), np.full(1, 255, np.uint8), np.zeros(len(sizes))
        self.open, self.number = np.arange(len(tokens)), np.zeros(len(tokens), np.int32)

    @classmethod
    def start(cls, ids: list, sizes: np.ndarray, trains: np.ndarray, seq: np.ndarray, symbols: np.ndarray, counts: np.ndarray, model: Model) -> Texts:
        """Texts of words, with the words' numbers and counts in the corpus."""
        ends = np.cumsum(sizes + 1) - 1
        tokens = np.full(len(seq) + len(sizes), len(symbols), np.int64)
        word = np.ones(len(tokens), bool)
        word[ends] = False
        tokens[word] = seq
        symbols, counts = np.append(symbols, 0), np.append(counts, model.n_texts)
        order = np.argsort(symbols)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        tokens, counts = number[tokens], counts[order]
        out = cls(ids, sizes + 1, trains, tokens, symbols[order], model)
        out.bound = counts[tokens]
        out.p = np.log2(counts + 1.0)[tokens] - model.below
        out.known = np.bincount(out.own, out.bound > 0, len(sizes)).astype(np.int64)
        out.base = np.bincount(out.own, out.p, len(sizes))
        return out

    def ask(self) -> None:
        """Goes to the next level: numbers the open contexts and what follows them, but for those that can't pass."""
        self.level += 1
        d = self.level
        i, number = self.open, self.number
        ok = self.place[i] >= d
        i, number = i[ok], number[ok]
        total = self.bound[i - 1]  # of the context, at most
        most = np.minimum(total, self.bound[i])  # of the context and the token
        enough = least(d)[self.caps[number]]
        ok = total >= np.maximum(enough, 3)
        two = np.flatnonzero((total == 2) & (enough <= 2))
        ok[two] = ~self.train[i[two]] | ((most[two] == 2) & (best_gain(2, -rounded(self.p[i[two]]) / _UNIT) >= price(d)))
        self.at, total, most, number = i[ok], total[ok], most[ok], number[ok]
        before = self.tokens[self.at - d]
        if d == 1:  # a context is a token
            used, places = dense(before, len(self.symbols))
            self.number, self.last = places[before], self.symbols[used]
            self.keys = short(self.last, self.bits) if self.bits < 64 else mixed(self.hash[used] + np.uint64(d))
        else:
            self.number, first = numbered(number, before)
            if d == 2 and 2 * self.bits < 64:
                self.keys = short(self.symbols[before[first]] << self.bits | self.last[number[first]], 2 * self.bits)
            else:
                self.keys = mixed(self.keys[number[first]] * _M + self.hash[before[first]] + np.uint64(d))
        # bounds of all tokens at this level; those asked for get exact counts
        self.bound[1:] = np.where(self.place[1:] >= d, np.minimum(self.bound[1:], self.bound[:-1]), self.bound[1:])
        self.gram, self.first = numbered(self.number, self.tokens[self.at])
        context = self.number[self.first]
        self.symbol = self.tokens[self.at[self.first]]
        self.told = most[self.first] >= 2  # what may occur twice, whose probability is needed
        self.parts = 1 + total[self.first] // self.split
        key = self.keys[context]
        self.hot = self.parts > 1
        self.dealt = key & ~np.uint64(1)
        split = np.flatnonzero(self.hot)
        part = self.hash[self.symbol[split]] % self.parts[split].astype(np.uint64)
        self.dealt[split] = mixed(key[split] + part * _M) | np.uint64(1)
        # by bucket in order of their tokens, or of their hashes (of its first bits; the rest only has to be the same each time)
        place = np.uint64(max(len(key) - 1, 0).bit_length())
        z = bucket_of(self.dealt, self.buckets).astype(np.uint64) << place if d <= SPELT else self.dealt >> place << place
        z |= np.arange(len(key), dtype=np.uint64)
        z.sort()
        self.order = (z & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
        self.sorted = self.dealt[self.order]
        self.starts = np.flatnonzero(np.append(True, self.sorted[1:] != self.sorted[:-1])) if len(key) else np.zeros(0, np.int64)

    def questions(self, buckets: int) -> Iterator[tuple]:
        """(bucket, contexts, number of next tokens of each, next tokens, log2 probabilities, counts), packed, by bucket."""
        n = np.bincount(self.gram, self.train[self.at], len(self.first)).astype(np.int64)[self.order]
        p = np.where(self.told, rounded(self.p[self.at[self.first]]), 0).astype(np.int16)[self.order]
        symbol = self.symbols[self.symbol][self.order]
        steps = differences(symbol, self.starts)
        keys, sizes = self.sorted[self.starts], np.diff(np.append(self.starts, len(self.order)))
        if not len(keys):
            return
        bucket = bucket_of(keys, buckets)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys))
        ends = np.append(self.starts, len(self.order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s = slice(int(ends[a]), int(ends[b]))
            if self.level <= SPELT:
                at = self.order[self.starts[a:b]]
                spelt = pack_spelt([self.symbols[self.tokens[self.at[self.first[at]] - i]] for i in range(1, self.level + 1)], np.where(self.hot[at], keys[a:b], np.uint64(0)))
            else:
                spelt = pack_bits(np.diff(keys[a:b], prepend=np.uint64(0)))
            yield int(bucket[a]), spelt, pack_counts(sizes[a:b]), pack_bits(steps[s]), pack_told(p[s], symbol[s]), pack_counts(n[s])

    def take(self, totals: np.ndarray, caps: np.ndarray, counts: np.ndarray, hot: dict[int, tuple[float, float, float]]) -> None:
        """The answers, in order of the questions: each context's total if it is in the tree, its cap if it stays open, counts."""
        sizes = np.diff(np.append(self.starts, len(self.order)))
        total, cap, n = (np.empty(len(self.order), t) for t in (np.int64, np.uint8, np.int64))
        total[self.order], cap[self.order], n[self.order] = np.repeat(totals, sizes), np.repeat(caps, sizes), counts
        told = (cap > 0) | (total > 0)
        of = self.number[self.first]
        for c in np.unique(of[self.hot]).tolist():
            mine = np.flatnonzero((of == c) & self.hot)
            parts = mixed(self.keys[c] + np.arange(int(self.parts[mine[0]]), dtype=np.uint64) * _M) | np.uint64(1)
            sums = np.sum([hot.get(k, (0.0, 0.0, 0.0)) for k in parts.tolist()], 0)
            total[mine], stays = verdict(self.level, *sums)
            cap[mine], told[mine] = 255 * stays, True
        g = self.gram
        p = self.p[self.at]
        inside = total[g] > 0
        i = self.at[inside]
        self.p[i] = np.log2((n[g][inside] + MU * np.exp2(p[inside])) / (total[g][inside] + MU))
        exact = told[g]
        self.bound[self.at[exact]] = n[g][exact]
        go = cap[g] > 0
        self.open, self.number = self.at[go], self.number[go]
        self.caps = np.zeros(len(self.keys), np.uint8)
        self.caps[of] = cap

    def far(self, reach: int) -> np.ndarray:
        """Tokens that a longer context of each open token can have; the level, if none can pass."""
        total, cap = self.bound[self.open - 1].astype(float), self.caps[self.number]
        out = np.where(cap == 255, reach, self.level).astype(np.int32)
        left, d = np.flatnonzero((cap < 255) & (total > 1)), self.level
        while len(left) and d < reach:
            n = total[left]
            # a context in the tree leaves MU / (n + MU) of a probability at least
            p = cap[left] / -CAP - (d - self.level) * np.log2(n / MU + 1)
            d += 1
            left = left[best_gain(n, p) >= price(d) - 1e-6]
            out[left] = d
        return out

    def rest(self, model: Model) -> tuple[np.ndarray, np.ndarray, Texts | None]:
        """log2 probability of each text so far, which texts are done, and the others: their open tokens and what can be a context of these."""
        sums = self.sums + np.bincount(self.own, self.p, len(self.sizes))
        far = self.far(model.reach)
        ok = far > self.level
        self.open, self.number, far = self.open[ok], self.number[ok], far[ok]
        going = np.zeros(len(self.sizes), bool)
        going[self.own[self.open]] = True
        if not going.any():
            return sums, ~going, None
        # open tokens and those before them in the text, as far as their contexts reach
        self.place[self.open] = np.minimum(self.place[self.open], far)
        marks = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(marks, self.open - self.place[self.open], 1)
        np.add.at(marks, self.open + 1, -1)
        stay = np.cumsum(marks[:-1]) > 0
        used, places = dense(self.tokens[stay], len(self.symbols))
        sizes = np.bincount(self.own[stay], minlength=len(self.sizes))[going]
        out = Texts([x for x, g in zip(self.ids, going.tolist()) if g], sizes, self.trains[going], places[self.tokens[stay]], self.symbols[used], model, np.minimum(self.place[stay], self.reach + 1), self.total[going])
        out.level, out.known, out.base, out.sums = self.level, self.known[going], self.base[going], sums[going]
        where = np.cumsum(stay) - 1
        out.open = where[self.open]
        out.keep(self.p[self.open], self.bound[self.open], self.bound[self.open - 1])
        numbers, places = dense(self.number, len(self.keys))
        out.number, out.keys, out.caps = places[self.number], self.keys[numbers], self.caps[numbers]
        return sums, ~going, out

    def keep(self, p: np.ndarray, bound: np.ndarray, before: np.ndarray) -> None:
        """Probabilities and bounds of open tokens, and bounds of those before them; the others' are summed up or not needed."""
        self.p = np.zeros(len(self.tokens))
        self.p[self.open] = p
        self.sums[:] -= np.bincount(self.own[self.open], p, len(self.sizes))
        self.bound = np.full(len(self.tokens), _UNKNOWN)
        self.bound[self.open - 1] = before
        self.bound[self.open] = bound

    def stored(self) -> list[bytes]:
        counts = (self.sizes, self.total, self.place, self.tokens, self.symbols, np.array([self.level]), self.known, np.diff(self.open, prepend=0), self.number, self.bound[self.open], self.bound[self.open - 1])
        return [*map(pack_counts, counts), pack(self.trains.astype(np.uint8)), pack(self.base), pack(self.sums), pack(self.p[self.open]), pack(self.keys), pack(self.caps)]

    @classmethod
    def read(cls, ids: list, parts: list[bytes], model: Model) -> Texts:
        sizes, total, place, tokens, symbols, level, known, open_, number, bound, before = map(unpack_counts, parts[:11])
        base, sums, p = (unpack(x, np.float64) for x in parts[12:15])
        out = cls(ids, sizes, unpack(parts[11], np.uint8).astype(bool), tokens, symbols, model, place, total)
        out.level, out.known, out.base, out.open, out.number, out.keys, out.caps = int(level[0]), known, base, np.cumsum(open_), number, unpack(parts[15], np.uint64), unpack(parts[16], np.uint8)
        out.sums = sums + np.bincount(out.own[out.open], p, len(sizes))
        out.keep(p, bound, before)
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def verdict(level: int, total: np.ndarray, told: np.ndarray, could: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts of `level` tokens: the total of those that pass, else 0, and whether they are extended."""
    gain = told - total * np.log2(np.maximum(total, 1) - 1 + MU)
    return np.where((gain >= price(level)) & (total > 0), total, 0).astype(np.int64), could >= price(level + 1)


def capped(of: np.ndarray, n: np.ndarray, p: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Caps of contexts (`inside`: totals of those in the tree): on -log2 of the probabilities of what follows them twice or more; `of` is sorted."""
    out = np.zeros(len(inside), np.uint8)
    if len(of):
        total = inside[of]
        p = np.where(total > 0, np.log2((n + MU * np.exp2(p)) / (total + MU)), p)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        # a bit in 32 is more than all rounding
        out[of[starts]] = np.clip(np.ceil((np.maximum.reduceat(-p, starts) + 1 / 32) * CAP), 1, 255)
    return out


def judged(level: int):
    """Of a bucket's questions: answers to each block, and sums of parts of contexts that are dealt over several buckets."""

    def run(group: pa.Table) -> pa.Table:
        asked = [group.column(c).to_pylist() for c in ("block", "bucket", "a", "b", "c", "d", "e")]
        sizes = [unpack_counts(x) for x in asked[3]]
        if level <= SPELT:
            spelt = [unpack_spelt(x, level) for x in asked[2]]
            keys = told_apart([np.concatenate(x) for x in zip(*(columns for columns, _ in spelt))], np.concatenate([dealt for _, dealt in spelt]))
            keys = np.split(keys, np.cumsum([len(x) for x in sizes])[:-1])
            del spelt
        else:
            keys = [np.cumsum(unpack_counts(x).view(np.uint64), dtype=np.uint64) for x in asked[2]]
        every = distinct(np.concatenate(keys))
        own = [np.searchsorted(every, k) for k in keys]
        context = np.concatenate([np.repeat(o, s) for o, s in zip(own, sizes)])
        symbols = [summed(unpack_counts(x), s) for x, s in zip(asked[4], sizes)]
        p = np.concatenate([unpack_told(x, s) for x, s in zip(asked[5], symbols)])
        symbols = np.concatenate(symbols)
        if _bits(context) + _bits(symbols) + len(symbols).bit_length() > 64:
            symbols = np.searchsorted(distinct(symbols), symbols)
        gram, first = numbered(context, symbols)
        n = np.bincount(gram, np.concatenate([unpack_counts(x) for x in asked[6]]), len(first))
        del symbols
        p, of = -p[first] / _UNIT, context[first]
        more = np.flatnonzero(n > 1)
        told = math.log2(MU) * np.bincount(of, n == 1, len(every)) + np.bincount(of[more], n[more] * np.log2((n[more] - 1) * np.exp2(-p[more]) + MU), len(every))
        could = np.bincount(of[more], best_gain(n[more], p[more]), len(every))
        total = np.bincount(of, n, len(every))
        hot = (every & np.uint64(1)).astype(bool)
        inside, stays = verdict(level, total, told, could)
        inside[hot], stays[hot] = 0, False
        caps = np.where(stays, capped(of[more], n[more], p[more], inside), 0).astype(np.uint8)
        n = np.where((inside > 0) | stays | hot, 1, 0)[of] * n
        out: list[list] = [[], [], [], [], []]
        at = 0
        for block, bucket, o, s in zip(asked[0], asked[1], own, sizes):
            m = int(s.sum())
            for col, v in zip(out, (block, bucket, pack_counts(inside[o]), pack(caps[o]), pack_counts(n[gram[at : at + m]].astype(np.int64)))):
                col.append(v)
            at += m
        if hot.any():
            for col, v in zip(out, (None, None, pack(every[hot]), pack(np.stack([total[hot], told[hot], could[hot]]).ravel()), None)):
                col.append(v)
        release()
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _ANSWER)], schema=_ANSWER)

    return run


_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ANSWERS = "block long, bucket int, a binary, b binary, c binary"
_STEP = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary()), ("ids", pa.list_(pa.int64())), ("state", pa.list_(pa.binary())), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_STEPS = "block long, bucket int, a binary, b binary, c binary, d binary, e binary, ids array<long>, state array<binary>, doc_id long, n_tokens long, n_known long, base_score double, score double"
_DONE = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def _rows(**columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns.get(f.name, [None] * n), f.type) for f in _STEP], schema=_STEP)


def _asked(block: int, texts: Texts, buckets: int) -> pa.Table:
    rows = list(zip(*texts.questions(buckets))) or [()] * 6
    return _rows(block=[block] * len(rows[0]), **dict(zip(("bucket", "a", "b", "c", "d", "e"), rows)))


def _finished(texts: Texts, sums: np.ndarray, done: np.ndarray) -> pa.Table:
    mine = np.flatnonzero(done)
    return _rows(doc_id=[texts.ids[i] for i in mine.tolist()], n_tokens=texts.total[mine], n_known=texts.known[mine], base_score=texts.base[mine] * math.log10(2), score=sums[mine] * math.log10(2))


def _given(found: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A level's answers to a block, by bucket."""
    rows = sorted((b, a, s, c) for l, b, a, s, c in zip(*(found.column(x).to_pylist() for x in ("level", "bucket", "a", "b", "c"))) if l == level)
    parts = [(unpack_counts(a), unpack(s, np.uint8), unpack_counts(c)) for _, a, s, c in rows]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))


class Model:
    """What every task is told: sizes of the corpus, number of buckets, sums of the most frequent contexts by level."""

    def __init__(self, n_tokens: int, n_texts: int, below: float, buckets: int, split: int, bits: int):
        """The root's probabilities are (count + 1) / 2 ** below; the words' numbers have at most so many bits."""
        self.n_tokens, self.n_texts, self.below, self.buckets, self.split, self.bits, self.hot = n_tokens, n_texts, below, buckets, split, bits, {}
        # no context can be longer: a level of the tree takes `below` bits of a token's probability at most, and all tokens together must reach the price
        self.reach = next(d for d in range(1, 1000) if price(d) > (d + 1) * below * n_tokens)


def _from_texts(model: Model, level: int):
    """Asks for a level of whole blocks: makes the levels before it again. After `AGAIN` levels, texts without open contexts are done."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _STEP.empty_table()
        block = docs.column("block")[0].as_py()
        ids = [i for part in docs.column("ids").to_pylist() for i in part]
        sizes, trains = (np.array([i for part in docs.column(c).to_pylist() for i in part], t) for c, t in (("sizes", np.int64), ("counted", bool)))
        seq = np.concatenate([unpack(q, np.int32) for q in docs.column("seq").to_pylist()])
        parts = [(np.cumsum(unpack(r, np.int32)), unpack_counts(c), unpack_counts(s)) for l, r, c, s in zip(*(found.column(x).to_pylist() for x in ("level", "a", "b", "c"))) if l == 0]
        n_words = sum(len(r) for r, *_ in parts)
        counts, symbols = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        for r, c, s in parts:
            counts[r], symbols[r] = c, s
        texts = Texts.start(ids, sizes, trains, seq, symbols, counts, model)
        del seq, parts
        for before in range(1, level):
            texts.ask()
            texts.take(*_given(found, before), model.hot.get(before, {}))
        return _go_on(block, texts, model, level > AGAIN)

    return run


def _go_on(block: int, texts: Texts, model: Model, store: bool) -> pa.Table:
    out = []
    if store:
        sums, done, rest = texts.rest(model)
        out.append(_finished(texts, sums, done))
        if rest is None:
            return pa.concat_tables(out)
        out.append(_rows(block=[block], ids=[rest.ids], state=[rest.stored()]))
        texts = rest
    texts.ask()
    out.append(_asked(block, texts, model.buckets))
    release()
    return pa.concat_tables(out)


def _from_rest(model: Model, level: int):
    """Asks for a level of the texts that were left at the level before."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _STEP.empty_table()
        texts = Texts.read(docs.column("ids")[0].as_py(), docs.column("state")[0].as_py(), model)
        texts.ask()
        texts.take(*_given(found, level - 1), model.hot.get(level - 1, {}))
        return _go_on(docs.column("block")[0].as_py(), texts, model, True)

    return run


def score_all(docs: DataFrame, trains, split: int = SPLIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every text of `docs` (doc_id, text) by a tree of the rows for which `trains` holds; adds `train_tokens`."""
    # what the first levels read is dealt by block once, so that only questions and answers move, and goes after them
    with passing(docs.sparkSession) as write:
        step, answered, asked, model = _first_levels(docs, trains, split, block_bytes, write)
    done, level = step.where("n_tokens is not null").select(*_DONE), AGAIN + 1
    while (rest := step.where("state is not null").select("block", "ids", "state")).limit(1).count():
        found = answered(step, level, written)
        level += 1
        step = written(asked(rest, found, _from_rest(model, level)), "rest")
        done = done.unionByName(step.where("n_tokens is not null").select(*_DONE))
    return done.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))


def _first_levels(docs: DataFrame, trains, split: int, block_bytes: int, write) -> tuple:
    """What is left after `AGAIN` levels, as `_from_texts` gives it, the functions that answer and ask, and the model."""
    n_texts = docs.where(trains).count()
    dealt = {"by": "block", "buckets": n_buckets(docs, block_bytes)}

    def answer(bucket: Bucket):
        # frequent words have low numbers, which take fewer bits in questions
        number = np.empty(len(bucket.counts), np.int64)
        number[np.argsort(-bucket.counts, kind="stable")] = 1 + np.arange(len(number)) * stride + bucket.number
        sums = pack(np.array([bucket.counts.sum(), (bucket.counts > 0).sum(), len(bucket.counts)], np.int64))
        first = [sums]
        return lambda places: [pack_counts(bucket.counts[places]), pack_counts(number[places]), first.pop() if first else None]

    with passing(docs.sparkSession) as write_first:
        dictionaries, texts = blocks(docs, words, trains, block_bytes=block_bytes, write=write_first)
        stride = 1 + (dictionaries.agg(F.max("bucket")).first()[0] or 0)
        with passing(docs.sparkSession) as write_answers:
            answers = write_answers(lookup(dictionaries, answer, 3), "answers")
            sums = [unpack(r.v2, np.int64) for r in answers.where("v2 is not null").select("v2").collect()]  # a row a bucket
            found = write(answers.select("block", F.lit(0).alias("level"), F.lit(0).alias("bucket"), F.col("ranks").alias("a"), F.col("v0").alias("b"), F.col("v1").alias("c")), "found", **dealt)
        for part in range(PARTS):
            some = texts.where(F.pmod(F.xxhash64("block"), F.lit(PARTS)) == part).select("block", "ids", "sizes", "seq", "counted")
            dealt_texts = write(some, "texts", **dealt)
    texts = dealt_texts
    n, v = (int(sum(s[i] for s in sums)) for i in (0, 1))
    n, v = n + n_texts, v + (n_texts > 0)
    most = max((int(s[2]) for s in sums), default=0) * stride + 1
    model = Model(n, n_texts, math.log2(n + v + 1), n_buckets(docs, BUCKET_BYTES), split, most.bit_length())

    def answered(questions: DataFrame, level: int, write, **dealt) -> DataFrame:
        rows = questions.select("block", "bucket", "a", "b", "c", "d", "e").where("bucket is not null").groupBy("bucket").applyInArrow(judged(level), _ANSWERS)
        rows = rows.select("block", F.lit(level).alias("level"), "bucket", "a", "b", "c")
        if dealt:  # the questions go before the answers move
            with passing(docs.sparkSession) as write_answers:
                rows = write(write_answers(rows, "answers"), "found", **dealt)
        else:
            rows = write(rows, "found")
        hot = rows.where("block is null").where(F.col("level") == level).select("a", "b").collect()  # at most tokens / SPLIT contexts
        if hot:
            keys = np.concatenate([unpack(r.a, np.uint64) for r in hot]).tolist()
            values = np.concatenate([unpack(r.b, np.float64).reshape(3, -1) for r in hot], 1).T.tolist()
            model.hot[level] = dict(zip(keys, map(tuple, values)))
        return rows.where("block is not null")

    def asked(side: DataFrame, answers: DataFrame, run) -> DataFrame:
        return side.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _STEPS)

    for level in range(1, AGAIN + 1):
        found = answered(asked(texts, found, _from_texts(model, level)), level, write, **dealt)
    return written(asked(texts, found, _from_texts(model, AGAIN + 1)), "rest"), answered, asked, model


def scored(docs: DataFrame, **sizes: int) -> DataFrame:
    """Contract of op10: learns from the documents that aren't held out, scores all."""
    held = id_crc() % 7 == 2
    out = score_all(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ~held, **sizes)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
