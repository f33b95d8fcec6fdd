"""Toxicity by a bidirectional gated recurrent network with attention pooling over windows of tokens.

A token's input is a vector of its word (lower case, without what surrounds its letters and digits; the words whose
document counts differ most between the labels have one) and the mean of vectors of its byte trigrams. A window
of `WINDOW` tokens is read in both directions; a weighted mean of the states, by attention, gives its logit. Windows
overlap by half, every one of a text is scored, and the text's logit is the largest. A logistic fit makes it a probability.

Training takes at most `SAMPLE` labelled rows of each label, those with the least hash of their id: word
counts and windows come from Spark, at most `CANDIDATES` windows a text; the network is trained on them
in numpy on the driver. The most suspicious window stands for a toxic text; which it is, the network says anew before each
round. A window of more than `WINDOW_BYTES` bytes doesn't train, but it is scored.

Scoring is a map without a shuffle. Projections of inputs are made once for each distinct token of a step.

Edge cases: a null or empty text, or one of blanks, is one window without tokens and has the score of that. Null labels
don't train; of several labels of an id the largest counts. Without rows of both labels every score is the
share of toxic ones, or 0. Rows with equal texts have equal scores. An empty table gives no rows. Columns other than
id, text and label aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import id_crc, small_batches, steps, written

#: Tokens of a window and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Labelled rows of each label that train, words with a vector, windows of a text that may train, their bytes at most.
SAMPLE, VOCABULARY, CANDIDATES, WINDOW_BYTES = 4096, 4096, 6, 4096
#: States of each direction, numbers of a word's and of a trigram's vector, trigram vectors.
STATES, WORD_SIZE, GRAM_SIZE, GRAMS = 8, 8, 8, 1 << 13
#: Rounds of training, passes of each, windows of a batch, rate of learning.
ROUNDS, PASSES, BATCH, RATE = 3, 2, 128, 0.01
#: A text counts as toxic from this score.
THRESHOLD = 0.3
#: Windows that are read side by side.
_AT_ONCE = 512


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word(token: str) -> str:
    """What the token has from its first letter or digit to its last."""
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def _grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all tokens, in a row, and where each token's start; a token of n bytes has n."""
    raw = [t.encode("utf-8", "surrogatepass") for t in found]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint32)
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(32 - (GRAMS.bit_length() - 1))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(size + 1) - size - 1
    inside = np.ones(len(code), bool)
    inside[(starts[1:] - 1)] = False  # those in the middle of which is a blank
    return code[inside].astype(np.int64), np.cumsum(size) - size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that have the same place of n."""
    by = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(at[by]) > 0)))
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        out[at[by][first]] = np.add.reduceat(rows[by], first)
    return out


def _weights(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)


@dataclass
class Network:
    """Parameters `p`, and the numbers of the words that have a vector; 0 stands for all others."""

    number: dict[str, int]
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    share: float | None = None
    _moments: dict = field(default_factory=dict)

    @classmethod
    def new(cls, weight: dict[str, float], seed: int = 7) -> Network:
        """A network that isn't trained; `weight` tells how a word's counts differ between the labels."""
        rng = np.random.default_rng(seed)
        x = WORD_SIZE + GRAM_SIZE
        p = {"word": 0.1 * rng.standard_normal((len(weight) + 1, WORD_SIZE)).astype(np.float32), "gram": 0.1 * rng.standard_normal((GRAMS, GRAM_SIZE)).astype(np.float32)}
        p["word"][0] = 0
        p["word"][1:, 0] = np.clip(np.fromiter(weight.values(), np.float32, len(weight)) / 4, -2, 2)
        for d in "fb":
            p |= {f"w{d}": _weights(rng, x, 3 * STATES), f"c{d}": np.zeros(3 * STATES, np.float32), f"u{d}": _weights(rng, STATES, 3 * STATES)}
        p |= {"a": _weights(rng, 2 * STATES, STATES), "ab": np.zeros(STATES, np.float32), "av": _weights(rng, STATES, 1)[:, 0], "o": _weights(rng, 2 * STATES, 1)[:, 0], "ob": np.zeros(1, np.float32)}
        return cls({w: i + 1 for i, w in enumerate(weight)}, p)

    def inputs(self, found: list[str]) -> tuple[np.ndarray, tuple]:
        """A row for each token, and what it was made of."""
        ids = np.fromiter((self.number.get(word(t), 0) for t in found), np.int64, len(found))
        if not found:
            return np.zeros((0, WORD_SIZE + GRAM_SIZE), np.float32), (ids, ids, ids)
        grams, starts = _grams(found)
        size = np.diff(np.append(starts, len(grams)))
        mean = np.add.reduceat(self.p["gram"][grams], starts) / size[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][ids], mean), 1), (ids, grams, size)

    def _projected(self, x: np.ndarray, d: str) -> np.ndarray:
        """What the gates of one direction get from each row of x; the last row, of no token, changes no state."""
        none = np.r_[np.full(STATES, 40), np.zeros(2 * STATES)].astype(np.float32)
        return np.concatenate((x @ self.p[f"w{d}"] + self.p[f"c{d}"], none[None]))

    def _read(self, pre: np.ndarray, places: np.ndarray, d: str, held: list | None = None) -> np.ndarray:
        """States (place, state, window) of one direction, of windows as columns of `places` of rows of `pre`."""
        u, s = np.ascontiguousarray(self.p[f"u{d}"].T), STATES
        h = np.zeros((s, places.shape[1]), np.float32)
        out = np.empty((len(places), *h.shape), np.float32)
        for t in range(len(places)) if d == "f" else range(len(places) - 1, -1, -1):
            g, hu = np.ascontiguousarray(pre.take(places[t], 0).T), u @ h
            if held is not None:
                held.append([t, h.copy(), hu[2 * s :].copy()])
            zr = hu[: 2 * s]
            zr += g[: 2 * s]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n = hu[2 * s :]
            n *= zr[s:]
            n += g[2 * s :]
            np.tanh(n, out=n)
            if held is not None:
                held[-1] += [zr[:s], zr[s:], n]
            h -= n
            h *= zr[:s]
            h += n
            out[t] = h
        return out

    def _pool(self, h: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of windows, what attention compares, and its shares."""
        q = np.ascontiguousarray(self.p["a"].T) @ h
        q += self.p["ab"][:, None]
        np.tanh(q, out=q)
        e = np.einsum("tsb,s->tb", q, self.p["av"])
        e[gone] = -1e9
        e = np.exp(e - e.max(0))
        e[gone] = 0
        share = e / np.maximum(e.sum(0), 1e-9)
        return (share * np.einsum("tsb,s->tb", h, self.p["o"])).sum(0) + self.p["ob"][0], q, share

    def logits(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of windows `at` of places of rows of x; len(x) is no token."""
        out, pre = np.empty(len(at), np.float32), [(d, self._projected(x, d)) for d in "fb"]
        for i in range(0, len(at), _AT_ONCE):
            w = np.ascontiguousarray(at[i : i + _AT_ONCE].T)
            h = np.concatenate([self._read(rows, w, d) for d, rows in pre], 1)
            out[i : i + _AT_ONCE] = self._pool(h, w == len(x))[0]
        return out

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the weighted log loss: by parameter, by row of x, and the loss."""
        p, s, g = self.p, STATES, {}
        w, held = np.ascontiguousarray(at.T), {"f": [], "b": []}
        h = np.concatenate([self._read(self._projected(x, d), w, d, held[d]) for d in "fb"], 1)
        logit, q, share = self._pool(h, w == len(x))
        prob = _sigmoid(logit)
        loss = -float((weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum())
        flat = lambda v: v.transpose(1, 0, 2).reshape(v.shape[1], -1)
        dl = weight * (prob - y)
        g["o"], g["ob"] = flat(h) @ (share * dl).ravel(), np.array([dl.sum()], np.float32)
        of = np.einsum("tsb,s->tb", h, p["o"]) * dl
        de = share * (of - (share * of).sum(0))
        g["av"] = flat(q) @ de.ravel()
        dq = de[:, None] * p["av"][:, None] * (1 - q * q)
        g["a"], g["ab"] = flat(h) @ flat(dq).T, dq.sum((0, 2))
        dh = (share * dl)[:, None] * p["o"][:, None] + p["a"] @ dq
        dx = np.zeros_like(x)
        for d, part in (("f", dh[:, :s]), ("b", dh[:, s:])):
            u, gu = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            grad = np.zeros((len(w), len(at), 3 * s), np.float32)
            back = np.zeros((s, len(at)), np.float32)
            for t, h0, hn, z, r, n in reversed(held[d]):
                back = back + part[t]
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (h0 - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                du = np.concatenate((dz, dr, dn * r))
                gu += h0 @ du.T
                grad[t] = np.concatenate((dz, dr, dn)).T
                back = back * z + u @ du
            pre = _sums(grad.reshape(-1, 3 * s), w.ravel(), len(x) + 1)[:-1]
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = gu, x.T @ pre, pre.sum(0)
            dx += pre @ p[f"w{d}"].T
        return g, dx, loss

    def learn(self, found: list[str], at: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step of Adam on the windows `at` of the tokens `found`."""
        x, (ids, grams, size) = self.inputs(found)
        g, dx, loss = self.gradients(x, at, y, weight)
        g["word"] = _sums(dx[:, :WORD_SIZE], ids, len(self.p["word"]))
        g["word"][0] = 0
        g["gram"] = _sums(np.repeat(dx[:, WORD_SIZE:] / np.maximum(size, 1)[:, None], size, 0), grams, GRAMS)
        t = self._moments["t"] = self._moments.get("t", 0) + 1
        for k, v in g.items():
            m, q = self._moments.get(k) or (np.zeros_like(v), np.zeros_like(v))
            m, q = 0.9 * m + 0.1 * v, 0.999 * q + 0.001 * v * v
            self._moments[k] = (m, q)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return loss

    def probability(self, logit: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(logit), self.share)
        return _sigmoid(self.slope * logit.astype(np.float64) + self.shift)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of so many tokens, laid end to end: each window's first token's place, and its text."""
    n = np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1
    of = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(sizes) - sizes)[of] + nth * STRIDE, of


class _Numbers(dict):
    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        return i


def windows(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of all texts, all their windows as places among these (their number: no token), and each window's text."""
    number, ids, sizes = _Numbers(), [], []
    for text in texts:
        found = tokens(text)
        sizes.append(len(found))
        ids.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
    size = np.array(sizes, np.int64)
    first, of = places(size)
    ends = np.cumsum(size)[of]
    every = np.concatenate([*ids, np.full(1, len(number), np.int32)])
    at = first[:, None] + np.arange(WINDOW)
    return list(number), every[np.where(at < ends[:, None], at, len(every) - 1)], of


def text_logits(net: Network, texts: list[str | None]) -> np.ndarray:
    """The largest logit of each text's windows."""
    found, at, of = windows(texts)
    x, _ = net.inputs(found)
    logit = net.logits(x, at)
    return np.maximum.reduceat(logit, np.searchsorted(of, np.arange(len(texts)))) if len(texts) else logit


def fit(rows: list[tuple[float, list[list[str]]]], weight: dict[str, float]) -> Network:
    """A network trained on texts, each a label and its windows' tokens; round by round, the window with the largest logit stands for a toxic text."""
    net = Network.new(weight)
    label = np.array([y for y, _ in rows], np.float32)
    number, at, of = _Numbers(), [], []
    for i, (_, own) in enumerate(rows):
        for w in own:
            at.append([number[t] for t in w] + [-1] * (WINDOW - len(w)))
            of.append(i)
    found, at, of = list(number), np.array(at, np.int64).reshape(-1, WINDOW), np.array(of)
    at[at < 0] = len(found)
    rng = np.random.default_rng(3)
    scale = {y: len(label) / (2 * max(1, int((label == y).sum()))) for y in (0.0, 1.0)}
    for turn in range(ROUNDS):
        score = net.logits(net.inputs(found)[0], at) if turn else -np.arange(len(at))  # at first the windows are in order of suspicion
        best = np.zeros(len(at), bool)
        by = np.lexsort((-score, of))
        best[by[np.concatenate(([True], of[by][1:] != of[by][:-1]))]] = True
        use = np.flatnonzero(best | (label[of] == 0))
        for _ in range(PASSES):
            rng.shuffle(use)
            for i in range(0, len(use), BATCH):
                part = use[i : i + BATCH]
                here, w = np.unique(at[part], return_inverse=True)
                w = w.reshape(-1, WINDOW)
                seen = [found[j] for j in here if j < len(found)]
                y = label[of[part]]
                share = np.where(best[part], 1.0, 0.25).astype(np.float32)
                net.learn(seen, w, y, share * np.where(y > 0, scale[1.0], scale[0.0]).astype(np.float32) / len(part), RATE / (1 + turn))
    return net


def calibrate(net: Network, logit: np.ndarray, label: np.ndarray) -> None:
    """Logistic fit of labels to texts' logits by Newton's method."""
    a, b = 1.0, 0.0
    x = np.stack((logit, np.ones(len(logit))), 1).astype(np.float64)
    for _ in range(50):
        p = _sigmoid(x @ (a, b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (label - p) - 1e-3 * np.array((a - 1, b)))
        size = float(np.abs(step).max())
        a, b = np.array((a, b)) + step * min(1, 2 / max(size, 1e-9))
        if size < 1e-6:
            break
    net.slope, net.shift = max(float(a), 1e-3), float(b)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y): at most `SAMPLE` rows of each label, one an id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    some = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return written(some.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")


def _word_weights(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """The words whose document counts differ most between the labels: signed root of the likelihood ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            counts = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                counts[y].update({word(t) for t in tokens(text)})
            every = [w for w in counts[0].keys() | counts[1].keys() if w]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)], names=["word", "clean", "toxic"])

    counted = rows.select("text", "y").mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    c, t, share = F.col("c").cast("double"), F.col("t").cast("double"), toxic / (toxic + clean)
    ratio = 2 * (term(t, (c + t) * share) + term(c, (c + t) * (1 - share)))
    sign = F.when(t > (c + t) * share, 1.0).otherwise(-1.0)
    top = counted.withColumn("g", sign * F.sqrt(F.greatest(ratio, F.lit(0.0)))).orderBy(F.desc(F.abs("g")), "word").limit(VOCABULARY).collect()
    return {r.word: r.g for r in top}


def _candidates(rows: DataFrame, weight: dict[str, float]) -> list[tuple[float, list[list[str]]]]:
    """Label and windows of each text: those with most suspicious words first, then some from all over the text."""
    model = rows.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                g = np.fromiter((max(0.0, model.value.get(word(t), 0.0)) for t in found), np.float64, len(found))
                first, _ = places(np.array([len(found)]))
                run_sum = np.concatenate(([0.0], np.cumsum(g)))
                heat = run_sum[np.minimum(first + WINDOW, len(found))] - run_sum[first]
                order = np.argsort(-heat, kind="stable")
                spread = order[np.argsort((order * 2654435761) % (1 << 32), kind="stable")]
                some = dict.fromkeys([*order[: CANDIDATES // 2].tolist(), *spread[: CANDIDATES - CANDIDATES // 2].tolist()])
                own = [" ".join(found[first[i] : first[i] + WINDOW]) for i in some]
                out.append([w for w in own if len(w) <= WINDOW_BYTES])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "y", "w"])

    got = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text").mapInArrow(run, "doc_id string, y int, w array<string>").orderBy("doc_id").collect()
    return [(float(r.y), [w.split() for w in r.w]) for r in got if r.w]


def logits(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The columns of `docs` other than the text, and `logit` of the text."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)
    keep = [f for f in docs.schema if f.name not in (text, "logit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            got = text_logits(model.value, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(got, pa.float64())], names=[*(f.name for f in keep), "logit"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "logit double"]))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """A network trained on `labels` (doc_id, toxic) of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels)
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        net = Network.new({})
        net.share = float(max(n, default=0))
        return net
    weight = _word_weights(rows, n[1], n[0])
    net = fit(_candidates(rows, weight), weight)
    net._moments = {}
    seen = logits(rows.select("y", "text"), net).orderBy("logit", "y").collect()
    calibrate(net, np.array([r.logit for r in seen]), np.array([r.y for r in seen], np.float64))
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, and what else `docs` has but the text): the probability that a text is toxic."""
    rest = [c for c in docs.columns if c not in ("text", "logit")]
    p = F.lit(net.share).cast("double") if net.share is not None else 1 / (1 + F.exp(-(F.lit(net.slope) * F.col("logit") + F.lit(net.shift))))
    return logits(docs, net).select(*rest, p.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op13: learns from the labels of rows that aren't held out, scores all."""
    net = train(docs, labels.where(id_crc() % 4 != 2))
    rows = docs.select("doc_id", "text", (id_crc() % 4 == 2).alias("held_out"))
    return scored(rows, net).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
