"""The network against differences of its loss, its windows against all, and what it learns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from clausewise.llm import queries, toxicity


def tiny(monkeypatch=None):
    net = toxicity.Network.new({"bad": 3.0, "good": -2.0, "x": 0.5})
    found = ["bad", "good,", "other", "é!!", "x"]
    at = np.array([[0, 1, 2, 5], [3, 4, 5, 5], [2, 2, 0, 1], [5, 5, 5, 5]])
    return net, found, at


def test_gradients():
    net, found, at = tiny()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    x = net.inputs(found)[0].astype(np.float64)
    loss = lambda: net.gradients(x, at, y, weight)[2]
    g, dx, _ = net.gradients(x, at, y, weight)
    rng = np.random.default_rng(1)
    for name, values, grad in [*((k, net.p[k], v) for k, v in g.items()), ("x", x, dx)]:
        for i in rng.choice(values.size, min(6, values.size), replace=False):
            place, was = np.unravel_index(i, values.shape), values.flat[i]
            values[place] = was + 1e-2
            up = loss()
            values[place] = was - 1e-2
            down = loss()
            values[place] = was
            assert abs((up - down) / 2e-2 - grad[place]) < 2e-3 + 0.02 * abs(grad[place]), name


def test_no_token_changes_nothing():
    """A window's logit is that of its tokens alone, on whatever side places are empty."""
    net, found, at = tiny()
    x = net.inputs(found)[0]
    short = net.logits(x, np.array([[0, 1, 2]]))
    for w in ([0, 1, 2, 5, 5], [5, 5, 0, 1, 2], [5, 0, 1, 2, 5]):
        assert net.logits(x, np.array([w])) == pytest.approx(short, abs=1e-5)
    assert net.logits(x, np.array([[0, 1, 3]])) != pytest.approx(short, abs=1e-5)


def test_windows():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{i}" for i in rng.integers(0, 50, n)) for n in (1, 5, 31, 32, 33, 47, 48, 49, 64, 200)] + ["", None, " \n", "a  b\tc"]
    found, at, of = toxicity.windows(texts)
    for i, text in enumerate(texts):
        words = (text or "").split()
        own = [[found[j] for j in w if j < len(found)] for w, o in zip(at.tolist(), of.tolist()) if o == i]
        starts = range(0, max(len(words) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]
        want = [words[a : a + toxicity.WINDOW] for a in starts]
        want = [w for k, w in enumerate(want) if k == 0 or (k * toxicity.STRIDE + toxicity.WINDOW - toxicity.STRIDE) < len(words)]
        assert own == want, len(words)
        assert not words or [w for k, x in enumerate(own) for w in (x if k == 0 else x[toxicity.WINDOW - toxicity.STRIDE :])] == words


def test_inputs():
    """Means of trigrams, token by token."""
    net = toxicity.Network.new({"bad": 1.0})
    found = ["bad", "é", "x", "BAD!?", "a" * 50]
    x, (ids, grams, size) = net.inputs(found)
    assert ids.tolist() == [1, 0, 0, 0, 0] and size.tolist() == [len(t.encode()) for t in found]
    for i, t in enumerate(found):
        alone = net.inputs([t])[0][0]
        assert np.allclose(alone, x[i], atol=1e-6)
    assert toxicity.word("--idiot###") == "idiot" and toxicity.word("a-b") == "a-b" and toxicity.word("##") == ""


def made(n=600, seed=5):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.5, int(rng.integers(3, 150))) % 400]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = str(rng.choice(["vile", "vile!!", "nasty", "nastiest"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_scores(spark):
    rows, labels = made()
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "nasty " * 5000), (None, "w1 w2"), (1004, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, logit="x", score="y", y=1) for i, t in rows], "doc_id long, text string, logit string, score string, y int").repartition(3)
    marks = spark.createDataFrame([*((i, 1, y) for i, y in labels), (3, 0, None), (None, 1, 1), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert by[1000].score == by[1001].score == by[1002].score and by[1003].predicted == 1
    assert by[1004].score == by[0].score
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in by.items())


def test_text_logits_against_single_windows(spark):
    rows, _ = made(40)
    net = toxicity.Network.new({"vile": 4.0, "w1": -1.0})
    got = {r.doc_id: r.logit for r in toxicity.logits(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, text in rows:
        words = text.split()
        of = [words[a : a + toxicity.WINDOW] for a in range(0, max(1, len(words)), toxicity.STRIDE)]
        every = [float(net.logits(net.inputs(w)[0], np.arange(len(w))[None])[0]) for k, w in enumerate(of) if k == 0 or len(w) > toxicity.WINDOW - toxicity.STRIDE]
        assert got[i] == pytest.approx(max(every), abs=1e-4)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, one).collect()} == {1.0}


def test_held_out_accuracy(spark):
    """On the given table, where a twentieth of the labels can't be told from texts."""
    folder = "/root/testdata/sf0.01"
    got = queries.op13_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.93
