"""Mixing against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import Row

from clausewise.llm import mixing


def brute_targets(sizes, weights, total, most):
    out = [0.0] * len(sizes)
    left = total
    for _ in range(100):
        open_ = [i for i in range(len(sizes)) if out[i] < most * sizes[i] - 1e-9]
        if not open_ or left < 1e-9:
            break
        unit = left / sum(weights[i] for i in open_)
        left = 0.0
        for i in open_:
            out[i] += weights[i] * unit
            if out[i] > most * sizes[i]:
                left += out[i] - most * sizes[i]
                out[i] = most * sizes[i]
    return out


@pytest.mark.parametrize("sizes", [[100], [1000, 10, 10], [5, 0, 7, 2000, 300], [1, 1, 1, 1], []])
def test_targets(sizes):
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, w, 1.5 * sum(sizes), 2.0) == pytest.approx(brute_targets(sizes, w, 1.5 * sum(sizes), 2.0))


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("quotas", [[5], [1000, 1, 0, 30], [300_000, 200_000, 7, 100_001]])
def test_draws_meet_quotas(quotas):
    q = np.array(quotas)
    n_groups = -(-int(q.sum()) // (mixing.SLOTS * mixing.GROUP))
    got = [mixing.draws(q, g, n_groups) for g in range(n_groups)]
    assert sum(n.sum(0) for n, _ in got).tolist() == quotas
    for (n, before), nxt in zip(got, got[1:]):
        assert (before + n.sum(0) == nxt[1]).all()
    for n, _ in got:
        assert (n >= 0).all() and (n.sum(1)[:-1] == mixing.SLOTS).all()


def test_mix(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(-1, None, "src0"), (-2, "", None), (-3, "a b\x0bc\x1cd é", None), (-3, "a b\x0bc\x1cd é", None), (None, "x " * 20_000, None), (-5, "y " * 3000, "é")]
    d = spark.createDataFrame([Row(doc_id=i, text=t, source=s, size=1, row="x", target=0) for i, t, s in rows], "doc_id long, text string, source string, size int, row string, target int").repartition(5)
    got = [r.asDict() for r in mixing.mixed_words(d).collect()]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by: dict = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + count(t)
    order = sorted(by, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    want = dict(zip(order, brute_targets([by[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(by.values()), 2.0)))
    assert sorted(((r["doc_id"], r["size"], r["source_size"]) for r in got), key=str) == sorted(((i, count(t), by[s]) for i, t, s in rows), key=str)
    source = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    again = [r.asDict() for r in mixing.mixed_words(d.repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    pieces = mixing.mix(d).where("taken > 0").collect()
    assert all(sum(p.n for p in r.pieces) <= r["size"] and sum(p.n * p.times for p in r.pieces) == r.taken for r in pieces)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_words(d).count() == 0
    d = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in mixing.mixed_words(d).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
