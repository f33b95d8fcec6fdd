"""The n-gram join against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clausewise.llm import components, ngram_join


def brute(rows, k, percent):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and 100 * len(sets[i] & sets[j]) >= percent * u:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def made(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    passage = " ".join(rng.choice(vocab, 40))
    for _ in range(60):
        texts.append(" ".join(rng.choice(vocab, rng.integers(1, 120))))
    for t in list(texts[:20]):
        w = t.split()
        for _ in range(4):
            x = list(w)
            for _ in range(rng.integers(0, 4)):
                x[rng.integers(len(x))] = str(rng.choice(vocab))
            texts.append(" ".join(x))
    big = list(rng.choice(vocab, 80))
    for _ in range(40):
        big[rng.integers(80)] = str(rng.choice(vocab))
        texts.append(" ".join(big))
    texts += [passage + " " + t for t in texts[:15]] + [texts[3].upper(), texts[5], texts[5] + " \n", "", " \t", None, "One", "one", "one two", "ONE two"]
    order = rng.permutation(len(texts))
    return [(int(i) * 3, texts[i]) for i in order] + [(None, texts[2]), (None, "null id"), (7, texts[0])]


@pytest.mark.parametrize("seed,k,percent,dense,side,pivots", [(1, 3, 90, 48, 512, 24), (2, 5, 80, 4, 5, 2), (3, 2, 60, 1, 3, 1), (4, 3, 70, 2, 4, 3), (5, 1, 40, 1, 2, 2)])
def test_join(spark, monkeypatch, seed, k, percent, dense, side, pivots):
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "SIDE", side)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(components, "AT_ONCE", seed % 2 << 17)
    rows = made(seed)
    d = spark.createDataFrame([Row(doc_id=i, text=t, n=1, key="x", cid=2) for i, t in rows], "doc_id long, text string, n int, key string, cid int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(d, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_common_passage(spark, monkeypatch):
    """Texts that share a long passage and nothing else make no cluster; near copies of one text do."""
    seen = []
    placed = ngram_join._placed
    monkeypatch.setattr(ngram_join, "_placed", lambda clusters, keys: seen.append(clusters) or placed(clusters, keys))
    monkeypatch.setattr(ngram_join, "SIDE", 32)
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    passage, text = words(60), words(80).split()
    rows = [(i, f"{words(30)} {passage} {words(10)}") for i in range(150)]
    for i in range(150, 260):
        copy = list(text)
        copy[int(rng.integers(80))] = "edited"
        rows.append((i, " ".join(copy)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(d, 3, 80).collect()), key=str)
    assert got == brute(rows, 3, 80)
    sizes = sorted(r["count"] for r in seen[0].groupBy("root").count().collect())
    assert sizes[-1] >= 50 and all(n < 10 for n in sizes[:-1])


def test_join_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_null_and_repeated_ids(spark, monkeypatch):
    """Documents without ids of their own cost what others cost: each is found again once."""
    seen = []
    texts = ngram_join._texts
    monkeypatch.setattr(ngram_join, "_texts", lambda docs, rows: seen.append(texts(docs, rows)) or seen[-1])
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None if i % 3 else 7, own(i // 2) + f" {i}") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.join(d, 5, 80, row_key=F.md5("text")).collect()
    assert sorted(n for n in Counter(r.group for r in got).values()) == [2] * 750
    assert sum(x.count() for x in seen) <= 2 * len(rows)


def test_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ngram_join.join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("at_once", [1 << 17, 0])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2)) if a != b]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert len(got) == len(near)


def test_sql_of_the_join(spark):
    """The registered query against its SQL on a thousand documents."""
    import duckdb

    from clausewise.llm import queries

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op6_ngram_join"]).fetchall())
    got = queries.op6_ngram_join(spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want
