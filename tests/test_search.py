"""Vector search exact and by lists, stored postings, and tables that are kept."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.plans import lexical, vectors
from clausewise.queries import QUERIES
from clausewise.sources import stored


def brute(v, asked, k):
    out = {}
    for i, q in asked:
        if q is None or not any(q):
            continue
        d = []
        for key, x in v:
            if x is not None and any(x):
                a, b = np.array(x, float), np.array(q, float)
                d.append((round(float(1 - a @ b / np.sqrt((a @ a) * (b @ b))), 10), key))
        out[i] = [x for _, x in sorted(d)[:k]]
    return out


def made(seed, n=300, dims=6):
    rng = np.random.default_rng(seed)
    v = [(i, rng.normal(size=dims).round(3).tolist()) for i in range(n)]
    v += [(1000 + i, v[7][1]) for i in range(30)]  # one vector many times
    return v + [(2000, None), (2001, [0.0] * dims)]


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query, {})[r["rank"]] = r.vec_id
    return {q: [x[i + 1] for i in range(len(x))] for q, x in out.items()}


@pytest.mark.parametrize("few,rows,queries", [(1024, 8192, 1024), (0, 16, 3), (0, 8192, 1024)])
def test_exact(spark, monkeypatch, few, rows, queries):
    for name, value in (("FEW", few), ("ROWS", rows), ("QUERIES", queries)):
        monkeypatch.setattr(vectors, name, value)
    v = made(1)
    asked = [(i, x) for i, x in v if i % 20 == 0 or i == 7]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query long, q array<float>")
    assert listed(vectors.nearest(d, q, 5)) == brute(v, asked, 5)


def test_keys_of_other_types(spark):
    v = [(f"k{i}", x) for i, x in made(2, 40)]
    d = spark.createDataFrame(v, "vec_id string, embedding array<double>")
    asked = [("a", v[3][1]), ("b", [0.0] * 6)]
    assert listed(vectors.nearest(d, spark.createDataFrame(asked, "query string, q array<double>"), 3)) == brute(v, asked, 3)


def test_all_lists_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 16)
    v = made(3)
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(4)
    asked = v[:40:4]
    q = spark.createDataFrame(asked, "query long, q array<float>")
    index = vectors.build(d, lists=9)
    assert index.rows.count() == 330 and len(index.centroids) == 9  # every row with a direction
    assert listed(vectors.search(index, q, 5, probes=9)) == brute(v, asked, 5)
    again = vectors.Index.load(spark, index.path)
    assert listed(vectors.search(again, q, 5, probes=9)) == brute(v, asked, 5)
    few = vectors.recall(vectors.search(index, q, 5, probes=1), vectors.nearest(d, q, 5))
    assert 0 < few < 1 and vectors.recall(vectors.search(index, q, 5, probes=9), vectors.nearest(d, q, 5)) == 1


def test_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, q array<float>")
    assert vectors.nearest(none, q, 3).count() == 0
    assert vectors.search(vectors.build(none), q, 3).count() == 0
    assert vectors.nearest(spark.createDataFrame([(1, [1.0, 2.0])], none.schema), q.limit(0), 3).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    """Of the registered query, against the exact one, all of whose rows SQL bears out."""
    assert vectors.recall(QUERIES["knn_indexed"](spark, folder), QUERIES["knn_queries"](spark, folder)) >= 0.9


def test_stored_postings(spark, tmp_path):
    """Searches of stored postings give what searches of texts give."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["a", "b", "Cc", "dé", "e1", "招标", "文件"]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(500, None), (501, "")]
    spark.createDataFrame(docs, "k int, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    q = spark.createDataFrame([(1, "a b"), (2, "Cc a E1"), (3, "招标文件"), (4, "nowhere"), (5, None)], "q int, text string")
    index = lexical.stored(d, "k")
    assert lexical.stored(d, "k") is index
    places = {(r.term, r.k): r.places for r in index.collect()}
    assert places["a", 0] == [i for i, w in enumerate(docs[0][1].split()) if w == "a"] or "招" in docs[0][1] or "文" in docs[0][1]
    rows = lambda index: sorted(map(tuple, lexical.ranked(d, "k", q, "q", 20, index=index).withColumn("score", F.round("score", 9)).collect()))
    assert rows(index) == rows(None) and len(rows(None)) >= 40


def test_many_terms(spark, monkeypatch, tmp_path):
    """Terms beyond what goes to the scan as a list are joined."""
    monkeypatch.setattr(lexical, "LISTED", 1)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    d = spark.createDataFrame([(i, f"x{i} y z{i % 3}") for i in range(30)], "k int, text string")
    d.write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    q = spark.createDataFrame([(i, f"y z{i}") for i in range(3)], "q int, text string")
    got = lexical.matches(d, "k", q, "q", index=lexical.stored(d, "k")).select("q", "k").collect()
    assert sorted(map(tuple, got)) == sorted((i % 3, i) for i in range(30))


def test_folder(spark, monkeypatch):
    """A cluster needs a folder that all executors share."""

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, other: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        stored.shared_dir(Session)
    assert stored.shared_dir(spark)
