"""Collocations against counts of all n-grams, and what summaries keep."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from clausewise.llm import collocations, queries


def brute(rows, first=2000):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    key = (lang, tuple(w[i : i + m]))
                    count[key] = count.get(key, 0) + 1
    found = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= 30}
    covered = set()
    for (lang, w), n in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * n >= 80 * found[lang, w[i : i + m]]:
                    covered.add((lang, w[i : i + m]))
    out: dict = {}
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            cuts = [(2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first]))


def made(seed):
    rng = np.random.default_rng(seed)
    vocab = ["the", "of", "Ä", "New", "York", "city", "x y", "\x1cz", "né"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(str(rng.choice(vocab, p=weights)) + str(rng.choice([" ", "  ", "\t", ", ", ".\n", "\r", "?"], p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) for _ in range(n))
    weights = 1 / np.arange(1, len(vocab) + 1)
    weights /= weights.sum()
    rows = [(str(rng.choice(["en", "de"])), text(int(rng.integers(1, 200)))) for _ in range(80)]
    passage = text(30)
    rows += [("en", f"{text(3)} {passage}") for _ in range(40)] + [("en", "New York city hall")] * 35 + [("fr", "new york" + " city" * i) for i in range(35)]
    return rows + [(None, "alone here " * 40), ("und", "alone here"), ("en", None), (None, None), ("de", ""), ("es", " \t.,"), ("it", "once only")]


@pytest.mark.parametrize("seed,slack,small,part", [(1, 4, 1 << 16, 1 << 22), (2, 1, 0, 1 << 10), (3, 2, 3, 1 << 12)])
def test_against_all_ngrams(spark, monkeypatch, seed, slack, small, part):
    for name, value in (("SLACK", slack), ("SMALL", small), ("PART", part)):
        monkeypatch.setattr(collocations, name, value)
    rows = made(seed)
    docs = spark.createDataFrame([Row(doc_id=None, lang=lang, text=t, phrase="p", n=1, part="q") for lang, t in rows], "doc_id long, lang string, text string, phrase string, n int, part string").repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == brute(rows)


def test_first_rows(spark):
    rows = made(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, first=5).collect()) == brute(rows, 5)


@pytest.mark.parametrize("seed", range(8))
def test_summaries(seed, monkeypatch):
    """Merged in any order, every frequent n-gram survives, counters are too low by `lost` at most, and few are held."""
    monkeypatch.setattr(collocations, "SLACK", 1)
    rng = np.random.default_rng(seed)
    grams = (rng.zipf(1.2, 40_000) % 30_000).astype(np.uint32)
    summary = collocations.Summary(30, small=8)
    for part in np.array_split(grams, 13):
        summary.add(*collocations._merged(part, np.ones(len(part), np.int64)))
    true = Counter(grams.tolist())
    assert 0 < summary.lost < 30
    assert {g for g, n in true.items() if n >= 30} <= set(summary.survivors().tolist())
    held = dict(zip(summary.grams.tolist(), summary.counts.tolist()))
    assert all(true[g] - summary.lost <= n <= true[g] for g, n in held.items())
    assert len(held) < len(true)


def test_bitmap():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    parts = [(x[(x >> np.uint64(61)) == p] << np.uint64(3) >> np.uint64(32)).astype(np.uint32) for p in range(8)]
    whole = b"".join(collocations._bits(p, 16, 3) for p in parts)
    found = collocations.Bitmap(16, np.frombuffer(whole, np.uint8))
    assert found.has(x).all()
    others = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert found.has(others).mean() < 0.05


def test_counts_beyond_64_bits(spark):
    """Products of counts, with those of a large corpus put in."""
    big = 9_000_000_000_000_000
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, phrase string, n long")
    found = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    got = collocations.scored(words, found).first()
    assert got.score == 2_000_000 * big // (2 * big + 8) and (got.a, got.l, got.r) == (big, big + 7, big + 1)


def test_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op11_collocations"])
    names = [x[0] for x in cursor.description]
    got = queries.op11_collocations(spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())
