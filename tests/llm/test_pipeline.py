"""The pipeline's stages on small tables, each against what it must keep."""

import re

import numpy as np
import pytest
from pyspark.sql import Row

import corpus_pipeline
from clausewise.llm import mixing


def sizes(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed", range(5))
def test_taken_texts(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" for i in range(30)]
    text = "  " + "".join(w + str(rng.choice([" ", "\n\t", "  "])) for w in words)
    pieces = [(a, 3, int(rng.integers(0, 3))) for a in range(0, 30, 3)]
    got = mixing.taken_texts(text, pieces)
    for turn in range(1, max(t for *_, t in pieces) + 1):
        assert got[turn - 1].split() == [w for a, n, t in pieces if t >= turn for w in words[a : a + n]]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [Row(doc_id=9001, text=None, lang=None, source=None, n_chars=None), Row(doc_id=9002, text="12 34", lang="en", source="a", n_chars=5), Row(doc_id=None, text="the words of a document without an id", lang="en", source=None, n_chars=36)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, at = at, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), at.collect())
    a, b = seen["language ID"]
    assert {r.doc_id for r in a} - {r.doc_id for r in b} == {9001, 9002} and len(b) == len(a) - 2
    a, b = seen["near duplicates"]
    assert len({r.doc_id for r in b}) == len(b) < len(a) and None in {r.doc_id for r in b}
    a, b = seen["personal data"]
    assert len(a) == len(b) and not any("@" in r.text and ".example" in r.text for r in b) and all(len(r.text) == r.n_chars for r in b)
    a, b = seen["mixture"]
    total, source = sum(sizes(r.text) for r in a), {}
    for r in a:
        source[r.source] = source.get(r.source, 0) + sizes(r.text)
    assert abs(sum(sizes(r.text) for r in b) - 1.5 * total) < 2 * mixing.BLOCK * len(source)
    assert all(r.n_chars == len(r.text) for r in b)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.n_tokens for r in got.collect()) == sorted(r.n_tokens for r in corpus_pipeline.tokens(spark, at, str(tmp_path)).collect())
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_nothing(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_by_row(spark, tmp_path):
    """Rows with null or repeated ids and different texts stay; of a group one row does."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, own(0)), (None, own(1)), (5, own(2)), (5, own(3)), (3, own(4)), (7, own(5)), (7, own(4)), (None, own(4)), (None, own(6)), (None, own(6)), (9, own(7) + " a"), (8, own(7) + " b"), (4, own(8)), (4, own(8))]
    # two rows without an id are one group of similar texts
    rows += [(None, own(9) + " a"), (None, own(9) + " b")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_chars=len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    last = [x for x in got if x[1].startswith(own(9))]
    assert len(last) == 1 and last[0][0] is None
    want = [(None, own(0)), (None, own(1)), (5, own(2)), (5, own(3)), (3, own(4)), (7, own(5)), (None, own(6)), (8, own(7) + " b"), (4, own(8))]
    assert [x for x in got if x not in last] == sorted(want, key=str)


def test_clashing_columns(spark, tmp_path):
    """Columns with the names that stages use inside come through as they were."""
    rows = [Row(doc_id=i, text=f"text {i} of the document " * 5, lang="en", source="s", n_chars=1, key=f"k{i}", row=i, row_key=f"r{i}", size="x", pieces="p", nth=7, group=None, stay=0, base=2.5, terms="t", _c1="c", score=42.0, lang_pred="p", t=i, l="l", rest="r") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row int, row_key string, size string, pieces string, nth int, group string, stay int, base double, terms string, _c1 string, score double, lang_pred string, t int, l string, rest string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: [v for c, v in r.asDict().items() if c not in ("text", "n_chars")] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all([v for c, v in r.asDict().items() if c not in ("text", "n_chars")] == want[r.doc_id] for r in got), name
