"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from clausewise.queries import QUERIES, SQL


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return int(v) if float(v).is_integer() and abs(v) < 1e15 else float(v)
    return str(v) if isinstance(v, (pd.Timestamp, np.ndarray)) else v


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_doc_clean_odd_lines(spark, tmp_path):
    """Lines of 7 characters that longer foldings would keep, characters with a lower case of their own, no source or id, ids that come twice."""
    again = "Die gleiche Zeile\n\n# die GLEICHE zeile"
    texts = ["Geschß.\nErß das.", "ΑΒΓΔΕΖΗΣ\nαβγδεζης\nαβγδεζησ", "İabcdef\nİABCDEFG", "a\x0bbcdefg", f"{again}\nDie gleiche Zeile", None, "", again]
    given = [(i, "s" if i % 3 else None, "de", t) for i, t in enumerate(texts * 3)] + [(None, "s", "de", again), (None, None, "de", again), (7, None, "de", again), (7, "s", "de", again)]
    spark.createDataFrame(given, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["doc_clean"](spark, str(tmp_path)).toPandas(), c.execute(SQL["doc_clean"]).df()
    columns = ["doc_id", "n_lines", "kept"]
    assert rows(got, columns) == rows(want, columns)
