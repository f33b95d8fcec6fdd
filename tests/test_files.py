"""Manifests and signatures of files that are too large for a value of a row."""

import gzip
import hashlib
import random

import pytest

import __spark_entry__
from clausewise.sources import tables


def test_larger_than_a_value(spark, tmp_path):
    """A file of more than 2 GB, mostly holes, with a line of each 16 MB."""
    with open(tmp_path / "a.parquet", "wb") as f:
        f.write(b"PAR1")
        for i in range(1, 130):
            f.seek((i << 24) - 1)
            f.write(b"\n")
        f.write(b"PAR1")
    (tmp_path / "b.parquet").write_bytes(b"%PDF-1.7")
    got = {r.file_name: r.kind for r in __spark_entry__.queries()["src_signature"](spark, str(tmp_path)).collect()}
    assert got == {"a.parquet": "parquet", "b.parquet": "pdf"}
    want = {p.name: (p.stat().st_size, hashlib.file_digest(p.open("rb"), "sha256").hexdigest()) for p in tmp_path.iterdir()}
    got = {r.file_name: (r.n_bytes, r.sha256) for r in __spark_entry__.queries()["src_file_manifest"](spark, str(tmp_path)).collect()}
    assert got == want and got["a.parquet"][0] > 1 << 31


@pytest.mark.parametrize("whole", [3, 5, 1 << 20])
def test_odd_files(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(tables, "WHOLE", whole)
    junk = random.Random(1).randbytes(300_000)
    files = {"end": b"a\nb\n", "open": b"a\nb", "feeds": b"\n\n\n", "one": b"\n", "return": b"a\r\nb\rc\r", "mark": b"\xef\xbb\xbfa\nb", "marks": b"\xef\xbb\xbf" * 2 + b"\n", "only mark": b"\xef\xbb\xbf", "junk": junk, "junk\xe9 {1} [2] %20": junk + b"\n", "p.gz": gzip.compress(junk), "pdf": b"%PDF-", "zip": b"PK\x03\x04", "x": b"P"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file_name: (r.n_bytes, r.sha256) for r in tables.manifest(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    kinds = {r.path.split("/")[-1]: r.kind for r in tables.signature(tables.heads(spark, str(tmp_path))).collect()}
    assert kinds == {n: {"pdf": "pdf", "zip": "zip"}.get(n, "other") for n in files}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
