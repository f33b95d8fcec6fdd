"""Packing against a plain best-fit-decreasing, and whole documents put together again."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row

from clausewise.llm import byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain(sizes, length):
    rooms = []
    for k in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= k]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - k)
        else:
            rooms.append(length - k)
    return sorted(length - r for r in rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(1, 70))
    sizes = rng.integers(1, length + 1, rng.integers(0, 200))
    rows = packing.pack(sizes, length)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert sorted(int(sizes[r].sum()) for r in rows) == plain(sizes.tolist(), length)


def test_packed(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    rows += [(1001, None), (1002, ""), (1003, "word " * 9000), (None, "null id"), (1004, "x")]
    d = spark.createDataFrame([Row(doc_id=i, text=t, row=1) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    out = packing.packed(d, RANKS, public_tokenizers.PATTERN, length=300, window=20_000).collect()
    enc = byte_bpe.library(RANKS, public_tokenizers.PATTERN)
    parts: dict = {}
    for r in out:
        ids, place = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(place) == 300 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.PAD).all()
        for a, b, doc, off in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.offsets):
            assert place[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((off, ids[a:b].tolist()))
    got = {doc: [x for _, p in sorted(ps) for x in p] for doc, ps in parts.items()}
    assert got == {i: enc.encode_ordinary(t) for i, t in rows if t}
    assert packing.packed(d.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_large_ids(spark, tmp_path):
    """ids beyond 16 bits are kept whole, in 32 bits."""
    import base64

    path = str(tmp_path / "large.tiktoken")
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(bytes([i])) + f" {70_000 + i}\n".encode() for i in range(256))
    d = spark.createDataFrame([(None, "ab"), (2, None), (3, "é")], "doc_id long, text string").coalesce(1)
    r = packing.packed(d, path, public_tokenizers.PATTERN, length=8).collect()
    assert len(r) == 1 and packing.id_type(path) == "<u4"
    ids = np.frombuffer(r[0].input_ids, "<u4")
    assert sorted(ids[: r[0].n_tokens].tolist()) == sorted(70_000 + b for b in "abé".encode()) and (ids[r[0].n_tokens :] == packing.PAD).all() and set(r[0].doc_ids) == {None, 3}
