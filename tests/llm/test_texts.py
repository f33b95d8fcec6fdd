"""Operators on single texts against brute force: language ID, Matroska, fingerprints, token counts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from clausewise.llm import fingerprints, language_id, matroska, pretokens, token_counts

TEXTS = ["", " ", "a", "it's  we'll 'tis ''s\n\n x'", "café 12½ x  y\t\n", "<|endoftext|> b<|endoftext|>", "1234567890", "\n'll", "日本語 テキスト", "x" * 5000 + " " * 300, "👩‍👩‍👧 ok"]
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang=lang, source=s, n_chars=len(t or "")) for i, t, lang, s in rows], SCHEMA)


def library_pieces(text):
    """What the library's own split gives (the regex module knows newer letters)."""
    from tokenizers import pre_tokenizers

    return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stredvml.,1aé 　"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
@settings(max_examples=300, deadline=None)
def test_boundaries_are_the_patterns(texts):
    got, counts = pretokens.pretokens(texts)
    want = [library_pieces(t) for t in texts]
    assert got == [x for w in want for x in w]
    assert counts.tolist() == [len(w) for w in want]


def test_token_counts_are_the_librarys(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    assert token_counts.count_texts(JSON, texts).tolist() == [len(t.encode(x, add_special_tokens=False)) for x in texts]
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "é" * 600, "en", "a"), (3, "é" * 600, "en", "a")]), JSON).collect()}
    assert (got[1].n_tokens, got[1].n_bytes, got[2].n_tokens, got[3].n_bytes, got[3].over_limit) == (0, 0, 0, 1200, len(t.encode("é" * 600)) > 512)
    assert token_counts.token_counts(docs(spark, []), JSON).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 511, 512, 513, 4096, 4097, 100_003])
def test_matroska_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    rows = matroska.demux(matroska.mux(data))
    media = matroska.mux(data)
    assert b"".join(media[r[2] : r[2] + r[3]] for r in rows) == data
    assert [r[1] for r in rows] == [i * 64_000_000 for i in range(len(rows))]


@pytest.mark.parametrize("sizes", [[3, 300, 5, 700], [255, 255, 1], [510, 2, 9], [1], [4, 4, 4]])
@pytest.mark.parametrize("turn", [0, 1])
def test_lacing(sizes, turn):
    kind, head = matroska._lace(sizes, turn)
    data = head + bytes(sum(sizes))
    assert [s for _, s in matroska._frames(data, 0, len(data), kind)] == sizes


def test_matroska_columns(spark):
    d = docs(spark, [(1, "abc", "en", "a"), (2, None, None, None), (3, "abc", "de", "b"), (4, "é" * 40_000, "fr", "b")])
    got = {r.doc_id: r for r in matroska.media_digest(d).collect()}
    pad = b"abc" + bytes(61)
    assert (got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (64, hashlib.sha256(pad).hexdigest(), zlib.crc32(pad))
    assert got[1].media_sha256 == got[3].media_sha256 and got[2].n_bytes == 0 and got[2].payload_bytes == 64
    assert got[4].n_bytes == got[4].payload_bytes == 80_000
    media = matroska.with_media(d.select("doc_id", "text", "lang")).select("doc_id", "media")
    table = matroska.packets(media, "doc_id").where("doc_id = 4").collect()
    assert sum(r["size"] for r in table) == 80_000 and {r["track"] for r in table} == {1} and len({r["cluster"] for r in table}) == 3
    bad = spark.createDataFrame([(1, b"\x1aE"), (2, None), (3, matroska.mux(b"x" * 999)[:-5])], "doc_id long, media binary")
    assert {r.doc_id: r.error is not None for r in matroska.packets(bad, "doc_id").collect()} == {1: True, 3: True}
    assert matroska.with_features(bad, ["doc_id"]).count() == 3


def test_unknown_sizes_parse():
    body = matroska._uint(matroska.TIMESTAMP, 0) + matroska.element(matroska.SIMPLE_BLOCK, matroska.vint(1) + b"\0\0\x80" + b"data")
    cluster = matroska._id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + body
    data = matroska._HEAD + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska._INFO + matroska._TRACKS + cluster + cluster
    assert [data[r[2] : r[2] + r[3]] for r in matroska.demux(data)] == [b"data", b"data"]


def test_language(spark, sf):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_of(all_docs).join(all_docs.select("doc_id", "lang"), "doc_id")
    right = got.selectExpr("avg(cast(lang = lang_pred as double)) a", "avg(score) s", "min(score) lo", "max(score) hi").first()
    assert right.a > 0.97 and 0 <= right.lo and right.hi <= 1
    d = docs(spark, [(0, "the cat and the dog", "en", "a"), (3, None, "en", "a"), (4, "der Hund und die Katze", "de", None), (5, "12 34!", None, None), (6, "", "fr", "x"), (7, "the dog", None, "a")])
    train = language_id.train(d)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d.withColumn("score", d.n_chars), train).collect()}
    assert pred[3] == pred[5] == pred[6] == ("und", 0.0) and pred[7][0] == "en" and pred[4][0] == "de"
    assert language_id.language_of(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.language_of(docs(spark, [(1, "text", None, None)])).collect()} == {"und"}


def test_language_chunks(monkeypatch):
    text = "some words of a text, again and again. " * 50
    want = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "_CHUNK", 37)
    got = language_id.ngrams(text)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def phrases(data: bytes) -> set:
    seen, w = set(), b""
    for i in range(len(data)):
        w += data[i : i + 1]
        if w not in seen:
            seen.add(w)
            w = b""
    return seen | ({w} if w else set())


def test_fingerprints(spark):
    rng = np.random.default_rng(1)
    texts = ["", "a", "aaaa", None, *("".join(rng.choice(list("abcé \n"), n)) for n in (5, 60, 200, 900, 901)), "a"]
    ids = [5, 1, 9, 30, 2, 7, 7, 100, 3, -4]
    d = docs(spark, [(i, t, None, None) for i, t in zip(ids, texts)])
    got = sorted((r.asDict() for r in fingerprints.edited_likeness(d).collect()), key=lambda r: (r["doc_id"], r["n_chars"]))
    rows = sorted((i, t or "") for i, t in zip(ids, texts))
    assert len(got) == len(rows)
    for g, (i, t), (_, nxt) in zip(got, sorted(rows, key=lambda r: (r[0], len(r[1]))), [rows[(rows.index(r) + 1) % len(rows)] for r in sorted(rows, key=lambda r: (r[0], len(r[1])))]):
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = (phrases(x.encode()) for x in (t, edited, nxt))
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(t)
        assert len(g["fingerprint"]) == 8 * min(len(a), fingerprints.SIGNATURE)
        for near, x in (("near_edited", b), ("near_next", c)):
            want = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(g[near] - want) < (1e-9 if len(a | x) <= fingerprints.SIGNATURE else 0.15)
    assert fingerprints.edited_likeness(docs(spark, [])).count() == 0
    assert fingerprints.edited_likeness(docs(spark, [(1, "abcd", None, None)])).first().near_next == 1.0
    assert fingerprints.fingerprint(d).count() == len(ids)


def profile(texts, k=300):
    """The k most frequent 1- to 3-letter n-grams of words with an end on either side, as numbers; a letter has 21 bits."""
    import re
    from collections import Counter

    n = Counter()
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            if not all(c.isalpha() for c in word):
                raise AssertionError(word)
            w = [0, *map(ord, word), 0]
            n.update(w[1:-1])
            n.update(a | b << 21 for a, b in zip(w, w[1:]))
            n.update(a | b << 21 | c << 42 for a, b, c in zip(w, w[1:], w[2:]))
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]]


def test_languages_by_brute_force(spark):
    """Predictions and scores against out-of-place distances computed straight from the texts."""
    import zlib
    from collections import defaultdict

    from clausewise.llm import language_id

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = d.collect()
    by = defaultdict(list)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None:
            by[r.lang].append(r.text)
    profiles = {name: {g: i for i, g in enumerate(profile(texts))} for name, texts in by.items()}
    got = {r.doc_id: r for r in language_id.language_of(d).collect()}
    for r in rows:
        mine = profile([r.text or ""])
        if not mine:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        far = {name: sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(mine)) for name, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - (1 - far[best] / (300 * len(mine)))) < 1e-12
