"""Operators on the distinct-word shuffle against brute force: byte-level BPE and the suffix tree."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row

from clausewise.llm import byte_bpe, common, suffix_tree, wordblocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ROWS = [(1, "it's we'll  'tis\n\n x"), (2, None), (3, ""), (None, "null id"), (5, "日本 語 12½ 👩‍👩‍👧"), (5, "日本 語 12½ 👩‍👩‍👧"), (7, "long" * 9000 + " word " * 9000), (9, " \n\t "), (10, "The the THE")]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [200, 1 << 25])
def test_encode_and_decode(spark, sf, library, block):
    rows = ROWS + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    d = spark.createDataFrame([Row(doc_id=i, text=t, ids="x", n_tokens=1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted((r.asDict() for r in byte_bpe.encode_and_decode(d, RANKS, public_tokenizers.PATTERN, block_bytes=block).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append({"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()})
    assert got == sorted(want, key=str)


def test_empty_and_unknown(spark):
    assert byte_bpe.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0
    d = spark.createDataFrame([(1, [0, 60_000]), (2, []), (3, None), (4, [64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(d, RANKS).collect()} == {1: None, 2: b"", 3: None, 4: byte_bpe.token_bytes(RANKS).decode(np.array([64]))}


def test_one_python_worker_a_task(spark, sf, capsys):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    both = byte_bpe.encode_and_decode(d, RANKS, public_tokenizers.PATTERN)
    both.explain()
    last = capsys.readouterr().out.split("FlatMapCoGroupsInArrow")
    assert len(last) == 2 and "InArrow" not in last[0]
    assert sorted(both.collect(), key=str) == sorted(byte_bpe.round_trip(byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS).collect(), key=str)


def test_packing():
    for dtype in (np.int32, np.uint8, np.float64):
        x = np.arange(100).astype(dtype)
        assert (wordblocks.unpack(wordblocks.pack(x), dtype) == x).all()
    assert wordblocks.unpack(wordblocks.pack(np.zeros(0, np.int32)), np.int32).size == 0


def test_passing_tables(spark, capsys):
    folder = common.shared_dir(spark)
    before = set(os.listdir(folder)), spark.catalog.listDatabases()
    with common.passing(spark) as write:
        side = write(spark.range(9).selectExpr("id as block", "id as x"), "side", by="block", buckets=3)
        write(spark.range(9).selectExpr("id as block", "'it''s' as x"), "found", by="block", buckets=3)
        found = write(spark.range(3).selectExpr("cast(null as long) as block", "cast(null as string) as x"), "found", by="block", buckets=3)
        assert sorted(found.collect(), key=str) == sorted([(i, "it's") for i in range(9)] + [(None, None)] * 3, key=str)
        both = side.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda a, b: pa.table({"n": [a.num_rows * 10 + b.num_rows]}), "n long")
        assert sorted(r.n for r in both.collect()) == [3, *[11] * 9]
        both.explain()
        assert "Exchange" not in capsys.readouterr().out
    assert (set(os.listdir(folder)), spark.catalog.listDatabases()) == before


def test_what_the_tree_leaves_on_disk(spark, sf):
    """Texts, dictionaries and the first levels' answers go once the first levels are done."""
    folder = common.shared_dir(spark)
    before = set(os.listdir(folder))
    out = suffix_tree.scored(spark.read.parquet(f"{sf}/documents.parquet"))
    left = {x.split("-")[1] for x in set(os.listdir(folder)) - before}
    assert left <= {"rest", "found"} and out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), "\n"]


def grown(texts):
    """The root's counts and the tree {context: (counts, total)}, grown from token lists as defined, without bounds or blocks."""
    root = Counter(x for t in texts for x in t)
    whole = sum(root.values()) + len(root) + 1
    tree, open_, depth, levels = {}, {()}, 0, 0
    mu = suffix_tree.MU

    def p(context, x):
        out = (root[x] + 1) / whole
        for d in range(1, len(context) + 1):
            if (c := context[len(context) - d :]) in tree:
                out = (tree[c][0][x] + mu * out) / (tree[c][1] + mu)
        return out

    while open_:
        depth += 1
        counts = {}
        for t in texts:
            for i in range(depth, len(t)):
                c = tuple(t[i - depth : i])
                if c[1:] in open_:
                    counts.setdefault(c, Counter())[t[i]] += 1
        passed, open_ = {}, set()
        for c, n in counts.items():
            q = {x: 2 ** (-round(-64 * math.log2(p(c[1:], x))) / 64) for x in n}
            total = sum(n.values())
            gain = sum(k * math.log2((k - 1) / q[x] + mu) for x, k in n.items()) - total * math.log2(total - 1 + mu)
            if gain >= suffix_tree.price(depth):
                passed[c] = (n, total)
            if sum(max(0, k * math.log2(((k - 1) / q[x] + mu) / (k - 1 + mu))) for x, k in n.items()) >= suffix_tree.price(depth + 1):
                open_.add(c)
        tree |= passed
        levels = depth if passed else levels
    return root, p, tree, levels


def markov(seed, n, order):
    """A text in which `order` words tell the next, and fewer don't."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2, order).tolist()
    while len(out) < n:
        out.append((sum(out[-order:]) + int(rng.random() < 0.02)) % 2)
    return " ".join("ab"[x] for x in out)


@pytest.mark.parametrize("sizes", [{}, {"split": 40, "block_bytes": 30_000}])
def test_scores(spark, sizes):
    """Every score against a tree grown by brute force, also with many blocks and contexts dealt over buckets."""
    rows = ROWS + [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000 + i, markov(i, 6000, 5)) for i in range(12)]
    long = " ".join(f"w{i * i % 97}" for i in range(300))
    rows += [(2000 + i, " ".join(w if j % 50 != i % 50 else f"edit{i % 7}" for j, w in enumerate(long.split()))) for i in range(120)]
    d = spark.createDataFrame([Row(doc_id=i, text=t, block=1, ids="x", n_tokens=2, score="s", level=3) for i, t in rows], "doc_id long, text string, block int, ids string, n_tokens int, score string, level int").repartition(3)
    got = sorted((r.asDict() for r in suffix_tree.scored(d, **sizes).collect()), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    tokens = {k: tokens_of(t) for k, (i, t) in enumerate(rows)}
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    c, p, tree, levels = grown([tokens[k] for k in tokens if not held[k]])
    assert levels > suffix_tree.AGAIN + 1
    n, v = sum(c.values()), len(c)
    longest = max(map(len, tree))
    want = sorted((
        {"doc_id": rows[k][0], "held_out": held[k], "n_tokens": len(x), "n_known": sum(c[w] > 0 for w in x), "train_tokens": n, "base_score": sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), "score": sum(math.log10(p(tuple(x[max(0, i - longest) : i]), w)) for i, w in enumerate(x))}
        for k, x in tokens.items()
    ), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g.pop("base_score") == pytest.approx(w.pop("base_score"))
        assert g.pop("score") == pytest.approx(w.pop("score"), rel=1e-9), g
        assert g == w


def test_held_out(spark):
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = suffix_tree.scored(plain).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert both.s > 0.96 * both.b


def test_numbers():
    """Pairs are numbered alike whether they fit one word with their places or not."""
    rng = np.random.default_rng(0)
    for high in (5, 1 << 20, 1 << 31):
        a, b = rng.integers(0, high, 1000), rng.integers(0, high, 1000)
        a[::3], b[::3] = 7 % high, 3
        number, first = suffix_tree.numbered(a, b)
        pairs = sorted(set(zip(a.tolist(), b.tolist())))
        assert [pairs[i] for i in number] == list(zip(a.tolist(), b.tolist())) and [(a[i], b[i]) for i in first] == pairs


def test_short_keys_and_differences():
    """Keys of few bits are told apart, and runs come back from their differences."""
    for bits in (2, 3, 17, 63):
        x = np.arange(1 << min(bits, 17))
        keys = suffix_tree.short(x << (bits - min(bits, 17)), bits)
        assert len(set(keys.tolist())) == len(x) and not (keys & np.uint64((1 << (64 - bits)) - 1)).any()
    x, sizes = np.array([5, 7, 9, 2, 1, 8]), np.array([3, 1, 2])
    assert (suffix_tree.summed(suffix_tree.differences(x, np.array([0, 3, 4])), sizes) == x).all()


def test_packed_by_bits():
    """Numbers of any size come back, also those that a float rounds up; skewed ones take less than as byte planes, probabilities in order of tokens less again."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, 1 << 64, int(rng.integers(0, 2000)), np.uint64, endpoint=False) >> rng.integers(0, 64, 1).astype(np.uint64)
        x = np.append(x, np.array([0, 1, (1 << 53) - 1, (1 << 60) - 1, 1 << 63, (1 << 64) - 1], np.uint64)) if rng.random() < 0.5 else x << np.uint64(rng.integers(0, 9))
        assert (suffix_tree.unpack_counts(suffix_tree.pack_bits(x)).view(np.uint64) == x).all()
    for x in (np.zeros(3000, np.int64), np.ones(3000, np.int64)):
        assert (suffix_tree.unpack_counts(suffix_tree.pack_bits(x)) == x).all()
    for n, top in ((100, 50), (4000, 50), (4000, 1 << 20), (4000, 1 << 58)):
        symbols = np.exp(rng.uniform(0, math.log(top), n)).astype(np.int64)
        p = np.where(rng.random(n) < 0.1, 0, np.minimum(60 * np.log2(symbols + 2), 32767)).astype(np.int16)
        packed = suffix_tree.pack_bits(symbols), suffix_tree.pack_told(p, symbols)
        assert (suffix_tree.unpack_counts(packed[0]) == symbols).all() and (suffix_tree.unpack_told(packed[1], symbols) == p).all()
        assert (suffix_tree.ascending(symbols) == np.argsort(symbols, kind="stable")).all()
        assert n < suffix_tree.CODED or len(packed[1]) < 0.6 * len(wordblocks.pack(p))
        assert n < suffix_tree.CODED or top != 1 << 20 or len(packed[0]) < 0.95 * len(suffix_tree.pack_counts(symbols))


def test_spelt_contexts():
    """Contexts sent as their tokens come back and are told apart, also where a context is dealt by next token or its numbers don't fit 63 bits; they take less than hashes."""
    rng = np.random.default_rng(4)
    for level, top, n in ((1, 1 << 20, 3000), (2, 1 << 20, 3000), (3, 1 << 20, 3000), (3, 1 << 40, 3000), (2, 9, 40), (1, 2, 1)):
        rows = np.unique(np.exp(rng.uniform(0, math.log(top), (n, level))).astype(np.int64), axis=0)
        rows = rows[np.sort(np.append(np.arange(len(rows)), 0))]
        dealt = np.where(rng.random(len(rows)) < 0.02, rng.integers(0, 1 << 62, len(rows)) | 1, 0).astype(np.uint64)
        dealt[:2] = 5, 7
        columns = [rows[:, i] for i in range(level)]
        data = suffix_tree.pack_spelt(columns, dealt)
        back, parts = suffix_tree.unpack_spelt(data, level)
        assert all((a == b).all() for a, b in zip(columns, back)) and len(back) == level and (parts == dealt).all()
        keys = suffix_tree.told_apart(back, parts)
        assert len(set(keys.tolist())) == len(rows) and ((keys & np.uint64(1)) == (dealt > 0)).all()
        if level == 3 and top == 1 << 20:
            hashes = np.sort(rng.integers(0, 1 << 64, len(rows), np.uint64))
            assert len(suffix_tree.pack_spelt(columns, dealt * np.uint64(0))) < 0.8 * len(wordblocks.pack(np.diff(hashes, prepend=np.uint64(0))))


def test_answers_move_after_questions(spark, monkeypatch):
    """No table is dealt by block in the job that asks, so that a level's questions and its dealt answers aren't kept together, and the texts are dealt in parts; words are numbered by falling counts."""
    passing, dealt, names, numbers = suffix_tree.passing, [], [], []

    @contextmanager
    def watched(session):
        with passing(session) as write:

            def note(df, name, **deal):
                if deal:
                    names.append(name)
                    dealt.append(df._jdf.queryExecution().optimizedPlan().toString())
                    numbers.extend(df.where("level = 0").select("b", "c").collect() if name == "found" and not numbers else [])
                return write(df, name, **deal)

            yield note

    monkeypatch.setattr(suffix_tree, "passing", watched)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert suffix_tree.scored(docs).count() == docs.count()
    assert names == ["found"] + ["texts"] * suffix_tree.PARTS + ["found"] * suffix_tree.AGAIN and suffix_tree.PARTS > 1
    assert not any("InArrow" in plan for plan in dealt)
    for r in numbers:
        counts, symbols = suffix_tree.unpack_counts(r.b), suffix_tree.unpack_counts(r.c)
        assert (np.diff(counts[np.argsort(symbols)]) <= 0).all()


def test_caps():
    """No context of fewer occurrences than `least` asks for passes or stays open, whatever follows it."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        level, k = int(rng.integers(1, 7)), int(rng.integers(1, 6))
        n, q = rng.integers(1, 1 << int(rng.integers(1, 9)), k).astype(float), rng.uniform(0, 30, k)
        more = n > 1
        cap = suffix_tree.capped(np.zeros(more.sum(), np.int64), n[more], -q[more], np.zeros(1, np.int64))[0]
        told = math.log2(suffix_tree.MU) * (~more).sum() + (n[more] * np.log2((n[more] - 1) * 2 ** q[more] + suffix_tree.MU)).sum()
        inside, stays = suffix_tree.verdict(level, n.sum(), told, suffix_tree.best_gain(n[more], -q[more]).sum())
        assert n.sum() >= suffix_tree.least(level)[cap] or (inside == 0 and not stays)


def test_what_open_tokens_keep():
    """A token in a context of few occurrences keeps the few tokens before it that a longer context could have, not all that the most frequent could."""
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(800):  # a short run whose next token five tokens tell, and fewer don't
        run = rng.integers(0, 2, 5).tolist()
        while len(run) < 12:
            run.append(sum(run[-5:]) % 2)
        texts.append([*rng.integers(20, 5000, 60).tolist(), *run, *rng.integers(20, 5000, 60).tolist()])
    seq, sizes = np.array([x for t in texts for x in t]), np.array([len(t) for t in texts])
    n = len(seq) + len(texts)
    model = suffix_tree.Model(n, len(texts), math.log2(n + 5001), 1, suffix_tree.SPLIT, 13)
    block = suffix_tree.Texts.start(list(range(800)), sizes, np.ones(800, bool), seq, np.arange(1, 5001), np.bincount(seq, minlength=5000), model)
    for level in range(1, 5):
        block.ask()
        asked = zip(*block.questions(1))
        found = suffix_tree.judged(level)(pa.table(dict(zip(("block", "bucket", "a", "b", "c", "d", "e"), ([0], *map(list, asked))))))
        block.take(*suffix_tree._given(found.append_column("level", pa.array([level] * len(found))), level), {})
    _, _, rest = block.rest(model)
    assert len(rest.open) and len(rest.tokens) < 800 * (12 + 10) < 800 * model.reach


def test_no_training_rows(spark):
    d = spark.createDataFrame([(i, "a b") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    got = suffix_tree.scored(d).collect()
    assert len(got) == d.count() and {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}
    assert suffix_tree.scored(d.limit(0)).count() == 0
