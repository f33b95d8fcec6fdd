"""The trie of conversations against all prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

from clausewise.llm import burst_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, head string, top int"


def brute(rows):
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for x in turns.values():
        x.sort()
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = [(t[2], t[4]) for t in turns.get(base, [])[:h] + own[h:]]
    nodes: dict = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children: dict = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in nodes[p] if len(built[c]) == len(p))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in nodes.items()), key=str)


def made(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"text {i} " * int(rng.integers(1, 4)) for i in range(6)] + ["é", "😀 b", None, ""]
    rows = []
    for conv in rng.choice(np.arange(-250, 900), 120, replace=False).tolist():
        for t in range(int(rng.integers(1, 12))):
            rows.append((conv, int(t) if rng.random() < 0.95 else None, str(rng.choice(["user", "assistant"])) if t else "system", str(rng.choice(vocab[:8])) if t > 2 else vocab[t % 2]))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(40) for t in range(9)]
    rows += [(2000 + c, t, "user", f"long {t}" if t < 30 + c % 3 else f"own {c}") for c in range(12) for t in range(34)]
    rows += [(5, 1, None, None), (5, 1, "", ""), (5, None, "a", "b"), (5, 1, "z", "t"), (5, 1, "z", "s"), (None, 1, "user", "x"), (3001, 0, "user", "only")]
    return rows + rows[:7]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,limit,packed", [(1, 64, 8192), (2, 1, 2), (3, 4, 1)])
def test_against_all_prefixes(spark, monkeypatch, seed, limit, packed):
    monkeypatch.setattr(burst_trie, "PACKED", packed)
    rows = made(seed)
    got = sorted((tuple(r) for r in burst_trie.nodes(frame(spark, rows), limit).collect()), key=str)
    assert got == brute(rows)


def test_long_conversation(spark):
    """Turns of one conversation are numbered over many partitions."""
    rows = [(100, t, "user", f"turn {t % 50}") for t in range(3000)] + [(101, t, "user", f"turn {t % 50}") for t in range(2999)]
    got = sorted((tuple(r) for r in burst_trie.nodes(frame(spark, rows), 1).collect()), key=str)
    assert got == brute(rows)


def test_nothing(spark):
    out = burst_trie.nodes(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[0] == "conv_id"
    assert burst_trie.nodes(spark.createDataFrame([(None, 1, "a", "b", "x", 1)], SCHEMA)).count() == 0
    # a conversation without turns of its own after its first h, and no first of its hundred
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = burst_trie.nodes(frame(spark, [(turnless, 0, "user", "x")])).collect()
    assert [tuple(r)[:7] for r in got] == [(turnless, 0, None, 1, 0, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(str(turnless).encode()).hexdigest()


def test_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_burst_trie(spark, folder).collect()), key=str) == brute(rows)


def test_sql(spark):
    """The SQL of the registered query, on rows with ties, nulls and long copies."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    frame_ = pd.DataFrame(made(1), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("rows", frame_)
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM rows")
    assert sorted(con.execute(queries.ORACLE_SQL["op12_burst_trie"]).fetchall(), key=str) == brute(made(1))
