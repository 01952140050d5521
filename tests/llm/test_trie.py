"""The trie against a dictionary of prefixes; extents against a scan."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reviewrec.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, exchange):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    if not exchange:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = lambda c: c - (abs(c) % 5) * (1 if c > 0 else -1)
    return {c: own.get(base(c), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def brute(rows, exchange=True):
    convs = rebuilt(rows, exchange)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(node), members[node[:-1]][0] if node else -1, len(m), len(children[node]), leaves[node], saved[node], sha(ends.get(node, []))) for node, m in members.items()
    )


def found(df, exchange=True):
    rows = trie.conversation_trie(df, exchange).select(*COLUMNS).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def made(seed, convs, most, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(-8, convs - 8):
        copied = rng.random() < 0.4
        r = random.Random(rng.choice([1, 2, 3])) if copied else rng
        for turn in range(r.choice([1, 2, 5, most])):
            rows.append((c, turn * 2, r.choice(["user", None]), "é" * r.randint(1, words) if r.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("exchange", [True, False])
def test_same_as_brute_force(spark, seed, exchange):
    rows = made(seed, 120, 20)
    rows += [(3, None, "user", "first"), (3, None, "user", "second"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "x", "y"), (1000, 0, "", ""), (2**62, 5, "user", "far")]
    random.Random(seed).shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), exchange) == brute(rows, exchange)


def test_long_conversations_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    monkeypatch.setattr(trie, "AT_ONCE", 10)
    monkeypatch.setattr(trie, "ROWS", 7)
    rows = made(7, 60, 23, words=1)
    turns = [("user", "same words")] * 12
    rows += [(c, t, *turn) for c in range(200, 230) for t, turn in enumerate(turns[: 4 + c % 9])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA), False) == brute(rows, False)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    # h of 7 is 8 or less, and 5 is absent: its own first turns go and nothing comes
    turnless = [(c, 0, "user", "x") for c in range(1, 5)]
    assert found(spark.createDataFrame(turnless, SCHEMA)) == brute(turnless)
    extra = spark.createDataFrame([(0, 0, "user", "x", "p", 9), (1, 0, "user", "x", "q", 9)], SCHEMA + ", digest string, position int")
    assert found(extra, False) == brute([(0, 0, "user", "x"), (1, 0, "user", "x")], False)


def test_extents():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 17, 64, 100]:
        h = rng.integers(0, 5, n)
        at, depth = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        left, right = trie.extents(trie.sparse_table(h[1:]), at, depth)
        for i, d, a, b in zip(at, depth, left, right, strict=True):
            lo = hi = i
            while lo > 0 and h[lo] >= d:
                lo -= 1
            while hi + 1 < n and h[hi + 1] >= d:
                hi += 1
            assert (a, b) == (lo, hi)
        assert (trie.least(trie.sparse_table(h), left, right) == [h[a : b + 1].min() for a, b in zip(left, right, strict=True)]).all()


def test_same_as_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(tuple(-1 if x is None else x for x in r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.OP11_SQL})").fetchall())
    assert want == brute(rows)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in trie.op11_prefix_trie(spark, sf).collect()) == want
