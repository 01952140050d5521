import random

import pytest

from reviewrec.llm.common import Scratch
from reviewrec.llm import near
from reviewrec.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept string"


def shingles(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(raw[i : i + 5]) for i in range(len(raw) - 4)} if len(raw) >= 5 else ({tuple(raw)} if raw else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_token = {}
    for i, s in sets.items():
        for x in s:
            by_token.setdefault(x, []).append(i)
    seen = set()
    for ids in by_token.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def corpus(seed, n=150, group=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(1, 120)))
        if r.random() < 0.3:
            t += " " + passage
        rows.append(t)
    base = [r.choice(vocab) for _ in range(90)]
    for _ in range(group):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append(" ".join(w))
    for _ in range(40):
        w = r.choice(rows).split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(vocab).upper()
        rows.append("  ".join(w))
    rows += [None, "", " \n", "a b", "A  b", "a b c"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "size"), [(1, 32), (2, 4)])
def test_against_brute_force(spark, monkeypatch, seed, size):
    monkeypatch.setattr(near, "SMALL", size)
    rows = corpus(seed)
    got = near.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, "x")], SCHEMA)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect() if r.doc_id)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x"), (None, "g h i j k l m", "x"), (None, None, "x"), (1, "a b c d e f", "x")], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, None, True), (None, 3, None, True), (None, 0, None, True), (1, 2, 1, True)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[200] == got[150] == 100
