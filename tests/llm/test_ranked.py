"""Ranked search against scoring every document, and the trees' bounds."""

import math
import random
import re
from collections import Counter

import numpy as np

from reviewrec.llm import ranked as R

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    vectors = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    vectors = [v for v in vectors if v[2]]
    number, length = len(vectors), sum(n for *_, n in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    queries = {}
    for item, text in items:
        if item is not None:
            queries.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in queries.items():
        scores = []
        for i, c, n in vectors:
            if i is not None:
                m = 100 - 75 + (75 * n * number) // length
                s = sum(x * math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in q.items() if c[t])
                if s > 0:
                    scores.append((-s, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    common = ["The", "of", "X9"]
    sentence = lambda m: " ".join(rng.choice(common) if rng.random() < 0.3 else words[int(150 * rng.random() ** 2)] for _ in range(m))
    items = [(k, sentence(rng.randint(1, 25))) for k in range(12)]
    docs = [(i, sentence(rng.choice([1, 5, 30, 120]))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(n // 3)] + [(2 * n + i, docs[1][1] + ", " + items[i % 3][1].upper()) for i in range(20)]
    docs += [(None, items[0][1]), (7, docs[7][1]), (5000, None), (5001, ""), (5002, "... --"), (-3, "long " * 30_000 + items[1][1])]
    items += [(3, "another part of x9"), (None, "the"), (90, None), (91, "!!"), (92, "unheardof"), (93, "the THE the")]
    rng.shuffle(docs)
    return docs, items


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "QUERY_BYTES", 600)
    docs, items = made(3, 400)
    got = R.ranked_search(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_fewer_than_k_and_odd_tables(spark):
    docs, items = made(4, 6)
    df, asked = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", n int, terms string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, R.ranked_search(df, asked, 60).collect())) == brute(docs, items, 60)
    assert R.ranked_search(df.limit(0), asked).count() == 0
    assert R.ranked_search(df, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    n, vocabulary = 2000, 300
    topic = np.sort(rng.integers(0, 20, n))
    own = [np.unique(np.append(rng.integers(0, vocabulary, 1), t * 15 + rng.integers(0, 15, 6))) for t in topic]
    start = np.append(0, np.cumsum([len(x) for x in own]))
    block = R.Block.built(np.arange(n), start, np.concatenate(own), rng.integers(400_000, 600_000, start[-1]))
    block = R.Block.read(dict(zip(R._ARRAYS, block.written(), strict=True)))
    dense = np.zeros((n, len(block.vocabulary)), object)
    for d in range(n):
        dense[d, block.terms[block.start[d] : block.start[d + 1]]] = [int(x) for x in block.impacts[block.start[d] : block.start[d + 1]]]
    for t in range(5):
        weights = np.zeros(vocabulary, np.int64)
        weights[t * 15 : t * 15 + 8] = rng.integers(1, 30_000, 8)
        query = weights[block.vocabulary]
        scores = dense @ query.astype(object)
        for node in range(len(block.first)):
            most = max(scores[block.first[node] : block.past[node]])
            assert most <= block.bound(node, query)
        found = []
        scored = R.best_first([block], weights, 10, found, None)
        assert found == sorted((-s, int(i)) for s, i in zip(scores, block.ids, strict=True) if s > 0)[:10]
        assert scored < n / 2


def test_same_as_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, R.op12_ranked_search(spark, sf).collect())) == sorted(con.execute(R.OP12_SQL).fetchall())
