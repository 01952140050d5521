"""Pruned and fused search against scoring every item."""

import math
import random

import pytest

from reviewrec.operators import hybrid, retrieval, search
from reviewrec.sources.scratch import Scratch


def made(seed, n, dim=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["often", "rare"]
    docs = [(str(k), " ".join(rng.choice(words[: 10 + k % 50]) for _ in range(rng.randint(1, 30))) + (" often" if k % 2 else "")) for k in range(n)]
    vectors = [(str(k), [rng.gauss(0, 1) for _ in range(dim)]) for k in range(n // 3, n + n // 4)]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), [rng.gauss(0, 1) for _ in range(dim)]) for q in range(8)]
    queries += [(50, "often often w3", [1.0] * dim), (51, "unheard of", [0.5] * dim), (52, "", [0.1] * dim)]
    return docs, vectors, queries


def frames(spark, docs, vectors, queries):
    return (
        spark.createDataFrame(queries, "query_id long, query string, vector array<double>"),
        spark.createDataFrame(vectors, "item_id string, vector array<double>"),
        search.postings(spark.createDataFrame(docs, "item_id string, text string")),
    )


def plain(docs, vectors, queries, k=50, threshold=0.2, least=20):
    """From the definition: BM25 is scaled over all documents, similarity over all vectors."""
    tf = {i: {w: t.split().count(w) for w in t.split()} for i, t in docs if t.split()}
    n, length = len(tf), {i: sum(c.values()) for i, c in tf.items()}
    mean_length = sum(length.values()) / n
    df = {}
    for c in tf.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: low if x < 0 else x for w, x in raw.items()}
    unit = lambda xs, x: (x - min(xs)) / (max(xs) - min(xs) + 1e-9)
    out = []
    for q, text, vector in queries:
        bm = {i: sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * length[i] / mean_length)) for w in text.split() if w in c) for i, c in tf.items()}
        dots = {i: sum(x * y for x, y in zip(v, vector, strict=True)) for i, v in vectors}
        rows = []
        for i in dots:
            e, b = unit(dots.values(), dots[i]), unit(bm.values(), bm[i]) if i in bm else 0.0
            rows.append((-round(0.55 * e + 0.45 * b, 6), i, round(e, 6), round(b, 6)))
        rows.sort()
        above = [r for r in rows if -r[0] >= threshold]
        kept = above[:k] if len(above) >= least else rows[: max(least, k)]
        out += [(q, i, rank + 1, e, b, -s) for rank, (s, i, e, b) in enumerate(kept)]
    return out


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(x - y) < 2e-6 for a, b in zip(got, want, strict=True) for x, y in zip(a[3:], b[3:], strict=True))


@pytest.mark.parametrize("k, threshold, least", [(50, 0.2, 20), (5, 0.2, 3), (6, 0.9, 12)])
def test_hybrid_search_from_its_definition(spark, k, threshold, least):
    data = made(1, 90)
    same(search.hybrid_search(*frames(spark, *data), k, threshold, least).collect(), plain(*data, k, threshold, least))


def test_a_document_without_vector_sets_the_scale(spark):
    docs = [("1", "a a a b"), ("2", "a b c d e f"), ("3", "x y"), ("4", "z"), ("5", "q")]
    vectors = [("2", [1.0, 0.0]), ("3", [0.0, 1.0]), ("9", [0.6, 0.8])]
    queries = [(7, "a", [1.0, 0.0])]
    got = {r.item_id: r for r in search.hybrid_search(*frames(spark, docs, vectors, queries)).collect()}
    assert set(got) == {"2", "3", "9"} and 0 < got["2"].bm25_score < 0.8 and got["9"].bm25_score == 0
    assert abs(got["2"].hybrid_score - (0.55 + 0.45 * got["2"].bm25_score)) < 2e-6
    same(got.values(), plain(docs, vectors, queries))


def test_every_item_shares_a_term_and_negative_idf(spark):
    docs = [(str(k), "all " + "all " * (k % 3) + f"x{k}") for k in range(30)]
    vectors = [(str(k), [math.sin(k), math.cos(k)]) for k in range(40)]
    queries = [(1, "all", [1.0, 0.0]), (2, "x3 all", [0.0, 1.0])]
    same(search.hybrid_search(*frames(spark, docs, vectors, queries), 4, 0.5, 2).collect(), plain(docs, vectors, queries, 4, 0.5, 2))
    docs = [(str(k), "p q r" + (" s" if k == 3 else "")) for k in range(9)]
    same(search.hybrid_search(*frames(spark, docs, vectors, queries + [(3, "p s", [1.0, 1.0])]), 4, 0.5, 2).collect(), plain(docs, vectors, queries + [(3, "p s", [1.0, 1.0])], 4, 0.5, 2))


def test_lists_are_read_in_part(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    docs, vectors, queries = made(2, 600)
    # one more group of words for a few documents: a query for them has a clear head
    docs += [(str(k), "rare0 rare1 rare2 often") for k in range(2000, 2006)]
    vectors += [(str(k), [9.0, 0.0, 0.0, 0.0, 0.0]) for k in range(2000, 2006)]
    queries = [(1, "rare0 rare1 rare2 often", [1.0, 0.0, 0.0, 0.0, 0.0])]
    asked, items, posted = frames(spark, docs, vectors, queries)
    report = []
    got = retrieval.fused_top(asked, items, posted, 5, depth=8, report=report).collect()
    want = {r[1]: r for r in plain(docs, vectors, queries, 5)}
    assert {r.item_id for r in got} == set(want)
    (depth, open_, (read, present)), *others = report
    assert depth == 8 and open_ == 1 and not others and read < present / 2, report
    with Scratch(spark) as scratch:
        blocks, seen = retrieval.PostingBlocks(retrieval.impacts(posted), scratch), []
        top = blocks.top(retrieval.query_terms(asked), 4, report=seen).select("item_id", "rank").collect()
        assert sorted((r["rank"], r.item_id) for r in top) == [(1, "2000"), (2, "2001"), (3, "2002"), (4, "2003")] and seen[0][0] < seen[0][1]


def test_batch_search_keeps_each_requests_own_number(spark):
    data = made(5, 60)
    asked, items, posted = frames(spark, *data)
    wanted = {0: 3, 1: 0, 2: None, 3: 500}
    requests = asked.where("query_id < 4").join(spark.createDataFrame(list(wanted.items()), "query_id long, top_k int"), "query_id")
    got = {}
    for r in hybrid.batch_search(requests, items, posted).collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    full = {q: len([1 for r in plain(*data, 100) if r[0] == q]) for q in wanted}
    assert {q: sorted(r) for q, r in got.items()} == {q: list(range(1, min(full[q], n) + 1)) for q, n in {0: 3, 1: 1, 2: 10, 3: 100}.items()}


def test_empty_tables(spark):
    asked, items, posted = frames(spark, *made(3, 20))
    assert search.hybrid_search(asked.limit(0), items, posted).count() == 0
    assert search.hybrid_search(asked, items.limit(0), posted).count() == 0
    assert search.hybrid_search(asked, items, posted.limit(0)).where("bm25_score > 0").count() == 0
