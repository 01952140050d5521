"""A search without a wanted number gives all that reach the threshold."""

from reviewrec.operators import search

from .test_retrieval import frames, made, plain, same


def test_all_hits_stay(spark):
    data = made(1, 90)
    want = plain(*data, 10**6, 0.2, 20)
    got = search.hybrid_search(*frames(spark, *data), all_hits=True).collect()
    for q in {r[0] for r in want}:
        hits = [r for r in want if r[0] == q and r[5] >= 0.2]
        own = [r for r in want if r[0] == q]
        same([r for r in got if r[0] == q], hits if len(hits) >= 20 else own[:50])
    assert max(r["rank"] for r in got) > 50
