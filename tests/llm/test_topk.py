import random

import duckdb

from reviewrec.llm import topk


def brute(items, queries, k):
    out = []
    for q, v in queries:
        rows = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in items if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(rows[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARE", 40)
    r = random.Random(1)
    items = [(i, [r.choice([0, 0, 1, -2, 3]) for _ in range(6)]) for i in range(150)] + [(900 + i, [1, 1, 1, 1, 1, 1]) for i in range(30)]
    queries = [x for x in items if x[0] % 10 == 0]
    schema = "id long, v array<long>"
    got = topk.exact_top_k(spark.createDataFrame(items, schema), spark.createDataFrame(queries, schema), 7)
    assert sorted(map(tuple, got.collect())) == brute(items, queries, 7)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"


def test_edges(spark):
    schema = "id long, v array<long>"
    items = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [None, 1]), (None, [1, 1]), (4, [5]), (5, []), (100, [1, 1]), (6, [1, 2])], schema)
    got = topk.exact_top_k(items, items.where("id = 100 or id = 2"), 10).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 4, 5), (2, 1, 3), (3, 6, 3), (4, 5, 0)]
    assert topk.exact_top_k(items.limit(0), items, 3).count() == 0
    assert topk.exact_top_k(items, items.limit(0), 3).count() == 0


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op6_exact_topk(spark, sf).collect())) == sorted(con.execute(topk.OP6_SQL).fetchall())
