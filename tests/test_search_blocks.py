"""Scores, band centres and closeness by matrices are those of the vectors one by one, and no vector is opened into rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reviewrec.operators import search


def made(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 5)
    draw = random.Random(2)
    vec = lambda: [draw.uniform(-1, 1) for _ in range(4)]
    items = {f"i{k:02}": vec() for k in range(33)} | {"zero": [0.0] * 4}
    asked = {k: vec() for k in range(12)}
    scores = [(q, i, round(draw.random(), 6)) for q in asked for i in items if draw.random() < 0.7]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return items, asked, scores, frame(list(items.items()), "item_id string, vector array<double>"), frame(list(asked.items()), "query_id long, vector array<double>"), frame(scores, "query_id long, item_id string, hybrid_score double")


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def test_all_scores(spark, monkeypatch):
    items, asked, _, vectors, queries, _ = made(spark, monkeypatch)
    vectors = vectors.unionByName(spark.createDataFrame([("none", None)], vectors.schema))
    got = {(r.query_id, r.item_id): r.emb for r in search.score_vectors(queries, vectors).collect()}
    assert len(got) == 12 * 35
    assert all(got.pop((q, "none")) is None for q in asked)
    assert all(abs(s - sum(x * y for x, y in zip(asked[q], items[i], strict=True))) < 1e-12 for (q, i), s in got.items())
    assert search.score_vectors(queries.limit(0), vectors).count() == search.score_vectors(queries, vectors.limit(0)).count() == 0


def test_bands_without_opened_vectors(spark, monkeypatch):
    items, _, scores, vectors, _, results = made(spark, monkeypatch)
    monkeypatch.setattr(search, "mean_vectors", lambda *_: pytest.fail("a row for each component"))
    monkeypatch.setattr(search, "unit", lambda *_: pytest.fail("a vector a row"))
    got = search.score_band_cluster(results, vectors).collect()
    assert len(got) == len(scores)
    groups = {}
    for r in got:
        groups.setdefault((r.query_id, r.band), []).append(items[r.item_id])
    means = {g: [sum(c) / len(rows) for c in zip(*rows, strict=True)] for g, rows in groups.items()}
    assert all(abs(r.closeness - cosine(items[r.item_id], means[r.query_id, r.band])) < 1e-6 for r in got)


def test_personal_scores_without_vectors_a_row(spark, monkeypatch):
    items, asked, scores, vectors, queries, results = made(spark, monkeypatch)
    profiles = queries.where("query_id <> 3").select("query_id", F.col("vector").alias("profile"))
    monkeypatch.setattr(search, "unit", lambda *_: pytest.fail("a vector a row"))
    got = {(r.query_id, r.item_id): r.final_score for r in search.rerank(results, "personalized", profiles=profiles, vectors=vectors).collect()}
    near = {(q, i): cosine(asked[q], items[i]) for q, i, _ in scores}
    assert len(got) == len(scores)
    for q, i, s in scores:
        own = [c for (a, _), c in near.items() if a == q]
        want = s if q == 3 else 0.5 * s + 0.5 * (near[q, i] - min(own)) / (max(own) - min(own) + 1e-9)
        assert abs(got[q, i] - want) < 2e-6


