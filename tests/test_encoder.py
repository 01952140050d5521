"""The text encoder: passes against dense algebra, planted topics as neighbours."""

import random

import numpy as np

from reviewrec.operators import encoder, search, vectors
from reviewrec.operators.svm import tfidf_rows


def test_products_of_sparse_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (30, 9)) * (rng.random((30, 9)) < 0.4)
    x[5] = 0
    row, places = np.nonzero(x)
    start, q = np.searchsorted(row, np.arange(31)), rng.normal(0, 1, (9, 4))
    assert np.allclose(encoder.times(start, places, x[row, places], q), x @ q)
    assert np.allclose(encoder.twice(start, places, x[row, places], q), x.T @ x @ q)


def topics(n, seed=2):
    rng = random.Random(seed)
    own = {t: [f"{t}{k}" for k in range(12)] for t in "abcd"}
    noise = [f"noise{k}" for k in range(25)]
    return [(f"{'abcd'[k % 4]}-{k:03d}", " ".join(rng.sample(own["abcd"[k % 4]], 4) + rng.choices(noise, k=3))) for k in range(n)]


def test_directions_are_the_leading_ones(spark):
    df = spark.createDataFrame(topics(80), "item_id string, text string")
    found = encoder.fit_encoder(df, "item_id", "text", 4)
    x = np.zeros((80, found.vocabulary.count()))
    for n, r in enumerate(tfidf_rows(df, "item_id", "text", found.vocabulary).collect()):
        x[n, list(r.places)] = r.weights
    # no other four directions hold more of the rows
    assert np.allclose(found.directions.T @ found.directions, np.eye(4))
    assert ((x @ found.directions) ** 2).sum() > 0.95 * (np.linalg.svd(x)[1][:4] ** 2).sum()
    again = encoder.fit_encoder(df.repartition(7), "item_id", "text", 4)
    assert np.allclose(again.directions, found.directions, atol=1e-9)


def test_topics_are_neighbours(spark):
    """Most texts share no term with most others of their topic; users' texts land among the items they name."""
    df = spark.createDataFrame([*topics(160), ("none", None), ("z-empty", ""), (None, "a1")], "item_id string, text string")
    found = encoder.fit_encoder(df, "item_id", "text", 8)
    made = search.embed_text(df, "text", encoder=found).cache()
    got = {r.item_id: r.vector for r in made.collect()}
    assert len(got) == 162 and all(x == 0 for k in ("none", "z-empty") for x in got[k])
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for k, v in got.items() if k[0] in "abcd")
    items = made.where("text <> ''").select("item_id", "vector")
    near = vectors.top_products(items, items.withColumnRenamed("item_id", "query"), 5).collect()
    assert sum(r.query[0] == r.item_id[0] for r in near) > 0.95 * len(near) == 0.95 * 800
    reviews = spark.createDataFrame([(f"u{t}", f"{t}{k} {t}{k + 1}", 5.0, k) for t in "abcd" for k in range(6)], "user_id string, title string, rating double, at int")
    users = search.user_profiles(reviews, "title", ["at"], encoder=found)
    near = vectors.top_products(items, users.select("user_id", "vector").withColumnRenamed("user_id", "query"), 5).collect()
    assert len(near) == 20 and all(r.query[1] == r.item_id[0] for r in near)


def test_without_terms(spark):
    df = spark.createDataFrame([("x", ""), ("y", None)], "item_id string, text string")
    assert [list(r.vector) for r in search.embed_text(df, "text").collect()] == [[], []]
    assert search.embed_text(df.limit(0), "text").count() == 0
