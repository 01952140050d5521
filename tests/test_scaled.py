"""Quantiles, masked and indexed products, and the linear SVM against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewrec.operators import factors, sentiment, svm, vectors
from reviewrec.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_as_percentile(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, -0.5, 3.25, rng.gauss(0, 9), float(rng.randint(0, 5))])) for _ in range(700)]
    rows += [("hot", 1, 7.0)] * 900 + [("one", 1, 4.5), ("none", 1, None), ("two", 1, 1.0), ("two", 1, 2.0)]
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(5)
    shares = {"least": 0.0, "q1": 0.25, "middle": 0.5, "q9": 0.9, "most": 1.0}
    want = df.where("x is not null").groupBy("a", "b").agg(*(F.percentile("x", q).alias(n) for n, q in shares.items()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, exact_quantiles(df, ["a", "b"], "x", shares).collect())) == sorted(map(key, want.collect()))
    whole = df.agg(*(F.percentile("x", q).alias(n) for n, q in shares.items())).first()
    assert exact_quantiles(df, [], F.col("x"), shares).collect() == [whole]
    assert exact_quantiles(df.where("x is null"), [], "x", {"m": 0.5}).collect()[0].m is None
    assert exact_quantiles(df.limit(0), ["a"], "x", {"m": 0.5}).count() == 0


def test_masked_products(spark, monkeypatch):
    """Rows that saw nearly everything, over many blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 6)
    rng = random.Random(3)
    items = [(f"i{k}", [float(rng.randint(-3, 3)) for _ in range(3)]) for k in range(40)]
    users = [(str(k), [float(rng.randint(-3, 3)) for _ in range(3)]) for k in range(15)]
    seen = [(u, i) for n, (u, _) in enumerate(users) for i, _ in items if rng.random() < n / 14] + [("0", "absent"), ("absent", "i1"), ("3", None)] * 2
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = vectors.top_products(make(items, "item_id string, vector array<double>"), make(users, "query string, vector array<double>"), 5, None, without=make(seen, "query string, item_id string"))
    found = sorted((r.query, r["rank"], r.item_id, r.score) for r in got.collect())
    want = []
    for u, v in users:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in items if (u, i) not in set(seen))[:5]
        want += [(u, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found == sorted(want)


def test_als_top_k_by_brute_force(spark):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1) / 5) for u in range(20) for i in range(30) if (u + i) % 3], "user_idx int, item_idx int, confidence float")
    seen = ratings.select(F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id"))
    model = factors.fit_als(ratings, 4, 3)
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in factors.recommend_als(model, spark.createDataFrame([(0,), (7,), (99,), (7,)], "user_id int"), seen, 5).collect()}
    of_users, of_items = ({r[0]: np.array(r[1]) for r in t.collect()} for t in factors.factor_tables(model))
    assert len(got) == 10
    for u in (0, 7):
        best = sorted(((-float(of_users[u] @ v), str(i)) for i, v in of_items.items() if (u + i) % 3 == 0))[:5]
        assert [got[u, n + 1][0] for n in range(5)] == [int(i) for _, i in best]
        assert all(abs(got[u, n + 1][1] + s) < 1e-9 for n, (s, _) in enumerate(best))


def test_inverted_file_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (25, 16))
    points = centres[rng.integers(0, 25, 1500)] + rng.normal(0, 0.35, (1500, 16))
    points[1000:] = points[0]  # a third are copies
    points /= np.linalg.norm(points, axis=1)[:, None]
    df = spark.createDataFrame([(f"{k:04d}", p.tolist()) for k, p in enumerate(points)] + [("none", None)], "item_id string, vector array<double>")
    asked = df.where("item_id < '0200'").withColumnRenamed("item_id", "query")
    exact = {(r.query, r.item_id) for r in vectors.top_products(df, asked, 10).collect()}
    found = {(r.query, r.item_id) for r in vectors.near_products(df, asked, 10, probes=6).collect()}
    assert len(found) == len(exact) == 2000
    assert len(found & exact) / len(exact) >= 0.95
    few = vectors.near_products(df, asked, 400, probes=1)  # more than most cells hold
    assert few.count() == 200 * 400
    every = {(r.query, r.item_id) for r in vectors.near_products(df, asked, 10, probes=38, cells=38).collect()}
    assert every == exact
    assert vectors.near_products(df.limit(0), asked, 10).count() == 0 and vectors.near_products(df, asked.limit(0), 10).count() == 0


def test_slopes_and_minimum():
    rng = np.random.default_rng(2)
    dense = rng.normal(0, 1, (60, 7)) * (rng.random((60, 7)) < 0.5)
    row, places = np.nonzero(dense)
    start, label, cost = np.searchsorted(row, np.arange(61)), rng.integers(0, 3, 60), rng.random(60) + 0.5
    f = lambda w: (lambda loss, slope: (0.5 * (w * w).sum() + loss, w + slope))(*svm.loss_and_slope(w, start, places, dense[row, places], label, cost))
    w = rng.normal(0, 1, (3, 8))
    for c in range(3):
        for k in range(8):
            d = np.zeros_like(w)
            d[c, k] = 1e-6
            assert abs((f(w + d)[0] - f(w - d)[0]) / 2e-6 - f(w)[1][c, k]) < 1e-4
    best = svm.minimised(f, np.zeros((3, 8)), 200, 1e-9)
    assert np.abs(f(best)[1]).max() < 1e-6
    # plain loops agree on the value
    value = 0.5 * (best**2).sum() + sum(cost[n] * max(0, 1 - (1 if label[n] == c else -1) * (dense[n] @ best[c, :-1] + best[c, -1])) ** 2 for n in range(60) for c in range(3))
    assert abs(value - f(best)[0]) < 1e-9


def test_svm_is_as_good_as_the_librarys(spark):
    """Held-out macro F1 on texts of unequal classes with noise words."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    rng = random.Random(4)
    own = {0.0: ["awful", "broke", "refund"], 1.0: ["average", "okay", "fine"], 2.0: ["great", "love", "perfect"]}
    noise = [f"word{k}" for k in range(80)]
    rows = []
    for k in range(400):
        label = rng.choices([0.0, 1.0, 2.0], [0.15, 0.15, 0.7])[0]
        other = rng.choice([0.0, 1.0, 2.0])
        rows.append((k, " ".join(rng.choices(noise, k=12) + rng.choices(own[label], k=2) + rng.choices(own[other], k=1)), label))
    rows += [(1000, "", 1.0), (1001, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    train, test = sentiment.stratified_split(df, "label", "id")
    vocabulary = svm.fit_vocabulary(df, "id", "text", 500).cache()
    assert vocabulary.count() == 500
    f1 = lambda predicted: {r["class"]: r.f1 for r in sentiment.classification_report(predicted).collect()}["macro"]
    predicted = svm.fit_svm(train, "id", "text", "label", vocabulary).transform(test)
    assert predicted.count() == test.count() and predicted.columns == [*test.columns, "prediction"]
    ours = f1(predicted)

    def theirs_rows(part):
        sparse = svm.tfidf_rows(part, "id", "text", vocabulary).join(part.select("id", "label"), "id").collect()
        return spark.createDataFrame([(r.label, Vectors.sparse(500, list(r.places), list(r.weights))) for r in sparse], StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))

    theirs = f1(OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01)).fit(theirs_rows(train)).transform(theirs_rows(test)))
    assert ours >= theirs and ours > 0.7, (ours, theirs)


def test_tfidf_rows_are_the_tables(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "x"), (4, None)], "id long, text string")
    vocabulary = svm.fit_vocabulary(df, "id", "text", 4)
    names = {r.idx: r.term for r in vocabulary.collect()}
    rows = {r.id: {names[p]: w for p, w in zip(r.places, r.weights, strict=True)} for r in svm.tfidf_rows(df, "id", "text", vocabulary).collect()}
    want = {(r.id, r.term): r.weight for r in sentiment.tfidf(df, "id", "text", 4).collect()}
    assert {(k, t) for k, r in rows.items() for t in r} == set(want) and all(abs(want[k, t] - w) < 1e-12 for k, r in rows.items() for t, w in r.items())
    assert rows[3] == rows[4] == {}


def test_products_are_sent_by_bands(spark, monkeypatch):
    """Many blocks of items and queries: no row holds a block, and a cell's best leave it already merged. Ids twice, ties and own ids go as before."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = random.Random(8)
    items = [(f"i{k:03d}", [float(rng.randint(-2, 2)) for _ in range(2)]) for k in range(300)] + [("i007", [2.0, 2.0]), ("none", None), (None, [9.0, 9.0])]
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} string, vector array<double>").repartition(3)
    sent = []
    plain = vectors._best
    monkeypatch.setattr(vectors, "_best", lambda rows, tasks, *rest: (sent.append((rows, tasks)), plain(rows, tasks, *rest))[1])
    got = vectors.top_products(make(items, "item_id"), make(items[:150], "query"), 7, None, least=True).collect()
    rows, tasks = sent[0]
    bands = lambda side: rows.where(f"side = {side}").groupBy("id").count().agg({"count": "max"}).first()[0]
    assert rows.schema["vector"].dataType.simpleString() == "array<double>" and rows.where("size(vector) > 2").isEmpty()
    assert tasks <= 12 and bands(vectors.ASKED) <= 3 and bands(vectors.ITEM) <= 2 * 2
    sound = [(i, v) for i, v in items if i is not None and v is not None]
    for q, v in sound[:150]:
        best = sorted((-(v[0] * w[0] + v[1] * w[1]), i) for i, w in sound if i != q)[:7]
        assert sorted((-r.score, r.item_id) for r in got if r.query == q and r.item_id) == best
        assert [r.score for r in got if r.query == q and not r.item_id] == [min(v[0] * w[0] + v[1] * w[1] for _, w in sound)]
