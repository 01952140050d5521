"""Comparisons of systems, splits, candidates, digests and fusion by hand."""

import math

import pytest

from reviewrec.operators import evaluate, factors, hybrid, sentiment
from reviewrec.operators import relational as R


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def fixed(spark, answers):
    """A system that gives each user the same items in order, whatever the seed."""
    table = spark.createDataFrame([(u, n + 1, i) for u, items in answers.items() for n, i in enumerate(items)], "user_id string, rank int, item_id string")
    return lambda seeds: seeds.select("user_id").join(table, "user_id")


def histories(spark):
    train = spark.createDataFrame([("u", "a", 1, 5.0), ("u", "b", 2, 5.0), ("v", "a", 1, 5.0), ("w", "c", 1, 5.0)], "user_id string, item_id string, timestamp int, rating double")
    test = spark.createDataFrame([("u", "x", 3, 5.0), ("v", "y", 3, 5.0), ("w", "z", 3, 5.0), ("new", "z", 3, 5.0)], "user_id string, item_id string, timestamp int, rating double")
    return train, test


def test_comparison_of_systems_by_hand(spark):
    train, test = histories(spark)
    good, poor = fixed(spark, {"u": ["q", "x"], "v": ["y"], "w": ["q"]}), fixed(spark, {"u": ["q"]})
    board = evaluate.compare_systems({n: evaluate.evaluate(f, train, test, 2, empty="skip") for n, f in (("good", good), ("poor", poor), ("silent", fixed(spark, {"nobody": ["x"]})))})
    got = {r.system: r for r in board.collect()}
    # u hits at rank 2, v at rank 1, w not at all; the unseeded user doesn't count
    assert got["good"].n_users == 3 and abs(got["good"].recall - 2 / 3) < 1e-6
    assert abs(got["good"].ndcg - (1 / math.log2(3) + 1) / 3) < 1e-6
    assert (got["poor"].n_users, got["poor"].recall) == (1, 0.0)
    assert (got["silent"].n_users, got["silent"].recall) == (0, None)
    assert {r.metric: r.winner for r in evaluate.metric_winners(board).collect()} == dict.fromkeys(evaluate.METRICS, "good")


def test_cold_start_deltas_by_hand(spark):
    train, test = histories(spark)
    masked = evaluate.mask_users(train, spark.createDataFrame([("v",)], "user_id string"))
    assert rows(masked, "user_id") == [("u",), ("u",), ("w",)]
    knows = lambda known: lambda seeds: fixed(spark, {"u": ["x"], "v": ["y"]})(seeds.join(known.select("user_id").distinct(), "user_id", "left_semi"))
    warm, cold = ({"s": evaluate.evaluate(knows(known), train, test, 1)} for known in (train, masked))
    delta = evaluate.cold_start_delta(evaluate.compare_systems(warm), evaluate.compare_systems(cold)).first()
    assert abs(delta.warm_recall - 2 / 3) < 1e-6 and abs(delta.cold_recall - 1 / 3) < 1e-6 and abs(delta.delta_recall + 1 / 3) < 2e-6


def test_random_split_is_a_partition_and_repeats(spark):
    df = spark.range(5000).selectExpr("cast(id AS string) AS user_id", "cast(id % 7 AS string) AS item_id")
    train, test = R.random_split(df, ["user_id", "item_id"])
    assert train.unionByName(test).exceptAll(df).isEmpty() and train.count() + test.count() == 5000
    assert 850 < test.count() < 1150
    again = R.random_split(df.repartition(7), ["user_id", "item_id"])[1]
    assert again.exceptAll(test).isEmpty() and again.count() == test.count()


def test_sampled_candidates(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(50)] * 2, "item_id string")
    test = spark.createDataFrame([("u", "i1"), ("v", "i2")], "user_id string, item_id string")
    seen = spark.createDataFrame([("u", f"i{k}") for k in range(40)], "user_id string, item_id string")
    got = rows(factors.sampled_candidates(test, items, seen, 30), "user_id", "item_id")
    mine, others = {i for u, i in got if u == "u"}, {i for u, i in got if u == "v"}
    assert len(got) == len(set(got)) and "i1" in mine and "i2" in others
    assert mine - {"i1"} <= {f"i{k}" for k in range(40, 50)} and len(others - {"i2"}) in (29, 30)
    assert mine - {"i1"} == others & {f"i{k}" for k in range(40, 50)} - ({"i1"} if "i1" in others else set())


def test_product_digest_by_hand(spark):
    long = "Good sound and strong bass for the price of it. " * 3 + "The cable broke within one week of rather light use at home."
    reviews = spark.createDataFrame([("a", long, 5.0, 1), ("a", "more words about the sound", 3.0, 2), ("a", "third", 1.0, 3), ("b", "short", 4.0, 1), ("b", "shorter", 4.0, 2), ("c", long, 2.0, 1)], "item_id string, text string, rating double, at int")
    got = {r.item_id: r for r in sentiment.product_digest(reviews, "text", ["at"], products=2).collect()}
    assert set(got) == {"a"}  # c isn't among the two most reviewed, b says too little
    assert got["a"].summary and all(s.strip() in long + " more words about the sound third" for s in got["a"].summary.split(". "))
    assert got["a"].n_reviews == 3 and got["a"].avg_rating == 3.0


def test_minmax_fusion(spark):
    found = spark.createDataFrame([("s", "i", 4.0, "content"), ("s", "j", 3.0, "content"), ("s", "k", 2.0, "content"), ("s", "j", 0.5, "cf"), ("s", "k", 0.1, "cf"), ("s", "k", 1.0, "rules"), ("t", "i", 7.0, "cf")], "seed_item string, item_id string, score double, source string")
    got = {(r.seed_item, r.item_id): (r.score, r.source) for r in hybrid.fuse(found, normalize="minmax").collect()}
    assert got == {("s", "i"): (0.35, "hybrid:content"), ("s", "j"): (0.625, "hybrid:cf"), ("s", "k"): (0.2, "hybrid:rules"), ("t", "i"): (0.45, "hybrid:cf")}
    with pytest.raises(ValueError):
        hybrid.fuse(found, normalize="other")


def test_bands_of_groups(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 0.3), (None, 5.0), (None, 9.0), ("one", 2.0), ("none", None)], "g string, s double")
    got = {(r.g, r.s): r.band for r in R.group_bands(df, "g", "s").collect()}
    assert got == {("a", 0.0): 0, ("a", 1.0): 3, ("a", 0.3): 1, (None, 5.0): 0, (None, 9.0): 3, ("one", 2.0): 0, ("none", None): got["none", None]}


def test_id_map_over_many_ranges(spark):
    ids = [f"k{n:03d}" for n in range(200)]
    df = spark.createDataFrame([(x,) for x in ids * 3] + [(None,)], "k string").repartition(9)
    assert rows(R.build_id_map(df, "k"), "id", "idx") == [(x, n) for n, x in enumerate(ids)]
    assert R.build_id_map(df.limit(0), "k").count() == 0


def test_candidates_are_lists(spark):
    """Nulls and users of several test rows as pairs would have them; no pair of a user and a sampled item is shuffled."""
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(f"i{k}",) for k in range(40)] + [(None,)], "item_id string")
    test = spark.createDataFrame([("u", "i1"), ("u", "i2"), ("v", None), (None, "i3"), ("w", "i4")], "user_id string, item_id string")
    seen = spark.createDataFrame([("u", f"i{k}") for k in range(30)] + [("w", None), (None, "i9"), ("x", "i1")], "user_id string, item_id string").repartition(3)
    some = R.sample_keys(items, "item_id", 20)
    pairs = test.select("user_id").distinct().crossJoin(some).join(seen.distinct(), ["user_id", "item_id"], "left_anti")
    want = test.select("user_id", "item_id").union(pairs.select("user_id", "item_id")).distinct()
    got = factors.sampled_candidates(test, items, seen, 20)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # lists are opened after the last shuffle


def test_scored_candidates_as_transform(spark):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1) / 5) for u in range(20) for i in range(30) if (u + i) % 3], "user_idx int, item_idx int, confidence float")
    model = factors.fit_als(ratings, 4, 3)
    lists = spark.createDataFrame([(u, [i for i in range(33) if (u * i) % 4]) for u in range(22)] + [(5, None)], "user_id int, items array<int>")
    sample = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 32)], "item_id int")
    pairs = lists.selectExpr("user_id AS user_idx", "explode(items) AS item_idx").distinct()
    want = factors.score_pairs(model.transform(pairs).selectExpr("user_idx AS user_id", "item_idx AS item_id", "cast(prediction AS double) AS score"), 4)
    key = lambda df: {(r.user_id, r["rank"]): r.score for r in df.collect()}
    for some in (sample, sample.limit(0)):
        got = key(factors.score_candidates(model, lists, some, 4))
        assert got.keys() == key(want).keys() and all(abs(got[at] - s) < 1e-6 for at, s in key(want).items())


def test_als_gives_shuffles_back(spark):
    """Of 20 iterations no more than a few shuffles are left when the session has a checkpoint folder."""
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1) / 5) for u in range(20) for i in range(30) if (u + i) % 3], "user_idx int, item_idx int, confidence float")
    params = factors.fit_als(ratings, 2, 2)._java_obj.parent().extractParamMap().toString()
    assert "checkpointInterval: 2" in params
