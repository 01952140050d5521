"""Formulas by hand, and properties of the operators that SQL can't express."""

import math

from pyspark.sql import functions as F

from reviewrec.functions import columns as C
from reviewrec.operators import baskets, content, evaluate, experiments, factors, hybrid, itemcf, search, sentiment
from reviewrec.operators import relational as R
from reviewrec.plans import catalogue
from reviewrec.sources import scratch, tables


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_ranking_metrics_by_hand(spark):
    recs = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("v", 1, "z")], "user_id string, rank int, item_id string")
    truth = spark.createDataFrame([("u", "b"), ("u", "c"), ("u", "x"), ("v", "y"), ("w", "q")], "user_id string, item_id string")
    got = {r.user_id: r for r in evaluate.ranking_metrics(recs, truth, 3).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    assert abs(got["u"].ndcg - dcg / (1 + 1 / math.log2(3) + 1 / math.log2(4))) < 1e-12
    assert abs(got["u"].recall - 2 / 3) < 1e-12 and abs(got["u"].precision - 2 / 3) < 1e-12
    assert abs(got["u"].first_hit_dcg - 1 / math.log2(3)) < 1e-12
    assert got["v"].hit_rate == 0 and got["v"].answered and not got["w"].answered
    assert evaluate.averaged(evaluate.ranking_metrics(recs, truth, 3)).first().n_users == 3
    assert evaluate.averaged(evaluate.ranking_metrics(recs, truth, 3), "skip").first().n_users == 2


def test_rules_by_hand(spark):
    b = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "c"]), (4, ["b", "c"])], "key int, items array<string>")
    got = {(r.antecedent, r.consequent): r for r in baskets.pair_rules(b, 0.1, 0.0).collect()}
    assert got["a", "b"].support == 0.5 and abs(got["a", "b"].confidence - 2 / 3) < 1e-12 and abs(got["a", "b"].lift - 2 * 4 / 9) < 1e-12
    assert abs(got["a", "b"].lift - got["b", "a"].lift) < 1e-12
    deep = baskets.one_to_one_rules(baskets.association_rules(b, 0.1, 0.0)).collect()
    assert {(r.antecedent, r.consequent) for r in deep} == set(got)


def test_fusion_and_paths(spark):
    found = spark.createDataFrame([("s", "i", 1.0, "rules"), ("s", "i", 0.5, "cf"), ("s", "j", 4.0, "content"), ("s", "k", 0.2 / 0.45, "cf"), ("s", "k", 1.0, "rules")], "seed_item string, item_id string, score double, source string")
    got = {r.item_id: (r.score, r.source) for r in hybrid.fuse(found).collect()}
    assert got == {"i": (0.425, "hybrid:cf"), "j": (1.4, "hybrid:content"), "k": (0.4, "hybrid:rules")}
    train = spark.createDataFrame([("u", "a")], "user_id string, item_id string")
    counts = spark.createDataFrame([("a", 5), ("b", 2)], "item_id string, n_reviews long")
    asked = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "zz"), ("x", "a")], "user_id string, seed_item string")
    assert rows(hybrid.route(asked, train, counts, 3), "user_id", "seed_item", "path") == [("u", "a", "warm"), ("u", "b", "cold_item"), ("u", "zz", "cold_item"), ("x", "a", "cold_user")]
    assert rows(hybrid.route(asked, train, counts, 1).where("seed_item = 'b'"), "path") == [("warm",)]


def test_similarity_properties(spark, sf):
    from reviewrec.sources.fixtures import Views

    v = Views(spark, sf)
    sims = itemcf.item_similarity(itemcf.center_ratings(R.rating_cells(v.interactions()))).cache()
    assert sims.where("abs(sim) > 1 + 1e-9 or item_id = neighbor_id").isEmpty()
    back = sims.select(F.col("item_id").alias("neighbor_id"), F.col("neighbor_id").alias("item_id"), F.col("sim").alias("other"))
    assert sims.join(back, ["item_id", "neighbor_id"]).where("abs(sim - other) < 1e-12").count() == sims.count()
    train, test = R.leave_last_out(v.interactions())
    assert train.count() + test.count() == v.interactions().count() and test.count() == test.select("user_id").distinct().count()


def test_columns(spark):
    df = spark.createDataFrame([(None, "from 34.00", "See http://x.y NOW!", 3.0), (2.0, "none", None, 0.3)], "r double, p string, t string, c double")
    got = df.select(C.sentiment_label("r").alias("l"), C.parse_price("p").alias("p"), C.clean_text("t").alias("t"), C.confidence_bucket("c").alias("b")).collect()
    assert tuple(got[0]) == (None, 34.0, "see now", None) and tuple(got[1]) == ("negative", None, None, "low")
    lists = spark.createDataFrame([("['a', 'b']", {"k": "v"})], "l string, m map<string,string>")
    assert lists.select(C.parse_list("l").alias("l"), C.flat_map("m").alias("m")).first() == (["a", "b"], "k v")
    bands = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "s double").select(C.band(F.col("s"), F.lit(0.0), F.lit(1.0), 4).alias("b"))
    assert [r.b for r in bands.collect()] == [0, 1, 3]


def test_sparse_columns_and_imputation(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 4.0), (3, 1.0, 8.0)], "id int, a double, b double")
    assert R.drop_sparse_columns(df).columns == ["id", "b"] and R.drop_sparse_columns(df, keep=["a"]).columns == ["id", "a", "b"]
    assert rows(R.impute(df, {"a": 0.0, "b": "mean"}), "id", "a", "b") == [(1, 0.0, 6.0), (2, 0.0, 4.0), (3, 1.0, 8.0)]
    assert R.drop_sparse_columns(df.limit(0)).columns == df.columns


def test_content_seed_is_left_out(spark):
    best = spark.createDataFrame([(str(i), float(i)) for i in range(20)], "item_id string, score double")
    seeds = spark.createDataFrame([("19",), ("0",)], "seed_item string")
    got = content.recommend_by_content(best, seeds, 3).collect()
    assert sorted((r.seed_item, r.rank, r.item_id) for r in got) == [("0", 1, "19"), ("0", 2, "18"), ("0", 3, "17"), ("19", 1, "18"), ("19", 2, "17"), ("19", 3, "16")]


def test_bm25_negative_idf(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "a c"), ("3", "a d d")], "item_id string, text string")
    got = {(r.query_id, r.item_id): r.bm25 for r in search.bm25(search.postings(docs), spark.createDataFrame([(1, "a a"), (2, "d")], "query_id int, query string")).collect()}
    raw = {"a": math.log(0.5) - math.log(3.5), **{t: math.log(2.5) - math.log(1.5) for t in "bcd"}}
    mean = sum(raw.values()) / 4
    length = 7 / 3
    want = 2 * 0.25 * mean * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / length))
    assert abs(got[1, "1"] - want) < 1e-12
    assert abs(got[2, "3"] - raw["d"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / length))) < 1e-12


def test_runs(spark):
    path = scratch.scratch_path(spark, "log")
    experiments.log_run(spark, path, "1", "als", {"rank": 8}, {"ndcg": 0.5}, 10)
    experiments.log_run(spark, path, "2", "als", {"rank": 16}, {"ndcg": 0.7}, 20)
    experiments.log_run(spark, path, "3", "als", {"rank": 16}, {"ndcg": 0.9}, 30, status="FAILED")
    experiments.log_run(spark, path, "4", "cf", {}, {"recall": 0.1}, 5)
    runs = spark.read.parquet(path)
    board = experiments.leaderboard(experiments.latest_runs(runs), ["ndcg", "recall"])
    assert rows(board, "rank", "run_name", "ndcg") == [(1, "als", 0.7), (2, "cf", None)]
    assert experiments.param_table(experiments.latest_runs(runs), ["rank", "absent"]).columns == ["run_name", "rank"]
    expected = spark.createDataFrame([("als",), ("mf",)], "run_name string")
    assert rows(experiments.missing_runs(runs, expected), "run_name", "state") == [("cf", "extra"), ("mf", "missing")]


def test_als_leaves_out_seen_items(spark):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1) / 5) for u in range(20) for i in range(30) if (u + i) % 3], "user_idx int, item_idx int, confidence float")
    seen = ratings.select(F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id"))
    got = factors.recommend_als(factors.fit_als(ratings, 4, 3), seen.select("user_id").distinct(), seen, 5)
    assert got.join(seen, ["user_id", "item_id"]).isEmpty() and got.where("rank > 5").isEmpty() and got.count() == 100


def test_content_weights_by_hand(spark):
    """0.4 satisfaction, 0.2 recency, 0.2 popularity, 0.1 hotness, 0.1 price score."""
    rows = [("a", 5.0, 3, 7, 2, "2020-01-11", 10.0, "x"), ("b", 2.0, 1, 0, 0, "2020-01-01", 30.0, "x"), ("c", 4.0, 8, 1, 8, "2020-01-06", 10.0, "x")]
    f = spark.createDataFrame(rows, "item_id string, rating_mean double, review_count long, helpful_votes long, verified_count long, d string, price_median double, main_category string")
    got = {r.item_id: r.score for r in content.content_ranking(f.withColumn("last_review_date", F.to_date("d"))).collect()}
    for name, mean, n, votes, verified, day, price, _ in rows:
        satisfaction = 0.6 * mean + 0.2 * verified / n + 0.2 * math.log(1 + votes)
        recency = (int(day[-2:]) - 1) / 10
        popularity = math.log(1 + n)
        near = 1 / (1 + abs(price - 10) / 10)
        assert abs(got[name] - (0.4 * satisfaction + 0.2 * recency + 0.2 * popularity + 0.1 * popularity * recency + 0.1 * near)) < 1e-6


def test_difference_of_keys_is_of_sets(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "k string"), spark.createDataFrame([("y",)], "k string")
    assert rows(R.except_keys(a, b, "k"), "k") == [("x",), ("z",)]


def test_block_products_against_all_pairs(spark, monkeypatch):
    import random

    from reviewrec.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = random.Random(1)
    items = [(f"i{k:02d}", [float(r.randint(-2, 2)) for _ in range(3)]) for k in range(40)]
    df = spark.createDataFrame([*items, ("none", None)], "item_id string, vector array<double>")
    got = {(x.query, x["rank"]): (x.item_id, x.score) for x in vectors.top_products(df, df.withColumnRenamed("item_id", "query"), 5).collect()}
    for q, v in items:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in items if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_heavy_users_meet_in_blocks(spark, monkeypatch):
    cells = spark.createDataFrame([(f"u{u}", f"i{i}", float((u * 7 + i * 3) % 5)) for u in range(3) for i in range(23)], "user_id string, item_id string, value double")
    want = rows(itemcf.item_similarity(cells).withColumn("sim", F.round("sim", 9)), "item_id", "neighbor_id", "sim")
    monkeypatch.setattr(itemcf, "BLOCK", 4)
    assert rows(itemcf.item_similarity(cells).withColumn("sim", F.round("sim", 9)), "item_id", "neighbor_id", "sim") == want


def test_personal_order_without_a_profile(spark):
    results = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.2), (2, "b", 0.8)], "query_id int, item_id string, hybrid_score double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_id string, vector array<double>")
    profiles = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, profile array<double>")
    got = rows(search.rerank(results, "personalized", profiles=profiles, vectors=vectors), "query_id", "position", "item_id")
    assert got == [(1, 1, "b"), (1, 2, "a"), (2, 1, "b"), (2, 2, "a")]


def test_split_and_report(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "id int, label int")
    train, test = sentiment.stratified_split(df, "label", "id")
    assert train.count() + test.count() == 300 and {r["count"] for r in test.groupBy("label").count().collect()} == {20}
    report = {r["class"]: r for r in sentiment.classification_report(df.withColumn("prediction", F.col("label"))).collect()}
    assert report["macro"].f1 == report["accuracy"].precision == 1.0


def test_same_result_for_any_partitioning(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(catalogue.QUERIES["cf5_recommend_by_cf"](spark, sf), "seed_item", "rank", "item_id", "score"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]


def test_jsonl_limit_and_columns(spark):
    path = scratch.scratch_path(spark, "json")
    tables.write_jsonl(spark.range(10).toDF("id"), path)
    assert tables.read_jsonl(spark, path, spark.range(1).toDF("id").schema, 4).count() == 4
    try:
        tables.require_columns(spark.range(1), ["x"])
    except ValueError as e:
        assert "x" in str(e)
    else:
        raise AssertionError


def test_pairs_without_longer_sets(spark, monkeypatch):
    """Pairs and rules of two items as FP-growth has them, without it."""
    import random

    r = random.Random(6)
    b = spark.createDataFrame([(k, sorted(r.sample("abcdefghij", r.randint(3, 6)))) for k in range(300)], "key int, items array<string>")
    want = {tuple(sorted(x["items"])): x.freq for x in baskets.frequent_itemsets(b, 0.1).where("size(items) = 2").collect()}
    rules = {(x.antecedent, x.consequent): x.lift for x in baskets.one_to_one_rules(baskets.association_rules(b, 0.1)).collect()}
    monkeypatch.setattr(baskets, "FPGrowth", None)
    assert {tuple(x["items"]): x.freq for x in baskets.frequent_itemsets(b, 0.1, 2).collect()} == want and want
    got = {(x.antecedent, x.consequent): x.lift for x in baskets.one_to_one_rules(baskets.association_rules(b, 0.1, longest=2)).collect()}
    assert got.keys() == rules.keys() and all(abs(got[k] - v) < 1e-9 for k, v in rules.items()) and rules
