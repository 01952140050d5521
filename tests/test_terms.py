"""Terms are counted where their texts lie, whatever keys the texts have."""

from collections import Counter

from pyspark.sql import functions as F

from reviewrec.operators import search, sentiment, svm, terms

ROWS = [("a", "x Yy yy\tzz"), ("b", None), ("b", "yy yy"), ("c", ""), (None, "zz qq"), (None, "qq"), ("d", "İx a_b yy."), ("b", "zz")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "item_id string, text string")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_postings_with_repeated_and_null_keys(spark):
    df = table(spark)
    got = sorted((str(r.item_id), r.term, r.tf) for r in search.postings(df).collect())
    words = df.select("item_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("w")).collect()
    assert got == sorted((str(k), w, n) for (k, w), n in Counter((r[0], r[1]) for r in words).items())


def test_weights_with_repeated_and_null_keys(spark):
    for most in (3, 100):
        df = table(spark)
        tf = sentiment.terms(df, "item_id", "text").groupBy("item_id", "term").agg(F.count("*").alias("tf"))
        top = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(most)
        w = tf.join(top, "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(len(ROWS))) / (1 + F.col("df"))) + 1))
        want = w.join(w.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "item_id")
        want = {(r.item_id, r.term): round(r.w / r.norm, 9) for r in want.collect()}
        assert {(r.item_id, r.term): round(r.weight, 9) for r in sentiment.tfidf(df, "item_id", "text", most).collect()} == want
        vocabulary = svm.fit_vocabulary(df, "item_id", "text", most)
        names = {r.idx: r.term for r in vocabulary.collect()}
        rows = svm.tfidf_rows(df, "item_id", "text", vocabulary).collect()
        assert sorted(str(r.item_id) for r in rows) == ["None", "a", "b", "c", "d"]
        assert {(r.item_id, names[p]): round(x, 9) for r in rows for p, x in zip(r.places, r.weights, strict=True)} == want


def test_no_term_of_a_single_row_is_shuffled(spark):
    df = table(spark, [(str(k), f"w{k} v{k % 3} w{k}") for k in range(50)]).repartition(3)
    base = exchanges(df)
    vocabulary = svm.fit_vocabulary(df, "item_id", "text", 5)
    for made in (search.postings(df), svm.tfidf_rows(df, "item_id", "text", vocabulary)):
        assert exchanges(made) == base


def test_full_counters_are_handed_on(spark, monkeypatch):
    df = table(spark, [(str(k), " ".join(f"w{k * j}" for j in range(20))) for k in range(30)])
    want = sorted(terms.counts(df, "item_id", "text", terms.PLAIN).collect()), sorted(sentiment.tfidf(df, "item_id", "text", 9).collect())
    monkeypatch.setattr(terms, "HELD", 7)
    assert (sorted(terms.counts(df, "item_id", "text", terms.PLAIN).collect()), sorted(sentiment.tfidf(df, "item_id", "text", 9).collect())) == want
