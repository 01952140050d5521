"""Sentiment classification: TF-IDF, splits, class weights, reports, review digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import head_text, top_k_per
from .terms import WORDS, separate, totals, weights


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) for words of two or more word characters and pairs of neighbours, with repeats."""
    words = df.select(key, F.regexp_extract_all(F.lower(F.col(text)), F.lit("(\\w\\w+)"), 1).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return words.select(key, F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))


def _counts(shared: DataFrame, key: str, text: str) -> DataFrame:
    return terms(shared, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(df: DataFrame, key: str, text: str, max_features: int, parts: tuple[DataFrame, DataFrame | None]) -> list:
    """Rows (term, idf) of the most frequent words and word pairs, most frequent first: ln((1 + n) / (1 + df)) + 1. parts: df's rows by `separate`."""
    alone, shared = parts
    sums = totals(alone, text, WORDS, pairs=True)
    if shared is not None:
        sums = sums.unionByName(_counts(shared, key, text).select("term", F.col("tf").alias("total"), F.lit(1).cast("long").alias("df")))
    top = sums.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    n = df.agg(F.count("*").alias("n"))
    return top.crossJoin(F.broadcast(n)).orderBy(F.desc("total"), "term").select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).collect()


def tfidf(df: DataFrame, key: str, text: str, max_features: int = 15_000) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1) of the most frequent terms, L2-normalised in each document.

    A document is weighed where it lies; only terms of rows that share a key are grouped.
    """
    alone, shared = parts = separate(df, key)
    found = vocabulary(df, key, text, max_features, parts)
    names = df.sparkSession.createDataFrame([(k, r.term) for k, r in enumerate(found)], "idx int, term string")
    rows = weights(alone, key, text, WORDS, True, {r.term: (k, r.idf) for k, r in enumerate(found)})
    each = rows.select(key, F.explode(F.arrays_zip("places", "weights")).alias("e"))
    out = each.join(F.broadcast(names), F.col("e.places") == F.col("idx")).select(key, "term", F.col("e.weights").alias("weight"))
    if shared is None:
        return out
    known = df.sparkSession.createDataFrame([(r.term, r.idf) for r in found], "term string, idf double")
    weighted = _counts(shared, key, text).join(F.broadcast(known), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return out.unionByName(weighted.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight")))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label the first share of its rows by a seeded hash of the key, exactly. Rows are ranked within 1000 ranges of
    the hash, so no task holds a label."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_range", F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 54))
    sizes = hashed.groupBy(label, "_range").agg(F.count("*").alias("_size"))
    of_label = Window.partitionBy(label)
    before = sizes.select(F.col(label).alias("_label"), F.col("_range").alias("_r"), (F.sum("_size").over(of_label.orderBy("_range")) - F.col("_size")).alias("_before"), F.sum("_size").over(of_label).alias("_all"))
    ranked = hashed.withColumn("_at", F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key)))
    placed = ranked.join(F.broadcast(before), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    first = F.col("_before") + F.col("_at") - 1 < share * F.greatest(F.col("_all") - 1, F.lit(1))
    return placed.where(~first).select(*df.columns), placed.where(first).select(*df.columns)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def confusion(predicted: DataFrame, actual: str = "label", guess: str = "prediction", classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    return predicted.groupBy(F.col(actual).cast("int").alias("actual")).agg(*(F.count_if(F.col(guess) == c).alias(f"predicted_{c}") for c in classes))


def classification_report(predicted: DataFrame, actual: str = "label", guess: str = "prediction") -> DataFrame:
    """precision, recall, f1, support of each class, with accuracy and averages in rows of their own."""
    cells = predicted.groupBy(F.col(actual).cast("int").alias("a"), F.col(guess).cast("int").alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit"))
    )
    each = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    each = each.select(F.col("class").cast("string").alias("class"), F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)).alias("recall"), "support", "hit")
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    names = ("precision", "recall", "f1")
    macro = each.agg(*(F.avg(c).alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("macro"))
    by_size = each.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("weighted"))
    accuracy = each.agg((F.sum("hit") / F.sum("support")).alias("precision"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), "precision", F.col("precision").alias("recall"), F.col("precision").alias("f1"), "support")
    columns = ["class", *names, "support"]
    return each.select(*columns).unionByName(macro.select(*columns)).unionByName(by_size.select(*columns)).unionByName(accuracy)


def extract_summary(texts: DataFrame, key: str = "item_id", text: str = "text", sentences: int = 2) -> DataFrame:
    """(key, summary): the sentences with the highest mean TF-IDF, in their order in the text."""
    split = texts.select(key, F.posexplode(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)).alias("at", "sentence")).withColumn("sid", F.concat_ws("#", F.col(key), F.col("at")))
    mean = tfidf(split, "sid", "sentence").groupBy("sid").agg(F.round(F.avg("weight"), 6).alias("score"))
    best = top_k_per(split.join(mean, "sid", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), key, "score", sentences, tie="at")
    ordered = F.array_sort(F.collect_list(F.struct("at", "sentence")))
    return best.groupBy(key).agg(ordered.alias("s")).select(key, F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("summary"))


def product_digest(reviews: DataFrame, text: str, order: list, products: int = 500, summarise: Callable[[DataFrame], DataFrame] = extract_summary) -> DataFrame:
    """Summary, mean rating, mean sentiment and number of reviews of the most reviewed products; texts under 20 words have no summary and go.

    summarise: a function of a table (item_id, text) that returns (item_id, summary), for instance a mapInPandas over a model.
    """
    from .relational import product_sentiment, top_groups

    top = top_groups(reviews, "item_id", products)
    chosen = reviews.join(top, "item_id", "left_semi")
    return summarise(head_text(chosen, "item_id", text, order)).join(product_sentiment(chosen), "item_id")
