"""Content scores of products, and a ranking that is the same for every seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrec.sources import scratch

from .quantiles import exact_quantiles

#: Fixed values.
WEIGHTS = {"satisfaction": 0.4, "recency": 0.2, "popularity": 0.2, "hotness": 0.1, "price_score": 0.1}


def product_features(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("item_id").agg(
        F.avg("rating").alias("rating_mean"), F.count("*").alias("review_count"), F.sum("helpful_vote").alias("helpful_votes"),
        F.sum(F.col("verified_purchase").cast("int")).alias("verified_count"), F.max("timestamp").alias("last_review_date"),
        F.median("price").alias("price_median"), F.min("main_category").alias("main_category"),
    )


def plain_scores(features: DataFrame) -> DataFrame:
    """verified_rate, helpful_log, satisfaction, popularity: what needs no figures of the whole table."""
    return (
        features.withColumn("verified_rate", F.col("verified_count") / F.greatest(F.col("review_count"), F.lit(1)))
        .withColumn("helpful_log", F.log1p("helpful_votes"))
        .withColumn("satisfaction", 0.6 * F.col("rating_mean") + 0.2 * F.col("verified_rate") + 0.2 * F.col("helpful_log"))
        .withColumn("popularity", F.log1p("review_count"))
    )


def content_scores(features: DataFrame) -> DataFrame:
    """satisfaction, recency, popularity, hotness; dates are scaled over the whole table."""
    edges = features.agg(F.min("last_review_date").alias("_first"), F.max("last_review_date").alias("_last"))
    span = F.date_diff("_last", "_first")
    return (
        plain_scores(features)
        .crossJoin(F.broadcast(edges))
        .withColumn("recency", F.when(span > 0, F.date_diff("last_review_date", "_first") / F.when(span > 0, span)).otherwise(0.0))
        .withColumn("hotness", F.col("popularity") * F.col("recency"))
        .drop("_first", "_last")
    )


def price_score(features: DataFrame) -> DataFrame:
    """Nearness of a price to its category's median; unknown prices and medians of zero count 0.5."""
    features = scratch.written(features, "features")
    middle = exact_quantiles(features, ["main_category"], "price_median", {"_middle": 0.5})
    m = F.nullif(F.col("_middle"), F.lit(0.0))
    near = 1 / (1 + F.abs(F.col("price_median") - m) / m)
    joined = features.join(middle, features["main_category"].eqNullSafe(middle["main_category"]), "left").drop(middle["main_category"])
    return joined.withColumn("price_score", F.coalesce(near, F.lit(0.5))).drop("_middle")


def content_ranking(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    total = sum((F.col(c) * w for c, w in (weights or WEIGHTS).items()), F.lit(0.0))
    return price_score(content_scores(features)).withColumn("score", F.round(total, 6))


def recommend_by_content(ranking: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """(seed_item, rank, item_id, score). All seeds share the best k + 1; a seed itself is left out."""
    from .relational import top_k_per

    best = ranking.select("item_id", "score").orderBy(F.desc("score"), "item_id").limit(k + 1)
    every = seeds.select("seed_item").distinct().join(F.broadcast(best), F.col("seed_item") != F.col("item_id"))
    return top_k_per(every, "seed_item", "score", k).withColumn("source", F.lit("content"))
