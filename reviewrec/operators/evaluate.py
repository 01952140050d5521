"""Ranking metrics of recommendation tables, comparisons, and cold-start simulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import last_item, sample_keys, winner


def ranking_metrics(recommendations: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Of each user of truth (user_id, item_id): recall, precision, ndcg, hit_rate and first_hit_dcg at k, and whether anything was recommended.

    recommendations: (user_id, rank, item_id).
    """
    wanted = truth.select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count("*").alias("n_truth"))
    top = recommendations.where(F.col("rank") <= k).select("user_id", "item_id", "rank")
    any_ = top.select("user_id").distinct().withColumn("_any", F.lit(True))
    hits = top.join(wanted, ["user_id", "item_id"]).groupBy("user_id").agg(F.countDistinct("item_id").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    joined = sizes.join(hits, "user_id", "left").join(any_, "user_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return joined.select(
        "user_id", (n / F.col("n_truth")).alias("recall"), (n / F.lit(k)).alias("precision"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        (n > 0).cast("double").alias("hit_rate"), F.coalesce(1 / F.log2(F.col("first") + 1), F.lit(0.0)).alias("first_hit_dcg"), F.coalesce("_any", F.lit(False)).alias("answered"),
    )


METRICS = ("recall", "precision", "ndcg", "hit_rate", "first_hit_dcg")


def averaged(per_user: DataFrame, empty: str = "zero") -> DataFrame:
    """Means over users; users without any answer count 0, or are skipped."""
    rows = per_user if empty == "zero" else per_user.where("answered")
    return rows.agg(F.count("*").alias("n_users"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def evaluate(system: Callable[[DataFrame], DataFrame], train: DataFrame, test: DataFrame, k: int = 10, users: int | None = None, seed: int = 42, empty: str = "zero") -> DataFrame:
    """Means of a system: a function from seeds (user_id, seed_item) to (user_id, rank, item_id). The seed is a user's last training item."""
    chosen = test if users is None else test.join(sample_keys(test, "user_id", users, seed), "user_id", "left_semi")
    seeds = last_item(train).join(chosen.select("user_id").distinct(), "user_id", "left_semi").select("user_id", F.col("item_id").alias("seed_item"))
    return averaged(ranking_metrics(system(seeds), chosen.join(seeds.select("user_id"), "user_id", "left_semi"), k), empty)


def compare_systems(results: dict[str, DataFrame]) -> DataFrame:
    """(system, metrics ..) of one-row results."""
    out = None
    for name, df in results.items():
        row = df.withColumn("system", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("system", "n_users", *METRICS)


def metric_winners(board: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    out = None
    for m in metrics:
        row = winner(board, "system", m)
        out = row if out is None else out.unionByName(row)
    return out


def cold_start_delta(warm: DataFrame, cold: DataFrame) -> DataFrame:
    """(system, warm_*, cold_*, delta_*) of two comparisons, the second with masked users."""
    w = warm.select("system", *(F.col(m).alias(f"warm_{m}") for m in METRICS))
    c = cold.select("system", *(F.col(m).alias(f"cold_{m}") for m in METRICS))
    return w.join(c, "system").select("*", *(F.round(F.col(f"cold_{m}") - F.col(f"warm_{m}"), 6).alias(f"delta_{m}") for m in METRICS))


def mask_users(interactions: DataFrame, users: DataFrame) -> DataFrame:
    return interactions.join(users, "user_id", "left_anti")
