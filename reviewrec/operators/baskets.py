"""Basket rules from exact pair counts; longer sets by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top_k_per


def baskets(rows: DataFrame, lo: int = 3, hi: int = 12) -> DataFrame:
    """(key, items): different items of each key, where there are lo to hi of them."""
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")).where(F.size("items").between(lo, hi))


def prune_baskets(b: DataFrame, least: int = 10, lo: int = 2) -> DataFrame:
    """Without items of fewer than `least` baskets, and then without baskets of fewer than lo items."""
    long = b.select("key", F.explode("items").alias("item"))
    often = long.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return long.join(often, "item", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")).where(F.size("items") >= lo)


def item_pairs(b: DataFrame) -> DataFrame:
    """(a, b, n) with a < b: baskets that have both. Pairs are made inside a basket, whose size is bounded by baskets()."""
    pairs = F.flatten(F.transform("items", lambda x: F.transform(F.filter("items", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return b.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def frequent_itemsets(b: DataFrame, min_support: float = 0.0005, length: int | None = None) -> DataFrame:
    """(items, freq) of any length by FP-growth; of length 2 alone by counting the pairs of each basket."""
    if length == 2:
        total = F.broadcast(b.agg(F.count("*").alias("total")))
        return item_pairs(b).crossJoin(total).where(F.col("n") >= F.col("total") * min_support).select(F.array("a", "b").alias("items"), F.col("n").alias("freq"))
    if length is not None:
        raise ValueError(f"no itemsets of length {length} alone")
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(b).freqItemsets


def pair_rules(b: DataFrame, min_support: float = 0.0005, min_lift: float = 1.0) -> DataFrame:
    """Rules of one item each way: support, confidence, lift."""
    single = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    total = b.agg(F.count("*").alias("total"))
    pairs = item_pairs(b).crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * min_support)
    both = pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "n", "total").unionByName(pairs.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "n", "total"))
    counted = both.join(single.toDF("antecedent", "na"), "antecedent").join(single.toDF("consequent", "nb"), "consequent")
    rules = counted.select("antecedent", "consequent", (F.col("n") / F.col("total")).alias("support"), (F.col("n") / F.col("na")).alias("confidence"), (F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("lift"))
    return rules.where(F.col("lift") >= min_lift)


def association_rules(b: DataFrame, min_support: float = 0.0005, min_lift: float = 1.0, longest: int | None = None) -> DataFrame:
    """Rules of any length by FP-growth; of two items at most by the counts of pair_rules."""
    if longest == 2:
        rules = pair_rules(b, min_support, min_lift)
        return rules.select(F.array("antecedent").alias("antecedent"), F.array("consequent").alias("consequent"), "confidence", "lift", "support")
    if longest is not None:
        raise ValueError(f"no rules of {longest} items at most")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1e-9).fit(b)
    return model.associationRules.where(F.col("lift") >= min_lift)


def one_to_one_rules(rules: DataFrame) -> DataFrame:
    return rules.where((F.size("antecedent") == 1) & (F.size("consequent") == 1)).select(
        F.element_at("antecedent", 1).alias("antecedent"), F.element_at("consequent", 1).alias("consequent"), "support", "confidence", "lift"
    )


def symmetric_rules(rules: DataFrame) -> DataFrame:
    """(item, other, lift, confidence) for both directions of each rule."""
    return rules.select(F.col("antecedent").alias("item"), F.col("consequent").alias("other"), "lift", "confidence").unionByName(rules.select(F.col("consequent").alias("item"), F.col("antecedent").alias("other"), "lift", "confidence")).distinct()


def recommend_by_rules(rules: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """(seed_item, rank, item_id, score): best lift * confidence over both directions."""
    scored = symmetric_rules(rules).groupBy("item", "other").agg(F.round(F.max(F.col("lift") * F.col("confidence")), 4).alias("score"))
    found = seeds.select("seed_item").distinct().join(scored, F.col("seed_item") == F.col("item")).select("seed_item", F.col("other").alias("item_id"), "score")
    return top_k_per(found, "seed_item", "score", k).withColumn("source", F.lit("rules"))


def rule_confirmation(rules: DataFrame, truth: DataFrame) -> DataFrame:
    """Rules with whether their pair, in either direction, is in truth (a, b)."""
    both = truth.select("a", "b").unionByName(truth.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("hit", F.lit(True))
    return rules.join(both, (F.col("antecedent") == F.col("a")) & (F.col("consequent") == F.col("b")), "left").withColumn("confirmed", F.coalesce("hit", F.lit(False))).drop("a", "b", "hit")


def confirmation_rate(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("n_rules"), F.coalesce(F.avg(F.col("confirmed").cast("int")), F.lit(0.0)).alias("rate"))


def confirmation_by_bucket(rules: DataFrame) -> DataFrame:
    from reviewrec.functions.columns import confidence_bucket

    return rules.groupBy(confidence_bucket("confidence").alias("bucket")).agg(F.count("*").alias("n_rules"), F.avg(F.col("confirmed").cast("int")).alias("rate"))


def most_connected(rules: DataFrame) -> DataFrame:
    return symmetric_rules(rules).groupBy("item").agg(F.count("*").alias("n_rules")).orderBy(F.desc("n_rules"), "item").limit(1)
