"""Projections, filters, joins, sets, windows and profiles over review tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewrec.functions.columns import band
from reviewrec.sources import scratch
from reviewrec.sources.tables import require_columns

from .quantiles import exact_quantiles

# -- projections and filters -----------------------------------------------------------------------


def with_item_id(df: DataFrame, source: str = "parent_asin") -> DataFrame:
    return require_columns(df, [source]).withColumn("item_id", F.col(source).cast("string"))


def select_interactions(df: DataFrame) -> DataFrame:
    return require_columns(df, ["user_id", "item_id", "rating", "timestamp"]).select("user_id", "item_id", F.col("rating").cast("double").alias("rating"), "timestamp")


def drop_null_keys(df: DataFrame, names: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    return df.dropna(subset=list(names))


def drop_sparse_columns(df: DataFrame, most: float = 0.40, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns of which more than that share is null; those to keep stay. One pass of counts."""
    tested = [c for c in df.columns if c not in keep]
    if not tested:
        return df
    share = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in tested)).first()
    gone = [c for c in tested if share.rows and share[c] / share.rows > most]
    return df.drop(*gone)


def impute(df: DataFrame, rules: dict[str, str | float]) -> DataFrame:
    """Fills nulls with the column's `mean` or `median`, or with a constant."""
    wide = df
    means = [F.avg(c).alias(f"_{c}") for c, r in rules.items() if r == "mean"]
    if means:
        wide = wide.crossJoin(F.broadcast(df.agg(*means)))
    for c in (c for c, r in rules.items() if r == "median"):
        wide = wide.crossJoin(F.broadcast(exact_quantiles(df, [], c, {f"_{c}": 0.5})))
    fill = {c: F.coalesce(F.col(c), F.col(f"_{c}") if r in ("mean", "median") else F.lit(r)) for c, r in rules.items()}
    return wide.select(*(fill[c].alias(c) if c in fill else F.col(c) for c in df.columns))


def safe_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts that turn what doesn't fit into null."""
    return df.select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns))


def keep_members(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def active_users(interactions: DataFrame, least: int = 5) -> DataFrame:
    busy = interactions.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return interactions.join(busy, "user_id", "left_semi")


def threshold_or_top(df: DataFrame, score: str, threshold: float, least: int, by: str, tie: str) -> DataFrame:
    """Rows of a score at or over the threshold if a group has at least so many; else the group's best so many."""
    hits = df.groupBy(by).agg(F.count_if(F.col(score) >= threshold).alias("_hits"))
    counted = df.join(hits, by)
    many = counted.where((F.col("_hits") >= least) & (F.col(score) >= threshold)).drop("_hits")
    # tasks keep the best so many of a group before the shuffle
    few = top_k_per(counted.where(F.col("_hits") < least).drop("_hits"), by, score, least, tie).drop("rank")
    return many.unionByName(few)


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n keys by the order of a seeded hash: the same for any partitioning."""
    return df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


# -- joins and sets --------------------------------------------------------------------------------


def merge_with_suffixes(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str] = ("_rev", "_meta")) -> DataFrame:
    """Inner join; columns that both sides have get the side's suffix."""
    both = [c for c in left.columns if c in right.columns and c != on]
    for c in both:
        left, right = left.withColumnRenamed(c, c + suffixes[0]), right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, on)


def lookup(df: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join; what isn't found gets the defaults."""
    out = df.join(table.select(key, *defaults), key, "left")
    return out.select(*df.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def exclude_seen(recommendations: DataFrame, interactions: DataFrame) -> DataFrame:
    return recommendations.join(interactions.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def common_users(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("user_id").intersect(b.select("user_id"))


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The different keys of a that b doesn't have."""
    return a.select(key).subtract(b.select(key))


def distinct_keys(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names).dropDuplicates()


# -- ranks -----------------------------------------------------------------------------------------


def top_n(df: DataFrame, score: str, n: int, tie: str = "item_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def top_k_per(df: DataFrame, by: str | list[str], score: str, k: int, tie: str = "item_id") -> DataFrame:
    """The k best rows of each group with their rank, ties by id."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def dedup_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_at = 1").drop("_at")


def best_per_item(df: DataFrame, keys: list[str], score: str = "score", tie: str = "source") -> DataFrame:
    """Of several rows for a key the one with the highest score; of equal scores the greatest tie value."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("_s"), F.col(tie).alias("_t"), *rest)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def minmax(df: DataFrame, column: str, by: str | None = None, out: str | None = None) -> DataFrame:
    """(x - lo) / (hi - lo + 1e-9), within groups or over the table."""
    if by is None:
        edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        wide = df.crossJoin(F.broadcast(edges))
    else:
        wide = df.join(df.groupBy(by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")), by)
    return wide.withColumn(out or column, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi")


def group_bands(df: DataFrame, by: str, score: str, n: int = 4, out: str = "band") -> DataFrame:
    """df with the number of the score's band of n equal ones between the group's extremes; a null group is one. The extremes are gathered before they are joined, so no
    task holds a group."""
    edges = df.groupBy(F.col(by).alias("_by")).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    joined = df.join(edges, F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn(out, band(F.col(score), F.col("_lo"), F.col("_hi"), n)).drop("_by", "_lo", "_hi")


def winner(df: DataFrame, name: str, metric: str, highest: bool = True) -> DataFrame:
    order = F.desc(metric) if highest else F.asc(metric)
    return df.where(F.col(metric).isNotNull()).orderBy(order, name).limit(1).select(F.lit(metric).alias("metric"), F.col(name).alias("winner"), F.col(metric).alias("value"))


# -- splits and histories --------------------------------------------------------------------------


def leave_last_out(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): each user's last interaction is the test row; of equal times the greatest item, then rating."""
    last = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("item_id"), F.desc("rating"))
    ranked = interactions.withColumn("_at", F.row_number().over(last))
    return ranked.where("_at > 1").drop("_at"), ranked.where("_at = 1").drop("_at")


def last_item(train: DataFrame) -> DataFrame:
    """(user_id, item_id) of each user's latest row; of equal times the greatest item id."""
    return train.groupBy("user_id").agg(F.max_by("item_id", F.struct("timestamp", "item_id")).alias("item_id"))


def user_history(train: DataFrame) -> DataFrame:
    """Items in order of time, and the last of them."""
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "item_id")))
    items = train.groupBy("user_id").agg(ordered.alias("_rows")).select("user_id", F.transform("_rows", lambda r: r["item_id"]).alias("items"))
    return items.withColumn("seed_item", F.element_at("items", -1))


def build_id_map(df: DataFrame, key: str) -> DataFrame:
    """(id, idx): 0, 1, .. in the order of the ids. Ranges of ids are numbered apart, so no task holds all of them; they are written, so numbering one again gives the same numbers."""
    ids = df.select(F.col(key).alias("id")).where("id is not null").distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.written(ids.repartitionByRange(parts, "id").withColumn("range", F.spark_partition_id()), "ids")
    numbered = ranged.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("id")))
    # a row a range
    before = ranged.groupBy("range").agg(F.count("*").alias("size")).select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    return numbered.join(F.broadcast(before), "range").select("id", (F.col("before") + F.col("n") - 1).alias("idx"))


def encode_ids(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    u, i = users.select(F.col("id").alias("user_id"), F.col("idx").alias("user_idx")), items.select(F.col("id").alias("item_id"), F.col("idx").alias("item_idx"))
    return interactions.join(u, "user_id").join(i, "item_id")


def random_split(interactions: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a seeded hash of the keys."""
    part = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return interactions.where(~part), interactions.where(part)


# -- aggregates and profiles -----------------------------------------------------------------------


def interaction_stats(interactions: DataFrame) -> DataFrame:
    counted = interactions.agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
    return counted.withColumn("avg_per_user", F.try_divide("n_rows", "n_users")).withColumn("density", F.try_divide(F.col("n_rows").cast("double"), F.col("n_users") * F.col("n_items")))


def null_report(df: DataFrame) -> DataFrame:
    """Nulls of each column, count and percent."""
    counts = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_null)", "_rows").select("column_name", "n_null", F.round(F.try_divide(F.col("n_null") * 100.0, F.col("_rows")), 4).alias("pct_null"))


def null_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = null_report(before), null_report(after)
    return a.select("column_name", F.col("n_null").alias("n_before")).join(b.select("column_name", F.col("n_null").alias("n_after")), "column_name", "left")


def distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 4).alias("pct"))


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def product_sentiment(df: DataFrame) -> DataFrame:
    from reviewrec.functions.columns import sentiment_code

    return df.groupBy("item_id").agg(F.round(F.avg("rating"), 3).alias("avg_rating"), F.round(F.avg(sentiment_code("rating")), 3).alias("avg_sentiment"), F.count("*").alias("n_reviews"))


def rating_cells(interactions: DataFrame, how: str = "sum") -> DataFrame:
    """One value for each (user, item): the sum of its ratings, their mean, or the last."""
    value = {"sum": F.sum("rating"), "mean": F.avg("rating"), "last": F.max_by("rating", F.struct("timestamp", "rating"))}[how]
    return interactions.groupBy("user_id", "item_id").agg(value.alias("value"))


def first_non_null(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first value of each column that isn't null, in order."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


def item_ratings(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id").agg(F.count("*").alias("n_reviews"), F.avg("rating").alias("avg_rating"))


def describe(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    whole = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    quartiles = exact_quantiles(df, [], x, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return whole.crossJoin(F.broadcast(quartiles)).select("n", "mean", "std", "least", "p25", "p50", "p75", "most")


def avg_words(df: DataFrame, column: str) -> DataFrame:
    from reviewrec.functions.columns import word_count

    return df.agg(F.avg(word_count(column)).alias("avg_words"))


def term_counts(df: DataFrame, text: str) -> DataFrame:
    from reviewrec.functions.columns import words

    return df.select(F.explode(words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def truth_sets(test: DataFrame) -> DataFrame:
    return test.groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def head_text(df: DataFrame, key: str, text: str, order: list[Column], n: int = 50, chars: int = 1500, least_words: int = 20) -> DataFrame:
    """The first n texts of each key in order, joined and cut to so many characters; short ones go."""
    from reviewrec.functions.columns import word_count

    first = df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") <= n)
    joined = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", text))).alias("_rows"))
    out = joined.select(key, F.substring(F.array_join(F.transform("_rows", lambda r: r[text]), " "), 1, chars).alias("text"))
    return out.where(word_count("text") >= least_words)
