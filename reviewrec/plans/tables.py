"""Queries for sources, cleaning, relational operators and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewrec.functions import columns as C
from reviewrec.operators import relational as R
from reviewrec.sources import scratch, tables
from reviewrec.sources.fixtures import Views

from .registry import query

# -- sources ---------------------------------------------------------------------------------------

META = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("store", T.StringType()), T.StructField("main_category", T.StringType()), T.StructField("price", T.DoubleType())])
_META_SQL = "SELECT item_id, title, store, main_category, price FROM metadata"


@query("src1_jsonl", _META_SQL)
def src1(v: Views):
    path = scratch.scratch_path(v.spark, "jsonl")
    tables.write_jsonl(v.metadata(), path)
    return tables.read_jsonl(v.spark, path, META)


@query("src2_categories", "SELECT p_name AS name, p_retailprice AS amount, NULL::INTEGER AS nation, 'part' AS main_category FROM part UNION ALL SELECT s_name, s_acctbal, s_nationkey, 'supplier' FROM supplier")
def src2(v: Views):
    part = v.table("part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("amount"))
    supplier = v.table("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"), F.col("s_nationkey").alias("nation"))
    return tables.read_categories({"part": part, "supplier": supplier})


@query("src3_csv", _META_SQL)
def src3(v: Views):
    path = scratch.scratch_path(v.spark, "csv")
    tables.write_csv(v.metadata(), path)
    return tables.read_csv(v.spark, path, META)


@query("src4_parquet", "SELECT user_id, item_id, rating, timestamp FROM interactions")
def src4(v: Views):
    path = scratch.scratch_path(v.spark, "interactions")
    tables.write_table(v.interactions(), path)
    return tables.read_table(v.spark, path)


@query("src5_projected_scan", "SELECT l_quantity, l_shipdate, l_partkey AS item_id FROM lineitem")
def src5(v: Views):
    return tables.read_columns(v.spark, f"{v.sf_dir}/lineitem.parquet", ["l_quantity", "l_shipdate"], {"item_id": ["parent_asin", "item_id", "l_partkey"]})


@query("src6_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, len(embedding)::INTEGER AS size FROM embeddings")
def src6(v: Views):
    path = scratch.scratch_path(v.spark, "vectors")
    tables.write_vectors(v.table("embeddings"), path, "vec_id", "embedding")
    back = tables.read_vectors(v.spark, path)
    return back.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("embedding").alias("size"))


@query("src7_id_map", "SELECT DISTINCT user_id AS id, (dense_rank() OVER (ORDER BY user_id) - 1)::BIGINT AS idx FROM interactions")
def src7(v: Views):
    path = scratch.scratch_path(v.spark, "ids")
    tables.write_id_map(R.build_id_map(v.interactions(), "user_id"), path)
    return tables.read_id_map(v.spark, path)


_POSTINGS = r"posted AS (SELECT item_id, term, count(*)::BIGINT AS tf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM docs) GROUP BY ALL)"


@query("src8_postings", f"{_POSTINGS} SELECT item_id, term, tf FROM posted")
def src8(v: Views):
    from reviewrec.operators.search import postings

    path = scratch.scratch_path(v.spark, "postings")
    tables.write_table(postings(v.docs()), path)
    return tables.read_table(v.spark, path)


@query("src11_confidence", "SELECT user_id, item_id, sum(rating) / 5.0 AS confidence FROM interactions GROUP BY ALL")
def src11(v: Views):
    return tables.confidence_table(v.interactions())


# -- projections and filters -----------------------------------------------------------------------


@query("prj1_item_id", "SELECT l_orderkey, l_partkey, l_partkey::VARCHAR AS item_id FROM lineitem")
def prj1(v: Views):
    return R.with_item_id(v.table("lineitem"), "l_partkey").select("l_orderkey", "l_partkey", "item_id")


@query("prj2_interactions", "SELECT user_id, item_id, rating, timestamp FROM reviews")
def prj2(v: Views):
    return R.select_interactions(v.reviews())


@query("prj3_null_keys", "SELECT nullif(l_returnflag, 'A') AS flag, l_orderkey FROM lineitem WHERE l_returnflag <> 'A'")
def prj3(v: Views):
    return R.drop_null_keys(v.table("lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"), "l_orderkey"), ["flag"])


@query("prj4_price", r"SELECT p_partkey, try_cast(nullif(regexp_extract('from ' || p_retailprice || ' up', '(\d+\.?\d*)', 1), '') AS DOUBLE) AS price, try_cast(nullif(regexp_extract(p_name, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS none FROM part")
def prj4(v: Views):
    return v.table("part").select("p_partkey", C.parse_price(F.concat(F.lit("from "), F.col("p_retailprice").cast("string"), F.lit(" up"))).alias("price"), C.parse_price("p_name").alias("none"))


@query("prj5_sparse_columns", "SELECT l_orderkey, nullif(l_tax, 0) AS tax, CASE WHEN l_returnflag = 'N' THEN 'N' END AS kept FROM lineitem")
def prj5(v: Views):
    flags = v.table("lineitem").select("l_orderkey", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"), F.when(F.col("l_returnflag") == "N", "N").alias("kept"), F.when(F.col("l_returnflag") == "A", "A").alias("gone"))
    return R.drop_sparse_columns(flags, 0.40, keep=["kept"])


@query(
    "prj6_impute",
    """t AS (SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS tax, nullif(l_discount, 0) AS discount, nullif(l_returnflag, 'A') AS flag FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(coalesce(tax, (SELECT avg(tax) FROM t)), 6) AS tax, coalesce(discount, (SELECT median(discount) FROM t)) AS discount, coalesce(flag, '') AS flag FROM t""",
)
def prj6(v: Views):
    t = v.table("lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"), F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"))
    return R.impute(t, {"tax": "mean", "discount": "median", "flag": ""}).withColumn("tax", F.round("tax", 6))


@query("prj7_safe_cast", "SELECT p_partkey, try_cast(p_name AS DOUBLE) AS p_name, try_cast(p_brand AS DATE) AS p_brand, try_cast(p_size AS VARCHAR) AS p_size FROM part")
def prj7(v: Views):
    return R.safe_cast(v.table("part").select("p_partkey", "p_name", "p_brand", "p_size"), {"p_name": "double", "p_brand": "date", "p_size": "string"})


@query("prj8_time_of_day", "SELECT event_id, hour(ts)::INTEGER AS hour, CASE WHEN hour(ts) < 6 THEN 'early_morning' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'midday' ELSE 'night' END AS time_of_day FROM events")
def prj8(v: Views):
    return v.table("events").select("event_id", F.hour("ts").alias("hour"), C.time_of_day("ts").alias("time_of_day"))


@query("prj9_dates", "SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, (isodow(ts) - 1)::INTEGER AS dayofweek, isodow(ts) IN (6, 7) AS is_weekend FROM events")
def prj9(v: Views):
    return v.table("events").select("event_id", *C.date_features("ts"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\S+|www\S+', '', 'g'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("prj10_clean_text", f"SELECT item_id, {_CLEAN} AS text_clean FROM docs")
def prj10(v: Views):
    return v.docs().select("item_id", C.clean_text("text").alias("text_clean"))


@query("prj11_product_text", "SELECT item_id, trim(title || ' ' || store || ' ' || main_category || ' size ' || p_size || ' brand ' || store) AS product_text FROM metadata JOIN part ON item_id = p_partkey::VARCHAR")
def prj11(v: Views):
    p = v.table("part")
    details = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return p.select(F.col("p_partkey").cast("string").alias("item_id"), C.product_text(F.col("p_name"), F.lit(None).cast("string"), F.array("p_brand", "p_type"), details).alias("product_text"))


@query("prj12_review_text", "SELECT item_id, trim(concat_ws(' ', nullif(lang, 'de'), text)) AS full_review_text FROM docs")
def prj12(v: Views):
    return v.docs().select("item_id", C.review_text(F.nullif(F.col("lang"), F.lit("de")), F.col("text")).alias("full_review_text"))


_LABEL = "CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating IS NOT NULL THEN 'positive' END"
_CODE = "CASE WHEN rating <= 2 THEN 0 WHEN rating = 3 THEN 1 WHEN rating IS NOT NULL THEN 2 END"


@query("prj13_sentiment", f"SELECT user_id, item_id, rating, {_LABEL} AS label, ({_CODE})::INTEGER AS code FROM (SELECT user_id, item_id, nullif(rating, 4) AS rating FROM interactions)")
def prj13(v: Views):
    rows = v.interactions().select("user_id", "item_id", F.nullif(F.col("rating"), F.lit(4.0)).alias("rating"))
    return rows.select("*", C.sentiment_label("rating").alias("label"), C.sentiment_code("rating").alias("code"))


@query("prj14_members", "SELECT user_id, item_id, rating FROM interactions WHERE item_id IN (SELECT item_id FROM metadata WHERE store = 'Brand#1' OR store LIKE '%1')")
def prj14(v: Views):
    return R.keep_members(v.interactions().select("item_id", "user_id", "rating"), v.metadata().where("store = 'Brand#1' OR store LIKE '%1'").select("item_id"), "item_id").select("user_id", "item_id", "rating")


@query("prj15_active_users", "SELECT user_id, item_id, rating FROM interactions WHERE user_id IN (SELECT user_id FROM interactions GROUP BY 1 HAVING count(*) >= 40)")
def prj15(v: Views):
    return R.active_users(v.interactions(), 40).select("user_id", "item_id", "rating")


@query(
    "prj16_threshold_or_top",
    """t AS (SELECT user_id, item_id, rating / 5 AS s, count(*) FILTER (WHERE rating / 5 >= 0.9) OVER (PARTITION BY user_id) AS hits,
    row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS pos FROM (SELECT user_id, item_id, max(rating) AS rating FROM interactions GROUP BY ALL))
    SELECT user_id, item_id, s FROM t WHERE (hits >= 8 AND s >= 0.9) OR (hits < 8 AND pos <= 8)""",
)
def prj16(v: Views):
    t = v.interactions().groupBy("user_id", "item_id").agg((F.max("rating") / 5).alias("s"))
    return R.threshold_or_top(t, "s", 0.9, 8, "user_id", "item_id")


@query("prj17_confidence_bucket", "SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount * 10 > 0 AND l_discount * 10 <= 0.3 THEN 'low' WHEN l_discount * 10 > 0.3 AND l_discount * 10 <= 0.6 THEN 'medium' WHEN l_discount * 10 > 0.6 AND l_discount * 10 <= 1 THEN 'high' END AS bucket FROM lineitem")
def prj17(v: Views):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", C.confidence_bucket(F.col("l_discount") * 10).alias("bucket"))


@query("prj18_rating_unit", "SELECT user_id, item_id, (rating - 1) / 4 AS unit FROM interactions")
def prj18(v: Views):
    return v.interactions().select("user_id", "item_id", C.rating_unit("rating").alias("unit"))


@query("prj19_sample")
def prj19(v: Views):
    return R.sample_keys(v.interactions(), "user_id", 500)


# -- joins and sets --------------------------------------------------------------------------------


@query("join1_suffixes", "SELECT r.item_id, r.user_id, r.title AS title_rev, m.title AS title_meta, r.price AS price_rev, m.price AS price_meta, r.store AS store_rev, m.store AS store_meta FROM reviews r JOIN metadata m USING (item_id)")
def join1(v: Views):
    return R.merge_with_suffixes(v.reviews().select("item_id", "user_id", "title", "price", "store"), v.metadata().drop("main_category"), "item_id")


@query("join2_semi", "SELECT DISTINCT item_id FROM metadata WHERE item_id IN (SELECT item_id FROM interactions WHERE rating = 5)")
def join2(v: Views):
    return R.keep_members(v.metadata().select("item_id"), v.interactions().where("rating = 5").select("item_id"), "item_id")


@query("join3_lookup", "SELECT i.user_id, i.item_id, coalesce(m.title, '') AS title, coalesce(m.price, 0.0) AS price FROM interactions i LEFT JOIN (SELECT * FROM metadata WHERE store LIKE '%2') m USING (item_id)")
def join3(v: Views):
    return R.lookup(v.interactions().select("item_id", "user_id"), v.metadata().where("store LIKE '%2'"), "item_id", {"title": "", "price": 0.0})


@query("join4_exclude_seen", "made AS (SELECT c_custkey::VARCHAR AS user_id, item_id FROM customer, (SELECT item_id FROM interactions GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 20)) SELECT user_id, item_id FROM made ANTI JOIN interactions USING (user_id, item_id)")
def join4(v: Views):
    """The 20 most frequent items for every user, without what the user has."""
    best = R.top_groups(v.interactions(), "item_id", 20).select("item_id")
    made = v.table("customer").select(F.col("c_custkey").cast("string").alias("user_id")).crossJoin(F.broadcast(best))
    return R.exclude_seen(made, v.interactions())


@query("join8_encode_ids", "u AS (SELECT DISTINCT user_id, (dense_rank() OVER (ORDER BY user_id) - 1)::BIGINT AS user_idx FROM interactions), i AS (SELECT DISTINCT item_id, (dense_rank() OVER (ORDER BY item_id) - 1)::BIGINT AS item_idx FROM interactions) SELECT user_id, item_id, rating, user_idx, item_idx FROM interactions JOIN u USING (user_id) JOIN i USING (item_id)")
def join8(v: Views):
    x = v.interactions()
    return R.encode_ids(x, R.build_id_map(x, "user_id"), R.build_id_map(x, "item_id")).select("user_id", "item_id", "rating", "user_idx", "item_idx")


@query("join9_bands", "t AS (SELECT p_partkey, p_type, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_type) lo, max(p_retailprice) OVER (PARTITION BY p_type) hi FROM part) SELECT p_partkey, p_type, least(floor((p_retailprice - lo) / ((hi - lo) / 4)), 3)::INTEGER AS band FROM t")
def join9(v: Views):
    return R.group_bands(v.table("part"), "p_type", "p_retailprice").select("p_partkey", "p_type", "band")


@query("set1_union_all", "SELECT user_id, item_id FROM interactions UNION ALL SELECT item_id, item_id FROM metadata")
def set1(v: Views):
    return tables.stack([v.interactions().select("user_id", "item_id"), v.metadata().select(F.col("item_id").alias("user_id"), "item_id")])


@query("set3_common_users", "SELECT user_id FROM interactions WHERE rating = 5 INTERSECT SELECT user_id FROM interactions WHERE rating = 1")
def set3(v: Views):
    return R.common_users(v.interactions().where("rating = 5"), v.interactions().where("rating = 1"))


@query("set4_except", "SELECT item_id FROM interactions EXCEPT SELECT item_id FROM reviews WHERE rating = 5 AND helpful_vote = 7")
def set4(v: Views):
    return R.except_keys(v.interactions(), v.reviews().where("rating = 5 and helpful_vote = 7"), "item_id")


@query("set5_distinct", "SELECT DISTINCT user_id, item_id FROM interactions")
def set5(v: Views):
    return R.distinct_keys(v.interactions(), ["user_id", "item_id"])


# -- aggregates ------------------------------------------------------------------------------------

_FEATURES = """features AS (SELECT item_id, avg(rating) AS rating_mean, count(*)::BIGINT AS review_count, sum(helpful_vote)::BIGINT AS helpful_votes, sum(verified_purchase::INTEGER)::BIGINT AS verified_count,
max(timestamp) AS last_review_date, median(price) AS price_median, min(main_category) AS main_category FROM reviews GROUP BY item_id)"""


@query("agg1_product_features", f"{_FEATURES} SELECT item_id, round(rating_mean, 6) AS rating_mean, review_count, helpful_votes, verified_count, last_review_date, round(price_median, 9) AS price_median, main_category FROM features")
def agg1(v: Views):
    from reviewrec.operators.content import product_features

    return product_features(v.reviews()).withColumn("rating_mean", F.round("rating_mean", 6)).withColumn("price_median", F.round("price_median", 9))


@query("agg2_stats", "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_users, count(DISTINCT item_id)::BIGINT AS n_items, round(count(*) / count(DISTINCT user_id), 6) AS avg_per_user, round(count(*)::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT item_id)), 9) AS density FROM interactions")
def agg2(v: Views):
    return R.interaction_stats(v.interactions()).withColumn("avg_per_user", F.round("avg_per_user", 6)).withColumn("density", F.round("density", 9))


def _nulled(v: Views):
    return v.table("lineitem").select("l_orderkey", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"), F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"))


@query("agg3_null_report", """t AS (SELECT count(*) n, count(*) FILTER (WHERE l_tax = 0) a, count(*) FILTER (WHERE l_returnflag = 'A') b FROM lineitem)
SELECT 'l_orderkey' AS column_name, 0::BIGINT AS n_null, 0.0::DOUBLE AS pct_null UNION ALL SELECT 'tax', a, round(a * 100.0 / n, 4) FROM t UNION ALL SELECT 'flag', b, round(b * 100.0 / n, 4) FROM t""")
def agg3(v: Views):
    return R.null_report(_nulled(v))


@query("agg4_null_comparison", """t AS (SELECT count(*) FILTER (WHERE l_tax = 0) a, count(*) FILTER (WHERE l_returnflag = 'A') b FROM lineitem)
SELECT 'l_orderkey' AS column_name, 0::BIGINT AS n_before, 0::BIGINT AS n_after UNION ALL SELECT 'tax', a, 0 FROM t UNION ALL SELECT 'flag', b, NULL FROM t""")
def agg4(v: Views):
    before = _nulled(v)
    return R.null_comparison(before, R.impute(before.drop("flag"), {"tax": "mean"}))


@query("agg6_distribution", "SELECT main_category, count(*)::BIGINT AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM reviews GROUP BY 1")
def agg6(v: Views):
    return R.distribution(v.reviews(), "main_category")


@query("agg7_top_groups", "SELECT item_id, count(*)::BIGINT AS n FROM interactions GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50")
def agg7(v: Views):
    return R.top_groups(v.interactions(), "item_id", 50)


@query("agg8_product_sentiment", f"SELECT item_id, round(avg(rating), 3) AS avg_rating, round(avg({_CODE}), 3) AS avg_sentiment, count(*)::BIGINT AS n_reviews FROM interactions GROUP BY 1")
def agg8(v: Views):
    return R.product_sentiment(v.interactions())


@query("agg11_describe", "SELECT count(rating)::BIGINT AS n, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std, min(rating) AS least, quantile_cont(rating, 0.25) AS p25, quantile_cont(rating, 0.5) AS p50, quantile_cont(rating, 0.75) AS p75, max(rating) AS most FROM interactions")
def agg11(v: Views):
    return R.describe(v.interactions(), "rating").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("agg12_rating_cells", "SELECT user_id, item_id, sum(rating) AS value FROM interactions GROUP BY ALL")
def agg12(v: Views):
    return R.rating_cells(v.interactions())


@query("agg13_first_non_null", "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS status, min_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def agg13(v: Views):
    o = v.table("orders").select("o_custkey", "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"), F.col("o_totalprice").alias("price"))
    return R.first_non_null(o, "o_custkey", "o_orderkey")


_LAST = "split AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC, rating DESC) AS pos FROM interactions), train AS (SELECT user_id, item_id, rating, timestamp FROM split WHERE pos > 1), test AS (SELECT user_id, item_id, rating, timestamp FROM split WHERE pos = 1)"


@query("agg14_truth_sets", "SELECT user_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM interactions WHERE rating = 5 GROUP BY 1")
def agg14(v: Views):
    return R.truth_sets(v.interactions().where("rating = 5")).select("user_id", F.array_join("items", ",").alias("items"))


@query("agg15_mean_vectors", "t AS (SELECT item_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM review_vectors), m AS (SELECT item_id, pos, avg(x) AS x, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, max(n)::BIGINT AS n, round(sum(x * pos), 6) AS checksum, count(*)::BIGINT AS size FROM m GROUP BY 1")
def agg15(v: Views):
    from reviewrec.operators.search import mean_vectors

    m = mean_vectors(v.review_vectors())
    total = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.size("vector")), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return m.select("item_id", "n", F.round(total, 6).alias("checksum"), F.size("vector").cast("long").alias("size"))


@query("agg16_item_ratings", "SELECT item_id, count(*)::BIGINT AS n_reviews, round(avg(rating), 6) AS avg_rating FROM interactions GROUP BY 1")
def agg16(v: Views):
    return R.item_ratings(v.interactions()).withColumn("avg_rating", F.round("avg_rating", 6))


@query("agg18_avg_words", r"SELECT round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 6) AS avg_words FROM docs")
def agg18(v: Views):
    return R.avg_words(v.docs(), "text").select(F.round("avg_words", 6).alias("avg_words"))


@query("agg19_term_counts", r"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM docs WHERE source = 'src0') GROUP BY 1")
def agg19(v: Views):
    return R.term_counts(v.docs().where("source = 'src0'"), "text")


@query("agg20_crosstab", f"SELECT rating, label, count(*)::BIGINT AS n FROM (SELECT rating, {_LABEL} AS label FROM interactions) GROUP BY ALL")
def agg20(v: Views):
    return R.crosstab(v.interactions().withColumn("label", C.sentiment_label("rating")), "rating", "label")


# -- windows and ranks -----------------------------------------------------------------------------


@query("win1_leave_last_out", f"{_LAST} SELECT user_id, item_id, rating, timestamp, 'train' AS part FROM train UNION ALL SELECT user_id, item_id, rating, timestamp, 'test' FROM test")
def win1(v: Views):
    train, test = R.leave_last_out(v.interactions())
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("win2_last_item", f"{_LAST}, r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) AS pos FROM train) SELECT user_id, item_id FROM r WHERE pos = 1")
def win2(v: Views):
    return R.last_item(R.leave_last_out(v.interactions())[0])


@query("win3_history", "SELECT user_id, string_agg(item_id, ',' ORDER BY timestamp, item_id) AS items, arg_max(item_id, struct_pack(t := timestamp, i := item_id)) AS seed_item FROM interactions GROUP BY 1")
def win3(v: Views):
    return R.user_history(v.interactions()).select("user_id", F.array_join("items", ",").alias("items"), "seed_item")


@query("win4_head_text", r"""t AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY item_id::BIGINT) AS pos FROM docs), j AS (SELECT source, string_agg(text, ' ' ORDER BY pos)[1:1500] AS text FROM t WHERE pos <= 50 GROUP BY 1)
SELECT source, text FROM j WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 20""")
def win4(v: Views):
    return R.head_text(v.docs(), "source", "text", [F.col("item_id").cast("long")])


@query("win6_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER () + 1e-9), 6) AS overall, round((p_retailprice - min(p_retailprice) OVER (PARTITION BY p_type)) / (max(p_retailprice) OVER (PARTITION BY p_type) - min(p_retailprice) OVER (PARTITION BY p_type) + 1e-9), 6) AS within FROM part")
def win6(v: Views):
    p = v.table("part").select("p_partkey", "p_type", "p_retailprice")
    both = R.minmax(R.minmax(p, "p_retailprice", None, "overall"), "p_retailprice", "p_type", "within")
    return both.select("p_partkey", F.round("overall", 6).alias("overall"), F.round("within", 6).alias("within"))


@query("win7_dedup", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders) WHERE pos = 1")
def win7(v: Views):
    return R.dedup_by(v.table("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("win10_best_per_item", "t AS (SELECT user_id, item_id, rating AS score, 'a' AS source FROM interactions UNION ALL SELECT user_id, item_id, helpful_vote, 'b' FROM reviews) SELECT user_id, item_id, score, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY score DESC, source DESC) AS pos FROM t) WHERE pos = 1")
def win10(v: Views):
    both = v.interactions().select("user_id", "item_id", F.col("rating").alias("score"), F.lit("a").alias("source")).unionByName(v.reviews().select("user_id", "item_id", F.col("helpful_vote").cast("double").alias("score"), F.lit("b").alias("source")))
    return R.best_per_item(both, ["user_id", "item_id"])


@query("top1_top_n", "SELECT item_id, price FROM metadata ORDER BY price DESC, item_id LIMIT 25")
def top1(v: Views):
    return R.top_n(v.metadata().select("item_id", "price"), "price", 25)


@query("top2_top_k_per", "SELECT main_category, item_id, price, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY main_category ORDER BY price DESC, item_id) AS rank FROM metadata) WHERE rank <= 10")
def top2(v: Views):
    return R.top_k_per(v.metadata().select("main_category", "item_id", "price"), "main_category", "price", 10)


@query("top3_winner", "SELECT 'price' AS metric, item_id AS winner, price AS value FROM metadata ORDER BY price, item_id LIMIT 1")
def top3(v: Views):
    return R.winner(v.metadata(), "item_id", "price", highest=False)


# -- scalar functions ------------------------------------------------------------------------------


@query("fn_text", r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:3], ' ') AS head, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS n_words, nullif(regexp_extract(text, '(\d+)', 1), '') AS number, concat_ws('-', lang, source) AS tag, array_to_string(list_transform(range(3), lambda x: lang), ' ') AS again FROM docs")
def fn_text(v: Views):
    return v.docs().select("item_id", F.array_join(F.slice(C.words("text"), 1, 3), " ").alias("head"), C.word_count("text").alias("n_words"), F.nullif(F.regexp_extract("text", r"(\d+)", 1), F.lit("")).alias("number"), F.concat_ws("-", "lang", "source").alias("tag"), C.repeat_text("lang", F.lit(3)).alias("again"))


@query("fn_numbers", "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS log1p, round(log2(p_size + 1), 6) AS log2, round(sqrt(p_retailprice), 6) AS root, abs(p_size - 25)::INTEGER AS apart, least(greatest(p_size, 10), 40)::INTEGER AS clipped, nullif(p_size, 1)::INTEGER AS not_one, round(sqrt(avg((p_size - 25) * (p_size - 25)) OVER ()), 6) AS rms FROM part")
def fn_numbers(v: Views):
    p = v.table("part")
    rms = p.agg(F.sqrt(F.avg((F.col("p_size") - 25) * (F.col("p_size") - 25))).alias("rms"))
    return p.crossJoin(F.broadcast(rms)).select("p_partkey", F.round(F.log1p("p_retailprice"), 6).alias("log1p"), F.round(F.log2(F.col("p_size") + 1), 6).alias("log2"), F.round(F.sqrt("p_retailprice"), 6).alias("root"), F.abs(F.col("p_size") - 25).alias("apart"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clipped"), F.nullif(F.col("p_size"), F.lit(1)).alias("not_one"), F.round("rms", 6).alias("rms"))


@query("fn_dates", "SELECT o_orderkey, date_diff('day', min(o_orderdate) OVER (), o_orderdate)::INTEGER AS days, year(o_orderdate)::INTEGER AS year FROM orders")
def fn_dates(v: Views):
    o = v.table("orders")
    return o.crossJoin(F.broadcast(o.agg(F.min("o_orderdate").alias("first")))).select("o_orderkey", C.days_between("o_orderdate", "first").alias("days"), F.year("o_orderdate").alias("year"))


@query("fn_lists", "SELECT p_partkey, 'size ' || p_size || ' brand ' || p_brand AS flat, 2 AS n, p_brand AS first, TRUE AS has FROM part")
def fn_lists(v: Views):
    made = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    listed = C.parse_list(made)
    return v.table("part").select("p_partkey", C.flat_map(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).alias("flat"), F.size(listed).alias("n"), listed[0].alias("first"), F.array_contains(listed, F.col("p_type")).alias("has"))


@query("fn_vectors", "SELECT vec_id, round(sqrt(list_dot_product(vector, vector)), 6) AS norm, round(list_dot_product(list_transform(vector, lambda x: 2 * x), vector), 6) AS doubled, round(list_sum(list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector)))), 6) AS unit_sum FROM review_vectors")
def fn_vectors(v: Views):
    x = v.review_vectors()
    return x.select("vec_id", F.round(C.norm("vector"), 6).alias("norm"), F.round(C.dot(C.scaled("vector", 2.0), F.col("vector")), 6).alias("doubled"), F.round(F.aggregate(C.unit("vector"), F.lit(0.0), lambda s, y: s + y), 6).alias("unit_sum"))
