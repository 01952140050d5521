"""Views that map the star-schema test tables to the engine's contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def interactions(self) -> DataFrame:
        rating = (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double")
        return self.lines().select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id"), rating.alias("rating"), F.col("l_shipdate").alias("timestamp"))

    def reviews(self) -> DataFrame:
        """Interactions with votes, purchase flag, price, category and a review text."""
        rating = (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double")
        return (
            self.lines()
            .join(self.table("part").select("p_partkey", "p_type", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").cast("string").alias("user_id"),
                F.col("l_partkey").cast("string").alias("item_id"),
                rating.alias("rating"),
                F.col("l_shipdate").alias("timestamp"),
                F.col("l_linenumber").cast("long").alias("helpful_vote"),
                (F.col("l_returnflag") == "N").alias("verified_purchase"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                F.col("p_type").alias("main_category"),
                F.col("p_name").alias("title"),
                F.col("p_brand").alias("store"),
                F.col("l_orderkey").alias("order_id"),
            )
        )

    def metadata(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"), F.col("p_type").alias("main_category"), F.col("p_retailprice").alias("price"))

    def order_names(self) -> DataFrame:
        """(key, item): part names of each order."""
        return self.table("lineitem").join(self.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("key"), F.col("p_name").alias("item"))

    def review_vectors(self) -> DataFrame:
        """Three and two vectors an item in turn."""
        return self.table("embeddings").select("vec_id", F.expr("vec_id * 2 div 5").cast("string").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))

    def meta_vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))

    def docs(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").cast("string").alias("item_id"), "text", "lang", "source", "n_chars")

    def search_queries(self) -> DataFrame:
        """The first five words of each benchmark item."""
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), 1, 5), " ").alias("query"))


#: The same views for DuckDB.
SQL_VIEWS = r"""
WITH interactions AS (
  SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, (floor((l_quantity - 1) / 10) + 1)::DOUBLE AS rating, l_shipdate AS timestamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), reviews AS (
  SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, (floor((l_quantity - 1) / 10) + 1)::DOUBLE AS rating, l_shipdate AS timestamp,
         l_linenumber::BIGINT AS helpful_vote, l_returnflag = 'N' AS verified_purchase, l_extendedprice / l_quantity AS price,
         p_type AS main_category, p_name AS title, p_brand AS store, l_orderkey AS order_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), metadata AS (
  SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_brand AS store, p_type AS main_category, p_retailprice AS price FROM part
), order_names AS (
  SELECT l_orderkey AS key, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey
), review_vectors AS (
  SELECT vec_id, (vec_id * 2 // 5)::VARCHAR AS item_id, embedding::DOUBLE[] AS vector FROM embeddings
), meta_vectors AS (
  SELECT vec_id::VARCHAR AS item_id, embedding::DOUBLE[] AS vector FROM embeddings
), docs AS (
  SELECT doc_id::VARCHAR AS item_id, text, lang, source, n_chars FROM documents
), search_queries AS (
  SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:5], ' ') AS query FROM benchmark
)"""
