"""Exact top-k by inner product: term-at-a-time accumulation of query blocks over item blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Vectors of a block of items and of queries; a pair of blocks takes ITEMS * QUERIES * 8 bytes for its scores.
ITEMS, QUERIES = 1000, 1000
#: Items of one share; each share gets all query blocks.
SHARE = 8_000
NONE = np.iinfo(np.int64).min
BLOCK = "share int, ids binary, weights binary, width int"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs (share, id, vector) rows, a batch at a time, ids ascending; shorter vectors end in zeros."""
    for batch in batches:
        share, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vectors = batch.column(2)
        size = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        width = int(size.max(initial=0))
        dense = np.zeros((len(ids), width), np.int64)
        dense[np.arange(width)[None, :] < size[:, None]] = flat
        for s in np.unique(share):
            at = np.flatnonzero(share == s)
            at = at[np.argsort(ids[at], kind="stable")]
            yield pa.record_batch({"share": pa.array([int(s)], pa.int32()), "ids": pa.array([ids[at].tobytes()], pa.binary()), "weights": pa.array([dense[at].tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})


def accumulate(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Scores of all queries against all items, a term at a time: each query that has the term scatters its weight times the term's postings."""
    scores = np.zeros((len(queries), len(items)), np.int64)
    for term in range(min(queries.shape[1], items.shape[1])):
        having = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(items[:, term])
        weights = np.outer(queries[having, term], items[postings, term])
        if len(having) == len(queries) and len(postings) == len(items):
            scores += weights
        else:
            scores[np.ix_(having, postings)] += weights
    return scores


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row, ties to the smaller column; NONE doesn't count."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), NONE + 1)
    least = np.maximum(least, NONE + 1)
    over = scores > least[:, None]
    room = k - over.sum(1)
    level = scores == least[:, None]
    over |= level & (np.cumsum(level, axis=1) <= room[:, None])
    return np.nonzero(over)


def exact_top_k(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k items of highest integer inner product for each query, ties to the smaller id.

    items, queries: (id long, vector array<long>). An item with the query's own id is left out. Every query block meets every
    item block: items are dealt into shares, each share gets the query blocks, and a pair of blocks keeps its k best.

    Null vectors and vectors with a null component take no part; nor do null ids. Shorter vectors count as ending in zeros.
    Repeated items each count. Fewer than k items: all. Empty tables give no rows.
    """
    spark = items.sparkSession
    common.prepare(spark, ITEMS)
    sound = lambda df: df.toDF("id", "vector").where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())).select(F.col("id").cast("long"), F.col("vector").cast("array<long>"))
    items, queries = sound(items), sound(queries)
    shares = max(1, items.count() // SHARE)
    query_blocks = max(1, -(-queries.count() // QUERIES))
    dealt = items.select(F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"), "id", "vector").repartition(shares, "share").mapInArrow(blocks, BLOCK)
    asked = queries.select(F.lit(0).alias("share"), "id", "vector").repartition(query_blocks, "id").mapInArrow(blocks, BLOCK)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.col("width").alias("q_width"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                scores = accumulate(np.frombuffer(row["q_weights"], np.int64).reshape(len(q_ids), row["q_width"]), np.frombuffer(row["weights"], np.int64).reshape(len(ids), row["width"]))
                scores[q_ids[:, None] == ids[None, :]] = NONE
                q, i = best(scores, k)
                yield pa.record_batch({"query_id": pa.array(q_ids[q]), "vec_id": pa.array(ids[i]), "score": pa.array(scores[q, i])})

    found = dealt.join(asked, "share").mapInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sound = vectors.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = sound.select("vec_id", F.transform("v", lambda x: F.floor(x * 1024)).alias("v"))
    return exact_top_k(whole, whole.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s
) WHERE rank <= 10
"""
