"""Keyword and vector search over item tables, for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reviewrec.functions.columns import added, dot, repeat_text, scaled, unit, words  # noqa: F401
from reviewrec.sources.scratch import Scratch

from .encoder import TextEncoder, fit_encoder
from .relational import group_bands, item_ratings, minmax, top_k_per
from .retrieval import impacts, query_terms
from .terms import PLAIN, counts, separate
from .vectors import near_products, top_products


def embed_text(df: DataFrame, text: str, key: str = "item_id", size: int = 32, seed: int = 42, encoder: TextEncoder | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds `vector`, of unit length. encoder: a fitted one, or a function that adds it, for instance a pandas UDF over a model; else one is fitted on df."""
    if callable(encoder):
        return encoder(df)
    return (encoder or fit_encoder(df, key, text, size, seed=seed)).encode(df, key, text)


def mean_vectors(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, vector, n): component-wise mean."""
    parts = vectors.select(key, F.posexplode("vector").alias("at", "x"))
    mean = parts.groupBy(key, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"), F.max("n").alias("n")).select(key, F.transform("v", lambda p: p["x"]).alias("vector"), "n")


def product_vectors(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """(item_id, vector): .7 review mean and .3 metadata with three reviews or more, else .3 and .7; unit length. Without metadata the review mean."""
    joined = mean_vectors(reviews).join(meta.select("item_id", F.col("vector").alias("meta")), "item_id", "left")
    w = F.when(F.col("n") >= 3, 0.7).otherwise(0.3)
    both = added(scaled("vector", w), scaled("meta", 1 - w))
    return joined.select("item_id", unit(F.when(F.col("meta").isNull(), F.col("vector")).otherwise(both)).alias("vector"))


def postings(docs: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, term, tf). A row is counted where it lies; only the terms of rows that share a key, or have none, are grouped."""
    alone, shared = separate(docs, key)
    posted = counts(alone, key, text, PLAIN)
    if shared is None:
        return posted
    return posted.unionByName(shared.select(key, F.explode(words(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))


def bm25(posted: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, key: str = "item_id") -> DataFrame:
    """(query_id, key, bm25) for items that share a term with the query; repeated query words count again.

    Terms in over half of the items get eps times the mean idf instead of a negative one.
    """
    asked = query_terms(queries)
    return _summed_impacts(impacts(posted, k1, b, eps, key, asked.select("term").distinct()), asked, key)


def _summed_impacts(weighted: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(query_id, key, bm25). An item's terms lie together, so its scores are summed where they are made and no pair of query and item is shuffled."""
    found = weighted.repartition(key).join(F.broadcast(asked), "term")
    return found.groupBy("query_id", key).agg(F.sum(F.col("qf") * F.col("impact")).alias("bm25"))


#: Vectors of a block of queries or items; a task makes so many times as many scores at once.
BLOCK = 256


def score_vectors(queries: DataFrame, vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """(query_id, key, emb) for all queries (query_id, vector) and items: blocks of both meet as matrices. A null vector has null scores."""

    def blocks(df: DataFrame, own: str, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // BLOCK))
        rows = df.select(F.struct(F.col(own).alias("id"), "vector").alias("row"), F.pmod(F.xxhash64(own), F.lit(n)).alias("block"))
        return rows.groupBy("block").agg(F.collect_list("row").alias(name)), n

    (asked, _), (items, n) = blocks(queries, "query_id", "q"), blocks(vectors, key, "i")
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("emb", T.DoubleType())]
    spread = items.repartition(min(n, 1 << 14), "block").select("i")
    return spread.crossJoin(asked.select("q")).select("q", "i").mapInArrow(_met, T.StructType(fields))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All scores of rows (q, i) of two blocks of (id, vector)."""
    for batch in batches:
        for k in range(len(batch)):
            (asked, q, sound_q), (ids, v, sound_v) = (_side(batch.column(c).slice(k, 1).flatten()) for c in (0, 1))
            scores = pa.array((q @ v.T if q.shape[1] == v.shape[1] else np.zeros((len(q), len(v)))).ravel(), pa.float64(), mask=~np.outer(sound_q, sound_v).ravel())
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(len(q)), len(v)))), ids.take(pa.array(np.tile(np.arange(len(v)), len(q)))), scores], names=["query_id", "item_id", "emb"])


def _side(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors as a matrix, and which rows have one; the others are zero."""
    ids, vectors = rows.flatten()
    return ids, *_rows_of(vectors)


def _rows_of(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sound = vectors.is_valid().to_numpy(zero_copy_only=False)
    there = vectors.drop_null()
    out = np.zeros((len(vectors), len(there[0]) if len(there) else 0))
    if len(there):
        out[sound] = there.flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1)
    return out, sound


def _with_cosine(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the cosine of two vectors instead of these; of a null vector null, of a zero one 0."""
    rest = [c for c in df.columns if c not in (a, b)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, sound_x), (y, sound_y) = (_rows_of(batch.column(len(rest) + k)) for k in (0, 1))
            if x.shape[1] and y.shape[1]:
                x, y = (v / np.where((n := np.sqrt((v * v).sum(1))) > 0, n, 1.0)[:, None] for v in (x, y))
                cosine = (x * y).sum(1)
            else:
                cosine = np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(cosine, pa.float64(), mask=~(sound_x & sound_y))], names=[*rest, name])

    out = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.DoubleType())])
    return df.select(*rest, a, b).mapInArrow(add, out)


def _group_means(rows: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """(keys, name): the mean vector of each group of rows without a null vector. A task sums the vectors that it sees of a group, so few vectors are shuffled and no row is opened."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            values, sound = _rows_of(batch.column(len(keys)))
            own = pa.Table.from_batches([batch.select(list(range(len(keys))))]).append_column("_at", pa.array(np.arange(len(batch)))).filter(pa.array(sound))
            for group in own.group_by(keys, use_threads=False).aggregate([("_at", "list")]).to_pylist():
                at = group.pop("_at_list")
                held = sums.setdefault(tuple(group[c] for c in keys), [0.0, 0])
                held[0], held[1] = held[0] + values[at].sum(0), held[1] + len(at)
        if sums:
            columns = [pa.array([k[c] for k in sums], t.type) for c, t in enumerate(batch.schema) if c < len(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())], names=[*keys, "total", "n"])

    part = T.StructType([*(rows.schema[c] for c in keys), T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    parts = rows.select(*keys, vector).mapInArrow(add, part)
    added = parts.select(*keys, "n", F.posexplode("total").alias("at", "x")).groupBy(*keys, "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return added.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(*keys, F.transform("v", lambda p: p["x"]).alias(name))


def hybrid_search(queries: DataFrame, vectors: DataFrame, posted: DataFrame, k: int = 50, threshold: float = 0.20, least: int = 20, all_hits: bool = False) -> DataFrame:
    """(query_id, item_id, rank, emb_score, bm25_score, hybrid_score).

    .55 vector similarity + .45 BM25, each scaled to 0..1 within the query: similarity over all items with a vector, BM25 over all of posted, with 0 for items that share no term. An
    item without postings has bm25_score 0. Kept: the best k of the scores at or over the threshold, if there are `least` of those; else the best max(least, k) of all.
    all_hits: every score at or over the threshold stays, and k counts only where there are fewer than `least`.
    """
    tables = Scratch(queries.sparkSession)
    asked = query_terms(queries)
    weighted = tables.written(impacts(posted, only=asked.select("term").distinct()), "impacts")
    corpus = tables.written(posted.select("item_id").distinct(), "corpus")
    # items that share no term have 0, but where all share one that is not among the scores
    sums = _summed_impacts(weighted, asked, "item_id").groupBy("query_id").agg(F.count("*").alias("n"), F.min("bm25").alias("lo"), F.max("bm25").alias("hi"))
    rest = sums.crossJoin(F.broadcast(corpus.agg(F.count("*").alias("of")))).withColumn("zero", F.when(F.col("n") < F.col("of"), 0.0))
    edges = rest.select("query_id", F.least("lo", "zero").alias("lo"), F.greatest("hi", "zero").alias("hi"))
    own = vectors.select("item_id")
    known = corpus.join(own, "item_id", "left_semi").withColumn("known", F.lit(True))
    shared = _summed_impacts(weighted.join(own, "item_id", "left_semi"), asked, "item_id")
    # written once, as their extremes are joined to them
    made = tables.written(score_vectors(queries, vectors), "emb")
    emb = minmax(made, "emb", "query_id").join(known, "item_id", "left")
    joined = emb.join(shared, ["query_id", "item_id"], "left").join(edges, "query_id", "left").fillna(0.0, ["bm25", "lo", "hi"])
    scaled_ = F.when(F.col("known"), (F.col("bm25") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).otherwise(0.0)
    scored = joined.select("query_id", "item_id", "emb", scaled_.alias("bm25")).withColumn("hybrid_score", F.round(0.55 * F.col("emb") + 0.45 * F.col("bm25"), 6))
    scored = tables.written(scored, "scored")
    tables.drop(made)
    hits = scored.groupBy("query_id").agg(F.count_if(F.col("hybrid_score") >= threshold).alias("hits"))
    counted = scored.join(hits, "query_id")
    few = top_k_per(counted.where(F.col("hits") < least), "query_id", "hybrid_score", max(least, k)).drop("rank")
    kept = counted.where((F.col("hits") >= least) & (F.col("hybrid_score") >= threshold)).unionByName(few)
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "item_id")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if not all_hits:
        ranked = ranked.where(F.col("rank") <= max(least, k)).where((F.col("rank") <= k) | (F.col("hits") < least))
    return ranked.select("query_id", "item_id", "rank", F.round("emb", 6).alias("emb_score"), F.round("bm25", 6).alias("bm25_score"), "hybrid_score")


def score_band_cluster(results: DataFrame, vectors: DataFrame, n: int = 4) -> DataFrame:
    """results with `band` (n - 1 is the top) and `position`: within a band by closeness to its centroid, top band first."""
    group = Window.partitionBy("query_id")
    tables = Scratch(results.sparkSession)
    results = tables.written(results.select("query_id", "item_id", "hybrid_score"), "results")
    banded = group_bands(results, "query_id", "hybrid_score", n)
    joined = banded.join(vectors.select("item_id", "vector"), "item_id")
    center = tables.written(_group_means(joined, ["query_id", "band"], "vector", "center"), "centers")
    near = _with_cosine(joined.join(center, ["query_id", "band"]), "vector", "center", "closeness").withColumn("closeness", F.round("closeness", 6))
    order = group.orderBy(F.desc("band"), F.desc("closeness"), "item_id")
    return near.withColumn("position", F.row_number().over(order)).select("query_id", "item_id", "hybrid_score", "band", "closeness", "position")


def rerank(results: DataFrame, mode: str = "relevance", interactions: DataFrame | None = None, profiles: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """results with `final_score` and `position`.

    relevance: the hybrid score. quality: .6 hybrid + .4 mean rating as 0..1 (3.0 where unrated). trending: .6 hybrid + .4 log count over the
    result's largest (count 1 where unrated). personalized: .5 hybrid + .5 scaled cosine to the query's user profile (query_id, profile); without one relevance.
    """
    from reviewrec.functions.columns import rating_unit

    if mode == "relevance":
        out = results.withColumn("final_score", F.col("hybrid_score"))
    elif mode in ("quality", "trending"):
        rated = results.join(item_ratings(interactions), "item_id", "left")
        if mode == "quality":
            out = rated.withColumn("final_score", 0.6 * F.col("hybrid_score") + 0.4 * rating_unit(F.coalesce("avg_rating", F.lit(3.0))))
        else:
            log = F.log1p(F.coalesce("n_reviews", F.lit(1)))
            out = rated.withColumn("_log", log).withColumn("final_score", 0.6 * F.col("hybrid_score") + 0.4 * F.col("_log") / F.max("_log").over(Window.partitionBy("query_id")))
    elif mode == "personalized":
        joined = results.join(profiles.select("query_id", "profile"), "query_id", "left").join(vectors.select("item_id", "vector"), "item_id")
        asked = joined.select("query_id", "item_id", "hybrid_score", F.col("profile").isNull().alias("_none"), "profile", "vector")
        # written once, as their extremes are joined to them
        close = minmax(Scratch(results.sparkSession).written(_with_cosine(asked, "profile", "vector", "_close"), "close"), "_close", "query_id")
        out = close.withColumn("final_score", F.when(F.col("_none"), F.col("hybrid_score")).otherwise(0.5 * F.col("hybrid_score") + 0.5 * F.col("_close")))
    else:
        raise ValueError(f"unknown mode {mode}")
    # halves round alike in any engine
    out = out.withColumn("final_score", F.round(F.col("final_score") + 1e-9, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "item_id")
    return out.select("query_id", "item_id", "hybrid_score", "final_score", F.row_number().over(order).alias("position"))


def user_profile_text(reviews: DataFrame, text: str, order: list, users: int = 50, chars: int = 3000) -> DataFrame:
    """(user_id, text) of the most active users: their texts, each as often as its rating, cut to so many characters."""
    from .relational import top_groups

    top = top_groups(reviews, "user_id", users)
    rows = reviews.join(top, "user_id", "left_semi").withColumn("_at", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    weighted = rows.select("user_id", "_at", repeat_text(text, F.greatest(F.lit(1), F.round("rating").cast("int"))).alias("t"))
    joined = weighted.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_at", "t"))).alias("r"))
    return joined.select("user_id", F.substring(F.array_join(F.transform("r", lambda x: x["t"]), " "), 1, chars).alias("text"))


def user_profiles(reviews: DataFrame, text: str, order: list, users: int = 50, encoder: TextEncoder | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(user_id, text, vector) of the most active users, in the encoder's space, which should be that of the items."""
    return embed_text(user_profile_text(reviews, text, order, users), "text", "user_id", encoder=encoder)


def similar_items(vectors: DataFrame, seeds: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(seed_item, rank, item_id, score): cosine, the seed left out; an unknown seed has none. probes: search an inverted file, so many cells a seed; else every item."""
    units = vectors.select("item_id", unit("vector").alias("vector"))
    q = seeds.select("seed_item").distinct().join(units, F.col("seed_item") == F.col("item_id")).select(F.col("seed_item").alias("query"), "vector")
    found = top_products(units, q, k) if probes is None else near_products(units, q, k, probes)
    return found.select(F.col("query").alias("seed_item"), "rank", "item_id", "score", F.lit("semantic").alias("source"))
