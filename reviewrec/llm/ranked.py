"""Ranked lexical search: exact inner products with sparse document vectors, found in ball trees best-first.

A document is a sparse vector of whole numbers, its impact for each term that some query has; a query one of term weights; the score is their inner
product. Documents are sorted by their heaviest terms and cut into blocks, each block a binary tree of balls (centroid, radius). For a query q and the
documents x of a ball with centroid c, radius r and the terms S: <q, x> = <q_S, c> + <q_S, x - c> <= <q_S, c> + |q_S| r. Centroids are rounded to
whole numbers and the radius is taken from the rounded one, squared; so the bound <q_S, c> + isqrt(|q_S|^2 r^2) is exact integer arithmetic and no rounding can lose
a document. A first round visits the most promising leaves only, and its k-th best score of all blocks prunes the second.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import floor, isqrt, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import LOWER, Scratch

#: Documents of a block and of a leaf, and blocks that one search sees together.
BLOCK, LEAF, TOGETHER = 4096, 32, 16
#: Documents of a range partition, about, where the session's number of partitions would give more.
ROWS = 1_000_000
#: Heaviest terms by which documents are sorted.
HEAVIEST = 3
#: Bytes of queries of one search; more queries are searched in groups of about that size, as their terms and weights go to every task.
QUERY_BYTES = 4_000_000

_ARRAYS = {
    "ids": np.int64, "start": np.int64, "terms": np.int32, "impacts": np.int64, "vocabulary": np.int64, "first": np.int32, "past": np.int32,
    "left": np.int32, "right": np.int32, "radius": np.int64, "least": np.int64, "center_start": np.int64, "center_terms": np.int32, "center": np.int64,
}
_BLOCK = ", ".join(f"{name} binary" for name in _ARRAYS)
_FOUND = "query int, doc_id long, score long"

#: Terms are runs of digits, letters and anything that isn't ASCII.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = common.utf8(texts)
    return common.word_hashes(LOWER[data], bounds, APART)


# -- vectors ------------------------------------------------------------------------------------------


def _gathered(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of some rows are, and the rows' own starts among them."""
    size = start[rows + 1] - start[rows]
    own = np.append(0, np.cumsum(size))
    return np.arange(own[-1]) + np.repeat(start[rows] - own[:-1], size), own


def counted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with a term at all: n terms, and of the sorted hashes the places of those that it has, with their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = common.utf8(batch.column(1))
            for lo, hi in common.slices(bounds):
                hashes, at = term_hashes(batch.column(1).slice(lo, hi - lo))
                size = np.diff(at)
                place = np.searchsorted(terms, hashes)
                place[place == len(terms)] = 0
                known = np.flatnonzero(terms[place] == hashes) if len(terms) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(hi - lo), size)[known]
                pair, tf = np.unique(doc * max(1, len(terms)) + place[known], return_counts=True)
                doc, place = np.divmod(pair, max(1, len(terms)))
                some = np.flatnonzero(size)
                start = np.searchsorted(doc, some)
                offsets = pa.array(np.append(start, len(doc)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place.astype(np.int32), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(size[some]), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<long>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Saturated frequencies of terms in documents of n terms, out of so many documents with so many terms together."""
    m = 25 + (75 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def _weighted(vectors: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """(doc_id, terms, impacts, heavy): with the places of the terms of the highest weighted impact, highest first."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tf, start = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            start = start - start[0]
            doc = np.repeat(np.arange(len(batch)), np.diff(start))
            x = impacts(tf, batch.column(1).to_numpy()[doc], documents, length)
            order = np.lexsort((terms, -weights[terms] * x, doc))
            rank = np.arange(len(doc)) - start[doc]
            top = [pa.array(np.full(len(batch), -1, np.int32)) for _ in range(HEAVIEST)]
            for k in range(HEAVIEST):
                column = np.full(len(batch), -1, np.int32)
                at = order[rank == k]
                column[doc[at]] = terms[at]
                top[k] = pa.array(column)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(x)), *top], names=["doc_id", "terms", "impacts", *(f"heavy{k}" for k in range(HEAVIEST))])

    some = vectors.where("doc_id is not null and size(terms) > 0")
    return some.mapInArrow(weigh, "doc_id long, terms array<int>, impacts array<long>, " + ", ".join(f"heavy{k} int" for k in range(HEAVIEST)))


# -- ball trees ---------------------------------------------------------------------------------------


class Block:
    """Documents in tree order, and the nodes of their tree: documents first..past, children, squared radius, smallest id, and for every term of the node the centroid's value."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls({name: np.frombuffer(row[name], kind) for name, kind in _ARRAYS.items()})

    def written(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in _ARRAYS.items()]

    @classmethod
    def built(cls, ids: np.ndarray, start: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF) -> Block:
        vocabulary, local = np.unique(terms, return_inverse=True)
        local = local.astype(np.int32)
        squares = np.add.reduceat(values * values, start[:-1]) if len(ids) else np.zeros(0, np.int64)
        dense = np.zeros(len(vocabulary), np.int64)
        first, past, left, right, radius, smallest, centers = [], [], [], [], [], [], []
        order: list[np.ndarray] = []

        def products(at: np.ndarray, own: np.ndarray, of_terms: np.ndarray, of: np.ndarray) -> np.ndarray:
            dense[of_terms] = of
            out = np.add.reduceat(values[at] * dense[local[at]], own[:-1])
            dense[of_terms] = 0
            return out

        def node(rows: np.ndarray, done: int) -> int:
            me = len(first)
            at, own = _gathered(start, rows)
            total = np.bincount(local[at], values[at], len(vocabulary)) / len(rows)
            present = np.unique(local[at])
            center = np.rint(total[present]).astype(np.int64)
            distance = squares[rows] + (center * center).sum() - 2 * products(at, own, present, center)
            first.append(done), past.append(done + len(rows)), left.append(-1), right.append(-1)
            radius.append(int(distance.max())), smallest.append(int(ids[rows].min())), centers.append((present, center))
            if len(rows) <= leaf or radius[me] == 0:
                order.append(rows[np.argsort(ids[rows], kind="stable")])
                return me
            far = [int(rows[np.argmax(distance)])]
            for _ in range(2):
                a = slice(start[far[-1]], start[far[-1] + 1])
                toward = squares[rows] + squares[far[-1]] - 2 * products(at, own, local[a], values[a])
                if len(far) == 1:
                    nearer, far = toward, [*far, int(rows[np.argmax(toward)])]
            side = np.argsort(nearer - toward, kind="stable")
            half = len(rows) // 2
            left[me] = node(rows[side[:half]], done)
            right[me] = node(rows[side[half:]], done + half)
            return me

        node(np.arange(len(ids)), 0)
        rows = np.concatenate(order)
        at, own = _gathered(start, rows)
        size = [len(t) for t, _ in centers]
        return cls({
            "ids": ids[rows], "start": own, "terms": local[at], "impacts": values[at], "vocabulary": vocabulary.astype(np.int64), "first": np.array(first), "past": np.array(past),
            "left": np.array(left), "right": np.array(right), "radius": np.array(radius), "least": np.array(smallest), "center_start": np.append(0, np.cumsum(size)),
            "center_terms": np.concatenate([t for t, _ in centers]), "center": np.concatenate([c for _, c in centers]),
        })

    def bound(self, node: int, query: np.ndarray) -> int:
        """No document of the node has a higher score. query: weights of the block's terms."""
        own = slice(self.center_start[node], self.center_start[node + 1])
        q = query[self.center_terms[own]]
        return int(q @ self.center[own]) + isqrt(int(q @ q) * int(self.radius[node]))

    def scores(self, node: int, query: np.ndarray) -> np.ndarray:
        a, b = self.first[node], self.past[node]
        own = slice(self.start[a], self.start[b])
        return np.add.reduceat(self.impacts[own] * query[self.terms[own]], self.start[a:b] - self.start[a])


def _worse(score: int, doc: int, than: tuple[int, int]) -> bool:
    return score < than[0] or (score == than[0] and doc > than[1])


def best_first(blocks: list[Block], weights: np.ndarray, k: int, found: list[tuple[int, int]], least: tuple[int, int] | None, leaves: int | None = None) -> int:
    """Adds the best documents to `found`, (-score, id) ascending, k at most; gives the number of documents that were scored.

    weights: the query's, of all terms. least: a score and id that k documents reach; worse ones may be left out. leaves: stop after so many.
    """
    local = [weights[b.vocabulary] for b in blocks]
    least = least or (1, np.iinfo(np.int64).max)
    heap = []

    def push(block: int, node: int) -> None:
        bound, smallest = blocks[block].bound(node, local[block]), int(blocks[block].least[node])
        if not _worse(bound, smallest, least):
            heapq.heappush(heap, (-bound, smallest, block, node))

    for block, query in enumerate(local):
        if query.any():
            push(block, 0)
    scored = 0
    while heap:
        bound, smallest, block, node = heapq.heappop(heap)
        if _worse(-bound, smallest, least):
            break
        own = blocks[block]
        if own.left[node] >= 0:
            push(block, int(own.left[node]))
            push(block, int(own.right[node]))
            continue
        scores, ids = own.scores(node, local[block]), own.ids[own.first[node] : own.past[node]]
        scored += len(scores)
        near = np.flatnonzero(scores >= least[0])
        if len(near) > k:
            near = near[np.lexsort((ids[near], -scores[near]))[:k]]
        found += [(-int(scores[i]), int(ids[i])) for i in near]
        found.sort()
        del found[k:]
        if len(found) == k and not _worse(-found[-1][0], found[-1][1], least):
            least = (-found[-1][0], found[-1][1])
        leaves = leaves - 1 if leaves else leaves
        if leaves == 0:
            break
    return scored


def _blocks(weighted: DataFrame) -> DataFrame:
    size = BLOCK

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            start = table.column(1).offsets.to_numpy().astype(np.int64)
            block = Block.built(table.column(0).to_numpy(), start - start[0], table.column(1).flatten().to_numpy(), table.column(2).flatten().to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in block.written()], names=list(_ARRAYS))

        for batch in batches:
            done = 0
            while done < len(batch):
                held.append(batch.slice(done, size - number))
                number, done = number + len(held[-1]), done + len(held[-1])
                if number == size:
                    yield flush()
                    held, number = [], 0
        if number:
            yield flush()

    return weighted.mapInArrow(build, _BLOCK)


def _searched(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], terms: int, k: int, least: dict[int, tuple[int, int]], leaves: int | None) -> DataFrame:
    """(query, doc_id, score): of each task the k best of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        weights = np.zeros(terms, np.int64)
        for batch in batches:
            blocks = [Block.read(r) for r in batch.to_pylist()]
            for number, (places, own) in enumerate(queries):
                weights[places] = own
                best_first(blocks, weights, k, best[number], least.get(number), leaves)
                weights[places] = 0
        rows = [(number, doc, -score) for number, found in enumerate(best) for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return index.mapInArrow(search, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query (item_id, text, ..) the k documents (doc_id, text, ..) of the highest score above 0, ties to the smaller id.

    Rows of one item_id are one query with the terms of them all; a query without terms finds nothing, nor does a null item_id. Null texts have no terms.
    A repeated doc_id is found once a row. A row without doc_id counts in the statistics, but isn't found. Other columns are ignored. Without
    documents or queries there are no rows. Terms are compared by a 64-bit hash.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // QUERY_BYTES))
    out = None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()
        found = _search_group(spark, docs, [(r.item_id, r.text) for r in rows], k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_group(spark: SparkSession, docs: DataFrame, rows: list[tuple[int, str]], k: int) -> DataFrame:
    hashes, at = term_hashes(pa.array([t for _, t in rows], pa.string()))
    terms = np.unique(hashes)
    own: dict[int, Counter] = {item: Counter() for item, _ in sorted(rows)}
    for n, (item, _) in enumerate(rows):
        own[item].update(np.searchsorted(terms, hashes[at[n] : at[n + 1]]).tolist())
    items = spark.createDataFrame(list(enumerate(own)), "query int, item_id long")
    with Scratch(spark) as scratch:
        common.prepare(spark)
        vectors = scratch.written(counted(docs, terms), "vectors")
        documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(documents, df.get(t, 0)) for t in range(len(terms))], np.int64)
        asked = [(np.array(list(c), np.int64), np.array([weights[t] * x for t, x in c.items()], np.int64)) for c in own.values()]
        heavy = [f"heavy{n}" for n in range(HEAVIEST)]
        weighted = _weighted(vectors, weights, documents, length or 1)
        parts = max(common.shuffle_partitions(spark), -(-documents // ROWS))
        dealt = weighted.repartitionByRange(parts, *heavy, "doc_id").sortWithinPartitions(*heavy, "doc_id").select("doc_id", "terms", "impacts")
        index = scratch.written(_blocks(dealt), "balls")
        scratch.drop(vectors)
        common.prepare(spark, TOGETHER)
        tried = _ranked(scratch.written(_searched(index, asked, len(terms), k, {}, 1), "tried"), k)
        least = {r.query: (r.score, r.doc_id) for r in tried.where(F.col("rank") == k).collect()}
        found = scratch.written(_ranked(_searched(index, asked, len(terms), k, least, None), k), "found")
        scratch.keep(found)
    common.prepare(spark)
    return found.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), total AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0
), q AS (
  SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL
), p AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total GROUP BY t
), s AS (
  SELECT item_id, r, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), total WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
