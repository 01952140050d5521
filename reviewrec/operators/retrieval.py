"""Pruned keyword search, and its fusion with vector search by a threshold algorithm. Both give what scoring every item gives.

Postings lie in blocks of about BLOCK items: for a term and a block one row, with its postings by falling impact and their highest one. The sum of a query's highest impacts in a
block bounds every score there. A query first reads the blocks with the highest bounds; the k-th score found prunes the rest.

The fused search takes items from two lists, by vector and by keyword score, as deep as `depth`, and looks up what the other list would give them. An item in
neither list scores at most what the two lists' ends give together; where the last wanted score isn't above that, the query goes on with deeper lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewrec.functions.columns import dot, words
from reviewrec.sources.scratch import Scratch

from .relational import top_k_per
from .vectors import top_products

#: Items of a block of postings, about.
BLOCK = 128
#: Sums in another order differ by less.
MARGIN = 1e-9


def impacts(posted: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, key: str = "item_id", only: DataFrame | None = None) -> DataFrame:
    """(key, term, impact): BM25 of one occurrence of the term in a query. Terms in over half of the items get eps times the mean idf instead of a negative one.

    only: the terms (term), each once, to return; the figures of the corpus are those of all.
    """
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    length = posted.groupBy(key).agg(F.sum("tf").alias("dl"))
    total = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = df.crossJoin(F.broadcast(total)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, eps * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    if only is not None:
        # no semi join: it would move below the counts, and the words of the texts be counted once more
        idf = F.broadcast(idf.join(F.broadcast(only), "term"))
    return posted.join(idf, "term").join(length, key).select(key, "term", part.alias("impact"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf) of (query_id, query)."""
    return queries.select("query_id", F.explode(words("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


class PostingBlocks:
    """A written index of (item_id, term, impact) with impacts of 0 or more."""

    def __init__(self, weighted: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.items = weighted.select("item_id").distinct().count()
        number = max(1, -(-self.items // BLOCK))
        dealt = weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(number)))
        posting = F.struct((-F.col("impact")).alias("below"), "item_id")
        rows = dealt.groupBy("term", "block").agg(F.max("impact").alias("most"), F.count("*").alias("n"), F.sort_array(F.collect_list(posting)).alias("postings"))
        self.rows = scratch.written(rows, "postings")
        self.sizes = scratch.written(dealt.groupBy("block").agg(F.countDistinct("item_id").alias("size")), "sizes")

    def _scores(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, item_id, bm25) in some blocks (query_id, block)."""
        met = pairs.join(asked, "query_id").join(self.rows.select("term", "block", "postings"), ["term", "block"])
        each = met.select("query_id", "qf", F.explode("postings").alias("p")).select("query_id", F.col("p.item_id").alias("item_id"), (-F.col("qf") * F.col("p.below")).alias("part"))
        return each.groupBy("query_id", "item_id").agg(F.sum("part").alias("bm25"))

    def top(self, asked: DataFrame, k: int, only: DataFrame | None = None, report: list | None = None) -> DataFrame:
        """(query_id, item_id, bm25, rank): the k items of the highest score above 0 of each query, ties to the smaller id; asked: see `query_terms`.

        only: other items than these (item_id) don't count. report: gets the number of postings that were read, and of those that the queries' terms have.
        """
        met = asked.join(self.rows.select("term", "block", "most", "n"), "term")
        sums = met.groupBy("query_id", "block").agg(F.sum(F.col("qf") * F.col("most")).alias("bound"), F.sum("n").alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        bounds = self.scratch.written(sums.withColumn("place", F.row_number().over(order)), "bounds")
        tried = F.col("place") <= 2 + k // (BLOCK // 8)
        own = lambda scores: scores if only is None else scores.join(only.select("item_id"), "item_id", "left_semi")
        first = self.scratch.written(top_k_per(own(self._scores(bounds.where(tried).select("query_id", "block"), asked)), "query_id", "bm25", k), "first")
        least = first.where(F.col("rank") == k).select("query_id", F.col("bm25").alias("least"))
        others = bounds.where(~tried).join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) * (1 - MARGIN))
        if report is not None:
            n = F.coalesce(F.sum("n"), F.lit(0))
            report.append((bounds.where(tried).select("n").unionByName(others.select("n")).agg(n).first()[0], bounds.agg(n).first()[0]))
        others = own(self._scores(others.select("query_id", "block"), asked))
        both = first.select("query_id", "item_id", "bm25").unionByName(others.select("query_id", "item_id", "bm25")).where("bm25 > 0")
        return top_k_per(both, "query_id", "bm25", k)

    def all_met(self, asked: DataFrame) -> DataFrame:
        """(query_id, bm25), the least score, of queries that share a term with every item. Blocks whose postings are fewer than their items settle most queries."""
        met = asked.join(self.rows.select("term", "block", "n"), "term").groupBy("query_id", "block").agg(F.sum("n").alias("n"))
        full = met.join(self.sizes, "block").where("n >= size").groupBy("query_id").count().join(self.sizes.agg(F.count("*").alias("all")), F.col("count") == F.col("all"), "left_semi")
        doubtful = asked.join(full.select("query_id"), "query_id", "left_semi")
        pairs = doubtful.select("query_id").distinct().join(met, "query_id").select("query_id", "block")
        found = self._scores(pairs, doubtful).groupBy("query_id").agg(F.count("*").alias("n"), F.min("bm25").alias("bm25"))
        return found.where(F.col("n") == self.items).select("query_id", "bm25")


def fused_top(queries: DataFrame, vectors: DataFrame, posted: DataFrame, k: int, of_vectors: float = 0.55, of_words: float = 0.45, depth: int | None = None, report: list | None = None) -> DataFrame:
    """(query_id, item_id, rank, emb, bm25, hybrid_score): for each query (query_id, query, vector) the k items (item_id, vector) of the highest sum of scaled scores, rounded, ties to the smaller id.

    The vector score is scaled by its least and highest over all vectors; BM25 by those over all items of posted (item_id, term, tf), items without a shared term at 0; an item
    without postings gets 0 after scaling. Queries or items with a null id or vector take no part. report: gets (depth, queries still open, read and present postings) a round.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark)
    with scratch:
        vectors = scratch.written(vectors.select("item_id", "vector").where("item_id is not null and vector is not null"), "vectors")
        open_ = scratch.written(queries.select("query_id", "query", "vector").where("query_id is not null and vector is not null"), "queries")
        weighted = scratch.written(impacts(posted), "impacts")
        n_items = vectors.count()
        depth = depth or 4 * k
        if weighted.where("impact < 0").isEmpty():
            asked = scratch.written(query_terms(open_), "terms")
            whole = PostingBlocks(weighted, scratch)
            high = whole.top(asked, 1).select("query_id", F.col("bm25").alias("hi"))
            edges = high.join(whole.all_met(asked).withColumnRenamed("bm25", "lo"), "query_id", "left").select("query_id", F.coalesce("lo", F.lit(0.0)).alias("lo"), "hi")
        else:  # mean idf under 0: only where most terms are in most items
            asked, listed = None, None
            scores = query_terms(open_).join(weighted, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("qf") * F.col("impact")).alias("bm25"))
            scores = scratch.written(scores, "scores")
            n = weighted.select("item_id").distinct().count()
            least = F.when(F.count("*") < n, F.least(F.min("bm25"), F.lit(0.0))).otherwise(F.min("bm25"))
            most = F.when(F.count("*") < n, F.greatest(F.max("bm25"), F.lit(0.0))).otherwise(F.max("bm25"))
            edges = scores.groupBy("query_id").agg(least.alias("lo"), most.alias("hi"))
        edges = scratch.written(edges, "edges")
        done = None
        while True:
            depth = n_items if asked is None else min(depth, n_items)
            found = scratch.written(_near(open_, vectors, depth), "near")
            ends = found.where("item_id is null").select("query_id", F.col("score").alias("e_lo")).join(found.where("rank = 1").select("query_id", F.col("score").alias("e_hi")), "query_id")
            by_vector = found.where("item_id is not null").select("query_id", "item_id")
            touched: list = []
            if asked is None:
                by_words, words_of = scores, scores
                candidates = by_vector
            else:
                own = asked.join(open_.select("query_id"), "query_id", "left_semi")
                by_words = scratch.written(whole.top(own, depth, vectors, touched if report is not None else None), "by_words")
                candidates = scratch.written(by_vector.unionByName(by_words.select("query_id", "item_id")).distinct(), "candidates")
                words_of = candidates.join(own, "query_id").join(weighted, ["item_id", "term"]).groupBy("query_id", "item_id").agg(F.sum(F.col("qf") * F.col("impact")).alias("bm25"))
            scaled = lambda x, lo, hi: (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo) + 1e-9)
            known = weighted.select("item_id").distinct().withColumn("known", F.lit(True)) if asked is None else None
            row = candidates.join(vectors, "item_id").join(open_.select("query_id", F.col("vector").alias("q")), "query_id").select("query_id", "item_id", dot("q", "vector").alias("e"))
            row = row.join(words_of.select("query_id", "item_id", "bm25"), ["query_id", "item_id"], "left").join(ends, "query_id").join(edges, "query_id", "left")
            if known is not None:
                row = row.join(known, "item_id", "left").withColumn("bm25", F.when(F.col("known"), F.coalesce("bm25", F.lit(0.0))))
            b = F.coalesce(scaled("bm25", "lo", "hi"), F.lit(0.0))
            both = row.select("query_id", "item_id", scaled("e", "e_lo", "e_hi").alias("emb"), b.alias("bm25"))
            both = both.withColumn("hybrid_score", F.round(of_vectors * F.col("emb") + of_words * F.col("bm25"), 6))
            best = scratch.written(top_k_per(both, "query_id", "hybrid_score", k), "best")
            if asked is None or depth >= n_items:
                closed, left = best, None
            else:
                # what no list has shown scores at most the two ends
                last_e = found.where(F.col("rank") == depth).join(ends, "query_id").select("query_id", scaled("score", "e_lo", "e_hi").alias("e"))
                last_b = by_words.where(F.col("rank") == depth).join(edges, "query_id").select("query_id", scaled("bm25", "lo", "hi").alias("b"))
                rest = last_e.join(last_b, "query_id", "left").select("query_id", (of_vectors * F.col("e") + of_words * F.coalesce("b", F.lit(0.0))).alias("rest"))
                sure = best.where(F.col("rank") == k).join(rest, "query_id").where(F.col("hybrid_score") > F.col("rest") + 1e-6).select("query_id")
                closed, left = best.join(sure, "query_id", "left_semi"), scratch.written(open_.join(sure, "query_id", "left_anti"), "open")
            done = closed if done is None else done.unionByName(closed)
            if report is not None:
                report.append((depth, open_.count(), touched[0] if touched else None))
            if left is None or left.isEmpty():
                break
            open_, depth = left, depth * 4
        out = scratch.written(done.select("query_id", "item_id", "rank", "emb", "bm25", "hybrid_score"), "fused")
        scratch.keep(out)
    return out


def _near(queries: DataFrame, vectors: DataFrame, depth: int) -> DataFrame:
    """(query_id, item_id, rank, score): the items of the highest products, and one row without item_id that holds the least product of all."""
    named = queries.select(F.concat(F.lit("?"), F.col("query_id").cast("string")).alias("query"), "vector")
    found = top_products(vectors, named, depth, None, least=True)
    id_type = queries.schema["query_id"].dataType
    return found.select(F.substr("query", F.lit(2)).cast(id_type).alias("query_id"), "item_id", "rank", "score")
