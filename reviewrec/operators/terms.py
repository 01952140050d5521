"""Terms of texts, counted where the texts lie: a document's counts are no rows of a shuffle unless several rows share its key."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewrec.sources import scratch

#: Different terms that a task holds before it hands them on.
HELD = 200_000
#: Words between white space, and words of two or more word characters; in Python's ASCII sense as in Java's.
PLAIN, WORDS = r"\S+", r"\w\w+"


def separate(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key is theirs alone, and the others: null keys and keys of several rows; None if there are none. Only keys are shuffled."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    many = scratch.written(counts.where("_key is null or _n > 1").select("_key"), "many")
    if many.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(many, same, "left_anti"), df.join(many, same, "left_semi")


def counter(pattern: str, pairs: bool) -> Callable[[str | None], Counter]:
    """From a text in lower case to the numbers of its words, and with `pairs` of its pairs of neighbours."""
    find = re.compile(pattern, re.ASCII).findall

    def count(text: str | None) -> Counter:
        found = find(text) if text is not None else []
        out = Counter(found)
        if pairs:
            out.update(map(" ".join, zip(found, found[1:])))
        return out

    return count


def counts(df: DataFrame, key: str, text: str, pattern: str, pairs: bool = False) -> DataFrame:
    """(key, term, tf) of rows whose keys differ."""
    count = counter(pattern, pairs)

    def made(keys: pa.Array, at: list, terms: list, tf: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=[key, "term", "tf"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, tf = [], [], []
            for n, one in enumerate(batch.column(1)):
                own = count(one.as_py())
                at += [n] * len(own)
                terms += own.keys()
                tf += own.values()
                if len(at) > HELD:
                    yield made(batch.column(0), at, terms, tf)
                    at, terms, tf = [], [], []
            yield made(batch.column(0), at, terms, tf)

    rows = df.select(key, F.lower(F.col(text)).alias("_text"))
    return rows.mapInArrow(each, T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def totals(df: DataFrame, text: str, pattern: str, pairs: bool = False) -> DataFrame:
    """(term, total, df): occurrences, and rows that have the term. A task adds up its own first; several rows of a term may come."""
    count = counter(pattern, pairs)

    def made(total: Counter, having: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([having[t] for t in total], pa.int64())], names=["term", "total", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, having = Counter(), Counter()
        for batch in batches:
            for one in batch.column(0):
                own = count(one.as_py())
                total.update(own)
                having.update(own.keys())
                if len(total) > HELD:
                    yield made(total, having)
                    total, having = Counter(), Counter()
        yield made(total, having)

    return df.select(F.lower(F.col(text)).alias("_text")).mapInArrow(add, "term string, total long, df long")


def weights(df: DataFrame, key: str, text: str, pattern: str, pairs: bool, known: dict[str, tuple[int, float]]) -> DataFrame:
    """(key, places, weights) of rows whose keys differ: the known terms' places, ascending, and their count times idf, of unit length together. known: (place, idf) by term."""
    count = counter(pattern, pairs)
    sent = df.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            places, values = [], []
            for one in batch.column(1):
                own = sorted((known[t][0], n * known[t][1]) for t, n in count(one.as_py()).items() if t in known)
                norm = sum(w * w for _, w in own) ** 0.5
                places.append([p for p, _ in own])
                values.append([w / norm for _, w in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=[key, "places", "weights"])

    rows = df.select(key, F.lower(F.col(text)).alias("_text"))
    return rows.mapInArrow(each, T.StructType([df.schema[key], T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))
