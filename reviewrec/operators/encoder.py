"""A text encoder fitted on the corpus: TF-IDF rows times the leading right singular vectors of the whole TF-IDF matrix, by a randomised method.

A pass multiplies a thin matrix by the rows and by their transpose, partition by partition, and adds the results up in two stages; the matrix of rows itself never moves. The driver holds
features times columns numbers, and features are at most those of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrec.functions.columns import unit
from reviewrec.sources.scratch import Scratch

from .svm import fit_vocabulary, tfidf_rows

#: Columns more than wanted, and passes over the rows.
MORE, PASSES = 10, 4


def times(start: np.ndarray, places: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sparse rows times q, a column at a time."""
    row, out = np.repeat(np.arange(len(start) - 1), np.diff(start)), np.zeros((q.shape[1], len(start) - 1))
    for c, column in enumerate(np.ascontiguousarray(q.T)):
        out[c] = np.bincount(row, values * column[places], out.shape[1])
    return out.T


def twice(start: np.ndarray, places: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The rows' transpose times the rows times q."""
    row, inner, out = np.repeat(np.arange(len(start) - 1), np.diff(start)), times(start, places, values, q).T, np.zeros_like(q)
    for c in range(q.shape[1]):
        out[:, c] = np.bincount(places, values * inner[c][row], len(q))
    return out


class TextEncoder:
    """vocabulary and directions: a row of `directions` for every term."""

    def __init__(self, vocabulary: DataFrame, directions: np.ndarray):
        self.vocabulary, self.directions = vocabulary, directions

    def encode(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """df with `vector`, of unit length; of zeros where no term is known. Rows with a null key go, and a key is one text."""
        q = self.directions

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
                made = times(offsets - offsets[0], batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), q)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * q.shape[1]), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "v"])

        rows = tfidf_rows(df.where(F.col(key).isNotNull()), key, text, self.vocabulary).withColumnRenamed(key, "k")
        made = rows.mapInArrow(project, f"k {df.schema[key].dataType.simpleString()}, v array<double>")
        return df.join(made, F.col(key) == F.col("k")).withColumn("vector", unit("v")).drop("k", "v")


def fit_encoder(df: DataFrame, key: str, text: str, size: int = 32, max_features: int = 15_000, seed: int = 42) -> TextEncoder:
    """From the texts of df; fewer than `size` directions if the texts have no more. The signs of directions are fixed by their largest entry."""
    spark = df.sparkSession
    vocabulary = fit_vocabulary(df, key, text, max_features)
    width = vocabulary.count()
    columns = min(size + MORE, width)
    q = np.linalg.qr(np.random.default_rng(seed).normal(0, 1, (width, columns)))[0] if width else np.zeros((0, 0))
    with Scratch(spark) as scratch:
        rows = scratch.written(tfidf_rows(df.where(F.col(key).isNotNull()), key, text, vocabulary).select("places", "weights"), "rows")
        parts = isqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))

        def product(q: np.ndarray) -> np.ndarray:
            def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros_like(q)
                for batch in batches:
                    offsets = batch.column(0).offsets.to_numpy().astype(np.int64)
                    out += twice(offsets - offsets[0], batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), q)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sum"])

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros_like(q)
                for batch in batches:
                    for raw in batch.column(0).to_pylist():
                        out = out + np.frombuffer(raw).reshape(q.shape)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sum"])

            found = rows.mapInArrow(own, "sum binary").repartition(parts).mapInArrow(add, "sum binary").collect()
            return sum(np.frombuffer(bytes(r["sum"])).reshape(q.shape) for r in found)

        for n in range(PASSES if width else 0):
            image = product(q)
            if n < PASSES - 1:
                q = np.linalg.qr(image)[0]
    if width:
        value, turn = np.linalg.eigh(q.T @ image)
        keep = np.argsort(-value)[: min(size, int((value > 1e-9 * max(value.max(), 1e-12)).sum()))]
        q = q @ turn[:, keep]
        q *= np.where(np.abs(q).max(0) == q.max(0), 1, -1)
    return TextEncoder(vocabulary, q)
