"""A linear SVM over sparse TF-IDF rows: squared hinge with an L2 penalty and weights of classes, one class against the rest.

Rows stay where they are; a step of the optimiser sends the weights out and gets the summed slopes of every partition, added up in two stages. The driver holds the weights alone,
classes times features, and some earlier steps of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewrec.sources.scratch import Scratch

from .sentiment import balanced_weights, terms, vocabulary
from .terms import WORDS, separate, weights

#: Steps that the optimiser remembers.
MEMORY = 10


def fit_vocabulary(df: DataFrame, key: str, text: str, max_features: int = 15_000) -> DataFrame:
    """(term, idx, idf) of the most frequent words and word pairs, max_features rows at most, so the table can be broadcast."""
    rows = vocabulary(df, key, text, max_features, separate(df, key))
    return df.sparkSession.createDataFrame([(r.term, k, r.idf) for k, r in enumerate(rows)], "term string, idx int, idf double")


def tfidf_rows(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, places, weights): a document's terms by place, of unit length together. Documents without a known term have empty lists."""
    alone, shared = separate(df, key)
    own = weights(alone, key, text, WORDS, True, {r.term: (r.idx, r.idf) for r in vocabulary.collect()})
    if shared is None:
        return own
    tf = terms(shared, key, text).join(F.broadcast(vocabulary), "term").groupBy(key, "idx").agg((F.count("*") * F.first("idf")).alias("w"))
    rows = tf.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("r"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sparse = rows.select(key, F.transform("r", lambda x: x["idx"]).alias("places"), F.transform("r", lambda x: x["w"] / F.col("norm")).alias("weights"))
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("places", "array<int>"), ("weights", "array<double>"))]
    return own.unionByName(shared.select(key).distinct().join(sparse, key, "left").select(key, *none))


def loss_and_slope(w: np.ndarray, start: np.ndarray, places: np.ndarray, values: np.ndarray, label: np.ndarray, cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Of rows in a sparse form; w: (classes, features + 1), the last one the constant; label: the class's place."""
    row = np.repeat(np.arange(len(label)), np.diff(start))
    slope, loss = np.zeros_like(w), 0.0
    for c in range(len(w)):
        margin = np.bincount(row, values * w[c, places], len(label)) + w[c, -1]
        y = np.where(label == c, 1.0, -1.0)
        short = np.maximum(0, 1 - y * margin)
        loss += float((cost * short**2).sum())
        pull = -2 * cost * y * short
        slope[c, :-1] = np.bincount(places, pull[row] * values, w.shape[1] - 1)
        slope[c, -1] = pull.sum()
    return loss, slope


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float = 1e-3) -> np.ndarray:
    """Limited-memory quasi-Newton with a backtracking line search, for a smooth convex f that gives value and slope."""
    value, slope = f(x)
    first, past = np.linalg.norm(slope), []
    for _ in range(steps):
        if np.linalg.norm(slope) <= tolerance * max(first, 1e-12):
            break
        way, coefficients = slope.copy(), []
        for s, y, r in reversed(past):
            a = r * (s * way).sum()
            way -= a * y
            coefficients.append(a)
        if past:
            s, y, _ = past[-1]
            way *= (s * y).sum() / (y * y).sum()
        else:
            way /= max(first, 1.0)
        for (s, y, r), a in zip(past, reversed(coefficients), strict=True):
            way += s * (a - r * (y * way).sum())
        size, down = 1.0, (slope * way).sum()
        while True:
            new_value, new_slope = f(x - size * way)
            if new_value <= value - 1e-4 * size * down or size < 1e-8:
                break
            size /= 2
        s, y = -size * way, new_slope - slope
        x, value, slope = x + s, new_value, new_slope
        if (s * y).sum() > 1e-12:
            past = [*past, (s, y, 1 / (s * y).sum())][-MEMORY:]
    return x


def _sparse(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = batch.column(at).offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], batch.column(at).flatten().to_numpy(), batch.column(at + 1).flatten().to_numpy()


class LinearSvm:
    def __init__(self, weights: np.ndarray, classes: list, key: str, text: str, label: str, vocabulary: DataFrame):
        self.weights, self.classes, self.key, self.text, self.label, self.vocabulary = weights, classes, key, text, label, vocabulary

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `prediction`, the class of the highest margin, the first of equal ones."""
        weights, classes = self.weights, np.array(self.classes)

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                start, places, values = _sparse(batch, 1)
                row = np.repeat(np.arange(len(batch)), np.diff(start))
                margins = np.stack([np.bincount(row, values * w[places], len(batch)) + w[-1] for w in weights])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes[margins.argmax(0)], pa.float64())], names=["k", "prediction"])

        rows = tfidf_rows(df, self.key, self.text, self.vocabulary)
        fields = [T.StructField("k", df.schema[self.key].dataType), T.StructField("prediction", T.DoubleType())]
        return df.join(rows.mapInArrow(guess, T.StructType(fields)), F.col(self.key) == F.col("k")).drop("k")


def fit_svm(df: DataFrame, key: str, text: str, label: str, vocabulary: DataFrame, cost: float = 1.0, steps: int = 60) -> LinearSvm:
    """From (key, text, label): the minimum of half the squared weights, constants too, and cost times each row's class weight times its squared hinge.

    Classes weigh n / (classes * rows of the class). Rows with a null label or key take no part; a key is one document.
    """
    spark = df.sparkSession
    sound = df.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, text, label)
    width = vocabulary.count()
    with Scratch(spark) as scratch:
        share = {r[0]: r[1] for r in balanced_weights(sound, label).collect()}
        classes = sorted(share)
        place = spark.createDataFrame([(c, k, cost * share[c]) for k, c in enumerate(classes)], T.StructType([T.StructField("c", sound.schema[label].dataType), T.StructField("y", T.IntegerType()), T.StructField("cost", T.DoubleType())]))
        rows = tfidf_rows(sound, key, text, vocabulary).join(sound.select(key, label), key).join(F.broadcast(place), F.col(label) == F.col("c"))
        rows = scratch.written(rows.select("y", "places", "weights", "cost"), "rows")
        parts = isqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))

        def summed(w: np.ndarray) -> tuple[float, np.ndarray]:
            def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                loss, slope = 0.0, np.zeros_like(w)
                for batch in batches:
                    start, places, values = _sparse(batch, 1)
                    more, by = loss_and_slope(w, start, places, values, batch.column(0).to_numpy(), batch.column(3).to_numpy())
                    loss, slope = loss + more, slope + by
                yield _sums(loss, slope)

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                loss, slope = 0.0, np.zeros_like(w)
                for batch in batches:
                    for x, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        loss, slope = loss + x, slope + np.frombuffer(raw).reshape(w.shape)
                yield _sums(loss, slope)

            partial = rows.mapInArrow(own, "loss double, slope binary")
            found = partial.repartition(parts).mapInArrow(add, "loss double, slope binary").collect()
            slope = sum(np.frombuffer(bytes(r.slope)).reshape(w.shape) for r in found)
            return 0.5 * float((w * w).sum()) + sum(r.loss for r in found), w + slope

        weights = minimised(summed, np.zeros((len(classes), width + 1)), steps)
    return LinearSvm(weights, classes, key, text, label, vocabulary)


def _sums(loss: float, slope: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])
