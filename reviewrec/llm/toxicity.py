"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER, U64, mix

#: Features: 2**20 at most, so the weights are 4 MB at most. Index 0 is the bias.
BITS = 20
#: Labelled rows that the classifier is fitted on at most; the first by a hash of the key.
TRAIN_ROWS = 16_000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.3, 1.0, 4.0, 1.0
THRESHOLD = 0.3

#: Words here: letters only. Any other ASCII byte separates; bytes from 0x80 on belong to letters.
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: A longer word also counts by its first so many bytes, as inflected words share their stem.
STEMS = (4, 5, 6, 7, 8)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and document of each word, its stems, pair of neighbours, and pair with one word between."""
    low = LOWER[data]
    start, end, at = common.word_places(low, bounds, _APART)
    sums = common.Prefix(common.BYTE[low])
    word = sums.spans(start, end)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    shift = U64(64 - BITS)
    found, of = [mix(word + U64(0x51ED270B)) >> shift], [doc]
    for size in STEMS:
        longer = np.flatnonzero(end - start > size)
        found.append(mix(sums.spans(start[longer], start[longer] + size) + U64(0x2545F491 + size)) >> shift)
        of.append(doc[longer])
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        found.append(mix(word[:-gap] * U64(odd) + word[gap:])[same] >> shift)
        of.append(doc[gap:][same])
    return np.concatenate(found).astype(np.int32), np.concatenate(of)


def ftrl(rows: Iterator[tuple[np.ndarray, int]], state: np.ndarray) -> None:
    """Follow-the-regularised-leader with per-coordinate rates; state: (z, n) of each coordinate, changed in place."""
    z, n = state
    for x, y in rows:
        zx, nx = z[x], n[x]
        w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
        n[x] = nx + g * g


def weights_of(state: np.ndarray) -> np.ndarray:
    z, n = state
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most `most` labelled rows, picked by a hash of the key.

    Features are made where the texts are; one task then runs the sequential descent over the bounded sample.
    """
    marked = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    sample = marked.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(sample), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = common.utf8(batch.column("text"))
            found: list[bytes] = []
            for i, j in common.slices(bounds):
                x, doc = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                pairs = np.unique((doc.astype(np.int64) << BITS) | np.maximum(x, 1))
                cut = np.searchsorted(pairs >> BITS, np.arange(j - i + 1))
                low = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                found += [np.append(np.int32(0), low[cut[k] : cut[k + 1]]).tobytes() for k in range(j - i)]
            order = common.mix(batch.column("id").to_numpy().view(U64)).view(np.int64)
            yield pa.record_batch({"at": pa.array(order), "y": batch.column("y"), "x": pa.array(found, pa.binary())})

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, np.int32), y) for b in batches for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        state = np.zeros((2, 1 << BITS))
        for _ in range(EPOCHS):
            ftrl(iter(rows), state)
        w = weights_of(state)
        at = np.flatnonzero(w)
        yield pa.record_batch({"feature": pa.array(at.astype(np.int32)), "weight": pa.array(w[at])})

    made = rows.mapInArrow(hashed, "at long, y int, x binary").repartition(1).sortWithinPartitions("at", "y", "x")
    table = made.mapInArrow(descend, "feature int, weight float").toArrow()
    weights = np.zeros(1 << BITS, np.float32)
    weights[table.column("feature").to_numpy()] = table.column("weight").to_numpy()
    return weights


def score(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probabilities of label 1. A feature counts once a text."""
    data, bounds = common.utf8(column)
    out = np.full(len(bounds) - 1, weights[0], np.float64)
    for i, j in common.slices(bounds):
        x, doc = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        x = np.maximum(x, 1)
        some = np.flatnonzero(weights[x])
        pairs = np.unique((doc[some].astype(np.int64) << BITS) | x[some])
        out[i:j] += np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to docs, learned from labels.

    The classifier is fitted on at most TRAIN_ROWS labelled rows; scoring reads every whole text. Null and empty text: the
    bias alone. Null labels or keys are not learned; of several labels for a key the highest counts. Without labels all
    scores are 0.5. Repeated rows score alike. Columns of docs with an output's name give way.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    weights = spark.sparkContext.broadcast(fit(docs, labels, key, text, label))
    taken = [c for c in carry or docs.columns if c not in ("score", "predicted")]

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        p = score(batch.column(0), weights.value)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return common.mapped(docs, taken, [F.col(f"`{text}`").cast("string")], predict, "score double, predicted int")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    return toxicity(docs, labels, carry=["doc_id", "held_out"])
