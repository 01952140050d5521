"""Shared pieces of the training-data operators: scratch tables, Arrow buffers as numpy, hashing.

Python here only ever sees one Arrow batch at a time; Spark partitions, shuffles and retries the work.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewrec.sources.scratch import Scratch, scratch_dir, written

__all__ = ["BYTE", "LOWER", "SPACE", "U64", "Prefix", "Scratch", "columns", "mapped", "mix", "powers", "prepare", "scratch_dir", "shuffle_partitions", "signed", "slices", "trim", "utf8", "word_hashes", "word_places", "written"]

U64 = np.uint64


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, as texts are long and a batch is held whole; and the shuffle files of a step go when it ends, as its result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives back what earlier tasks of this worker freed but still hold, as a worker serves all stages of a pipeline."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


# -- columns that go along --------------------------------------------------------------------------


def columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def mapped(docs: DataFrame, taken: list[str], others: list[Column], step: Callable[[pa.RecordBatch], list[pa.Array]], added: str) -> DataFrame:
    """Columns of docs by name, and added ones (DDL), which step makes from a batch of the others. Names inside are numbers, so none can clash."""
    fields = T.StructType.fromDDL(added).fields
    names = [f"c{k}" for k in range(len(taken))] + [f"added{k}" for k in range(len(fields))]
    inner = docs.select(*(c.alias(n) for c, n in zip(columns(taken), names, strict=False)), *(c.alias(f"other{k}") for k, c in enumerate(others)))
    first, asked = len(taken), [f"other{k}" for k in range(len(others))]
    types = [*(docs.schema[n].dataType for n in taken), *(f.dataType for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = step(pa.RecordBatch.from_arrays(batch.columns[first:], names=asked))
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *made], names=names)

    out = inner.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))
    return out.toDF(*taken, *(f.name for f in fields))


# -- Arrow buffers ---------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole documents (first, past the last) of about limit bytes together; a longer document stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# -- hashing ---------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.ones(1, U64)
            while len(p) < size:
                p = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
            _POWERS[k] = p[:size].copy()
    return _POWERS[0][:n], _POWERS[1][:n]


class Prefix:
    """Polynomial hashes of any stretch of a token sequence from one running sum."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(tokens * self.power[:n], out=self.sums[1:])

    def fixed(self, width: int) -> np.ndarray:
        """Of every stretch of so many tokens."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


#: Word separators are space and U+0009 to U+000D, as bytes.split() has it.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_places(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some documents, and the documents' bounds in them; space: which bytes separate words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some documents, and the documents' bounds in them."""
    start, end, at = word_places(data, bounds, space)
    return Prefix(BYTE[data]).spans(start, end), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
