"""Removal of repeated substrings: long byte strings (suffix-array style) and long word windows (count-min prefilter)."""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

#: Bytes of a string that counts as copied, and of its anchor.
BYTES, BYTE_GRAM = 50, 20
#: Words of a window, and of its anchor.
WORDS, WORD_GRAM = 35, 10


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = BYTES, gram: int = BYTE_GRAM, carry: list[str] | None = None) -> DataFrame:
    """Finds every byte that lies in a string of `width` bytes which also starts in a document with a smaller key.

    A depth-limited most-significant-digit radix sort of suffixes, through `width` bytes. Its first digit is the anchor, the least
    `gram` bytes inside a window, and its place; neighbouring windows that share it travel as one run. Pass 1 counts
    anchors (the two-row sketch of `repeats`) and drops those that occur once. Pass 2 merges runs of equal bytes, found by a hash. Pass 3
    orders the windows of each anchor that still has unlike runs by digits of eight bytes, and goes on with groups of two
    and more only; the windows of an anchor beyond an average partition's rows are grouped by a 128-bit hash instead. Equal
    groups after the last digit are exactly the repeated strings.

    Returns docs' columns (those in `carry`, if given; columns of docs with an output's name give way) plus `cut`: array of (start, end) byte ranges, ascending and apart; `n_bytes`, `n_removed`,
    `kept` (binary, the rest). Null text counts as empty. Texts shorter than `width` lose nothing. A null key
    never matches and is kept whole. Rows that share a key count as one document, and never remove each other.
    Equal texts: all but the smallest key lose everything. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    plain = repeats.ids_and_text(docs, key, text)
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeats.repeated_stretches(plain, repeats.byte_tokens, total, width, gram, by_doc=True)
    joined = repeats.with_spans(docs, key, text, found)
    taken = [c for c in carry or docs.columns if c not in ("cut", "n_bytes", "n_removed", "kept")]

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        ranges, sizes, removed, kept = [], [], [], []
        for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (t or "").encode()
            sizes.append(len(raw))
            if not spans or not raw:
                ranges.append([])
                removed.append(0)
                kept.append(raw)
                continue
            mask = repeats.as_mask(len(raw), spans, width)
            edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            ranges.append(edge.tolist())
            removed.append(int(mask.sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~mask].tobytes())
        return [pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]

    return common.mapped(joined, taken, common.columns(joined.columns[-2:]), cut, "cut array<array<long>>, n_bytes long, n_removed long, kept binary")


def window_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, gram: int = WORD_GRAM, carry: list[str] | None = None) -> DataFrame:
    """Finds every word that lies in a window of `width` words which also starts anywhere else, in any document.

    Words are runs of bytes other than space and U+0009 to U+000D. Pass 1 merges the tasks' count-min sketches of window
    anchors, which overestimate window counts; pass 2 groups exactly only what is estimated repeated, losing none
    (see `repeats`).

    Returns docs' columns (those in `carry`, if given; columns of docs with an output's name give way) plus `n_words`, `n_removed` and `kept` (string, the other words joined by one space). Null
    text has no words; shorter texts lose nothing. A null key is kept whole and matches nothing. Repeated rows
    are repeats: both lose the window. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    plain = repeats.ids_and_text(docs, key, text)
    total = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 5
    found = repeats.repeated_stretches(plain, repeats.word_tokens, total, width, gram, by_doc=False)
    joined = repeats.with_spans(docs, key, text, found)
    taken = [c for c in carry or docs.columns if c not in ("n_words", "n_removed", "kept")]

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, removed, kept = [], [], []
        for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (t or "").encode().split()
            sizes.append(len(words))
            gone = 0
            if spans and words:
                mask = repeats.as_mask(len(words), spans, width)
                gone = int(mask.sum())
                words = [words[i] for i in np.flatnonzero(~mask)]
            removed.append(gone)
            kept.append(b" ".join(words).decode())
        return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    return common.mapped(joined, taken, common.columns(joined.columns[-2:]), cut, "n_words long, n_removed long, kept string")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, carry=["doc_id"]).select("doc_id", "n_bytes", "n_removed", F.size("cut").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return window_dedup(docs, carry=["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
