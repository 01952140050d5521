"""Benchmark decontamination: every passage queries a BM25 index of test items by block-max WAND, and hits are verified."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER

#: An item is indexed in units of at most one word more than this; passages are twice as long and overlap by half, so some passage has a whole unit.
UNIT = 32
#: BM25 saturation and length weights. A unit's score is its share of the unit's own BM25 mass.
K1, B = 1.2, 0.75
THRESHOLD = 0.7
#: Units of a block that share upper bounds.
BLOCK = 8
#: An item counts as contained if so large a share of the words of its question, and of its answer, lie in five-word shingles of the document.
SHINGLE, OVERLAP = 5, 0.75
#: Items and bytes of one broadcast index; a larger benchmark is scanned against several.
INDEX_ITEMS, INDEX_BYTES = 20_000, 16_000_000

#: Words are runs of letters and digits; bytes from 0x80 on count as letters.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = common.utf8(pa.array(texts, pa.large_string()))
    return common.word_hashes(LOWER[data], bounds, _APART)


def covered(item: np.ndarray, shingles: set[tuple]) -> np.ndarray:
    """Which words of an item lie in a shingle of the document."""
    size = min(SHINGLE, len(item))
    out = np.zeros(len(item), bool)
    for k in range(len(item) - size + 1):
        if tuple(item[k : k + size].tolist()) in shingles:
            out[k : k + size] = True
    return out


def cut(own: np.ndarray) -> list[np.ndarray]:
    """The units of an item's words."""
    return np.array_split(own, max(1, -(-len(own) // (UNIT + 1))))


class Frequencies:
    """In how many units of the whole benchmark each term is, and the units' number and words."""

    def __init__(self):
        self.terms, self.df, self.number, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0

    def add(self, texts: list[str]) -> None:
        hashes, at = words(texts)
        units = [u for k in range(len(texts)) if at[k + 1] > at[k] for u in cut(hashes[at[k] : at[k + 1]])]
        self.number, self.size = self.number + len(units), self.size + sum(map(len, units))
        every = np.concatenate([self.terms, *(np.unique(u) for u in units)])
        count = np.concatenate([self.df, np.ones(len(every) - len(self.df), np.int64)])
        self.terms, at = np.unique(every, return_inverse=True)
        self.df = np.bincount(at, count, len(self.terms)).astype(np.int64)

    def of(self, term: np.ndarray) -> dict[int, int]:
        return dict(zip(term.tolist(), self.df[np.searchsorted(self.terms, term)].tolist(), strict=True))


class Index:
    """Inverted lists over units, by blocks, with the largest weight of each term in a block.

    Only the heaviest terms of a unit are listed, until the others together stay under half the threshold: a unit that reaches the
    threshold has at least the other half in listed terms.
    """

    def __init__(self, ids: list[int], texts: list[str], whole: Frequencies | None = None):
        if whole is None:
            whole = Frequencies()
            whole.add(texts)
        hashes, at = words(texts)
        self.items: list[tuple[int, np.ndarray, int]] = []
        units: list[np.ndarray] = []
        self.item_of: list[int] = []
        for k, (name, text) in enumerate(zip(ids, texts, strict=True)):
            own = hashes[at[k] : at[k + 1]]
            if not len(own):
                continue
            parts = [len(words([p])[0]) for p in _SENTENCE.split(text)]
            parts = [p for p in parts if p]
            question = sum(parts[:-1]) if len(parts) > 1 else len(own) - max(1, len(own) // 3)
            self.item_of += [len(self.items)] * len(parts := cut(own))
            self.items.append((name, own, question))
            units += parts
        df = whole.of(np.unique(hashes))
        mean = whole.size / max(1, whole.number)
        self.weights: list[dict[int, float]] = []
        listed: dict[int, dict[int, float]] = {}
        self.rest = np.zeros(-(-len(units) // BLOCK) or 1)
        for k, u in enumerate(units):
            w = {t: np.log(1 + (whole.number - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(u) / mean)) for t, f in Counter(u.tolist()).items()}
            mass = sum(w.values())
            w = {t: x / mass for t, x in w.items()}
            self.weights.append(w)
            rest = 1.0
            for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
                if rest < THRESHOLD / 2:
                    break
                rest -= x
                block = listed.setdefault(t, {})
                block[k // BLOCK] = max(block.get(k // BLOCK, 0), x)
            self.rest[k // BLOCK] = max(self.rest[k // BLOCK], rest)
        self.terms = np.array(sorted(listed), np.uint64)
        lists = [listed[int(t)] for t in self.terms]
        self.start = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        self.block = np.array([b for x in lists for b in x], np.int64)
        self.bound = np.array([v for x in lists for v in x.values()])

    def retrieve(self, word: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) for every passage whose score for a unit of the item reaches the threshold."""
        if not len(self.terms) or not len(word):
            return []
        size = np.diff(at)
        count = np.maximum(1, -(-(size - 2 * UNIT) // UNIT) + 1)
        first = np.append(0, np.cumsum(count))
        term = np.minimum(np.searchsorted(self.terms, word), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[term] == word)
        term = term[hit]
        doc = np.searchsorted(at, hit, "right") - 1
        passage = (hit - at[doc]) // UNIT
        pairs = [((first[doc] + passage - back) * len(self.terms) + term)[ok] for back in (0, 1) if (ok := (passage - back >= 0) & (passage - back < count[doc])).any()]
        if not pairs:
            return []
        pairs = np.unique(np.concatenate(pairs))
        window, term = pairs // len(self.terms), pairs % len(self.terms)
        n = self.start[term + 1] - self.start[term]
        at_list = np.repeat(self.start[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(window, n) * len(self.rest) + self.block[at_list]
        order = np.argsort(key, kind="stable")
        key, bound = key[order], self.bound[at_list][order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        upper = np.add.reduceat(bound, cut) + self.rest[key[cut] % len(self.rest)]
        found = []
        for k in key[cut][upper >= THRESHOLD - 1e-9].tolist():
            w, block = divmod(k, len(self.rest))
            d = int(np.searchsorted(first, w, "right")) - 1
            lo = at[d] + (w - first[d]) * UNIT
            there = set(word[lo : min(lo + 2 * UNIT, at[d + 1])].tolist())
            for u in range(block * BLOCK, min((block + 1) * BLOCK, len(self.weights))):
                if sum(x for t, x in self.weights[u].items() if t in there) >= THRESHOLD - 1e-9:
                    found.append((d, self.item_of[u]))
        return sorted(set(found))

    def verify(self, item: int, shingles: dict[int, set[tuple]], text: np.ndarray) -> bool:
        _, own, question = self.items[item]
        size = min(SHINGLE, len(own))
        if size not in shingles:
            shingles[size] = set(zip(*(text[k : len(text) - size + 1 + k].tolist() for k in range(size)), strict=True)) if len(text) >= size else set()
        inside = covered(own, shingles[size])
        return all(x.mean() >= OVERLAP for x in (inside[:question], inside[question:]) if len(x))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_retrieved, item_ids (ascending) and contaminated to docs: the test items found in each whole text.

    Passages of 2 * UNIT words are queries to a BM25 index of the items' units; all units that score THRESHOLD of their own mass or
    more are retrieved. An item counts if OVERLAP of the words of its question, and of its answer (the last sentence), lie in
    five-word shingles of the document. Words are letters and digits in lower case.

    Null texts and texts without words: nothing found. Items without words are left out; repeated items are each found. A benchmark over
    INDEX_ITEMS items or INDEX_BYTES is scanned in parts, weighted alike. Empty tables: nothing found, no rows.
    Repeated rows of docs get equal results. Columns of docs with an output's name give way.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    names = ["n_retrieved", "item_ids", "contaminated"]
    taken = [c for c in carry or docs.columns if c not in names]
    tests = items.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    size = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size.n // INDEX_ITEMS), -(-size.bytes // INDEX_BYTES))
    def of_part(part: int) -> list:
        return sorted(tests.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toLocalIterator())

    whole = Frequencies()
    for part in range(parts):
        whole.add([r.text for r in of_part(part)])
    indexes = []
    for part in range(parts):
        rows = of_part(part)
        indexes.append(spark.sparkContext.broadcast(Index([r.id for r in rows], [r.text for r in rows], whole)))

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        data, bounds = common.utf8(batch.column(0))
        retrieved, ids = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
        for i, j in common.slices(bounds):
            word, at = common.word_hashes(LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i], _APART)
            for index in indexes:
                before, shingles = -1, {}
                for d, k in index.value.retrieve(word, at):
                    if d != before:
                        before, shingles = d, {}
                    retrieved[i + d] += 1
                    if index.value.verify(k, shingles, word[at[d] : at[d + 1]]):
                        ids[i + d].append(index.value.items[k][0])
        return [pa.array(retrieved), pa.array([sorted(x) for x in ids], pa.list_(pa.int64())), pa.array([bool(x) for x in ids], pa.bool_())]

    return common.mapped(docs, taken, [F.col(f"`{text}`").cast("string")], scan, "n_retrieved long, item_ids array<long>, contaminated boolean")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
