"""Language identification by interpolated Kneser-Ney character models, learned from the labelled rows of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters fall into this many symbols; 0 is anything between words. Four of them make a gram of 24 bits.
SYMBOLS, ORDER = 64, 4
UNKNOWN = "und"
#: Of the training rows one in FOLD is held out to learn which cross-entropies texts of a language and length have, by a model of the others. A text is
#: rejected if its own exceeds their QUANTILE by this share of the language's mean.
FOLD, QUANTILE, MARGIN = 10, 0.999, 0.1
#: Where fewer than LEAST held-out texts of a length are there: beyond the mean of the model's own counts by so many standard errors plus this share.
LEAST, ERRORS, SLACK = 50, 6.0, 0.25
#: Neighbouring characters aren't independent: a text counts as so many observations a character.
WEIGHT = 0.25

_SYMBOL: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Symbol of each code point: a-z and A-Z are 1 to 26, other letters share the rest by their lower-case code point."""
    if not _SYMBOL:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                low = ord(s.lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % (1 << 32) >> 7) % (SYMBOLS - 27)
        _SYMBOL.append(table)
    return _SYMBOL[0]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 24-bit gram that ends at each character, the texts' bounds in them, and their numbers of letters.

    Each text starts with three separators; what stands between words counts as one.
    """
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 3 for t in texts], out=bounds[1:])
    raw = np.frombuffer("".join("   " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = symbols()[raw]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    for k in range(3):
        keep[bounds[:-1] + k] = True
    # a text's own leading separators beyond the three go
    count = np.append(0, np.cumsum(keep))
    code, bounds = code[keep].astype(np.uint32), count[bounds]
    letters = np.append(0, np.cumsum(code > 0))[bounds]
    gram = np.zeros(len(code), np.uint32)
    if len(code) > 3:
        gram[3:] = (code[:-3] << 18) | (code[1:-2] << 12) | (code[2:-1] << 6) | code[3:]
    inside = np.ones(len(code), bool)
    for k in range(3):
        inside[bounds[:-1] + k] = False
    place = np.append(0, np.cumsum(inside))
    return gram[inside], place[bounds], np.diff(letters)


@dataclass
class Model:
    """Sorted grams seen in any language and their log probabilities; log probabilities of the last three symbols and back-off weights for the others."""

    languages: list[str]
    grams: np.ndarray
    seen: np.ndarray
    lower: np.ndarray
    backoff: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    #: (languages, lengths as powers of two): the largest cross-entropy that is accepted; infinite where unknown.
    limits: np.ndarray | None = None

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        known = self.grams[at] == gram
        out = self.seen[at]
        other = np.flatnonzero(~known)
        if len(other):
            g = gram[other]
            out[other] = self.backoff[g >> np.uint32(6)] + self.lower[g & np.uint32(0x3FFFF)]
        return out


def _discount(counts: np.ndarray) -> float:
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return one / (one + 2 * two) if one and one + 2 * two else 0.5


def kneser_ney(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one language: probabilities of its grams, of all three-symbol grams, and back-off weights of all three-symbol contexts."""
    size = SYMBOLS
    # continuation counts: how many different symbols stand before a shorter gram
    three = np.bincount(gram & np.uint32(0x3FFFF), minlength=size**3).reshape(size, size, size).astype(float)
    two = (three > 0).sum(0).astype(float)
    one = (two > 0).sum(0).astype(float)
    p = (one + 0.5) / (one.sum() + 0.5 * size)
    for table in (two, three):
        d = _discount(table[table > 0])
        total = table.sum(-1, keepdims=True)
        rest = np.where(total > 0, d * (table > 0).sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
        p = np.maximum(table - d, 0) / np.maximum(total, 1) + rest * p
    p = p.reshape(-1)
    d = _discount(count)
    context = gram >> np.uint32(6)
    total = np.bincount(context, count, size**3)
    kinds = np.bincount(context, minlength=size**3)
    rest = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(count - d, 0) / total[context] + rest[context] * p[gram & np.uint32(0x3FFFF)], p, rest


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from (grams, counts) of each language."""
    languages = sorted(counts)
    grams = np.unique(np.concatenate([counts[x][0] for x in languages])) if languages else np.zeros(0, np.uint32)
    seen = np.zeros((len(grams), len(languages)), np.float32)
    lower, backoff = (np.zeros((SYMBOLS**3, len(languages)), np.float32) for _ in range(2))
    mean, deviation = np.zeros(len(languages)), np.zeros(len(languages))
    for k, language in enumerate(languages):
        gram, count = counts[language]
        order = np.argsort(gram)
        gram, count = gram[order], count[order].astype(float)
        p, p3, rest = kneser_ney(gram, count)
        lower[:, k], backoff[:, k] = np.log(p3), np.log(np.maximum(rest, 1e-12))
        full = backoff[grams >> np.uint32(6), k] + lower[grams & np.uint32(0x3FFFF), k]
        full[np.searchsorted(grams, gram)] = np.log(p)
        seen[:, k] = full
        bits = -np.log(p)
        mean[k] = (count * bits).sum() / count.sum()
        deviation[k] = np.sqrt(max((count * bits**2).sum() / count.sum() - mean[k] ** 2, 1e-9))
    return Model(languages, grams, seen, lower, backoff, mean, deviation)


def learn(docs: DataFrame, text: str, label: str) -> Model:
    """Counts the grams of all labelled rows; a language has at most 2**24 different ones, which bounds the model."""
    names = sorted(r[0] for r in docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().toLocalIterator())
    place = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[start], np.add.reduceat(n, start)

        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, name in enumerate(names):
                mine = [t for t, x in zip(texts, labels, strict=True) if x == name and t]
                if mine:
                    gram, n = np.unique(coded(mine)[0], return_counts=True)
                    held.append((gram.astype(np.int64) | (k << 24), n))
            if sum(len(h[0]) for h in held) > 4_000_000:
                held = [flush()]
        if held:
            keys, n = flush()
            for lo in range(0, len(keys), 100_000):
                yield pa.record_batch({"key": pa.array(keys[lo : lo + 100_000]), "n": pa.array(n[lo : lo + 100_000])})

    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string"), F.col(label).cast("string"))
    table = labelled.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    return build({x: ((keys[m] & 0xFFFFFF).astype(np.uint32), n[m]) for x, k in place.items() if (m := keys >> 24 == k).any()})


def calibrated(held: DataFrame, text: str, label: str, model: Model) -> np.ndarray:
    """Limits of a model's languages by the length of a text, from rows that it hasn't learned."""
    fields = "language string, size int, entropy double"

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _, entropy, _, n = score(batch.column(0).to_pylist(), model)
            right = np.array([a == b for a, b in zip(best, batch.column(1).to_pylist(), strict=True)], bool) & np.isfinite(entropy)
            keep = np.flatnonzero(right)
            yield pa.record_batch({"language": pa.array([best[k] for k in keep], pa.string()), "size": pa.array(lengths(n[keep]).astype(np.int32)), "entropy": pa.array(entropy[keep])})

    labelled = held.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string"), F.col(label).cast("string"))
    rows = labelled.mapInArrow(entropies, fields).groupBy("language", "size").agg(F.percentile_approx("entropy", QUANTILE, 10_000).alias("most"), F.count("*").alias("n"))
    out = np.full((len(model.languages), SIZES), np.nan)
    for r in rows.where(F.col("n") >= LEAST).toLocalIterator():
        k = model.languages.index(r.language)
        out[k, r["size"]] = r.most + MARGIN * model.mean[k]
    return out


SIZES = 32


def lengths(n: np.ndarray) -> np.ndarray:
    """Numbers of characters as powers of two."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), SIZES - 1)


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, cross-entropy in nats a character, whether the text is accepted as that language, and its number of characters."""
    filled = [t or "" for t in texts]
    best, confidence, entropy, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
    sizes_in = np.zeros(len(texts), np.int64)
    sizes = np.append(0, np.cumsum([len(t) + 3 for t in filled]))
    for i, j in common.slices(sizes, 1 << 19):
        gram, bounds, letters = coded(filled[i:j])
        if not model.languages or not len(gram):
            continue
        n = np.diff(bounds)
        sums = np.zeros((j - i, len(model.languages)))
        full = np.flatnonzero(n)
        # about as many values at a time, whatever the number of languages
        step = max(1, (1 << 24) // len(model.languages))
        edges = bounds[:-1][full]
        for d in range(0, len(full), max(1, len(full) * step // max(1, len(gram)))) if len(full) else ():
            part = full[d : d + max(1, len(full) * step // max(1, len(gram)))]
            lo, hi = edges[d], bounds[part[-1] + 1]
            sums[part] = np.add.reduceat(model.log_probabilities(gram[lo:hi]), bounds[:-1][part] - lo, axis=0, dtype=np.float64)
        cross = -sums / np.maximum(n, 1)[:, None]
        k = cross.argmin(1)
        least = cross[np.arange(len(k)), k]
        weight = np.exp(-(cross - least[:, None]) * np.maximum(n, 1)[:, None] * WEIGHT)
        limit = model.mean[k] * (1 + SLACK) + ERRORS * model.deviation[k] / np.sqrt(np.maximum(n, 1) * WEIGHT)
        if model.limits is not None:
            own = model.limits[k, lengths(n)]
            limit = np.where(np.isnan(own), limit, own)
        ok = letters > 0
        sizes_in[i:j] = n
        confidence[i:j] = np.where(ok, 1 / weight.sum(1), 0)
        entropy[i:j] = np.where(ok, least, np.nan)
        accepted[i:j] = ok & (least <= limit)
        for d in np.flatnonzero(ok):
            best[i + d] = model.languages[k[d]]
    return best, confidence, entropy, accepted, sizes_in


def identify(docs: DataFrame, train: DataFrame, text: str = "text", label: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (0 to 1), cross_entropy and accepted to docs, by models of train's labelled rows.

    One interpolated Kneser-Ney model of character four-grams for each label, from all of train. The label with the
    least cross-entropy a character wins, score is its share among all labels. A text is not accepted if that
    cross-entropy is beyond what held-out texts of its language and length have (FOLD, QUANTILE, MARGIN), by a model of the others.

    Null text, and text without a letter: `und`, score 0, not accepted. Null labels are not learned; without any label all
    texts are `und`. Ties go to the first label in order. Columns of docs with an output's name give way.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    held = F.pmod(F.xxhash64(F.col(f"`{text}`").cast("string")), F.lit(FOLD)) == 0
    learned, part = learn(train, text, label), learn(train.where(~held), text, label)
    limits = calibrated(train.where(held), text, label, part)
    learned.limits = np.full((len(learned.languages), SIZES), np.nan)
    for k, language in enumerate(part.languages):
        learned.limits[learned.languages.index(language)] = limits[k]
    model: Broadcast[Model] = spark.sparkContext.broadcast(learned)
    added = "lang_pred string, score double, cross_entropy double, accepted boolean"
    names = [x.split()[0] for x in added.split(", ")]
    taken = [c for c in carry or docs.columns if c not in names]

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        best, confidence, entropy, accepted, _ = score(batch.column(0).to_pylist(), model.value)
        return [pa.array(best, pa.string()), pa.array(confidence), pa.array(entropy, from_pandas=True), pa.array(accepted)]

    return common.mapped(docs, taken, [F.col(f"`{text}`").cast("string")], predict, added)


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row stays out of training; a row without key does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(~held_out()).select("text", "lang")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, train, carry=["doc_id", "held_out"])
