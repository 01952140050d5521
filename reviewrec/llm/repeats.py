"""Windows of tokens that occur more than once in a corpus: the engine behind substring removal.

A window is W consecutive tokens of one document. Neighbouring windows that agree on their least K-gram (the
anchor, leftmost on ties) form a run, and move through every pass as one row. Equal windows have equal anchors at
equal places, so anchors bound window counts from above, and runs with equal content settle all their windows at
once. Three scans:

1. anchors are counted in a count-min sketch: one per task, merged by cell range, saturating at two. Anchors with a
   cell below two are unique, and so are all their windows; nothing repeated is lost.
2. runs of the other anchors are grouped exactly by (anchor, content). A task settles what it can see itself and
   sends one row for each distinct run, so a run shared by a third of the corpus costs one row a task.
3. where one anchor has several contents, its windows are grouped exactly one by one, by a 128-bit hash: runs of up to
   `LARGE` rows an anchor, or an average partition's, meet as contents in the anchor's partition; windows of larger ones
   are grouped like runs in 2.

All passes grow in proportion to the input. The sketch has a fixed upper size (`MAX_CELLS`); beyond it more rows
reach passes 2 and 3, which stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .common import U64, Prefix, Scratch, mix, signed

DEPTH = 2
SEGMENT = 1 << 16
#: Cells of one sketch row; two bitmaps of this many bits (32 MB each) are the largest broadcast.
MAX_CELLS = 1 << 28
PIECE = 1 << 19
#: Runs that a task holds before it settles and sends them.
HOLD = 3_000_000

#: Rows of an anchor whose windows meet in one partition, at least; more where partitions are larger.
LARGE = 1000
#: Rows whose windows are grouped at once there.
CHUNK = 30_000

CONTENT = "key0 long, doc long, at long, n long, seen int, content binary"
RUN = "key0 long, key1 long, doc long, at long, n long, seen int, settled boolean"
SEGMENTS = "segment int, once binary, more binary"


# -- runs of windows -------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def pieces(bounds: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(first document, document bounds inside, start, place of the start in its document); long documents are cut with overlap."""
    i, n = 0, len(bounds) - 1
    while i < n:
        size = int(bounds[i + 1] - bounds[i])
        if size > PIECE + overlap:
            for s in range(0, size - overlap, PIECE):
                yield i, np.array([0, min(PIECE + overlap, size - s)]), int(bounds[i]) + s, s
            i += 1
        else:
            j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1))
            yield i, bounds[i : j + 1] - bounds[i], int(bounds[i]), 0
            i = j


class Runs:
    """The runs of one piece: anchor hash, first window, number of windows, document."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, width: int, gram: int):
        self.width, self.prefix, n = width, Prefix(tokens), len(tokens)
        if n < width:
            self.anchor, self.at, self.n, self.doc = np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
            return
        grams = self.prefix.fixed(gram)
        packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
        least = sliding_min(packed, width - gram + 1).astype(np.uint32)
        valid = np.ones(len(least), bool)
        inner = bounds[1:]
        bad = (inner[:, None] + np.arange(1 - width, 0)).ravel()
        valid[bad[(bad >= 0) & (bad < len(valid))]] = False
        new = np.empty(len(least), bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(new)
        size = np.diff(start, append=len(least))
        ok = valid[start]
        self.at, self.n = start[ok], size[ok]
        self.anchor = grams[least[self.at]]
        self.doc = np.searchsorted(bounds, self.at, "right") - 1

    def content(self, pick: np.ndarray) -> np.ndarray:
        at = self.at[pick]
        return self.prefix.spans(at, at + self.n[pick] - 1 + self.width)


Tokens = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]]]


def hashed(tokens: np.ndarray) -> np.ndarray:
    """Bytes are hashed by table; words are hashes already."""
    return common.BYTE[tokens] if tokens.dtype == np.uint8 else tokens


def byte_tokens(batch: pa.RecordBatch) -> Iterator:
    """(document ids, bounds, tokens between two places): UTF-8 bytes."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, bounds = common.utf8(batch.column(1))
    yield ids, bounds, lambda lo, hi: data[lo:hi]


def word_tokens(batch: pa.RecordBatch) -> Iterator:
    """The same with words, for some documents at a time."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, bounds = common.utf8(batch.column(1))
    for i, j in common.slices(bounds):
        words, at = common.word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        yield ids[i:j], at, lambda lo, hi, words=words: words[lo:hi]


def runs_of(batches: Iterator[pa.RecordBatch], tokens: Tokens, width: int, gram: int) -> Iterator[tuple[Runs, np.ndarray, int, np.ndarray]]:
    for batch in batches:
        for ids, bounds, get in tokens(batch):
            for first, inner, lo, place in pieces(bounds, width - 1):
                piece = get(lo, lo + int(inner[-1]))
                runs = Runs(hashed(piece), inner, width, gram)
                if len(runs.at):
                    # where a run starts in its document
                    yield runs, ids[first + runs.doc], runs.at - inner[runs.doc] + place, piece


# -- count-min sketch ------------------------------------------------------------------------------


def cells(keys: np.ndarray, width: int) -> np.ndarray:
    """The cells of some keys, one row of the sketch after the other: row * width + column."""
    shift = U64(64 - int(width).bit_length() + 1)
    return np.stack([(mix(keys + U64(0x632BE59BD9B4E019 * (r + 1) % (1 << 64))) >> shift) + U64(r * width) for r in range(DEPTH)])


def sketch_rows(keys: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch, without its empty cells: for each range of cells those counted, and those counted twice or more."""
    found = np.sort(cells(np.concatenate(keys), width).ravel()) if keys else np.zeros(0, U64)
    if not len(found):
        return
    first = np.empty(len(found), bool)
    first[0] = True
    first[1:] = found[1:] != found[:-1]
    once = found[first]
    more = once[np.diff(np.flatnonzero(first), append=len(found)) > 1]
    ranges = np.unique(once >> U64(16))
    edge = np.append(ranges, ranges[-1] + U64(1)) << U64(16)
    lo, up = np.searchsorted(once, edge), np.searchsorted(more, edge)
    low, many = (once & U64(0xFFFF)).astype(np.uint16), (more & U64(0xFFFF)).astype(np.uint16)
    for k in range(0, len(ranges), 512):
        part = range(k, min(k + 512, len(ranges)))
        yield pa.record_batch({
            "segment": pa.array(ranges[k : k + 512].astype(np.int32)),
            "once": pa.array([low[lo[i] : lo[i + 1]].tobytes() for i in part], pa.binary()),
            "more": pa.array([many[up[i] : up[i + 1]].tobytes() for i in part], pa.binary()),
        })


def merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the cells that count two or more, for each range of cells; holds the ranges of one partition."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, more in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            seen, twice = state.setdefault(segment, (np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)))
            at = np.frombuffer(once, np.uint16)
            twice[at] |= seen[at]
            seen[at] = True
            twice[np.frombuffer(more, np.uint16)] = True
    for segment, (_, twice) in state.items():
        if twice.any():
            yield pa.record_batch({"segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})


def merged(sketches: DataFrame, width: int) -> np.ndarray:
    """The merged sketch as bits, on the driver: DEPTH * width of them, MAX_CELLS at most a row."""
    spark = sketches.sparkSession
    parts = min(common.shuffle_partitions(spark), max(1, DEPTH * width // SEGMENT))
    rows = sketches.repartition(parts, "segment").mapInArrow(merge_sketches, "segment int, bits binary").toArrow()
    bits = np.zeros(max(DEPTH * width, SEGMENT) // 8, np.uint8)
    for segment, part in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        bits[segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(part, np.uint8)[: len(bits) - segment * SEGMENT // 8]
    return bits


def repeated(keys: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Whether the sketch counts a key twice or more."""
    out = np.ones(len(keys), bool)
    for row in cells(keys, width):
        out &= (bits[row >> U64(3)] >> (row & U64(7)).astype(np.uint8)) & 1 > 0
    return out


def sketch_width(items: float) -> int:
    return min(MAX_CELLS, max(SEGMENT, 1 << int(4 * items).bit_length()))


# -- settling --------------------------------------------------------------------------------------


def settle(key0, key1, doc, at, n, seen, by_doc: bool) -> Iterator[pa.RecordBatch]:
    """What one task can decide about its own rows, and one row for each distinct key for the others.

    by_doc: a row is repeated if a smaller document has its key; else if any other row has it. seen: 2 for a row that
    stands for several.
    """
    order = np.lexsort((at, doc, key1, key0))
    key0, key1, doc, at, n, seen = (x[order] for x in (key0, key1, doc, at, n, seen))
    new = np.empty(len(key0), bool)
    new[:1] = True
    new[1:] = (key0[1:] != key0[:-1]) | (key1[1:] != key1[:-1])
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(key0))
    group = np.cumsum(new) - 1
    count = np.add.reduceat(seen, start) if len(start) else size
    covered = doc > doc[start][group] if by_doc else (count > 1)[group]
    seen = np.minimum(count, 2)[group].astype(np.int32)
    send = ~covered if by_doc else new
    # what is settled here, neighbouring stretches of a document as one
    d, a, z = doc[covered], at[covered], (at + n)[covered]
    o = np.lexsort((a, d))
    d, a, z = d[o], a[o], z[o]
    if len(d):
        gap = np.ones(len(d), bool)
        gap[1:] = (d[1:] != d[:-1]) | (a[1:] > z[:-1])
        s = np.flatnonzero(gap)
        d, a, z = d[s], a[s], np.maximum.reduceat(z, s)
    for lo in range(0, len(d), 50_000):
        x = slice(lo, lo + 50_000)
        k = len(d[x])
        yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(d[x]), pa.array(a[x]), pa.array((z - a)[x]), pa.nulls(k, pa.int32()), pa.array(np.ones(k, bool))], names=["key0", "key1", "doc", "at", "n", "seen", "settled"])
    rows = np.flatnonzero(send)
    for lo in range(0, len(rows), 50_000):
        x = rows[lo : lo + 50_000]
        yield pa.record_batch([pa.array(signed(key0[x])), pa.array(signed(key1[x])), pa.array(doc[x]), pa.array(at[x]), pa.array(n[x]), pa.array(seen[x]), pa.array(np.zeros(len(x), bool))], names=["key0", "key1", "doc", "at", "n", "seen", "settled"])


def settled(parts: Iterator[tuple], by_doc: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > HOLD:
            yield from settle(*map(np.concatenate, zip(*held, strict=True)), by_doc)
            held, rows = [], 0
    if held:
        yield from settle(*map(np.concatenate, zip(*held, strict=True)), by_doc)


def judged(rows: DataFrame, by_doc: bool) -> DataFrame:
    """(doc, at, n) of the stretches that are repeated, over all tasks; a key has one row a task, so no partition is hot."""
    sent = rows.where(~F.col("settled"))
    key = Window.partitionBy("key0", "key1")
    if by_doc:
        more = sent.withColumn("least", F.min("doc").over(key)).where("doc > least")
    else:
        more = sent.withColumn("total", F.sum("seen").over(key)).where("total > 1 and seen = 1")
    return rows.where("settled").select("doc", "at", "n").unionByName(more.select("doc", "at", "n"))


# -- the three scans -------------------------------------------------------------------------------


def radix_groups(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of data (bytes) in most-significant-digit order through `width` bytes: (suffixes that have an equal, group of each), ordered.

    A digit is eight bytes. Each pass orders the suffixes of a group by their next digit and goes on with those only that still
    have company, so a suffix takes part as far as it agrees with another. What is left after the last digit are exactly the repeated windows.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = 8 if width >= 8 else 1
    digits = np.lib.stride_tricks.sliding_window_view(data, size)
    alive, group = np.arange(len(start)), bucket.astype(np.int64)
    for at in [*range(0, width - size, size), width - size]:
        digit = np.ascontiguousarray(digits[start[alive] + at]).view(">u8" if size == 8 else np.uint8).ravel().astype(U64)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        alive, group = alive[keep], number[keep]
        if not len(alive):
            break
    return alive, group


def repeated_stretches(docs: DataFrame, tokens: Tokens, total: float, width: int, gram: int, by_doc: bool) -> DataFrame:
    """(doc, at, n): window starts at .. at + n - 1 of document doc are repeated windows.

    docs: (id long, text string), no null id. total: about how many tokens there are.
    by_doc: repeated means that a document with a smaller id has the window; else that it starts anywhere else.
    """
    spark: SparkSession = docs.sparkSession
    cells_wide = sketch_width(total * 2 / (width - gram + 2))

    def count_anchors(batches):
        keys, held = [], 0
        for runs, *_ in runs_of(batches, tokens, width, gram):
            keys.append(runs.anchor)
            held += len(runs.anchor)
            if held > HOLD:
                yield from sketch_rows(keys, cells_wide)
                keys, held = [], 0
        yield from sketch_rows(keys, cells_wide)

    bits = spark.sparkContext.broadcast(merged(docs.mapInArrow(count_anchors, SEGMENTS), cells_wide))

    def runs_again(batches):
        def parts():
            for runs, doc, at, _ in runs_of(batches, tokens, width, gram):
                pick = np.flatnonzero(repeated(runs.anchor, bits.value, cells_wide))
                if len(pick):
                    yield runs.anchor[pick], runs.content(pick), doc[pick], at[pick], runs.n[pick], np.ones(len(pick), np.int64)

        return settled(parts(), by_doc)

    scratch = Scratch(spark)
    by_run = scratch.written(docs.mapInArrow(runs_again, RUN), "runs")
    bits.destroy()

    sent = by_run.where(~F.col("settled")).groupBy("key0").agg(F.min("key1").alias("lo"), F.max("key1").alias("hi"), F.count("*").alias("rows"))
    varied = scratch.written(sent.where("lo <> hi").select("key0", "rows"), "varied")
    size = varied.agg(F.count("*").alias("keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    cells_varied = sketch_width(size["keys"])
    share = max(LARGE, size["rows"] // common.shuffle_partitions(spark))

    def mark(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(U64)
            if len(key):
                yield from sketch_rows([key, key], cells_varied)

    varied_bits = spark.sparkContext.broadcast(merged(varied.select("key0").mapInArrow(mark, SEGMENTS), cells_varied))
    large_bits = spark.sparkContext.broadcast(merged(varied.where(F.col("rows") > share).select("key0").mapInArrow(mark, SEGMENTS), cells_varied))

    def varied_runs(batches, large: bool):
        for runs, doc, at, piece in runs_of(batches, tokens, width, gram):
            pick = np.flatnonzero(repeated(runs.anchor, varied_bits.value, cells_varied))
            pick = pick[repeated(runs.anchor[pick], large_bits.value, cells_varied) == large]
            if len(pick):
                yield runs, pick, doc[pick], at[pick], piece

    def single_windows(batches):
        def parts():
            for runs, pick, doc, at, piece in varied_runs(batches, True):
                yield windows(hashed(piece), runs.at[pick], runs.n[pick], doc, at, np.ones(len(pick), np.int64), width)

        return settled(parts(), by_doc)

    def contents(batches):
        """One row for each distinct run of a piece, with its tokens."""
        for runs, pick, doc, at, piece in varied_runs(batches, False):
            order = np.lexsort((doc, runs.content(pick)))
            pick, doc, at = pick[order], doc[order], at[order]
            content = runs.content(pick)
            new = np.append(True, content[1:] != content[:-1])
            if by_doc:
                first = np.flatnonzero(new)
                keep = doc == doc[first][np.cumsum(new) - 1]
                seen = np.ones(len(pick), np.int32)
            else:
                keep = new
                seen = np.minimum(np.diff(np.flatnonzero(new), append=len(new)), 2)[np.cumsum(new) - 1].astype(np.int32)
            pick, doc, at, seen = pick[keep], doc[keep], at[keep], seen[keep]
            n = runs.n[pick]
            size = n - 1 + width
            end = np.cumsum(size)
            taken = piece[np.arange(end[-1]) + np.repeat(runs.at[pick] - (end - size), size)]
            offsets = np.append(0, end * piece.itemsize).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(taken))])
            yield pa.RecordBatch.from_arrays([pa.array(signed(runs.anchor[pick])), pa.array(doc), pa.array(at), pa.array(n), pa.array(seen), blob], names=["key0", "doc", "at", "n", "seen", "content"])

    def meet(batches):
        """Groups the windows of an anchor; its rows follow each other, in one partition."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows > CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key0").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield from met(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = len(table) - cut
        if held:
            yield from met(pa.Table.from_batches(held).combine_chunks())

    def met(table: pa.Table):
        blob = table.column("content").combine_chunks()
        data, bounds = common.utf8(blob)
        if item.itemsize > 1:
            data, bounds = np.frombuffer(data.tobytes(), item), bounds // item.itemsize
        doc, at, n, seen = (table.column(c).to_numpy() for c in ("doc", "at", "n", "seen"))
        if item.itemsize == 1:
            key = table.column("key0").to_numpy()
            bucket = np.cumsum(np.append(True, key[1:] != key[:-1]))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            alive, group = radix_groups(data, np.repeat(bounds[:-1], n) + step, np.repeat(bucket, n), width)
            if len(alive):
                doc, at = np.repeat(doc, n)[alive], (np.repeat(at, n) + step)[alive]
                least = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
                gone = doc > np.repeat(least, np.bincount(group)[np.unique(group)])
                yield from stretches(doc[gone], at[gone])
            return
        for batch in settle(*windows(hashed(data), bounds[:-1], n, doc, at, seen, width), by_doc):
            if batch.column("settled")[0].as_py():
                yield batch.select(["doc", "at", "n"])

    item = np.dtype(np.uint8 if tokens is byte_tokens else U64)
    small = docs.mapInArrow(contents, CONTENT).repartition(common.shuffle_partitions(spark), "key0").sortWithinPartitions("key0").mapInArrow(meet, "doc long, at long, n long")
    found = judged(by_run, by_doc).unionByName(small)
    if size["most"] > share:
        found = found.unionByName(judged(scratch.written(docs.mapInArrow(single_windows, RUN), "windows"), by_doc))
    out = scratch.written(found, "stretches")
    varied_bits.destroy()
    large_bits.destroy()
    scratch.keep(out)
    with scratch:
        return out


def windows(tokens: np.ndarray, start: np.ndarray, n: np.ndarray, doc: np.ndarray, at: np.ndarray, seen: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The single windows of some runs, for settle()."""
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(start, n) + step
    one, two = Prefix(tokens), Prefix(mix(tokens + U64(0xA0761D6478BD642F)))
    return one.spans(first, first + width), two.spans(first, first + width), np.repeat(doc, n), np.repeat(at, n) + step, np.ones(len(first), np.int64), np.repeat(seen, n)


def stretches(doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, at, n) of single windows, neighbours as one."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    n = (at[np.append(first[1:], len(at)) - 1] - at[first] + 1) if len(doc) else at
    for lo in range(0, len(first), 50_000):
        x = slice(lo, lo + 50_000)
        yield pa.record_batch({"doc": pa.array(doc[first[x]]), "at": pa.array(at[first[x]]), "n": pa.array(n[x])})


def as_mask(size: int, spans: list, width: int) -> np.ndarray:
    """Which of size tokens the windows of some stretches cover."""
    edge = np.zeros(size + 1, np.int64)
    if len(spans):
        s = np.asarray(spans, np.int64).reshape(-1, 2)
        np.add.at(edge, np.minimum(s[:, 0], size), 1)
        np.add.at(edge, np.minimum(s[:, 0] + s[:, 1] - 1 + width, size), -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, key: str, text: str, stretches: DataFrame) -> DataFrame:
    """docs, and last the text and the array of (start, number of windows), null where nothing is repeated, under names that docs doesn't have."""
    spans = stretches.groupBy("doc").agg(F.collect_list(F.array("at", "n")).alias("spans"))
    rows = docs.select(F.struct(*common.columns(docs.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = rows.join(spans, rows.id == spans.doc, "left")
    have = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in have else free("_" + name)
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("text").alias(free("whole_text")), F.col("spans").alias(free("repeated_spans")))


def ids_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    plain = docs.select(F.col(f"`{key}`").cast(T.LongType()).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return plain.where("id is not null and text is not null")
