"""Trie of conversation prefixes from sorted longest common prefixes: every candidate prefix finds its members' interval by itself.

Conversations are sorted by their turns, as digests; h is the number of leading turns that a row shares with the one before. A sparse table holds
the minima of h over every stretch of a power of two, so the extent of the rows that share d turns with row i, to the left and to the right,
is a binary search over these minima; no search needs another's result, and there is no stack.

No row or task grows with a conversation or with a group of copies. A conversation is a row for every SEGMENT turns, sorted under an id of
all turns before; a range partition sorts by conversation last, so equal rows split; a node that reaches over partitions is the sum of
its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import Scratch

#: Turns of a row, and bytes of a turn's digest.
SEGMENT, DIGEST = 64, 16
#: Rows of a range partition, about, where the session's number of partitions would give more.
ROWS = 100_000
#: Candidate prefixes that are searched at once.
AT_ONCE = 1 << 17
#: Ids of one piece of a node's list.
IDS = 4096
#: The exchange of first turns, see `rebuilt`: conversations of a group, and one more than the most turns.
GROUP, HEAD = 5, 9

_NODE = "a long, b long, parent_a long, parent_b long, depth long, n long, conv_id long, leaves long, shared long, above long"
_SORT = ["k", "group_a", "group_b", "turns", "more", "conv_id"]


# -- turns ------------------------------------------------------------------------------------------


def _parts(df: DataFrame) -> int:
    return max(common.shuffle_partitions(df.sparkSession), -(-df.count() // ROWS))


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, position, digest, size): turns in order, null first, ties by digest; size in bytes of the text. A table of scratch.

    Turns are sorted over range partitions and counted within; the driver adds what earlier partitions hold of the conversation that a
    partition starts with, one number a partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.unhex(F.md5(framed)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            size = np.diff(np.append(first, len(conv)))
            place = np.arange(len(conv)) - np.repeat(first, size)
            if conv[0] == last:
                place[: size[0]] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), batch.column(1), batch.column(2), pa.array(np.full(len(conv), part, np.int32))], names=["conv_id", "place", "digest", "size", "part"])

    dealt = rows.repartitionByRange(_parts(conversations), *order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    placed = scratch.written(dealt.mapInArrow(count, "conv_id long, place long, digest binary, size long, part int"), "turns")
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).orderBy("part").collect()
    carried, last, seen = [], None, 0
    for r in ends:
        before = seen if r.first == last else 0
        if before:
            carried.append((r.part, r.first, before))
        seen = r.last.place + 1 + (before if r.last.conv_id == r.first else 0)
        last = r.last.conv_id
    carry = placed.sparkSession.createDataFrame(carried, "part int, conv_id long, before long")
    joined = placed.join(F.broadcast(carry), ["part", "conv_id"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "digest", "size")


def exchanged(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations with exchanged first turns, as (conv_id, position, digest, size), and all their ids.

    Conversation c gets the first h turns of c - c % GROUP (all if fewer, none if there is none; % has the sign of c), then its own after its first h; h is
    the CRC-32 of c's decimal digits modulo HEAD.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    ids = turns.where("position = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("of"), h.alias("h"))
    few = turns.where(F.col("position") < HEAD - 1).groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("position", "digest", "size"))).alias("few"))
    head = F.when(F.col("h") > 0, F.slice("few", 1, F.col("h")))
    asked = scratch.written(ids.join(few, "of", "left").select("conv_id", "h", head.alias("head")), "heads")
    theirs = asked.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.position", "t.digest", "t.size")
    kept = asked.select("conv_id", "h", F.coalesce(F.array_size("head"), F.lit(0)).alias("lead"))
    own = turns.join(kept, "conv_id").where("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.col("lead")).alias("position"), "digest", "size")
    return theirs.unionByName(own), asked.select("conv_id")


# -- sorted rows ------------------------------------------------------------------------------------


def _hashed(part: Column, k: Column, tag: str) -> Column:
    return F.xxhash64(F.concat(part, F.lit(tag).cast("binary"), k.cast("string").cast("binary")))


def _segments(turns: DataFrame) -> DataFrame:
    """A row for every SEGMENT turns of a conversation: its number k, the id of all turns before (group_a, group_b; zeros before the first), the digests as one binary,
    the sizes, and whether more turns follow. Only conversations of SEGMENT turns or more meet a window, a row for so many turns."""
    k = (F.col("position") / SEGMENT).cast("long")
    cut = turns.groupBy("conv_id", k.alias("k")).agg(F.sort_array(F.collect_list(F.struct("position", "digest", "size"))).alias("t"))
    joined = F.aggregate("t", F.lit(b""), lambda s, x: F.concat(s, x["digest"]))
    rows = cut.select("conv_id", "k", joined.alias("turns"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    long = (F.col("k") > 0) | (F.size("sizes") == SEGMENT)
    order = Window.partitionBy("conv_id").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ids = [F.coalesce(F.bit_xor(_hashed(F.col("turns"), F.col("k"), tag)).over(before), F.lit(0)).alias(f"group_{tag}") for tag in "ab"]
    zero = [F.lit(0).cast("long").alias(f"group_{tag}") for tag in "ab"]
    whole = rows.where(~long).select("conv_id", "k", "turns", "sizes", *zero, F.lit(False).alias("more"))
    return whole.unionByName(rows.where(long).select("conv_id", "k", "turns", "sizes", *ids, F.lead("k").over(order).isNotNull().alias("more")))


def _common(x, y) -> int:
    """Leading turns of two rows of a group that are alike; of rows of different groups 0."""
    if (x.k, x.group_a, x.group_b) != (y.k, y.group_a, y.group_b):
        return 0
    n, a, b = 0, bytes(x.turns), bytes(y.turns)
    while n < min(len(a), len(b)) and a[n : n + DIGEST] == b[n : n + DIGEST]:
        n += DIGEST
    return n // DIGEST


def neighbours(ordered: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For each partition of sorted rows: turns that its first row shares with the row before, its last row with the row after, and the first row's k. One entry a partition."""
    key = F.struct(*_SORT)
    ends = ordered.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("part").collect()
    between = [_common(x.last, y.first) for x, y in zip(ends, ends[1:], strict=False)]
    return {r.part: (before, after, r.first.k) for r, before, after in zip(ends, [0, *between], [*between, 0], strict=False)}


# -- range minima -----------------------------------------------------------------------------------


def sparse_table(x: np.ndarray) -> list[np.ndarray]:
    """Level m holds the minima of every 2**m neighbours."""
    levels = [x]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]))
    return levels


def extents(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around row `at` within which every row shares `depth` turns with the one before; levels: of h over rows 1, 2, .."""
    left, right = at.copy(), at.copy()
    n = len(levels[0])
    for m in range(len(levels) - 1, -1, -1):
        step, mins = 1 << m, levels[m]
        if not len(mins):
            continue
        can = right + step <= n
        right[can & (mins[np.minimum(right, len(mins) - 1)] >= depth)] += step
        can = left >= step
        left[can & (mins[np.maximum(left - step, 0)] >= depth)] -= step
    return left, right


def least(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of rows left..right, from two stretches that overlap."""
    m = np.log2(right - left + 1).astype(np.int64)
    out = np.empty(len(left), levels[0].dtype)
    for level in np.unique(m):
        own = m == level
        out[own] = np.minimum(levels[level][left[own]], levels[level][right[own] + 1 - (1 << level)])
    return out


class Part:
    """Sorted rows of one partition."""

    def __init__(self, rows: pa.RecordBatch, before: int, after: int):
        get = lambda c: rows.column(rows.schema.get_field_index(c))
        self.conv, self.k, self.more = get("conv_id").to_numpy(), get("k").to_numpy(), get("more").to_numpy(zero_copy_only=False)
        self.group = np.stack([get("group_a").to_numpy(), get("group_b").to_numpy()], 1)
        self.turns = get("turns").to_pylist()
        self.size = np.array([len(t) // DIGEST for t in self.turns])
        n, most = len(self.conv), int(self.size.max())
        inside = np.arange(most)[None, :] < self.size[:, None]
        digests = np.zeros((n, most, 2), np.uint64)
        digests[inside] = np.frombuffer(b"".join(self.turns), np.uint64).reshape(-1, 2)
        #: Bytes of a row's first 0, 1, .. turns.
        self.bytes = np.zeros((n, most + 1), np.int64)
        self.bytes[:, 1:][inside] = get("sizes").flatten().to_numpy()
        np.cumsum(self.bytes, axis=1, out=self.bytes)
        alike = (digests[1:] == digests[:-1]).all(2) & inside[1:] & inside[:-1]
        shared = np.where(alike.all(1), most, np.argmin(alike, 1))
        shared[(self.k[1:] != self.k[:-1]) | (self.group[1:] != self.group[:-1]).any(1)] = 0
        self.h = np.append(before, shared)
        #: Bytes of the turns that a row shares with the one before, and whether nothing but equal rows has all its turns, for the last of equal ones.
        self.shared = self.bytes[np.arange(n), self.h]
        self.leaf = (np.append(self.h[1:], after) < self.size) & ~self.more

    def ids(self, row: int, first: int) -> list[tuple[int, int]]:
        """Ids of a row's prefixes of first, first + 1, .. turns of this segment; of none: the group's."""
        turns, out = self.turns[row], []
        a, b = int(self.group[row, 0]), int(self.group[row, 1])
        tags = [tag + str(self.k[row]).encode() for tag in (b"a", b"b")]
        for j in range(first, self.size[row] + 1):
            own = turns[: j * DIGEST]
            out.append((a ^ _signed(xxhash.xxh64_intdigest(own + tags[0], 42)), b ^ _signed(xxhash.xxh64_intdigest(own + tags[1], 42))) if j else (a, b))
        return out

    def nodes(self, deeper: np.ndarray, leaf_below: np.ndarray, segment: int = SEGMENT, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
        """This partition's part of every node: a candidate is a prefix that the row before, here, doesn't have."""
        levels, names = sparse_table(self.h[1:].astype(np.int16)), sparse_table(self.conv)
        total = lambda x: np.append(0, np.cumsum(x))
        leaves, shared, below = total(np.where(self.more, leaf_below, self.leaf)), total(self.shared), total(deeper)
        known = np.append(0, self.h[1:])
        number = self.size - known
        row = 0
        while row < len(number):
            end = max(row + 1, int(np.searchsorted(np.cumsum(number[row:]), at_once, "right")) + row)
            at = np.repeat(np.arange(row, end), number[row:end])
            depth = np.arange(len(at)) - np.repeat(np.cumsum(number[row:end]) - number[row:end], number[row:end]) + known[at] + 1
            left, right = extents(levels, at, depth)
            sum_shared = shared[right + 1] - shared[left + 1] + np.where((left == 0) & (depth <= self.h[0]), self.shared[0], 0) + below[right + 1] - below[left]
            chain = [self.ids(i, known[i]) for i in range(row, end) if number[i]]
            own = np.array([x for ids in chain for x in ids[1:]], np.int64).reshape(-1, 2)
            above = np.array([x for ids in chain for x in ids[:-1]], np.int64).reshape(-1, 2)
            columns = [own[:, 0], own[:, 1], above[:, 0], above[:, 1], self.k[at] * segment + depth, right - left + 1, least(names, left, right), leaves[right + 1] - leaves[left], sum_shared, self.bytes[at, depth - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _NODE.split(", ")])
            row = end


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _each_part(ordered: DataFrame, parts: int, step, made: str) -> DataFrame:
    """step(rows of a partition of `ordered`, its number) for each; whole partitions come back together by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = None

        def flush():
            if held:
                yield from step(pa.Table.from_batches(held).combine_chunks().to_batches()[0], part)

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if numbers[lo] != part:
                        yield from flush()
                        held, part = [], int(numbers[lo])
                    held.append(batch.slice(lo, hi - lo))
        yield from flush()

    first = ["part", *(c for c in ordered.columns if c != "part")]
    return ordered.select(*first).repartition(parts, "part").sortWithinPartitions("part", *_SORT).mapInArrow(run, made)


def _below(ordered: DataFrame, parts: int, beside: dict[int, tuple[int, int, int]]) -> DataFrame:
    """(conv_id, k, deeper, leaf_below) for segments that more turns follow: bytes that all later segments share with the row before, and whether the conversation's last row is a leaf."""

    def step(rows: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
        before, after, k = beside[part]
        p = Part(rows, before if k else 0, after)
        yield pa.RecordBatch.from_arrays([pa.array(p.conv), pa.array(p.k - 1), pa.array(p.shared), pa.array(p.leaf.astype(np.int64))], names=["conv_id", "k", "shared", "leaf"])

    later = _each_part(ordered.where("k > 0"), parts, step, "conv_id long, k long, shared long, leaf long")
    upward = Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return later.select("conv_id", "k", F.sum("shared").over(upward).alias("deeper"), F.sum("leaf").over(upward).alias("leaf_below"))


def _nodes(rows: DataFrame, parts: int, beside: dict[int, tuple[int, int, int]]) -> DataFrame:
    segment, at_once = SEGMENT, AT_ONCE

    def step(batch: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()
        before, after, _ = beside[part]
        yield from Part(batch, before, after).nodes(get("deeper"), get("leaf_below"), segment, at_once)

    pieces = _each_part(rows, parts, step, _NODE)
    whole = pieces.groupBy("a", "b").agg(
        F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("leaves").alias("n_leaves"), F.sum("shared").alias("shared"), F.first("above").alias("above"),
    )
    return whole.withColumn("saved_tokens", F.col("shared") - (F.col("n_convs") - 1) * F.col("above")).drop("shared", "above")


# -- members that end in a node -----------------------------------------------------------------------


def _digests(ends: DataFrame, parts: int) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv_id): ids are joined within range partitions, IDS at most at a time; a node's pieces then pass through its hash in order, as SHA-256 can't be merged."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(k).to_numpy() for k in range(3))
            if not len(a):
                continue
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            last = np.append(first[1:], len(a))
            ids = conv.astype(str).tolist()
            texts = [",".join(ids[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(conv[first]), pa.array(texts)], names=["a", "b", "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r[0], r[1]) == node:
                    state.update(b"," + r[3].encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (r[0], r[1]), hashlib.sha256(r[3].encode())
            yield _hashes(done)
        if node:
            yield _hashes([(*node, state.hexdigest())])

    order = ["a", "b", "conv_id"]
    joined = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, "a long, b long, conv_id long, ids string")
    return joined.repartition(parts, "a", "b").sortWithinPartitions(*order).mapInArrow(hashed, "a long, b long, ends_sha256 string")


def _hashes(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, digest = zip(*done, strict=True) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], names=["a", "b", "ends_sha256"])


# -- the trie -----------------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, conversations: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """A row for every distinct prefix of the conversations' turns; nodes have an id (a, b), the root's is (0, 0).

    turns: (conv_id, position from 0 without gaps, digest of DIGEST bytes, size); conversations: (conv_id), each once, turnless ones too.
    conv_id, the smallest member (a conversation that starts with the prefix); depth, turns of the prefix; parent_conv_id (root: null); n_convs, members;
    n_children; n_leaves, childless nodes in the subtree with its top; saved_tokens, the sum over the subtree of (members - 1) times the size of the prefix's last turn;
    ends_sha256, of the decimal ids of the members that end here, ascending, with commas. No conversation: no rows. parts: range partitions, else by the number of turns.
    """
    rows = _segments(turns)
    parts = parts or _parts(turns)
    ordered = scratch.written(rows.repartitionByRange(parts, *_SORT).sortWithinPartitions(*_SORT).withColumn("part", F.spark_partition_id()), "sorted")
    beside = neighbours(ordered)
    none = [F.lit(0).cast("long").alias(c) for c in ("deeper", "leaf_below")]
    both = ordered.where("more").join(_below(ordered, parts, beside), ["conv_id", "k"]).unionByName(ordered.where("not more").select("*", *none))
    inner = scratch.written(_nodes(both, parts, beside), "nodes")
    every = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    below = inner.where("depth = 1").agg(F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = every.crossJoin(F.broadcast(below)).select(zero.alias("a"), zero.alias("b"), null.alias("parent_a"), null.alias("parent_b"), zero.alias("depth"), "n_convs", "conv_id", "n_leaves", "saved_tokens")
    nodes = inner.unionByName(root)
    end = [F.col(f"group_{tag}").bitwiseXOR(_hashed(F.col("turns"), F.col("k"), tag)).alias(tag) for tag in "ab"]
    turnless = conversations.join(ordered.where("k = 0").select("conv_id"), "conv_id", "left_anti").select(zero.alias("a"), zero.alias("b"), "conv_id")
    ends = _digests(ordered.where("not more").select(*end, "conv_id").unionByName(turnless), parts)
    children = inner.groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    parent = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, ["a", "b"], "left").join(ends, ["a", "b"], "left").join(parent, ["parent_a", "parent_b"], "left")
    scratch.keep(ordered, inner)
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", digest.alias("ends_sha256"), "a", "b", "parent_a", "parent_b")


def conversation_trie(conversations: DataFrame, exchange: bool = False) -> DataFrame:
    """The trie (see `prefix_trie`) of conversations (conv_id, turn, role, text, ..); exchange: after `exchanged`.

    Turns are alike if role and text are; null ones count as empty. Null turns come first, and those of equal number are ordered by a digest. Repeated rows are
    turns of their own. Rows without conv_id take no part. Other columns are ignored. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    common.prepare(spark, IDS)
    with Scratch(spark) as scratch:
        turns = numbered(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"), scratch)
        ids, parts = turns.where("position = 0").select("conv_id"), _parts(turns)
        if exchange:
            turns, ids = exchanged(turns, scratch)
        out = prefix_trie(turns, ids, scratch, parts)
        for table, _ in list(scratch.paths):
            scratch.keep(table)
        return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), exchange=True)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS turns FROM own GROUP BY conv_id
), crc AS (
  SELECT conv_id, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda r, x:
         list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(r, x)), 4294967295::BIGINT) AS crc
  FROM lists
), rebuilt AS (
  SELECT l.conv_id, coalesce(b.turns[:h], []) || l.turns[h + 1:] AS turns
  FROM lists l JOIN (SELECT conv_id, xor(crc, 4294967295) % 9 AS h FROM crc) USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 5
), members AS (
  SELECT conv_id, turns[:d] AS node, d, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, d
), children AS (
  SELECT node[:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)
), sums AS (
  SELECT node[:e] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(node[d].text)) END) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_nodes) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (node) LEFT JOIN nodes p ON p.node = n.node[:n.d - 1] AND p.d = n.d - 1
"""
