"""Packing of tokenised documents into fixed windows: bounded-space online best fit, one pass over the corpus."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
#: Windows that a partition keeps open.
OPEN = 64
END = 1
#: Different word pieces whose ids a worker remembers, in a table of SLOTS.
REMEMBER, SLOTS = 1_000_000, 1 << 22
#: Bytes whose pieces are looked up at once.
CHUNK = 1 << 20
#: Partitions whose leftovers one group merges.
MERGE = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: White space that cuts a text, as bytes. Texts with rarer white space, or what may be a special token, go to the tokenizer whole.
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0D, 0x20]] = True
_RARE = np.zeros(256, bool)
_RARE[[0x0B, 0x0C, *range(0x1C, 0x20)]] = True


def rare_texts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold other white space of Unicode, or "<|"."""
    one, two, three = data, data[1:], data[2:]
    at = [np.flatnonzero(_RARE[one])]
    if len(two):
        at.append(np.flatnonzero((one[:-1] == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one[:-1] == 0x3C) & (two == 0x7C)))
    if len(three):
        lead = np.flatnonzero((one[:-2] >= 0xE1) & (one[:-2] <= 0xE3))
        x, y, z = one[lead], two[lead], three[lead]
        blank = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F)
        at.append(lead[blank | (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))])
    out = np.zeros(len(bounds) - 1, bool)
    out[np.searchsorted(bounds, np.concatenate(at), "right") - 1] = True
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts are cut: before a single space in front of a word, and around other white space, of which the last stands alone.

    The tokenizer's own pre-tokens never cross these places.
    """
    space = _SPACE[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[bounds[:-1]] = True
    start = begin[:-1].copy()
    start[:-1] |= space[:-1] & ~space[1:] & ~begin[1:-1]
    start[1:] |= space[1:] & ~space[:-1] | ~space[1:] & space[:-1] & (data[:-1] != 0x20)
    return np.flatnonzero(start)


class Encoder:
    """Texts to ids. Pieces that were met before are looked up in a table, by a 64-bit hash and their size; only new ones go to the tokenizer."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.line = self.ids("\n")[0]
        self.forget()

    def forget(self) -> None:
        self.hash, self.size, self.at, self.n = np.zeros(SLOTS, np.uint64), *(np.zeros(SLOTS, np.int32) for _ in range(3))
        self.known, self.used, self.flat = 0, 0, np.zeros(1 << 20, "<u4")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def tokenise(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece). One call for many pieces, a line each: the line break's id never occurs inside a visible piece."""
        n = np.zeros(len(pieces), np.int64)
        found: list[np.ndarray] = [np.zeros(0, "<u4")] * len(pieces)
        visible = []
        for k, p in enumerate(pieces):
            if p.isspace():
                found[k] = self.ids(p)
                n[k] = len(found[k])
            else:
                visible.append(k)
        for lo in range(0, len(visible), 4096):
            part = visible[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n" + "\n".join([pieces[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.line)
            n[part] = np.diff(cut, append=len(ids)) - 1
            for k, x in zip(part, np.split(ids, cut)[1:], strict=True):
                found[k] = x[1:]
        return np.concatenate(found), n

    def find(self, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slots of some pieces; -1 for unknown ones."""
        slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        while len(left):
            here = slot[left]
            held = self.hash[here]
            hit = (held == hashes[left]) & (self.size[here] == size[left])
            out[left[hit]] = here[hit]
            left = left[~hit & (held != 0)]
            slot[left] = (slot[left] + 1) % SLOTS
        return out

    def learn(self, hashes: np.ndarray, size: np.ndarray, pieces: list[str]) -> None:
        ids, n = self.tokenise(pieces)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), "<u4")])
        self.flat[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.hash[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            here = slot[won]
            self.hash[here], self.size[here], self.at[here], self.n[here] = hashes[won], size[won], at[won], n[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) % SLOTS
        self.used, self.known = self.used + len(ids), self.known + len(pieces)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after the other, and the texts' bounds in them; texts without rare white space."""
        start = piece_starts(data, bounds)
        end = np.append(start[1:], len(data))
        found, count, k = [], [np.zeros(1, np.int64)], 0
        while k < len(start):
            j = int(np.searchsorted(end, start[k] + CHUNK, "right"))
            if j <= k:  # a piece this long isn't remembered
                found.append(self.ids(data[start[k] : end[k]].tobytes().decode()))
                count.append(np.array([len(found[-1])]))
                k += 1
                continue
            lo, size = start[k:j] - start[k], (end[k:j] - start[k:j]).astype(np.int32)
            hashes = np.maximum(common.Prefix(common.BYTE[data[start[k] : end[j - 1]]]).spans(lo, lo + size), np.uint64(1))
            slot = self.find(hashes, size)
            while len(new := np.flatnonzero(slot < 0)):
                if self.known + len(new) > REMEMBER:
                    self.forget()
                    new = np.arange(len(slot))
                new = new[np.unique(hashes[new], return_index=True)[1]]
                self.learn(hashes[new], size[new], [data[start[k + i] : end[k + i]].tobytes().decode() for i in new.tolist()])
                slot = self.find(hashes, size)
            n = self.n[slot].astype(np.int64)
            past = np.cumsum(n)
            found.append(self.flat[np.arange(past[-1]) + np.repeat(self.at[slot] - (past - n), n)])
            count.append(n)
            k = j
        past = np.cumsum(np.concatenate(count))
        return np.concatenate(found) if found else np.zeros(0, "<u4"), past[np.searchsorted(start, bounds)]


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Open windows as (gap, number), smallest gap first, so the first gap that is large enough fits best."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.open: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.number = 0
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.done.append((doc, start, length, zlib.crc32(ids), total, self.number, offset))
            offset += length
        self.number += 1

    def add(self, doc, ids: bytes) -> None:
        total = size = len(ids) // 4
        start = 0
        while size - start >= self.window:
            self._emit([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        while start < size:
            k = bisect.bisect_left(self.open, (size - start, -1))
            if k < len(self.open):
                gap, at = self.open.pop(k)
                take = size - start
            elif len(self.open) < self.most:
                gap, at = self.window, max(self.held, default=0) + 1
                self.held[at] = []
                take = size - start
            else:  # none fits: the fullest is topped up and goes
                gap, at = self.open.pop(0)
                take = gap
            self.held[at].append((doc, start, ids[4 * start : 4 * (start + take)], total))
            start += take
            if take == gap:
                self._emit(self.held.pop(at))
            else:
                bisect.insort(self.open, (gap - take, at))

    def leftovers(self) -> list[tuple]:
        """Fills windows from those still open, fullest first; returns the pieces that make no whole window."""
        pieces = [p for _, at in self.open for p in self.held[at]]
        self.open, self.held = [], {}
        now, room = [], self.window
        for doc, start, ids, total in pieces:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                now.append((doc, start, part, total))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    self._emit(now)
                    now, room = [], self.window
        return now


def binary_tail(pieces: list[tuple], packer: Packer) -> None:
    """Sequences of powers of two, which need no padding, from less than a window."""
    rest = sum(len(p[2]) // 4 for p in pieces)
    now: list[tuple] = []
    room = 1 << (rest.bit_length() - 1) if rest else 0
    for doc, start, ids, total in pieces:
        while ids:
            part, ids = ids[: 4 * room], ids[4 * room :]
            now.append((doc, start, part, total))
            start += len(part) // 4
            room -= len(part) // 4
            rest -= len(part) // 4
            if not room:
                packer._emit(now)
                now, room = [], 1 << (rest.bit_length() - 1) if rest else 0


def _rows(done: list[tuple], base: int, leftovers: list[tuple] = ()) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [()] * 7
    columns[5] = [base + k for k in columns[5]]
    columns = [list(c) + [None] * len(leftovers) for c in columns] + [[None] * len(done) + [p[2] for p in leftovers]]
    n = len(done)
    for k, (doc, start, ids, total) in enumerate(leftovers):
        for c, v in ((0, doc), (1, start), (2, len(ids) // 4), (4, total)):
            columns[c][n + k] = v
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=names)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN, tokenizer: str | None = None) -> DataFrame:
    """Packs all documents (ids, then END) into sequences of at most `window` ids, cutting documents freely.

    A partition keeps `open_windows` windows open and places each document (what remains beyond whole windows) into
    the one it fits best. When none fits, the fullest is topped up with the document's head and emitted. At its end
    the open windows fill each other; the rest, under one window a partition, is merged by groups of MERGE partitions, and
    what still makes no window becomes sequences of power-of-two length. So no sequence needs padding.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty text: the single id END. A null
    key stays null; repeated rows are packed each on its own. Other columns of docs are not read. An empty
    table gives no rows. Long texts are cut into whole windows as they come.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    end = np.array([END], "<u4").tobytes()

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        packer, part, coder = Packer(window, open_windows), TaskContext.get().partitionId(), encoder(tokenizer)
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, bounds = common.utf8(batch.column(1))
            for i, j in common.slices(bounds):
                text, inner = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                rare = rare_texts(text, inner)
                # what goes to the tokenizer whole is left out here
                plain = text if not rare.any() else text[np.repeat(~rare, np.diff(inner))]
                ids, at = coder.encode(plain, np.append(0, np.cumsum(np.where(rare, 0, np.diff(inner)))))
                for d in range(j - i):
                    own = coder.ids(text[inner[d] : inner[d + 1]].tobytes().decode()) if rare[d] else ids[at[d] : at[d + 1]]
                    packer.add(names[i + d], own.tobytes() + end)
            if packer.done:
                yield _rows(packer.done, part << 32)
                packer.done = []
        rest = packer.leftovers()
        if packer.done or rest:
            yield _rows(packer.done, part << 32, rest)

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = common.written(plain.mapInArrow(online, PIECES).withColumn("part", F.spark_partition_id()), "pieces")

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        packer = Packer(window, open_windows)
        rows = rows.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        packer.held[0] = list(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))
        packer.open = [(0, 0)]
        binary_tail(packer.leftovers(), packer)
        return pa.Table.from_batches([_rows(packer.done, (1 << 62) | (group[0].as_py() << 32))])

    merged = pieces.where(F.col("ids").isNotNull()).withColumn("group", F.expr(f"part div {MERGE}")).groupBy("group").applyInArrow(merge, PIECES)
    return pieces.where(F.col("ids").isNull()).drop("part").unionByName(merged).drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
