"""Near-duplicate documents: a set similarity join by recursive branching on minwise tokens, exactly verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats
from .common import LOWER, U64, Prefix, Scratch, mix, signed
from .components import connected_components

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: Independent trees, and levels of branching. A pair at the threshold meets in a node of level l of one tree with
#: probability 0.75**l: it is missed by all trees with probability 2e-10 at level 1, 2e-6 at 2, 2e-4 at 3. Only nodes that
#: are still large branch deeper.
TREES, LEVELS = 16, 5
#: Nodes of more documents branch again.
SMALL = 32
#: Pairs of a node whose minwise tokens agree in less than this share are not verified. At the threshold the share is
#: 0.75 with a deviation of 0.05.
LEAST_SHARE = 0.5
#: About so many documents of a large node travel together to meet the node's others.
TOGETHER = 64

ORDERS = TREES * LEVELS
_ODD = mix(np.arange(1, ORDERS + 1, dtype=U64)) | U64(1)
_ADD = mix(np.arange(1001, ORDERS + 1001, dtype=U64))


def shingle_sets(column: pa.Array, pick: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, set bounds, sorted shingle hashes) for some documents at a time; pick: only these."""
    data, bounds = common.utf8(column)
    for i, j in common.slices(bounds):
        if pick is not None and not pick[i:j].any():
            continue
        words, at = common.word_hashes(LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i])
        size = np.diff(at)
        prefix = Prefix(words)
        count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
        doc = np.repeat(np.arange(j - i), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + at[:-1][doc]
        hashes = prefix.spans(start, np.minimum(start + SHINGLE, at[1:][doc]))
        if pick is not None:
            keep = pick[i:j][doc]
            doc, hashes = doc[keep], hashes[keep]
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        doc, hashes = doc[new], hashes[new]
        yield np.arange(i, j), np.searchsorted(doc, np.arange(j - i + 1)), hashes


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, a 128-bit name of the set, and its least token under each tree's and level's own order."""
    for batch in batches:
        ids = batch.column(0)
        for docs, bounds, hashes in shingle_sets(batch.column(1)):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            one, two = np.zeros(len(docs), U64), np.zeros(len(docs), U64)
            least = np.zeros((len(docs), ORDERS), np.uint32)
            if len(some):
                at = bounds[:-1][some]
                one[some] = np.add.reduceat(mix(hashes), at)
                two[some] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), at)
                for k in range(ORDERS):
                    least[some, k] = np.minimum.reduceat((hashes * _ODD[k] + _ADD[k]) >> U64(32), at)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(docs[0], len(docs)), pa.array(n), pa.array(signed(one)), pa.array(signed(two)), pa.array([x.tobytes() if k else b"" for x, k in zip(least, n, strict=True)], pa.binary())],
                names=["doc", "n", "name0", "name1", "least"],
            )


def node_keys(least: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """(documents, TREES, levels): the node that each document is in, one key for each level of each tree."""
    tokens = least.reshape(-1, TREES, LEVELS)[:, :, :levels].astype(U64)
    out = np.empty_like(tokens)
    path = mix(np.arange(1, TREES + 1, dtype=U64))[None, :]
    for level in range(levels):
        path = mix(path ^ (tokens[:, :, level] * U64(0x9E3779B97F4A7C15)))
        out[:, :, level] = path
    return out


def _least_of(batch: pa.RecordBatch, name: str = "least") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint32).reshape(len(batch), ORDERS)


def nodes_of(texts: DataFrame) -> DataFrame:
    """(doc, tree, k1) for each tree in which some other document is in the document's first node."""
    spark = texts.sparkSession
    width = repeats.sketch_width(texts.count() * TREES)

    def first(batches):
        for batch in batches:
            if len(batch):
                yield from repeats.sketch_rows([node_keys(_least_of(batch), 1).ravel()], width)

    bits = spark.sparkContext.broadcast(repeats.merged(texts.select("least").mapInArrow(first, repeats.SEGMENTS), width))

    def shared(batches):
        for batch in batches:
            if len(batch):
                keys = node_keys(_least_of(batch), 1).ravel()
                pick = np.flatnonzero(repeats.repeated(keys, bits.value, width))
                yield pa.record_batch({"doc": pa.array(np.repeat(batch.column("doc").to_numpy(), TREES)[pick]), "tree": pa.array((pick % TREES).astype(np.int32)), "k1": pa.array(signed(keys[pick]))})

    return texts.select("doc", "least").mapInArrow(shared, "doc long, tree int, k1 long")


def deeper(rows: DataFrame, least: DataFrame) -> DataFrame:
    """(doc, tree, k2 .. kLEVELS) for rows (doc, tree)."""
    names = [f"k{level + 1}" for level in range(1, LEVELS)]

    def keys(batches):
        for batch in batches:
            if len(batch):
                own = node_keys(_least_of(batch))[np.arange(len(batch)), batch.column("tree").to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tree"), *(pa.array(signed(np.ascontiguousarray(own[:, k]))) for k in range(1, LEVELS))], names=["doc", "tree", *names])

    return rows.select("doc", "tree").join(least, "doc").select("doc", "tree", "least").mapInArrow(keys, "doc long, tree int, " + ", ".join(f"{x} long" for x in names))


def branch(rows: DataFrame, least: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc) of the nodes of 2 to SMALL documents, each at the first level where it is so small; (node, tree, doc) of those that stay larger."""
    small: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        key = f"k{level}"
        large = scratch.written(rows.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > SMALL).select(F.col(key).alias("large")), "large")
        here = rows.join(large, rows[key] == large.large, "left_anti").select(F.col(key).alias("node"), "doc")
        small = here if small is None else small.unionByName(here)
        if large.isEmpty():
            return small, None
        rows = rows.join(large, rows[key] == large.large, "left_semi")
        rows = scratch.written(deeper(rows, least) if level == 1 else rows, "branch")
    return small, rows.select(F.col(f"k{LEVELS}").alias("node"), "tree", "doc")


def token_sets(docs: DataFrame, wanted: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """(doc, tokens): full sets of the wanted documents, about `count`; a bit array of their hashes picks them from docs (id, text)."""
    spark = docs.sparkSession
    width = repeats.sketch_width(count)

    def mark(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(U64)
            if len(key):
                yield from repeats.sketch_rows([key, key], width)

    bits = spark.sparkContext.broadcast(repeats.merged(wanted.select("doc").mapInArrow(mark, repeats.SEGMENTS), width))

    def sets(batches):
        for batch in batches:
            ids = batch.column(0)
            pick = repeats.repeated(ids.to_numpy().view(U64), bits.value, width) if len(batch) else np.zeros(0, bool)
            for docs, bounds, hashes in shingle_sets(batch.column(1), pick):
                own = np.flatnonzero(np.diff(bounds))
                yield pa.record_batch({"doc": ids.take(pa.array(docs[own])), "tokens": pa.array([hashes[bounds[k] : bounds[k + 1]].tobytes() for k in own], pa.binary())})

    made = scratch.written(docs.mapInArrow(sets, "doc long, tokens binary").dropDuplicates(["doc"]), "sets")
    bits.destroy()
    return made


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < PERCENT * large:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough, a table of scratch. docs: (id, text); sets are made for the documents in pairs only."""
    ends = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    made = token_sets(docs, ends, 2 * pairs.count(), scratch)
    left, right = made.toDF("a", "left"), made.toDF("b", "right")

    def similar(batches):
        for batch in batches:
            both = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([linked(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in both], pa.bool_()))

    links = scratch.written(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(similar, "a long, b long"), "links")
    scratch.drop(made)
    return links


def stars(small: DataFrame, large: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Each document of a node with the node's first document."""
    lists = small.groupBy("node").agg(F.sort_array(F.collect_list("doc")).alias("docs")).where(F.size("docs") > 1)
    pairs = lists.select(F.col("docs")[0].alias("a"), F.explode(F.slice("docs", 2, SMALL)).alias("b"))
    if large is not None:
        first = scratch.written(large.groupBy("node").agg(F.min("doc").alias("a")), "firsts")
        pairs = pairs.unionByName(large.join(first, "node").where("a <> doc").select("a", F.col("doc").alias("b")))
    return pairs.distinct()


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(-1) >= LEAST_SHARE


def rest_of_small(small: DataFrame, tell: DataFrame) -> DataFrame:
    """The pairs of a small node in different components so far whose minwise tokens agree often enough."""

    def within(batches):
        for batch in batches:
            for docs, least, component in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = np.frombuffer(b"".join(least), np.uint32).reshape(len(docs), -1)
                i, j = np.triu_indices(len(docs), 1)
                names = np.array(component)
                keep = names[i] != names[j]
                i, j = i[keep], j[keep]
                keep = agree(tokens[i], tokens[j])
                a, b = np.array(docs)[i[keep]], np.array(docs)[j[keep]]
                yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    told = small.join(tell, "doc")
    mixed = told.groupBy("node").agg(F.collect_list("doc").alias("docs"), F.collect_list("least").alias("least"), F.collect_list("component").alias("component"))
    return mixed.where(F.size(F.array_distinct("component")) > 1).select("docs", "least", "component").mapInArrow(within, "a long, b long")


def rest_of_large(large: DataFrame, tell: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between the documents outside a large node's main component and all others of the node, on full sets.

    Those outside travel in parcels; each document of the node meets each parcel, so no row is made for a pair. A pair
    that shares several nodes is compared in its first tree.
    """
    told = scratch.written(large.join(tell.select("doc", "component"), "doc"), "large-told")
    sizes = told.groupBy("node", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("node").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all")).where("most < all")
    main = scratch.written(main.select("node", "main", F.ceil((F.col("all") - F.col("most")) / TOGETHER).alias("parcels")), "mains")
    mixed = scratch.written(told.join(main, "node"), "large-mixed")
    sets = token_sets(docs, mixed.select("doc").distinct(), mixed.count(), scratch)
    full = mixed.join(sets, "doc").join(tell.select("doc", "least"), "doc")
    full = scratch.written(full, "large-full")
    scratch.drop(told, main, mixed, sets)
    odd = full.where("component <> main").withColumn("parcel", F.pmod(F.xxhash64("doc"), F.col("parcels")))
    odd = odd.groupBy("node", "parcel").agg(F.collect_list(F.struct("doc", "component", "least", "tokens")).alias("odd"))

    def meet(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["least"], np.uint32)
                theirs = np.frombuffer(b"".join(o["least"] for o in row["odd"]), np.uint32).reshape(len(row["odd"]), -1)
                ids, parts = np.array([o["doc"] for o in row["odd"]]), np.array([o["component"] for o in row["odd"]])
                # two odd documents meet twice
                ask = (parts != row["component"]) & agree(theirs, own) & ((row["component"] == row["main"]) | (ids < row["doc"]))
                first = (theirs == own).reshape(len(ids), TREES, LEVELS).all(-1).argmax(-1)
                mine = np.frombuffer(row["tokens"], U64)
                found = [int(ids[k]) for k in np.flatnonzero(ask & (first == row["tree"])) if linked(mine, np.frombuffer(row["odd"][k]["tokens"], U64))]
                if found:
                    yield pa.record_batch({"a": pa.array([min(x, row["doc"]) for x in found], pa.int64()), "b": pa.array([max(x, row["doc"]) for x in found], pa.int64())})

    links = scratch.written(full.join(odd, "node").select("tree", "doc", "component", "main", "least", "tokens", "odd").mapInArrow(meet, "a long, b long"), "links")
    scratch.drop(full)
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by similar sets of five-word shingles.

    Equal sets are one class, of which one member goes on. A tree branches all classes by the least token under a random
    order, and each node of more than SMALL again by another order, LEVELS deep; TREES trees are independent. In a node all
    are compared with its first document, on full sets. Pairs of a node that this leaves unconnected are compared
    too: all pairs of small nodes, and in larger ones each document outside the main connected part with all others.

    Null text and text without words: n_shingles 0, linked with nothing, kept. Under five words, the whole sequence is one
    shingle. A null key: component null, kept. A key names one document; repeated rows of it share its component. Ties:
    the smallest key names the component and is kept. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        known = scratch.written(plain.mapInArrow(signatures, "doc long, n long, name0 long, name1 long, least binary"), "signatures")
        full = known.where("doc is not null and n > 0")
        classes = scratch.written(full.groupBy("name0", "name1", "n").agg(F.min("doc").alias("first")), "classes")
        firsts = classes.select(F.col("first").alias("doc")).distinct()
        least = scratch.written(full.select("doc", "least").join(firsts, "doc", "left_semi").dropDuplicates(["doc"]), "firsts")
        own = scratch.written(known.select("doc", "n", "name0", "name1"), "sizes")
        scratch.drop(known)

        nodes = scratch.written(nodes_of(least), "nodes")
        small, large = branch(nodes, least, scratch)
        small = scratch.written(small, "small")
        plain = plain.where("id is not null and text is not null")
        first_pairs = scratch.written(stars(small, large, scratch), "stars")
        links = verified(first_pairs, plain, scratch)
        component = connected_components(links, scratch)
        tell = least.join(component, least.doc == component.node, "left").select("doc", "least", F.coalesce("component", "doc").alias("component"))
        tell = scratch.written(tell, "told")
        scratch.drop(first_pairs, nodes)
        rest = scratch.written(rest_of_small(small, tell).distinct(), "rest")
        more = verified(rest, plain, scratch)
        if large is not None:
            more = more.unionByName(rest_of_large(large, tell, plain, scratch))
        if not more.isEmpty():
            component = connected_components(links.unionByName(more), scratch)
        named = classes.join(component, classes["first"] == component.node, "left").select("name0", "name1", F.col("n").alias("size"), F.coalesce("component", "first").alias("component"))
        named = scratch.written(named, "named")
        scratch.keep(own, named)
    joined = own.where("doc is not null and n > 0").join(named.where("size > 0"), ["name0", "name1"], "left").where("size = n")
    alone = own.where("doc is null or n = 0").select("doc", "n", F.col("doc").alias("component"))
    every = joined.select("doc", "n", "component").unionByName(alone)
    return every.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
