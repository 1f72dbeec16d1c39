"""Near copies by words: SimHash tries and MinHash bands propose pairs of texts, exact Jaccard similarity of their word shingles decides.

A text is its words in lower case; equal ones are one node, so copies meet in an aggregate. A node has one key for the set of
fingerprints that the tries link with its own, and one per band of minima, for similar texts whose fingerprints lie further
apart. A key's nodes are compared with one leader, and what this leaves in several components block by block, so that each
pair of nodes that share a key was compared or is connected by other links. Shingles are made again for proposed texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import matched, slices, unused, written
from wattledger.llm.components import components
from wattledger.llm.simhash import fingerprint, near_links

SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
#: A pair of similarity s shares a key with chance 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, BAND_ROWS = 20, 5
#: Shingles of a block of nodes (in the mean), and different shingles of two blocks in a matrix at once.
BLOCK_SHINGLES, COLUMNS_AT_ONCE = 200_000, 2048
#: Hashes whose minima are taken at once.
HASHES_AT_ONCE = 1 << 12
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)


def text_words(text: str | None) -> list[bytes]:
    """Lower case of A-Z, split at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles; a shorter text is one shingle, no words are none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, width = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(line[s:e]) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=False)], dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key per band of minima; nothing for no hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), HASHES_AT_ONCE):
        np.minimum(least, (hashes[k : k + HASHES_AT_ONCE, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def node_of(words: list[bytes]) -> int:
    key = xxhash.xxh64_intdigest(b" ".join(words))
    return key - (1 << 64) if key >> 63 else key


def add_keys(documents: DataFrame) -> DataFrame:
    """doc_id, node, the band keys and the SimHash fingerprint (signed long) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            words = [text_words(t) for t in texts]
            prints = np.array([fingerprint(t, SHINGLE_WORDS) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([node_of(w) for w in words], pa.int64()),
                 pa.array([band_keys(shingles(w)) for w in words], pa.list_(pa.int64())), pa.array(prints.view(np.int64))],
                ["doc_id", "node", "keys", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, node long, keys array<long>, fingerprint long")


def trie_keys(own: DataFrame) -> DataFrame:
    """node and key of the nodes of `own` (node, fingerprint) that have words: one key for each set of fingerprints the tries link."""
    prints = own.filter(F.size("keys") > 0).select("node", "fingerprint").distinct()
    roots = components(near_links(prints)).withColumnRenamed("node", "fingerprint")
    root = F.coalesce("root", "fingerprint")
    return prints.join(roots, "fingerprint", "left").select("node", F.xxhash64(F.lit("trie"), root).alias("key"))


def shingle_sets(documents: DataFrame) -> DataFrame:
    """node, the distinct shingles of every row's text and their number."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [text_words(t) for t in part.column("text").to_pylist()]
            sets = [shingles(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(w) for w in words], pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32())],
                ["node", "shingles", "n"])

    return documents.select("text").mapInArrow(per_batch, "node long, shingles array<long>, n int")


def similar(pairs: DataFrame, sets: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles, n) have a Jaccard similarity of at least `least`."""
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    # A set smaller by more than the least similarity cannot reach it, so its shingles need not travel.
    sides = sides.filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b")
    both = sides.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= least * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components `roots` (node, root) after new links (a, b)."""
    edges = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(edges).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return roots.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root"))


def shared_counts(rows: list[np.ndarray], others: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets has in common with each of those at the positions `others`."""
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values, column, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    kept = often[column] > 1  # what only one set has, no two have in common
    which, column = which[kept], np.cumsum(often > 1)[column[kept]] - 1
    order = np.argsort(column, kind="stable")
    which, column, width = which[order], column[order], int((often > 1).sum())
    out = np.zeros((len(others), len(rows)), dtype=np.float32)
    for low in range(0, width, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + COLUMNS_AT_ONCE])
        part = np.zeros((len(rows), min(COLUMNS_AT_ONCE, width - low)), dtype=np.float32)
        part[which[a:b], column[a:b] - low] = 1
        out += part[others] @ part.T
    return out


def linked_in_block(nodes: np.ndarray, roots: np.ndarray, outside: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join the components of a block as all its similar pairs with a node of `outside` would: at most one a component."""
    left = np.flatnonzero(outside)
    if not len(left) or (roots == roots[0]).all():
        return []
    size = np.array([len(x) for x in sets], dtype=np.float64)
    shared = shared_counts(sets, left)
    near = (shared >= least * (size[left][:, None] + size[None, :] - shared)) & (roots[left][:, None] != roots[None, :])
    u, v = np.nonzero(near)
    names, component = np.unique(roots, return_inverse=True)
    label = np.arange(len(names))
    a, b = component[left[u]], component[v]
    while True:
        lower = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, lower)
        np.minimum.at(new, b, lower)
        new = new[new]
        if (new == label).all():
            break
        label = new
    first = np.full(len(names), -1)
    first[component[::-1]] = nodes[::-1]
    return [(int(first[k]), int(first[label[k]])) for k in np.flatnonzero(label != np.arange(len(names)))]


def links_of_open_keys(open_: DataFrame, sets: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Links (a, b) that connect whatever similar pairs of a key connect. `open_` has key, node, root, largest.

    A pair within the key's largest component needs no look. All others, so those with a node outside of it, are
    compared: a key's nodes lie in blocks of a bounded number of shingles, and each pair of blocks meets in one task,
    where a matrix product counts what any two sets share. Only links leave it, not pairs.
    """
    sized = open_.join(sets, "node")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = sized.join(blocks, "key").withColumn("own", own).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", (F.col("root") != F.col("largest")).alias("outside"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None
        for batch in batches:
            names = batch.schema.names
            for row in zip(*[batch.column(names.index(c)).to_pylist() for c in ("key", "i", "j", "node", "root", "outside")], batch.column(names.index("shingles")), strict=True):
                if row[:3] != at and rows:
                    yield from linked(rows)
                    rows = []
                at = row[:3]
                rows.append((*row[3:6], row[6].values.to_numpy()))
        if rows:
            yield from linked(rows)

    def linked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes, roots, outside, sets = zip(*rows, strict=True)
        found = linked_in_block(np.array(nodes), np.array(roots), np.array(outside), list(sets), least)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def near_components(documents: DataFrame, own: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes of `own` (doc_id, node, keys, fingerprint) that share a key.

    Nodes are linked if they share a key and their texts are similar. First each key has one leader, the same for keys
    with the same nodes, with which its other nodes are compared: this connects the copies of one text, however many they
    are, with as many pairs as nodes. Keys whose other nodes still lie in several components are then compared in blocks.
    """
    entries = own.select("node", F.explode("keys").alias("key")).union(trie_keys(own)).distinct()
    order = F.struct(F.xxhash64("node").alias("turn"), "node")
    leaders = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order)["node"].alias("leader")).filter("n > 1")
    entries = written(entries.join(leaders.drop("n"), "key").select("key", "node", "leader"))
    roots = written(entries.select("node", F.col("node").alias("root")).distinct())
    wanted = written(own.join(roots, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    sets = written(shingle_sets(matched(documents, wanted, "doc_id")).join(roots.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    followers = entries.filter("node <> leader")
    pairs = followers.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    roots = written(joined_roots(roots, written(similar(pairs, sets))))
    placed = followers.select("key", "node").join(roots, "node")
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root"))["root"].alias("largest"))
    open_ = placed.join(keys.filter("parts > 1").select("key", "largest"), "key").select("key", "node", "root", "largest")
    return written(joined_roots(roots, written(links_of_open_keys(open_, sets))))


@F.pandas_udf(T.LongType())
def _node(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: node_of(text_words(t)))


def keep_one_of_each_copy(documents: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group that links of similar texts reach, all columns unchanged.

    Texts without words are copies of each other. Rows without a doc_id cannot be named by another, so they stay. Rows with
    one doc_id are each judged by their text; of those in one group, the one with the smallest text stays. Only ids, keys and
    the shingles of texts that share a key are shuffled, not the texts, but for those of repeated ids and where the ids to
    drop are too many to be broadcast. An empty table gives no rows.
    """
    known = documents.filter("doc_id is not null")
    own = written(add_keys(known))
    least = own.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    linked = written(least.join(near_components(known, own), "node"))
    reach = linked.groupBy("root").agg(F.min("least_id").alias("group_id"))
    groups = least.join(linked.join(reach, "root").select("node", "root", "group_id"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("group_id", "least_id").alias("group_id"))
    judged = own.select("doc_id", "node").join(groups, "node")
    ids = written(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("group_id")).alias("stays")).filter("rows > 1 or not stays"))
    single = matched(documents, ids.select("doc_id"), "doc_id", "left_anti")
    repeated = written(ids.filter("rows > 1 and stays").select("doc_id"))
    if repeated.isEmpty():
        return single
    node, root, turn = (unused(name, documents.columns) for name in ("node_of_text", "root_of_text", "turn_in_group"))
    named = groups.select(F.col("node").alias(node), F.col("root").alias(root), F.col("group_id").alias(turn))
    rows = matched(documents, repeated, "doc_id").withColumn(node, _node("text")).join(named, node).filter(F.col("doc_id") == F.col(turn))
    order = Window.partitionBy("doc_id", root).orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    one = rows.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1)
    return single.unionByName(one.select(*[F.col(f"`{c}`") for c in documents.columns]))
