"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Only fingerprints (8 bytes) are shuffled for the search, never texts, and only distinct ones: copies meet in an
aggregate. Fingerprints are dealt by pairs of bit blocks: with six blocks, two that differ in at most four bits agree on
two whole blocks, so each pair of blocks is one way to deal and no link is lost. A task holds the tries of its
groups as one sorted array. It joins the tries with themselves and returns a star per linked set, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import slices, written
from wattledger.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_DIFFERING_BITS = 4
#: Hashes turned into bits at once, and node pairs and leaf pairs held at once.
HASHES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 19
#: A node pair with so few member pairs is compared directly.
LEAF_PAIRS = 32


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: bit k is 1 if it is set in over half of the shingles' hashes; no words give 0.

    Lower-casing A-Z and splitting at ASCII white space are the methods of bytes.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    width = min(shingle_words, len(words))
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(ends), HASHES_AT_ONCE):
        hashes = [xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[k:], ends[k : k + HASHES_AT_ONCE], strict=False)]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(ends)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def add_fingerprint(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint (signed long) of every row, from its whole text."""
    kind = documents.schema["doc_id"].dataType

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([fingerprint(t, shingle_words) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind.simpleString()}, fingerprint long")


# ---- dealing ----

def block_sizes(differing_bits: int, kept: int = 2) -> list[int]:
    blocks = differing_bits + kept
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)]


def dealt(prints: DataFrame, differing_bits: int, kept: int = 2) -> DataFrame:
    """way, key, turned, fingerprint: for each way to choose `kept` blocks, the bits with those blocks moved to the front.

    Bits are only permuted, so distances stay; the key is the value of the chosen blocks.
    """
    sizes = block_sizes(differing_bits, kept)
    above = [sum(sizes[:k]) for k in range(len(sizes))]
    ways: list[Column] = []
    for way, chosen in enumerate(combinations(range(len(sizes)), kept)):
        turned, at = F.lit(0).cast("long"), 0
        for k in [*chosen, *(x for x in range(len(sizes)) if x not in chosen)]:
            block = F.shiftrightunsigned("fingerprint", 64 - above[k] - sizes[k]).bitwiseAND(F.lit((1 << sizes[k]) - 1))
            turned, at = turned.bitwiseOR(F.shiftleft(block, 64 - at - sizes[k])), at + sizes[k]
        front = sum(sizes[k] for k in chosen)
        ways.append(F.struct(
            F.lit(way).alias("way"), F.lit(front).alias("front"), F.shiftrightunsigned(turned, 64 - front).alias("key"),
            turned.alias("turned")))
    return prints.select("fingerprint", F.explode(F.array(*ways)).alias("x")).select("x.way", "x.front", "x.key", "x.turned", "fingerprint")


# ---- the trie self-join ----

class _Sets:
    """Linked positions: label is the smallest position of each set."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._mark()

    def _mark(self) -> None:
        self.runs = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]
        self._mark()

    def one(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Whether all members of both nodes are in one set already."""
        runs, label = self.runs, self.label
        return (runs[alo] == runs[ahi - 1]) & (runs[blo] == runs[bhi - 1]) & (label[alo] == label[blo])


def linked_sets(values: np.ndarray, group: np.ndarray, front: np.ndarray, differing_bits: int) -> np.ndarray:
    """Set label of each value; values (uint64) are sorted by (group, value), and a group agrees on its first `front` bits.

    A trie node is a range of the array. Pairs of nodes walk down together from (root, root); a step to unequal bits
    costs one differing bit, and a pair over the budget is dropped, as is one whose members are in one set already.
    Pairs of few members are compared directly. The frontier is worked off depth first in bounded pieces.
    """
    sets = _Sets(len(values))
    if len(values) < 2:
        return sets.label
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], len(values)]
    zeros: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in zeros:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.r_[0, np.cumsum(bit == 0)]
        z = zeros[depth]
        return lo + z[hi] - z[lo]

    def compare(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> None:
        width = bhi - blo
        count = (ahi - alo) * width
        at = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        i, j = alo[at] + step // width[at], blo[at] + step % width[at]
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= differing_bits)
        sets.join(i[near], j[near])

    work = []
    for depth in np.unique(front).tolist():
        own = front[first] == depth
        lo, hi = first[own], last[own]
        work.append((depth, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8)))
    while work:
        depth, alo, ahi, blo, bhi, errors = work.pop()
        if len(alo) > PAIRS_AT_ONCE // LEAF_PAIRS:
            half = len(alo) // 2
            work += [(depth, *(x[s] for x in (alo, ahi, blo, bhi, errors))) for s in (slice(half), slice(half, None))]
            continue
        open_ = ~sets.one(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, errors = (x[open_] for x in (alo, ahi, blo, bhi, errors))
        few = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (depth >= 64)
        if few.any():
            compare(alo[few], ahi[few], blo[few], bhi[few])
            alo, ahi, blo, bhi, errors = (x[~few] for x in (alo, ahi, blo, bhi, errors))
        if not len(alo):
            continue
        am, bm, same = middle(alo, ahi, depth), middle(blo, bhi, depth), alo == blo
        children = [(alo, am, blo, bm, errors, slice(None)), (am, ahi, bm, bhi, errors, slice(None)),
                    (alo, am, bm, bhi, errors + 1, slice(None)), (am, ahi, blo, bm, errors + 1, ~same)]
        parts = [tuple(x[keep] for x in child) for *child, keep in children]
        nodes = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2]) & (nodes[4] <= differing_bits)
        alive &= ~((nodes[0] == nodes[2]) & (nodes[1] - nodes[0] == 1))
        if alive.any():
            work.append((depth + 1, *(x[alive] for x in nodes)))
    return sets.label


def near_links(prints: DataFrame, differing_bits: int = MAX_DIFFERING_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs of at most `differing_bits` differing bits.

    A linked set within a task comes as a star, so the edges never outnumber the dealt fingerprints.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], [], [], []]
        for batch in batches:
            for k, name in enumerate(("way", "front", "turned", "fingerprint")):
                columns[k].append(batch.column(name).to_numpy())
        if not columns[0]:
            return
        way, front, turned, own = (np.concatenate(c) for c in columns)
        turned = turned.view(np.uint64)
        order = np.lexsort((turned, way))
        way, front, turned, own = way[order], front[order], turned[order], own[order]
        key = turned >> (64 - front).astype(np.uint64)
        fresh = np.r_[False, (way[1:] != way[:-1]) | (key[1:] != key[:-1])]
        label = linked_sets(turned, np.cumsum(fresh), front, differing_bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], ["a", "b"])

    spread = dealt(prints.select("fingerprint").distinct(), differing_bits).repartition("way", "key").drop("key")
    return spread.mapInArrow(per_task, "a long, b long")


def near_duplicates(documents: DataFrame, differing_bits: int = MAX_DIFFERING_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows are linked if their fingerprints differ in at most `differing_bits` bits; component_id is the smallest doc_id
    that links reach. Null and empty texts have no words, hence fingerprint zero. Repeated rows come back as often as
    they are there; a null doc_id counts for no component_id, which is null where a component has no other id.
    """
    own = written(add_fingerprint(documents))
    least = own.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    roots = components(near_links(own, differing_bits)).withColumnRenamed("node", "fingerprint")
    linked = written(least.join(roots, "fingerprint"))
    reach = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(reach, "root").select("fingerprint", "component_id")
    # Written, so that the last join has plain scans on both sides and Spark may split a fingerprint that many rows share.
    answer = written(least.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least_id").alias("component_id")))
    return own.join(answer, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(documents: DataFrame, differing_bits: int = MAX_DIFFERING_BITS) -> DataFrame:
    """The row with the smallest doc_id of each component, all columns unchanged; of repeated rows one stays.

    Rows without a doc_id cannot be named by another, so they stay.
    """
    chosen = near_duplicates(documents, differing_bits).filter("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(documents.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in documents.columns])


