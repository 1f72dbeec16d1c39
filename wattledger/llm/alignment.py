"""Token alignment of two tokenizers by interval coalescing.

Both tokenizers cut the same bytes, so their tokens are two sets of intervals. All tokens of a slice of documents are
sorted by start at once; with the running maximum of their ends, a new group begins where a start reaches it, and
within groups the overlapping pairs are expanded. Pairs that end together are links.

Each document keeps its different linked id pairs and how often it has them. Their totals over the corpus are one
aggregate. Pairs seen more than once go back to the documents in a broadcast of bounded size (an unlisted pair was seen
once); beyond the bound, documents and totals meet in a join on the pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattledger.llm.common import slices, written

#: Characters aligned at once (a longer text alone), and pairs that are broadcast at most (16 bytes each).
CHARACTERS_AT_ONCE, BROADCAST_PAIRS = 1 << 20, 4_000_000
#: How the byte-level vocabulary splits text before merging; a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White-space characters in a row from which the slower library splits a text.
LONG_RUN = 100_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


# ---- the two tokenizers ----

def letters_of_bytes() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids of space + text by a byte-level BPE vocabulary file; special tokens' strings are plain text.

    Where ids follow the order of merges, a faster library gives the same ids; it is asked unless it differs on a
    probe, but for texts with runs of white space too long for its pattern's backtracking.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocabulary = letters_of_bytes(), model["vocab"]
        self.pieces = _by_id({i: bytes(letters[c] for c in w) for w, i in vocabulary.items()})
        merged = [vocabulary["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in model["merges"]]
        if merged == list(range(256, 256 + len(merged))):
            import tiktoken

            ranks = {p: i for i, p in enumerate(self.pieces)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            probe = " It's déjà-vu,  3.14 times\n\n\t42　ok <|endoftext|> ’tis \U0001f600"
            self.fast = self.fast if self.fast.encode_ordinary(probe) == self._slowly([probe])[0] else None

    def _slowly(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._slowly(texts)
        return [self._slowly([t])[0] if len(t) > LONG_RUN and _RUN.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """Ids of a text by a sentence-piece model, which puts the space before it itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _by_id(pieces: dict[int, bytes]) -> list[bytes]:
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


@dataclass
class Table:
    """Token bytes of a vocabulary, one after the other, and where each token's begin."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Table:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        return cls(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


# ---- intervals ----

def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B interval, counted from 0: a new one begins where a start reaches all ends before it."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.r_[False, start[order][1:] >= reach[:-1]]
    group = np.empty(len(start), dtype=np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(start_a)], group[len(start_a) :]


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in A, position in B) of intervals that share a byte; each side is in order and without gaps."""
    first, last = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    n = np.maximum(last - first, 0)
    before = np.cumsum(n) - n
    return np.repeat(np.arange(len(start_a)), n), np.repeat(first - before, n) + np.arange(int(n.sum()))


class Aligner:
    """Aligns slices of texts; the two vocabularies are read once per worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.table_a, self.table_b = Table.of(self.a.pieces), Table.of(self.b.pieces)
        self.digits = [f"{i}{s}" for i in range(len(self.a.pieces)) for s in ",|"] + [f"{i}{s}" for i in range(len(self.b.pieces)) for s in ",;"]
        self.width = len(self.a.pieces) * len(self.b.pieces)

    def align(self, texts: list[str | None]) -> tuple:
        """Per text: n_a, n_b, n_groups, n_links, digest of the groups, linked pairs (a * |B| + b) and how often it has them."""
        some = [k for k, t in enumerate(texts) if t]
        encoded = zip(some, self.a.encode([" " + texts[k] for k in some]), self.b.encode([texts[k] for k in some]) if some else [], strict=True)
        kept = []
        for k, x, y in encoded:
            x, y, raw = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64), np.frombuffer((" " + texts[k]).encode(), dtype=np.uint8)
            if all(int(t.sizes[i].sum()) == len(raw) and np.array_equal(t.spelt(i), raw) for t, i in ((self.table_a, x), (self.table_b, y))):
                kept.append((k, x, y))
        sums = np.zeros((4, len(texts)), dtype=np.int64)
        digests, links, times = [""] * len(texts), [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        if not kept:
            return *sums, digests, links, times
        at, ids_a, ids_b = (list(x) for x in zip(*kept, strict=True))
        sums[0, at], sums[1, at] = [len(x) for x in ids_a], [len(y) for y in ids_b]
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        owner = np.repeat(np.arange(len(at)), sums[0, at])
        # The bytes of all texts lie one after the other, so no group or overlap reaches over two texts.
        end_a, end_b = np.cumsum(self.table_a.sizes[a]), np.cumsum(self.table_b.sizes[b])
        start_a, start_b = end_a - self.table_a.sizes[a], end_b - self.table_b.sizes[b]
        group_a, group_b = coalesced(start_a, end_a, start_b, end_b)
        p, q = overlaps(start_a, end_a, start_b, end_b)
        linked = end_a[p] == end_b[q]
        p, q = p[linked], q[linked]
        sums[2, at] = np.bincount(owner[np.r_[True, group_a[1:] != group_a[:-1]]], minlength=len(at))
        sums[3, at] = np.bincount(owner[p], minlength=len(at))
        for k, digest in zip(at, self._digests(a, b, group_a, group_b, (sums[0, at] + sums[1, at]).tolist()), strict=True):
            digests[k] = digest
        keys, often = np.unique(owner[p] * self.width + a[p] * len(self.b.pieces) + b[q], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, len(at)) * self.width)
        for k, some_keys, some_times in zip(at, np.split(keys % self.width, cuts), np.split(often, cuts), strict=True):
            links[k], times[k] = some_keys, some_times
        return *sums, digests, links, times

    def _digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: list[int]) -> Iterator[str]:
        """SHA-256 of each text's groups, written a1,a2|b1;a3|b2,b3."""
        # Groups follow each other, each with its A tokens before its B tokens; the last of either has its own separator.
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[place_a] = 2 * a + np.r_[group_a[1:] != group_a[:-1], True]
        code[place_b] = 2 * (len(self.a.pieces) + b) + np.r_[group_b[1:] != group_b[:-1], True]
        code, start = code.tolist(), 0
        for size in sizes:
            spelt = "".join(map(self.digits.__getitem__, code[start : start + size]))
            yield hashlib.sha256(spelt[:-1].encode()).hexdigest()
            start += size


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


# ---- the corpus ----

def bounded(texts: list[str | None], characters: int = CHARACTERS_AT_ONCE) -> Iterator[slice]:
    """Slices of a list of texts with at most `characters` characters, or one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text or "") > characters:
            yield slice(start, k)
            start, size = k, 0
        size += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document: doc_id, the four counts, groups_sha256, its linked pairs and how often it has each."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for part in bounded(texts):
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                *sums, digests, pairs, times = work.align(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, sums), pa.array(digests, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names)

    return documents.select("doc_id", "text").mapInArrow(
        per_batch, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_totals(rows: DataFrame, width_b: int) -> DataFrame:
    """pair, n (its links in the corpus) and best (whether no pair of its B id has more)."""
    links = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    totals = links.groupBy("pair").agg(F.sum("times").alias("n"))
    per_b = Window.partitionBy(F.col("pair") % width_b)
    return totals.withColumn("best", F.col("n") == F.max("n").over(per_b))


def _scored_by_broadcast(rows: DataFrame, frequent: pa.Table, best_of_b: pa.Table, width_b: int) -> DataFrame:
    order = np.argsort(frequent.column("pair").to_numpy())
    listed = [frequent.column(c).to_numpy()[order] for c in ("pair", "n")]
    most = np.zeros(width_b, dtype=np.int64)
    most[best_of_b.column("b").to_numpy()] = best_of_b.column("n").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast((*listed, most))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pairs", "times"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, most = sent.value
        for batch in batches:
            column = batch.column("pairs")
            pair, times = column.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(column.value_lengths()))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            count = np.where(known[at] == pair, n[at], 1) if len(known) else np.ones(len(pair), np.int64)
            best = np.where(count == most[pair % width_b], times, 0)
            # Integers below 2**53 add up exactly in the weights' floating point.
            total = [np.bincount(owner, weights=w, minlength=batch.num_rows).astype(np.int64) for w in (best, times * count)]
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, total)], [*kept.schema.names, "n_best", "count_sum"])

    return rows.mapInArrow(per_batch, f"{schema}, n_best long, count_sum long")


def _scored_by_join(rows: DataFrame, totals: DataFrame) -> DataFrame:
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(totals, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").withColumns(
        {"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def alignment_report(documents: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Texts that are null or empty, and those whose tokens of either vocabulary do not spell them (a vocabulary may
    normalize), have no tokens: zeros and an empty digest. Every row counts by itself, repeated rows and null ids too; an empty table
    gives no rows. `path_a` is a byte-level vocabulary, `path_b` a sentence-piece model, both present on every machine.
    """
    rows = written(aligned(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    width_b = len(Pieces(path_b).pieces)
    totals = written(pair_totals(rows, width_b))
    if totals.filter("n > 1").count() <= broadcast_pairs:
        best_of_b = totals.filter("best").groupBy((F.col("pair") % width_b).alias("b")).agg(F.max("n").alias("n"))
        scored = _scored_by_broadcast(rows, totals.filter("n > 1").select("pair", "n").toArrow(), best_of_b.toArrow(), width_b)
    else:
        scored = _scored_by_join(rows, totals)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
