"""Exact top-k inner products by a vector-approximation file.

The index holds vectors in blocks. Each block has, per dimension, a least value and a cell width, one byte per component
that names its cell, and the exact integers. For a query, the cells bound every score from above and below with one
matrix product over the bytes. Exact vectors are then read in the order of their upper bounds, until the next bound is
below the k-th score. Queries go to the tasks in blocks of a fixed size, each task returns its k best per query, and
these meet in a window per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattledger.llm.common import slices, written

SCALE, TOP = 1024, 10
BLOCK_ROWS, QUERY_ROWS, CELLS = 2048, 4096, 256
#: Exact vectors read at once for a query.
READ_AT_ONCE = 64
EXACT_FLOAT = 2.0**53


def integer_vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of a batch for each length of vector; vectors with null or non-finite components are left out."""
    column, ids = batch.column("embedding"), batch.column("vec_id")
    usable = np.flatnonzero(np.asarray(column.is_valid()) & np.asarray(ids.is_valid()))
    column, ids = column.take(pa.array(usable)), ids.take(pa.array(usable)).to_numpy(zero_copy_only=False)
    sizes = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        part = values[starts[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))
        good = np.isfinite(part).all(axis=1)
        scaled = np.clip(np.floor(part[good] * scale), -(2.0**62), 2.0**62)
        yield ids[rows[good]].astype(np.int64), scaled.astype(np.int64)


def approximation_file(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (size, ids, least, width, codes, exact), each a block of at most 2048 vectors of one length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            for ids, exact in integer_vectors(batch, scale):
                if not len(ids):
                    continue
                least = exact.min(axis=0, initial=2**62) if exact.size else np.zeros(exact.shape[1], np.int64)
                span = exact.max(axis=0, initial=-(2**62)).astype(object) - least.astype(object) + 1 if exact.size else np.zeros(exact.shape[1], object)
                width = np.array([max(1, -(-int(s) // CELLS)) for s in span], dtype=np.int64)
                codes = ((exact - least) // width).astype(np.uint8) if exact.size else exact.astype(np.uint8)
                row = [exact.shape[1], ids.tobytes(), least.tobytes(), width.tobytes(), codes.tobytes(), exact.tobytes()]
                kinds = [pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["size", "ids", "least", "width", "codes", "exact"])

    return vectors.select("vec_id", "embedding").mapInArrow(build, "size long, ids binary, least binary, width binary, codes binary, exact binary")


class Best:
    """The k best (score, id) so far of each query: higher scores first, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.found = k, [([], [])] * queries
        self.bar = np.full(queries, -np.inf)

    def add(self, q: int, scores: list[int], ids: list[int]) -> None:
        merged = sorted(zip([*self.found[q][0], *scores], [*self.found[q][1], *ids], strict=True), key=lambda x: (-x[0], x[1]))[: self.k]
        self.found[q] = tuple(map(list, zip(*merged, strict=True))) if merged else ([], [])
        if len(merged) == self.k:
            self.bar[q] = merged[-1][0]


def search_block(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, width: np.ndarray, codes: np.ndarray, exact: np.ndarray) -> int:
    """Takes one block into `best`; returns how many exact vectors were read."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, least, exact)]
    if largest[0] * (max(largest[1:]) + 1) * 4 * max(1, exact.shape[1]) >= EXACT_FLOAT:
        # Bounds in floating point would not be safe: every vector is read, in integers of any size.
        for q in range(len(queries)):
            others = ids != query_ids[q]
            scores = exact[others].astype(object) @ queries[q].astype(object) if exact.shape[1] else np.zeros(int(others.sum()), object)
            best.add(q, [max(-(2**63), min(2**63 - 1, int(s))) for s in scores], ids[others].tolist())
        return len(ids) * len(queries)
    wide = queries.astype(np.float64)
    lower = codes.astype(np.float64) @ (wide * width).T + wide @ least
    slack = wide * (width - 1)
    upper = (lower + np.where(slack > 0, slack, 0).sum(axis=1)).T
    lower = (lower + np.where(slack < 0, slack, 0).sum(axis=1)).T
    own = ids[None, :] == query_ids[:, None]
    upper[own] = lower[own] = -np.inf
    bar = best.bar
    if len(ids) >= best.k:
        bar = np.maximum(bar, np.partition(lower, len(ids) - best.k, axis=1)[:, len(ids) - best.k])
    read = 0
    for q in np.flatnonzero((upper >= bar[:, None]).any(axis=1) & (upper > -np.inf).any(axis=1)):
        chosen = np.flatnonzero((upper[q] >= bar[q]) & (upper[q] > -np.inf))
        chosen = chosen[np.argsort(-upper[q][chosen], kind="stable")]
        for k in range(0, len(chosen), READ_AT_ONCE):
            some = chosen[k : k + READ_AT_ONCE]
            if upper[q][some[0]] < best.bar[q]:
                break
            best.add(q, (exact[some] @ queries[q]).tolist(), ids[some].tolist())
            read += len(some)
    return read


def top_products(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) for each row of `queries`.

    Both tables have vec_id and embedding. Candidates are all rows of `vectors` with a vector of the query's length, but
    for those with the query's own vec_id. Null vectors and ids and vectors with null or non-finite components take no
    part; components are held within 62 bits and scores within 63. A query id that is repeated gets its ranks for
    each different vector of its rows. Fewer candidates than k give all of them.
    """
    index = written(approximation_file(vectors, scale))
    asked = written(queries.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding").distinct())
    blocks = max(1, -(-asked.count() // query_rows))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).toArrow()
        groups = [g for batch in rows.combine_chunks().to_batches() for g in integer_vectors(batch, scale) if len(g[0])]
        sent = index.sparkSession.sparkContext.broadcast((b, {g[1].shape[1]: g for g in _merged(groups)}))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            number, by_size = sent.value
            found = {size: Best(len(ids), k) for size, (ids, _) in by_size.items()}
            for batch in batches:
                for row in batch.to_pylist():
                    if (size := row["size"]) not in by_size:
                        continue
                    ids, least, width = (np.frombuffer(row[c], np.int64) for c in ("ids", "least", "width"))
                    codes, exact = np.frombuffer(row["codes"], np.uint8).reshape(-1, size) if size else np.zeros((len(ids), 0), np.uint8), np.frombuffer(row["exact"], np.int64)
                    search_block(found[size], *by_size[size], ids, least, width, codes, exact.reshape(len(ids), size))
            for size, best in found.items():
                for q, (scores, ids) in enumerate(best.found):
                    if ids:
                        n = len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f"{number}:{size}:{q}"] * n), pa.array([int(by_size[size][0][q])] * n), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                            ["query", "query_id", "vec_id", "score"])

        parts.append(index.mapInArrow(search, "query string, query_id long, vec_id long, score long"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _merged(groups: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of the same vector length put together."""
    sizes = sorted({g[1].shape[1] for g in groups})
    return [tuple(np.concatenate([g[k] for g in groups if g[1].shape[1] == size]) for k in (0, 1)) for size in sizes]
