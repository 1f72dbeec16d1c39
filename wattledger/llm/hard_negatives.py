"""Hard negatives: for each anchor its best rows of the same label, and rows of other labels that come close to these.

Scores are inner products of integer vectors. Anchors are dealt in blocks and all rows in slots, both of bounded size, and
each block meets each slot once in one plan of two rounds. In a task, tiles of anchors and candidates are multiplied by
Strassen's recursion in int64: a ring modulo 2**64, so the sums and differences on the way may wrap and the product is
exact wherever it fits. Tiles that might not fit are multiplied in integers of any size.

The first round keeps per anchor and slot the best rows of its label; these heaps merge in a window. The positives then
bound a range of scores each, and the second round keeps per range and slot the best rows of other labels; these merge
likewise. Heaps hold at most the wanted number of rows, so what is shuffled does not depend on labels or ties.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.llm.common import written

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative scores between these hundredths of its positive's score.
LOW, HIGH = 50, 95
#: Anchors that meet a slot at once, rows of a slot (both in the mean), and sides of the tiles that are multiplied.
BLOCK_ROWS, SLOT_ROWS, TILE = 4096, 4096, 1024
#: Shorter sides are multiplied directly.
LEAF = 32
LARGEST = 2**63 - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven half-size products a level, sides padded with zeros to even numbers."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b if a.dtype == object else np.einsum("ik,kj->ij", a, b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    (a11, a12), (a21, a22) = np.split(a[:i], [j], axis=1), np.split(a[i:], [j], axis=1)
    (b11, b12), (b21, b22) = np.split(b[:j], [l], axis=1), np.split(b[j:], [l], axis=1)
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6, p7 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b; int64 where no sum can leave it, else integers held within 63 bits."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = a.shape[1] * max(map(abs, (int(a.min()), int(a.max())))) * max(map(abs, (int(b.min()), int(b.max()))))
    if bound <= LARGEST:
        return strassen(a, np.ascontiguousarray(b.T))
    wide = strassen(a.astype(object), b.T.astype(object))
    return np.clip(wide, -LARGEST, LARGEST).astype(np.int64)


def best_of_each(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n entries of each group: higher scores first, then smaller ids."""
    order = np.lexsort((vec_id, -score, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    turn = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[turn < n]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def positives_of(anchors: pa.Table, rows: pa.Table, n: int = POSITIVES) -> list[np.ndarray]:
    """anchor (position), vec_id, score of the best rows with an anchor's label and another id."""
    a, b = _matrix(anchors.column("vector"), len(anchors)), _matrix(rows.column("vector"), len(rows))
    label, other, own, ids = (_numbers(t, c) for t, c in ((anchors, "label"), (rows, "label"), (anchors, "vec_id"), (rows, "vec_id")))
    found = [np.zeros((3, 0), np.int64)]
    for value in np.unique(label):
        ours, theirs = np.flatnonzero(label == value), np.flatnonzero(other == value)
        for i in range(0, len(ours), TILE):
            heap = np.zeros((3, 0), np.int64)
            for j in range(0, len(theirs), TILE):
                x, y = ours[i : i + TILE], theirs[j : j + TILE]
                score = products(a[x], b[y])
                mine = own[x][:, None] == ids[y][None, :]
                if len(y) > 2 * n:
                    # A row below the n-th best of the others in this tile is not among the n best.
                    bar = np.partition(np.where(mine, -LARGEST, score), len(y) - n, axis=1)[:, len(y) - n]
                    mine |= score < bar[:, None]
                p, q = np.nonzero(~mine)
                heap = np.concatenate([heap, [x[p], ids[y][q], score[p, q]]], axis=1)
                heap = heap[:, best_of_each(heap[0], heap[2], heap[1], n)]
            found.append(heap)
    return list(np.concatenate(found, axis=1))


def negatives_of(anchors: pa.Table, rows: pa.Table, n: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> list[np.ndarray]:
    """anchor (position), place of the positive, vec_id, score of the best rows of other labels within each positive's range."""
    a, b = _matrix(anchors.column("vector"), len(anchors)), _matrix(rows.column("vector"), len(rows))
    label, other, ids = _numbers(anchors, "label"), _numbers(rows, "label"), _numbers(rows, "vec_id")
    lists = anchors.column("positive_scores").combine_chunks()
    sizes, scores = np.asarray(lists.value_lengths()), lists.flatten().to_numpy(zero_copy_only=False)
    which = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Integers of any size: hundredths of a large score leave int64.
    ends = [(-(-int(s) * low // 100), int(s) * high // 100) for s in scores]
    least, most = (np.array([e[k] for e in ends], dtype=np.int64) for k in (0, 1))
    found = [np.zeros((3, 0), np.int64)]
    for i in range(0, len(a), TILE):
        windows = np.flatnonzero((which >= i) & (which < i + TILE))
        heap = np.zeros((3, 0), np.int64)
        for j in range(0, len(b), TILE):
            score = products(a[i : i + TILE], b[j : j + TILE])
            differs = label[i : i + TILE, None] != other[None, j : j + TILE]
            for turn in range(int(sizes[i : i + TILE].max(initial=0))):
                w = windows[place[windows] == turn]
                some, rows_of = score[which[w] - i], differs[which[w] - i]
                p, q = np.nonzero(rows_of & (some >= least[w][:, None]) & (some <= most[w][:, None]))
                chosen = best_of_each(p, some[p, q], ids[j + q], n)
                heap = np.concatenate([heap, [w[p[chosen]], ids[j + q[chosen]], some[p[chosen], q[chosen]]]], axis=1)
            heap = heap[:, best_of_each(heap[0], heap[2], heap[1], n)]
        found.append(heap)
    window, vec_id, score = np.concatenate(found, axis=1)
    return [which[window], place[window], vec_id, score]


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, size, vector of the rows that take part, components held within 62 bits."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62))))
    return vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"),
        F.transform("embedding", held).alias("vector"))


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, slots: int, find: Callable, names: list[str], schema: str) -> DataFrame:
    """`find` over each block of anchors with each slot of rows of their length; its first column is replaced by the anchor's row number."""
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    renewed = anchors.select([F.col(c).alias(c) for c in anchors.columns])  # columns of its own, though it comes from `rows`
    left = renewed.withColumns({"block": part(blocks), "slot": every(slots)})
    right = rows.withColumns({"slot": part(slots), "block": every(blocks)})

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        columns = find(ours, theirs) if len(ours) and len(theirs) else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(_numbers(ours, "row")[columns[0]] if len(ours) else columns[0], pa.int64()), *columns[1:]], names)

    key = ["size", "block", "slot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)


def _first(df: DataFrame, n: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
    high: int = HIGH, block_rows: int = BLOCK_ROWS, slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, embedding and label; `is_anchor` is a condition on vec_id. An anchor's positives are its
    `positives` best rows of the same label; each has the `negatives` best rows of other labels with low * positive <=
    100 * negative <= high * positive. Higher scores come first, ties by smaller vec_id. Rows with a null id, label or vector,
    or with a null or non-finite component take no part, and vectors meet only those of their length. Components are held
    within 62 bits and scores within 63. Rows with the anchor's own vec_id are never its positives; a repeated row counts as
    often as it appears, as anchor too. Positives without a negative give no row; an empty table gives none.
    """
    rows = written(integer_rows(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.filter(is_anchor)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    blocks, slots = max(1, -(-sizes["a"] // block_rows)), max(1, -(-sizes["n"] // slot_rows))
    found = _met(anchors, rows, blocks, slots, lambda x, y: positives_of(x, y, positives), ["row", "vec_id", "score"], "row long, vec_id long, score long")
    best = written(_first(found, positives, "row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")))
    ranged = anchors.join(best.select("row", F.col("best.score").alias("positive_scores")), "row")
    close = _met(
        ranged, rows, blocks, slots, lambda x, y: negatives_of(x, y, negatives, low, high), ["row", "place", "vec_id", "score"],
        "row long, place long, vec_id long, score long")
    chosen = _first(close, negatives, "row", "place").join(best, "row").join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    positive = F.get("best", F.col("place").cast("int"))
    return chosen.select(
        "anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The table with labels moved on by one where vec_id is divisible by 7, so that some rows are close to another label's."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", moved.alias("label"))
