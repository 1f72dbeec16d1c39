"""Hard negatives against a plain scan of all rows, and Strassen's products against plain ones."""

import math

import numpy as np
import pytest
from comparing import database, difference
from pyspark.sql import functions as F

from wattledger.llm import checks, queries
from wattledger.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row int, score double"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (64, 64, 64), (65, 33, 67), (130, 64, 71), (7, 0, 4)])
def test_products_are_exact(shape):
    rng, (m, k, n) = np.random.default_rng(1), shape
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (H.strassen(a, b, leaf=2) == a @ b).all() and (H.products(a, b.T.copy()) == a @ b).all()


def test_products_beyond_63_bits_are_held():
    a, b = np.full((40, 40), 2**40), np.full((40, 40), 2**40)
    b[0] = -b[0]
    a[1] = 1
    want = [[max(-(2**63 - 1), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, c, strict=True)))) for c in b] for r in a]
    assert H.products(a, b).tolist() == want


def plain(rows, low=50, high=95):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], k) for i, v, k in rows
              if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, k in usable:
        if i % 50:
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), j, c) for j, w, c in usable if len(v) == len(w)]
        for s, j in sorted(((s, j) for s, j, c in score if c == k and j != i), key=lambda x: (-x[0], x[1]))[:5]:
            near = sorted(((t, n) for t, n, c in score if c != k and low * s <= 100 * t <= high * s), key=lambda x: (-x[0], x[1]))[:3]
            out += [(i, j, r + 1, n, s, t) for r, (t, n) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, 0.5) for r in rows], SCHEMA)
    found = H.hard_negatives(df, F.col("vec_id") % 50 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_odd_rows_ties_and_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12))
    rows = [(k, (centre[k % 4] + 0.7 * rng.normal(size=12)).tolist(), int(k * 7 % 5 % 4)) for k in range(420)]
    rows += [(1000 + k, [0.5] * 12, k % 2) for k in range(60)] + [(1050 + 1000, [0.5] * 12, 0)]  # ties
    rows += [(3000, None, 1), (3050, [1.0] * 12, None), (None, [1.0] * 12, 1), (3100, [None, *[1.0] * 11], 1), (3150, [math.nan] * 12, 2), (3200, [math.inf] * 12, 2)]
    rows += [(4000, [], 1), (4001, [], 1), (4002, [], 2), (5000, [1.0, 1.0], 1), (5001, [1.0, 0.5], 1), (5002, [0.7, 0.5], 2), (5003, [-1.0, -1.0], 3)]
    want = plain(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, block_rows=3, slot_rows=50) == want
    # Huge components: beyond int64 scores are held, here the windows of held scores are empty.
    assert mined(spark, [(0, [3e5, 2e5], 1), (1, [3e5, 1e5], 1), (2, [2e5, 1e5], 2)]) == plain([(0, [3e5, 2e5], 1), (1, [3e5, 1e5], 1), (2, [2e5, 1e5], 2)])


def test_repeated_and_missing_rows(spark):
    twice = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.75, 0.75], 2), (2, [0.75, 0.75], 2)]
    assert mined(spark, twice) == sorted([(0, 1, 1, 2, 131072, 98304), (0, 1, 2, 2, 131072, 98304)] * 2)
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_the_query_agrees_with_its_sql(spark, folder):
    found = queries.op13_hard_negatives(spark, folder)
    assert found.count() and difference(found, database(folder), checks.HARD_NEGATIVES) == ""
