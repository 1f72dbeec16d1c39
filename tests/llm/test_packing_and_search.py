"""Packing as an exact round trip; searches against all products."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wattledger.llm import checks
from wattledger.llm import packing as P
from wattledger.llm import vector_search as V
from wattledger.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")


ODD = ["a", "B", "é", "É", "'s", "'", "1", "!!", "###", " ", "\n", "ß", "ÿ", "́", "Σ", "_", "ñ", "\xa0", "İ", "×", "\t", "<|", "’s", "'LL", "k", "^", "<|endoftext|>", "日本", "\x1c"]


def test_words_give_the_tokenizers_ids(reference_ids, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "straße İ ΑΣ Σ", "K Å À× Þ, ẞ", *("".join(rng.choice(ODD) for _ in range(rng.randint(1, 30))) for _ in range(1500))]
    texts += ["".join(rng.choice("aàzß'ñ,") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    want = [reference_ids(t)[:-1].tobytes() for t in texts]
    assert P.word_tokenizer(tokenizer_file()).merge is not None
    assert [bytes(x) for x in P.encoded(pa.array(texts), tokenizer_file())] == want
    assert [bytes(x) for x in P.encoded(pa.array([None, None], pa.string()), tokenizer_file())] == [b"", b""]
    monkeypatch.setattr(P, "WORDS_KEPT", 50)
    monkeypatch.setattr(P, "BYTES_AT_ONCE", 400)
    monkeypatch.setattr(P, "_LOADED", {})
    assert [bytes(x) for x in P.encoded(pa.array(texts), tokenizer_file())] == want
    P.word_tokenizer(tokenizer_file()).merge = None  # as where the probes differ
    assert [bytes(x) for x in P.encoded(pa.array(texts), tokenizer_file())] == want


def test_all_words_of_the_documents(spark, folder, reference_ids):
    texts = [r.text for r in spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet").collect()]
    for text, found in zip(texts, P.encoded(pa.array(texts), tokenizer_file()), strict=True):
        assert bytes(found) == reference_ids(text)[:-1].tobytes()


def test_checksum_of_a_tail():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (rng.integers(0, 256, rng.integers(0, n), dtype=np.uint8).tobytes() for n in (300, 6000))
        assert P.crc_of_tail(np.array([zlib.crc32(a)]), np.array([zlib.crc32(a + b)]), np.array([len(b)]))[0] == zlib.crc32(b)


def test_least_squares_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.normal(size=12)
        x = P.non_negative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-5).all() and np.abs(slope[x > 1e-7]).max(initial=0) < 1e-5


def test_plan_uses_no_rank_twice_and_fills_windows():
    rng = np.random.default_rng(2)
    histogram = {k: int(n) for k, n in enumerate(rng.exponential(300, 65)) if k}
    slots, sequences = P.plan_of(histogram, 64)
    fill, used = np.zeros(sequences, dtype=int), {}
    for units, low, high, first, _ in slots:
        fill[first : first + high - low] += units
        used.setdefault(units, []).append((low, high))
    assert (fill == 64).all() and sequences > 0
    for units, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= histogram[units]
    assert sum(h - lo for _, lo, h, _, _ in slots) > 0.5 * sum(histogram.values())
    assert P.plan_of({}, 64) == ([], 0) and P.plan_of({5: 3}, 64) == ([], 0)


def check_pieces(out, rows, ids_of):
    """Each id of each row in exactly one piece, sequences gapless and not too long; returns the share of padding."""
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(ids_of(t))
    for piece in sorted(out, key=lambda r: (str(r.doc_id), r.start)):
        fitting = [a for a in left[piece.doc_id] if len(a) == piece.doc_tokens and zlib.crc32(a[piece.start : piece.start + piece.length].tobytes()) == piece.ids_crc32]
        assert fitting and piece.length > 0
    for i, own in left.items():
        spans = sorted((r.start, r.length) for r in out if r.doc_id == i)
        want = sorted(x for a in own for x in [len(a)])
        assert sum(n for _, n in spans) == sum(want) and sum(s == 0 for s, _ in spans) == len(own)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding / (padding + total)


def test_pack_odd_rows(corpus, reference_ids):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id"), (4, " ".join(word() for _ in range(9000)))]
    rows += [(k, " ".join(word() for _ in range(rng.choice([3, 40, 700, 1100])))) for k in range(10, 90)] + [(100 + k, "equal length here now") for k in range(500)]
    assert check_pieces(P.pack(corpus(rows).repartition(3), tokenizer_file()).collect(), rows, reference_ids) < 0.05
    assert P.pack(corpus([]), tokenizer_file()).count() == 0
    assert [r.length for r in P.pack(corpus([(1, None)]), tokenizer_file()).collect()] == [1]


def plain_search(rows, k=10):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, score int")


def searched(df, **options):
    out = V.top_products(df, df.filter("vec_id % 100 = 0"), **options).collect()
    assert len(out) == len({(r.query_id, r.rank, r.vec_id) for r in out})
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in out}


def test_search_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8) * 0.4]) for k in range(350)] + [(1000 + k, [0.5] * 8) for k in range(30)] + [(2000, [0.5] * 8)]
    rows += [(3000, None), (3001, [None] * 8), (3100, [float("nan")] * 8), (3101, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (4000, []), (4001, []), (4100, [1.0, 2.0]), (4102, [1.0, 3.0]), (4200, [5.0] * 3)]
    df = table_of(spark, rows)
    want = plain_search([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert searched(df) == want and searched(df, query_rows=1) == want
    assert searched(df.limit(0)) == set()


def test_search_far_beyond_the_float_range(spark):
    rows = [(k, [float(np.float32((-1) ** k * 3e5 * (k + 1))), 1e6]) for k in range(12)] + [(100, [7e5, -9e5])]
    assert searched(table_of(spark, rows)) == plain_search([(i, [np.float32(x) for x in v]) for i, v in rows])


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 32))
    exact = np.floor(1024 * (centres[rng.integers(0, 20, 2000)] + 0.1 * rng.normal(size=(2000, 32)))).astype(np.int64)
    least = exact.min(axis=0)
    width = np.maximum(1, -(-(exact.max(axis=0) - least + 1) // 256))
    best = V.Best(20, 10)
    read = V.search_block(best, np.arange(20), exact[:20], np.arange(2000), least, width, ((exact - least) // width).astype(np.uint8), exact)
    assert read < 0.2 * 20 * 2000
    for q in range(20):
        scores = sorted(((int(s), i) for i, s in enumerate(exact @ exact[q]) if i != q), key=lambda x: (-x[0], x[1]))[:10]
        assert list(zip(*best.found[q], strict=True)) == scores


def test_search_sql_agrees(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(checks.TOP_PRODUCTS).fetchall()
    assert searched(spark.read.parquet(f"{folder}/embeddings.parquet")) == set(want)
