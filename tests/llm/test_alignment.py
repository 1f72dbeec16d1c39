"""Token alignment against a plain walk over byte offsets with the tokenizers asked directly."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest

from wattledger.llm import alignment as A
from wattledger.llm import queries
from wattledger.llm.common import table
from wattledger.llm.queries import tokenizer_file

BYTE, PIECE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    with open(BYTE, encoding="utf-8") as file:
        spelling = {i: w for w, i in json.load(file)["model"]["vocab"].items()}
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def tokens(text):
        if not text:
            return [], []
        first = [(i, bytes(byte[c] for c in spelling[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        second = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (first, second) if b"".join(x for _, x in first) == whole == b"".join(x for _, x in second) else ([], [])

    return tokens


def plain(rows):
    tokens, facts = plain_tokens(), []
    counts = collections.Counter()
    for i, text in rows:
        a, b = tokens(text)
        ends_a, ends_b = ({int(e): k for e, k in zip(np.cumsum([len(x) for _, x in t]), range(len(t)), strict=True)} for t in (a, b))
        shared = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[e]][0], b[ends_b[e]][0]) for e in shared]
        counts.update(links)
        groups, x, y = [], 0, 0
        for e in shared:
            groups.append(",".join(str(k) for k, _ in a[x : ends_a[e] + 1]) + "|" + ",".join(str(k) for k, _ in b[y : ends_b[e] + 1]))
            x, y = ends_a[e] + 1, ends_b[e] + 1
        facts.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = collections.defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(map(str, ((i, n_a, n_b, len(links), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), sha)
                  for i, n_a, n_b, links, sha in facts)))


def rows_of(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(8)
    letters = "abc de\n\t  'sß漢🙂.,3"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a ▁ b"), (104, "<|endoftext|> <s> </s> <0x41>"), (105, "\x00\x01 é  x")]
    rows += [(106, "word " * 20000), (107, "a" * 30000), (108, "same text here"), (108, "same text here"), (None, "same text here"), (109, "\U0010ffff ")]
    return rows


def test_odd_texts_both_ways_of_scoring(corpus, odd_rows):
    want = plain(odd_rows)
    assert rows_of(A.alignment_report(corpus(odd_rows).repartition(3), BYTE, PIECE)) == want
    assert rows_of(A.alignment_report(corpus(odd_rows), BYTE, PIECE, broadcast_pairs=0)) == want
    assert A.alignment_report(corpus([]), BYTE, PIECE).columns == COLUMNS and A.alignment_report(corpus([]), BYTE, PIECE).count() == 0
    assert rows_of(A.alignment_report(corpus([(1, None)]), BYTE, PIECE)) == plain([(1, None)])


def test_the_query(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text").collect()
    assert rows_of(queries.op12_token_alignment(spark, folder)) == plain([(r.doc_id, r.text) for r in documents])


def test_intervals_against_a_plain_scan():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ends = [np.unique(np.r_[rng.integers(1, 40, 12), 40]) for _ in "ab"]
        starts = [np.r_[0, e[:-1]] for e in ends]
        group_a, group_b = A.coalesced(starts[0], ends[0], starts[1], ends[1])
        cuts = np.intersect1d(*ends)
        assert (group_a == np.searchsorted(cuts, ends[0])).all() and (group_b == np.searchsorted(cuts, ends[1])).all()
        pairs = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        p, q = A.overlaps(starts[0], ends[0], starts[1], ends[1])
        assert set(zip(p.tolist(), q.tolist(), strict=True)) == pairs and len(p) == len(pairs)
    # Intervals with gaps: a gap is a break too.
    assert [g.tolist() for g in A.coalesced(np.array([0, 5]), np.array([3, 9]), np.array([1, 7]), np.array([2, 8]))] == [[0, 1], [0, 1]]


def test_the_fast_way_gives_the_same_ids():
    words = A.ByteLevel(BYTE)
    assert words.fast is not None
    texts = [f"a{chr(c)}1{chr(c)}  {chr(c)}{chr(c)} .{chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    assert words.encode(texts) == words._slowly(texts)
    runs = ["a" + " " * 1_500_000 + "b", "a" * 1_500_000, "\n" * 150_000, "1" * 500_000, "." * 500_000]
    assert words.encode(runs) == words._slowly(runs)
