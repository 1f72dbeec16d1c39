"""Fingerprints bit by bit, the trie join and whole components against brute force."""

import random

import numpy as np
import xxhash

from wattledger.llm import simhash as S
from wattledger.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    """Label of each print: the smallest position that links reach."""
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    while True:
        least = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def test_fingerprint_bits():
    for text in [None, "", " \n", "One", "a b c", "A b\tC\x0bd e é É f", "x\xa0y z 1 2 3", "rep " * 50, "Ünï " * 9 + "ẞ"]:
        assert S.fingerprint(text) == plain_fingerprint(text)


def near_prints(seed, n, spread):
    out, rng = set(), random.Random(seed)
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, spread)):
            value = base
            for _ in range(rng.randint(0, 6)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return np.array(sorted(out), dtype=np.uint64)


def test_trie_join():
    for seed in range(12):
        values = near_prints(seed, 12, 60)
        zero = np.zeros(len(values), dtype=np.int64)
        assert (S.linked_sets(values, zero, zero, 4) == plain_components(values)).all()
    assert S.linked_sets(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 4).tolist() == []


def test_links_lose_no_component(spark):
    values = near_prints(99, 60, 30)
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    roots = {r.node: r.root for r in components(S.near_links(prints)).collect()}
    groups = {}
    for v, k in zip(values.view(np.int64).tolist(), plain_components(values).tolist(), strict=True):
        groups.setdefault(k, set()).add(v)
    found = {}
    for node, root in roots.items():
        found.setdefault(root, set()).add(node)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in found.values()}


def test_dealing_keeps_distances(spark):
    values = near_prints(3, 4, 8).view(np.int64).tolist()
    rows = S.dealt(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 4).collect()
    by_way = {}
    for r in rows:
        by_way.setdefault(r.way, {})[r.fingerprint] = (r.turned, r.key)
    assert len(by_way) == 15
    mask = (1 << 64) - 1
    for way in by_way.values():
        for a in values:
            for b in values:
                assert bin((way[a][0] ^ way[b][0]) & mask).count("1") == bin((a ^ b) & mask).count("1")
    for a in values:
        for b in values:
            if bin((a ^ b) & mask).count("1") <= 4:
                assert any(way[a][1] == way[b][1] for way in by_way.values())


def test_components_of_chains_stars_and_nothing(spark):
    def roots(pairs):
        return {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}

    chain = [(k + 1, k) if k % 2 else (k, k + 1) for k in range(200)]
    assert set(roots(chain).values()) == {0} and len(roots(chain)) == 201
    star = [(500, k) for k in range(300)] + [(7, 7), (None, 4), (500, 3), (3, 500)]
    assert set(roots(star).values()) == {0}
    assert roots([(-5, 4), (10, 11), (11, 12)]) == {-5: -5, 4: -5, 10: 10, 11: 10, 12: 10}
    assert roots([]) == {}


def test_documents(corpus):
    body = " ".join(f"w{k}" for k in range(300))
    rows = [(10, body), (7, body), (7, body), (12, body + " tail"), (3, "quite another text " * 9), (5, None), (4, ""), (None, "  "), (8, "x " * 50_000), (None, "lonely words are here")]
    out = S.near_duplicates(corpus(rows)).collect()
    assert len(out) == len(rows)
    expected = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    label, least = plain_components(expected), {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min([x for x in (least.get(k), i) if x is not None], default=None)
    want = sorted((str(i), f"{int(f):016x}", str(least[k])) for (i, _), f, k in zip(rows, expected, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want
    kept = S.keep_one_of_each(corpus(rows))
    assert kept.columns == corpus([]).columns
    got = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert got == sorted({c for c in least.values() if c is not None})
    assert S.near_duplicates(corpus([])).count() == 0
