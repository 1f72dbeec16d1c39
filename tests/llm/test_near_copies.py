"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest

from wattledger.llm import near_copies as N


def plain_kept(rows):
    sets = []
    for _, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, i), i)
    return sorted(least.values())


def plain_pairs(texts):
    """Pairs of texts with a similarity of 0.8 or more, by numbers of shingles in a matrix of texts."""
    number, rows = {}, []
    for t in texts:
        words = t.split()
        rows.append([number.setdefault(tuple(words[k : k + 5]), len(number)) for k in range(len(words) - 4)])
    has = np.zeros((len(rows), len(number)), dtype=np.float32)
    for k, row in enumerate(rows):
        has[k, row] = 1
    both, size = has @ has.T, has.sum(axis=1)
    return {(int(a), int(b)) for a, b in np.argwhere(both >= 0.8 * (size[:, None] + size[None, :] - both)) if a < b}


@pytest.mark.parametrize(("groups", "size", "changed"), [(4, 300, (3, 5)), (2, 600, (3, 3)), (1, 1500, (1, 1))])
def test_large_groups_near_the_threshold_lose_no_link(corpus, groups, size, changed):
    rng, texts = random.Random(groups * size + changed[0]), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(200)]
        for _ in range(size):
            words = list(base)
            for k in rng.sample(range(200), rng.randint(*changed)):
                words[k] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    pairs = plain_pairs(texts)
    documents = corpus(list(enumerate(texts)))
    own = N.written(N.add_keys(documents))
    root = {r.node: r.root for r in N.near_components(documents, own).collect()}
    of = [root.get(N.node_of(N.text_words(t)), -k - 1) for k, t in enumerate(texts)]
    found = sum(of[a] == of[b] for a, b in pairs)
    assert len(pairs) > 300 and found >= 0.995 * len(pairs)
    if size != 600:
        return
    label = list(range(len(texts)))
    for a, b in sorted(pairs):
        x, y = sorted((label[a], label[b]))
        if x != y:
            label = [x if k == y else k for k in label]
    kept = N.keep_one_of_each_copy(documents).count()
    assert len(set(label)) <= kept <= len(set(label)) + 0.01 * len(texts)


def test_tries_propose_pairs_without_a_common_band(corpus):
    from pyspark.sql import functions as F

    base = [f"w{k}" for k in range(3000)]
    other = [f"v{k}" for k in range(3000)]
    texts = [" ".join(w) for w in (base, [*base[:-1], "x"], [*base[:-1], "y"], other, [*other[:1500], "z", *other[1501:]])]
    documents = corpus([*enumerate(texts), (9, None), (10, "")])
    # Each node has a key of its own in place of its bands, so only the tries can propose; of the two last texts their prints differ.
    own = N.written(N.add_keys(documents).withColumn("keys", F.when(F.size("keys") > 0, F.array("node")).otherwise(F.col("keys"))).withColumn(
        "fingerprint", F.when(F.col("doc_id") == 4, F.bitwise_not("fingerprint")).otherwise(F.col("fingerprint"))))
    root = {r.node: r.root for r in N.near_components(documents, own).collect()}
    nodes = [N.node_of(N.text_words(t)) for t in texts]
    assert len({root[n] for n in nodes[:3]}) == 1 and not {nodes[3], nodes[4]} & set(root)
    # Linked fingerprints of texts that are not similar: the exact check decides.
    forced = N.written(own.withColumn("fingerprint", F.lit(7).cast("long")))
    root = {r.node: r.root for r in N.near_components(documents, forced).collect()}
    assert len(root) == 5 and len(set(root.values())) == 2 and root[nodes[3]] == root[nodes[4]] != root[nodes[0]]


def test_repeated_ids_with_different_texts(corpus):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (6, b), (4, c), (7, a), (7, a), (8, c)]
    assert sorted((r.doc_id, r.text) for r in N.keep_one_of_each_copy(corpus(rows)).collect()) == [(4, c), (5, a), (5, b)]
    assert sorted((r.doc_id, r.text) for r in N.keep_one_of_each_copy(corpus([*rows, (3, a), (5, b + " z")])).collect()) == [(3, a), (4, c), (5, b)]


def test_one_of_each_group_stays(corpus):
    rng, rows = random.Random(4), [(900, None), (901, " "), (902, "Two words"), (903, "two  WORDS"), (904, "two other")]
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 200, 600]))]
        for k in range(40 if group == 0 else 6):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((group * 50 + k, " ".join(words)))
    rng.shuffle(rows)
    kept = N.keep_one_of_each_copy(corpus([*rows, (None, "Two words"), rows[3]]))
    assert kept.columns == corpus([]).columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == plain_kept(rows) and got.count(None) == 1
    assert N.keep_one_of_each_copy(corpus([])).count() == 0


def test_stage_takes_five_words_and_four_fifths(spark, folder):
    import corpus_pipeline as C
    from wattledger.llm.common import table

    documents = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(r.doc_id for r in dict(C.STAGES)["near_duplicates"](spark, documents, folder).collect()) == plain_kept(rows)
