"""Held-out accuracy, numpy traversal against a walk node by node, and odd inputs."""

import zlib

import numpy as np
import pytest

from wattledger.llm import quality as Q
from wattledger.llm import toxicity as X
from wattledger.llm.common import table


def rank_area(score, truth):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    ones = truth == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_trees_walk_like_a_plain_walk():
    random = np.random.default_rng(5)
    rows = random.normal(size=(400, 6))
    truth = ((rows[:, 0] > 0.2) ^ (rows[:, 3] < -0.5)).astype(float)
    trees = Q.fit_trees(rows, truth, trees=25)
    for row, chance in zip(rows[:50], trees.probability(rows[:50]), strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.threshold[node] != np.inf:
                node = trees.child[node] + (row[trees.feature[node]] > trees.threshold[node])
            total += trees.value[node]
        assert chance == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
    assert ((trees.probability(rows) > 0.5) == (truth == 1)).mean() > 0.97


def test_trees_with_one_class_or_nothing():
    assert Q.fit_trees(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (Q.fit_trees(np.ones((8, 3)), np.ones(8)).probability(np.ones((2, 3))) > 0.8).all()
    assert len(set(Q.fit_trees(np.ones((8, 3)), np.array([0.0, 1.0] * 4)).probability(np.ones((2, 3))))) == 1


def test_held_out_quality(spark, folder):
    folder = folder.replace("0.001", "0.01")
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = Q.score_quality(documents, labels).toPandas()
    assert len(out) == documents.count() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert out.held_out.tolist() == [held(i) for i in out.doc_id]
    judged = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert rank_area(judged.score.to_numpy(), judged.quality.to_numpy()) > 0.95
    assert (judged.predicted == judged.quality).mean() > 0.93


def test_held_out_toxicity(spark, folder):
    folder = folder.replace("0.001", "0.1")
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = X.score_toxicity(documents, labels).toPandas()
    judged = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert rank_area(judged.score.to_numpy(), judged.toxic.to_numpy()) > 0.9
    assert (judged.predicted == judged.toxic).mean() > 0.94
    assert judged[judged.predicted == 1].toxic.mean() > 0.95


def test_labels_of_the_held_out_fold_are_not_used(corpus, labelled):
    texts = [(i, "fine words here %d" % i if i % 2 else "junk!! ### %d" % i) for i in range(60)]
    documents = corpus(texts)
    honest = [(i, i % 2, 1 - i % 2) for i, _ in texts]
    turned = [(i, 1 - q if held(i) else q, 1 - t if held(i) else t) for i, q, t in honest]
    for score in (Q.score_quality, X.score_toxicity):
        first, second = (score(documents, labelled(rows)).orderBy("doc_id").collect() for rows in (honest, turned))
        assert first == second


@pytest.mark.parametrize("score", [Q.score_quality, X.score_toxicity])
def test_odd_rows(corpus, labelled, score):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (4, "word " * 60_000), (5, " \n\t")]
    labels = labelled([(1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1), (4, 1, 0), (99, 0, 1), (3, 0, 1), (7, 5, 5)])
    out = score(corpus(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert score(corpus([]), labels).count() == 0
    assert [r.predicted for r in score(corpus(rows[:2]), labelled([])).collect()] == ([1, 1] if score is Q.score_quality else [0, 0])


def test_rejected_documents_go_and_columns_stay(corpus, labelled):
    rows = [(i, "calm and readable text number %d." % i if i % 4 else "$$$ ### !!! %d" % i) for i in range(200)]
    documents = corpus(rows)
    kept = Q.keep_good(documents, labelled([(i, int(i % 4 > 0), 0) for i, _ in rows]))
    assert kept.schema.names == documents.schema.names
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 4}


def test_risk_never_falls_below_zero():
    """With as many unlabelled rows as confirmed ones and the same words, the classifier falls back to the prior."""
    rows = X.SparseRows([[0], [1], [0, 1], []] * 20)
    w, b = X.fit_nnpu(rows, rows, 2, 0.3, seed=1, epochs=30)
    assert np.isfinite(w).all() and abs(1 / (1 + np.exp(-b)) - 0.3) < 0.25
