"""Toxicity by non-negative positive-unlabelled learning.

Known are documents confirmed as toxic, and documents of which nothing is known. Linear classifiers over the words of
a text are trained in numpy on the non-negative risk: with the share of toxic documents pi, the risk on unlabelled
texts as if clean, less pi times the risk on toxic texts as if clean, estimates the risk on clean texts. It must
not fall below zero; where a mini-batch makes it do so, the step goes the other way. Training looks at a bounded
sample whose words are counted by Spark; scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import held_out, slices, written

#: Bounds of the training sample, and of the words the classifiers see.
POSITIVE_ROWS, UNLABELLED_ROWS, FEATURES = 8_000, 16_000, 4_000
#: A word must be in so many sampled toxic or unlabelled documents, and its two shares so many standard errors apart.
LEAST_DOCUMENTS, LEAST_ERRORS = 3, 2.6
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """The different words of a whole text in lower case; null has none."""
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Classifiers:
    """Word numbers, and one column of weights and one bias per classifier; `constant` answers where nothing was learnt."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The mean probability of the classifiers; an empty text has the bias alone."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, known = np.empty(len(texts)), self.vocabulary.keys()
        for row, text in enumerate(texts):
            at = sorted(self.vocabulary[w] for w in words_of(text) & known)
            out[row] = (1 / (1 + np.exp(-np.clip(self.weights[at].sum(axis=0) + self.bias, -500, 500)))).mean()
        return out


class SparseRows:
    """Rows of word numbers, end to end."""

    def __init__(self, rows: list[list[int]]):
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.flat = np.array([w for r in rows for w in r], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of the chosen rows and, for each, the position of its row among the chosen."""
        size = self.size[chosen]
        owner = np.repeat(np.arange(len(chosen)), size)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.start[chosen], size) + step], owner


def fit_nnpu(
    positive: SparseRows, unlabelled: SparseRows, features: int, prior: float, seed: int, epochs: int = 60, batch: int = 1024,
    rate: float = 0.05, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier with the logistic loss, by Adam on mini-batches of both kinds."""
    random = np.random.default_rng(seed)
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    first, second, step = np.zeros(features + 1), np.zeros(features + 1), 0
    n_p, n_u = len(positive.size), len(unlabelled.size)

    def margin(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, w[words], n) + b

    for _ in range(epochs):
        order = random.permutation(n_u)
        for k in range(0, n_u, batch):
            u = order[k : k + batch]
            p = random.integers(0, n_p, min(batch, max(64, n_p)))
            (pw, po), (uw, uo) = positive.take(p), unlabelled.take(u)
            zp, zu = margin(pw, po, len(p)), margin(uw, uo, len(u))
            chance_p, chance_u = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
            clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            as_clean_u, as_clean_p = chance_u / len(u), -prior * chance_p / len(p)
            if clean_risk >= 0:
                slope_u, slope_p = as_clean_u, as_clean_p - prior * (1 - chance_p) / len(p)
            else:
                slope_u, slope_p = -as_clean_u, -as_clean_p
            grad = np.append(np.bincount(pw, slope_p[po], features) + np.bincount(uw, slope_u[uo], features) + decay * w, slope_p.sum() + slope_u.sum())
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - float(move[-1])
    return w, b


def training_words(documents: DataFrame, labels: DataFrame, positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> DataFrame:
    """doc_id, is_positive, words of a bounded sample outside the held-out fold, the same in every run.

    Unlabelled rows are drawn from all such documents, whatever their label; toxic ones among them come twice, once as
    confirmed and once as unlabelled, as the risk asks for.
    """
    toxic = labels.filter("doc_id is not null and toxic = 1").filter(~held_out()).select("doc_id").distinct()
    some = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).withColumn("is_positive", F.lit(True))
    others = documents.select("doc_id").filter("doc_id is not null").filter(~held_out())
    others = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).distinct().withColumn("is_positive", F.lit(False))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [sorted(words_of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("is_positive"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "is_positive", "words"])

    chosen = F.broadcast(some.unionByName(others))
    return documents.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(split, "doc_id string, is_positive boolean, words array<string>")


def share_of_toxic(labels: DataFrame) -> float | None:
    """The share of toxic rows among the labelled ones outside the held-out fold; None without both kinds."""
    n, toxic = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).agg(F.count(F.lit(1)), F.sum("toxic")).first()
    return toxic / n if n and 0 < toxic < n else None


def fit_toxicity(documents: DataFrame, labels: DataFrame, prior: float | None = None, features: int = FEATURES, members: int = 3) -> Classifiers:
    """Several classifiers from different orders and draws of the same sample.

    `prior` is the share of toxic documents; without it, that of the labels outside the held-out fold. Without toxic
    training rows nothing can be learnt: every score is the prior, or 0 where that is unknown too.
    """
    prior = share_of_toxic(labels) if prior is None else prior
    sample = written(training_words(documents, labels))
    sizes = {r["is_positive"]: r["n"] for r in sample.groupBy("is_positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not prior or not sizes.get(True) or not sizes.get(False):
        return Classifiers({}, np.zeros((0, 1)), np.zeros(1), prior or 0.0)
    each = sample.select("is_positive", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.sum(F.col("is_positive").cast("long")).alias("p"), F.sum((~F.col("is_positive")).cast("long")).alias("u"))
    p, u = (F.col("p") + 0.5) / (sizes[True] + 1), (F.col("u") + 0.5) / (sizes[False] + 1)
    spread = p * (1 - p) / (sizes[True] + 1) + u * (1 - u) / (sizes[False] + 1)
    found = counts.filter(F.greatest("p", "u") >= LEAST_DOCUMENTS).withColumn("z", F.abs(p - u) / F.sqrt(spread)).filter(F.col("z") >= LEAST_ERRORS).orderBy(F.desc("z"), "word").limit(features).collect()
    vocabulary = {r["word"]: k for k, r in enumerate(found)}
    numbers = sample.sparkSession.createDataFrame(list(vocabulary.items()), "word string, number int")
    rows = (
        sample.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "is_positive", F.explode_outer("words").alias("word"))
        .join(F.broadcast(numbers), "word", "left").groupBy("row", "doc_id", "is_positive").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
        .select("doc_id", "is_positive", "numbers").collect()
    )
    rows = sorted((r["doc_id"], r["numbers"]) for r in rows if r["is_positive"]), sorted((r["doc_id"], r["numbers"]) for r in rows if not r["is_positive"])
    positive, unlabelled = (SparseRows([numbers for _, numbers in part]) for part in rows)
    fitted = [fit_nnpu(positive, unlabelled, len(vocabulary), prior, seed) for seed in range(members)]
    return Classifiers(vocabulary, np.stack([w for w, _ in fitted], axis=1), np.array([b for _, b in fitted]))


def score_toxicity(documents: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold) of every row, from its whole text.

    Null and empty texts have the score of a text without known words; repeated rows are scored each.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit_toxicity(documents, labels, prior))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
