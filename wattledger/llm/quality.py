"""Document quality: histogram gradient-boosted trees over document statistics.

Training rows are a bounded sample of the labelled documents; only their statistics (not their texts) reach the
driver. The trees are flattened into arrays, broadcast (some 100 KB), and walked by numpy for whole Arrow batches, so
scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import SLICE_ROWS, held_out, slices, unused

STATISTICS = [
    "log_characters", "log_words", "word_length", "upper_share", "lower_share", "digit_share", "symbol_share",
    "space_share", "newline_share", "non_ascii_share", "distinct_words", "distinct_word_pairs", "distinct_lines",
    "line_length", "pipe_share", "exclamation_share", "top_symbol_share", "sentence_length", "byte_entropy",
]
#: Labelled documents that training looks at, at most.
TRAINING_ROWS = 20_000


def _byte_classes() -> np.ndarray:
    """One row per class of UTF-8 bytes: upper, lower, digit, symbol, space, newline, non-ASCII, character starts."""
    code = np.arange(256)
    upper, lower = (code >= 65) & (code <= 90), (code >= 97) & (code <= 122)
    digit, space = (code >= 48) & (code <= 57), np.isin(code, [9, 11, 12, 13, 32])
    newline, high = code == 10, code >= 128
    symbol = ~(upper | lower | digit | space | newline | high)
    starts = (code < 128) | (code >= 192)
    return np.array([upper, lower, digit, symbol, space, newline, high, starts], dtype=np.float64)


_CLASSES = _byte_classes()


def statistics(text: str | None) -> list[float]:
    """The numbers in STATISTICS for one whole text; null counts as empty, and an empty text gives zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digit, symbol, space, newline, high, characters = _CLASSES @ counts
    words, lines = raw.split(), raw.split(b"\n")
    n_words, n_lines, size = max(1, len(words)), len(lines), len(raw)
    shares = counts[counts > 0] / size
    symbols = counts * (_CLASSES[3] > 0)
    return [
        np.log1p(characters), np.log1p(len(words)), (size - space - newline) / n_words, upper / size, lower / size,
        digit / size, symbol / size, space / size, newline / size, high / size, len(set(words)) / n_words,
        (len(set(zip(words, words[1:], strict=False))) + 1) / n_words, len(set(lines)) / n_lines, np.log1p(size / n_lines),
        counts[124] / n_words, counts[33] / n_words, symbols.max() / n_words,
        np.log1p(n_words / (1 + counts[46] + counts[33] + counts[63])), float(-(shares * np.log2(shares)).sum()),
    ]


@dataclass
class Trees:
    """Flattened trees: node k of the whole forest asks feature[k] > threshold[k] and goes to child[k] or child[k] + 1.

    A leaf points at itself with an infinite threshold, so all rows walk the same number of levels.
    """

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total, at = np.full(len(rows), self.base), np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                node = self.child[node] + (rows[at, self.feature[node]] > self.threshold[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def constant_trees(probability: float, depth: int = 1) -> Trees:
    none = np.zeros(0, dtype=np.int64)
    return Trees(none, np.zeros(0), none, np.zeros(0), none, depth, float(np.log(probability / (1 - probability))))


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12,
    penalty: float = 2.0, least: float = 4.0,
) -> Trees:
    """Second-order boosting on the logistic loss, splits found on histograms of quantile bins.

    With one class only there is nothing to learn: the smoothed share of the class is the constant answer.
    """
    n, positive = len(labels), float(labels.sum())
    base = (positive + 1) / (n + 2)
    if n == 0 or positive in (0, n):
        return constant_trees(base)
    grid = np.quantile(rows, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
    edges = [np.unique(grid[:, j]) for j in range(rows.shape[1])]
    codes = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    columns = rows.shape[1]
    flat = codes + np.arange(columns) * bins
    feature, threshold, child, value, roots = [], [], [], [], []
    score = np.full(n, np.log(base / (1 - base)))
    for _ in range(trees):
        chance = 1.0 / (1.0 + np.exp(-score))
        slope, bend = chance - labels, chance * (1 - chance)

        def leaf(members: np.ndarray, slope: np.ndarray = slope, bend: np.ndarray = bend) -> float:
            return float(-rate * slope[members].sum() / (bend[members].sum() + penalty))

        def add(members: np.ndarray) -> int:
            k = len(feature)
            feature.append(0), threshold.append(np.inf), child.append(k), value.append(leaf(members))
            return k

        everyone = np.arange(n)
        roots.append(add(everyone))
        level = [(roots[-1], everyone)]
        for _ in range(depth):
            following = []
            for k, members in level:
                cells = flat[members].ravel()
                g = np.bincount(cells, np.repeat(slope[members], columns), columns * bins).reshape(columns, bins).cumsum(1)
                h = np.bincount(cells, np.repeat(bend[members], columns), columns * bins).reshape(columns, bins).cumsum(1)
                all_g, all_h = g[0, -1], h[0, -1]
                gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
                gain[(h < least) | (all_h - h < least)] = 0
                gain[:, -1] = 0
                j, cut = divmod(int(gain.argmax()), bins)
                if gain[j, cut] <= 1e-6 or cut >= len(edges[j]):
                    continue
                right = codes[members, j] > cut
                first, second = add(members[~right]), add(members[right])
                feature[k], threshold[k], child[k] = j, edges[j][cut], first
                following += [(first, members[~right]), (second, members[right])]
                assert second == first + 1
            level = following
        flattened = Trees(np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots[-1:]), depth, 0.0)
        node = np.full(n, roots[-1])
        for _ in range(depth):
            node = flattened.child[node] + (rows[everyone, flattened.feature[node]] > flattened.threshold[node])
        score += flattened.value[node]
    return Trees(
        np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), depth, float(np.log(base / (1 - base)))
    )


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents outside the held-out fold, the same ones in every run.

    The ids are chosen first, on the labels alone, so that the (bounded) list of ids can be sent to the documents.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Trees from the statistics of a bounded sample (some 150 bytes a row reach the driver)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = [statistics(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.string()), part.column("label"), pa.array(values, pa.list_(pa.float64()))],
                ["doc_id", "label", "statistics"],
            )

    sample = labelled_sample(documents, labels, label, rows).mapInArrow(measure, "doc_id string, label int, statistics array<double>")
    found = sample.toPandas().sort_values(["doc_id", "label"], kind="stable")
    if not len(found):
        return constant_trees(0.5)
    values = np.array([np.asarray(x, dtype=float) for x in found["statistics"]])
    order = np.lexsort([*values.T[::-1], found["doc_id"].to_numpy()])  # repeated ids in any order give the same sums
    return fit_trees(values[order], found["label"].to_numpy(dtype=float)[order])


def add_score(documents: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """All columns of `documents` and the probability of good quality of each whole text, in one pass.

    Null text counts as empty; repeated rows are scored each; an existing column of that name is replaced.
    """
    kept = [c for c in documents.columns if c.lower() != name.lower()]
    source = unused("text_of_document", kept)
    frame = documents.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(source))
    model = documents.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_ROWS):
            rows = np.array([statistics(t) for t in part.column(source).to_pylist()], dtype=float)
            arrays = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.value.probability(rows))], [*kept, name])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in frame.schema.fields[:-1]], T.StructField(name, T.DoubleType())])
    return frame.mapInArrow(score, schema)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score reaches the threshold) for every row of `documents`.

    Without usable labels (none, or none outside the held-out fold) every score is 0.5; an empty table gives no rows.
    """
    scored = add_score(documents.select("doc_id", "text"), fit_quality(documents, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `documents` that the classifier does not reject, with their columns unchanged."""
    name = unused("quality_score", documents.columns)
    return add_score(documents, fit_quality(documents, labels), name).filter(F.col(name) >= threshold).drop(name)
