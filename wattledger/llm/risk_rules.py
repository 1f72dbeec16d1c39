"""Quality rules whose cutoffs carry a guarantee: in each stratum they reject few good documents, with high probability.

Each rule is a share between 0 and 1 that is high in bad text, in 1024 bins. Labelled documents fall into two halves. The
first half proposes: for each level of strictness, a stratum's cutoffs are the lowest bins above which at most that share
of its good documents lies, rule by rule. The second half tests the levels, all rules together, from the loosest to the
strictest: a level passes if the exact binomial (Clopper-Pearson) upper bound of its false rejections is within the
allowed risk, and the first that does not ends the sequence. A fixed sequence needs no correction within a stratum;
between strata the confidence is split (Bonferroni). So with the stated confidence every passed level of every stratum keeps
the risk, and the one that separates good from bad best may be taken. A stratum without a passed level rejects nothing.

Texts are read once for their counts; labels, histograms and decisions work on these numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import held_out, slices, written

BINS = 1024
#: Shares of good documents that a rule alone may reject, from the loosest level to the strictest.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
#: Allowed share of good documents rejected in a stratum, and the chance that any stratum exceeds it.
RISK, DOUBT = 0.02, 0.05
#: Strata whose numbers (some kilobytes each) reach the driver, at most.
MOST_STRATA = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "upper_letters", "exclamations"]
#: Share = the first count in the sum of the others.
RULES = {
    "long_words": ("word_chars", ("word_chars", *["n_words"] * 8)),
    "short_words": ("n_words", ("n_words", "word_chars")), "symbols": ("n_symbols", ("n_symbols", "n_words")),
    "repeated_lines": ("n_dup_lines", ("n_lines",)), "repeated_words": ("n_repeat_words", ("n_words",)),
    "upper_letters": ("upper_letters", ("word_chars",)), "exclamations": ("exclamations", ("exclamations", "n_words")),
}
_SYMBOLS, _SPACES = np.frombuffer(b"#*$%&|<>", dtype=np.uint8), np.array([9, 10, 11, 12, 13, 32])


# ---- counts of a text ----

def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words which the text has twice or more."""
    n = len(words)
    if n <= size:
        return 0
    number = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    window = ids
    for k in range(1, size):
        _, window = np.unique(window[: n - k] * n + ids[k:], return_inverse=True)
    again = np.bincount(window)[window] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[: n - size + 1] += again
    edges[size:] -= again
    return int((np.cumsum(edges[:n]) > 0).sum())


def counts(text: str | None) -> list[int]:
    """The numbers in COUNTS for one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    size = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    characters = int(size.sum() - size[128:192].sum())
    return [
        len(words), characters - int(size[_SPACES].sum()), int(size[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_window_words(words),
        len(lines), int(size[65:91].sum()), int(size[33])]


def add_counts(documents: DataFrame) -> DataFrame:
    """doc_id and the numbers in COUNTS of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = np.array([counts(t) for t in part.column("text").to_pylist()], dtype=np.int64).reshape(part.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, rows.T)], ["doc_id", *COUNTS])

    return documents.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def length_band() -> Column:
    """Strata of the query: short, middle and long texts."""
    return F.when(F.col("n_words") < 200, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")


def bins() -> dict[str, Column]:
    """The bin of each rule's share; nothing to share in is bin 0."""
    out = {}
    for name, (part, whole) in RULES.items():
        total = sum((F.col(c) for c in whole[1:]), F.col(whole[0]))
        out[name] = F.when(total > 0, F.floor(F.col(part) * BINS / total)).otherwise(0).cast("int")
    return out


# ---- exact bounds ----

def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p)."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k)
    logs = n * np.log1p(-p) + np.r_[0.0, np.cumsum(np.log((n - i) / (i + 1)) + np.log(p) - np.log1p(-p))]
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, doubt: float) -> float:
    """The largest share that k of n leaves open at this doubt (Clopper-Pearson, one-sided); 1 for no rows."""
    low, high = 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if at_most(k, n, middle) > doubt else (low, middle)
    return high


@dataclass
class Stratum:
    """What was found for a stratum: cutoffs by rule (one per level), bounds of the tested levels, and the level taken (None: none)."""

    cutoffs: dict[str, list[int]]
    bounds: list[float]
    level: int | None


def chosen_level(good: list[int], bad: list[int], doubt: float, risk: float) -> tuple[list[float], int | None]:
    """Bounds of the levels tested, and of the passed ones the best.

    good[k] and bad[k] count the rows that level k is the first to reject, with a last place for those that none does.
    """
    n, m, bounds, best = sum(good), sum(bad), [], None
    for level in range(len(good) - 1):
        rejected = sum(good[: level + 1])
        bounds.append(upper_bound(rejected, n, doubt))
        if bounds[-1] > risk:
            break
        gain = sum(bad[: level + 1]) / max(m, 1) - rejected / max(n, 1)
        if best is None or gain > best[0]:
            best = (gain, level)
    return bounds, best and best[1]


# ---- the corpus ----

def _first_rejecting_level(levels: int) -> Column:
    """The first level at which a rule rejects a row (with bins and cutoffs beside it); `levels` if none does."""
    def passed(rule: str) -> Column:
        return F.size(F.filter(F.col("cutoffs")[rule], lambda cutoff: cutoff >= F.col(f"bins.{rule}")))

    return F.when(F.col("cutoffs").isNotNull(), F.least(*map(passed, RULES))).otherwise(levels)


def _cutoff_table(spark, strata: dict[str, Stratum]) -> DataFrame:
    return spark.createDataFrame(
        [(k, s.cutoffs, s.level) for k, s in strata.items()], "stratum string, cutoffs map<string,array<int>>, level int")


def fit_rules(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, levels: tuple[float, ...] = LEVELS) -> dict[str, Stratum]:
    """The strata of `measured` (doc_id, stratum, passes the base, bins) with their cutoffs.

    Labels are those of quality (1 good, 0 bad) outside the held-out fold; of contradicting ones 1 counts. Null strata
    and rows that fail the base take no part.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    proposes = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 2 == 0
    rows = written(measured.filter("not base_failed and stratum is not null").join(known, "doc_id").select("stratum", "label", "bins", proposes.alias("proposes")))
    shares = rows.filter("proposes and label = 1").select("stratum", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"bins.{name}").alias("bin")) for name in RULES])).alias("x"))
    found: dict = defaultdict(lambda: defaultdict(dict))
    strata = rows.select("stratum").distinct().limit(MOST_STRATA + 1).collect()
    if len(strata) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    for r in shares.groupBy("stratum", "x.rule", "x.bin").count().toLocalIterator():
        found[r["stratum"]][r["rule"]][r["bin"]] = r["count"]
    proposed = {k: Stratum({name: cutoffs_of(by_rule.get(name, {}), levels) for name in RULES}, [], None) for k, by_rule in found.items()}
    tried = rows.filter("not proposes").join(_cutoff_table(rows.sparkSession, proposed), "stratum").select(
        "stratum", "label", _first_rejecting_level(len(levels)).alias("first"))
    tally: dict = defaultdict(lambda: [[0] * (len(levels) + 1), [0] * (len(levels) + 1)])
    for r in tried.groupBy("stratum", "label", "first").count().collect():
        tally[r["stratum"]][r["label"]][r["first"]] = r["count"]
    for k, s in proposed.items():
        s.bounds, s.level = chosen_level(tally[k][1], tally[k][0], doubt / max(1, len(strata)), risk)
    return proposed


def cutoffs_of(histogram: dict[int, int], levels: tuple[float, ...]) -> list[int]:
    """Per level the lowest occupied bin above which at most its share of the counts lies; no counts reject nothing."""
    n, out = sum(histogram.values()), []
    for share in levels:
        cutoff, above = BINS, 0
        for b in sorted(histogram, reverse=True):
            if above > share * n:
                break
            cutoff, above = b, above + histogram[b]
        out.append(cutoff)
    return out


def rules_report(documents: DataFrame, labels: DataFrame, stratum: Column | None = None, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum of every row of `documents`.

    `stratum` is a text column made of the counts (by default three bands of length). Null and empty texts have no words and
    fail the base. Repeated rows and null ids are judged each; labels of null ids are not used. Without labels, or with too
    few for any guarantee, only the base rejects. An empty table gives no rows.
    """
    rows = add_counts(documents).withColumns({"base_failed": base_failed(), "stratum": length_band() if stratum is None else stratum})
    measured = written(rows.withColumn("bins", F.struct(*[c.alias(name) for name, c in bins().items()])))
    strata = _cutoff_table(measured.sparkSession, fit_rules(measured, labels, risk, doubt))
    judged = measured.join(F.broadcast(strata), "stratum", "left")
    rejected = F.coalesce(_first_rejecting_level(len(LEVELS)) <= F.col("level"), F.lit(False))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "stratum")
