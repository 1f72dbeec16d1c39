"""Risk-controlled quality rules against a plain version of every step, and the guarantee on invented holdouts."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger.llm import queries
from wattledger.llm import risk_rules as R
from wattledger.llm.common import table

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
    seen, windows = collections.Counter(), list(zip(words, words[1:], words[2:], strict=False))
    seen.update(windows)
    again = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(again),
            len(lines), sum("A" <= c <= "Z" for c in text), text.count("!")]


def plain_report(rows, labels, risk=R.RISK, doubt=R.DOUBT):
    """doc_id to its result columns, by the words of the docstrings."""
    label = {}
    for i, quality, _ in labels:
        if i is not None and quality in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(quality, label.get(i, 0))
    judged = []
    for i, text in rows:
        c = dict(zip(R.COUNTS, plain_counts(text), strict=True))
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        band = "short" if c["n_words"] < 200 else "middle" if c["n_words"] < 1000 else "long"
        shares = {n: (1024 * c[a] // total if (total := sum(c[x] for x in b)) else 0) for n, (a, b) in R.RULES.items()}
        judged.append((i, [c[x] for x in R.COUNTS[:5]], failed, band, shares))
    known = [(i, band, shares, label[i]) for i, _, failed, band, shares in judged if not failed and i in label]
    bands, taken = {b for _, b, _, _ in known}, {}
    for band in bands:
        half = [[(s, y) for i, b, s, y in known if b == band and zlib.crc32(str(i).encode()) // 5 % 2 == k] for k in (0, 1)]
        good = [s for s, y in half[0] if y]
        best = None
        for level in R.LEVELS if good else ():
            cutoffs = {n: min(c for c in {s[n] for s in good} if sum(s[n] > c for s in good) <= level * len(good)) for n in R.RULES}
            hits = {y: [any(s[n] > cutoffs[n] for n in R.RULES) for s, t in half[1] if t == y] for y in (0, 1)}
            k, n = sum(hits[1]), len(hits[1])
            tail = sum(math.comb(n, j) * Fraction(risk) ** j * (1 - Fraction(risk)) ** (n - j) for j in range(k + 1))
            if tail > Fraction(doubt) / len(bands):
                break
            gain = sum(hits[0]) / max(1, len(hits[0])) - k / max(1, n)
            if best is None or gain > best[0]:
                best = (gain, cutoffs)
        taken[band] = best[1] if best else None
    return sorted(str((i, *numbers, failed, not failed and not (taken.get(b) and any(s[n] > taken[b][n] for n in R.RULES)), b)) for i, numbers, failed, b, s in judged)


def report(df, labels, **options):
    out = R.rules_report(df, labels, **options)
    assert out.columns == COLUMNS
    return sorted(str(tuple(r)) for r in out.collect())


ODD = [None, "", " \n\t", "one", "a b a b a b", "x\n x\nx\n\nx\n", "é ü  漢 <|>#", "a b c d a b c e a b c", "\x0b\x0c\x1c w\x85w\xa0w", "A!! B!! C!! A!! B!! C!!", "same same same same"]


@pytest.mark.parametrize("text", [*ODD, " ".join(random.Random(5).choices("ab c d".split(" "), k=300))])
def test_counts(text):
    assert R.counts(text) == plain_counts(text)


def test_bounds_are_exact():
    for n, k, p in [(1, 0, 0.3), (20, 3, 0.2), (50, 0, 0.02), (50, 50, 0.5), (200, 7, 0.05)]:
        exact = sum(math.comb(n, j) * Fraction(p) ** j * (1 - Fraction(p)) ** (n - j) for j in range(k + 1))
        assert R.at_most(k, n, p) == pytest.approx(float(exact), rel=1e-9)
    assert R.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01) and R.upper_bound(5, 5, 0.05) == 1.0 and R.upper_bound(0, 0, 0.05) == 1.0
    assert R.at_most(10**6, 10**8, 0.0101) < 1e-9 < R.at_most(10**6, 10**8, 0.01)


def test_the_risk_is_kept():
    """Levels whose true risk is known: over many holdouts, a taken level exceeds the risk in at most the stated share (here far fewer)."""
    rng, true, broken = np.random.default_rng(7), np.cumsum([0.002, 0.006, 0.006, 0.008, 0.02]), 0
    for _ in range(400):
        good = rng.multinomial(600, [*np.diff(np.r_[0, true]), 1 - true[-1]]).tolist()
        _, level = R.chosen_level(good, [5, 5, 5, 5, 5, 0], 0.05, 0.02)
        broken += level is not None and true[level] > 0.02
    assert broken <= 0.05 * 400


def invented(n):
    rng, words, rows, labels = random.Random(11), [f"w{k}" for k in range(3000)], [], []
    for i in range(n):
        size = rng.choice([60, 120, 300])
        bad = rng.random() < 0.25
        text = [rng.choice(words) + ("###" if bad and rng.random() < 0.3 else "") for _ in range(size)]
        rows.append((i, " ".join(w.upper() + "!!" for w in text) if bad and i % 3 == 0 else " ".join(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_report_against_the_plain_version(corpus, labelled):
    rows, labels = invented(2400)
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + [rows[0], (None, rows[1][1]), (20_000, "word " * 50_000), (20_001, " ".join(f"v{k}" for k in range(60_000)))]
    labels += [(0, 1 - labels[0][1], None), (None, 1, 0), (3, 5, 0), (4, None, 1), (99_999, 0, 0)]
    found = report(corpus(rows).repartition(5), labelled(labels))
    assert found == plain_report(rows, labels)
    kept = {r.doc_id: r.kept for r in R.rules_report(corpus(rows), labelled(labels)).collect()}
    wrong = sum(not kept[i] for i, quality, _ in labels[5:2400] if quality)
    caught = sum(not kept[i] for i, quality, _ in labels[5:2400] if not quality)
    assert wrong < 0.02 * 1800 and caught > 0.95 * sum(1 - q for _, q, _ in labels[5:2400])


def test_few_or_no_labels(corpus, labelled):
    rows, labels = invented(120)
    assert report(corpus(rows), labelled(labels[:40])) == plain_report(rows, labels[:40])
    assert report(corpus(rows), labelled([])) == plain_report(rows, [])
    assert report(corpus(rows), labelled([(i, 0, 0) for i in range(120)])) == plain_report(rows, [(i, 0, 0) for i in range(120)])
    assert report(corpus([]), labelled(labels)) == []
    # A null stratum rejects nothing beyond the base.
    out = R.rules_report(corpus(rows), labelled(labels), stratum=F.lit(None).cast("string")).collect()
    assert all(r.kept != r.base_failed for r in out)


def test_the_query(spark, folder):
    documents, labels = (table(spark, folder, n).collect() for n in ("documents", "labels"))
    want = plain_report([(r.doc_id, r.text) for r in documents], [(r.doc_id, r.quality, r.toxic) for r in labels])
    assert sorted(str(tuple(r)) for r in queries.op11_risk_controlled_rules(spark, folder).collect()) == want
