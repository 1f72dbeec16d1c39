"""Secret scans: fixed patterns for known shapes, and password guess cost for values in credential contexts.

A value after a word like "password" is priced by dynamic programming: the cheapest way to spell it as dictionary
words, dates, repeats, keyboard walks and brute-force spans gives the guesses an informed attacker needs. Costs are
decimal logarithms and add up along a segmentation. Each document is scanned whole in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import slices

# The patterns of the base spans and their least lengths, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Maximal runs of hexadecimal digits that are long enough; a shorter run cannot match from a later start either.
HEX_RUNS = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, what joins it to its value, and the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[\x20_-]?key|credentials?)s?["']?"""
    r"""(?:\x20{0,8}(?:=>|->|[:=])\x20{0,8}|\x20(?P<prose>is|was)\x20)["']?(?P<value>[^\s"'<>,;]{8,})""", re.I | re.A)
#: Text in lower case without any of these has no credential word.
HINTS = ("pass", "pwd", "secret", "token", "api", "credential")
#: Values that cost fewer guesses (as a power of ten) are no secrets worth the name.
LEAST_LOG10_GUESSES = 10.0
#: Common parts of passwords, most common first.
DICTIONARY = (
    "password pass admin welcome login user test hello love dragon monkey master shadow sun moon star summer winter spring autumn "
    "monday friday january june july august secret letmein access changeme default root guest server system computer internet "
    "football baseball soccer hockey batman superman princess angel baby flower cookie chocolate orange banana apple cherry "
    "purple yellow silver golden diamond freedom liberty america london paris berlin madrid tiger lion eagle falcon wolf bear "
    "horse dog cat fish bird house home happy lucky money power magic ninja pirate hunter killer ranger soldier captain jordan "
    "michael jennifer thomas robert daniel charlie andrew ashley jessica george maggie ginger pepper buster cheese coffee "
    "example sample demo dummy token key value string secretkey mypassword qwerty azerty abc iloveyou trustno"
).split()
LEET = str.maketrans("@4310$57", "aaeiosst")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
LONGEST_WALK, LONGEST_UNIT = 16, 4
DATES = re.compile(r"(?:(?:19|20)\d\d(?P<a>[-/.]?)(?:0[1-9]|1[0-2])(?P=a)(?:0[1-9]|[12]\d|3[01])|"
                   r"(?:0[1-9]|[12]\d|3[01])(?P<b>[-/.]?)(?:0[1-9]|[12]\d|3[01])(?P=b)(?:19|20)\d\d|(?:19|20)\d\d)", re.A)
YEARS = 120


def _neighbours() -> set[str]:
    pairs = set()
    for row in ROWS:
        for a, b in zip(row, row[1:], strict=False):
            pairs |= {a + b, b + a}
    for upper, lower in zip(ROWS[:2], ROWS[1:3], strict=True):
        for k, b in enumerate(lower):
            for a in upper[k : k + 2]:
                pairs |= {a + b, b + a}
    return pairs


_NEIGHBOURS, _RANK = _neighbours(), {w: k + 1 for k, w in enumerate(DICTIONARY)}
_LONGEST_WORD = max(map(len, DICTIONARY))
_KIND_COST = math.log10(5)


def character_cost(c: str) -> float:
    if c.isascii():
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 2.0


def pattern_segments(value: str) -> list[list[tuple[int, float]]]:
    """For each position, the (end, log10 guesses) of all words, dates, repeats and walks that begin there."""
    n, low = len(value), value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for end in range(i + 3, min(n, i + _LONGEST_WORD) + 1):
            word = low[i:end]
            rank, leet = _RANK.get(word), 0.0
            if rank is None and (rank := _RANK.get(plain[i:end])):
                leet = math.log10(2 ** sum(a != b for a, b in zip(word, plain[i:end], strict=True)))
            if rank:
                written_ = value[i:end]
                case = 0.0 if written_ == word else math.log10(2) if written_[1:] == word[1:] or written_.isupper() else math.log10(2 ** len(word))
                out[i].append((end, math.log10(rank + 1) + case + leet))
        for size in (4, 8, 10):
            if (found := DATES.fullmatch(value, i, i + size)) if i + size <= n else None:
                mark = math.log10(4) if found["a"] or found["b"] else 0.0
                out[i].append((i + size, math.log10(YEARS * (1 if size == 4 else 365)) + mark))
        turns, way = 0, None
        for end in range(i + 2, min(n, i + LONGEST_WALK) + 1):
            if low[end - 2 : end] not in _NEIGHBOURS:
                break
            step = ord(low[end - 1]) - ord(low[end - 2])
            turns, way = turns + (way is not None and step * way < 0), step
            if end - i >= 3:
                out[i].append((end, math.log10(47 * 4) + math.log10(end - i) + turns * math.log10(4)))
    for unit in range(1, LONGEST_UNIT + 1):
        alike = 0
        for i in range(n - unit - 1, -1, -1):
            alike = alike + 1 if value[i] == value[i + unit] else 0
            times = alike // unit + 1
            if times >= 2 and times * unit >= 3:
                out[i].append((i + times * unit, sum(map(character_cost, value[i : i + unit])) + math.log10(times)))
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation; every segment also pays for the choice of its kind.

    One sweep: `best` ends in any segment, `brute` in an open brute-force span, which grows by a character at a time.
    Time is linear in the length of the value. The empty value costs 0.
    """
    n = len(value)
    best, brute, edges = [0.0] + [math.inf] * n, math.inf, pattern_segments(value)
    for i in range(n):
        brute = min(brute, best[i] + _KIND_COST) + character_cost(value[i])
        best[i + 1] = min(best[i + 1], brute)
        for end, cost in edges[i]:
            best[end] = min(best[end], best[i] + _KIND_COST + cost)
    return best[n]


@dataclass(frozen=True)
class Span:
    """A secret at [start, end) of the text in code points; [value, value_end) is what must not be seen.

    A guess that base spans cover in part is at what they leave of it; its value is whole.
    """

    kind: str
    start: int
    end: int
    value: int
    value_end: int
    log10_guesses: float | None


def mixed(value: str) -> bool:
    """Whether a value mixes letters with digits or symbols inside, as prose seldom does."""
    inner = value.strip(".!?:)(][}{")
    return len(inner) >= LEAST_VALUE and any(c.isalpha() for c in inner) and any(not c.isalpha() for c in inner)


def outside(start: int, end: int, taken: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """What the intervals of `taken` (sorted) from number `at` on leave of [start, end)."""
    out = []
    while at < len(taken) and taken[at][0] < end:
        if taken[at][0] > start:
            out.append((start, taken[at][0]))
        start, at = max(start, taken[at][1]), at + 1
    return [*out, (start, end)] if start < end else out


def find_secrets(text: str | None, least: float = LEAST_LOG10_GUESSES) -> list[Span]:
    """All spans of a whole text by start, then kind: base spans as the patterns say, then values that cost enough guesses.

    Every value in a credential context is priced; only after "is" or "was" must it mix letters with other characters.
    A guess overlaps no base span: where they cover a part of its value, each part outside is a span of the whole value,
    unless it is closing brackets alone.
    """
    if not text:
        return []
    base = [Span("access", *m.span(), *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [Span("hex", *m.span(), *m.span(), None) for m in HEX_RUNS.finditer(text)]
    low, added = text.lower(), []
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                base.append(Span("assign", *m.span(), *m.span(2), guess_cost(m[2])))
        taken = sorted((s.start, s.end) for s in base)
        at = 0
        for m in CONTEXT.finditer(text):
            if m["prose"] and not mixed(m["value"]):
                continue
            start, end = m.span("value")
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            parts = outside(start, end, taken, at)
            if parts != [(start, end)]:
                parts = [(a, b) for a, b in parts if text[a:b].strip(")]}")]
            if parts and (cost := guess_cost(m["value"])) >= least:
                added += [Span("guess", a, b, start, end, cost) for a, b in parts]
    return sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def mask(text: str | None, mark: str = "[SECRET]", least: float = LEAST_LOG10_GUESSES) -> str | None:
    """The text with the value of every span replaced; overlapping values become one mark."""
    spans = find_secrets(text, least)
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted((s.value, s.value_end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_spans(documents: DataFrame, least: float = LEAST_LOG10_GUESSES) -> DataFrame:
    """doc_id and spans (kind, start, end, value_start, value_end, log10_guesses) of every row.

    Null and empty texts have no spans; repeated rows come back as often as they are there.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = ["kind", "start", "end", "value_start", "value_end", "log10_guesses"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    arrow = pa.list_(pa.struct(list(zip(fields, types, strict=True))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [[dict(zip(fields, vars(s).values(), strict=True)) for s in find_secrets(t, least)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, arrow)], ["doc_id", "spans"])

    inner = "kind string, start long, end long, value_start long, value_end long, log10_guesses double"
    return documents.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, spans array<struct<{', '.join(x.replace(' ', ': ', 1) for x in inner.split(', '))}>>")


def secret_report(documents: DataFrame, least: float = LEAST_LOG10_GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, n_strong of every row.

    base_sha256 is over the base spans alone; spans lists the added ones too; n_strong counts the priced values, by their
    start, that cost at least `least`.
    """
    found = secret_spans(documents, least)

    def count(test: Callable) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(kind: str) -> Column:
        return count(lambda s: s["kind"] == kind)

    def text(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), text("spans").alias("spans"),
        of_kind("guess").alias("n_guess"),
        F.size(F.array_distinct(F.transform(
            F.filter("spans", lambda s: F.coalesce(s["log10_guesses"], F.lit(0.0)) >= least), lambda s: s["value_start"]))).cast("long").alias("n_strong"))


def mask_secrets(documents: DataFrame, mark: str = "[SECRET]", least: float = LEAST_LOG10_GUESSES) -> DataFrame:
    """All rows and columns of `documents` with secrets replaced in `text`; `n_chars`, where there is one, follows the text."""
    names = documents.columns
    at, schema = names.index("text"), T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            arrays = list(part.columns)
            arrays[at] = pa.array([mask(t, mark, least) for t in arrays[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names)

    masked = documents.mapInArrow(scan, schema)
    if "n_chars" in names:
        length = F.coalesce(F.length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))
    return masked
