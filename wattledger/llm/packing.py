"""Packing documents into training sequences: shallow length combinations chosen by non-negative least squares.

A document is tokenized once. Whole windows are sequences of their own; what remains of each document (less than a
window) is packed. Its length is rounded up to units of 16 tokens, and the histogram of units (256 numbers, whatever
the size of the corpus) is all that planning sees. Combinations of one to three lengths that fill the window exactly
are the columns of a non-negative least-squares problem: how often to use each, so that together they use up the
histogram. The counts are rounded down, and the pieces of a length take the slots of the plan by their rank.
Pieces without a slot are packed greedily one after the other, and cut where a sequence is full.

Ranks and running sums are made of counts within a task and offsets between tasks, so no length, however common, is
gathered in one task, and no token is shuffled: checksums of cut pieces follow from checksums kept every 16 tokens.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import written

WINDOW, UNIT, END_ID = 4096, 16, 2
#: Lengths in a combination, at most.
DEEPEST = 3
#: Bytes of text tokenized at once (a longer text alone); words other than plain letters that a worker remembers.
BYTES_AT_ONCE, WORDS_KEPT = 1 << 23, 200_000
ID_BYTES = 4
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_LETTERS_AND_MARKS = r"^[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[!-&(-/:-@\[-`{-~]*$"


# ---- token ids ----

class WordTokenizer:
    """Token ids of a tokenizer that drops white space and never joins words across it.

    So the ids of a text are those of its words one after the other, and each different word of many texts is tokenized
    once. A word of letters and the marks after it are two words to the tokenizer. For letters in composed lower case its
    normalization changes nothing, and merging alone gives the ids: they are spelt in one byte per symbol, with bytes of
    their own for a word's last symbol, and merged by a rank table in one call. All other words are asked of the tokenizer
    itself, which also decides on a few probes whether the rank table may be used. Lower case of A-Z changes nothing, as
    the tokenizer lower-cases. Texts that may hold a special token's string are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.merge = Tokenizer.from_file(path), {}, None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self._rank_table(model["vocab"], [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]], model.get("end_of_word_suffix") or "")
        probes = ["a", "the", "wordlike", "straße", "déjà", "ñandú", "abcdefghijklmnop", "zzzzzz", "àààà"]
        if self.merge is not None:
            ids, sizes = self._merged(probes)
            same = [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [e.tolist() for e in self._plain(probes)]
            joined = np.concatenate(self._plain(["abc", "),!"])).tolist() == self._plain(["abc),!"])[0].tolist()
            self.merge = self.merge if same and joined else None

    def _rank_table(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str) -> None:
        """Bytes for the symbols of lower-case letters, and the merges that stay within them, ranked by id."""
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        letters = [*range(97, 123), 0xC3, *range(0x9F, 0xC0)]
        spare = iter([*range(33, 127), *range(1, 32)])
        symbols = {letter[b]: next(spare) for b in letters}
        symbols |= {letter[b] + suffix: next(spare) for b in letters if b != 0xC3}
        spelt = {}
        for token, i in vocabulary.items():
            head, last = token.removesuffix(suffix), suffix if suffix and token.endswith(suffix) else ""
            if head and all(c in symbols for c in head[:-1]) and head[-1] + last in symbols:
                spelt[bytes([*(symbols[c] for c in head[:-1]), symbols[head[-1] + last]])] = i
        order = [vocabulary["".join(m)] for m in merges]
        if not suffix or order != sorted(order) or len(spelt) < len(symbols):
            return
        self.inner, self.final = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
        self.inner[32] = 32
        for b in letters:
            self.inner[b], self.final[b] = symbols[letter[b]], symbols.get(letter[b] + suffix, 0)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.merge = tiktoken.Encoding("letters", pat_str="[^ ]+", mergeable_ranks=spelt, special_tokens={})

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, one after the other, and how many each has."""
        raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        last = np.r_[raw[1:] == 32, True]
        code = np.where(last, self.final[raw], self.inner[raw]).tobytes().decode("ascii")
        ids = np.array(self.merge.encode_ordinary(code), dtype=np.uint32)
        stops = np.flatnonzero(self.ends[ids])
        return ids, np.diff(np.r_[-1, stops])

    def _asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words; the tokenizer's answers are remembered up to a number."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        missing = [w for w in words if w not in self.known]
        self.known.update(zip(missing, self._plain(missing), strict=True))
        found = [self.known[w] for w in words]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], dtype=np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words in ASCII lower case, one after the other, and how many each has."""
        direct = np.asarray(pc.match_substring_regex(words, _LETTERS_AND_MARKS)) if self.merge is not None else np.zeros(len(words), dtype=bool)
        fast = pc.utf8_lower(words.filter(pa.array(direct)))
        letters, marks = (x.dictionary_encode() for x in (pc.utf8_rtrim(fast, _MARKS), pc.utf8_ltrim(fast, _LETTERS)))
        parts = [self._merged(letters.dictionary.to_pylist()) if len(letters.dictionary) else (np.zeros(0, np.uint32), np.zeros(0, np.int64)),
                 self._asked(marks.dictionary.to_pylist()), self._asked(words.filter(pa.array(~direct)).to_pylist())]
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        # Each word has two of the parts: letters and marks, or itself and an empty one at the end.
        n_letters, n_marks = len(letters.dictionary), len(marks.dictionary)
        part = np.full((len(words), 2), len(sizes), dtype=np.int64)
        part[direct, 0], part[direct, 1] = letters.indices.to_numpy(), n_letters + marks.indices.to_numpy()
        part[~direct, 0] = n_letters + n_marks + np.arange(int((~direct).sum()))
        sizes = np.r_[sizes, 0]
        return gathered(ids, sizes, part.ravel()), sizes[part].sum(axis=1)

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = np.asarray(pc.match_substring(texts, "<|"))
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(special), "", texts)))
        words = split.flatten().dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        index = words.indices.to_numpy()
        all_ids = memoryview(gathered(ids, sizes, index).astype("<u4", copy=False).tobytes())
        ends = np.r_[0, np.cumsum(sizes[index])][np.cumsum(np.asarray(split.value_lengths()))] * ID_BYTES
        odd = iter(self._plain(texts.filter(pa.array(special)).to_pylist()))
        return [memoryview(next(odd).astype("<u4").tobytes()) if s else all_ids[a:b] for s, a, b in zip(special, np.r_[0, ends[:-1]], ends, strict=True)]


def gathered(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs (of given sizes, one after the other in `values`) named by `index`, joined."""
    starts, n = (np.cumsum(sizes) - sizes)[index], sizes[index]
    ends = np.cumsum(n)
    return values[np.repeat(starts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def encoded(texts: pa.Array, tokenizer_path: str) -> Iterator[memoryview]:
    """The ids of each text in order, a bounded number of bytes at once (or one text)."""
    tokenizer, sizes, start, size = word_tokenizer(tokenizer_path), pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for k, n in enumerate(sizes):
        if k > start and size + n > BYTES_AT_ONCE:
            yield from tokenizer.encode(texts.slice(start, k - start))
            start, size = k, 0
        size += n
    yield from tokenizer.encode(texts.slice(start))


def measured(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """One row per document: its place (part, at), token count, checksums of whole windows, and its rest.

    rank counts the rests of the same number of units before it in the task, fulls_before the whole windows and
    marks are the checksums of the rest's first 16, 32, ... tokens.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    ending = array("I", [end_id]).tobytes()
    names = ["doc_id", "part", "at", "doc_tokens", "fulls_before", "fulls", "rest", "units", "rank", "rest_crc", "marks"]
    types = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, fulls, ranks = TaskContext.get().partitionId(), 0, 0, {}
        for batch in batches:
            rows = []
            for found in encoded(batch.column("text"), tokenizer_path):
                ids = memoryview(bytes(found) + ending)
                step, jump = window * ID_BYTES, unit * ID_BYTES
                n_full = len(ids) // step
                whole = [zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(n_full)]
                rest, crc, marks = ids[n_full * step :], 0, []
                for k in range(0, len(rest), jump):
                    crc = zlib.crc32(rest[k : k + jump], crc)
                    marks.append(crc - (crc >> 31 << 32))
                units = -(-len(rest) // jump)
                rows.append((part, at, len(ids) // ID_BYTES, fulls, whole, len(rest) // ID_BYTES, units, ranks.get(units, 0), crc, marks))
                at, fulls, ranks[units] = at + 1, fulls + n_full, ranks.get(units, 0) + 1
            if not rows:
                continue
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return documents.select("doc_id", "text").mapInArrow(
        per_task,
        f"doc_id {kind}, part long, at long, doc_tokens long, fulls_before long, fulls array<long>, rest long, units int, rank long, "
        "rest_crc long, marks array<int>")


# ---- checksums of cut pieces ----

def _crc_after_zero_bits() -> np.ndarray:
    """Rows k: the effect of 2**k zero bytes on each of the 32 bits of a CRC-32 register."""
    one = np.array([0xEDB88320, *(1 << k for k in range(31))], dtype=np.uint64)

    def twice(m: np.ndarray) -> np.ndarray:
        return _times(np.broadcast_to(m, (32, 32)), m)

    m = one
    for _ in range(3):
        m = twice(m)
    steps = [m]
    for _ in range(31):
        steps.append(twice(steps[-1]))
    return np.array(steps)


def _times(matrix: np.ndarray, register: np.ndarray) -> np.ndarray:
    """matrix[i] (32 columns) times register[i], over two elements."""
    bits = (register[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    return np.bitwise_xor.reduce(matrix * bits, axis=1)


_ZEROS = _crc_after_zero_bits()


def crc_of_tail(before: np.ndarray, through: np.ndarray, tail_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of the last `tail_bytes` bytes of a run, from those of what comes before them and of the whole run."""
    register, size = before.astype(np.uint64), tail_bytes.astype(np.int64)
    for k in range(32):
        on = (size >> k) & 1 == 1
        if on.any():
            register[on] = _times(np.broadcast_to(_ZEROS[k], (int(on.sum()), 32)), register[on])
    return (register ^ through.astype(np.uint64)).astype(np.int64)


@F.pandas_udf(T.LongType())
def _tail_crc(before: pd.Series, through: pd.Series, tail_bytes: pd.Series) -> pd.Series:
    return pd.Series(crc_of_tail(before.to_numpy(), through.to_numpy(), tail_bytes.to_numpy()))


# ---- the plan ----

def combinations_of(total: int, deepest: int = DEEPEST) -> list[tuple[int, ...]]:
    """All multisets of one to `deepest` lengths with the sum `total`, the longest length first."""
    out = [(total,)]
    for depth in range(2, deepest + 1):
        for rest in combinations_with_replacement(range(1, total), depth - 1):
            if (last := total - sum(rest)) >= rest[-1]:
                out.append((last, *reversed(rest)))
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method; a stop after `rounds` is a feasible, less good x."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= tolerance:
            break
        active[k] = True
        while True:
            chosen = np.flatnonzero(active)
            part = a[:, chosen]
            z = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(chosen)), part.T @ b)
            if (z > tolerance).all():
                x[:] = 0
                x[chosen] = z
                break
            low = z <= tolerance
            ratio = x[chosen][low] / np.maximum(x[chosen][low] - z[low], 1e-300)
            x[chosen] += min(1.0, float(ratio.min())) * (z - x[chosen])
            out = chosen[low & (x[chosen] <= tolerance)]
            out = out if len(out) else chosen[[int(np.argmin(np.where(low, x[chosen], np.inf)))]]
            active[out], x[out] = False, 0
            if not active.any():
                break
    return x


def plan_of(histogram: dict[int, int], units: int, deepest: int = DEEPEST) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length in units, first rank, end rank, first sequence, place in it) and the number of planned sequences."""
    left = {k: n for k, n in histogram.items() if k > 0 and n > 0}
    columns = [c for c in combinations_of(units, deepest) if all(k in left for k in c)]
    if not columns:
        return [], 0
    a, b = np.zeros((units + 1, len(columns))), np.zeros(units + 1)
    for j, c in enumerate(columns):
        for k in c:
            a[k, j] += 1
    for k, n in left.items():
        b[k] = n
    scale = max(left.values())
    x = non_negative_least_squares(a, b / scale) * scale
    slots, used, sequences = [], dict.fromkeys(left, 0), 0
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] + 1e-6 < 1:
            break
        need = {k: columns[j].count(k) for k in columns[j]}
        times = min(int(x[j] + 1e-6), *((left[k] - used[k]) // n for k, n in need.items()))
        if times <= 0:
            continue
        for place, k in enumerate(columns[j]):
            slots.append((k, used[k], used[k] + times, sequences, place))
            used[k] += times
        sequences += times
    return slots, sequences


# ---- pieces ----

def _before(table: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """Adds the sum of `value` over the tasks before this one; the table has a row per task (and key) only."""
    window = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document's tokens are the ids of its whole text and then `end_id`; null and empty texts have that one token.
    Sequences hold `window` tokens at most; a rest keeps together unless it is packed without a slot and a sequence ends
    within it, where it is cut at a multiple of `unit` tokens. Documents are told apart by their place in the input, so
    repeated rows, repeated ids and null ids are packed each. An empty table has no pieces.
    """
    rows = written(measured(documents, tokenizer_path, window, unit, end_id))
    spark = rows.sparkSession
    per_length = rows.filter("units > 0").groupBy("part", "units").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["units"]: r["n"] for r in per_length.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    slots, planned = plan_of(totals, window // unit)
    fulls = _before(rows.groupBy("part").agg(F.sum(F.size("fulls")).alias("n")), "n", "earlier").select("part", "earlier")
    whole = rows.filter(F.size("fulls") > 0).join(fulls, "part").select(
        "doc_id", "doc_tokens", (F.col("earlier") + F.col("fulls_before")).alias("first"), F.posexplode("fulls").alias("k", "ids_crc32"))
    n_full = rows.agg(F.coalesce(F.sum(F.size("fulls")), F.lit(0))).first()[0]
    whole = whole.select(
        "doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.lit(planned) + F.col("first") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    offsets = _before(per_length, "n", "earlier", "units").select("part", "units", "earlier")
    ranked = rows.filter("units > 0").join(offsets, ["part", "units"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    slot_table = spark.createDataFrame(slots, "slot_units int, low long, high long, first_sequence long, place int")
    fits = (F.col("units") == F.col("slot_units")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    assigned = written(ranked.join(F.broadcast(slot_table), fits, "left").select(
        "doc_id", "part", "at", "doc_tokens", "rest", "rest_crc",
        F.when(F.col("low").isNull(), F.col("marks")).alias("marks"),
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "place"))
    rest_start = (F.col("doc_tokens") - F.col("rest")).alias("start")
    in_slots = assigned.filter("sequence_id is not null").select(
        "doc_id", rest_start, F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id",
        F.col("place").cast("long").alias("turn"))

    # Without a slot: a running sum of tokens, with a boundary every `stride` tokens; a cut goes back to the last mark
    # before the boundary, so a sequence gets at most the unit less one that its predecessor left.
    stride = window - unit + 1
    loose = assigned.filter("sequence_id is null")
    sums = _before(loose.groupBy("part").agg(F.sum("rest").alias("n")), "n", "earlier").select("part", "earlier")
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = loose.withColumn("own", F.coalesce(F.sum("rest").over(within), F.lit(0))).join(sums, "part").withColumn("from", F.col("own") + F.col("earlier"))
    first, last = F.floor(F.col("from") / stride), F.floor((F.col("from") + F.col("rest") - 1) / stride)
    cut = placed.select("*", F.explode(F.sequence(first, last)).alias("block")).withColumns({
        "a": F.greatest(F.floor((F.col("block") * stride - F.col("from")) / unit) * unit, F.lit(0)),
        "b": F.when(F.col("block") == last, F.col("rest")).otherwise(F.floor(((F.col("block") + 1) * stride - F.col("from")) / unit) * unit)})
    cut = cut.filter("b > a")
    mark = lambda at: F.get("marks", (at / unit).cast("int") - 1).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    through = F.when(F.col("b") == F.col("rest"), F.col("rest_crc")).otherwise(mark(F.col("b")))
    cut = cut.withColumns({"through": through, "head": F.coalesce(F.when(F.col("a") > 0, mark(F.col("a"))), F.lit(0).cast("long"))})
    heads = cut.filter("a = 0").withColumn("ids_crc32", F.col("through"))
    tails = cut.filter("a > 0").withColumn("ids_crc32", _tail_crc("head", "through", (F.col("b") - F.col("a")) * ID_BYTES))
    greedy = heads.unionByName(tails).select(
        "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("a")).alias("start"), (F.col("b") - F.col("a")).alias("length"),
        "ids_crc32", "doc_tokens", (F.lit(planned + n_full) + F.col("block")).cast("long").alias("sequence_id"), (F.col("from") + F.col("a")).alias("turn"))
    ahead = Window.partitionBy("sequence_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return whole.unionByName(
        in_slots.unionByName(greedy).withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("turn"))
