"""Benchmark decontamination: a prefix-filtered join of item windows with document words, in DataFrame functions only.

A window (ten consecutive item words; a shorter item is one window) is contained in a document if all its words stand
there in a row. All of them must occur, so the necessary prefix of a window, with its words ordered by rarity over all
documents, is the rarest one alone. Document words meet these prefix words in a broadcast hash join; there, the
window's position must lie inside the document, and the words around the match must equal the window, all within one
code-generated stage without a copy of the text. Windows whose rarest word no document has are gone before. Only
verified hits and one row per document are shuffled. Benchmarks of any size work: they are joined in blocks of
windows of a fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import BROADCAST_IDS, lower_ascii, unused, written

WINDOW_WORDS = 10
#: Windows that are broadcast at once (some 300 bytes each).
BLOCK_WINDOWS = 100_000
#: What separates words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a whole text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """item_id (text) and window (array of words), each once."""
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("start")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return items.select("item_id", "w", start).select("item_id", F.slice("w", F.col("start"), F.lit(size)).alias("window")).distinct()


def word_counts(documents: DataFrame, vocabulary: DataFrame, block: int = BLOCK_WINDOWS) -> DataFrame:
    """How often each word of `vocabulary` occurs in all documents (n = 0: never)."""
    found = documents.select(F.explode(words(F.col("text"))).alias("word"))
    fits = vocabulary.limit(block * 2 + 1).count() <= block * 2
    found = found.join(F.broadcast(vocabulary) if fits else vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window_id, window, token, place: the window's rarest word and where in the window it stands (from 0).

    Ties go to the smaller word, then to the first place. Windows with a word that no document has are left out.
    """
    each = windows.select("window_id", F.posexplode("window").alias("place", "word")).join(counts, "word")
    rarest = each.groupBy("window_id").agg(F.min(F.struct("n", "word", "place")).alias("x")).filter("x.n > 0")
    return windows.join(rarest.select("window_id", F.col("x.word").alias("token"), F.col("x.place").alias("place")), "window_id")


def _hits(documents: DataFrame, block: DataFrame, mark: bool) -> DataFrame:
    """Rows (doc_id, body, n_words, start, length, window_id) of verified windows; with `mark` also one row per document.

    The mark row comes from a null word after the last one, which matches the block's null token.
    """
    split = documents.select("doc_id", F.xxhash64("text").alias("body"), words(F.col("text")).alias("w"))
    ends = F.array(F.lit(None).cast("string")) if mark else F.array().cast("array<string>")
    each = split.select("doc_id", "body", "w", F.posexplode(F.concat("w", ends)).alias("at", "word"))
    start, size = F.col("at") - F.col("place"), F.size("window")
    inside = (start >= 0) & (start + size <= F.size("w"))
    same = F.when(inside, F.slice("w", start + 1, size) == F.col("window")).otherwise(False)
    on = F.coalesce("word", F.lit("")) == F.coalesce("token", F.lit(""))
    return each.join(F.broadcast(block), on & (F.col("token").isNull() | same)).select(
        "doc_id", "body", F.size("w").cast("long").alias("n_words"), start.cast("long").alias("start"),
        size.cast("long").alias("length"), "window_id")


def contamination(
    documents: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """doc_id, body, copies, n_words, n_hit, items (sorted texts) per different (doc_id, text); body tells texts apart.

    Null and empty texts have no words and no hits, an item without words has no window, an item without an id marks
    words but is in no list, repeated items count once, and repeated documents are one row with their number in
    `copies`. Empty tables give empty or clean results.
    """
    pairs = written(item_windows(benchmark, window_words))
    windows = written(pairs.select("window").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    vocabulary = written(windows.select(F.explode("window").alias("word")).distinct())
    ready = written(prefixed(windows, word_counts(documents, vocabulary, block_windows)))
    blocks = max(1, -(-ready.count() // block_windows))
    mark = ready.sparkSession.createDataFrame([(None, [], None, 0)], ready.select("window_id", "window", "token", "place").schema)
    parts = []
    for k in range(blocks):
        block = ready.filter(F.pmod(F.xxhash64("window_id"), F.lit(blocks)) == k).select("window_id", "window", "token", "place")
        parts.append(_hits(documents, block if k else block.union(mark), mark=k == 0))
    hit = F.when(F.col("window_id").isNotNull(), F.struct("start", "length", "window_id"))
    rows = reduce(DataFrame.union, parts).groupBy("doc_id", "body").agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("window_id").isNull().cast("long")).alias("copies"),
        F.collect_set(hit).alias("hits"))
    nothing = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))

    def cover(so_far: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(F.lit(0).cast("long"), end - F.greatest(so_far["end"], x["start"]))
        return F.struct((so_far["covered"] + more).alias("covered"), F.greatest(so_far["end"], end).alias("end"))

    covered = F.aggregate(F.array_sort("hits"), nothing, cover, lambda x: x["covered"])
    rows = written(rows.select("doc_id", "body", "copies", "n_words", covered.alias("n_hit"),
                               F.array_distinct(F.transform("hits", lambda x: x["window_id"])).alias("found")))
    ids = pairs.filter("item_id is not null").join(windows, "window").select("window_id", "item_id")
    items = (
        rows.filter(F.size("found") > 0).select("doc_id", "body", F.explode("found").alias("window_id")).join(ids, "window_id")
        .groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc_id").alias("d"), F.col("body").alias("b"), "items")
    )
    return rows.join(items, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left").select(
        "doc_id", "body", "copies", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    each = contamination(documents, benchmark).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that hold no window of any item, with their columns unchanged.

    Null and empty texts hold none and stay; with an empty benchmark all rows stay. Repeated rows stay or go together, rows
    with one doc_id and different texts each by its text. The ids and text hashes to drop are broadcast where they are few enough.
    """
    body = unused("body_of_text", documents.columns)
    hit = written(contamination(documents, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("body").alias("hit_body")))
    marked = documents.withColumn(body, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(hit["hit_id"]) & (marked[body] == hit["hit_body"])
    return marked.join(F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit, same, "left_anti").drop(body)
