"""Which distributor printed a document: markers looked up once per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind
from wattledger.functions.text import ascii_upper
from wattledger.sources.staging import materialize

_WORD_CCI = "<word CCI>"
_NEO_NOT_ELEKTRO = "<NEOENERGIA without ELEKTRO>"
_EDGE = 48  # longer than any marker


def _markers() -> list[str]:
    """Every plain marker the rules mention, once."""
    words = [w for _, groups in V.LAYOUT_RULES for group in groups for w in group if w != _NEO_NOT_ELEKTRO]
    words += [w for _, group in V.LAYOUT_MARKERS for w in group]
    return list(dict.fromkeys(words))


def _bit(marker: str) -> int:
    return 1 << _markers().index(marker)


def _has(text: Column, marker: str) -> Column:
    return text.rlike(r"\bCCI\b") if marker == _WORD_CCI else text.contains(marker)


def marker_bits(plain: Column) -> Column:
    """The markers of a text as bits of one integer."""
    bits = F.lit(0).cast("bigint")
    for marker in _markers():
        bits = bits.bitwiseOR(F.when(_has(plain, marker), F.lit(_bit(marker)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def _layout_of_bits(bits: Column) -> Column:
    def has(marker: str) -> Column:
        if marker == _NEO_NOT_ELEKTRO:
            return has("NEOENERGIA") & ~has("ELEKTRO")
        return bits.bitwiseAND(F.lit(_bit(marker)).cast("bigint")) != 0

    out = F
    for layout, groups in V.LAYOUT_RULES:
        hit = F.lit(True)
        for group in groups:
            some = F.lit(False)
            for marker in group:
                some = some | has(marker)
            hit = hit & some
        out = out.when(hit, layout)

    def count(words: list[str]) -> Column:
        return sum((has(w).cast("int") for w in words), F.lit(0))

    # Highest count first, then the earlier layout.
    scored = F.array(*[
        F.struct(count(words).alias("n"), F.lit(-i).alias("order"), F.lit(layout).alias("layout"))
        for i, (layout, words) in enumerate(V.LAYOUT_MARKERS)])
    best = bind(F.array_max(scored), lambda s: F.when(s["n"] >= 2, s["layout"]).otherwise("GENERIC"))
    return out.otherwise(best)


def layout_of_text(text: Column) -> Column:
    """Layout of one text."""
    return bind(bind(ascii_upper(text), marker_bits), _layout_of_bits)


def marker_scores(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Marker count per layout, long form."""
    plain = df.select(*keys, ascii_upper(text).alias("p"))
    scored = F.array(*[
        F.struct(F.lit(layout).alias("layout"),
                 sum((_has(F.col("p"), w).cast("int") for w in words), F.lit(0)).alias("markers"))
        for layout, words in V.LAYOUT_MARKERS])
    return plain.select(*keys, F.explode(scored).alias("s")).select(*keys, "s.layout", "s.markers")


def document_layouts(pages: DataFrame) -> DataFrame:
    """(pdf_source, provider_layout), decided from all pages of each document.

    No page text is shuffled. The facts of each page are written once. A page ships its marker bits, which meet in one map-side combined `bit_or` per document
    however long it is. Its tail meets the next page's head in a join by page, for markers that run over a page break.
    """
    return layouts_of_facts(materialize(page_facts(pages)))


def page_facts(pages: DataFrame) -> DataFrame:
    """(pdf_source, page_no, bits, head, tail) of every page, some hundred bytes each."""
    plain = pages.select("pdf_source", F.col("page_no").cast("int").alias("page_no"), ascii_upper(F.col("text")).alias("p"))
    return plain.select("pdf_source", "page_no", *fact_columns(F.col("p")))


def fact_columns(plain: Column) -> list[Column]:
    """bits, head and tail of a page from its `ascii_upper` text."""
    return [marker_bits(plain).alias("bits"), F.left(plain, F.lit(_EDGE)).alias("head"), F.right(plain, F.lit(_EDGE)).alias("tail")]


def layouts_of_facts(facts: DataFrame) -> DataFrame:
    """The same from page facts, which a caller may have written: they are read three times."""
    heads = facts.select("pdf_source", (F.col("page_no") - 1).alias("page_no"), "head")
    joints = facts.select("pdf_source", "page_no", "tail").join(heads, ["pdf_source", "page_no"]).select(
        "pdf_source", marker_bits(F.concat_ws(" ", "tail", "head")).alias("bits"))
    per_document = facts.select("pdf_source", "bits").union(joints).groupBy("pdf_source").agg(F.bit_or("bits").alias("bits"))
    return per_document.select("pdf_source", _layout_of_bits(F.col("bits")).alias("provider_layout"))
