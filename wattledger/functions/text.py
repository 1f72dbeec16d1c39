"""Text functions: accents, whitespace, slugs, labels, number formats."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind, bind_sql, sql_text

# Latin letters with marks, superscripts, letter-like signs, Roman numerals,
# ligatures, full-width forms: here every decomposition counts. Of all other
# code points, those do that leave something in ASCII (squared units, circled digits, ...).
_BLOCKS = [(0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2000, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]


@lru_cache(maxsize=None)
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """NFKD without marks: (one character to one, one character to several)."""
    one, many = {}, {}
    listed = {code for low, high in _BLOCKS for code in range(low, high)}
    for code in range(0x80, 0x20000):
        if 0xAC00 <= code < 0xE000:  # Hangul syllables and surrogates
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char or not (code in listed or any(c.isascii() for c in plain)):
            continue
        if len(plain) == 1:
            one[char] = plain
        elif plain:
            many[char] = plain
    return one, many


def _regex_class(chars) -> str:
    """A class of ranges that holds all of `chars`, and what lies in small gaps between them."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= 8:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


_WHITE = " \t\n\x0b\f\r"
_NOT_ASCII = r"[^\x00-\x7F]"
_RUNS = r"[\x00-\x7F]+|[^\x00-\x7F]+"


# Runs of white space that are not one space already.
_SPACES = r"[\s\x1c-\x1f\x85\x{a0}]{2,}|[\t-\r\x1c-\x1f\x85\x{a0}]"
_OTHER_SPACE = r"[\t-\r\x1c-\x1f\x85\x{a0}]"
# A text is plain ASCII if it has as many bytes as characters; no pattern has to read it.
_IS_ASCII = "length(x) = octet_length(x)"


@lru_cache(maxsize=None)
def _strip_marks_sql() -> str:
    """SQL over `x` that removes accents and other marks.

    Plain ASCII texts pass through. Others are cut into ASCII and other runs, and
    only the others, usually single letters, are looked up.
    """
    one, many = _decompositions()
    pairs = "\u0001".join(f"{k}\u0002{v}" for k, v in many.items())
    table = f"str_to_map({sql_text(pairs)}, '\\u0001', '\\u0002')"
    single = f"translate(r, {sql_text(''.join(one))}, {sql_text(''.join(one.values()))})"
    spelled = (f"get(transform(array({single}), z -> CASE WHEN z RLIKE {sql_text(_regex_class(many))} THEN "
               f"array_join(transform(split(z, ''), ch -> coalesce({table}[ch], ch)), '') ELSE z END), 0)")
    run = f"CASE WHEN r RLIKE {sql_text(_NOT_ASCII)} THEN regexp_replace({spelled}, {sql_text(r'[\p{M}]+')}, '') ELSE r END"
    return f"CASE WHEN {_IS_ASCII} THEN x ELSE array_join(transform(regexp_extract_all(x, {sql_text(_RUNS)}, 0), r -> {run}), '') END"


@lru_cache(maxsize=None)
def _ascii_sql() -> str:
    """SQL over `x` that leaves plain ASCII. Latin letters are looked up in the whole text; where that was not all, the rest by runs."""
    one, _ = _decompositions()
    latin = [c for c, plain in one.items() if ord(c) < 0x180 and plain.isascii()]
    spelled = f"translate(x, {sql_text(''.join(latin))}, {sql_text(''.join(one[c] for c in latin))})"
    rest = f"get(transform(array({spelled}), x -> CASE WHEN {_IS_ASCII} THEN x ELSE regexp_replace({_strip_marks_sql()}, {sql_text(_NOT_ASCII + '+')}, '') END), 0)"
    return f"CASE WHEN {_IS_ASCII} THEN x ELSE {rest} END"


def _squeeze_sql(inner: str) -> str:
    """Most texts have single line breaks only, which need no pattern; the rest is looked at once more."""
    rest = f"CASE WHEN contains(y, '  ') OR y RLIKE {sql_text(_OTHER_SPACE)} THEN regexp_replace(y, {sql_text(_SPACES)}, ' ') ELSE y END"
    return f"trim(get(transform(array(replace({inner}, '\\n', ' ')), y -> {rest}), 0))"


def strip_marks(c: Column) -> Column:
    """Remove accents and other marks, keep every other character."""
    return bind_sql(c, _strip_marks_sql())


def squeeze(c: Column) -> Column:
    """All whitespace runs, line breaks included, become one space."""
    return bind_sql(c, _squeeze_sql("x"))


def ascii_upper(c: Column) -> Column:
    """Accent-free ASCII in upper case with single spaces; null is ''."""
    return bind_sql(F.coalesce(c, F.lit("")), f"upper({_squeeze_sql(_ascii_sql())})")


def plain_lower(c: Column) -> Column:
    """Accent-free lower case with single spaces."""
    return bind_sql(c, f"lower({_squeeze_sql(_strip_marks_sql())})")


def search_key(c: Column) -> Column:
    """Accent-free lower case, trimmed only."""
    return strip(F.lower(strip_marks(c)))


def strip(c: Column) -> Column:
    """Trim every kind of whitespace (Spark's `trim` only knows the space)."""
    return F.btrim(c, F.lit(_WHITE))


def strip_sql(text: str) -> str:
    """`strip` as SQL."""
    return f"btrim({text}, {sql_text(_WHITE)})"


def tidy_lines(c: Column) -> Column:
    """Single spaces, single line breaks, trimmed; line breaks stay."""
    def replaced(c: Column, marks: list[str], pattern: str, by: str) -> Column:
        return bind(c, lambda x: F.when(contains_any(x, marks), F.regexp_replace(x, pattern, by)).otherwise(x))

    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n"))
    c = replaced(c, ["  ", "\t"], r"[ \t]{2,}|\t", " ")
    return strip(replaced(c, ["\n\n"], r"\n{2,}", "\n"))


def lines_of(c: Column) -> Column:
    """Trimmed, non-blank lines of an already tidied text."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: strip(x)), lambda x: x != "")


def blank_to_null(c: Column) -> Column:
    return F.get(F.filter(F.array(c), lambda v: strip(v) != ""), F.lit(0))


def found(c: Column) -> Column:
    """`regexp_extract` gives '' for no match; turn that into null. (`nullif` would run the search twice inside other expressions.)"""
    return F.get(F.filter(F.array(c), lambda v: v != ""), F.lit(0))


def found_sql(text: str) -> str:
    """`found` as SQL."""
    return f"get(filter(array({text}), hit -> hit <> ''), 0)"


@lru_cache(maxsize=None)
def needed_word(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds, in upper case; '' when none is certain."""
    bare = re.sub(r"\[[^\]]*\]", "\0", re.sub(r"\\.", "\0", pattern))
    while "(" in bare:
        bare = re.sub(r"\([^()]*\)", "\0", bare)
    bare = re.sub(r".(?:[?*]|\{[^}]*\})", "\0", bare)
    return "" if "|" in bare else max(re.findall("[A-Za-z]+", bare), key=len, default="").upper()


def may_match(text: Column, plain: Column, pattern: str) -> Column:
    """Whether a text can match a pattern in any case, told by a word in its `ascii_upper` form.

    That form keeps all letters that a pattern takes for one of A to Z, but for the dotless i.
    """
    word = needed_word(pattern)
    return plain.contains(word) | text.contains("\u0131") if "I" in word else plain.contains(word)


def pick(text: Column, pattern: str, group: int = 1, plain: Column | None = None) -> Column:
    """First match of a pattern on raw text, in any case; null when absent. With the text's `ascii_upper` form most absent ones cost no search."""
    hit = found(F.regexp_extract(text, "(?iU)" + pattern, group))
    return hit if plain is None else F.when(may_match(text, plain, pattern), hit)


def pick_sql(text: str, pattern: str, any_case: bool = True, group: int = 1, plain: str = "") -> str:
    """`pick` (or, in upper case only, `pick_ascii`) as SQL."""
    hit = found_sql(f"regexp_extract({text}, {sql_text(('(?iU)' if any_case else '') + pattern)}, {group})")
    if not plain:
        return hit
    word = needed_word(pattern)
    dotless = f" OR contains({text}, '\u0131')" if any_case and "I" in word else ""
    return f"CASE WHEN contains({plain}, {sql_text(word)}){dotless} THEN {hit} END"


def pick_ascii(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of an upper-case pattern on `ascii_upper` text."""
    hit, word = found(F.regexp_extract(text, pattern, group)), needed_word(pattern)
    return F.when(text.contains(word), hit) if word else hit


def pick_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def cut_before(text: Column, pattern: str) -> Column:
    """Cut a text in front of every match; what precedes the first is dropped."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1"), "\u0001")
    return bind(parts, lambda x: F.slice(x, 2, F.size(x)))


def contains_any(text: Column, words: list[str]) -> Column:
    return bind_sql(text, " OR ".join(f"contains(x, {sql_text(w)})" for w in words) or "false")


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def _or_default(c: Column, default: str) -> Column:
    return F.coalesce(found(c), F.lit(default))


def project_slug(c: Column) -> Column:
    return _or_default(_slug(c), "project")


def run_slug(c: Column) -> Column:
    return _or_default(_slug(F.coalesce(c, F.lit(""))), "na")


def file_slug(c: Column) -> Column:
    """The only slug that spells accented letters out."""
    return _or_default(_slug(strip_marks(F.coalesce(c, F.lit("")))), "arquivo")


def export_name(c: Column, default: str = V.EXPORT_DEFAULT_NAME) -> Column:
    """Keeps case and hyphens; nothing left is `default`, the name an installation gives its exports."""
    kept = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_-]+", "_")
    return _or_default(F.regexp_replace(kept, r"^_+|_+\z", ""), default)


def drop_glyph_codes(c: Column) -> Column:
    """Remove `(cid:N)` tokens left by undecodable fonts."""
    return squeeze(F.regexp_replace(c, r"(?i)\(cid:\d+\)", " "))


def clean_class_text(c: Column) -> Column:
    """A consumer class line without dates, day counts and trailing counters."""
    c = drop_glyph_codes(c)
    c = F.regexp_replace(c, r"\b\d{2}/\d{2}/\d{4}\b", " ")
    c = F.regexp_replace(c, r"\b\d{1,2}\b(?=\s+\d{2}/\d{2}/\d{4})", " ")
    c = F.regexp_replace(c, r"(?:\s+\d{1,2})+\s*$", " ")
    return F.regexp_replace(squeeze(c), r"^[ \-]+|[ \-]+\z", "")


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def municipality_of_file(path: Column, override: Column | None = None) -> Column:
    stem = F.regexp_replace(file_stem(path), r"(?i)[_-]?faturas?.*$", "")
    stem = F.regexp_replace(stem, r"(?i)[_-]?invoices?.*$", "")
    stem = strip(F.regexp_replace(stem, r"[_\-]+", " "))
    named = _or_default(stem, "NAO INFORMADO")
    return named if override is None else F.coalesce(found(strip(override)), named)


def page_label(file_name: Column, page: Column) -> Column:
    """`stem page: n`, or whichever half is known."""
    stem = F.when(~F.coalesce(file_name, F.lit("")).isin("", "nan"), file_stem(file_name))
    number = F.when(page.try_cast("double") >= 1, page.try_cast("double").cast("bigint"))
    label = F.concat(F.lit("page: "), number.cast("string"))
    return F.concat_ws(" ", stem, label)


def spell_abbreviations(c: Column) -> Column:
    for token, meaning in V.ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"\b{token}\b", f"{token} ({meaning})")
    return c


def kwh_source(bucket: Column | str, detail: Column) -> Column:
    """`bucket/detail`, or the one that is filled."""
    bucket = F.lit(bucket) if isinstance(bucket, str) else bucket
    left, right = found(F.trim(bucket)), found(F.trim(F.coalesce(detail, F.lit(""))))
    return F.when(left == right, left).otherwise(F.concat_ws("/", left, right))


def format_ptbr(c: Column, decimals: int = 2) -> Column:
    return F.translate(F.format_number(F.coalesce(c, F.lit(0.0)), decimals), ",.", ".,")


def format_brl(c: Column) -> Column:
    return F.concat(F.lit("R$ "), format_ptbr(c, 2))


def format_currency(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("R$ "), F.format_number(F.nanvl(c, F.lit(None)), 2)), F.lit("N/A"))


def format_plain(c: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.format_number(F.nanvl(c, F.lit(None)), 2), F.lit(suffix)), F.lit("N/A"))
