"""Billing months: tokens, references `MM/YYYY`, month starts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind, bind_sql, bound, sql_text
from wattledger.functions.text import ascii_upper, found, found_sql, pick_ascii, strip

_DAY = r"\b\d{2}/(\d{2}/\d{4})\b"
_MONTH_TABLE = {name: f"{number:02d}" for name, number in V.MONTH_NUMBER.items()}


def month_digits(name: Column, table: dict[str, str] | None = None) -> Column:
    table = table or _MONTH_TABLE
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[name]


def long_month_digits(name: Column) -> Column:
    return month_digits(name, {k: f"{v:02d}" for k, v in V.LONG_MONTH_NUMBER.items()})


def full_year(digits: Column) -> Column:
    """Two digits mean 20yy; three digits mean nothing."""
    return F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).when(F.length(digits) == 4, digits)


def _reference(month: Column, year: Column) -> Column:
    return F.concat(F.lpad(month, 2, "0"), F.lit("/"), year)


def compact_reference(c: Column) -> Column:
    """`202511` -> `11/2025`, after dropping everything but digits; else ''."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return bind(digits, lambda d: F.when(
        F.length(d) == 6, _reference(F.substring(d, 5, 2), F.substring(d, 1, 4))).otherwise(""))


def reference_of_date(c: Column) -> Column:
    """First `dd/mm/yyyy` -> `mm/yyyy`; else ''."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), _DAY, 1)


def named_month_reference(name: Column, year: Column) -> Column:
    return F.coalesce(_reference(month_digits(F.upper(name)), full_year(year)), F.lit(""))


def month_reference(c: Column) -> Column:
    """Any spelling of a month (`1/25`, `01-2025`, `JAN25`, `Fev-2024`, `202501`) -> `MM/YYYY`, else ''."""
    return token_reference(ascii_upper(c))


@lru_cache(maxsize=None)
def _reference_sql() -> str:
    def part(pattern: str, group: int) -> str:
        return found_sql(f"regexp_extract(x, {sql_text(pattern)}, {group})")

    def year(text: str) -> str:
        return bound(text, "CASE length(y) WHEN 2 THEN concat('20', y) WHEN 4 THEN y END", "y")

    number = r"^(0?[1-9]|1[0-2])[/-](\d{2,4})$"
    named = rf"^({V.MON3})[/-]?(\d{{2,4}})$"
    packed = r"^(\d{4})(0[1-9]|1[0-2])$"
    position = f"(instr({sql_text(V.MON3)}, {part(named, 1)}) + 3) div 4"
    return (
        f"coalesce(concat(lpad({part(number, 1)}, 2, '0'), '/', {year(part(number, 2))}), "
        f"concat(format_string('%02d', {position}), '/', {year(part(named, 2))}), "
        f"concat({part(packed, 2)}, '/', {part(packed, 1)}), '')")


def token_reference(c: Column) -> Column:
    """The same for a token a pattern has already cut out, which is plain ASCII."""
    return bind_sql(F.upper(F.translate(c, " \t\n", "")), _reference_sql())


def token_sql(token: str) -> str:
    """`token_reference` as SQL."""
    return bound(f"upper(translate({token}, ' \\t\\n', ''))", _reference_sql(), "x")


def compact_sql(text: str) -> str:
    """`compact_reference` as SQL."""
    return bound(f"regexp_replace(coalesce({text}, ''), {sql_text(r'[^0-9]')}, '')",
                 "CASE WHEN length(d) = 6 THEN concat(substring(d, 5, 2), '/', substring(d, 1, 4)) ELSE '' END", "d")


def date_sql(text: str) -> str:
    """`reference_of_date` as SQL."""
    return f"regexp_extract(coalesce({text}, ''), {sql_text(_DAY)}, 1)"


_STRICT = r"^\s*(0?[1-9]|1[0-2])/(1[7-9]\d{2}|2[01]\d{2})\s*$"


def month_start(c: Column) -> Column:
    """`MM/YYYY` -> first day of the month; anything else -> null."""
    month = found(F.regexp_extract(c, _STRICT, 1)).cast("int")
    year = found(F.regexp_extract(c, _STRICT, 2)).cast("int")
    return F.make_date(year, month, F.lit(1))


def month_index(date: Column) -> Column:
    """Months counted as one integer, so windows are plain subtraction."""
    return F.year(date) * 12 + F.month(date)


def reference_index(c: Column) -> Column:
    """Month count of a `MM/YYYY` text, null when invalid."""
    month = found(F.regexp_extract(c, _STRICT, 1)).cast("int")
    year = found(F.regexp_extract(c, _STRICT, 2)).cast("int")
    return year * 12 + month


def index_sql(text: str) -> str:
    """`reference_index` as SQL."""
    month, year = (f"cast({found_sql(f'regexp_extract({text}, {sql_text(_STRICT)}, {g})')} AS int)" for g in (1, 2))
    return f"{year} * 12 + {month}"


def label_sql(index: str) -> str:
    """`index_label` as SQL."""
    year = f"cast(floor(({index} - 1) / 12) AS int)"
    return f"concat(lpad(cast({index} - {year} * 12 AS string), 2, '0'), '/', lpad(cast({year} AS string), 4, '0'))"


def index_label(index: Column) -> Column:
    """Month count -> `MM/YYYY`."""
    year = F.floor((index - 1) / 12).cast("int")
    return F.format_string("%02d/%04d", (index - year * 12).cast("int"), year)


def label(date: Column) -> Column:
    return F.date_format(date, "MM/yyyy")


def iso_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def _named_month_start(c: Column) -> Column:
    pattern = rf"^({V.MON3})[/-](\d{{4}}|\d{{2}})$"
    month = month_digits(pick_ascii(F.upper(c), pattern, 1)).cast("int")
    year = full_year(pick_ascii(F.upper(c), pattern, 2)).cast("int")
    return F.make_date(F.when((year >= 1700) & (year < 2200), year), month, F.lit(1))


def reference_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """`MM/YYYY` or a named month; else null."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.coalesce(month_start(text), _named_month_start(text))


_YEAR_FIRST = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T].*)?$"
_YEAR_MONTH = r"^(\d{4})-(\d{1,2})$"
_MONTH_YEAR = r"^(\d{1,2})-(\d{4})$"
_THREE_PARTS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?: .*)?$"


def _general_date(text: Column, month_first: bool = False) -> Column:
    """Year-first dates and, in one order or the other, dates that end with the year; else null."""
    def read(order: str) -> Column:
        iso = F.regexp_replace(text, _YEAR_FIRST, "$1-$2-$3")
        iso = F.regexp_replace(F.regexp_replace(iso, _YEAR_MONTH, "$1-$2-1"), _MONTH_YEAR, "$2-$1-1")
        return F.try_to_date(F.regexp_replace(iso, _THREE_PARTS, order), "yyyy-M-d")

    day_first = read("$3-$2-$1")
    return F.coalesce(read("$3-$1-$2"), day_first) if month_first else day_first


def contract_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Contract dates: `MM/YYYY`, named month, then day-first dates."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")

    def read(text: Column) -> Column:
        upper = F.upper(text)
        month = month_digits(pick_ascii(upper, rf"^({V.MON3})[/-]", 1)).cast("int")
        year = bind(F.regexp_extract(upper, r"([^/-]*)$", 1), lambda tail: F.when(
            F.length(tail) >= 4, F.substring(tail, -4, 4)).when(
            F.length(tail) <= 2, F.concat(F.lit("20"), F.lpad(tail, 2, "0"))))
        valid = F.regexp_extract(year, r"^(?:1[7-9]|2[01])\d{2}$", 0).try_cast("int")
        named = F.when(F.length(upper) >= 7, F.make_date(valid, month, F.lit(1)))
        return F.coalesce(month_start(text), named, _general_date(text))

    return bind(strip(c.cast("string")), read)


def bridge_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Sizing dates: reference forms, then general dates with the month first where both read."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return bind(strip(c.cast("string")), lambda text: F.coalesce(
        reference_date(text), _general_date(text, month_first=True)))
