"""Number dialects. `1.700` is 1700 in some and 1.7 in others; never mix them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.functions.binding import bind, sql_text
from wattledger.functions.text import strip, strip_sql

_PLAIN = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def plain_number(c: Column) -> Column:
    """A text that is a number as it stands. The guard keeps out Java forms such as `12d`."""
    return F.regexp_extract(c, _PLAIN, 1).try_cast("double")


def as_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Plain coercion of a column of any type; NaN becomes null."""
    if dtype is None or isinstance(dtype, T.StringType):
        return plain_number(c.cast("string"))
    return F.nanvl(c.cast("double"), F.lit(None))


def ptbr_number(c: Column) -> Column:
    """Dots group thousands, the comma is decimal: `1.700` is 1700."""
    return plain_number(F.translate(strip(c), ",.", "."))


def ptbr_sql(text: str) -> str:
    """`ptbr_number` as SQL."""
    bare = f"translate({strip_sql(text)}, ',.', '.')"
    return f"try_cast(regexp_extract({bare}, {sql_text(_PLAIN)}, 1) AS double)"


def ptbr_or_zero(c: Column) -> Column:
    return F.coalesce(ptbr_number(c), F.lit(0.0))


def flexible_number(c: Column) -> Column:
    """Comma means pt-BR; one dot with up to two decimals is decimal; other dots group."""
    def read(c: Column) -> Column:
        return plain_number(
            F.when(c.contains(","), F.translate(c, ",.", "."))
            .when(c.rlike(r"^[^.]*\.[^.]{0,2}$"), c)
            .otherwise(F.translate(c, ".", "")))

    return bind(F.translate(strip(c), " ", ""), read)


def _bare(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"(?i)r\$", "")
    return F.translate(c, " ", "")


def _last_is_decimal(c: Column) -> Column:
    """Both separators present: the last one is decimal."""
    comma_last = F.translate(c, ",.", ".")
    return F.when(c.rlike(r",[^.,]*$"), comma_last).otherwise(F.translate(c, ",", ""))


def brl_number(c: Column) -> Column:
    """Money as typed by people: several commas group, dot groups of three group."""
    def read(c: Column) -> Column:
        return plain_number(
            F.when(c.contains(",") & c.contains("."), _last_is_decimal(c))
            .when(c.rlike(r",.*,"), F.translate(c, ",", ""))
            .when(c.contains(","), F.translate(c, ",", "."))
            .when(c.rlike(r"^\d+(\.\d+){2,}$|^\d+\.\d{3}$"), F.translate(c, ".", ""))
            .otherwise(c))

    return bind(_bare(c), read)


def locale_number(c: Column) -> Column:
    """Like `brl_number`, but a lone dot always is decimal: `1.700` is 1.7."""
    def read(c: Column) -> Column:
        return plain_number(
            F.when(c.contains(",") & c.contains("."), _last_is_decimal(c))
            .otherwise(F.translate(c, ",", ".")))

    return bind(_bare(c), read)


def contract_number(c: Column) -> Column:
    """Contract columns: `1,234.56` has no reading and is null."""
    def read(c: Column) -> Column:
        grouped = c.contains(".") & c.rlike(r",[^.,]*$")
        return plain_number(F.translate(F.when(grouped, F.translate(c, ".", "")).otherwise(c), ",", "."))

    return bind(_bare(c), read)


def number_or_zero(c: Column, dtype: T.DataType | None = None) -> Column:
    return F.coalesce(as_number(c, dtype), F.lit(0.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Null when there is nothing to divide by."""
    return F.when(bottom != 0, top / bottom)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


_MICRO = 1_000_000


def exact_sum(c: Column) -> Column:
    """A sum to six decimals that does not depend on the order of rows, partitions or retries.

    Whole units and millionths are added as two integers: as exact as a decimal
    sum for such amounts, and several times cheaper in wide aggregates.
    """
    whole, millionths = exact_parts(c)
    return exact_total(F.sum(whole), F.sum(millionths))


def exact_parts(c: Column) -> tuple[Column, Column]:
    """(whole units, millionths) of an amount, as integers; NaN and the infinities count as missing."""
    c = F.when(F.abs(c) < float("inf"), c)  # NaN is above infinity here
    unit = F.floor(c)
    return unit, F.rint((c - unit) * float(_MICRO)).cast("bigint")


def exact_total(whole: Column, millionths: Column) -> Column:
    """The amount behind summed parts."""
    scaled = whole.cast("decimal(28,0)") * F.lit(_MICRO).cast("decimal(8,0)") + millionths.cast("decimal(28,0)")
    return (scaled * F.lit("0.000001").cast("decimal(7,6)")).cast("double")


def sum_or_zero(c: Column) -> Column:
    return F.coalesce(exact_sum(c), F.lit(0.0))


def max_positive(c: Column) -> Column:
    return F.coalesce(F.max(positive(c)), F.lit(0.0))


def numeric_columns(df: DataFrame, names: list[str], fill: float | None = None) -> DataFrame:
    """Type several columns as numbers with the column-wide parse choice.

    When any value of a text column is a plain number, the plain parse holds for
    the whole column; otherwise every value is read as money. The flags of all
    text columns come from one aggregate, a single row joined back by broadcast.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [n for n in names if isinstance(types.get(n), T.StringType)]
    default = F.lit(fill).cast("double")
    if texts:
        flags = df.agg(*[
            F.coalesce(F.bool_or(plain_number(F.col(n)).isNotNull()), F.lit(False)).alias(f"__plain_{n}")
            for n in texts
        ])
        df = df.crossJoin(F.broadcast(flags))
    out = {}
    for n in names:
        if n not in types:
            out[n] = default
        elif n in texts:
            out[n] = F.coalesce(
                F.when(F.col(f"__plain_{n}"), plain_number(F.col(n))).otherwise(brl_number(F.col(n))), default)
        else:
            out[n] = F.coalesce(as_number(F.col(n), types[n]), default)
    return df.withColumns(out).drop(*[f"__plain_{n}" for n in texts])
