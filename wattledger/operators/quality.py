"""Quality report of a standardized contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.dates import iso_label
from wattledger.functions.domain import messages
from wattledger.functions.numbers import exact_parts, exact_total, sum_or_zero
from wattledger.operators.skew import one_row
from wattledger.sources.staging import materialize

_TRACE = ["municipio", "uc", "consumer_class", "source_file"]


_WORD = 64
_FACTS = ["__rows", "__null", "__nonpositive", "__whole", "__millionths", "__no_reference", "__latest", "__word", "__months"]


def contract_facts(df: DataFrame) -> DataFrame:
    """What every table of the report needs, per unit with its attributes and word of months: one read of the contract.

    Rows are counted by kind and kWh added up in exact parts. Months (`yyyy-MM` labels) are bits of 64-month words that
    `bit_or` gathers, so a unit ships eight bytes for five years, however many rows it has. Columns that a contract lacks are null.
    """
    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    month = column("reference_month", "string")
    index = F.when(month.rlike(r"^\d{4}-\d{2}$"), F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1)
    kwh = column("consumption_kwh", "double")
    rows = df.select(
        *[column(c, "string").alias(c) for c in _TRACE], kwh.alias("kwh"), (F.coalesce(kwh, F.lit(0.0)) <= 0).alias("nonpositive"),
        column("reference_date", "date").alias("day"), index.alias("index"))
    whole, millionths = exact_parts(F.col("kwh"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("index", F.lit(_WORD)))
    return rows.groupBy(*_TRACE, F.floor(F.col("index") / _WORD).alias("__word")).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(F.col("kwh").isNull()).alias("__null"), F.count_if("nonpositive").alias("__nonpositive"),
        F.sum(whole).alias("__whole"), F.sum(millionths).alias("__millionths"), F.count_if(F.col("day").isNull()).alias("__no_reference"),
        F.max("day").alias("__latest"), F.bit_or(bit).alias("__months"))


def _facts(df: DataFrame) -> DataFrame:
    return df if set(_FACTS) <= set(df.columns) else contract_facts(df)


def _kwh() -> Column:
    return F.coalesce(exact_total(F.sum("__whole"), F.sum("__millionths")), F.lit(0.0))


def _labels(word: Column, bits: Column) -> Column:
    """The ascending `yyyy-MM` labels of a word of months."""
    on = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda b: F.getbit(bits, b) == 1)

    def label(b: Column) -> Column:
        index = (word * _WORD + b).cast("int")
        return F.format_string("%04d-%02d", F.floor(index / 12), F.pmod(index, F.lit(12)) + 1)

    return F.transform(on, label)


def class_totals(df: DataFrame) -> DataFrame:
    """One row: kWh of B3, IP, A4, OUTROS and their TOTAL; rows without a class are in none of them."""
    sums = df.agg(*[
        sum_or_zero(F.when(F.col("consumer_class") == c, F.col("consumption_kwh"))).alias(c)
        for c in ("B3", "IP", "A4", "OUTROS")])
    return sums.withColumn("TOTAL", F.col("B3") + F.col("IP") + F.col("A4") + F.col("OUTROS"))


def null_zero_stats(df: DataFrame) -> DataFrame:
    """Rows, null kWh and kWh <= 0 of the three main classes; a class without rows shows zeros. A contract or its facts."""
    names = V.QUALITY_CLASSES
    kinds = {"rows": "__rows", "null": "__null", "zero": "__nonpositive"}
    wide = _facts(df).agg(*[
        F.coalesce(F.sum(F.when(F.col("consumer_class") == c, F.col(counted))), F.lit(0)).alias(f"{c}_{kind}")
        for c in names for kind, counted in kinds.items()])

    def share(part: str, c: str) -> Column:
        return F.when(F.col(f"{c}_rows") > 0, F.col(f"{c}_{part}") / F.col(f"{c}_rows")).otherwise(0.0)

    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("consumer_class"), F.col(f"{c}_rows").alias("rows"),
            F.col(f"{c}_null").alias("null_kwh_rows"), F.col(f"{c}_zero").alias("zero_or_negative_kwh_rows"),
            share("null", c).alias("null_kwh_pct"), share("zero", c).alias("zero_or_negative_kwh_pct"))
        for c in names])))


def expected_months(df: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """One row: ascending `yyyy-MM` labels ending at the latest month, or at today's without any. A contract or its facts."""
    last = F.coalesce(F.trunc(F.max("__latest"), "MM"), F.trunc(F.current_date(), "MM"))
    grid = _facts(df).agg(last.alias("last")).select(
        F.sequence(F.add_months("last", -(months - 1)), F.col("last"), F.expr("interval 1 month")).alias("d"))
    return grid.select(F.transform("d", iso_label).alias("expected"))


def months_available(df: DataFrame) -> DataFrame:
    """The distinct months, ascending. A contract or its facts."""
    words = _facts(df).filter("__word is not null").groupBy("__word").agg(F.bit_or("__months").alias("__months"))
    return words.select(F.explode(_labels(F.col("__word"), F.col("__months"))).alias("reference_month")).orderBy("reference_month")


def _per_unit(df: DataFrame) -> DataFrame:
    """One row per UC; its months are the bits of a few words. The sample attributes are the smallest pair."""
    words = _facts(df).groupBy("uc", "__word").agg(
        F.min(F.struct("municipio", "consumer_class")).alias("w"), F.bit_or("__months").alias("__months"), F.sum("__rows").alias("rows"),
        F.sum("__nonpositive").alias("nonpositive"), F.sum("__whole").alias("__whole"), F.sum("__millionths").alias("__millionths"))
    months = F.collect_list(F.when(F.col("__word").isNotNull(), F.struct("__word", "__months")))
    return words.groupBy("uc").agg(
        F.min("w").alias("w"), F.flatten(F.transform(F.array_sort(months), lambda m: _labels(m["__word"], m["__months"]))).alias("present"),
        F.sum("rows").alias("rows"), _kwh().alias("total_kwh"), (F.sum("rows") == F.sum("nonpositive")).alias("all_zero"),
    ).select("uc", "w.*", "present", "rows", "total_kwh", "all_zero")


def first_of(df: DataFrame, order: list[Column | str], top: int | None) -> DataFrame:
    """All rows, or the `top` first ones of an order."""
    return df if top is None else df.orderBy(*order).limit(top)


def units_missing_months(df: DataFrame, months: int = V.MONTHS_IN_WINDOW, top: int | None = None) -> DataFrame:
    """UCs with gaps in the window, which ends at the latest month of the whole table; `top` keeps those with most gaps."""
    rows = one_row(_per_unit(df), expected_months(df, months)).withColumn(
        "missing", F.array_sort(F.array_except("expected", "present")))
    rows = rows.filter(F.size("missing") > 0).select(
        "uc", "municipio", "consumer_class", F.size("present").alias("months_present_count"),
        F.size("missing").alias("missing_months_count"),
        F.array_join("missing", ", ").alias("missing_months"),
    )
    return first_of(rows, [F.desc("missing_months_count"), "uc"], top)


def units_all_zero(df: DataFrame, top: int | None = None) -> DataFrame:
    rows = _per_unit(df).filter("all_zero").select("uc", "municipio", "consumer_class", "rows", "total_kwh")
    return first_of(rows, [F.desc("rows"), "uc"], top)


def rows_without_reference(df: DataFrame, top: int | None = None) -> DataFrame:
    present = [c for c in _TRACE if c in df.columns]
    return first_of(_facts(df).filter("__no_reference > 0").select(*present).distinct(), present, top)


def quality_summary(df: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """One row: counts over the whole table, messages and whether any of them is critical. A contract or its facts."""
    found = _facts(df)

    def counted(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    rows = found.agg(
        counted("__rows").alias("total_rows"), F.count_distinct("uc").alias("unique_ucs"), counted("__no_reference").alias("missing_reference_count"),
        counted("__nonpositive").alias("nonpositive_rows"))
    words = found.groupBy("__word").agg(F.bit_or("__months").alias("m")).agg(F.coalesce(F.sum(F.bit_count("m")), F.lit(0)).alias("month_count"))
    facts = one_row(rows, words).select("total_rows", "unique_ucs", "month_count", "missing_reference_count", "nonpositive_rows")
    zero = found.groupBy("uc").agg((F.sum("__rows") == F.sum("__nonpositive")).alias("all_zero")).agg(F.count_if("all_zero").alias("zero_ucs"))
    row = one_row(facts, zero)
    c = F.col
    share = c("nonpositive_rows") / F.nullif(c("total_rows"), F.lit(0))
    rules = messages(
        F.when(c("unique_ucs") == 0, F.lit("Nenhuma UC valida encontrada.")),
        F.when(c("month_count") < months, F.format_string(
            f"Meses disponiveis (%d) abaixo do esperado ({months}).", c("month_count"))),
        F.when(c("missing_reference_count") > 0, F.format_string(
            "Existem %d linhas sem referencia valida.", c("missing_reference_count"))),
        F.when(share > V.QUALITY_NONPOSITIVE_LIMIT, F.lit("Mais de 30% das linhas estao com kWh nulo/zero/negativo.")),
        F.when(c("zero_ucs") > 0, F.format_string(
            "Existem %d UCs com kWh zerado em todos os registros.", c("zero_ucs"))),
    )
    empty = F.array(F.lit("Contrato vazio apos adaptacao."))
    return row.withColumn("critical_messages", F.when(c("total_rows") == 0, empty).otherwise(rules)).withColumn(
        "is_critical", F.size("critical_messages") > 0)


def quality_report(df: DataFrame, months: int = V.MONTHS_IN_WINDOW, top: int | None = None) -> dict[str, DataFrame]:
    """All tables of the report, from one read of the contract: its facts are written once and each table reads these."""
    facts = materialize(contract_facts(df))
    return {
        "summary": quality_summary(facts, months),
        "expected_months": expected_months(facts, months).select(F.explode("expected").alias("month")),
        "months_available": months_available(facts),
        "null_zero_stats_by_class": null_zero_stats(facts),
        "missing_references_list": rows_without_reference(facts, top),
        "ucs_with_missing_months": units_missing_months(facts, months, top),
        "ucs_all_zero_kwh": units_all_zero(facts, top),
    }
