"""Cost analytics over the month table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.columns import reorder
from wattledger.functions.dates import label, reference_date
from wattledger.functions.numbers import exact_sum, numeric_columns, ratio, sum_or_zero
from wattledger.functions.text import format_brl, page_label, spell_abbreviations
from wattledger.operators.items import item_rows
from wattledger.operators.skew import one_row


def with_reference_date(df: DataFrame) -> DataFrame:
    if "reference_date" in df.columns:
        return df.withColumn("reference_date", F.col("reference_date").try_cast("date"))
    if "referencia" in df.columns:
        return df.withColumn("reference_date", reference_date(F.col("referencia")))
    return df.withColumn("reference_date", F.lit(None).cast("date"))


def date_filter(df: DataFrame, date_range: Sequence | None) -> DataFrame:
    """Both ends included; null dates drop out. No range or no date column: unchanged."""
    if not date_range or len(date_range) != 2 or "reference_date" not in df.columns:
        return df
    return df.filter(F.col("reference_date").between(F.lit(date_range[0]).cast("date"), F.lit(date_range[1]).cast("date")))


def municipality_filter(df: DataFrame, names: list[str]) -> DataFrame:
    """No selection means no rows, not all rows."""
    return df.filter(F.col("municipio").isin(list(names))) if names else df.limit(0)


def with_costs(df: DataFrame, energy_rate: float = V.ENERGY_RATE_RS_KWH, demand_rate: float = V.DEMAND_RATE_RS_KW) -> DataFrame:
    """Estimated and actual cost per row, and which of them counts."""
    df = numeric_columns(df, V.ANALYTICS_NUMBER_COLUMNS, 0.0)
    invoice, items = F.col("total_fatura_rs"), F.col("itens_fatura_total_valor_rs")
    df = df.withColumn("extra_demand_kw", F.greatest("dif_demanda", F.lit(0.0)))
    df = df.withColumns({
        "estimated_energy_cost_rs": F.col("kwh_total_te") * F.lit(float(energy_rate)),
        "estimated_extra_demand_cost_rs": F.col("extra_demand_kw") * F.lit(float(demand_rate)),
        "actual_total_cost_rs": F.when(invoice > 0, invoice).when(items > 0, items),
        "cost_source": F.when(invoice > 0, "actual_fatura").when(items > 0, "actual_itens").otherwise("estimated"),
    })
    df = df.withColumn(
        "estimated_total_cost_rs", F.col("estimated_energy_cost_rs") + F.col("estimated_extra_demand_cost_rs"))
    return df.withColumn("total_cost_rs", F.coalesce("actual_total_cost_rs", "estimated_total_cost_rs"))


def with_page_labels(df: DataFrame) -> DataFrame:
    """File and page as one readable label in both trail columns."""
    for name in ("page_first_seen", "audit_pdf_pages"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    file = next((c for c in ("uploaded_file", "pdf_source") if c in df.columns), None)
    shown = page_label(F.col(file) if file else F.lit(""), F.col("page_first_seen").cast("string"))
    return df.withColumns({"pdf_source": shown, "audit_pdf_pages": shown})


_MONEY = ["kwh_total_te", "extra_demand_kw", "total_cost_rs", "actual_total_cost_rs"]


def monthly_financials(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reference_date").isNotNull()).groupBy("reference_date").agg(
        *[sum_or_zero(F.col(c)).alias(c) for c in _MONEY]).orderBy("reference_date")


def monthly_kwh_by_municipality(df: DataFrame) -> DataFrame:
    known = F.col("reference_date").isNotNull() & F.col("municipio").isNotNull()
    return df.filter(known).groupBy("municipio", "reference_date").agg(
        sum_or_zero(F.col("kwh_total_te")).alias("kwh_total_te")).orderBy("reference_date", "municipio")


def category_kwh(df: DataFrame) -> DataFrame:
    """A missing category is a category."""
    return df.groupBy("categoria").agg(sum_or_zero(F.col("kwh_total_te")).alias("kwh_total_te")).orderBy(
        F.desc("kwh_total_te"), "categoria")


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole) * 100.0, F.lit(0.0))


def municipality_profile(df: DataFrame) -> DataFrame:
    """Benchmark row per municipality."""
    df = numeric_columns(df, ["consumo_hp_kwh", "consumo_fhp_kwh", "kwh_total_te", "extra_demand_kw", "total_cost_rs"], 0.0)
    if "uc" not in df.columns:
        df = df.withColumn("uc", F.lit(""))
    sums = df.filter(F.col("municipio").isNotNull()).groupBy("municipio").agg(
        sum_or_zero(F.col("kwh_total_te")).alias("total_kwh"),
        sum_or_zero(F.col("total_cost_rs")).alias("total_cost_rs"),
        sum_or_zero(F.col("extra_demand_kw")).alias("extra_demand_kw"),
        F.count_distinct("uc").alias("uc_count"),
        sum_or_zero(F.col("consumo_hp_kwh")).alias("hp"),
        sum_or_zero(F.col("consumo_fhp_kwh")).alias("fhp"),
    )
    return sums.select(
        "municipio", "total_kwh", "total_cost_rs", "extra_demand_kw", "uc_count",
        _percent(F.col("hp"), F.col("hp") + F.col("fhp")).alias("peak_share_pct"),
        F.coalesce(ratio(F.col("total_cost_rs"), F.col("total_kwh")), F.lit(0.0)).alias("avg_cost_per_kwh_rs"),
    ).orderBy(F.desc("total_kwh"), "municipio")


def item_summary(items: DataFrame) -> DataFrame:
    return items.filter(F.col("item").isNotNull()).groupBy("item").agg(
        sum_or_zero(F.col("valor_rs")).alias("total_valor_rs"),
        sum_or_zero(F.col("quantidade")).alias("total_quantidade"),
        (exact_sum(F.col("preco_unitario_com_tributos_rs")) / F.count("preco_unitario_com_tributos_rs"))
        .alias("preco_unitario_medio_rs"),
    ).orderBy(F.desc("total_valor_rs"), "item")


def top_items(items: DataFrame, top: int = 15) -> DataFrame:
    return item_summary(items).limit(top)


def _with_uc_label(df: DataFrame) -> DataFrame:
    return df.withColumn("uc_label", F.concat_ws(" | ", F.col("municipio"), F.col("uc")))


def top_units(df: DataFrame, top: int = 15) -> DataFrame:
    known = F.col("municipio").isNotNull() & F.col("uc").isNotNull()
    best = df.filter(known).groupBy("municipio", "uc").agg(
        sum_or_zero(F.col("kwh_total_te")).alias("kwh_total_te")
    ).orderBy(F.desc("kwh_total_te"), "municipio", "uc").limit(top)
    return _with_uc_label(best)


def inefficiency_ranking(df: DataFrame, demand_rate: float = V.DEMAND_RATE_RS_KW, top: int = 25) -> DataFrame:
    """Units by cost of extra demand, then by peak share."""
    df = numeric_columns(df, ["consumo_hp_kwh", "consumo_fhp_kwh", "extra_demand_kw"], 0.0)
    known = F.col("municipio").isNotNull() & F.col("uc").isNotNull()
    sums = df.filter(known).groupBy("municipio", "uc").agg(*[
        sum_or_zero(F.col(c)).alias(c) for c in ("consumo_hp_kwh", "consumo_fhp_kwh", "extra_demand_kw")])
    return sums.select(
        "municipio", "uc", "consumo_hp_kwh", "consumo_fhp_kwh",
        _percent(F.col("consumo_hp_kwh"), F.col("consumo_hp_kwh") + F.col("consumo_fhp_kwh")).alias("peak_share_pct"),
        "extra_demand_kw",
        (F.col("extra_demand_kw") * F.lit(float(demand_rate))).alias("estimated_extra_demand_cost_rs"),
    ).orderBy(F.desc("estimated_extra_demand_cost_rs"), F.desc("peak_share_pct"), "municipio", "uc").limit(top)


def top_extra_demand(df: DataFrame, top: int = 10) -> DataFrame:
    return _with_uc_label(inefficiency_ranking(df)).orderBy(
        F.desc("estimated_extra_demand_cost_rs"), F.desc("peak_share_pct"), "municipio", "uc").limit(top)


def row_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("uc").alias("ucs"),
        F.count_distinct("municipio").alias("municipios"),
        F.count_if(F.col("extra_demand_kw") > 0).alias("extra_demand_events"),
        F.count_if(F.col("total_fatura_rs") > 0).alias("billed_invoices"),
    )


_KPI_SUMS = {
    "total_cost_rs": "total_cost_rs", "actual_cost_rs": "actual_total_cost_rs", "total_kwh": "kwh_total_te",
    "itens_fatura_energia_valor_rs": "itens_fatura_energia_valor_rs",
    "itens_fatura_energia_kwh": "itens_fatura_energia_kwh", "hp_kwh": "consumo_hp_kwh", "fhp_kwh": "consumo_fhp_kwh",
    "extra_demand_kw": "extra_demand_kw", "billed_total_rs": "total_fatura_rs",
}


def kpis(df: DataFrame, demand_rate: float = V.DEMAND_RATE_RS_KW) -> DataFrame:
    """All headline numbers as one row.

    The table is reduced to one row per month once; everything else, the latest
    month and the year to date included, comes from that small table.
    """
    fallback = F.when(F.col("cost_source") == "estimated", F.col("estimated_total_cost_rs"))
    per_month = df.groupBy("reference_date").agg(
        *[sum_or_zero(F.col(c)).alias(n) for n, c in _KPI_SUMS.items()],
        sum_or_zero(fallback).alias("estimated_fallback_cost_rs"),
        F.count_if(F.col("total_fatura_rs") > 0).alias("billed_invoice_count"),
        F.count_if(F.col("extra_demand_kw") > 0).alias("extra_demand_events"),
    )
    month = F.struct(F.col("reference_date").alias("d"), F.col("total_cost_rs").alias("cost"))
    total = per_month.agg(
        *[sum_or_zero(F.col(n)).alias(n) for n in [*_KPI_SUMS, "estimated_fallback_cost_rs"]],
        F.coalesce(F.sum("billed_invoice_count"), F.lit(0)).alias("billed_invoice_count"),
        F.coalesce(F.sum("extra_demand_events"), F.lit(0)).alias("extra_demand_events"),
        F.max("reference_date").alias("latest_month"),
        F.sort_array(F.collect_list(F.when(F.col("reference_date").isNotNull(), month))).alias("__months"),
    )
    same_year = F.filter("__months", lambda m: F.year(m["d"]) == F.year(F.col("latest_month")))
    year_to_date = F.aggregate(
        same_year, F.lit(0).cast("decimal(28,6)"), lambda a, m: (a + m["cost"].cast("decimal(28,6)")).cast("decimal(28,6)")
    ).cast("double")
    by_items = ratio(F.col("itens_fatura_energia_valor_rs"), F.col("itens_fatura_energia_kwh"))
    no_month = F.col("latest_month").isNull()
    return total.select(
        F.when(no_month, F.col("total_cost_rs")).otherwise(
            F.try_element_at("__months", F.lit(-1))["cost"]).alias("total_monthly_cost_rs"),
        F.when(no_month, F.col("total_cost_rs")).otherwise(year_to_date).alias("ytd_spending_rs"),
        F.coalesce(by_items, ratio(F.col("total_cost_rs"), F.col("total_kwh"))).alias("avg_cost_per_kwh_rs"),
        F.when(by_items.isNotNull(), "Itens da Fatura (Valor/Quantidade)").otherwise("Total Cost / Total kWh")
        .alias("avg_cost_per_kwh_source"),
        "itens_fatura_energia_valor_rs", "itens_fatura_energia_kwh", "actual_cost_rs", "estimated_fallback_cost_rs",
        (ratio(F.col("actual_cost_rs"), F.col("total_cost_rs")) * 100.0).alias("actual_cost_share_pct"),
        (ratio(F.col("hp_kwh"), F.col("hp_kwh") + F.col("fhp_kwh")) * 100.0).alias("peak_share_pct"),
        "extra_demand_kw", "billed_total_rs", "billed_invoice_count", "extra_demand_events", "total_cost_rs",
        "total_kwh", (F.col("extra_demand_kw") * F.lit(float(demand_rate))).alias("extra_demand_cost_rs"),
        F.coalesce(label(F.col("latest_month")), F.lit("N/A")).alias("latest_month"),
    )


_SUMMARY_ROWS = [
    ("total_monthly_cost_rs", "latest_month"), ("ytd_spending_rs", "latest_month"),
    ("avg_cost_per_kwh_rs", "filtered period"), ("avg_cost_per_kwh_source", "calculation method"),
    ("itens_fatura_energia_valor_rs", "filtered period"), ("itens_fatura_energia_kwh", "filtered period"),
    ("actual_cost_rs", "filtered period"), ("actual_cost_share_pct", "filtered period"),
    ("peak_share_pct", "filtered period"), ("extra_demand_kw", "filtered period"),
]
_APP_EXTRA_ROWS = [
    ("estimated_fallback_cost_rs", "filtered period"), ("billed_total_rs", "filtered period"),
    ("billed_invoice_count", "filtered period"),
]


def kpi_rows(wide: DataFrame, app_variant: bool = False) -> DataFrame:
    """(metric, value, text, reference): 10 rows, 13 in the app variant. `text` holds the one textual metric."""
    rows = []
    for metric, reference in _SUMMARY_ROWS + (_APP_EXTRA_ROWS if app_variant else []):
        textual = metric == "avg_cost_per_kwh_source"
        rows.append(F.struct(
            F.lit(metric).alias("metric"),
            (F.lit(None) if textual else F.col(metric)).cast("double").alias("value"),
            (F.col(metric) if textual else F.lit(None)).cast("string").alias("text"),
            (F.col("latest_month") if reference == "latest_month" else F.lit(reference)).alias("reference")))
    return wide.select(F.inline(F.array(*rows)))


def benchmark_deltas(selected: DataFrame, pool: DataFrame) -> DataFrame:
    """Selection against the average municipality of a pool; one row."""
    average = municipality_profile(pool).agg(
        (exact_sum(F.col("total_kwh")) / F.count("total_kwh")).alias("avg_kwh"),
        (exact_sum(F.col("peak_share_pct")) / F.count("peak_share_pct")).alias("avg_peak_pct"),
        (exact_sum(F.col("extra_demand_kw")) / F.count("extra_demand_kw")).alias("avg_extra_kw"))
    own = kpis(selected).select("total_kwh", "peak_share_pct", "extra_demand_kw")
    return one_row(own, average).select(
        ((ratio(F.col("total_kwh"), F.col("avg_kwh")) - 1.0) * 100.0).alias("selected_vs_avg_kwh_pct"),
        (F.col("peak_share_pct") - F.col("avg_peak_pct")).alias("peak_share_delta_pp"),
        (F.col("extra_demand_kw") - F.col("avg_extra_kw")).alias("extra_demand_delta_kw"),
        "total_kwh", "peak_share_pct", "extra_demand_kw")


def savings_messages(facts: DataFrame, peak_threshold: float = V.PEAK_THRESHOLD_PCT,
                     energy_rate: float = V.ENERGY_RATE_RS_KWH) -> DataFrame:
    """Advice rows from one row of facts: peak share, extra demand, use above average, cost per kWh.

    With a column `rows` of 0 in it there was nothing to look at, which is the only message then.
    """
    peak, extra = F.col("peak_share_pct"), F.col("extra_demand_kw")
    above, cost = F.col("selected_vs_avg_kwh_pct"), F.col("avg_cost_per_kwh_rs")
    tips = F.array_compact(F.array(
        F.when(peak > peak_threshold, F.format_string(
            "Peak-hour consumption is %.1f%%. Shift discretionary loads outside peak to target <= "
            f"{peak_threshold:.0f}%%.", peak)),
        F.when(extra > 0, F.concat(
            F.lit("Detected "), F.format_number(extra, 2), F.lit(" kW of extra demand, adding about "),
            format_brl(F.col("extra_demand_cost_rs")),
            F.lit(". Review contracted demand and stagger equipment starts."))),
        F.when(above > 10, spell_abbreviations(F.format_string(
            "Usage is %.1f%% above municipality average benchmark. Prioritize audits for top UCs by kWh.", above))),
        F.when(cost > energy_rate * 1.15, spell_abbreviations(F.lit(
            "Average cost per kWh is materially above base tariff. Focus on demand overruns and corrections."))),
    ))
    none = F.array(spell_abbreviations(F.lit(
        "Current profile is close to benchmark. Keep monthly monitoring and focus on top 5 UCs.")))
    advice = F.when(F.size(tips) > 0, tips).otherwise(none)
    if "rows" in facts.columns:
        advice = F.when(F.col("rows") == 0, F.array(F.lit(V.NOTHING_EXTRACTED))).otherwise(advice)
    return facts.select(F.explode(advice).alias("savings_opportunity"))


def savings_opportunities(selected: DataFrame, pool: DataFrame | None = None, **limits) -> DataFrame:
    deltas = benchmark_deltas(selected, selected if pool is None else pool).select("selected_vs_avg_kwh_pct")
    facts = kpis(selected).select("peak_share_pct", "extra_demand_kw", "extra_demand_cost_rs", "avg_cost_per_kwh_rs")
    rows = selected.agg(F.count(F.lit(1)).alias("rows"))
    return savings_messages(one_row(one_row(facts, deltas), rows), **limits)


def analytics_blocks(raw: DataFrame) -> dict[str, DataFrame]:
    """The ten named blocks of the analytics export.

    Every block is derived from one enriched frame; callers that write all of
    them stage it once first (`wattledger.sources.staging.materialize`).
    """
    enriched = with_costs(with_reference_date(with_page_labels(raw)))
    return {
        "displayed_data": reorder(enriched),
        "monthly_kwh": monthly_kwh_by_municipality(enriched),
        "monthly_cost": monthly_financials(enriched),
        "category_kwh": category_kwh(enriched),
        "top_uc_kwh": top_units(enriched),
        "inefficiencies": inefficiency_ranking(enriched),
        "itens_fatura": item_rows(enriched),
        "benchmark": municipality_profile(enriched),
        "summary": kpi_rows(kpis(enriched)),
        "savings_tips": savings_opportunities(enriched),
    }
