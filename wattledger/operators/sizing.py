"""Solar sizing per municipality, tariffs inferred from invoices, choice of a record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind
from wattledger.functions.columns import column_type, first_number, header_name, resolve_exact_first
from wattledger.functions.dates import bridge_date, contract_date, index_label, month_index
from wattledger.functions.domain import bridge_class, unique_messages
from wattledger.functions.numbers import as_number, exact_sum, locale_number, numeric_columns, positive, ratio, sum_or_zero
from wattledger.functions.text import spell_abbreviations, strip
from wattledger.operators.rows import numbered

CLASSES = ["B3", "B4A", "A4_HP", "A4_FHP"]
TARIFFS = {"B3": "dim_tariff_b3", "B4A": "dim_tariff_b4a", "A4_HP": "dim_tariff_a4_hp", "A4_FHP": "dim_tariff_a4_fhp"}


@dataclass
class SizingParameters:
    months: int = V.MONTHS_IN_WINDOW
    sun_hours: float = V.SUN_HOURS
    performance_ratio: float = V.PERFORMANCE_RATIO
    days_per_month: float = V.DAYS_PER_MONTH
    a4_hp_factor: float = 1.0
    capex_rs_per_mwp: float = V.CAPEX_RS_PER_MWP

    def __post_init__(self) -> None:
        for name, text in (
            ("months", "months_to_use"), ("sun_hours", "HSP"), ("performance_ratio", "Performance ratio (PR)"),
            ("days_per_month", "Days per month"), ("a4_hp_factor", "A4 HP factor"),
        ):
            if getattr(self, name) <= 0:
                raise ValueError(f"{text} must be greater than 0.")
        if self.capex_rs_per_mwp < 0:
            raise ValueError("CAPEX BRL/MWp cannot be negative.")

    @property
    def kwh_per_kwp_month(self) -> float:
        return float(self.sun_hours) * float(self.performance_ratio) * float(self.days_per_month)


def no_tariffs(spark) -> DataFrame:
    return given_tariffs(spark, {})


def given_tariffs(spark, tariffs: dict[str, float | None]) -> DataFrame:
    """One row of tariffs; what is missing or not positive is null."""
    return spark.range(1).select(*[
        positive(F.lit(tariffs.get(c)).cast("double")).alias(TARIFFS[c]) for c in CLASSES])


def _amount(df: DataFrame, name: str | None) -> Column:
    if name is None:
        return F.lit(0.0)
    return F.coalesce(as_number(F.col(f"`{name}`"), column_type(df, name)), F.lit(0.0))


def municipal_sizing(
    df: DataFrame, parameters: SizingParameters | None = None, tariffs: DataFrame | None = None, source_label: str = "",
) -> DataFrame:
    """One sizing record per municipality; its window ends at its own latest month.

    Rows are first reduced to (municipality, month); the per-municipality step
    then handles months only, so a municipality of any size costs the same.
    """
    p = parameters or SizingParameters()
    bound = {k: resolve_exact_first(df.columns, a) for k, a in V.SIZING_ALIASES.items()}
    if bound["date"] is None:
        raise ValueError("No reference date column found.")
    date = bridge_date(F.col(f"`{bound['date']}`"), column_type(df, bound["date"]))
    town = strip(F.col(f"`{bound['municipio']}`").cast("string")) if bound["municipio"] else F.lit("NAO INFORMADO")
    klass = bridge_class(F.coalesce(F.col(f"`{bound['class']}`").cast("string"), F.lit(""))) if bound["class"] else F.lit("OUTROS")
    no_split = bound["a4_hp"] is None and bound["a4_fhp"] is None
    off_peak = bound["a4_total"] if no_split else bound["a4_fhp"]
    rows = df.select(
        town.alias("municipio"), month_index(date).alias("ix"), klass.alias("klass"),
        _amount(df, bound["b3_ip"]).alias("b"), _amount(df, bound["a4_hp"]).alias("hp"),
        _amount(df, off_peak).alias("fhp"),
    ).filter(F.col("ix").isNotNull())
    k = F.col("klass")
    per_month = rows.groupBy("municipio", "ix").agg(
        sum_or_zero(F.when(k == "B3", F.col("b"))).alias("B3"),
        sum_or_zero(F.when(k == "IP", F.col("b"))).alias("B4A"),
        sum_or_zero(F.when(k == "A4", F.col("hp"))).alias("A4_HP"),
        sum_or_zero(F.when(k == "A4", F.col("fhp"))).alias("A4_FHP"),
    )
    per_town = per_month.groupBy("municipio").agg(
        F.max("ix").alias("last"), F.collect_list(F.struct("ix", *CLASSES)).alias("months"))  # one entry per month

    def series(c: str) -> Column:
        return F.transform(
            F.sequence(F.col("last") - (p.months - 1), F.col("last")),
            lambda i: F.coalesce(F.get(F.filter("months", lambda m: m["ix"] == i), F.lit(0))[c], F.lit(0.0)))

    def mean(c: str) -> Column:
        total = F.aggregate(F.col(f"s_{c}"), F.lit(0).cast("decimal(38,6)"),
                            lambda a, x: (a + x.cast("decimal(28,6)")).cast("decimal(38,6)"))
        return total.cast("double") / F.lit(float(p.months))

    sized = per_town.select(
        "municipio",
        F.transform(F.sequence(F.col("last") - (p.months - 1), F.col("last")), index_label).alias("month_labels"),
        *[series(c).alias(f"s_{c}") for c in CLASSES],
    ).withColumns({f"c_{c}": mean(c) for c in CLASSES})
    factor = {c: p.a4_hp_factor if c == "A4_HP" else 1.0 for c in CLASSES}
    sized = sized.withColumns({
        f"k_{c}": F.col(f"c_{c}") / F.lit(p.kwh_per_kwp_month) / F.lit(float(factor[c])) for c in CLASSES})
    sized = sized.withColumn("kwp", F.col("k_B3") + F.col("k_B4A") + F.col("k_A4_HP") + F.col("k_A4_FHP"))
    sized = sized.withColumn("mwp", F.col("kwp") / 1000.0).withColumn(
        "investment_brl", F.col("mwp") * F.lit(float(p.capex_rs_per_mwp)))

    tariffs = no_tariffs(df.sparkSession) if tariffs is None else tariffs
    sized = sized.crossJoin(F.broadcast(tariffs))  # one row
    sized = sized.withColumns({
        f"cost_{c}": F.when(F.col(f"c_{c}") <= 0, 0.0).otherwise(F.col(f"c_{c}") * F.col(TARIFFS[c])) for c in CLASSES})
    costs = [F.col(f"cost_{c}") for c in CLASSES]
    total_cost = costs[0] + costs[1] + costs[2] + costs[3]  # null as soon as one class lacks its tariff
    sized = sized.withColumn("total_cost", total_cost)

    def by_class(prefix: str, extra: dict[str, Column] | None = None) -> Column:
        pairs = {c: F.col(f"{prefix}_{c}") for c in CLASSES} | (extra or {})
        return F.create_map(*[x for key, v in pairs.items() for x in (F.lit(key), v)])

    return sized.select(
        "municipio", F.lit("Dimensionamento Previo UFV").alias("cenario"), "mwp", "kwp",
        ((F.col("c_B3") + F.col("c_B4A") + F.col("c_A4_HP") + F.col("c_A4_FHP")) * F.lit(float(p.months))).alias("total_kwh"),
        F.lit(source_label).alias("source_file"), F.lit(p.months).alias("months_to_use"), "month_labels",
        by_class("c").alias("consumo_medio_mensal_kwh"),
        by_class("s").alias("consumo_mensal_janela_kwh"),
        by_class("k").alias("ufv_kwp_por_categoria"),
        F.lit(p.kwh_per_kwp_month).alias("generation_kwh_per_kwp_month"), "investment_brl",
        F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.col(TARIFFS[c]))]).alias("tariff_rs_kwh"),
        by_class("cost", {"TOTAL": F.col("total_cost")}).alias("monthly_energy_cost_brl"),
        ratio(F.col("investment_brl"), positive(F.col("total_cost"))).alias("payback_months"),
        F.col("total_cost").isNull().alias("payback_needs_tariff_input"),
        F.array(*([F.lit(V.SIZING_NO_PEAK_SPLIT)] if no_split else [])).cast("array<string>").alias("warnings"),
    )


def weighted_price(price: Column, weight: Column, where: Column) -> Column:
    """Aggregate: weighted mean of positive prices, plain mean without any positive weight, else null."""
    p = F.when(where & (price > 0), price)
    w = F.when(p.isNotNull() & (weight > 0), weight)
    weighted = exact_sum(F.when(w.isNotNull(), p * w)) / exact_sum(w)
    return F.coalesce(weighted, exact_sum(p) / F.count(p))


def infer_tariffs(df: DataFrame) -> DataFrame:
    """One row with the four tariffs an invoice table supports; null where it does not."""
    names = [c for group in V.TARIFF_PRICE_COLUMNS.values() for c in group]
    present = {header: c for c in df.columns for header in [header_name(c)]}
    typed = numeric_columns(df, [present[n] for n in dict.fromkeys(names) if n in present])

    def of(group: str) -> Column:
        return first_number(typed, V.TARIFF_PRICE_COLUMNS[group])

    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
             for c in ("categoria", "subgrupo", "classificacao_uc", "grupo_tensao")]
    rows = typed.select(
        F.upper(F.concat_ws(" ", *parts)).alias("klass"),
        *[of(g).alias(g) for g in V.TARIFF_PRICE_COLUMNS])
    derived = F.when((F.col("energy_value") > 0) & (F.col("energy_kwh") > 0), F.col("energy_value") / F.col("energy_kwh"))
    rows = rows.withColumn("blended", F.coalesce(F.col("blended"), derived))
    rows = rows.withColumns({
        "hp_price": F.coalesce("hp_price", "blended"), "fhp_price": F.coalesce("fhp_price", "blended")})
    k, c = F.col("klass"), F.col
    return rows.agg(
        weighted_price(c("blended"), c("b_weight"), k.rlike(r"\bB3\b")).alias(TARIFFS["B3"]),
        weighted_price(c("blended"), c("b_weight"), k.rlike(r"\b(IP|B4A|B4B)\b")).alias(TARIFFS["B4A"]),
        weighted_price(c("hp_price"), c("hp_weight"), k.rlike(r"\bA4\b")).alias(TARIFFS["A4_HP"]),
        weighted_price(c("fhp_price"), c("fhp_weight"), k.rlike(r"\bA4\b")).alias(TARIFFS["A4_FHP"]),
    )


def sizing_with_inferred_tariffs(df: DataFrame, parameters: SizingParameters | None = None, source_label: str = "") -> DataFrame:
    """Sizing with the tariffs its own invoices imply, so payback needs no input where they suffice."""
    return municipal_sizing(df, parameters, infer_tariffs(df), source_label)


def needs_tariff_rerun(records: DataFrame) -> DataFrame:
    """Records whose payback waits for tariffs; sizing is rerun only when there are any."""
    return records.filter(F.col("payback_months").isNull() & F.col("payback_needs_tariff_input"))


def select_record(records: DataFrame, preferred: str = "") -> DataFrame:
    """The preferred municipality, else the one with the largest plant; ties by name."""
    wanted = str(preferred or "").strip().lower()
    match = (strip(F.lower("municipio")) == wanted) & (F.lit(wanted) != "")
    return records.withColumn("is_preferred", match).orderBy(
        F.desc("is_preferred"), F.when(F.col("is_preferred"), 0.0).otherwise(-F.col("mwp")), "municipio").limit(1)


_REFERENCE_NAMES = ["reference_date", "data_referencia", "referencia", "competencia", "mes_referencia"]


def review_warnings(raw: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """One row: messages about an invoice table, from one aggregate."""
    names = {header_name(c): c for c in raw.columns}
    supplies = [c for n, c in names.items() if "tipo_fornecimento" in n]
    category = names.get("categoria")
    reference = next((names[n] for n in _REFERENCE_NAMES if n in names), None)

    def text(c: str) -> Column:
        return strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))

    has_supply = F.lit(False)
    for c in supplies:
        has_supply = has_supply | (text(c) != "")
    month = F.lit(None).cast("date")
    if reference:
        month = F.trunc(contract_date(F.col(f"`{reference}`"), column_type(raw, reference)), "MM")
    unknown = F.upper(text(category)).isin(V.UNKNOWN_CATEGORIES) if category else F.lit(False)
    facts = raw.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_or(has_supply), F.lit(False)).alias("has_supply"),
        F.coalesce(F.bool_or(unknown), F.lit(False)).alias("unknown_category"), F.count_distinct(month).alias("months"))
    uncertain = "Categoria/fornecimento com deteccao incerta (needs_review)."
    listed = F.array_compact(F.array(
        F.when(F.lit("itens_fatura_energia_kwh" not in names),
               spell_abbreviations(F.lit("Fonte kWh fallback (nao veio de Itens da Fatura)."))),
        F.when(~F.col("has_supply"), F.lit("Tipo fornecimento ausente.")),
        F.when(F.col("unknown_category"), F.lit(uncertain)) if category
        else F.lit("Categoria ausente no extraido (needs_review)."),
        F.when(F.lit(reference is not None) & (F.col("months") < months),
               spell_abbreviations(F.lit("UC com meses faltantes -> zeros preenchidos."))),
    ))
    empty = F.array(F.lit("Sem dataframe bruto para validacao detalhada (needs_review)."))
    return facts.select(F.when(F.col("rows") > 0, listed).otherwise(empty).alias("raw_warnings"))


def dimension(records: DataFrame, raw: DataFrame | None = None, preferred: str = "", months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """One row: the chosen record, its totals and every warning about it."""
    chosen = select_record(records, preferred).crossJoin(F.broadcast(records.agg(F.count(F.lit(1)).alias("records"))))
    if raw is None:
        no_raw = F.array(F.lit("Sem dataframe bruto para validacao detalhada (needs_review)."))
        chosen = chosen.withColumn("raw_warnings", no_raw)
    else:
        chosen = chosen.crossJoin(F.broadcast(review_warnings(raw, months)))
    own = F.array_compact(F.array(
        F.when(~F.col("is_preferred") & (F.col("records") > 1), spell_abbreviations(
            F.lit("Multiplos cenarios detectados; usado o de maior MWp."))),
        F.when(F.col("payback_needs_tariff_input"), F.lit("Tarifa ausente -> payback indisponivel/estimado.")),
    ))
    return chosen.withColumn("all_warnings", unique_messages(own, F.col("raw_warnings"), F.col("warnings"))).select(
        "municipio", F.col("mwp").alias("mwp_ac"), F.col("kwp").alias("kwp_total"),
        F.col("consumo_medio_mensal_kwh").alias("category_totals"), "month_labels",
        F.col("all_warnings").alias("warnings"),
        F.exists("all_warnings", lambda m: F.lower(m).contains("needs_review")).alias("needs_review"))


def month_coverage(raw: DataFrame, reference: str = "referencia") -> DataFrame:
    """One row: number of distinct valid months."""
    return raw.agg(F.count_distinct(F.trunc(contract_date(F.col(reference)), "MM")).alias("month_count"))


def read_sizing_summary(df: DataFrame, source_label: str = "") -> DataFrame:
    """Earlier sizing summaries of any header spelling; rows without any power drop out."""
    def find(*targets: str) -> str | None:
        return next((c for t in targets for c in df.columns if t in " ".join(header_name(c).replace("_", " ").split())), None)

    town, scenario = find("municipio"), find("cenario")
    mwp, kwp = find("potencia necessaria mwp"), find("potencia necessaria kwp")
    yield_, total = find("produtividade"), next(
        (c for c in df.columns if "total" in header_name(c) and "kwh" in header_name(c)), None)

    def number(c: str | None) -> Column:
        if c is None:
            return F.lit(None).cast("double")
        return locale_number(F.col(f"`{c}`").cast("string"))

    def text(c: str | None) -> Column:
        return strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c else F.lit("")

    rows = numbered(df, "pos").select(
        text(town).alias("municipio"), text(scenario).alias("name"), number(mwp).alias("given_mwp"),
        number(kwp).alias("given_kwp"), number(yield_).alias("produtividade_kwh_kwp_ano"), number(total).alias("total_kwh"),
        (F.col("pos") + 1).alias("pos"))
    rows = rows.withColumn("mwp", F.coalesce("given_mwp", F.col("given_kwp") / 1000.0)).filter("mwp is not null")
    named = bind(F.col("name"), lambda n: F.when(n != "", n))
    return rows.select(
        "municipio", F.coalesce(named, F.format_string("Scenario Row %d", "pos")).alias("cenario"), "mwp",
        F.coalesce("given_kwp", F.col("mwp") * 1000.0).alias("kwp"), "produtividade_kwh_kwp_ano", "total_kwh",
        F.lit(source_label).alias("source_file"))
