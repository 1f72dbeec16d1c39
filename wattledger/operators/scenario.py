"""Scenarios: equipment, electrical sizing, priced line items, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind
from wattledger.functions.domain import message, messages
from wattledger.functions.numbers import exact_sum, locale_number
from wattledger.functions.text import found, strip

_EQUIPMENT_PRICES = [
    "module_price_sem_override", "module_price_com_override", "inverter_price_sem_override", "inverter_price_com_override",
]
BOS_FIELDS = ["enabled", "scaling_rule", "unit_price_sem", "unit_price_com", *V.BOS_QUANTITIES]


# ------------------------------------------------------------------ defaults
def default_bos_overrides(names: DataFrame, bos: DataFrame) -> DataFrame:
    """(scenario, item_code, ...) for every scenario and catalog item."""
    items = bos.filter(F.coalesce("item_code", F.lit("")) != "").select(
        "item_code", F.lit(True).alias("enabled"),
        F.coalesce("scaling_rule", F.lit("fixed")).alias("scaling_rule"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("unit_price_sem", "unit_price_com")],
        *[F.col(c).cast("double").alias(c) for c in V.BOS_QUANTITIES])
    return items.crossJoin(names.select(F.col("name").alias("scenario"))).select("scenario", "item_code", *BOS_FIELDS)


def complete_bos_overrides(existing: DataFrame, names: DataFrame, bos: DataFrame) -> DataFrame:
    """Existing overrides stay as they are; missing catalog items are added."""
    missing = default_bos_overrides(names, bos).join(existing, ["scenario", "item_code"], "left_anti")
    return existing.select("scenario", "item_code", *BOS_FIELDS).unionByName(missing)


def scenario_names(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in V.SCENARIO_NAMES])).alias("name"))


def first_value(catalog: DataFrame, column: str, default: str, name: str) -> DataFrame:
    """One row: the value of the first catalog row (by `pos`), or a default."""
    first = catalog.agg(F.min_by(F.col(column), F.col("pos")).alias("v"))
    return first.select(F.coalesce("v", F.lit(default)).alias(name))


def complete_scenarios(existing: DataFrame | None, spark, modules: DataFrame, inverters: DataFrame, versions: DataFrame) -> DataFrame:
    """The three standard scenarios, every blank filled with its default, nothing given overwritten."""
    defaults = scenario_names(spark).crossJoin(
        F.broadcast(first_value(versions, "version_id", "PV-BASE", "pricing_version"))
    ).crossJoin(F.broadcast(first_value(modules, "model", "", "module_model"))
    ).crossJoin(F.broadcast(first_value(inverters, "model", "", "inverter_model")))
    number = {"modules_per_string": "int", "strings_per_combiner": "int"}
    defaults = defaults.withColumns({
        **{k: F.lit(v).cast(number.get(k, "double")) for k, v in V.SCENARIO_DEFAULTS.items()},
        **{p: F.lit(None).cast("double") for p in _EQUIPMENT_PRICES},
    })
    if existing is None:
        return defaults
    given = existing.select(
        "name", *[F.col(c).alias(f"__{c}") for c in defaults.columns if c != "name" and c in existing.columns])
    merged = defaults.join(given, "name", "full")
    return merged.select("name", *[
        (F.coalesce(F.col(f"__{c}"), F.col(c)) if f"__{c}" in merged.columns else F.col(c)).alias(c)
        for c in defaults.columns if c != "name"])


# ------------------------------------------------------------------ equipment
def by_model(scenarios: DataFrame, catalog: DataFrame, model_column: str, prefix: str) -> DataFrame:
    """First catalog row of the scenario's model, else the first row of the catalog.

    `catalog` carries its row order in `pos`.
    """
    fields = [c for c in catalog.columns if c not in ("model", "pos")]
    row = F.struct("model", *fields)
    firsts = catalog.groupBy("model").agg(F.min_by(row, F.col("pos")).alias("hit")).withColumnRenamed("model", model_column)
    fallback = catalog.agg(F.min_by(row, F.col("pos")).alias("first"))
    joined = scenarios.join(firsts, model_column, "left").crossJoin(F.broadcast(fallback))
    chosen = F.coalesce("hit", "first")
    return joined.withColumns(
        {f"{prefix}_{f}": chosen[f] for f in ["model", *fields] if f"{prefix}_{f}" != model_column}
        | {f"{prefix}_resolved": chosen["model"]}).drop("hit", "first")


def resolve_equipment(scenarios: DataFrame, modules: DataFrame, inverters: DataFrame) -> DataFrame:
    return by_model(by_model(scenarios, modules, "module_model", "module"), inverters, "inverter_model", "inverter")


def with_version(scenarios: DataFrame, versions: DataFrame) -> DataFrame:
    """Date, description and source of each scenario's pricing version."""
    firsts = versions.groupBy("version_id").agg(
        F.min_by(F.struct("date", "description", "source"), F.col("pos")).alias("v"))
    return scenarios.join(firsts.withColumnRenamed("version_id", "pricing_version"), "pricing_version", "left").select(
        scenarios.columns + [F.col("v.date").alias("version_date"), F.col("v.description").alias("version_description"),
                             F.col("v.source").alias("version_source")])


def effective_price(override: Column, catalog: Column) -> Column:
    """Zero is a valid override."""
    return F.coalesce(override, catalog)


def temperature_voltage(voltage: Column, coefficient: Column, celsius: float) -> Column:
    return voltage * (F.lit(1.0) + coefficient / 100.0 * F.lit(celsius - V.STC_TEMP_C))


def size_scenarios(df: DataFrame) -> DataFrame:
    """Strings, combiners, voltages, equipment cost and range warnings per scenario row.

    `df`: scenario columns with `mwp_ac`, joined with its module and inverter.
    """
    c = F.col
    per_string = c("modules_per_string")
    df = df.withColumn("ac_kwp", c("mwp_ac") * 1000.0).withColumn("dc_kwp", c("ac_kwp") * c("dc_ac_ratio"))
    df = df.withColumns({
        "module_count": F.ceil(c("dc_kwp") / (c("module_wp") / 1000.0)),
        "inverter_qty": F.ceil(c("ac_kwp") / c("inverter_kw")),
    })
    df = df.withColumn("strings", F.ceil(c("module_count") / per_string))
    df = df.withColumn("combiners", F.ceil(c("strings") / c("strings_per_combiner")))
    coefficient = F.coalesce("module_temp_coeff_voc", F.lit(0.0))
    df = df.withColumns({
        "combiners_with_spare": F.ceil(c("combiners") * c("spare_factor")),
        "vstring_vmp_stc": per_string * c("module_vmp"),
        "vstring_voc_cold": per_string * temperature_voltage(c("module_voc"), coefficient, V.MIN_AMBIENT_C),
        "vstring_vmp_hot": per_string * temperature_voltage(c("module_vmp"), coefficient, V.MAX_CELL_C),
    })
    for bdi in ("sem", "com"):
        df = df.withColumns({
            f"module_price_{bdi}": effective_price(c(f"module_price_{bdi}_override"), c(f"module_price_{bdi}_bdi_per_kwp")),
            f"inverter_price_{bdi}": effective_price(c(f"inverter_price_{bdi}_override"), c(f"inverter_price_{bdi}_bdi")),
        })
        df = df.withColumns({
            f"modules_cost_{bdi}": c("dc_kwp") * c(f"module_price_{bdi}"),
            f"inverters_cost_{bdi}": c("inverter_qty") * c(f"inverter_price_{bdi}"),
        }).withColumn(f"modules_inverters_total_{bdi}", c(f"modules_cost_{bdi}") + c(f"inverters_cost_{bdi}"))
    low, high, cold, hot = c("inverter_mppt_min_v"), c("inverter_mppt_max_v"), V.MIN_AMBIENT_C, V.MAX_CELL_C
    warnings = messages(
        F.when((c("dc_ac_ratio") < V.DC_AC_MIN) | (c("dc_ac_ratio") > V.DC_AC_MAX), F.format_string(
            f"Razao DC/AC %.2f fora da faixa recomendada [{V.DC_AC_MIN:.2f}, {V.DC_AC_MAX:.2f}].", "dc_ac_ratio")),
        F.when(c("vstring_vmp_stc") < low, F.format_string(
            "Vmp da string em STC (%.0fV) abaixo do MPPT minimo (%.0fV).", c("vstring_vmp_stc"), low)),
        F.when(c("vstring_vmp_stc") > high, F.format_string(
            "Vmp da string em STC (%.0fV) acima do MPPT maximo (%.0fV).", c("vstring_vmp_stc"), high)),
        F.when(c("vstring_voc_cold") > high, F.format_string(
            f"Voc da string no frio (%.0fV em {cold:.0f}C) acima do MPPT maximo (%.0fV).", c("vstring_voc_cold"), high)),
        F.when(c("vstring_vmp_hot") < low, F.format_string(
            f"Vmp da string no quente (%.0fV em {hot:.0f}C de celula) abaixo do MPPT minimo (%.0fV).",
            c("vstring_vmp_hot"), low)),
    )
    return df.withColumn("warnings", warnings)


# ------------------------------------------------------------------ line items
def map_items(raw: DataFrame) -> DataFrame:
    """Rows of a line-item map `{reference_mwp_ac, reference_dc_kwp, sheets: [{sheet_name, rows: [...]}]}`."""
    sheets = raw.select("reference_mwp_ac", "reference_dc_kwp", F.posexplode("sheets").alias("sheet_pos", "s"))
    rows = sheets.select("reference_mwp_ac", "reference_dc_kwp", "sheet_pos", F.col("s.sheet_name").alias("sheet_name"),
                         F.posexplode("s.rows").alias("row_pos", "r"))
    return normalize_items(rows.select("reference_mwp_ac", "reference_dc_kwp", "sheet_pos", "row_pos", "sheet_name", "r.*"))


_MAP_NUMBERS = ("reference_mwp_ac", "reference_dc_kwp", "base_quantity", "base_price_sem", "base_price_com")
_MAP_TEXTS = ("item_code", "description", "scaling_rule", "rounding", "lookup_key")
_MAP_FLAGS = ("has_quantity", "has_price_sem", "has_price_com", "default_enabled")


def drifting_items(maps: DataFrame, text: str) -> DataFrame:
    """Rows of line-item maps in JSON text whose fields change their type from row to row; all other columns stay.

    The map is read as a variant, so one odd value voids no other. `unreadable` names the fields of a row that are there but have
    no reading (they get their default), `row` where the row is no object and `map` where the text is no map.
    """
    kept = [F.col(f"`{c}`") for c in maps.columns if c != text]
    sheets = maps.select(*kept, F.posexplode_outer(F.try_variant_get(F.try_parse_json(text), "$.sheets", "array<variant>")).alias("sheet_pos", "s"), F.try_parse_json(text).alias("m"))
    rows = sheets.select("*", F.try_variant_get("s", "$.sheet_name", "string").alias("sheet_name"), F.posexplode_outer(F.try_variant_get("s", "$.rows", "array<variant>")).alias("row_pos", "r"))

    def value(name: str, kind: str) -> Column:
        return F.try_variant_get("m" if name.startswith("reference") else "r", f"$.{name}", kind)

    number = {n: locale_number(value(n, "string")) for n in _MAP_NUMBERS}
    odd = [F.when(value(n, "variant").isNotNull() & ~F.is_variant_null(value(n, "variant")) & (
        F.schema_of_variant(value(n, "variant")).startswith("OBJECT") | F.schema_of_variant(value(n, "variant")).startswith("ARRAY") | number[n].isNull()), F.lit(n)) for n in _MAP_NUMBERS]
    is_object = F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))
    unreadable = F.when(F.col("s").isNull(), F.array(F.lit("map"))).when(~is_object, F.array(F.lit("row"))).otherwise(F.array_compact(F.array(*odd)))
    plain = rows.select(
        *kept, "sheet_pos", "row_pos", "sheet_name", unreadable.alias("unreadable"), *[number[n].alias(n) for n in _MAP_NUMBERS],
        *[value(n, "string").alias(n) for n in _MAP_TEXTS], *[value(n, "boolean").alias(n) for n in _MAP_FLAGS])
    blank = {n: F.when(F.array_contains("unreadable", "row") | F.array_contains("unreadable", "map"), F.lit(None)).otherwise(F.coalesce(n, F.lit(d))).alias(n) for n, d in (
        ("base_quantity", 0.0), ("base_price_sem", 0.0), ("base_price_com", 0.0), ("item_code", ""), ("description", ""), ("scaling_rule", "fixed"), ("rounding", ""),
        ("lookup_key", ""), ("has_quantity", True), ("has_price_sem", True), ("has_price_com", True), ("default_enabled", True))}
    reference = F.coalesce("reference_mwp_ac", F.lit(V.DEFAULT_REFERENCE_MWP))
    return plain.select(*kept, "sheet_pos", "row_pos", "sheet_name", "unreadable", *blank.values(), reference.alias("reference_mwp_ac"),
                        F.coalesce("reference_dc_kwp", reference * 1000.0).alias("reference_dc_kwp"))


def normalize_items(rows: DataFrame) -> DataFrame:
    """Defaults of the map fields."""
    def get(name: str, default, dtype: str) -> Column:
        value = F.col(name) if name in rows.columns else F.lit(None)
        return F.coalesce(value.cast(dtype), F.lit(default).cast(dtype)).alias(name)

    def number(name: str) -> Column:
        value = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        return F.coalesce(locale_number(value), F.lit(0.0)).alias(name)

    reference = F.coalesce(F.col("reference_mwp_ac").cast("double"), F.lit(V.DEFAULT_REFERENCE_MWP))
    kept = [c for c in rows.columns if c.endswith("_cell") or c in ("sheet_pos", "row_pos", "sheet_name")]
    return rows.select(
        *kept, get("item_code", "", "string"), get("description", "", "string"),
        get("has_quantity", True, "boolean"), get("has_price_sem", True, "boolean"), get("has_price_com", True, "boolean"),
        number("base_quantity"), number("base_price_sem"), number("base_price_com"),
        get("scaling_rule", "fixed", "string"), get("rounding", "", "string"), get("lookup_key", "", "string"),
        get("default_enabled", True, "boolean"), reference.alias("reference_mwp_ac"),
        F.coalesce(F.col("reference_dc_kwp").cast("double"), reference * 1000.0).alias("reference_dc_kwp"))


def _rule(c: Column) -> Column:
    return strip(F.lower(F.coalesce(c, F.lit("fixed"))))


def map_quantity() -> Column:
    """Quantity of a map row: scaled from the reference plant."""
    base, rule = F.col("base_quantity"), _rule(F.col("scaling_rule"))

    def scaled(size: str, reference: str) -> Column:
        return F.when(F.col(reference) > 0, base * (F.col(size) / F.col(reference))).otherwise(base)

    return (
        F.when(rule == "per_mwp_ac", scaled("mwp_ac", "reference_mwp_ac"))
        .when(rule == "per_kwp_dc", scaled("dc_kwp", "reference_dc_kwp"))
        .when(rule == "per_string", base * F.col("strings"))
        .when(rule == "percent_of_capex", base * F.col("modules_inverters_total_com"))
        .otherwise(base)
    )


def override_quantity(prefix: str = "ov_") -> Column:
    """Quantity of an override: base per unit times the plant itself."""
    rule = _rule(F.col(f"{prefix}scaling_rule"))

    def base(name: str) -> Column:
        return F.coalesce(F.col(f"{prefix}{name}"), F.lit(0.0))

    return (
        F.when(rule == "per_mwp_ac", base("base_qty_per_mwp") * F.col("mwp_ac"))
        .when(rule == "per_kwp_dc", base("base_qty_per_kwp") * F.col("dc_kwp"))
        .when(rule == "per_string", base("base_qty_per_string") * F.col("strings"))
        .when(rule == "percent_of_capex", base("base_qty_fixed") * F.col("modules_inverters_total_com"))
        .otherwise(base("base_qty_fixed"))
    )


def rounded(value: Column, rule: Column) -> Column:
    key = strip(F.lower(F.coalesce(rule, F.lit(""))))
    return F.when(key == "ceil", F.ceil(value).cast("double")).when(
        key == "floor", F.floor(value).cast("double")).otherwise(value)


def by_lookup(quantity: Column, price_sem: Column, price_com: Column) -> Column:
    """struct(quantity, price_sem, price_com) after the equipment lookups of a map row."""
    key = strip(F.lower(F.col("lookup_key")))

    def row(q: Column, sem: Column, com: Column) -> Column:
        return F.struct(q.cast("double").alias("quantity"), sem.cast("double").alias("price_sem"), com.cast("double").alias("price_com"))

    c = F.col
    return bind(row(quantity, price_sem, price_com), lambda r: (
        F.when(key == "pv.modules_dc_kwp", row(c("dc_kwp"), c("module_price_sem"), c("module_price_com")))
        .when(key == "pv.inverter_qty", row(c("inverter_qty"), c("inverter_price_sem"), c("inverter_price_com")))
        .when(key == "pv.module_count", row(c("module_count"), r["price_sem"], r["price_com"]))
        .when(key == "pv.strings", row(c("strings"), r["price_sem"], r["price_com"]))
        .when(key == "pv.combiners", row(c("combiners_with_spare"), r["price_sem"], r["price_com"]))
        .otherwise(r)))


_SIZE_COLUMNS = [
    "mwp_ac", "dc_kwp", "strings", "module_count", "inverter_qty", "combiners_with_spare",
    "modules_inverters_total_com", "module_price_sem", "module_price_com", "inverter_price_sem", "inverter_price_com",
]


def line_items(items: DataFrame, sized: DataFrame, overrides: DataFrame) -> DataFrame:
    """Priced rows of every map item for every sized scenario, cells for the sheet writer included."""
    pairs = items.crossJoin(sized.select(F.col("name").alias("scenario"), *_SIZE_COLUMNS))
    given = overrides.select("scenario", "item_code", F.lit(True).alias("ov_hit"), *[
        F.col(f).alias(f"ov_{f}") for f in BOS_FIELDS])
    df = pairs.join(given, ["scenario", "item_code"], "left")
    c, hit = F.col, F.coalesce("ov_hit", F.lit(False))
    df = df.withColumns({
        "enabled": F.when(hit, F.coalesce("ov_enabled", "default_enabled")).otherwise(c("default_enabled")),
        "rule": F.when(hit, F.coalesce("ov_scaling_rule", "scaling_rule")).otherwise(c("scaling_rule")),
        "raw_quantity": F.when(hit, override_quantity()).otherwise(map_quantity()),
        "raw_sem": F.when(hit, F.coalesce("ov_unit_price_sem", "base_price_sem")).otherwise(c("base_price_sem")),
        "raw_com": F.when(hit, F.coalesce("ov_unit_price_com", "base_price_com")).otherwise(c("base_price_com")),
    })
    df = df.withColumn("p", by_lookup(c("raw_quantity"), c("raw_sem"), c("raw_com")))
    always = F.lower("lookup_key").isin(V.ALWAYS_ON_LOOKUPS)
    df = df.withColumn("written", F.when(c("has_quantity"), F.when(
        ~c("enabled") & ~always, 0.0).otherwise(rounded(c("p.quantity"), c("rounding")))))

    def subtotal(price: str) -> Column:
        return F.when(c("has_quantity"), c("written") * c(f"p.{price}")).otherwise(c(f"p.{price}"))

    cells = [x for x in ("quantity_cell", "price_sem_cell", "price_com_cell") if x in items.columns]
    return df.select(
        "scenario", "sheet_pos", "row_pos", F.col("sheet_name").alias("sheet"), "item_code", "description", "enabled",
        F.col("rule").alias("scaling_rule"), F.coalesce("written", F.lit(0.0)).alias("quantity"),
        c("p.price_sem").alias("unit_price_sem"), c("p.price_com").alias("unit_price_com"),
        subtotal("price_sem").alias("subtotal_sem"), subtotal("price_com").alias("subtotal_com"),
        c("written").alias("cell_quantity"),
        F.when(c("has_price_sem"), c("p.price_sem")).alias("cell_price_sem"),
        F.when(c("has_price_com"), c("p.price_com")).alias("cell_price_com"), *cells)


def sheet_totals(lines: DataFrame) -> DataFrame:
    """Totals per scenario and sheet, sheets in their first-seen order."""
    return lines.groupBy("scenario", "sheet").agg(
        F.min("sheet_pos").alias("sheet_pos"),
        exact_sum(F.col("subtotal_sem")).alias("total_sem_bdi"),
        exact_sum(F.col("subtotal_com")).alias("total_com_bdi"),
    ).orderBy("scenario", "sheet_pos")


def grand_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("scenario").agg(
        exact_sum(F.col("subtotal_sem")).alias("grand_total_sem_bdi"),
        exact_sum(F.col("subtotal_com")).alias("grand_total_com_bdi"))


def comparison(sized: DataFrame, lines: DataFrame) -> DataFrame:
    """The review table: one row per scenario."""
    return sized.join(grand_totals(lines).withColumnRenamed("scenario", "name"), "name", "left").select(
        F.regexp_replace("name", "Scenario", "Cenario").alias("cenario"),
        F.col("pricing_version").alias("versao_preco"), "dc_kwp", F.col("module_count").alias("qtd_modulos"),
        F.col("inverter_qty").alias("qtd_inversores"),
        F.col("modules_inverters_total_com").alias("modulos_inversores_com_bdi"),
        F.col("grand_total_com_bdi").alias("total_com_bdi_mapeado"), F.size("warnings").alias("alertas"))


def scenario_bundle(
    scenarios: DataFrame, modules: DataFrame, inverters: DataFrame, items: DataFrame, overrides: DataFrame, mwp_ac: float,
) -> dict[str, DataFrame]:
    """Sizing, line items, totals and comparison of all scenarios for one plant size."""
    if float(mwp_ac) <= 0:
        raise ValueError("MWp invalido para orcamentacao.")
    sized = size_scenarios(resolve_equipment(scenarios.withColumn("mwp_ac", F.lit(float(mwp_ac))), modules, inverters))
    lines = line_items(items, sized, overrides)
    return {
        "sizing": sized, "line_items": lines, "sheet_totals": sheet_totals(lines),
        "totals": grand_totals(lines), "comparison": comparison(sized, lines),
        "warnings": sized.select("name", F.explode("warnings").alias("warning")),
    }


# ------------------------------------------------------------------ BOS editor and step rules
def bos_editor(bos: DataFrame, overrides: DataFrame) -> DataFrame:
    """Catalog rows as a scenario sees them: its override first, the catalog value where it has none."""
    joined = bos.join(overrides.select("scenario", "item_code", F.lit(True).alias("hit"), *[
        F.col(f).alias(f"ov_{f}") for f in BOS_FIELDS]), "item_code", "left")
    hit = F.coalesce("hit", F.lit(False))

    def shown(name: str) -> Column:
        return F.when(hit, F.col(f"ov_{name}")).otherwise(F.col(name).cast("double")).alias(name)

    return joined.select(
        "scenario", "item_code", "item_name", "unit", F.coalesce("ov_enabled", F.lit(True)).alias("enabled"),
        F.coalesce("ov_scaling_rule", "scaling_rule", F.lit("fixed")).alias("scaling_rule"),
        *[shown(q) for q in ("base_qty_per_mwp", "base_qty_per_kwp", "base_qty_per_string", "base_qty_fixed")],
        *[F.coalesce(f"ov_{p}", F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in ("unit_price_sem", "unit_price_com")])


def overrides_of_editor(edited: DataFrame) -> DataFrame:
    """An edited table as overrides: codes trimmed, NaN to null, blank rule to fixed."""
    return edited.select(
        "scenario", strip(F.col("item_code")).alias("item_code"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.coalesce(found(strip(F.col("scaling_rule"))), F.lit("fixed")).alias("scaling_rule"),
        *[F.col(p).cast("double").alias(p) for p in ("unit_price_sem", "unit_price_com")],
        *[F.nanvl(F.col(q).cast("double"), F.lit(None)).alias(q) for q in V.BOS_QUANTITIES])


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def step_messages(projects: DataFrame, step: str) -> DataFrame:
    """(key columns, level, text) of one wizard step for many projects or scenarios at once.

    Steps A, D and E read `client, project_name, city, mwp_ac`; B reads
    `module_model, inverter_model`; C reads override rows joined with the catalog
    (`item_name, enabled, unit_price_sem, unit_price_com, scaling_rule`).
    """
    no_mwp = F.coalesce(F.col("mwp_ac"), F.lit(0.0)) <= 0 if "mwp_ac" in projects.columns else F.lit(False)
    if step == "A":
        parts = [
            message(_blank("client"), "warning", "Cliente nao informado."),
            message(_blank("project_name"), "warning", "Nome do projeto nao informado."),
            message(_blank("city"), "warning", "Cidade nao selecionada."),
            message(no_mwp, "info", "MWp AC nao definido. Aplique um dimensionamento."),
        ]
    elif step == "B":
        parts = [
            message(_blank("module_model"), "error", "Nenhum modulo selecionado."),
            message(_blank("inverter_model"), "error", "Nenhum inversor selecionado."),
        ]
    elif step == "C":
        enabled = F.coalesce("enabled", F.lit(True))
        negative = (F.coalesce("unit_price_sem", F.lit(0.0)) < 0) | (F.coalesce("unit_price_com", F.lit(0.0)) < 0)
        rule = F.coalesce("scaling_rule", F.lit("fixed"))
        parts = [
            message(enabled & negative, "error", F.format_string("BOS '%s': preco negativo nao permitido.", "item_name")),
            message(enabled & ~rule.isin(V.SCALING_RULES), "warning", F.format_string(
                "BOS '%s': regra de escalonamento invalida '%s'.", "item_name", rule)),
        ]
    elif step == "D":
        parts = [message(no_mwp, "warning", "MWp nao definido — revisao parcial.")]
    elif step == "E":
        parts = [message(no_mwp, "error", "MWp AC nao definido. Aplique um dimensionamento antes de exportar.")]
    else:
        raise ValueError(f"Unknown step '{step}'")
    return projects.select(*projects.columns, F.explode(messages(*parts)).alias("m")).select(
        *projects.columns, "m.level", "m.text")


def step_status(projects: DataFrame) -> DataFrame:
    """Completion flags A to E."""
    has_mwp = F.coalesce("mwp_ac", F.lit(0.0)) > 0
    return projects.select(
        *projects.columns,
        (~_blank("client") & ~_blank("city") & has_mwp).alias("A"),
        (~_blank("module_model") & ~_blank("inverter_model")).alias("B"),
        F.lit(True).alias("C"), F.lit(True).alias("D"), has_mwp.alias("E"))
