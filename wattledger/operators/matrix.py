"""Month windows and consumer-unit by month matrices.

A matrix is one shuffle: conditional sums over fixed month slots, latest first.
Slot columns are `m00`, `m01`, ...; `slot_labels` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.dates import index_label, reference_index
from wattledger.functions.domain import a4_label, availability_exact_kwh, availability_kwh
from wattledger.functions.numbers import exact_parts, exact_sum, exact_total, positive, sum_or_zero
from wattledger.functions.text import strip
from wattledger.operators.skew import one_row


def slot_names(months: int = V.MONTHS_IN_WINDOW) -> list[str]:
    return [f"m{i:02d}" for i in range(months)]


def anchor(df: DataFrame, reference: str = "referencia") -> DataFrame:
    """One row: the latest valid month as a month count. Reads a single column."""
    return df.agg(F.max(reference_index(F.col(reference))).alias("__last"))


def window_months(df: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """(slot, referencia), latest first and gap-free; 0 months means every valid month found."""
    if months:
        grid = anchor(df).filter("__last is not null")
        return grid.select(F.posexplode(F.transform(
            F.sequence(F.col("__last"), F.col("__last") - (months - 1), F.lit(-1)), index_label)
        ).alias("slot", "referencia"))
    found = df.select(reference_index(F.col("referencia")).alias("ix")).filter("ix is not null").distinct()
    listed = found.agg(F.sort_array(F.collect_list("ix"), asc=False).alias("ixs"))  # one entry per month
    return listed.select(F.posexplode(F.transform("ixs", index_label)).alias("slot", "referencia"))


def slot_labels(df: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    w = window_months(df, months)
    return w.select(F.format_string("m%02d", F.col("slot")).alias("column"), "referencia")


def with_slot(df: DataFrame, whole: DataFrame | None = None, reference: str = "referencia",
              measures: tuple[str, ...] = ("kwh_total_te",)) -> DataFrame:
    """Add `__slot`: months back from the latest month of `whole` (default: of the table itself).

    The measures are split into the integer parts of an exact sum here, once per
    row, so that many conditional sums over them stay small and compiled.
    """
    placed = one_row(df, anchor(df if whole is None else whole, reference))
    placed = placed.withColumn("__slot", F.col("__last") - reference_index(F.col(reference))).drop("__last")
    parts = {}
    for m in measures:
        parts[f"__whole_{m}"], parts[f"__micro_{m}"] = exact_parts(F.col(m).cast("double"))
    return placed.withColumns(parts)


def _slot_sums(measure: str, months: int) -> list[Column]:
    """Exact sum of a measure per slot, 0 without rows; for tables made by `with_slot`."""
    out = []
    for i in range(months):
        here = F.col("__slot") == i
        whole, micro = (F.sum(F.when(here, F.col(f"__{part}_{measure}"))) for part in ("whole", "micro"))
        out.append(F.coalesce(exact_total(whole, micro), F.lit(0.0)))
    return out


def _mean(names: list[str], months: int | None = None) -> Column:
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return total / F.lit(float(months or len(names)))


def month_matrix(
    df: DataFrame, keys: list[str], value: str = "kwh_total_te", months: int = V.MONTHS_IN_WINDOW,
    whole: DataFrame | None = None,
) -> DataFrame:
    """keys x m00..; missing months are 0, keys with a null part drop out, keys outside the window stay."""
    known = F.col("referencia").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    placed = with_slot(df, whole, measures=(value,)).filter(known)
    return placed.groupBy(*keys).agg(
        *[c.alias(n) for c, n in zip(_slot_sums(value, months), slot_names(months))])


def fixed_cycle_matrix(df: DataFrame, keys: list[str], value: str = "kwh_total_te",
                       cycle: list[str] | None = None) -> DataFrame:
    """Matrix over a literal list of months, with the mean over the cycle."""
    cycle = cycle or V.FIXED_CYCLE
    names = slot_names(len(cycle))
    kept = df.filter(F.col("referencia").isin(cycle))
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    sums = [sum_or_zero(F.when(F.col("referencia") == r, F.col(value))).alias(n) for r, n in zip(cycle, names)]
    return kept.groupBy(*keys).agg(*sums).withColumn("media_mensal", _mean(names))


def row_order(df: DataFrame) -> Column:
    """What stands for the order of rows: file, page, block."""
    present = [c for c in ("pdf_source", "page_first_seen", "block_no") if c in df.columns]
    return F.struct(*present) if present else F.struct(F.lit(0).alias("o"))


def first_text(name: str, order: Column) -> Column:
    """First filled text of a group in row order; '' when there is none. Combined map-side."""
    text = strip(F.col(name).cast("string"))
    filled = ~F.lower(text).isin("", "nan", "none")
    return F.coalesce(
        F.min_by(F.when(filled, text), F.when(filled, F.struct(order.alias("o"), text.alias("t")))), F.lit(""))


def by_unit(
    rows: DataFrame, keys: list[str], texts: list[str], totals: dict[str, tuple[Column, Column]], peaks: dict[str, Column], order: list[str],
) -> DataFrame:
    """Per unit: its first filled texts, exact totals, greatest peaks and first page, without sorting the wide rows.

    All that is added up is numeric, in one hash aggregate that combines map-side. The texts come from a narrow table:
    first the first place of each combination of texts and file, again in a hash aggregate, then a choice among the few
    combinations of a unit.
    """
    page = F.min(F.col("page_first_seen").cast("double")) if "page_first_seen" in rows.columns else F.lit(None).cast("double")
    numbers = rows.groupBy(*keys).agg(
        *[F.coalesce(exact_total(F.sum(whole), F.sum(micro)), F.lit(0.0)).alias(n) for n, (whole, micro) in totals.items()],
        *[F.max(c).alias(n) for n, c in peaks.items()], page.alias("first_page"))
    place = [F.min(F.col(c).cast("long")).alias(c) for c in order if c != "pdf_source"] or [F.lit(0).alias("__place")]
    some = rows.groupBy(*keys, *dict.fromkeys([*texts, *[c for c in order if c == "pdf_source"]])).agg(*place)
    first = F.struct(*order) if order else F.struct(F.lit(0).alias("o"))
    chosen = some.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[first_text(c, first).alias(c) for c in texts])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return numbers.join(chosen, same).drop(*[f"__{k}" for k in keys])


def order_columns(df: DataFrame) -> list[str]:
    return [c for c in ("pdf_source", "page_first_seen", "block_no") if c in df.columns]


def _slot_parts(measure: str, months: int) -> list[tuple[Column, Column]]:
    """What the exact sum of each slot adds up; for tables made by `with_slot`."""
    return [tuple(F.when(F.col("__slot") == i, F.col(f"__{part}_{measure}")) for part in ("whole", "micro")) for i in range(months)]


def most_frequent(name: str) -> Column:
    """Most frequent filled text, the smallest one among ties."""
    return F.coalesce(F.mode(F.nullif(strip(F.col(name)), F.lit("")), deterministic=True), F.lit(""))


def first_rows(df: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """First whole row per key, as an aggregate: no key group is sorted or held in one task."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*others)
    rank = F.struct((row_order(df) if order is None else order).alias("o"), row.alias("r"))
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("__r")).select(*keys, "__r.*")


def _pdf_info() -> Column:
    blank = F.lower(strip(F.col("audit_pdf_pages"))).isin("", "nan", "none")
    return F.when(blank, F.col("pdf_source")).otherwise(F.col("audit_pdf_pages"))


def _with_trail(df: DataFrame) -> DataFrame:
    return df if "audit_pdf_pages" in df.columns else df.withColumn("audit_pdf_pages", F.lit(""))


def fill_zero_series(series: Column, availability: Column, months: int = V.MONTHS_IN_WINDOW) -> Column:
    """Pad or cut to `months`; zeros become the availability when there is one."""
    def at(i: Column) -> Column:
        value = F.coalesce(F.get(series, i), F.lit(0.0))
        return F.when((availability > 0) & (F.abs(value) <= V.ZERO_KWH), availability).otherwise(value)

    return F.transform(F.sequence(F.lit(0), F.lit(months - 1)), at)


def category_table(
    master: DataFrame, categories: list[str], label: str, fill_zeros: bool = True,
    months: int = V.MONTHS_IN_WINDOW,
) -> DataFrame:
    """Final table of a category: attributes, 13 months, mean and balance in one aggregate per UC."""
    names = slot_names(months)
    rows = with_slot(_with_trail(master).filter(F.col("categoria").isin(categories)), master)
    per_uc = by_unit(
        rows, ["uc"], ["nome", "endereco", "tipo_fornecimento", "audit_pdf_pages", "pdf_source"],
        dict(zip(names, _slot_parts("kwh_total_te", months))), {}, order_columns(master),
    ).withColumn("DISPONIBILIDADE", availability_kwh(F.col("tipo_fornecimento")))
    if fill_zeros and (label == "B3" or "IP" in categories):
        per_uc = per_uc.withColumns({
            n: F.when(F.abs(F.col(n)) <= V.ZERO_KWH, F.col("DISPONIBILIDADE")).otherwise(F.col(n)) for n in names})
    per_uc = per_uc.withColumn("MEDIA_MENSAL", _mean(names))
    return per_uc.select(
        F.col("nome").alias("LOCAL"), F.col("endereco").alias("ENDERECO"), F.col("uc").alias("UC"),
        F.lit(label).alias("CLASSIFICACAO"), F.col("tipo_fornecimento").alias("TIPO_FORNECIMENTO"),
        "DISPONIBILIDADE", (F.col("MEDIA_MENSAL") - F.col("DISPONIBILIDADE")).alias("SALDO"),
        *names, "MEDIA_MENSAL", _pdf_info().alias("PDF_INFO"), "first_page",
    )


_A4_SERIES = {"demanda_hp": "demanda_hp_kw", "demanda_fhp": "demanda_fhp_kw",
              "consumo_hp": "consumo_hp_kwh", "consumo_fhp": "consumo_fhp_kwh"}


def demand_peaks() -> dict[str, Column]:
    """What the single contracted demand of a UC takes the maximum of; none is null."""
    def some(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return {
        "__contracted": some(positive(F.col("demanda_contratada_kw"))), "__overrun": some(positive(F.col("dif_demanda"))),
        "__peak": F.greatest(some(F.col("demanda_hp_kw")), some(F.col("demanda_fhp_kw"))),
    }


def lock_columns(df: DataFrame) -> DataFrame:
    """Contracted (else peak), overrun (else peak above contracted) and peak demand."""
    df = df.withColumn("DEMANDA_CONTRATADA_UNICA_KW", F.when(
        F.col("__contracted") > 0, F.col("__contracted")).otherwise(F.col("__peak")))
    over = F.greatest(F.col("__peak") - F.col("DEMANDA_CONTRATADA_UNICA_KW"), F.lit(0.0))
    return df.withColumns({
        "MAIOR_DEMANDA_MEDIDA_KW": F.col("__peak"),
        "DEMANDA_ULTRAPASSADA_KW": F.when(F.col("__overrun") > 0, F.col("__overrun")).otherwise(over),
    }).drop("__contracted", "__overrun", "__peak")


def demand_lock_table(master: DataFrame) -> DataFrame:
    return lock_columns(master.filter(F.upper("categoria") == "A4").groupBy("uc").agg(*[F.max(c).alias(n) for n, c in demand_peaks().items()]))


def a4_table(master: DataFrame, fill_zeros: bool = True, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """A4 table: demand lock and four month series per UC, one aggregate for all of it."""
    rows = _with_trail(master).filter(F.upper("categoria") == "A4")
    if "classificacao_uc" not in rows.columns:
        rows = rows.withColumn("classificacao_uc", F.lit(""))
    series = {
        f"__{name}_{i:02d}": parts for name, column in _A4_SERIES.items() for i, parts in enumerate(_slot_parts(column, months))}
    per_uc = by_unit(
        with_slot(rows, master, measures=tuple(_A4_SERIES.values())), ["uc"],
        ["nome", "endereco", "classificacao_uc", "tipo_fornecimento", "audit_pdf_pages", "pdf_source"], series, demand_peaks(),
        order_columns(master))
    per_uc = lock_columns(per_uc).withColumn("DISPONIBILIDADE", availability_kwh(F.col("tipo_fornecimento")))
    arrays = {name: F.array(*[F.col(f"__{name}_{i:02d}") for i in range(months)]) for name in _A4_SERIES}
    if fill_zeros:
        per_uc = per_uc.withColumns(arrays)
        arrays = {name: fill_zero_series(F.col(name), F.col("DISPONIBILIDADE"), months) for name in _A4_SERIES}
    return per_uc.select(
        F.col("nome").alias("LOCAL"), F.col("endereco").alias("ENDERECO"), F.col("uc").alias("UC"),
        a4_label(F.col("classificacao_uc")).alias("CLASSIFICACAO"),
        "DEMANDA_CONTRATADA_UNICA_KW", "MAIOR_DEMANDA_MEDIDA_KW", "DEMANDA_ULTRAPASSADA_KW",
        *[a.alias(n) for n, a in arrays.items()], _pdf_info().alias("PDF_INFO"), "first_page",
    )


def in_page_order(table: DataFrame, uc: str = "UC") -> DataFrame:
    """Final row order of a printed table; ties by UC."""
    return table.orderBy(F.asc_nulls_last("first_page"), uc).drop("first_page")


def uc_template(master: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """One row per UC: attributes of its first row, 13 months, mean with zeros; the balance stays blank."""
    names = slot_names(months)
    base = ["nome", "endereco", "categoria", "tipo_fornecimento", "audit_pdf_pages"]
    rows, order = with_slot(_with_trail(master)), order_columns(master)
    # As in `by_unit`, but the attributes come from one row together.
    some = rows.groupBy("uc", *dict.fromkeys([*base, *[c for c in order if c == "pdf_source"]])).agg(
        *[F.sum(part).alias(f"__{n}_{k}") for n, parts in zip(names, _slot_parts("kwh_total_te", months)) for k, part in zip(("whole", "micro"), parts)],
        *[F.min(F.col(c).cast("long")).alias(c) for c in order if c != "pdf_source"], F.min(F.col("page_first_seen").cast("double")).alias("__page"))
    row = F.struct(*base)
    per_uc = some.groupBy("uc").agg(
        F.min_by(row, F.struct((F.struct(*order) if order else F.lit(0)).alias("o"), row.alias("r"))).alias("b"),
        *[F.coalesce(exact_total(F.sum(f"__{n}_whole"), F.sum(f"__{n}_micro")), F.lit(0.0)).alias(n) for n in names],
        F.min("__page").alias("first_page"),
    ).select("uc", "b.*", *names, "first_page")
    return per_uc.select(
        "nome", "endereco", "uc", "categoria", "tipo_fornecimento",
        availability_kwh(F.col("tipo_fornecimento")).alias("DISPONIBILIDADE"), F.lit("").alias("SALDO"),
        "audit_pdf_pages", *names, _mean(names).alias("MEDIA_MENSAL"), "first_page",
    )


def template_sheets(template: DataFrame) -> dict[str, DataFrame]:
    """The whole table and its three categories."""
    return {"GERAL": template, **{c: template.filter(F.col("categoria") == c) for c in ("A4", "B3", "IP")}}


def uc_final_template(master: DataFrame, cycle: list[str] | None = None) -> DataFrame:
    """One row per UC with the most frequent attributes over a literal 12-month cycle."""
    cycle = cycle or V.FIXED_CYCLE
    names = slot_names(len(cycle))
    sums = [sum_or_zero(F.when(F.col("referencia") == r, F.col("kwh_total_te"))).alias(n) for r, n in zip(cycle, names)]
    per_uc = master.filter(F.col("uc").isNotNull()).groupBy("uc").agg(
        *[most_frequent(c).alias(c) for c in ("nome", "endereco", "categoria", "tipo_fornecimento")],
        F.min("page_first_seen").alias("pagina_pdf"), *sums)
    return per_uc.select(
        "nome", "endereco", "uc", "categoria", "tipo_fornecimento",
        availability_exact_kwh(F.col("tipo_fornecimento")).alias("disponibilidade"), F.lit("").alias("saldo"),
        "pagina_pdf", *names, _mean(names, 12).alias("media_mensal"))


def mean_month_total(table: DataFrame, months: int = V.MONTHS_IN_WINDOW, name: str = "mean_kwh") -> DataFrame:
    """Mean over the months of the column sums; one row, 0 for an empty table."""
    totals = table.agg(*[sum_or_zero(F.col(n)).alias(n) for n in slot_names(months)])
    return totals.select(_mean(slot_names(months)).alias(name))


def mean_series_total(table: DataFrame, series: str, months: int = V.MONTHS_IN_WINDOW, name: str = "mean_kwh") -> DataFrame:
    """The same for an array column; short arrays count what they have."""
    sums = table.agg(*[sum_or_zero(F.get(F.col(series), F.lit(i))).alias(n) for i, n in enumerate(slot_names(months))])
    return sums.select(_mean(slot_names(months)).alias(name))


def sizing_inputs(master: DataFrame, fill_zeros: bool = True, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """One row: mean monthly kWh of B3, IP, A4 peak and A4 off-peak.

    The category tables this summarizes are not built: one aggregate per (category,
    UC) has all their month slots.
    """
    cat = F.when(F.upper("categoria") == "A4", "A4").when(F.col("categoria").isin("B3", "IP"), F.col("categoria"))
    measures = {"kwh": "kwh_total_te", "hp": "consumo_hp_kwh", "fhp": "consumo_fhp_kwh"}
    rows = with_slot(master, measures=tuple(measures.values())).withColumn("__cat", cat).filter("__cat is not null")
    sums = {f"{tag}_{n}": parts for tag, column in measures.items()
            for n, parts in zip(slot_names(months), _slot_parts(column, months))}
    per_uc = by_unit(rows, ["__cat", "uc"], ["tipo_fornecimento"], sums, {}, order_columns(master))
    per_uc = per_uc.withColumn("__min", availability_kwh(F.col("tipo_fornecimento")) if fill_zeros else F.lit(0.0))

    def total_of(tag: str) -> Column:
        filled = [F.when((F.abs(F.col(n)) <= V.ZERO_KWH) & (F.col("__min") > 0), F.col("__min")).otherwise(F.col(n))
                  for n in sums if n.startswith(f"{tag}_")]
        out = filled[0]
        for f in filled[1:]:
            out = out + f
        return out

    totals = per_uc.select("__cat", *[total_of(t).alias(t) for t in measures])

    def mean_of(category: str, tag: str) -> Column:
        return sum_or_zero(F.when(F.col("__cat") == category, F.col(tag))) / F.lit(float(months))

    return totals.agg(
        mean_of("B3", "kwh").alias("b3_media"), mean_of("IP", "kwh").alias("ip_media"),
        mean_of("A4", "hp").alias("a4_hp_media"), mean_of("A4", "fhp").alias("a4_fhp_media"))


def reconciliation(master: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """Master total inside the window against the total of the template matrix."""
    inside = with_slot(master).filter(F.col("__slot").between(0, months - 1))
    total = inside.agg(sum_or_zero(F.col("kwh_total_te")).alias("master_total"))
    names = slot_names(months)
    matrix = uc_template(master, months).agg(
        sum_or_zero(_mean(names, 1)).alias("template_total"))
    return one_row(total, matrix).withColumn("difference", F.col("master_total") - F.col("template_total"))


def yield_scenarios(spark) -> DataFrame:
    """The three productivity rows."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(n).alias("cenario"), F.lit(p).alias("produtividade")) for n, p in V.YIELD_SCENARIOS]))
    return spark.range(1).select(rows)


def plant_scenarios(master: DataFrame, months: int = V.MONTHS_IN_WINDOW) -> DataFrame:
    """Needed kWp and MWp for three yields, from the window total, with class totals beside."""
    kwh, cat = F.col("kwh_total_te"), F.col("categoria")
    inside = with_slot(master).filter(F.col("__slot").between(0, months - 1))
    totals = inside.agg(
        sum_or_zero(kwh).alias("total_kwh"),
        *[sum_or_zero(F.when(cat == c, kwh)).alias(f"total_{c.lower()}_kwh") for c in ("A4", "B3", "IP")])
    rows = yield_scenarios(master.sparkSession).crossJoin(F.broadcast(totals))
    kwp = F.col("total_kwh") / F.col("produtividade").cast("double")
    return rows.select(
        "cenario", "produtividade", "total_kwh", kwp.alias("kwp"), (kwp / 1000.0).alias("mwp"),
        "total_a4_kwh", "total_b3_kwh", "total_ip_kwh")


def cycle_plant_scenarios(master: DataFrame, cycle: list[str] | None = None) -> DataFrame:
    """Scenarios over the literal cycle, in total and per category, rounded half-even."""
    keys = ["uc", "categoria", "grupo_tensao", "subgrupo", "nome", "endereco"]
    cycle = cycle or V.FIXED_CYCLE
    kept = master.filter(F.col("referencia").isin(cycle))
    for k in keys:
        if k in master.columns:
            kept = kept.filter(F.col(k).isNotNull())
    totals = kept.groupBy("categoria").agg(
        exact_sum(F.col("kwh_total_te")).alias("kwh"))
    overall = totals.agg(sum_or_zero(F.col("kwh")).alias("kwh")).select(F.lit("TOTAL").alias("categoria"), "kwh")
    rows = totals.unionByName(overall).crossJoin(F.broadcast(yield_scenarios(master.sparkSession)))
    kwp = F.col("kwh") / F.col("produtividade").cast("double")
    return rows.select(
        "categoria", "cenario", "produtividade", F.bround("kwh", 3).alias("consumo_kwh"),
        F.bround(kwp, 3).alias("kwp"), F.bround(kwp / 1000.0, 6).alias("mwp"))
