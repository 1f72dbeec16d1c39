"""Ordered searches on invoice text: the first pattern with an acceptable value wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind, bind_sql, bound, sql_text
from wattledger.functions.dates import compact_sql, date_sql, token_reference, token_sql
from wattledger.functions.domain import category
from wattledger.functions.numbers import positive, ptbr_number, ptbr_or_zero, ptbr_sql
from wattledger.functions.text import (
    ascii_upper, blank_to_null, clean_class_text, contains_any, found, found_sql, lines_of, pick, pick_ascii, pick_sql, strip,
    tidy_lines,
)


def sourced(value: Column, source: str) -> Column:
    """struct(value, source), null when the value is null."""
    return bind(value, lambda v: F.when(
        v.isNotNull(), F.struct(v.alias("value"), F.lit(source).alias("source"))))


def first_positive(text: Column, patterns: dict[str, str], plain: Column | None = None) -> Column:
    """struct(value, source) of the first pattern whose number is above zero. `plain` is the text's `ascii_upper` form, if known."""
    known = "both.a" if plain is not None else ""
    hits = [bound(ptbr_sql(pick_sql("both.t", p, plain=known)), f"CASE WHEN v > 0 THEN named_struct('value', v, 'source', {sql_text(name)}) END", "v") for name, p in patterns.items()]
    both = [text.alias("t")] if plain is None else [text.alias("t"), plain.alias("a")]
    return bind_sql(F.struct(*both), f"coalesce({', '.join(hits)})", "both")


def first_text(text: Column, patterns: list[str], plain: Column | None = None) -> Column:
    """Text of the first pattern that matches at all."""
    return F.coalesce(*[pick(text, p, plain=plain) for p in patterns])


# ------------------------------------------------------------------ sections
def _until(start: str, ends: list[str]) -> str:
    return start + r".*?(?=" + "|".join(ends) + r"|$)"


def items_section(plain: Column) -> Column:
    """Invoice items part of an `ascii_upper` text; '' when absent."""
    return F.regexp_extract(plain, _until(V.ITEMS_SECTION_START, V.ITEMS_SECTION_END), 0)


def contracted_section(plain: Column) -> Column:
    return F.regexp_extract(plain, _until(V.CONTRACTED_SECTION_START, V.CONTRACTED_SECTION_END), 0)


def header_lines(text: Column) -> Column:
    """array<struct<raw, plain>>: lines above the first item or history marker."""
    lines = F.transform(lines_of(tidy_lines(text)), lambda l: F.struct(l.alias("raw"), ascii_upper(l).alias("plain")))

    def above(rows: Column) -> Column:
        marker = F.array_position(F.transform(rows, lambda r: contains_any(r["plain"], V.HEADER_END)), F.lit(True))
        return bind(marker, lambda m: F.when(m > 0, F.slice(rows, 1, m.cast("int") - 1)).otherwise(rows))

    return bind(lines, above)


def header_class(header: Column) -> Column:
    """Cleaned text of the first header line that names a class; '' when none does."""
    hits = F.filter(header, lambda r: r["plain"].rlike("|".join(V.HEADER_CLASS_LINES)))
    return F.coalesce(clean_class_text(F.get(hits, F.lit(0))["raw"]), F.lit(""))


# ------------------------------------------------------------------ identifiers
def pad_uc(digits: Column, size: int = 10) -> Column:
    """Left-pad to `size`; longer ids stay whole (Spark's `lpad` would cut them)."""
    return F.when(F.length(digits) < size, F.lpad(digits, size, "0")).otherwise(digits)


def normalize_uc(c: Column, size: int = 10) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return bind(digits, lambda d: F.when(d == "", d).otherwise(pad_uc(d, size)))


def digits_in(line: Column, low: int = 6, high: int = 12) -> Column:
    """All digits of a line when there are `low` to `high` of them."""
    return bind(F.regexp_replace(line, r"\D", ""), lambda d: F.when(F.length(d).between(low, high), d))


def _scored_ids(lines: Column) -> Column:
    """array<struct(score, place, digits)>: the lines that are one number of 6 to 12 digits, best first.

    A number with a unit label on its line or the one above scores two, separators (`12.345.678-9`) one. Dates and money are no ids.
    """
    def candidate(line: Column, i: Column) -> Column:
        number = F.regexp_extract(line, V.ID_LINE, 1)
        label = ascii_upper(F.concat_ws(" ", F.when(i > 0, F.get(lines, i - 1)), line)).rlike(V.ID_LABEL)
        is_id = (number != "") & ~number.rlike(V.NOT_AN_ID)
        score = F.when(label, 2).otherwise(0) + F.when(number.rlike("[^0-9]"), 1).otherwise(0)
        return bind(digits_in(F.when(is_id, number)), lambda d: F.when(
            d.isNotNull(), F.struct((-score).alias("rank"), i.alias("place"), d.alias("digits"))))

    return F.array_sort(F.array_compact(F.transform(lines, candidate)))


def uc_of(text: Column, plain: Column, first_lines: int = 12) -> Column:
    """struct(value, source): labelled id, else an id among all lines, else any run of 6 to 12 digits.

    Without a label, ids under a unit label come first, wherever they stand; then a line of the first ones that has 6 to 12 digits in
    all, as invoices print their id; then any such run; then other lines that are one formatted number.
    """
    labelled = [sourced(pick(text, p, plain=plain), name) for name, p in V.UC_LABELS.items()]

    def by_line(lines: Column) -> Column:
        top = F.get(F.array_compact(F.transform(F.slice(lines, 1, first_lines), lambda l: digits_in(l))), F.lit(0))
        return bind(_scored_ids(lines), lambda ids: F.coalesce(
            F.get(F.filter(ids, lambda c: c["rank"] <= -2), F.lit(0))["digits"], top, pick_ascii(plain, r"\b([0-9]{6,12})\b"), F.get(ids, F.lit(0))["digits"]))

    hit = F.coalesce(*labelled, sourced(bind(lines_of(text), by_line), "DIGIT_FALLBACK"))
    return bind(hit, lambda h: F.when(
        h.isNotNull(), F.struct(pad_uc(h["value"]).alias("value"), h["source"].alias("source"))))


# ------------------------------------------------------------------ billing month
def reference_of(text: Column, plain: Column) -> Column:
    """struct(value, source): labelled month, else the first readable month token."""
    readers = {"FATURA_YYYYMM": compact_sql, "DATA_FATURAMENTO": date_sql}

    def sourced_sql(value: str, source: str) -> str:
        return bound(value, f"CASE WHEN v IS NOT NULL THEN named_struct('value', v, 'source', {sql_text(source)}) END", "v")

    labelled = [sourced_sql(found_sql(readers.get(name, token_sql)(pick_sql("both.t", p, plain="both.a"))), name) for name, p in V.REFERENCE_LABELS.items()]
    tokens = [found_sql(token_sql(pick_sql("both.a", p, any_case=False, plain="both.a"))) for p in V.LABELLED_REFERENCE]
    free = f"get(filter(transform(regexp_extract_all(both.a, {sql_text(V.FREE_MONTH_TOKEN)}, 0), token -> {token_sql('token')}), r -> r <> ''), 0)"
    first = f"coalesce({', '.join([*labelled, sourced_sql(f'coalesce({chr(44).join([*tokens, free])})', 'GENERIC_REF_TOKEN')])})"
    return bind_sql(F.struct(text.alias("t"), plain.alias("a")), first, "both")


# ------------------------------------------------------------------ kWh and demand
def item_kwh(section_or_text: Column, plain: Column | None = None) -> Column:
    return first_positive(section_or_text, V.KWH_ITEM_PATTERNS, plain)


def text_kwh(text: Column, plain: Column | None = None) -> Column:
    return first_positive(text, V.KWH_TEXT_PATTERNS, plain)


def generic_kwh(text: Column, plain: Column | None = None) -> Column:
    return first_positive(text, V.KWH_GENERIC_PATTERNS, plain)


def kwh_of(text: Column, section: Column) -> Column:
    """struct(value, source) of the whole kWh cascade; without a section the item patterns read the text."""
    return F.coalesce(item_kwh(F.coalesce(found(section), text)), text_kwh(text), generic_kwh(text))


def demand_of(text: Column, plain: Column | None = None) -> Column:
    return first_positive(text, V.DEMAND_PATTERNS, plain)


def _label_pattern(label: str) -> str:
    return r"\b" + r"\s+".join(label.split()) + r"\b"


def item_quantity(section: Column, labels: list[str]) -> Column:
    """First number after the first label found; up to three unit words may stand between."""
    patterns = []
    for label in labels:
        patterns.append(_label_pattern(label) + r"(?:\s*[-:]\s*|\s+)([0-9][0-9\.,]*)")
        patterns.append(_label_pattern(label) + r"(?:\s+[A-Z/%()\-]+){0,3}\s+([0-9][0-9\.,]*)")
    return ptbr_number(first_text(section, patterns, section))


def quantity_text(plain: Column, labels: list[str]) -> Column:
    """Number text right after the first label found; '' when none is."""
    return F.coalesce(first_text(plain, [_label_pattern(l) + r"\s+([0-9][0-9\.,]*)" for l in labels], plain), F.lit(""))


def a4_measures(section: Column) -> Column:
    """struct of the A4 amounts in the items section; off-peak demand falls back to the single one."""
    demand = ptbr_number(first_text(section, V.BARE_DEMAND, section))
    values = {name: item_quantity(section, labels) for name, labels in V.A4_QUANTITY_LABELS.items()}
    out = F.struct(demand.alias("demanda_hp_kw"), *[v.alias(n) for n, v in values.items()])
    return bind(out, lambda s: F.struct(
        s["demanda_hp_kw"].alias("demanda_hp_kw"),
        F.coalesce(s["demanda_fhp_kw"], s["demanda_hp_kw"]).alias("demanda_fhp_kw"),
        *[s[n].alias(n) for n in V.A4_QUANTITY_LABELS if n != "demanda_fhp_kw"]))


def contracted_demand(text: Column, plain: Column, measured: Column) -> Column:
    """Contracted kW: contract section, explicit line, demand rows, item amounts, cascade, 0."""
    section = bind(contracted_section(plain), lambda s: F.coalesce(*[ptbr_number(pick_ascii(s, p)) for p in V.CONTRACTED_IN_SECTION]))
    line = pick(text, V.CONTRACTED_LINE, plain=plain)
    rows = [bind(ptbr_number(pick_ascii(plain, p)), positive) for p in V.CONTRACTED_ROWS]
    return F.coalesce(
        F.when(plain.contains("CONTRATADA"), section),
        bind(line, lambda x: F.when(x.isNotNull(), ptbr_or_zero(x))),
        *rows,
        positive(measured),
        demand_of(text, plain)["value"],
        F.lit(0.0),
    )


def robust_demand(text: Column) -> Column:
    """struct(demanda_item, dif_demanda) for texts whose columns moved."""
    return bind(ascii_upper(text), lambda plain: F.struct(
        ptbr_number(pick_ascii(plain, V.ROBUST_DEMAND)).alias("demanda_item"),
        ptbr_number(pick_ascii(plain, V.ROBUST_DEMAND_DIFFERENCE)).alias("dif_demanda")))


# ------------------------------------------------------------------ class and category
def voltage_group(text: Column, plain: Column | None = None) -> Column:
    """struct(grupo, subgrupo, source)."""
    sub = F.upper(pick(text, V.SUBGROUP_LABEL, plain=plain))
    return F.coalesce(
        F.when(text.rlike("(?iU)" + V.GROUP_LABEL), F.struct(
            F.upper(pick(text, V.GROUP_LABEL, 1)).alias("grupo"),
            F.upper(pick(text, V.GROUP_LABEL, 2)).alias("subgrupo"),
            F.lit("GRUPO_SUBGRUPO").alias("source"))),
        bind(sub, lambda s: F.struct(
            F.coalesce(F.substring(s, 1, 1), F.lit("")).alias("grupo"),
            F.coalesce(s, F.lit("")).alias("subgrupo"),
            F.when(s.isNotNull(), "SUBGRUPO").otherwise("").alias("source"))),
    )


def class_of(text: Column, header: Column, plain: Column | None = None) -> Column:
    """struct(value, source) of the consumer class text; the header is only looked at where no label has one."""
    labelled = [sourced(blank_to_null(clean_class_text(pick(text, p, plain=plain))), n) for n, p in V.CLASS_LABELS.items()]
    return F.coalesce(*labelled, sourced(blank_to_null(header_class(header)), "HEADER_CLASSIFICACAO"))


def category_of(group: Column, subgroup: Column, class_text: Column) -> Column:
    """Category by class text and group; public-power texts save an undecided one."""
    plain = ascii_upper(class_text)
    rescued = F.when(plain.contains("PODER PUBLICO"), "B3").otherwise("OUTROS")
    return bind(category(group, subgroup, class_text), lambda c: F.when(c == "OUTROS", rescued).otherwise(c))


# ------------------------------------------------------------------ names and totals
def first_line(c: Column, drop: str) -> Column:
    """First line of a captured label value, without a trailing label."""
    line = strip(F.split_part(c, F.lit("\n"), F.lit(1)))
    return F.coalesce(strip(F.regexp_replace(line, drop, "")), F.lit(""))


def name_of(text: Column, plain: Column | None = None) -> Column:
    return first_line(first_text(text, V.NAME_LABELS, plain), "Endere[cç]o:")


def address_of(text: Column, plain: Column | None = None) -> Column:
    return first_line(first_text(text, V.ADDRESS_LABELS, plain), "Etapa:")


def invoice_total(text: Column, plain: Column | None = None) -> Column:
    return ptbr_number(first_text(text, V.TOTAL_LABELS, plain))


def due_line(text: Column, plain: Column) -> Column:
    """struct(referencia, total) of `month dd/mm/yyyy R$ total`, else labelled values one by one."""
    reference = found(token_reference(pick_ascii(plain, V.DUE_LINE, 1)))
    on_line = bind(reference, lambda r: F.when(r.isNotNull(), F.struct(
        r.alias("referencia"), ptbr_number(pick_ascii(plain, V.DUE_LINE, 2)).alias("total"))))
    labels = [V.TOTAL_LABELS[1], *V.DUE_TOTAL_FALLBACKS]
    apart = F.struct(
        F.coalesce(reference_of(text, plain)["value"], F.lit("")).alias("referencia"),
        ptbr_number(first_text(text, labels, plain)).alias("total"))
    return F.coalesce(on_line, apart)
