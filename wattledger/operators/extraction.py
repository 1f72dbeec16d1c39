"""Invoice page texts -> one row per consumer unit and month.

Input everywhere: `pages(pdf_source string, page_no int, text string)`, pages
counted from 1. Everything is column expressions over pages and blocks, so the
work is even whatever the size of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.binding import bind, kept
from wattledger.functions.dates import (
    long_month_digits, month_reference, named_month_reference, reference_of_date,
)
from wattledger.functions.domain import category_of_text, legacy_category, low_voltage_class, supply_of_plain, supply_type
from wattledger.functions.numbers import ptbr_number
from wattledger.functions.text import (
    ascii_upper, clean_class_text, contains_any, cut_before, drop_glyph_codes, found, kwh_source, lines_of, pick,
    pick_all, pick_ascii, squeeze, strip, tidy_lines,
)
from wattledger.operators import cascade as C
from wattledger.operators import history as H
from wattledger.operators import items as I
from wattledger.operators.layouts import fact_columns, layouts_of_facts
from wattledger.sources.staging import finely_split, materialize

RECORD_COLUMNS = [
    "uc", "referencia", "grupo_tensao", "subgrupo", "categoria", "tipo_fornecimento", "origem", "nome",
    "endereco", "classificacao_uc", "kwh_b3_ip", "kwh_a4_fp_te", "kwh_a4_p_te", "kwh_total_te",
    "demanda_item", "dif_demanda", "demanda_contratada_kw", "demanda_hp_kw", "demanda_fhp_kw",
    "consumo_hp_kwh", "consumo_fhp_kwh", "total_fatura_rs", "itens_fatura_json", *V.ITEM_MEASURES,
    "pdf_source", "page_first_seen", "audit_header_page", "audit_itens_page", "audit_historico_page",
    "audit_kwh_source", "provider_layout", "needs_review", "template", "block_no",
]
_TEXTS = [
    "uc", "referencia", "grupo_tensao", "subgrupo", "categoria", "tipo_fornecimento", "origem", "nome",
    "endereco", "classificacao_uc", "itens_fatura_json", "pdf_source", "audit_kwh_source", "provider_layout",
    "template",
]
_PAGES = ["page_first_seen", "audit_header_page", "audit_itens_page", "audit_historico_page"]
# Months a record expands to: the history row, and for blocks with a UC label the
# older rule that leaves the two A4 energy columns alone.
_EXPANSION = ["__months", "__contracted", "__labelled"]
_MONTH = "struct<referencia:string," + ",".join(f"{m}:double" for m in V.HISTORY_MEASURES) + ",kwh:double>"

_UC_MARKER = "(?iU)" + "|".join(V.UC_LABELS.values())


_ITEM_COLUMNS = ["itens_fatura_json", *V.ITEM_MEASURES, "audit_itens_page"]


def _record(df: DataFrame) -> DataFrame:
    """Typed record columns but for those of the items, which go along as `__items`; what a branch did not fill is blank, null or -1."""
    out = []
    for name in RECORD_COLUMNS:
        value = name if name in df.columns else "NULL"
        if name in _ITEM_COLUMNS:
            continue
        if name in _TEXTS:
            value = f"coalesce(cast({value} AS string), '')"
        elif name in _PAGES:
            value = f"coalesce(cast({value} AS int), -1)"
        elif name == "block_no":
            value = f"coalesce(cast({value} AS int), 0)"
        elif name == "needs_review":
            value = f"coalesce(cast({value} AS boolean), false)"
        else:
            value = f"cast({value} AS double)"
        out.append(f"{value} AS {name}")
    months, contracted, labelled = (c if c in df.columns else "NULL" for c in _EXPANSION)
    rank = ["__rank"] if "__rank" in df.columns else []
    return df.selectExpr(
        *out, *rank, f"cast({months} AS array<{_MONTH}>) AS __months", f"cast({contracted} AS double) AS __contracted",
        f"coalesce({labelled}, false) AS __labelled", "__items")


def _a4_months(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(
        r["referencia"].alias("referencia"), *[r[m].alias(m) for m in V.HISTORY_MEASURES],
        F.lit(None).cast("double").alias("kwh")))


def _b_months(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(
        r["referencia"].alias("referencia"), *[F.lit(None).cast("double").alias(m) for m in V.HISTORY_MEASURES],
        r["consumo_kwh"].alias("kwh")))


def _with_items(records: DataFrame) -> DataFrame:
    """Item columns of all records at once; no items leave them blank."""
    df = records.withColumn("__measures", F.when(F.size("__items") > 0, I.item_measures(F.col("__items"))))
    return df.withColumns({
        "itens_fatura_json": I.items_json(F.col("__items")),
        **{m: F.col("__measures")[m] for m in V.ITEM_MEASURES},
        "audit_itens_page": F.when(F.size("__items") > 0, F.col("page_first_seen")).otherwise(-1),
    }).select(*RECORD_COLUMNS, *_EXPANSION, *[c for c in df.columns if c == "__rank"])


# ------------------------------------------------------------------ blocks
def uc_blocks(pages: DataFrame) -> DataFrame:
    """Each page cut in front of every UC label; text before the first is dropped."""
    others = [c for c in pages.columns if c != "text"]
    blocks = cut_before(tidy_lines(F.col("text")), _UC_MARKER)
    cut = pages.select(*others, F.posexplode(blocks).alias("block_no", "block"))
    return cut.withColumn("block", strip(F.col("block")))


def grouped_blocks(pages: DataFrame) -> DataFrame:
    """Each page cut in front of every installation code of a grouped invoice; whole page when it has none."""
    others = [c for c in pages.columns if c != "text"]
    text = tidy_lines(F.col("text"))
    blocks = bind(cut_before(text, "(?i)" + V.GROUPED_MARKER), lambda b: F.when(F.size(b) > 0, b))
    cut = pages.select(*others, F.posexplode(F.coalesce(blocks, F.array(F.col("text")))).alias("block_no", "block"))
    return cut.withColumn("block", strip(F.col("block")))


def block_records(blocks: DataFrame) -> DataFrame:
    """Records of UC-labelled blocks.

    `blocks(pdf_source, page_no, block, default_ref, provider_layout)`, with `t` where already tidied.
    """
    t, a, cat = F.col("t"), F.col("a"), F.col("categoria")
    df = blocks if "t" in blocks.columns else blocks.withColumn("t", tidy_lines(F.col("block")))
    df = df.withColumn("a", ascii_upper(t)).withColumns({
        "uc": C.uc_of(t, a)["value"],
        "referencia": F.coalesce(C.reference_of(t, a)["value"], found(month_reference(F.col("default_ref"))), F.lit("")),
        "section": C.items_section(a),
        "group": C.voltage_group(t, a),
        "origem": strip(pick(t, V.ORIGIN_LABEL, plain=a)),
        "nome": C.name_of(t, a),
        "endereco": C.address_of(t, a),
        "total_fatura_rs": C.invoice_total(t, a),
    })
    df = kept(df, F.col("uc").isNotNull())
    df = df.withColumn("__class", C.class_of(t, C.header_lines(t), a))
    df = df.withColumns({
        "grupo_tensao": F.col("group.grupo"),
        "subgrupo": F.col("group.subgrupo"),
        "categoria": C.category_of(F.col("group.grupo"), F.col("group.subgrupo"), F.col("__class.value")),
        "classificacao_uc": F.coalesce(
            F.col("__class.value"), clean_class_text(pick_ascii(a, V.CLASS_ASCII)), F.lit("")),
    })
    df = df.withColumn("tipo_fornecimento", F.coalesce(
        found(supply_type(F.col("classificacao_uc"))), supply_of_plain(a)))
    df = df.withColumns({
        "__labelled_items": I.labelled_items(F.col("section")),
        "__energy_items": I.energy_items(a, cat),
    })
    df = df.withColumn("__items", F.when(
        F.size("__energy_items") > 0, I.unique_items(F.concat("__labelled_items", "__energy_items"))
    ).otherwise(F.col("__labelled_items")))

    is_a4, is_b = cat == "A4", cat.isin("B3", "IP")
    df = df.withColumns({
        "__hist_a": F.when(is_a4, H.a4_dated(t)),
        "__hist_b": F.when(is_b, H.b_dated(t)),
        "__a4": F.when(is_a4, C.a4_measures(F.col("section"))),
        "__demand": F.when((is_a4 | is_b) & a.contains("DEMANDA"), C.demand_of(t, a)["value"]),
    })
    df = df.withColumns({
        "__contracted": F.when(is_a4, C.contracted_demand(t, a, F.col("__a4.demanda_hp_kw"))),
        "__row_a": H.grid_row(F.col("__hist_a"), F.col("referencia"), V.HISTORY_MEASURES),
        "__row_b": H.grid_row(F.col("__hist_b"), F.col("referencia"), ["consumo_kwh"]),
    })
    a4 = {m: F.when(F.col("__row_a").isNotNull(), F.col("__row_a")[m]).otherwise(F.col("__a4")[m])
          for m in V.HISTORY_MEASURES}
    df = df.withColumns(a4)
    hp, fhp = F.col("consumo_hp_kwh"), F.col("consumo_fhp_kwh")

    # Low-voltage energy in order of trust: items, text, history, anything in kWh; what comes later is only looked for if need be.
    def trusted(hit: Column, bucket: str) -> Column:
        return bind(hit, lambda h: F.when(h.isNotNull(), F.struct(
            h["value"].alias("value"), kwh_source(bucket, h["source"]).alias("source"))))

    section = F.col("section")
    te = F.when(section != "", F.coalesce(
        C.item_kwh(section, section), C.sourced(C.item_quantity(section, V.B_QUANTITY_LABELS), "ITEM_QUANTITY_FALLBACK")))
    by_text = F.coalesce(C.item_kwh(F.coalesce(found(section), t), a), C.text_kwh(t, a))
    df = df.withColumn("__kwh", F.when(is_b, F.coalesce(
        trusted(te, "ITENS_CONSUMO_TE"), trusted(by_text, "TEXTO_CONSUMO_TE"),
        C.sourced(F.col("__row_b.consumo_kwh"), "HISTORICO_CONSUMO_KWH"), trusted(C.generic_kwh(t, a), "GENERIC_KWH"))))
    b_kwh, b_source = F.col("__kwh.value"), F.col("__kwh.source")
    df = df.withColumns({
        "kwh_b3_ip": F.when(is_b, b_kwh),
        "kwh_a4_p_te": F.when(is_a4, hp),
        "kwh_a4_fp_te": F.when(is_a4, fhp),
        "kwh_total_te": F.when(is_a4, F.coalesce(hp, F.lit(0.0)) + F.coalesce(fhp, F.lit(0.0))).when(is_b, b_kwh),
        "audit_kwh_source": F.when(is_b, b_source),
        "demanda_item": F.when(is_a4, F.coalesce("demanda_hp_kw", "__demand")).when(is_b, F.col("__demand")),
        "dif_demanda": F.when(is_a4, F.col("__a4.demanda_ultrapassagem_kw")).when(
            is_b, ptbr_number(pick(t, V.DEMAND_DIFFERENCE, plain=a))),
        "demanda_contratada_kw": F.col("__contracted"),
        "page_first_seen": F.col("page_no"),
        "audit_header_page": F.col("page_no"),
        "audit_historico_page": F.when(F.coalesce(F.size("__hist_a"), F.size("__hist_b"), F.lit(0)) > 0, F.col("page_no")),
        "__months": F.when(is_a4 & a.contains("HISTORICO"), _a4_months(H.month_grid(F.col("__hist_a"), V.HISTORY_MEASURES))).when(
            is_b, _b_months(H.month_grid(F.col("__hist_b"), ["consumo_kwh"]))),
        "__labelled": F.lit(True),
    })
    return _record(df)


# ------------------------------------------------------------------ pages without a UC label
def _unlabelled_id(header: Column, stream: Column) -> Column:
    """Identifier from the header, else the number right before a month token of the running text."""
    plain = ascii_upper(F.array_join(F.transform(header, lambda r: r["raw"]), " "))
    labelled = bind(plain, lambda p: F.coalesce(*[pick_ascii(p, x) for x in V.UNLABELLED_ID_PATTERNS]))

    def before(tokens: Column) -> Column:
        def candidate(j: Column) -> Column:
            return F.when(j >= 0, C.digits_in(F.get(tokens, j), 4, 12))

        hits = F.transform(tokens, lambda tok, i: F.when(
            tok.rlike(r"^\d{2}/\d{4}$"), F.coalesce(candidate(i - 1), candidate(i - 2), candidate(i - 3))))
        return F.get(F.array_compact(hits), F.lit(0))

    return F.coalesce(labelled, bind(F.filter(F.split(stream, r"\s+"), lambda x: x != ""), before))


def _raw(header: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(header, i)["raw"])


def _not_fiscal(line: Column) -> Column:
    return F.when(~ascii_upper(line).contains("NOTA FISCAL"), line)


def _position(header: Column, words: list[str]) -> Column:
    """Index from 0 of the first header line with one of the words, -1 when absent."""
    flags = F.transform(header, lambda r: contains_any(r["plain"], words))
    return (F.array_position(flags, F.lit(True)) - 1).cast("int")


def _a4_name_address(header: Column) -> Column:
    """struct(nome, endereco, origem) of a medium-voltage page header."""
    def public(i: Column) -> Column:
        name = drop_glyph_codes(_raw(header, i + 1))
        address = _not_fiscal(drop_glyph_codes(_raw(header, i + 2)))
        return F.struct(
            F.when(i >= 0, found(name)).alias("nome"), F.when(i >= 0, address).alias("endereco"),
            F.when(i >= 0, "Poder publico Municipal").alias("origem"))

    def town(i: Column) -> Column:
        line = _raw(header, i)
        following = _not_fiscal(drop_glyph_codes(_raw(header, i + 1)))
        name = drop_glyph_codes(line)
        return F.struct(name.alias("nome"), F.when(name == line, following).alias("endereco"))

    def choose(both: Column) -> Column:
        first, second = both["p"], both["m"]
        named = first["nome"].isNotNull()
        return F.struct(
            F.coalesce(F.when(named, first["nome"]).otherwise(second["nome"]), F.lit("")).alias("nome"),
            F.coalesce(F.when(named, first["endereco"]).otherwise(
                F.coalesce(second["endereco"], first["endereco"])), F.lit("")).alias("endereco"),
            F.coalesce(first["origem"], F.lit("")).alias("origem"))

    both = F.struct(
        bind(_position(header, ["PODER PUBLICO MUNICIPAL"]), public).alias("p"),
        bind(_position(header, ["MUNICIPIO DE"]), town).alias("m"))
    return bind(both, choose)


def _b_name_address(header: Column) -> Column:
    """struct(nome, endereco, origem) of a low-voltage page header."""
    lines = F.transform(header, lambda r: bind(drop_glyph_codes(r["raw"]), lambda l: F.struct(
        l.alias("raw"), ascii_upper(l).alias("plain"))))

    def read(rows: Column) -> Column:
        def any_line(word: str) -> Column:
            return F.exists(rows, lambda r: r["plain"].contains(word))

        unit_lines = F.filter(rows, lambda r: r["plain"].contains("UNIDADE CONSUMIDORA")
                              & ~r["plain"].contains("CLASSIFIC") & ~r["plain"].contains("TIPO DE FORNECIMENTO"))
        left_parts = F.transform(unit_lines, lambda r: F.regexp_replace(
            F.get(F.split(r["raw"], r"(?i)UNIDADE\s+CONSUMIDORA"), F.lit(0)), r"^[ :\-]+|[ :\-]+\z", ""))
        beside_unit = F.get(F.filter(left_parts, lambda p: F.length(p) >= 6), F.lit(0))
        at = _position(rows, ["MUNICIPIO DE"])
        near = bind(at, lambda i: F.when(i >= 0, F.slice(rows, i + 2, 5)).otherwise(rows))
        streets = F.filter(near, lambda r: ~r["plain"].contains("NOTA FISCAL")
                           & r["raw"].rlike("(?iU)" + V.STREET_PREFIX))
        return F.struct(
            F.coalesce(bind(at, lambda i: _raw(rows, i)), F.lit("")).alias("nome"),
            F.coalesce(beside_unit, F.get(streets, F.lit(0))["raw"], F.lit("")).alias("endereco"),
            F.when(any_line("PODER PUBLICO MUNICIPAL"), "Poder publico Municipal")
            .when(any_line("ILUMINACAO PUBLICA"), "Iluminacao Publica").otherwise("").alias("origem"))

    return bind(lines, read)


def _unlabelled(pages: DataFrame) -> DataFrame:
    """Shared columns of fiscal pages without a UC label. `pages` has the tidy text `t` and its plain form `a`."""
    t, a = F.col("t"), F.col("a")
    df = pages.filter(a.contains("NOTA FISCAL")).withColumns({
        "stream": F.replace(t, F.lit("\n"), F.lit(" ")),
        "header": C.header_lines(F.col("text")),
        "due": C.due_line(t, a),
        "tipo_fornecimento": supply_of_plain(a),
        "page_first_seen": F.col("page_no"),
        "audit_header_page": F.col("page_no"),
        "audit_historico_page": F.col("page_no"),
        "total_fatura_rs": F.lit(None).cast("double"),
    })
    df = df.withColumns({
        "uc": _unlabelled_id(F.col("header"), F.col("stream")),
        "classificacao_uc": C.header_class(F.col("header")),
        "total_fatura_rs": F.col("due.total"),
    })
    return kept(df, F.col("uc").isNotNull())


def _names_medium_voltage(plain: Column) -> Column:
    return plain.contains("A4") | plain.contains("HOROSAZONAL")


def unlabelled_a4_records(pages: DataFrame) -> DataFrame:
    """Medium-voltage pages of `_unlabelled`: month lines are mandatory."""
    a = F.col("a")
    df = pages.filter(_names_medium_voltage(a))
    df = kept(df.withColumn("__rows", H.a4_month_lines(F.col("text"))), F.col("__rows").isNotNull())
    last = F.element_at("__rows", -1)
    df = df.withColumn("referencia", F.coalesce(found(F.col("due.referencia")), last["referencia"]))
    df = df.withColumn("__row", F.coalesce(H.row_of(F.col("__rows"), F.col("referencia")), last))
    df = df.withColumns({m: F.col("__row")[m] for m in V.HISTORY_MEASURES})
    df = df.withColumns({
        "__names": _a4_name_address(F.col("header")),
        "__stream_a": ascii_upper(F.col("stream")),
    })

    def contracted(text: Column, plain: Column) -> Column:
        measured = C.a4_measures(C.items_section(plain))["demanda_hp_kw"]
        return bind(C.contracted_demand(text, plain, measured), lambda v: F.when(v > 0, v))

    df = df.withColumn("__contracted", F.coalesce(
        contracted(F.col("text"), a), contracted(F.col("stream"), F.col("__stream_a")),
        F.nullif(F.col("demanda_fhp_kw"), F.lit(0.0)), F.nullif(F.col("demanda_hp_kw"), F.lit(0.0)), F.lit(0.0)))
    df = df.withColumn("__items", I.energy_items(F.col("__stream_a"), F.lit("A4")))
    hp, fhp = F.col("consumo_hp_kwh"), F.col("consumo_fhp_kwh")
    return _record(df.withColumns({
        "grupo_tensao": F.lit("A"), "subgrupo": F.lit("A4"), "categoria": F.lit("A4"),
        "nome": F.col("__names.nome"), "endereco": F.col("__names.endereco"), "origem": F.col("__names.origem"),
        "kwh_a4_p_te": hp, "kwh_a4_fp_te": fhp,
        "kwh_total_te": F.coalesce(hp, F.lit(0.0)) + F.coalesce(fhp, F.lit(0.0)),
        "demanda_item": F.col("demanda_hp_kw"),
        "demanda_contratada_kw": F.when(F.col("__contracted") > 0, F.col("__contracted")).otherwise(F.col("demanda_hp_kw")),
        "__months": _a4_months(F.col("__rows")),
    }))


def unlabelled_b_records(pages: DataFrame) -> DataFrame:
    """Low-voltage pages of `_unlabelled`: consumption history is mandatory."""
    a = F.col("a")
    df = pages.withColumn("__b", low_voltage_class(ascii_upper(F.col("classificacao_uc")), a))
    df = kept(df, F.col("__b.categoria") != "")
    df = kept(df.withColumn("__rows", H.b_history_of_stream(F.col("stream"))), F.col("__rows").isNotNull())
    last = F.element_at("__rows", -1)
    df = df.withColumn("referencia", F.coalesce(found(F.col("due.referencia")), last["referencia"]))
    df = df.withColumns({
        "__row": F.coalesce(H.row_of(F.col("__rows"), F.col("referencia")), last),
        "__names": _b_name_address(F.col("header")),
        "categoria": F.col("__b.categoria"),
    })
    df = df.withColumn("__items", I.energy_items(ascii_upper(F.col("stream")), F.col("categoria")))
    df = df.withColumn("__tagged", I.tag_items(F.col("__items")))
    df = df.withColumns({
        "__te": I.te_quantity(F.col("__tagged")),
        "__text": C.kwh_of(F.col("text"), C.items_section(a)),
    })
    by_item = F.col("__te") > 0
    by_text = F.col("__text.source").isin(list(V.KWH_TEXT_PATTERNS))
    kwh = F.when(by_item, F.col("__te")).when(by_text, F.col("__text.value")).otherwise(F.col("__row.consumo_kwh"))
    return _record(df.withColumns({
        "grupo_tensao": F.col("__b.grupo"), "subgrupo": F.col("__b.subgrupo"),
        "nome": F.col("__names.nome"), "endereco": F.col("__names.endereco"), "origem": F.col("__names.origem"),
        "kwh_b3_ip": kwh, "kwh_total_te": kwh,
        "audit_kwh_source": F.when(by_item, "ITENS_CONSUMO_TE/ITEMS_SUMMARY")
        .when(by_text, kwh_source("TEXTO_CONSUMO_TE", F.col("__text.source")))
        .otherwise("HISTORICO_CONSUMO_KWH"),
        "__months": _b_months(F.col("__rows")),
    }))


# ------------------------------------------------------------------ grouped invoices
def is_grouped_page(plain: Column) -> Column:
    return contains_any(plain, V.GROUPED_PAGE_MARKERS)


def _grouped_reference(text: Column, plain: Column) -> Column:
    long_month = pick_ascii(plain, V.LONG_MONTH_REF, 1)
    return F.coalesce(
        F.concat(long_month_digits(long_month), F.lit("/"), pick_ascii(plain, V.LONG_MONTH_REF, 2)),
        found(reference_of_date(pick_ascii(plain, V.GROUPED_ISSUE_DATE))),
        found(named_month_reference(pick_ascii(plain, V.SHORT_MONTH_REF, 1), pick_ascii(plain, V.SHORT_MONTH_REF, 2))),
        found(F.regexp_extract(text, r"\b(\d{2}/\d{4})\b", 1)),
        C.reference_of(text, plain)["value"],
        F.lit(""),
    )


def _grouped_address(lines: Column, starts_with_id: Column, name: Column) -> Column:
    """Lines under the name up to the first line of another field."""
    begin = F.when(starts_with_id, 1).otherwise(0)
    plain_name = ascii_upper(name)
    begin = begin + F.when((name != "") & (ascii_upper(F.get(lines, begin)) == plain_name), 1).otherwise(0)
    below = F.slice(lines, begin + 1, F.size(lines))

    def cleaned(l: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(l, "(?iU)" + V.GROUPED_ISSUE_TAIL, ""), r"^[ \-]+|[ \-]+\z", "")

    rows = F.filter(
        F.transform(below, lambda l: bind(cleaned(l), lambda c: F.struct(c.alias("raw"), ascii_upper(c).alias("plain")))),
        lambda r: r["raw"] != "")

    def above(r: Column) -> Column:
        stop = _position(r, V.GROUPED_ADDRESS_END)
        kept = bind(stop, lambda i: F.when(i >= 0, F.slice(r, 1, i)).otherwise(r))
        kept = F.filter(kept, lambda x: ~((name != "") & (x["plain"] == plain_name)))
        return F.array_join(F.transform(kept, lambda x: x["raw"]), " ")

    return strip(bind(rows, above))


def grouped_records(blocks: DataFrame) -> DataFrame:
    """Records of grouped-invoice blocks. `blocks(pdf_source, page_no, block)`, with `t` and `a` where already known."""
    t, a, cat, lines = F.col("t"), F.col("a"), F.col("categoria"), F.col("lines")
    df = blocks if "a" in blocks.columns else blocks.withColumn("t", tidy_lines(F.col("block"))).withColumn("a", ascii_upper(t))
    df = df.withColumn("lines", lines_of(t))
    df = df.withColumn("first_id", C.digits_in(F.get(lines, F.lit(0))))
    df = df.withColumn("uc", F.coalesce(
        *[pick_ascii(a, p) for p in V.GROUPED_ID_PATTERNS], F.col("first_id"), pick_ascii(a, V.GROUPED_ID_FOOTER)))
    df = kept(df, F.col("uc").isNotNull()).withColumns({
        "referencia": _grouped_reference(t, a),
        "categoria": bind(category_of_text(a), lambda c: F.when(
            (c == "OUTROS") & a.rlike(r"\bCONSUMO\s+TE\b") & ~contains_any(a, ["CONSUMO PONTA", "FORA PONTA"]), "B3"
        ).otherwise(c)),
        "classificacao_uc": C.header_class(C.header_lines(t)),
        "tipo_fornecimento": supply_of_plain(a),
        "section": C.items_section(a),
        "page_first_seen": F.col("page_no"),
        "audit_header_page": F.col("page_no"),
    })
    starts_with_id, several = F.col("first_id").isNotNull(), F.size(lines) >= 2
    second = F.get(lines, F.lit(1))
    named = found(strip(F.regexp_extract(t, "(?i)" + V.GROUPED_NAME, 1)))
    under_id = F.when(several & starts_with_id & ~contains_any(ascii_upper(second), V.GROUPED_NOT_A_NAME), second)
    df = df.withColumn("nome", F.coalesce(named, under_id, F.lit("")))
    addressed = found(strip(F.regexp_extract(t, "(?i)" + V.GROUPED_ADDRESS, 1)))
    money = F.try_element_at(pick_all(a, V.GROUPED_MONEY, 1), F.lit(-1))
    df = df.withColumns({
        "endereco": F.coalesce(
            addressed, F.when(several, _grouped_address(lines, starts_with_id, F.col("nome"))), F.lit("")),
        "total_fatura_rs": F.coalesce(
            ptbr_number(pick_ascii(a, V.GROUPED_TOTAL)), ptbr_number(money), ptbr_number(pick_ascii(a, V.GROUPED_TOTAL_LINE))),
        "__hist_b": H.b_history(t),
    })
    df = df.withColumn("__items", I.labelled_items(F.col("section")))
    is_b = cat.isin("B3", "IP")
    te_rows = F.filter(F.transform(pick_all(a, V.GROUPED_TE_ROW, 1), ptbr_number), lambda v: v.isNotNull())
    explicit = [F.when(t.rlike("(?iU)" + V.KWH_TEXT_PATTERNS[n]), F.struct(
        ptbr_number(pick(t, V.KWH_TEXT_PATTERNS[n])).alias("v"))) for n in V.GROUPED_TEXT_SOURCES]
    df = df.withColumn("__tagged", I.tag_items(F.col("__items"))).withColumns({
        "__te": I.te_quantity(F.col("__tagged")),
        "__sum": F.when(is_b, bind(te_rows, lambda r: F.when(
            F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda x, y: x + y)))),
        "__line": F.when(is_b, F.coalesce(*explicit)),
        "__row": H.row_of(F.col("__hist_b"), F.col("referencia")),
        "__measured": F.when(is_b, ptbr_number(pick(t, V.KWH_GENERIC_PATTERNS["ENERGIA_UNICO_APURADO"]))),
        "__any": F.when(is_b, ptbr_number(F.coalesce(
            pick(t, V.KWH_GENERIC_PATTERNS["KWH_GENERIC"]), pick(t, V.KWH_GENERIC_PATTERNS["KWH_BROKEN"])))),
    })
    by_history = F.when(is_b & F.col("__line").isNull(), F.col("__row.consumo_kwh"))
    levels = [
        (F.when(F.col("__te") > 0, F.col("__te")), "ITENS_CONSUMO_TE"),
        (F.coalesce(F.col("__sum"), F.col("__line.v")), "TEXTO_CONSUMO_TE"),
        (by_history, "HISTORICO_CONSUMO_KWH"),
        (F.col("__measured"), "ENERGIA_UNICO_APURADO"),
        (F.col("__any"), "GENERIC_KWH"),
    ]
    kwh = F.coalesce(*[v for v, _ in levels])
    return _record(df.withColumns({
        "kwh_total_te": kwh,
        "kwh_b3_ip": F.when(is_b, kwh),
        "audit_kwh_source": F.coalesce(*[F.when(v.isNotNull(), s) for v, s in levels]),
        "audit_historico_page": F.when(F.col("__hist_b").isNotNull(), F.col("page_no")),
        "__months": F.when(is_b, _b_months(F.col("__hist_b"))),
        "__labelled": F.lit(True),
    }))


# ------------------------------------------------------------------ expansion and assembly
def expand_history(records: DataFrame) -> DataFrame:
    """One row per history month; records without history stay single.

    Invoice totals and items stay on the billed month only.
    """
    rows = records.withColumn("h", F.explode_outer("__months"))
    has, other = F.col("h").isNotNull(), F.col("h.referencia") != F.col("referencia")
    a4, low = has & (F.col("categoria") == "A4"), has & F.col("categoria").isin("B3", "IP")
    unlabelled_a4 = a4 & ~F.col("__labelled")
    energy = F.coalesce(F.col("h.consumo_hp_kwh"), F.lit(0.0)) + F.coalesce(F.col("h.consumo_fhp_kwh"), F.lit(0.0))
    contracted = F.when(F.col("__contracted") > 0, F.col("__contracted")).when(
        unlabelled_a4, F.col("h.demanda_hp_kw")).otherwise(F.col("demanda_item"))
    changes = {
        "kwh_total_te": F.when(a4, energy).when(low, F.col("h.kwh")).otherwise(F.col("kwh_total_te")),
        "kwh_b3_ip": F.when(low, F.col("h.kwh")).otherwise(F.col("kwh_b3_ip")),
        "kwh_a4_p_te": F.when(unlabelled_a4, F.col("h.consumo_hp_kwh")).otherwise(F.col("kwh_a4_p_te")),
        "kwh_a4_fp_te": F.when(unlabelled_a4, F.col("h.consumo_fhp_kwh")).otherwise(F.col("kwh_a4_fp_te")),
        "demanda_contratada_kw": F.when(a4, contracted).otherwise(F.col("demanda_contratada_kw")),
        "demanda_item": F.when(unlabelled_a4, contracted).when(
            a4, F.coalesce(contracted, F.col("demanda_item"))).otherwise(F.col("demanda_item")),
        **{m: F.when(a4, F.col("h")[m]).otherwise(F.col(m)) for m in V.HISTORY_MEASURES},
        **{m: F.when(~F.coalesce(other, F.lit(False)), F.col(m)) for m in ["total_fatura_rs", *V.ITEM_MEASURES]},
        "itens_fatura_json": F.when(other, "").otherwise(F.col("itens_fatura_json")),
        "referencia": F.coalesce("h.referencia", "referencia"),
    }
    return rows.select(*[changes.get(c, F.col(c)).alias(c) for c in records.columns])


def has_uc_marker(text: Column) -> Column:
    return text.rlike(_UC_MARKER)


# Page parsers in the order they are tried; a last-resort row only counts in a
# grouped document that has no other.
_BLOCK, _MEDIUM, _LOW, _GROUPED, _LAST_RESORT = range(5)


def _ranked(records: DataFrame, rank: int) -> DataFrame:
    return records.withColumn("__rank", F.lit(rank))


def _first_per_page(records: DataFrame) -> DataFrame:
    """The row of the first parser that has one, per page."""
    row = F.struct(*[c for c in records.columns if c not in ("pdf_source", "page_first_seen")])
    return records.groupBy("pdf_source", "page_first_seen").agg(
        F.min_by(row, F.col("__rank")).alias("r")).select("pdf_source", "page_first_seen", "r.*").select(*records.columns)


def extract_pages(pages: DataFrame, expand: bool = False) -> DataFrame:
    """Records of all documents at once.

    Pages with a UC label are cut into blocks. The other pages go through the page
    parsers and the first that yields a row wins; a collective invoice with any UC
    label skips that. Parsing is map-only: page texts are never shuffled. One scan
    writes the tidy texts with their facts, so that no parser reads pages that are
    not its own. What depends on the whole document (its layout, whether it has
    labelled pages) is joined to the parsed records afterwards; these and the
    document table are written once too. Parsing jobs read small splits. The months
    of a history go along with the records only where they are expanded.
    """
    pages = pages.select("pdf_source", F.col("page_no").cast("int").alias("page_no"),
                         F.coalesce("text", F.lit("")).alias("text"))
    t, a, labelled = F.col("t"), F.col("a"), F.col("labelled")
    tidy = pages.withColumn("t", tidy_lines(F.col("text"))).withColumns({"a": ascii_upper(t), "labelled": has_uc_marker(t)})
    with finely_split(pages.sparkSession):
        tidy = materialize(tidy.select(
            "pdf_source", "page_no", "t", "labelled", F.when(labelled, C.reference_of(t, a)["value"]).alias("default_ref"),
            F.when(~labelled, F.col("text")).alias("text"), F.when(~labelled, a).alias("a"), *fact_columns(a)), fine=True)
    with_uc = tidy.filter(labelled).select("pdf_source", "page_no", t.alias("text"), "default_ref")
    blocks = _ranked(block_records(uc_blocks(with_uc).withColumn("t", F.col("block"))), _BLOCK)

    others = tidy.filter(~labelled).select("pdf_source", "page_no", "text", "t", "a")
    grouped_page = is_grouped_page(F.col("a"))
    whole = others.filter(grouped_page | F.col("a").contains("UC:")).withColumns({
        "block": F.col("text"), "__rank": F.when(grouped_page, _GROUPED).otherwise(_LAST_RESORT)})
    by_page = _first_per_page(
        _ranked(unlabelled_a4_records(_unlabelled(others.filter(_names_medium_voltage(a)))), _MEDIUM)
        .unionByName(_ranked(unlabelled_b_records(_unlabelled(others)), _LOW))
        .unionByName(grouped_records(whole)))

    expansion = _EXPANSION if expand else []
    with finely_split(pages.sparkSession):
        records = materialize(_with_items(blocks.unionByName(by_page)).select(*RECORD_COLUMNS, *expansion, "__rank"))
    facts = records.groupBy("pdf_source").agg(
        F.bool_or(F.col("__rank") == _BLOCK).alias("any_uc"), F.bool_or(F.col("__rank") < _LAST_RESORT).alias("any_row"))
    documents = materialize(layouts_of_facts(tidy).join(facts, "pdf_source").withColumnRenamed("provider_layout", "__layout"))
    placed = records.join(documents, "pdf_source")
    collective = (F.col("__layout") == "CELESC_COLETIVA") & F.col("any_uc")
    stray = (F.col("__rank") == _LAST_RESORT) & ((F.col("__layout") != "NEOENERGIA_ELEKTRO") | F.col("any_row"))
    placed = placed.filter(~((F.col("__rank") != _BLOCK) & collective) & ~stray)
    placed = placed.withColumns({"provider_layout": F.col("__layout"), "template": F.col("__layout")}).select(
        *RECORD_COLUMNS, *expansion)
    return (expand_history(placed) if expand else placed).drop(*_EXPANSION)


# ------------------------------------------------------------------ simpler extractors
def two_tab_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(A4 rows, B3 rows) of the two-sheet report; amounts stay as printed."""
    others = [c for c in pages.columns if c != "text"]
    blocks = pages.select(*others, F.explode(cut_before(F.col("text"), r"\bUC:\s*")).alias("b"))
    b = F.col("b")
    df = blocks.withColumn("plain", ascii_upper(b)).withColumns({
        "nome": squeeze(F.regexp_extract(b, r"(?isU)\bNome:\s*(.+?)(?:\n|Endere[cç]o:|$)", 1)),
        "endereco": squeeze(F.regexp_extract(
            b, r"(?isU)Endere[cç]o:\s*(.+?)(?:Etapa:|Chave de Acesso:|Classifica[cç][aã]o|$)", 1)),
        "uc": F.regexp_extract(b, r"(?i)UC:\s*([0-9]{6,12})", 1),
        "grupo_subgrupo": squeeze(F.regexp_extract(
            b, r"(?iU)Grupo\s*/\s*Subgrupo\s*Tens[aã]o:\s*([A-Z0-9\-\s]+)", 1)),
        "tipo_fornecimento": supply_type(b),
        "pdf": F.col("pdf_source"),
    })
    df = materialize(df.withColumns({n: C.quantity_text(F.col("plain"), labels) for n, labels in V.TWO_TAB_LABELS.items()}).drop("b"))
    amounts = ["demanda_kw", "ultrapassagem_kw", "consumo_te_ponta", "consumo_te_fora_ponta"]
    is_a4 = F.col("plain").contains("A4")
    for name in amounts:
        is_a4 = is_a4 | (F.col(name) != "")
    shared = ["nome", "endereco", "uc", "grupo_subgrupo", "tipo_fornecimento"]
    return df.filter(is_a4).select(*shared, *amounts, "pdf"), df.filter(~is_a4).select(*shared, "consumo_te", "pdf")


def single_layout_records(pages: DataFrame) -> DataFrame:
    """Older extractor for one layout: `UC:` blocks, TE text patterns, generic kWh."""
    text = F.col("text")
    refs = ["REFERENCIA", "FATURA_YYYYMM", "DATA_FATURAMENTO"]

    def reference(t: Column, names: list[str]) -> list[Column]:
        read = {
            "REFERENCIA": lambda: pick(t, V.REFERENCE_LABELS["REFERENCIA"]),
            "FATURA_YYYYMM": lambda: bind(pick(t, V.REFERENCE_LABELS["FATURA_YYYYMM"]), lambda d: F.concat(
                F.substring(d, 5, 2), F.lit("/"), F.substring(d, 1, 4))),
            "DATA_FATURAMENTO": lambda: found(reference_of_date(pick(t, V.REFERENCE_LABELS["DATA_FATURAMENTO"]))),
        }
        return [read[n]() for n in names]

    df = kept(pages, F.col("text").contains("UC:")).withColumn("text", tidy_lines(F.col("text")))
    df = df.withColumn("default_ref", F.coalesce(*reference(text, refs)))
    others = [c for c in df.columns if c != "text"]
    df = df.select(*others, F.explode(cut_before(text, "(?iU)" + V.UC_LABELS["UC"])).alias("t"))
    t, cat = F.col("t"), F.col("categoria")
    df = df.withColumns({
        "uc": C.pad_uc(pick(t, V.UC_LABELS["UC"])),
        "referencia": F.coalesce(reference(t, refs)[0], F.col("default_ref"), *reference(t, refs)[1:], F.lit("")),
        "grupo_tensao": F.coalesce(F.upper(pick(t, V.GROUP_LABEL, 1)), F.lit("")),
        "subgrupo": F.coalesce(F.upper(pick(t, V.GROUP_LABEL, 2)), F.lit("")),
        "__class": F.coalesce(strip(pick(t, V.CLASS_LABELS["CLASSIFICACAO_HEADER"])), F.lit("")),
        "origem": strip(pick(t, V.ORIGIN_LABEL)),
        "nome": C.name_of(t),
        "endereco": C.address_of(t),
        "page_first_seen": F.col("page_no"),
    })
    df = df.withColumns({
        "tipo_fornecimento": F.coalesce(found(supply_type(F.col("__class"))), supply_type(t)),
        "categoria": legacy_category(F.col("grupo_tensao"), F.col("subgrupo"), F.col("__class")),
    })
    is_a4, is_b = cat == "A4", cat.isin("B3", "IP")
    generic = V.KWH_GENERIC_PATTERNS
    te = C.first_text(t, [V.KWH_TEXT_PATTERNS[n] for n in V.GROUPED_TEXT_SOURCES])
    low = F.coalesce(
        ptbr_number(F.coalesce(te, pick(t, generic["ENERGIA_UNICO_APURADO"]))),
        ptbr_number(F.coalesce(pick(t, generic["KWH_GENERIC"]), pick(t, generic["KWH_BROKEN"]))))
    fhp, hp = (ptbr_number(pick(t, V.A4_ENERGY_PATTERNS[k])) for k in ("fhp", "hp"))
    df = df.withColumns({
        "kwh_a4_fp_te": F.when(is_a4, fhp),
        "kwh_a4_p_te": F.when(is_a4, hp),
        "kwh_b3_ip": F.when(is_b, low),
        "demanda_item": F.when(is_a4 | is_b, ptbr_number(pick(t, V.DEMAND_PATTERNS["DEMANDA_ITEM"]))),
        "dif_demanda": F.when(is_a4 | is_b, ptbr_number(pick(t, V.DEMAND_DIFFERENCE))),
    })
    hp, fhp = F.col("kwh_a4_p_te"), F.col("kwh_a4_fp_te")
    df = df.withColumn("kwh_total_te", F.when(
        is_a4 & (hp.isNotNull() | fhp.isNotNull()), F.coalesce(fhp, F.lit(0.0)) + F.coalesce(hp, F.lit(0.0))
    ).when(is_b, F.col("kwh_b3_ip")))
    return df.select(
        "uc", "referencia", "grupo_tensao", "subgrupo", "categoria", "tipo_fornecimento",
        F.coalesce("origem", F.lit("")).alias("origem"), "nome", "endereco", "kwh_b3_ip", "kwh_a4_fp_te",
        "kwh_a4_p_te", "kwh_total_te", "demanda_item", "dif_demanda", "pdf_source", "page_first_seen")


# ------------------------------------------------------------------ discovery diagnostics
def discovery_lines(pages: DataFrame) -> DataFrame:
    """(pdf_source, kind, line): unknown item headers and lines that may hold consumption."""
    lines = pages.select("pdf_source", F.explode(lines_of(tidy_lines(F.col("text")))).alias("line")).withColumn(
        "plain", ascii_upper(F.col("line")))
    p = F.col("plain")
    header = p.contains("DESCRICAO") & p.contains("QUANT") & ~contains_any(p, V.KNOWN_ITEM_HEADERS)
    consumption = p.contains("CONSUMO") & contains_any(p, ["TE", "TUSD", "KWH", "ENERGIA"])
    kinds = F.array_compact(F.array(
        F.when(header, "unmatched_itens_header"), F.when(consumption, "candidate_consumption_line")))
    return lines.select("pdf_source", F.explode(kinds).alias("kind"), "line").distinct()


def discovery_months(pages: DataFrame) -> DataFrame:
    """Month tokens per document, each once."""
    tokens = pick_all(ascii_upper(F.col("text")), V.DISCOVERY_MONTH)
    return pages.select("pdf_source", F.explode(tokens).alias("token")).distinct()


def field_report(pages: DataFrame) -> DataFrame:
    """(pdf_source, page_no, field, found, source_pattern, value): what each cascade finds on a page."""
    t, a = F.col("t"), F.col("a")
    df = pages.withColumn("t", tidy_lines(F.col("text"))).withColumn("a", ascii_upper(t)).withColumns({
        "header": C.header_lines(t), "group": C.voltage_group(t)})
    df = df.withColumn("cls", C.class_of(t, F.col("header")))
    category = C.category_of(F.col("group.grupo"), F.col("group.subgrupo"), F.col("cls.value"))
    entries = {
        "uc": C.uc_of(t, a),
        "reference": C.reference_of(t, a),
        "kwh": C.kwh_of(t, C.items_section(a)),
        "demand": C.demand_of(t),
        "categoria": F.struct(category.alias("value"), F.coalesce(
            F.col("cls.source"), F.col("group.source")).alias("source")),
    }
    rows = F.array(*[_report_entry(name, entry) for name, entry in entries.items()])
    return df.select("pdf_source", "page_no", F.inline(rows))


def _report_entry(name: str, entry: Column) -> Column:
    return bind(entry, lambda x: F.struct(
        F.lit(name).alias("field"),
        (F.coalesce(x["value"].cast("string"), F.lit("")) != "").alias("found"),
        F.coalesce(x["source"], F.lit("")).alias("source_pattern"),
        x["value"].cast("string").alias("value")))
