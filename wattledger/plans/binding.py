"""The given tables in the shapes of the invoice domain.

Orders and their lines play invoices and invoice items, customers play consumer
units, nations play municipalities. `plans.check_sql` holds the same projections
in SQL, so every query can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.dates import label
from wattledger.functions.numbers import exact_sum, sum_or_zero
from wattledger.functions.text import format_ptbr
from wattledger.operators import items as I
from wattledger.operators.cascade import pad_uc

DOCUMENTS = 20
CONTRACTED_KW = 50.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _case(column: str, cases: dict[str, str], default: str) -> Column:
    out = F
    for value, result in cases.items():
        out = out.when(F.col(column) == value, result)
    return out.otherwise(default)


def category() -> Column:
    return _case("c_mktsegment", {
        "BUILDING": "B3", "HOUSEHOLD": "B3", "MACHINERY": "IP", "AUTOMOBILE": "A4"}, "OUTROS")


def supply(priority: Column) -> Column:
    """Supply type of the digit that a priority begins with."""
    return F.when(priority == 1, "TRIFÁSICO").when(priority == 2, "BIFÁSICO").when(priority == 3, "MONOFÁSICO").otherwise("")


def month_of(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "MM")


def uc_of(column: str) -> Column:
    return pad_uc(F.col(column).cast("string"))


def document_name(number: Column) -> Column:
    return F.concat(F.lit("doc_"), (number % DOCUMENTS).cast("string"), F.lit(".pdf"))


def _flags() -> tuple[dict[str, Column], Column]:
    period = {"hp": F.col("l_returnflag") == "A", "fhp": F.col("l_returnflag") == "N", "unico": F.col("l_returnflag") == "R"}
    return period, F.col("l_linestatus") == "F"


def item_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Item rows before any grouping; (uc, referencia) repeats."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        uc_of("o_custkey").alias("uc"), label(month_of("o_orderdate")).alias("referencia"),
        document_name(F.col("l_suppkey")).alias("pdf_source"), F.col("l_linenumber").cast("int").alias("page_first_seen"),
        F.col("l_quantity").alias("quantidade"), (F.col("l_extendedprice") / 1000.0).alias("valor"),
        "l_returnflag", "l_linestatus")


def _line_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Line items reduced per order, combined map-side, before they meet the orders."""
    period, te = _flags()
    q, v = F.col("l_quantity"), F.col("l_extendedprice") / 1000.0
    sums = []
    for tag, flag in period.items():
        sums += [
            sum_or_zero(F.when(flag & te, q)).alias(f"{tag}_te"), sum_or_zero(F.when(flag & ~te, q)).alias(f"{tag}_tusd"),
            sum_or_zero(F.when(flag, v)).alias(f"{tag}_valor"),
        ]
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *sums, sum_or_zero(F.col("l_discount") * 100.0).alias("discounts"),
        F.max(F.when(period["hp"], q)).alias("max_hp"), F.max(F.when(period["fhp"], q)).alias("max_fhp"),
        F.min(F.col("l_suppkey") % DOCUMENTS).alias("doc"), F.min("l_linenumber").alias("page"),
    )


def unit_months(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per customer and month: lines -> orders -> (customer, month)."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("digit"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).when(F.col("o_orderstatus") == "O", 0.0).alias("billed"))
    lines = _line_sums(spark, folder)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    tags = ("hp", "fhp", "unico")
    return joined.groupBy("o_custkey", month_of("o_orderdate").alias("reference_date")).agg(
        *[sum_or_zero(F.col(f"{t}_{k}")).alias(f"{t}_{k}") for t in tags for k in ("te", "tusd", "valor")],
        sum_or_zero(F.col("discounts")).alias("discounts"), exact_sum(F.col("billed")).alias("billed"),
        F.max("max_hp").alias("max_hp"), F.max("max_fhp").alias("max_fhp"),
        F.min("doc").alias("doc"), F.min("page").cast("int").alias("page"), F.min("digit").alias("priority"),
    )


def master(spark: SparkSession, folder: str) -> DataFrame:
    """The month table: one row per consumer unit and month."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    units = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    months = unit_months(spark, folder)
    c, cat = F.col, category()
    te = c("hp_te") + c("fhp_te") + c("unico_te")
    value = c("hp_valor") + c("fhp_valor") + c("unico_valor")
    kwh = F.greatest("hp_te", "hp_tusd") + F.greatest("fhp_te", "fhp_tusd") + F.greatest("unico_te", "unico_tusd")
    rows = months.join(units, months.o_custkey == units.c_custkey).select(
        c("o_custkey").alias("custkey"), uc_of("o_custkey").alias("uc"), label(c("reference_date")).alias("referencia"),
        "reference_date", c("n_name").alias("municipio"), cat.alias("categoria"), supply(c("priority")).alias("tipo_fornecimento"),
        c("c_name").alias("nome"), F.concat(F.lit("RUA "), c("c_nationkey").cast("string")).alias("endereco"),
        F.when(cat == "A4", "A").otherwise("B").alias("grupo_tensao"),
        F.when(cat == "A4", "A4").when(cat == "IP", "B4A").otherwise("B3").alias("subgrupo"),
        F.when(cat == "A4", "A4 HOROSAZONAL VERDE").otherwise(c("c_mktsegment")).alias("classificacao_uc"),
        te.alias("kwh_total_te"), c("hp_te").alias("consumo_hp_kwh"), c("fhp_te").alias("consumo_fhp_kwh"),
        c("max_hp").alias("demanda_hp_kw"), c("max_fhp").alias("demanda_fhp_kw"),
        (c("discounts") - 20.0).alias("dif_demanda"), F.lit(CONTRACTED_KW).alias("demanda_contratada_kw"),
        c("billed").alias("total_fatura_rs"),
        F.when(c("o_custkey") % 3 == 0, 0.0).otherwise(F.round(value, 6)).alias("itens_fatura_total_valor_rs"),
        F.round(value, 6).alias("itens_fatura_energia_valor_rs"), kwh.alias("itens_fatura_energia_kwh"),
        (F.round(value, 6) / F.nullif(kwh, F.lit(0.0))).alias("itens_fatura_preco_medio_rs_kwh"),
        (c("hp_valor") / F.nullif(F.greatest("hp_te", "hp_tusd"), F.lit(0.0))).alias("itens_fatura_preco_all_in_hp_rs_kwh"),
        (c("fhp_valor") / F.nullif(F.greatest("fhp_te", "fhp_tusd"), F.lit(0.0))).alias("itens_fatura_preco_all_in_fhp_rs_kwh"),
        document_name(c("doc")).alias("pdf_source"), c("page").alias("page_first_seen"),
        F.when(c("o_custkey") % 4 == 0, "TEXTO_CONSUMO_TE/CONS_TE").otherwise("ITENS_CONSUMO_TE/ITEM_CONSUMO_TE_QTD").alias("audit_kwh_source"),
        F.when(c("o_custkey") % 7 == 0, "GENERIC").otherwise("CELESC_COLETIVA").alias("provider_layout"),
    )
    return rows.withColumn("kwh_b3_ip", F.when(c("categoria").isin("B3", "IP"), c("kwh_total_te")).otherwise(0.0))


def month_items(spark: SparkSession, folder: str) -> DataFrame:
    """(uc, referencia, categoria, tipo_fornecimento, itens_fatura_json): TE and TUSD items per period."""
    period, te = _flags()
    months = unit_months(spark, folder)
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    entries = []
    for tag, name in (("hp", "HP"), ("fhp", "FHP"), ("unico", "UNICO")):
        for comp, k, price in (("TE", "te", 0.5), ("TUSD", "tusd", 0.25)):
            qty = F.col(f"{tag}_{k}")
            entries.append(F.when(qty > 0, I.make_item(
                F.lit(f"CONSUMO {name} {comp}"), qty, F.lit(price), qty * F.lit(price), name, F.lit(comp), "ITENS_DE_FATURA")))
    items = F.array_compact(F.array(*entries))
    rows = months.join(customers, months.o_custkey == customers.c_custkey)
    return rows.select(
        F.col("o_custkey").alias("custkey"), uc_of("o_custkey").alias("uc"), label(F.col("reference_date")).alias("referencia"),
        "reference_date", category().alias("categoria"), supply(F.col("priority")).alias("tipo_fornecimento"),
        I.items_json(items).alias("itens_fatura_json"))


# ------------------------------------------------------------------ printed invoices
def _page_key() -> list[Column]:
    """One page per customer, twenty documents; a page holds at most one block per month."""
    return [document_name(F.col("custkey")).alias("pdf_source"),
            (F.floor(F.col("custkey") / DOCUMENTS) + 1).cast("int").alias("page_no")]


def _header() -> Column:
    """Marker line per document."""
    d = F.col("custkey") % DOCUMENTS % 4
    return (F.when(d == 0, "CELESC DISTRIBUICAO").when(d == 1, "CPFL PAULISTA").when(d == 2, "ENERGISA")
            .otherwise("CONTA MENSAL"))


def _join_lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def block_text() -> Column:
    c = F.col
    kwh, price = c("kwh_total_te"), F.lit("0,500000")
    money = format_ptbr(F.round(kwh * 0.5, 2))
    label_te = F.when(c("categoria") == "IP", "Consumo IP TE ").otherwise("Consumo TE ")
    low = F.concat(label_te, format_ptbr(kwh), F.lit(" "), price, F.lit(" "), money)
    history = F.concat(
        F.lit("HISTORICO DO FATURAMENTO\n"), c("referencia"), F.lit(" "), format_ptbr(F.coalesce("demanda_hp_kw", F.lit(0.0))),
        F.lit(" "), format_ptbr(F.coalesce("demanda_fhp_kw", F.lit(0.0))), F.lit(" "), format_ptbr(c("consumo_hp_kwh")),
        F.lit(" "), format_ptbr(c("consumo_fhp_kwh")))
    klass = F.when(c("categoria") == "A4", "A4 HOROSAZONAL").when(c("categoria") == "IP", "ILUMINACAO PUBLICA").when(
        c("categoria") == "B3", "PODER PUBLICO").otherwise("RURAL")
    group = F.when(c("categoria") == "A4", "A-A4").when(c("categoria") == "IP", "B-B4A").when(
        c("categoria") == "B3", "B-B3").otherwise("B-B2")
    return _join_lines(
        F.concat(F.lit("UC: "), c("uc")), F.concat(F.lit("Referencia: "), c("referencia")),
        F.concat(F.lit("Grupo / Subgrupo Tensao:"), group),
        F.concat(F.lit("Classificacao / Modalidade Tarifaria / Tipo de Fornecimento: "), klass, F.lit("-"),
                 c("tipo_fornecimento"), F.lit(" Municipio:")),
        F.concat(F.lit("Nome: "), c("nome"), F.lit(" Endereço: "), c("endereco"), F.lit(" Etapa: 1")),
        F.concat(F.lit("Valor: R$ "), format_ptbr(F.coalesce("total_fatura_rs", F.lit(0.0)))),
        "Itens da Fatura", F.when(c("categoria") == "A4", history).otherwise(low))


def energy_rows() -> dict[str, tuple[Column, float]]:
    """Printed energy rows: their text before the amounts, with the kWh and the price; the first four are by period."""
    hp, fhp, total = F.col("consumo_hp_kwh"), F.col("consumo_fhp_kwh"), F.col("kwh_total_te")
    return {
        "ENERGIA ATV FORN F PONTA TE KWH": (fhp, 0.5), "Energia Ativa Fornecida Fora Ponta TUSD kWh": (fhp, 0.25),
        "Energia Ativa Fornecida Ponta TE K W H": (hp, 0.5), "ENERGIA ATV FORN PONTA TUSD KWH": (hp, 0.25),
        "Energia Ativa Fornecida TE kWh": (total, 0.5), "ENERGIA ATV FORN TUSD KWH": (total, 0.25)}


def detailed_block() -> Column:
    """A block with item rows by period, medium-voltage items and, in five ways, its contracted demand; the month stands last."""
    c, cat = F.col, F.col("categoria")
    a4 = cat == "A4"

    def row(name: str, quantity: Column, price: float) -> Column:
        return F.concat(F.lit(f"{name} "), format_ptbr(quantity), F.lit(f" {price:.6f} ".replace(".", ",")), format_ptbr(F.round(quantity * price, 2)))

    energy = [row(name, *amounts) for name, amounts in energy_rows().items()]
    demand = _join_lines(
        row("Demanda", F.coalesce("demanda_hp_kw", F.lit(0.0)), 1.0), row("Demanda Fora Ponta", F.coalesce("demanda_fhp_kw", F.lit(0.0)), 2.0),
        row("Demanda de Ultrapassagem", F.greatest("dif_demanda", F.lit(0.0)), 3.0), row("Consumo Ponta TE", c("consumo_hp_kwh"), 0.5),
        row("Consumo Fora Ponta TE", c("consumo_fhp_kwh"), 0.25))
    way, kw = c("custkey") % 5, format_ptbr((c("custkey") % 90 + 10).cast("double"))
    above = F.when(a4 & (way == 0), F.concat(F.lit("Grandezas Contratadas\nDemanda Fora Ponta - kW "), kw))
    below = F.when(a4, F.when(way == 1, F.concat(F.lit("Demanda Fora Ponta - kW "), kw)).when(way == 2, F.concat(F.lit("Demanda Ativa kW "), kw)).when(
        way == 3, F.concat(F.lit("Demanda Faturada - kW "), kw)))
    klass = F.when(a4, "A4 HOROSAZONAL").when(cat == "IP", "ILUMINACAO PUBLICA").when(cat == "B3", "PODER PUBLICO").otherwise("RURAL")
    group = F.when(a4, "A-A4").when(cat == "IP", "B-B4A").when(cat == "B3", "B-B3").otherwise("B-B2")
    items = F.when(a4, _join_lines(demand, *energy[:4])).when(cat.isin("B3", "IP"), _join_lines(*energy[4:])).otherwise(_join_lines(*energy))
    label = F.when(c("custkey") % 4 == 0, "UC: ").when(c("custkey") % 4 == 1, "Instalação: ").when(
        c("custkey") % 4 == 2, "Unidade Consumidora: ").otherwise("Número do Cliente: ")
    return _join_lines(
        F.concat(label, c("uc")), F.concat(F.lit("Grupo / Subgrupo Tensao:"), group),
        F.concat(F.lit("Classificacao / Modalidade Tarifaria / Tipo de Fornecimento: "), klass, F.lit(" Municipio:")), above,
        "Itens da Fatura", items, "Valores Medidos", below, F.concat(F.lit("Referencia: "), c("referencia")))


def detailed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page of detailed blocks per customer, one block per month; all four labels of a consumer unit occur."""
    return _paged(master(spark, folder).withColumn("block", detailed_block()))


def demand_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A short page per customer with one of four unit labels and one of three demand labels."""
    k = F.col("custkey")
    kw = format_ptbr((k % 90 + 10).cast("double"))
    unit = F.when(k % 4 == 0, "UC: ").when(k % 4 == 1, "Instalação: ").when(k % 4 == 2, "Unidade Consumidora: ").otherwise("Número do Cliente: ")
    demand = F.when(k % 3 == 0, "Demanda Contratada: ").when(k % 3 == 1, "Demanda Registrada ").otherwise("Demanda Medida ")
    rows = master(spark, folder).select("custkey", "uc").distinct()
    return rows.select(*_page_key(), _join_lines(_header(), F.concat(unit, F.col("uc")), F.concat(demand, kw)).alias("text"))


def _paged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reference_date", "block"))), lambda x: x["block"]), "\n").alias("body")
    ).select(*_page_key(), F.concat_ws("\n", _header(), F.col("body")).alias("text"))


def labelled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of UC-labelled blocks, one block per month of the customer."""
    return _paged(master(spark, folder).withColumn("block", block_text()))


def _history(rows: DataFrame, line: Column) -> DataFrame:
    """Per customer: its latest month's row and the printed lines of all its months, latest first."""
    latest = F.max_by(F.struct(*[c for c in rows.columns]), F.col("reference_date"))
    return rows.withColumn("line", line).groupBy("custkey").agg(
        latest.alias("r"),
        F.transform(F.sort_array(F.collect_list(F.struct("reference_date", "line")), asc=False), lambda x: x["line"]).alias("lines"),
    ).select("r.*", "lines")


def _month_lines() -> Column:
    return F.concat("referencia", F.lit(" "), format_ptbr(F.col("kwh_total_te")), F.lit(" 30"))


def history_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One labelled block per customer with its consumption history; a medium-voltage block has its own one-month history above."""
    printed = _history(master(spark, folder), _month_lines())
    return printed.select(*_page_key(), _join_lines(
        _header(), block_text(), "HISTORICO DE CONSUMO", F.array_join("lines", "\n")).alias("text"))


def repeated_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Histories as scans print them: every second month twice, first with another value, every third month left out.

    Low-voltage blocks of `history_pages`, and medium-voltage pages of `fiscal_pages` with the right values first.
    """
    rows = master(spark, folder).withColumn("month", F.month("reference_date"))
    wrong = F.concat("referencia", F.lit(" 9.999,00 30\n"))
    low = rows.filter("categoria <> 'A4'").withColumn("shown", F.when(F.col("month") % 2 == 0, F.concat(wrong, _month_lines())).otherwise(_month_lines()))
    low = _history(low, F.when(F.col("month") % 3 != 0, F.col("shown"))).select(*_page_key(), _join_lines(
        _header(), block_text(), "HISTORICO DE CONSUMO", F.array_join(F.array_compact("lines"), "\n")).alias("text"))
    again = F.concat("referencia", F.lit(" 7,00 7,00 7,00 7,00"))
    medium = rows.filter("categoria = 'A4'").withColumn("shown", F.when(F.col("month") % 2 == 0, F.concat(_demand_lines(), F.lit("\n"), again)).otherwise(_demand_lines()))
    medium = _medium_page(_history(medium, F.when(F.col("month") % 3 != 0, F.col("shown"))))
    return low.unionByName(medium.withColumn("pdf_source", F.concat(F.lit("medium_"), "pdf_source")))


def series_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Medium-voltage blocks whose history is four series of 13 numbers, their months in a list below."""
    index = F.year("reference_date") * 12 + F.month("reference_date")
    rows = master(spark, folder).filter("categoria = 'A4'").withColumn("ix", index)
    latest = F.max_by(F.struct(*rows.columns), F.col("ix"))
    measures = {"DEMANDA HP": "demanda_hp_kw", "DEMANDA FHP": "demanda_fhp_kw", "CONSUMO HP": "consumo_hp_kwh", "CONSUMO FHP": "consumo_fhp_kwh"}
    kept = rows.groupBy("custkey").agg(latest.alias("r"), F.map_from_entries(F.collect_list(F.struct("ix", F.struct(*measures.values())))).alias("by"))
    kept = kept.select("r.*", "by")

    def series(measure: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: format_ptbr(F.coalesce(
            F.try_element_at("by", F.col("ix") - i)[measure], F.lit(0.0)))), " ")

    months = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.date_format(
        F.add_months(F.trunc("reference_date", "MM"), -i), "MM/yyyy")), " ")
    text = _join_lines(
        _header(), F.concat(F.lit("UC: "), F.col("uc")), "Grupo / Subgrupo Tensao:A-A4",
        "Classificacao / Modalidade Tarifaria / Tipo de Fornecimento: A4 HOROSAZONAL Municipio:", "Itens da Fatura", "HISTORICO DO FATURAMENTO",
        *[F.concat(F.lit(f"{label} "), series(m)) for label, m in measures.items()], months, F.concat(F.lit("Referencia: "), F.col("referencia")))
    return kept.select(*_page_key(), text.alias("text"))


def _demand_lines() -> Column:
    return F.concat_ws(" ", F.col("referencia"), *[format_ptbr(F.coalesce(m, F.lit(0.0))) for m in (
        "demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh")])


def _due_line() -> Column:
    return F.concat(F.lit("CONTA "), F.col("referencia"), F.lit(" 28/"), F.col("referencia"), F.lit(" R$ "),
                    format_ptbr(F.coalesce("total_fatura_rs", F.lit(0.0))))


def _medium_page(printed: DataFrame) -> DataFrame:
    return printed.select(*_page_key(), _join_lines(
        "DOCUMENTO AUXILIAR DA NOTA FISCAL",
        F.concat(F.lit("CODIGO "), F.col("uc")), "PODER PUBLICO MUNICIPAL", F.col("nome"), F.col("endereco"),
        F.concat(F.lit("A4 HOROSAZONAL "), F.col("tipo_fornecimento")), _due_line(),
        "ITENS DE FATURA Unid Quant", "MES/ANO", F.array_join(F.array_compact("lines"), "\n")).alias("text"))


def fiscal_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without a UC label, for customers of every category: medium voltage, low voltage, and a class no parser takes."""
    rows = master(spark, folder)
    medium = _medium_page(_history(rows.filter("categoria = 'A4'"), _demand_lines()))
    printed = _history(rows.filter("categoria <> 'A4'"), _month_lines())
    cat = F.col("categoria")
    klass = F.when(cat == "IP", "B4A ILUMINACAO PUBLICA").when(cat == "B3", "B3 COMERCIAL").otherwise("SEM CLASSE")
    low = printed.select(*_page_key(), _join_lines(
        "NOTA FISCAL DE ENERGIA", F.concat(F.lit("CODIGO "), F.col("uc")),
        F.concat(klass, F.lit(" "), F.col("tipo_fornecimento")), F.concat(F.lit("MUNICIPIO DE "), F.col("nome")),
        F.col("endereco"), _due_line(), "ITENS DE FATURA", "HISTORICO", F.array_join("lines", "\n")).alias("text"))
    return medium.unionByName(low)


def grouped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped-invoice pages of all customers with all their months on one line and the values above."""
    rows = master(spark, folder)
    names = F.create_map(*[x for i, n in enumerate(
        ["JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ"], 1) for x in (F.lit(i), F.lit(n))])
    token = F.concat(names[F.month("reference_date")], F.lit("/"), F.date_format("reference_date", "yyyy"))
    printed = _history(rows, F.concat_ws("|", token, F.col("kwh_total_te").cast("bigint").cast("string")))
    tokens = F.array_join(F.transform("lines", lambda x: F.split_part(x, F.lit("|"), F.lit(1))), " ")
    values = F.array_join(F.transform("lines", lambda x: F.split_part(x, F.lit("|"), F.lit(2))), " ")
    return printed.select(*_page_key(), _join_lines(
        F.col("uc"), F.concat(F.lit("MUNICIPIO DE "), F.col("nome")), F.col("endereco"), "Data de Emissao: 28/01/2001",
        F.concat(F.lit("Competencia "), F.col("referencia")),
        "CCI* Descricao do Produto Quantidade PODER PUBLICO",
        F.concat(F.lit("0601 CONSUMO TE "), format_ptbr(F.col("kwh_total_te")), F.lit(" 0,309625 1.312,81")),
        values, tokens, F.concat(F.lit("TOTAL A PAGAR R$ "), format_ptbr(F.coalesce("total_fatura_rs", F.lit(0.0))))).alias("text"))


# ------------------------------------------------------------------ catalogs and scenarios
def modules(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as modules."""
    c = F.col
    return table(spark, folder, "part").select(
        c("p_name").alias("model"), c("p_brand").alias("brand"), (400.0 + 10.0 * c("p_size")).alias("wp"),
        F.lit(41.0).alias("vmp"), F.lit(49.5).alias("voc"), F.lit(-0.29).alias("temp_coeff_voc"),
        c("p_retailprice").alias("price_sem_bdi_per_kwp"), F.round(c("p_retailprice") * 1.25, 4).alias("price_com_bdi_per_kwp"),
        F.concat(F.lit("Supplier "), (c("p_partkey") % 10).cast("string")).alias("supplier"), F.lit("").alias("notes"),
        c("p_type").alias("pricing_version"), c("p_partkey").alias("pos"))


def inverters(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as inverters."""
    c = F.col
    return table(spark, folder, "supplier").select(
        c("s_name").alias("model"), F.concat(F.lit("Brand "), (c("s_suppkey") % 5).cast("string")).alias("brand"),
        (100.0 + c("s_nationkey") * 10).cast("double").alias("kw"), F.lit(500.0).alias("mppt_min_v"), F.lit(1500.0).alias("mppt_max_v"),
        F.abs("s_acctbal").alias("price_sem_bdi"), F.round(F.abs("s_acctbal") * 1.25, 4).alias("price_com_bdi"),
        F.lit("S").alias("supplier"), F.lit("").alias("notes"), F.lit("V1").alias("pricing_version"), c("s_suppkey").alias("pos"))


def bos(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as balance-of-system cost items."""
    k = F.col("n_nationkey")
    rule = F.element_at(F.array(*[F.lit(r) for r in ("fixed", "per_mwp_ac", "per_kwp_dc", "per_string", "percent_of_capex")]), k % 5 + 1)
    return table(spark, folder, "nation").select(
        F.concat(F.lit("I"), k.cast("string")).alias("item_code"), F.col("n_name").alias("item_name"), F.lit("un").alias("unit"),
        F.when(k % 5 == 1, k + 1.5).alias("base_qty_per_mwp"), F.when(k % 5 == 2, 0.25).alias("base_qty_per_kwp"),
        F.when((k % 5 == 0) | (k % 5 == 4), F.when(k % 5 == 4, 0.01).otherwise(k + 2.0)).alias("base_qty_fixed"),
        F.when(k % 5 == 3, 2.0).alias("base_qty_per_string"),
        (k * 10.0 + 5).alias("unit_price_sem"), (k * 12.5 + 6.25).alias("unit_price_com"),
        F.lit("direct_com_bdi").alias("bdi_rule"), rule.alias("scaling_rule"), k.alias("pos"))


def map_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as line items of a budget map; nations give codes that have overrides."""
    k = F.col("p_partkey")
    rule = F.element_at(F.array(*[F.lit(r) for r in ("fixed", "per_mwp_ac", "per_kwp_dc", "per_string", "percent_of_capex")]), (k % 5 + 1).cast("int"))
    lookup = (F.when(k % 50 == 1, "pv.modules_dc_kwp").when(k % 50 == 2, "pv.inverter_qty").when(k % 50 == 3, "pv.module_count")
              .when(k % 50 == 4, "pv.strings").when(k % 50 == 5, "pv.combiners").otherwise(""))
    return table(spark, folder, "part").select(
        F.lit(30.0).alias("reference_mwp_ac"), F.lit(30000.0).alias("reference_dc_kwp"),
        (F.col("p_size") % 31).cast("int").alias("sheet_pos"), k.alias("row_pos"),
        F.concat(F.lit("SHEET "), (F.col("p_size") % 31).cast("string")).alias("sheet_name"),
        F.concat(F.lit("I"), (k % 40).cast("string")).alias("item_code"), F.col("p_name").alias("description"),
        (k % 9 != 0).alias("has_quantity"), F.lit(True).alias("has_price_sem"), (k % 11 != 0).alias("has_price_com"),
        F.when(k % 5 == 4, 0.01).otherwise(F.col("p_size").cast("double")).alias("base_quantity"),
        F.col("p_retailprice").alias("base_price_sem"), F.round(F.col("p_retailprice") * 1.25, 4).alias("base_price_com"),
        rule.alias("scaling_rule"), F.when(k % 6 == 0, "ceil").otherwise("").alias("rounding"), lookup.alias("lookup_key"),
        (k % 13 != 0).alias("default_enabled"))


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as scenarios with their own equipment and ratios."""
    k = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        F.col("r_name").alias("name"), F.lit("V1").alias("pricing_version"),
        F.concat(F.lit("Supplier#"), F.lpad((k + 3).cast("string"), 9, "0")).alias("inverter_model"),
        F.when(k == 0, "no such model").otherwise("red widget").alias("module_model"),
        (1.0 + k * 0.1).alias("dc_ac_ratio"), (k + 20).cast("int").alias("modules_per_string"),
        (k + 16).cast("int").alias("strings_per_combiner"), F.lit(1.05).alias("spare_factor"),
        F.when(k == 1, 0.0).alias("module_price_sem_override"), F.lit(None).cast("double").alias("module_price_com_override"),
        F.when(k == 2, 999.5).alias("inverter_price_sem_override"), F.lit(None).cast("double").alias("inverter_price_com_override"),
        (k + 1.0).alias("mwp_ac"))


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Overrides for every third cost item in every scenario."""
    k = F.regexp_extract("item_code", r"(\d+)", 1).cast("int")
    items = bos(spark, folder).filter(k % 3 == 0)
    names = table(spark, folder, "region").select(F.col("r_name").alias("scenario"))
    return items.crossJoin(names).select(
        "scenario", "item_code", (k % 2 == 0).alias("enabled"), "scaling_rule",
        F.when(k % 4 != 0, F.col("unit_price_sem")).alias("unit_price_sem"), "unit_price_com",
        "base_qty_per_mwp", "base_qty_per_kwp", "base_qty_fixed", "base_qty_per_string")
