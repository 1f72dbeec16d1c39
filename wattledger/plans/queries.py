"""Registered queries. Each reads the given tables whole; most have an SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions import columns as FC
from wattledger.functions import dates as D
from wattledger.functions import domain as K
from wattledger.functions import numbers as N
from wattledger.functions import text as X
from wattledger.functions.binding import kept
from wattledger.functions.numbers import exact_sum
from wattledger.functions.fixed_values import EXPORT_DEFAULT_NAME, RULE_FAMILY_CLASSES
from wattledger.operators import adapters as AD
from wattledger.operators import analytics as AN
from wattledger.operators import audit as AU
from wattledger.operators import budget as BU
from wattledger.operators import catalog as CT
from wattledger.operators import extraction as EX
from wattledger.operators import items as IT
from wattledger.operators import layouts as LA
from wattledger.operators import master as MA
from wattledger.operators import matrix as MX
from wattledger.operators import quality as QU
from wattledger.operators import rules as RU
from wattledger.operators import scenario as SC
from wattledger.operators import sizing as SZ
from wattledger.operators.rows import numbered
from wattledger.plans import binding as B
from wattledger.plans.check_sql import COSTS, ITEMS, LINES, MASTER, MONTHS, mean, ptbr, slots, total, total_or_null, with_base
from wattledger.sources import readers as RD
from wattledger.sources import writers as WR
from wattledger.sources.staging import checkpoint_folder, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
c = F.col
_PAGE = "'doc_' || (custkey % 20) || '.pdf' AS pdf_source, cast(custkey // 20 + 1 AS int) AS page_no"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def staged_master(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The columns of the month table that a query reads more than once, written once."""
    return materialize(B.master(spark, folder).select(*(columns or ["*"])))


#: What the category tables and templates read.
_TABLE_COLUMNS = ["uc", "referencia", "categoria", "nome", "endereco", "tipo_fornecimento", "pdf_source", "page_first_seen", "kwh_total_te"]
_A4_COLUMNS = [*_TABLE_COLUMNS, "classificacao_uc", "demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh", "demanda_contratada_kw", "dif_demanda"]
_SIZING_COLUMNS = ["municipio", "uc", "referencia", "categoria", "kwh_total_te", "kwh_b3_ip", "consumo_hp_kwh", "consumo_fhp_kwh"]


# =================================================================== text functions
@query("text_ascii_upper", r"""
SELECT doc_id, md5(a) AS digest, length(a) AS n FROM (
  SELECT doc_id, upper(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]+', '', 'g'), '\s+', ' ', 'g'))) AS a FROM documents)""")
def text_ascii_upper(spark, folder):
    return B.table(spark, folder, "documents").select("doc_id", X.ascii_upper(c("text")).alias("a")).select(
        "doc_id", F.md5("a").alias("digest"), F.length("a").cast("bigint").alias("n"))


@query("text_plain_lower", r"""
SELECT doc_id, md5(a) AS digest FROM (
  SELECT doc_id, lower(trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g'))) AS a FROM documents)""")
def text_plain_lower(spark, folder):
    return B.table(spark, folder, "documents").select("doc_id", F.md5(X.plain_lower(c("text"))).alias("digest"))


@query("text_tidy_lines", r"""
SELECT doc_id, md5(t) AS digest, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS lines FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def text_tidy_lines(spark, folder):
    return B.table(spark, folder, "documents").select("doc_id", X.tidy_lines(c("text")).alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.size(X.lines_of(c("t"))).cast("bigint").alias("lines"))


@query("text_slugs", rf"""
SELECT page_id, coalesce(nullif(s, ''), 'project') AS project, coalesce(nullif(s, ''), 'na') AS run,
       coalesce(nullif(s, ''), 'arquivo') AS file, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '{EXPORT_DEFAULT_NAME}') AS export
FROM (SELECT page_id, url, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)""")
def text_slugs(spark, folder):
    return B.table(spark, folder, "pages").select(
        "page_id", X.project_slug(c("url")).alias("project"), X.run_slug(c("url")).alias("run"),
        X.file_slug(c("url")).alias("file"), X.export_name(c("url")).alias("export"))


@query("text_labels", """
SELECT c_custkey, c_mktsegment || ' CLASSE' AS class_text, 'NATION ' || c_nationkey AS municipio,
       CASE WHEN c_custkey % 3 = 0 THEN 'inv_' || c_custkey WHEN c_custkey % 3 = 1 THEN 'inv_' || c_custkey || ' page: ' || (c_custkey % 7 + 1) ELSE 'page: ' || (c_custkey % 7 + 1) END AS label,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A4 VERDE' ELSE 'A4' END AS a4,
       CASE WHEN c_custkey % 2 = 0 THEN 'ITENS/' || c_mktsegment ELSE 'ITENS' END AS source,
       'UC (Unidade Consumidora) ' || c_custkey || ' com kWh (Quilowatt-hora) e A4 (Grupo A4 (media tensao))' AS spelled
FROM customer""")
def text_labels(spark, folder):
    k = c("c_custkey")
    page = k % 7 + 1
    file = F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("in/inv_"), k.cast("string"), F.lit(".pdf")))
    return B.table(spark, folder, "customer").select(
        "c_custkey",
        X.clean_class_text(F.concat("c_mktsegment", F.lit(" (cid:3)  CLASSE 12/09/2025 30 2"))).alias("class_text"),
        X.municipality_of_file(F.concat(F.lit("dir/NATION_"), c("c_nationkey").cast("string"), F.lit("_Faturas-2.pdf"))).alias("municipio"),
        X.page_label(file, F.when(k % 3 == 0, 0).otherwise(page)).alias("label"),
        K.a4_label(F.when(c("c_mktsegment") == "AUTOMOBILE", "A4 Tarifa Verde").otherwise("")).alias("a4"),
        X.kwh_source("ITENS", F.when(k % 2 == 0, c("c_mktsegment")).otherwise("")).alias("source"),
        X.spell_abbreviations(F.concat(F.lit("UC "), k.cast("string"), F.lit(" com kWh e A4"))).alias("spelled"))


@query("text_money", f"""
SELECT o_orderkey, {ptbr('o_totalprice')} AS ptbr, 'R$ ' || {ptbr('o_totalprice')} AS brl,
       'R$ ' || format('{{:,.2f}}', o_totalprice) AS currency, format('{{:,.2f}}', o_totalprice) || ' kW' AS plain FROM orders""")
def text_money(spark, folder):
    v = c("o_totalprice")
    return B.table(spark, folder, "orders").select(
        "o_orderkey", X.format_ptbr(v).alias("ptbr"), X.format_brl(v).alias("brl"), X.format_currency(v).alias("currency"),
        X.format_plain(v, " kW").alias("plain"))


# =================================================================== numbers and dates
@query("number_dialects", """
SELECT o_orderkey, o_totalprice AS ptbr, o_totalprice AS brl, o_totalprice AS locale_pt, o_totalprice AS locale_en, o_totalprice AS flexible,
       CASE WHEN o_totalprice < 1000 THEN o_totalprice END AS contract_en, floor(o_totalprice) AS grouped,
       CASE WHEN o_totalprice < 1000 THEN floor(o_totalprice) WHEN o_totalprice < 1000000 THEN floor(o_totalprice) / 1000 END AS locale_grouped,
       CAST(NULL AS double) AS suffix FROM orders""")
def number_dialects(spark, folder):
    v = c("o_totalprice")
    en, pt = F.format_number(v, 2), X.format_ptbr(v)
    grouped = F.translate(F.format_number(F.floor(v), 0), ",", ".")
    return B.table(spark, folder, "orders").select(
        "o_orderkey", N.ptbr_number(pt).alias("ptbr"), N.brl_number(F.concat(F.lit("R$ "), pt)).alias("brl"),
        N.locale_number(pt).alias("locale_pt"), N.locale_number(en).alias("locale_en"),
        N.flexible_number(F.translate(en, ",", "")).alias("flexible"), N.contract_number(en).alias("contract_en"),
        N.ptbr_number(grouped).alias("grouped"), N.locale_number(grouped).alias("locale_grouped"),
        N.plain_number(F.concat(F.floor(v).cast("string"), F.lit("d"))).alias("suffix"))


@query("number_column_choice", """
SELECT event_id, cast(json_extract_string(props, '$.k') AS double) AS k, value FROM events""")
def number_column_choice(spark, folder):
    df = B.table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), X.format_brl(c("value")).alias("value"), c("value").alias("v"))
    typed = N.numeric_columns(df, ["k", "value"])
    # Money text is rounded to cents when printed, so the original is shown where it agrees.
    return typed.select("event_id", "k", F.when(F.abs(c("value") - c("v")) <= 0.00500001, c("v")).otherwise(c("value")).alias("value"))


@query("number_aggregates", f"""
WITH {LINES.strip()}
SELECT l_returnflag, {total('valor')} AS total, coalesce(max(CASE WHEN quantidade > 0 THEN quantidade END), 0) AS largest,
       round(cast(sum(cast(valor AS decimal(28,6))) AS double) / nullif({total('quantidade')}, 0), 6) AS price FROM lines GROUP BY 1""")
def number_aggregates(spark, folder):
    return B.item_lines(spark, folder).groupBy("l_returnflag").agg(
        N.sum_or_zero(c("valor")).alias("total"), N.max_positive(c("quantidade")).alias("largest"),
        F.round(N.ratio(N.exact_sum(c("valor")), N.sum_or_zero(c("quantidade"))), 6).alias("price"))


@query("month_tokens", """
SELECT o_orderkey, r AS slash, r AS short, r AS named, r AS named_long, r AS packed, r AS of_date, '' AS bad, r AS compact
FROM (SELECT o_orderkey, strftime(o_orderdate, '%m/%Y') AS r FROM orders)""")
def month_tokens(spark, folder):
    d = c("o_orderdate").cast("date")
    names = F.array(*[F.lit(n) for n in ("Jan", "fev", "MAR", "Abr", "Mai", "JUN", "Jul", "AGO", "Set", "OUT", "Nov", "DEZ")])
    name = F.element_at(names, F.month(d))
    short_year = F.when(F.year(d) >= 2000, F.date_format(d, "yy")).otherwise(F.date_format(d, "yyyy"))
    return B.table(spark, folder, "orders").select(
        "o_orderkey", D.month_reference(F.date_format(d, "M/yyyy")).alias("slash"),
        D.month_reference(F.concat(F.date_format(d, "MM-"), short_year)).alias("short"),
        D.month_reference(F.concat(F.lit(" "), name, short_year)).alias("named"),
        D.month_reference(F.concat(name, F.lit("-"), F.date_format(d, "yyyy"))).alias("named_long"),
        D.month_reference(F.date_format(d, "yyyyMM")).alias("packed"),
        D.reference_of_date(F.concat(F.lit("em "), F.date_format(d, "dd/MM/yyyy"), F.lit("."))).alias("of_date"),
        D.month_reference(F.concat(F.date_format(d, "yyyy"), F.lit("/13"))).alias("bad"),
        D.compact_reference(F.date_format(d, "yyyy-MM")).alias("compact"))


@query("month_dates", """
SELECT o_orderkey, m AS strict, m AS named, m AS contract_month, d AS contract_day, d AS bridge_iso, m AS trunc_month,
       strftime(o_orderdate, '%Y-%m') AS iso, cast(year(o_orderdate) * 12 + month(o_orderdate) AS bigint) AS ix
FROM (SELECT *, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def month_dates(spark, folder):
    d = c("o_orderdate").cast("date")
    names = F.array(*[F.lit(n) for n in ("JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ")])
    ref = F.date_format(d, "MM/yyyy")
    named = F.concat(F.element_at(names, F.month(d)), F.lit("/"), F.date_format(d, "yyyy"))

    def iso(x):
        return F.date_format(x, "yyyy-MM-dd")

    return B.table(spark, folder, "orders").select(
        "o_orderkey", iso(D.month_start(ref)).alias("strict"), iso(D.reference_date(named)).alias("named"),
        iso(D.contract_date(named)).alias("contract_month"), iso(D.contract_date(F.date_format(d, "dd/MM/yyyy"))).alias("contract_day"),
        iso(D.bridge_date(F.date_format(d, "yyyy-MM-dd"))).alias("bridge_iso"), iso(F.trunc(D.bridge_date(ref), "MM")).alias("trunc_month"),
        D.iso_label(d).alias("iso"), D.reference_index(ref).cast("bigint").alias("ix"))


# =================================================================== domain ladders
_CLASS_TEXTS = [
    "A4 Horosazonal", "b3 comercial", "Iluminação Pública", "B4A", "ip", "Grupo A alta tensão", "mt rural", "grupo b",
    "PODER PÚBLICO", "residencial", "comercial mt", "TRIFÁSICO B3", "bifasico", "Monofásico",
]


def _class_sql(name: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {v!r}" if isinstance(v, str) else f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE p_partkey % {len(_CLASS_TEXTS)} {whens} END AS {name}"


@query("class_ladders", "SELECT p_partkey, " + ", ".join([
    _class_sql("text_class", ["A4", "B3", "IP", "IP", "OUTROS", "OUTROS", "OUTROS", "OUTROS", "B3", "OUTROS", "OUTROS", "B3", "OUTROS", "OUTROS"]),
    _class_sql("contract_class", ["A4", "B3", "IP", "OUTROS", "IP", "A4", "A4", "B3", "OUTROS", "OUTROS", "A4", "B3", "OUTROS", "OUTROS"]),
    _class_sql("bridge_class", ["A4", "B3", "IP", "IP", "IP", "A4", "OUTROS", "B3", "OUTROS", "OUTROS", "B3", "B3", "OUTROS", "OUTROS"]),
    _class_sql("rule_class", ["A4", "B3", "IP", "IP", "IP", "A4", "A4", "B3", "OUTROS", "OUTROS", "A4", "B3", "OUTROS", "OUTROS"]),
    _class_sql("category", ["A4", "B3", "IP", "IP", "B3", "B3", "B3", "B3", "B3", "B3", "B3", "B3", "B3", "B3"]),
    _class_sql("legacy", ["IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP", "IP"]),
    _class_sql("page_class", ["", "B3", "IP", "IP", "", "", "", "", "", "", "", "B3", "", ""]),
    _class_sql("supply", ["", "", "", "", "", "", "", "", "", "", "", "TRIFÁSICO", "BIFÁSICO", "MONOFÁSICO"]),
    _class_sql("kwh", [0.0] * 11 + [100.0, 50.0, 30.0]).replace("END AS kwh", "END::double AS kwh"),
]) + " FROM part")
def class_ladders(spark, folder):
    text = F.element_at(F.array(*[F.lit(t) for t in _CLASS_TEXTS]), (c("p_partkey") % len(_CLASS_TEXTS) + 1).cast("int"))
    plain = X.ascii_upper(c("t"))
    return B.table(spark, folder, "part").select("p_partkey", text.alias("t")).withColumn("a", plain).select(
        "p_partkey", K.category_of_text(c("a")).alias("text_class"), K.contract_class(c("t")).alias("contract_class"),
        K.bridge_class(c("t")).alias("bridge_class"), K.rule_class(c("t"), RULE_FAMILY_CLASSES).alias("rule_class"),
        K.category(F.lit("B"), F.lit("b3"), c("t")).alias("category"),
        K.legacy_category(F.lit("B"), F.lit("B4A"), c("t")).alias("legacy"),
        K.low_voltage_class(F.lit(""), c("a"))["categoria"].alias("page_class"),
        K.supply_type(c("t")).alias("supply"), K.availability_kwh(K.supply_type(c("t"))).alias("kwh"))


@query("availability", with_base(MONTHS, """
SELECT uc, referencia, CASE tipo_fornecimento WHEN 'TRIFÁSICO' THEN 100.0 WHEN 'BIFÁSICO' THEN 50.0 WHEN 'MONOFÁSICO' THEN 30.0 ELSE 0.0 END::double AS loose,
       cast(CASE tipo_fornecimento WHEN 'TRIFÁSICO' THEN 100 WHEN 'BIFÁSICO' THEN 50 WHEN 'MONOFÁSICO' THEN 30 ELSE 0 END AS bigint) AS exact FROM months"""))
def availability(spark, folder):
    return B.unit_months(spark, folder).select(
        B.uc_of("o_custkey").alias("uc"), D.label(c("reference_date")).alias("referencia"), B.supply(c("priority")).alias("s")).select(
        "uc", "referencia", K.availability_kwh(c("s")).alias("loose"), K.availability_exact_kwh(c("s")).cast("bigint").alias("exact"))


# =================================================================== audit and dedupe
_TRAIL = """
SELECT {keys}, string_agg(pdf || ': ' || pages, ' | ' ORDER BY pdf, pages) AS audit_pdf_pages FROM (
  SELECT {keys}, pdf, string_agg(cast(page_first_seen AS varchar), ', ' ORDER BY page_first_seen) AS pages FROM (
    SELECT DISTINCT {keys}, {pdf} AS pdf, page_first_seen FROM lines) GROUP BY ALL) GROUP BY {keys}"""


@query("audit_page_trail", with_base(LINES, _TRAIL.format(keys="uc, referencia", pdf="replace(pdf_source, '.pdf', '')")))
def audit_page_trail(spark, folder):
    return AU.page_trail(B.item_lines(spark, folder), ["uc", "referencia"])


@query("audit_page_trail_legacy", with_base(LINES, _TRAIL.format(keys="uc", pdf="pdf_source")))
def audit_page_trail_legacy(spark, folder):
    return AU.page_trail(B.item_lines(spark, folder), ["uc"], keep_extension=True)


@query("audit_join", with_base(LINES, "SELECT l.uc, l.referencia, l.page_first_seen, l.valor, a.audit_pdf_pages FROM lines l LEFT JOIN ("
                               + _TRAIL.format(keys="uc, referencia", pdf="replace(pdf_source, '.pdf', '')") + ") a USING (uc, referencia)"))
def audit_join(spark, folder):
    return AU.with_page_trail(B.item_lines(spark, folder)).select("uc", "referencia", "page_first_seen", "valor", "audit_pdf_pages")


@query("audit_provenance", with_base(LINES, """
SELECT l.uc, l.pdf_source, l.valor, p.first_page AS page_first_seen, p.listed AS audit_pdf_pages FROM lines l JOIN (
  SELECT uc, pdf_source, cast(min(page_first_seen) AS int) AS first_page,
         '[' || string_agg(DISTINCT cast(page_first_seen AS varchar), ', ' ORDER BY cast(page_first_seen AS varchar)) || ']' AS listed
  FROM lines WHERE page_first_seen > 0 GROUP BY 1, 2) p USING (uc, pdf_source)"""))
def audit_provenance(spark, folder):
    return AU.with_page_provenance(B.item_lines(spark, folder)).select("uc", "pdf_source", "valor", "page_first_seen", "audit_pdf_pages")


@query("audit_duplicates", with_base(LINES, """
SELECT count(*) AS unique_pairs, count(*) FILTER (n > 1) AS duplicate_pairs, max(n) AS max_rows
FROM (SELECT uc, referencia, count(*) AS n FROM lines GROUP BY 1, 2)"""))
def audit_duplicates(spark, folder):
    return AU.duplicate_report(B.item_lines(spark, folder))


@query("audit_worst_duplicates", with_base(LINES, """
SELECT uc, referencia, count(*) AS rows FROM lines GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 10"""))
def audit_worst_duplicates(spark, folder):
    return AU.worst_duplicates(B.item_lines(spark, folder))


@query("audit_value_counts", with_base(MASTER, """
SELECT categoria AS value, 'categoria' AS kind, count(*) AS rows FROM master GROUP BY 1
UNION ALL SELECT audit_kwh_source, 'audit_kwh_source', count(*) FROM master GROUP BY 1"""))
def audit_value_counts(spark, folder):
    df = staged_master(spark, folder, "categoria", "audit_kwh_source")
    parts = [AU.value_counts(df, name).select(c(name).alias("value"), F.lit(name).alias("kind"), "rows") for name in df.columns]
    return parts[0].unionByName(parts[1])


@query("audit_blank_counts", with_base(MASTER, """
SELECT count(*) AS rows, count(*) FILTER (total_fatura_rs IS NULL) AS blank_kwh, count(*) FILTER (custkey % 5 = 0) AS missing_ref FROM master"""))
def audit_blank_counts(spark, folder):
    df = B.master(spark, folder).select(
        F.when(c("custkey") % 5 != 0, c("referencia")).alias("referencia"), c("total_fatura_rs").alias("kwh_total_te"))
    return AU.blank_counts(df)


@query("audit_page_order", with_base(MASTER, """, f AS (SELECT uc, min(page_first_seen)::double AS first_page FROM master WHERE custkey % 7 <> 0 GROUP BY 1)
SELECT uc, row_number() OVER (ORDER BY first_page NULLS LAST, uc) - 1 AS position FROM (SELECT DISTINCT uc FROM master) LEFT JOIN f USING (uc)"""))
def audit_page_order(spark, folder):
    """Units in the order of their first pages, of which some are not known, each with its place."""
    df = staged_master(spark, folder, "uc", "page_first_seen", "custkey")
    ordered = AU.order_by_first_page(df.select("uc").distinct(), df.filter("custkey % 7 <> 0"))
    return numbered(ordered, "position").select("uc", "position")


@query("dedupe_by_content", """
SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'kept' ELSE 'skipped' END AS outcome FROM documents""")
def dedupe_by_content(spark, folder):
    kept, skipped = AU.split_by_content(B.table(spark, folder, "documents").select("doc_id", "text"), c("text"), "doc_id")
    return kept.select("doc_id", F.lit("kept").alias("outcome")).unionByName(skipped.select("doc_id", F.lit("skipped").alias("outcome")))


@query("merge_tables", with_base(MASTER, """
SELECT DISTINCT uc, referencia, categoria, kwh_total_te, CASE WHEN categoria = 'B3' THEN NULL ELSE municipio END AS municipio
FROM master WHERE categoria IN ('A4', 'B3', 'IP')"""))
def merge_tables(spark, folder):
    df = B.master(spark, folder).select("uc", "referencia", "categoria", "kwh_total_te", "municipio")
    b3, others = df.filter("categoria = 'B3'").drop("municipio"), df.filter("categoria <> 'B3'")
    return RD.union_tables([others, b3, others])


@query("first_row_per_unit", with_base(MASTER, """
SELECT uc, referencia, pdf_source, page_first_seen, kwh_total_te FROM (
  SELECT *, row_number() OVER (PARTITION BY uc ORDER BY pdf_source, page_first_seen, referencia, kwh_total_te) AS rn FROM master) WHERE rn = 1"""))
def first_row_per_unit(spark, folder):
    df = B.master(spark, folder).select("uc", "referencia", "pdf_source", "page_first_seen", "kwh_total_te")
    return MX.first_rows(df, ["uc"], F.struct("pdf_source", "page_first_seen", "referencia", "kwh_total_te"))


# =================================================================== matrices
@query("month_window", with_base(MASTER, """
SELECT cast(i AS bigint) AS slot, printf('%02d/%04d', (last - i - 1) % 12 + 1, (last - i - 1) // 12) AS referencia FROM last, range(13) t(i)"""))
def month_window(spark, folder):
    return MX.window_months(B.master(spark, folder)).select(c("slot").cast("bigint").alias("slot"), "referencia")


@query("month_list_all", with_base(MASTER, """
SELECT cast(row_number() OVER (ORDER BY ix DESC) - 1 AS bigint) AS slot, referencia FROM (SELECT DISTINCT ix, referencia FROM master)"""))
def month_list_all(spark, folder):
    return MX.window_months(B.master(spark, folder), 0).select(c("slot").cast("bigint").alias("slot"), "referencia")


def _matrix_sql(keys: str) -> str:
    return with_base(MASTER, f"SELECT {keys}, {slots('kwh_total_te', slot='last - ix')} FROM master, last GROUP BY {keys}")


@query("matrix_by_unit", _matrix_sql("uc"))
def matrix_by_unit(spark, folder):
    return MX.month_matrix(staged_master(spark, folder, "uc", "referencia", "kwh_total_te"), ["uc"])


@query("matrix_by_attributes", _matrix_sql("uc, categoria, grupo_tensao, subgrupo, nome, endereco"))
def matrix_by_attributes(spark, folder):
    keys = ["uc", "categoria", "grupo_tensao", "subgrupo", "nome", "endereco"]
    return MX.month_matrix(staged_master(spark, folder, *keys, "referencia", "kwh_total_te"), keys)


@query("matrix_by_source", _matrix_sql("nome, endereco, uc, categoria, tipo_fornecimento, pdf_source"))
def matrix_by_source(spark, folder):
    keys = ["nome", "endereco", "uc", "categoria", "tipo_fornecimento", "pdf_source"]
    return MX.month_matrix(staged_master(spark, folder, *keys, "referencia", "kwh_total_te"), keys)


@query("matrix_by_category", _matrix_sql("categoria"))
def matrix_by_category(spark, folder):
    keys = ["categoria"]
    return MX.month_matrix(staged_master(spark, folder, *keys, "referencia", "kwh_total_te"), keys)


_CYCLE = [f"{m:02d}/1999" for m in range(1, 13)]
_CYCLE_SUMS = ", ".join(f"{total(f'''CASE WHEN referencia = '{r}' THEN kwh_total_te END''')} AS m{i:02d}" for i, r in enumerate(_CYCLE))
_IN_CYCLE = "referencia IN (" + ", ".join(f"'{r}'" for r in _CYCLE) + ")"


@query("matrix_fixed_cycle", with_base(MASTER, f"""
SELECT *, round({mean(12)}, 6) AS media_mensal FROM (SELECT uc, categoria, {_CYCLE_SUMS} FROM master WHERE {_IN_CYCLE} GROUP BY 1, 2)"""))
def matrix_fixed_cycle(spark, folder):
    out = MX.fixed_cycle_matrix(B.master(spark, folder), ["uc", "categoria"], cycle=_CYCLE)
    return out.withColumn("media_mensal", F.round("media_mensal", 6))


_FIRST_ATTRS = ("first(tipo_fornecimento ORDER BY pdf_source, page_first_seen, tipo_fornecimento) FILTER (trim(tipo_fornecimento) <> '')")


def _category_sql(cats: str, label: str) -> str:
    filled = ", ".join(f"CASE WHEN abs(m{i:02d}) <= 1e-9 THEN disp ELSE m{i:02d} END AS m{i:02d}" for i in range(13))
    return with_base(MASTER, f"""
SELECT LOCAL, ENDERECO, UC, '{label}' AS CLASSIFICACAO, TIPO_FORNECIMENTO, disp AS DISPONIBILIDADE, round({mean()} - disp, 6) AS SALDO,
       {', '.join(f'm{i:02d}' for i in range(13))}, round({mean()}, 6) AS MEDIA_MENSAL, PDF_INFO FROM (
  SELECT LOCAL, ENDERECO, UC, TIPO_FORNECIMENTO, disp, PDF_INFO, {filled} FROM (
    SELECT *, CASE TIPO_FORNECIMENTO WHEN 'TRIFÁSICO' THEN 100.0 WHEN 'BIFÁSICO' THEN 50.0 WHEN 'MONOFÁSICO' THEN 30.0 ELSE 0.0 END::double AS disp FROM (
      SELECT uc AS UC, min(nome) AS LOCAL, min(endereco) AS ENDERECO, coalesce({_FIRST_ATTRS}, '') AS TIPO_FORNECIMENTO,
             first(pdf_source ORDER BY pdf_source, page_first_seen) AS PDF_INFO, {slots('kwh_total_te', slot='last - ix')}
      FROM master, last WHERE categoria IN ({cats}) GROUP BY uc)))""")


def _category_table(spark, folder, cats, label):
    out = MX.in_page_order(MX.category_table(staged_master(spark, folder, *_TABLE_COLUMNS), cats, label))
    return out.withColumns({"SALDO": F.round("SALDO", 6), "MEDIA_MENSAL": F.round("MEDIA_MENSAL", 6)})


@query("category_table_b3", _category_sql("'B3'", "B3"))
def category_table_b3(spark, folder):
    return _category_table(spark, folder, ["B3"], "B3")


@query("category_table_ip", _category_sql("'IP'", "B4 A Ilum, Pública"))
def category_table_ip(spark, folder):
    return _category_table(spark, folder, ["IP"], "B4 A Ilum, Pública")


_SERIES = {"demanda_hp": "demanda_hp_kw", "demanda_fhp": "demanda_fhp_kw", "consumo_hp": "consumo_hp_kwh", "consumo_fhp": "consumo_fhp_kwh"}
_LOCK = """coalesce(max(CASE WHEN demanda_contratada_kw > 0 THEN demanda_contratada_kw END), 0) AS contr,
             coalesce(max(CASE WHEN dif_demanda > 0 THEN dif_demanda END), 0) AS over,
             greatest(max(coalesce(demanda_hp_kw, 0)), max(coalesce(demanda_fhp_kw, 0))) AS peak"""
_LOCK_COLUMNS = """CASE WHEN contr > 0 THEN contr ELSE peak END AS DEMANDA_CONTRATADA_UNICA_KW, peak AS MAIOR_DEMANDA_MEDIDA_KW,
       CASE WHEN over > 0 THEN over ELSE greatest(peak - CASE WHEN contr > 0 THEN contr ELSE peak END, 0) END AS DEMANDA_ULTRAPASSADA_KW"""


def _a4_series_sql() -> str:
    sums = ", ".join(total(f"CASE WHEN last - ix = {i} THEN {col} END") + f" AS {n}_{i:02d}" for n, col in _SERIES.items() for i in range(13))
    def shown(n):
        return " || ',' || ".join(f"cast(cast(CASE WHEN abs({n}_{i:02d}) <= 1e-9 AND disp > 0 THEN disp ELSE {n}_{i:02d} END AS bigint) AS varchar)" for i in range(13)) + f" AS {n}"
    return with_base(MASTER, f"""
SELECT LOCAL, ENDERECO, UC, 'A4 VERDE' AS CLASSIFICACAO, {_LOCK_COLUMNS}, {', '.join(shown(n) for n in _SERIES)}, PDF_INFO FROM (
  SELECT *, CASE tipo WHEN 'TRIFÁSICO' THEN 100.0 WHEN 'BIFÁSICO' THEN 50.0 WHEN 'MONOFÁSICO' THEN 30.0 ELSE 0.0 END::double AS disp FROM (
    SELECT uc AS UC, min(nome) AS LOCAL, min(endereco) AS ENDERECO, coalesce({_FIRST_ATTRS}, '') AS tipo,
           first(pdf_source ORDER BY pdf_source, page_first_seen) AS PDF_INFO, {_LOCK}, {sums}
    FROM master, last WHERE categoria = 'A4' GROUP BY uc))""")


@query("a4_table", _a4_series_sql())
def a4_table(spark, folder):
    out = MX.in_page_order(MX.a4_table(staged_master(spark, folder, *_A4_COLUMNS)))
    return out.withColumns({n: F.array_join(c(n).cast("array<bigint>").cast("array<string>"), ",") for n in _SERIES})


@query("demand_lock", with_base(MASTER, f"""
SELECT uc, {_LOCK_COLUMNS} FROM (SELECT uc, {_LOCK} FROM master WHERE categoria = 'A4' GROUP BY uc)"""))
def demand_lock(spark, folder):
    return MX.demand_lock_table(B.master(spark, folder))


@query("unit_template", with_base(MASTER, f"""
SELECT b.nome, b.endereco, s.uc, b.categoria, b.tipo_fornecimento, b.disp AS DISPONIBILIDADE, '' AS SALDO, '' AS audit_pdf_pages,
       {', '.join(f'm{i:02d}' for i in range(13))}, round({mean()}, 6) AS MEDIA_MENSAL
FROM (SELECT uc, {slots('kwh_total_te', slot='last - ix')} FROM master, last GROUP BY 1) s JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uc ORDER BY pdf_source, page_first_seen, nome, endereco, categoria, tipo_fornecimento) AS rn FROM master) WHERE rn = 1) b USING (uc)"""))
def unit_template(spark, folder):
    out = MX.in_page_order(MX.uc_template(staged_master(spark, folder, *_TABLE_COLUMNS)), "uc")
    return out.withColumn("MEDIA_MENSAL", F.round("MEDIA_MENSAL", 6))


@query("unit_final_template", with_base(MASTER, f"""
SELECT nome, endereco, uc, categoria, coalesce(tipo, '') AS tipo_fornecimento, cast(CASE tipo WHEN 'TRIFÁSICO' THEN 100 WHEN 'BIFÁSICO' THEN 50 WHEN 'MONOFÁSICO' THEN 30 ELSE 0 END AS bigint) AS disponibilidade,
       '' AS saldo, pagina_pdf, {', '.join(f'm{i:02d}' for i in range(12))}, round({mean(12)}, 6) AS media_mensal
FROM (SELECT uc, min(nome) AS nome, min(endereco) AS endereco, min(categoria) AS categoria, min(page_first_seen) AS pagina_pdf, {_CYCLE_SUMS} FROM master GROUP BY 1)
LEFT JOIN (SELECT uc, tipo_fornecimento AS tipo FROM (
  SELECT uc, tipo_fornecimento, row_number() OVER (PARTITION BY uc ORDER BY count(*) DESC, tipo_fornecimento) AS rn
  FROM master WHERE tipo_fornecimento <> '' GROUP BY 1, 2) WHERE rn = 1) USING (uc)"""))
def unit_final_template(spark, folder):
    out = MX.uc_final_template(B.master(spark, folder), _CYCLE)
    return out.withColumns({"media_mensal": F.round("media_mensal", 6), "disponibilidade": c("disponibilidade").cast("bigint")})


def _filled_total(cats: str, measure: str) -> str:
    return f"""(SELECT round({total(f'CASE WHEN abs(x) <= 1e-9 THEN disp ELSE x END')} / 13.0, 6) FROM (
      SELECT uc, i, any_value(disp) AS disp, {total(f'CASE WHEN last - ix = i THEN {measure} END')} AS x FROM (
        SELECT m.uc, m.ix, m.{measure}, u.disp FROM master m JOIN (
          SELECT uc, CASE coalesce({_FIRST_ATTRS}, '') WHEN 'TRIFÁSICO' THEN 100.0 WHEN 'BIFÁSICO' THEN 50.0 WHEN 'MONOFÁSICO' THEN 30.0 ELSE 0.0 END::double AS disp
          FROM master WHERE categoria IN ({cats}) GROUP BY 1) u USING (uc) WHERE categoria IN ({cats})), last, range(13) t(i) GROUP BY 1, 2))"""


@query("sizing_inputs", with_base(MASTER, f"""
SELECT {_filled_total("'B3'", 'kwh_total_te')} AS b3_media, {_filled_total("'IP'", 'kwh_total_te')} AS ip_media,
       {_filled_total("'A4'", 'consumo_hp_kwh')} AS a4_hp_media, {_filled_total("'A4'", 'consumo_fhp_kwh')} AS a4_fhp_media"""))
def sizing_inputs(spark, folder):
    return MX.sizing_inputs(staged_master(spark, folder, *_A4_COLUMNS)).select(*r6("b3_media", "ip_media", "a4_hp_media", "a4_fhp_media"))


@query("mean_month_totals", with_base(MASTER, f"""
SELECT round({total('kwh_total_te')} / 13.0, 6) AS matrix_mean, round({total("CASE WHEN categoria = 'A4' THEN consumo_hp_kwh END")} / 13.0, 6) AS series_mean
FROM master, last WHERE last - ix BETWEEN 0 AND 12"""))
def mean_month_totals(spark, folder):
    df = staged_master(spark, folder, *_A4_COLUMNS)
    matrix = MX.mean_month_total(MX.month_matrix(df, ["uc"]), name="matrix_mean")
    series = MX.mean_series_total(MX.a4_table(df, fill_zeros=False), "consumo_hp", name="series_mean")
    return matrix.crossJoin(series).select(*r6("matrix_mean", "series_mean"))


@query("reconciliation", with_base(MASTER, f"""
, w AS (SELECT uc, kwh_total_te, last - ix AS slot FROM master, last WHERE last - ix BETWEEN 0 AND 12), units AS (SELECT uc, {slots('kwh_total_te')} FROM w GROUP BY 1),
t AS (SELECT (SELECT {total('kwh_total_te')} FROM w) AS master_total, (SELECT {total(mean() + ' * 13.0')} FROM units) AS template_total)
SELECT master_total, round(template_total, 3) AS template_total, round(master_total - template_total, 3) AS difference FROM t"""))
def reconciliation(spark, folder):
    out = MX.reconciliation(staged_master(spark, folder, *_TABLE_COLUMNS))
    return out.withColumns({n: F.round(n, 3) for n in ("template_total", "difference")})


_YIELDS = "(VALUES ('Conservador', 1250), ('Base', 1350), ('Otimista', 1450)) s(cenario, produtividade)"


@query("plant_scenarios", with_base(MASTER, f"""
SELECT cenario, cast(produtividade AS bigint) AS produtividade, total_kwh, round(total_kwh / produtividade, 6) AS kwp, round(total_kwh / produtividade / 1000.0, 6) AS mwp, total_a4_kwh, total_b3_kwh, total_ip_kwh
FROM (SELECT {total('kwh_total_te')} AS total_kwh, {total("CASE WHEN categoria = 'A4' THEN kwh_total_te END")} AS total_a4_kwh,
             {total("CASE WHEN categoria = 'B3' THEN kwh_total_te END")} AS total_b3_kwh, {total("CASE WHEN categoria = 'IP' THEN kwh_total_te END")} AS total_ip_kwh
      FROM master, last WHERE last - ix BETWEEN 0 AND 12), {_YIELDS}"""))
def plant_scenarios(spark, folder):
    return MX.plant_scenarios(staged_master(spark, folder, *_SIZING_COLUMNS)).select(
        "cenario", *big("produtividade"), "total_kwh", *r6("kwp", "mwp"), "total_a4_kwh", "total_b3_kwh", "total_ip_kwh")


@query("plant_scenarios_cycle", with_base(MASTER, f"""
SELECT categoria, cenario, cast(produtividade AS bigint) AS produtividade, kwh AS consumo_kwh, round(kwh / produtividade, 3) AS kwp, round(kwh / produtividade / 1000.0, 6) AS mwp
FROM (SELECT categoria, {total('kwh_total_te')} AS kwh FROM master WHERE {_IN_CYCLE} GROUP BY 1
      UNION ALL SELECT 'TOTAL', {total('kwh_total_te')} FROM master WHERE {_IN_CYCLE}), {_YIELDS}"""))
def plant_scenarios_cycle(spark, folder):
    out = MX.cycle_plant_scenarios(B.master(spark, folder), _CYCLE)
    return out.select("categoria", "cenario", *big("produtividade"), "consumo_kwh", "kwp", "mwp")


@query("sheet_split", with_base(MASTER, f"""
, u AS (SELECT uc, min(categoria) AS categoria, min(nome) AS nome FROM master GROUP BY 1)
SELECT 'GERAL' AS sheet, uc, categoria, nome FROM u UNION ALL SELECT categoria, uc, categoria, nome FROM u WHERE categoria <> 'OUTROS'"""))
def sheet_split(spark, folder):
    """The units on each sheet of the workbook, the general one included."""
    template = MX.uc_template(staged_master(spark, folder, *_TABLE_COLUMNS)).select("uc", "categoria", "nome")
    sheets = MX.template_sheets(materialize(template))  # written, so that a task does not aggregate it once per sheet
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("sheet"), "uc", "categoria", "nome") for name, df in sheets.items()])


# =================================================================== cost analytics
def enriched(spark: SparkSession, folder: str) -> DataFrame:
    return AN.with_costs(B.master(spark, folder))


def staged_costs(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(enriched(spark, folder))


_COST_COLUMNS = ["extra_demand_kw", "estimated_energy_cost_rs", "estimated_extra_demand_cost_rs", "estimated_total_cost_rs",
                 "actual_total_cost_rs", "total_cost_rs"]


@query("cost_columns", with_base(COSTS, """
SELECT uc, referencia, cost_source, extra_demand_kw, round(est_energy, 6) AS estimated_energy_cost_rs, round(est_demand, 6) AS estimated_extra_demand_cost_rs,
       round(estimated_total_cost_rs, 6) AS estimated_total_cost_rs, round(actual_total_cost_rs, 6) AS actual_total_cost_rs, round(total_cost_rs, 6) AS total_cost_rs FROM enriched"""))
def cost_columns(spark, folder):
    return enriched(spark, folder).select("uc", "referencia", "cost_source", *r6(*_COST_COLUMNS))


@query("monthly_financials", with_base(COSTS, f"""
SELECT strftime(reference_date, '%Y-%m-%d') AS month, {total('kwh_total_te')} AS kwh_total_te, {total('extra_demand_kw')} AS extra_demand_kw,
       {total('total_cost_rs')} AS total_cost_rs, {total('actual_total_cost_rs')} AS actual_total_cost_rs FROM enriched GROUP BY 1"""))
def monthly_financials(spark, folder):
    return AN.monthly_financials(enriched(spark, folder)).select(
        F.date_format("reference_date", "yyyy-MM-dd").alias("month"), "kwh_total_te", "extra_demand_kw", "total_cost_rs", "actual_total_cost_rs")


@query("monthly_kwh_by_municipality", with_base(MASTER, f"""
SELECT municipio, strftime(reference_date, '%Y-%m-%d') AS month, {total('kwh_total_te')} AS kwh_total_te FROM master GROUP BY 1, 2"""))
def monthly_kwh_by_municipality(spark, folder):
    return AN.monthly_kwh_by_municipality(B.master(spark, folder)).select(
        "municipio", F.date_format("reference_date", "yyyy-MM-dd").alias("month"), "kwh_total_te")


@query("category_kwh", with_base(MASTER, f"SELECT nullif(categoria, 'OUTROS') AS categoria, {total('kwh_total_te')} AS kwh_total_te FROM master GROUP BY 1"))
def category_kwh(spark, folder):
    df = B.master(spark, folder).withColumn("categoria", F.nullif("categoria", F.lit("OUTROS")))
    return AN.category_kwh(df)


_PROFILE = f"""SELECT municipio, {total('kwh_total_te')} AS total_kwh, {total('total_cost_rs')} AS total_cost_rs, {total('extra_demand_kw')} AS extra_demand_kw,
       count(DISTINCT uc) AS uc_count, {total('consumo_hp_kwh')} AS hp, {total('consumo_fhp_kwh')} AS fhp FROM enriched GROUP BY 1"""


@query("municipality_profile", with_base(COSTS, f"""
SELECT municipio, total_kwh, total_cost_rs, extra_demand_kw, uc_count, round(coalesce(hp / nullif(hp + fhp, 0) * 100.0, 0), 6) AS peak_share_pct,
       round(coalesce(total_cost_rs / nullif(total_kwh, 0), 0), 6) AS avg_cost_per_kwh_rs FROM ({_PROFILE})"""))
def municipality_profile(spark, folder):
    out = AN.municipality_profile(enriched(spark, folder))
    return out.withColumns({n: F.round(n, 6) for n in ("peak_share_pct", "avg_cost_per_kwh_rs")})


@query("top_units", with_base(MASTER, f"""
SELECT municipio, uc, {total('kwh_total_te')} AS kwh_total_te, municipio || ' | ' || uc AS uc_label FROM master GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15"""))
def top_units(spark, folder):
    return AN.top_units(B.master(spark, folder))


_INEFFICIENCY = f"""SELECT *, round(coalesce(consumo_hp_kwh / nullif(consumo_hp_kwh + consumo_fhp_kwh, 0) * 100.0, 0), 6) AS peak_share_pct, extra_demand_kw * 42.0 AS estimated_extra_demand_cost_rs
FROM (SELECT municipio, uc, {total('consumo_hp_kwh')} AS consumo_hp_kwh, {total('consumo_fhp_kwh')} AS consumo_fhp_kwh, {total('extra_demand_kw')} AS extra_demand_kw FROM enriched GROUP BY 1, 2)
ORDER BY estimated_extra_demand_cost_rs DESC, consumo_hp_kwh / nullif(consumo_hp_kwh + consumo_fhp_kwh, 0) DESC NULLS LAST, municipio, uc"""


@query("inefficiency_ranking", with_base(COSTS, f"{_INEFFICIENCY} LIMIT 25"))
def inefficiency_ranking(spark, folder):
    return AN.inefficiency_ranking(enriched(spark, folder)).withColumn("peak_share_pct", F.round("peak_share_pct", 6))


@query("top_extra_demand", with_base(COSTS, f"SELECT *, municipio || ' | ' || uc AS uc_label FROM ({_INEFFICIENCY} LIMIT 10)"))
def top_extra_demand(spark, folder):
    return AN.top_extra_demand(enriched(spark, folder)).withColumn("peak_share_pct", F.round("peak_share_pct", 6))


@query("row_counts", with_base(COSTS, """
SELECT count(*) AS rows, count(DISTINCT uc) AS ucs, count(DISTINCT municipio) AS municipios, count(*) FILTER (extra_demand_kw > 0) AS extra_demand_events,
       count(*) FILTER (total_fatura_rs > 0) AS billed_invoices FROM enriched"""))
def row_counts(spark, folder):
    return AN.row_counts(enriched(spark, folder))


_KPI = f"""kpi AS (SELECT {total('total_cost_rs')} AS total_cost, {total('actual_total_cost_rs')} AS actual_cost, {total('kwh_total_te')} AS kwh,
  {total('itens_fatura_energia_valor_rs')} AS item_value, {total('itens_fatura_energia_kwh')} AS item_kwh, {total('consumo_hp_kwh')} AS hp, {total('consumo_fhp_kwh')} AS fhp,
  {total('extra_demand_kw')} AS extra, {total('total_fatura_rs')} AS billed, count(*) FILTER (total_fatura_rs > 0) AS billed_n,
  {total("CASE WHEN cost_source = 'estimated' THEN estimated_total_cost_rs END")} AS fallback, max(reference_date) AS latest FROM enriched),
kpi_month AS (SELECT {total('CASE WHEN reference_date = latest THEN total_cost_rs END')} AS month_cost,
  {total('CASE WHEN year(reference_date) = year(latest) THEN total_cost_rs END')} AS ytd, strftime(any_value(latest), '%m/%Y') AS lbl FROM enriched, kpi)"""


def _kpi_sql(app: bool) -> str:
    rows = [
        ("total_monthly_cost_rs", "month_cost", None, "lbl"), ("ytd_spending_rs", "ytd", None, "lbl"),
        ("avg_cost_per_kwh_rs", "item_value / item_kwh", None, "'filtered period'"),
        ("avg_cost_per_kwh_source", None, "'Itens da Fatura (Valor/Quantidade)'", "'calculation method'"),
        ("itens_fatura_energia_valor_rs", "item_value", None, "'filtered period'"), ("itens_fatura_energia_kwh", "item_kwh", None, "'filtered period'"),
        ("actual_cost_rs", "actual_cost", None, "'filtered period'"), ("actual_cost_share_pct", "actual_cost / total_cost * 100.0", None, "'filtered period'"),
        ("peak_share_pct", "hp / (hp + fhp) * 100.0", None, "'filtered period'"), ("extra_demand_kw", "extra", None, "'filtered period'"),
    ]
    if app:
        rows += [("estimated_fallback_cost_rs", "fallback", None, "'filtered period'"), ("billed_total_rs", "billed", None, "'filtered period'"),
                 ("billed_invoice_count", "billed_n", None, "'filtered period'")]
    selects = [f"SELECT '{m}' AS metric, round(cast({v or 'NULL'} AS double), 4) AS value, cast({t or 'NULL'} AS varchar) AS text, {ref} AS reference FROM kpi, kpi_month" for m, v, t, ref in rows]
    return with_base(COSTS, f", {_KPI} " + " UNION ALL ".join(selects))


@query("summary_kpis", _kpi_sql(False))
def summary_kpis(spark, folder):
    return AN.kpi_rows(AN.kpis(enriched(spark, folder))).withColumn("value", F.round("value", 4))


@query("app_kpis", _kpi_sql(True))
def app_kpis(spark, folder):
    return AN.kpi_rows(AN.kpis(enriched(spark, folder)), app_variant=True).withColumn("value", F.round("value", 4))


_SELECTED = ["NATION_1", "NATION_7", "NATION_12"]
_RANGE = ("1998-01-01", "2000-12-01")


def _selection(spark, folder):
    pool = AN.date_filter(staged_costs(spark, folder), _RANGE)
    return AN.municipality_filter(pool, _SELECTED), pool


_FILTERED = f"""pool AS (SELECT * FROM enriched WHERE reference_date BETWEEN date '{_RANGE[0]}' AND date '{_RANGE[1]}'),
sel AS (SELECT * FROM pool WHERE municipio IN ({', '.join(repr(s) for s in _SELECTED)})),
prof AS (SELECT municipio, total_kwh, extra_demand_kw, round(coalesce(hp / nullif(hp + fhp, 0) * 100.0, 0), 6) AS peak FROM ({_PROFILE.replace('FROM enriched', 'FROM pool')})),
avgs AS (SELECT {total('total_kwh')} / count(*) AS avg_kwh, {total('peak')} / count(*) AS avg_peak, {total('extra_demand_kw')} / count(*) AS avg_extra FROM prof),
own AS (SELECT {total('kwh_total_te')} AS kwh, {total('consumo_hp_kwh')} AS hp, {total('consumo_fhp_kwh')} AS fhp, {total('extra_demand_kw')} AS extra,
               {total('itens_fatura_energia_valor_rs')} / {total('itens_fatura_energia_kwh')} AS cost FROM sel)"""


@query("benchmark_deltas", with_base(COSTS, f""", {_FILTERED}
SELECT round((kwh / avg_kwh - 1.0) * 100.0, 4) AS selected_vs_avg_kwh_pct, round(hp / (hp + fhp) * 100.0 - avg_peak, 4) AS peak_share_delta_pp,
       round(extra - avg_extra, 4) AS extra_demand_delta_kw, kwh AS total_kwh, round(hp / (hp + fhp) * 100.0, 4) AS peak_share_pct, extra AS extra_demand_kw FROM own, avgs"""))
def benchmark_deltas(spark, folder):
    out = AN.benchmark_deltas(*_selection(spark, folder))
    return out.select(*[F.round(n, 4).alias(n) if n not in ("total_kwh", "extra_demand_kw") else c(n) for n in out.columns])


@query("savings_tips", with_base(COSTS, f""", {_FILTERED},
facts AS (SELECT hp / (hp + fhp) * 100.0 AS peak, extra, (kwh / avg_kwh - 1.0) * 100.0 AS above, cost FROM own, avgs)
SELECT 'Peak-hour consumption is ' || printf('%.1f', peak) || '%. Shift discretionary loads outside peak to target <= 25%.' AS savings_opportunity FROM facts WHERE peak > 25
UNION ALL SELECT 'Detected ' || format('{{:,.2f}}', extra) || ' kW of extra demand, adding about R$ ' || {ptbr('extra * 42.0')} || '. Review contracted demand and stagger equipment starts.' FROM facts WHERE extra > 0
UNION ALL SELECT 'Usage is ' || printf('%.1f', above) || '% above municipality average benchmark. Prioritize audits for top UCs by kWh (Quilowatt-hora).' FROM facts WHERE above > 10
UNION ALL SELECT 'Average cost per kWh (Quilowatt-hora) is materially above base tariff. Focus on demand overruns and corrections.' FROM facts WHERE cost > 0.85 * 1.15"""))
def savings_tips(spark, folder):
    return AN.savings_opportunities(*_selection(spark, folder))


# What is summed of each block of the export; the tips are texts and only counted.
_BLOCK_SUMS = {
    "displayed_data": "total_cost_rs", "monthly_kwh": "kwh_total_te", "monthly_cost": "total_cost_rs", "category_kwh": "kwh_total_te",
    "top_uc_kwh": "kwh_total_te", "inefficiencies": "estimated_extra_demand_cost_rs", "itens_fatura": "valor_rs",
    "benchmark": "total_cost_rs", "summary": "value"}
_ALL_TIPS = _FILTERED.replace(f" WHERE reference_date BETWEEN date '{_RANGE[0]}' AND date '{_RANGE[1]}'", "").replace(
    f" WHERE municipio IN ({', '.join(repr(s) for s in _SELECTED)})", "")


@query("analytics_blocks", with_base(COSTS + ITEMS[len(MONTHS):], f""", {_ALL_TIPS}, {_KPI},
sums AS (SELECT 'displayed_data' AS block, count(*) AS rows, {total_or_null('total_cost_rs')} AS amount FROM enriched
UNION ALL SELECT 'monthly_kwh', count(DISTINCT (municipio, reference_date)), {total_or_null('kwh_total_te')} FROM enriched
UNION ALL SELECT 'monthly_cost', count(DISTINCT reference_date), {total_or_null('total_cost_rs')} FROM enriched
UNION ALL SELECT 'category_kwh', count(DISTINCT categoria), {total_or_null('kwh_total_te')} FROM enriched
UNION ALL SELECT 'top_uc_kwh', count(*), {total_or_null('kwh')} FROM (SELECT municipio, uc, {total('kwh_total_te')} AS kwh FROM enriched GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15)
UNION ALL SELECT 'inefficiencies', count(*), {total_or_null('estimated_extra_demand_cost_rs')} FROM ({_INEFFICIENCY} LIMIT 25)
UNION ALL SELECT 'itens_fatura', count(*), {total_or_null('valor')} FROM item_rows
UNION ALL SELECT 'benchmark', count(*), {total_or_null('total_cost_rs')} FROM ({_PROFILE})
UNION ALL SELECT 'summary', 10, {total_or_null('v')} FROM (SELECT unnest([month_cost, ytd, item_value / item_kwh, item_value, item_kwh, actual_cost, actual_cost / total_cost * 100.0, hp / (hp + fhp) * 100.0, extra]) AS v FROM kpi, kpi_month)
UNION ALL SELECT 'savings_tips', (hp / (hp + fhp) * 100.0 > 25)::int + (extra > 0)::int + ((kwh / avg_kwh - 1.0) * 100.0 > 10)::int + (cost > 0.85 * 1.15)::int, NULL FROM own, avgs)
SELECT block, rows::bigint AS rows, round(amount, 2) AS amount FROM sums"""))
def analytics_blocks(spark, folder):
    """The export as its readers see it: written, read again, each block counted and one of its columns added up."""
    items = B.month_items(spark, folder).select("custkey", "reference_date", "itens_fatura_json")
    raw = materialize(B.master(spark, folder).join(items, ["custkey", "reference_date"], "left"))
    path = f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"
    WR.blocks(AN.analytics_blocks(raw), path)
    fields = F.create_map(*[F.lit(x) for pair in _BLOCK_SUMS.items() for x in pair])
    amount = F.from_json("value", "map<string,string>")[fields[c("block")]].cast("double")
    return spark.read.schema("value string, block string").text(path).groupBy("block").agg(
        F.count(F.lit(1)).alias("rows"), F.round(exact_sum(amount), 2).alias("amount"))


# =================================================================== items and rules
@query("item_explode", with_base(ITEMS, "SELECT uc, referencia, item, qty AS quantidade, price::double AS preco, round(valor, 6) AS valor FROM item_rows"))
def item_explode(spark, folder):
    return IT.item_rows(B.month_items(spark, folder)).select(
        "uc", "referencia", "item", "quantidade", c("preco_unitario_com_tributos_rs").alias("preco"), F.round("valor_rs", 6).alias("valor"))


@query("item_summary", with_base(ITEMS, f"""
SELECT item, {total('valor')} AS total_valor_rs, {total('qty')} AS total_quantidade, round({total('price')} / count(*), 6) AS preco_unitario_medio_rs FROM item_rows GROUP BY 1"""))
def item_summary(spark, folder):
    out = AN.item_summary(IT.item_rows(B.month_items(spark, folder)))
    return out.withColumn("preco_unitario_medio_rs", F.round("preco_unitario_medio_rs", 6))


@query("top_items", with_base(ITEMS, f"""
SELECT item, {total('valor')} AS total_valor_rs, {total('qty')} AS total_quantidade FROM item_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""))
def top_items(spark, folder):
    return AN.top_items(IT.item_rows(B.month_items(spark, folder)), 3).drop("preco_unitario_medio_rs")


_MEASURE_SQL = """
measured AS (SELECT *, greatest(hp_te, hp_tusd) AS hp, greatest(fhp_te, fhp_tusd) AS fhp, greatest(unico_te, unico_tusd) AS unico,
  (hp_te + fhp_te + unico_te) * 0.5 + (hp_tusd + fhp_tusd + unico_tusd) * 0.25 AS money,
  hp_te + fhp_te + unico_te AS te, hp_tusd + fhp_tusd + unico_tusd AS tusd FROM unit_items)"""


@query("item_measures", with_base(ITEMS, f""", {_MEASURE_SQL}
SELECT uc, referencia, round(nullif(money, 0), 6) AS total_valor, round(nullif(kwh, 0), 6) AS energia_kwh, round(money / nullif(kwh, 0), 6) AS preco_medio,
       round((hp_te * 0.5 + hp_tusd * 0.25) / nullif(hp, 0), 6) AS all_in_hp, round((fhp_te * 0.5 + fhp_tusd * 0.25) / nullif(fhp, 0), 6) AS all_in_fhp,
       round(coalesce((unico_te * 0.5 + unico_tusd * 0.25) / nullif(unico, 0), money / nullif(kwh, 0)), 6) AS blended
FROM (SELECT *, CASE WHEN hp > 0 OR fhp > 0 THEN hp + fhp ELSE unico END AS kwh FROM measured)"""))
def item_measures(spark, folder):
    df = B.month_items(spark, folder).withColumn("i", IT.parse_items(c("itens_fatura_json")))
    df = df.withColumn("m", F.when(F.size("i") > 0, IT.item_measures(c("i"))))
    names = {"total_valor": "itens_fatura_total_valor_rs", "energia_kwh": "itens_fatura_energia_kwh", "preco_medio": "itens_fatura_preco_medio_rs_kwh",
             "all_in_hp": "itens_fatura_preco_all_in_hp_rs_kwh", "all_in_fhp": "itens_fatura_preco_all_in_fhp_rs_kwh", "blended": "itens_fatura_preco_all_in_blended_rs_kwh"}
    return df.select("uc", "referencia", *[F.round(c("m")[v], 6).alias(k) for k, v in names.items()])


@query("item_dedupe", with_base(ITEMS, "SELECT uc, referencia, count(*) AS items, round(cast(sum(cast(valor AS decimal(28,6))) AS double), 6) AS valor FROM item_rows GROUP BY 1, 2"))
def item_dedupe(spark, folder):
    i = IT.parse_items(c("itens_fatura_json"))
    df = B.month_items(spark, folder).withColumn("i", i).withColumn("u", IT.unique_items(F.concat("i", F.reverse("i"), "i")))
    total_value = F.aggregate(F.transform("u", lambda x: x["valor"]), F.lit(0.0), lambda a, b: a + b)
    return kept(df, F.size("u") > 0).select("uc", "referencia", F.size("u").cast("bigint").alias("items"), F.round(total_value, 6).alias("valor"))


@query("item_json_variants", with_base(ITEMS, """
SELECT u.uc, u.referencia, coalesce(n, 0) AS plain, CASE WHEN coalesce(n, 0) > 0 THEN coalesce(n, 0) ELSE 0 END AS mixed, 0::bigint AS bare, 0::bigint AS broken
FROM unit_items u LEFT JOIN (SELECT uc, referencia, count(*) AS n FROM item_rows GROUP BY 1, 2) USING (uc, referencia)"""))
def item_json_variants(spark, folder):
    j = c("itens_fatura_json")

    def size(x):
        return F.size(IT.parse_items(x)).cast("bigint")

    def inner(first, last):
        return F.substring(j, F.lit(1 + first), F.length(j) - (first + last))

    # The text is '' or an array of objects, so its ends are cut by position; patterns take several times longer.
    mixed = F.when(j.endswith("]"), F.concat(inner(0, 1), F.lit(', 7, "x", null]'))).otherwise(j)
    return B.month_items(spark, folder).select(
        "uc", "referencia", size(j).alias("plain"), size(mixed).alias("mixed"), size(inner(1, 1)).alias("bare"), size(inner(0, 2)).alias("broken"))


def _ruled(spark, folder):
    """Item months with a stored total and, for A4 only, history values."""
    return B.month_items(spark, folder).withColumns({
        "kwh_total_te": F.lit(1.0), "kwh_b3_ip": F.lit(1.0), "provider_layout": F.lit("CPFL"),
        "audit_kwh_source": F.when(c("custkey") % 4 == 0, "GENERIC_KWH").otherwise("itens_consumo_te/x"),
        "demanda_hp_kw": F.when((c("categoria") == "A4") & (c("custkey") % 2 == 0), 5.0).otherwise(0.0),
        "demanda_fhp_kw": F.lit(0.0), "consumo_hp_kwh": F.lit(0.0), "consumo_fhp_kwh": F.lit(None).cast("double"),
    })


_DISP = "CASE tipo_fornecimento WHEN 'TRIFÁSICO' THEN 100.0 WHEN 'BIFÁSICO' THEN 50.0 WHEN 'MONOFÁSICO' THEN 30.0 ELSE 0.0 END::double"
_RULED = f""", {_MEASURE_SQL},
ruled AS (SELECT *, {_DISP} AS disp, categoria = 'A4' AND custkey % 2 = 0 AS hist FROM measured),
ruled2 AS (SELECT *, CASE WHEN te > 0 AND NOT hist THEN te ELSE 1.0 END AS kwh, CASE WHEN te > 0 AND NOT hist AND categoria IN ('B3', 'IP') THEN te ELSE 1.0 END AS kwh_b FROM ruled)"""


@query("rule_energy_from_items", with_base(ITEMS, _RULED + " SELECT uc, referencia, kwh AS kwh_total_te, kwh_b AS kwh_b3_ip FROM ruled2"))
def rule_energy_from_items(spark, folder):
    return RU.energy_from_items(_ruled(spark, folder)).select("uc", "referencia", "kwh_total_te", "kwh_b3_ip")


@query("rule_zero_to_availability", with_base(MASTER, """
SELECT uc, referencia, CASE WHEN abs(kwh_total_te) <= 1e-9 AND disp > 0 THEN disp ELSE kwh_total_te END AS kwh_total_te,
       CASE WHEN categoria = 'A4' AND abs(consumo_hp_kwh) <= 1e-9 AND disp > 0 THEN disp ELSE consumo_hp_kwh END AS consumo_hp_kwh,
       CASE WHEN categoria = 'A4' AND abs(coalesce(demanda_fhp_kw, 0)) <= 1e-9 AND disp > 0 THEN disp ELSE coalesce(demanda_fhp_kw, 0) END AS demanda_fhp_kw FROM master"""))
def rule_zero_to_availability(spark, folder):
    return RU.zeros_to_availability(B.master(spark, folder)).select("uc", "referencia", "kwh_total_te", "consumo_hp_kwh", "demanda_fhp_kw")


@query("rule_component_pricing", with_base(ITEMS, _RULED + """
SELECT uc, referencia, CASE WHEN te > 0 THEN 0.5 ELSE 0.0 END::double AS preco_te, CASE WHEN tusd > 0 THEN 0.25 ELSE 0.0 END::double AS preco_tusd,
       te * 0.5 AS valor_te, tusd * 0.25 AS valor_tusd, round(CASE WHEN money > 0 THEN money / 1.0 ELSE 0 END, 6) AS preco_all_in_kwh FROM ruled2"""))
def rule_component_pricing(spark, folder):
    out = RU.component_pricing(_ruled(spark, folder))
    return out.select("uc", "referencia", "preco_te", "preco_tusd", "valor_te", "valor_tusd", *r6("preco_all_in_kwh"))


@query("rule_review_flags", with_base(MASTER, """
SELECT uc, referencia, provider_layout = 'GENERIC' OR categoria = 'OUTROS' OR (categoria IN ('B3', 'IP') AND audit_kwh_source NOT LIKE 'ITENS_CONSUMO_TE%') AS needs_review FROM master"""))
def rule_review_flags(spark, folder):
    return RU.review_flags(B.master(spark, folder)).select("uc", "referencia", "needs_review")


@query("rule_finalize", with_base(ITEMS, _RULED + """
SELECT uc, referencia, kwh AS kwh_total_te, round(CASE WHEN money > 0 THEN money / kwh ELSE 0 END, 6) AS preco_all_in_kwh,
       CASE WHEN categoria = 'A4' AND disp > 0 THEN disp ELSE 0.0 END::double AS consumo_fhp_kwh,
       CASE WHEN categoria = 'A4' AND NOT hist AND disp > 0 THEN disp WHEN hist THEN 5.0 ELSE 0.0 END::double AS demanda_hp_kw,
       categoria = 'OUTROS' OR (categoria IN ('B3', 'IP') AND custkey % 4 = 0) AS needs_review, '' AS nome, 0.0::double AS dif_demanda FROM ruled2"""))
def rule_finalize(spark, folder):
    return RU.finalize(_ruled(spark, folder)).select(
        "uc", "referencia", "kwh_total_te", *r6("preco_all_in_kwh"), "consumo_fhp_kwh", "demanda_hp_kw", "needs_review", "nome", "dif_demanda")


@query("output_contract", with_base(MASTER, """
SELECT uc, categoria, coalesce(nullif(municipio, ''), '') AS municipio, '' AS template, coalesce(demanda_hp_kw, 0) AS demanda_hp_kw, page_first_seen::double AS page_first_seen, 0.0::double AS preco_te, false AS needs_review FROM master"""))
def output_contract(spark, folder):
    return FC.with_output_contract(B.master(spark, folder)).select(
        "uc", "categoria", "municipio", "template", "demanda_hp_kw", "page_first_seen", "preco_te", "needs_review")


# =================================================================== contracts and quality
def contract(spark: SparkSession, folder: str) -> DataFrame:
    """The month table under foreign column names, texts where files would hold text."""
    m = B.master(spark, folder)
    k = c("custkey")
    return m.select(
        c("municipio").alias("Município"), c("uc").alias("Unidade Consumidora"), c("categoria").alias("subgrupo"),
        F.when(k % 10 != 0, c("referencia")).otherwise("sem data").alias("referencia"),
        F.when(k % 6 == 0, "0").when(k % 11 == 0, "n/d").otherwise(X.format_brl(c("kwh_total_te"))).alias("kwh_total_te"),
        c("demanda_contratada_kw").alias("Demanda Faturada"), c("pdf_source").alias("arquivo_origem"))


_CONTRACT = MASTER + """,
std AS (SELECT municipio, uc, CASE WHEN categoria = 'OUTROS' THEN 'OUTROS' ELSE categoria END AS consumer_class,
  CASE WHEN custkey % 10 <> 0 THEN reference_date END AS reference_date, CASE WHEN custkey % 10 <> 0 THEN strftime(reference_date, '%Y-%m') END AS reference_month,
  CASE WHEN custkey % 6 = 0 OR custkey % 11 = 0 THEN 0.0 ELSE kwh_total_te END AS consumption_kwh, 50.0::double AS demand_kw, pdf_source AS source_file, custkey FROM master)"""


@query("standardize_contract", with_base(_CONTRACT, """
SELECT municipio, uc, consumer_class, strftime(reference_date, '%Y-%m-%d') AS reference_date, reference_month, consumption_kwh, demand_kw, source_file, 'celesc' AS adapter_name FROM std"""))
def standardize_contract(spark, folder):
    return AD.standardize(contract(spark, folder), "celesc").drop("adapted_at").withColumn(
        "reference_date", F.date_format("reference_date", "yyyy-MM-dd"))


@query("standardize_by_rules", with_base(_CONTRACT, """
SELECT municipio, uc, consumer_class, strftime(reference_date, '%Y-%m-%d') AS reference_date, consumption_kwh, 50.0::double AS demand_kw, source_file, 'copel' AS adapter_name FROM std"""))
def standardize_by_rules(spark, folder):
    return AD.standardize(contract(spark, folder).withColumnRenamed("arquivo_origem", "pdf_source"), "copel").select(
        "municipio", "uc", "consumer_class", F.date_format("reference_date", "yyyy-MM-dd").alias("reference_date"), "consumption_kwh",
        "demand_kw", "source_file", "adapter_name")


@query("adapter_scores", """
SELECT * FROM (VALUES ('celesc', 0.0), ('cemig', 5.5), ('coelba', 1.5), ('copel', 0.0), ('cpfl', 0.0), ('enel', 0.0), ('energisa', 1.0), ('equatorial', 0.0), ('light', 0.0)) v(adapter, score)
WHERE (SELECT count(*) FROM part) > 0""".replace("0.0)", "0.0::double)"))
def adapter_scores(spark, folder):
    # 1.5 for the column name, 2.0 for each of two content words; coelba by column, energisa by file name.
    df = B.table(spark, folder, "part").select(
        F.concat(F.lit("CEMIG Distribuicao "), "p_name").alias("origem"), c("p_brand").alias("fornecedor"),
        c("p_type").alias("conta_cemig"), c("p_size").alias("neoenergia"))
    return AD.adapter_scores(df, ["out/energisa_master.csv"])


@query("class_totals", with_base(_CONTRACT, f"""
SELECT *, "B3" + "IP" + "A4" + "OUTROS" AS "TOTAL" FROM (SELECT {', '.join(total(f"CASE WHEN consumer_class = '{k}' THEN consumption_kwh END") + f' AS "{k}"' for k in ('B3', 'IP', 'A4', 'OUTROS'))} FROM std)"""))
def class_totals(spark, folder):
    return QU.class_totals(AD.standardize(contract(spark, folder), "celesc"))


def standard(spark: SparkSession, folder: str) -> DataFrame:
    return AD.standardize(contract(spark, folder), "celesc")


@query("quality_null_zero", with_base(_CONTRACT, """
SELECT consumer_class, count(*) AS rows, 0::bigint AS null_kwh_rows, count(*) FILTER (consumption_kwh <= 0) AS zero_or_negative_kwh_rows, 0.0::double AS null_kwh_pct,
       round(count(*) FILTER (consumption_kwh <= 0) / count(*), 6) AS zero_or_negative_kwh_pct FROM std WHERE consumer_class <> 'OUTROS' GROUP BY 1"""))
def quality_null_zero(spark, folder):
    out = QU.null_zero_stats(standard(spark, folder))
    return out.withColumns({n: F.round(n, 6) for n in ("null_kwh_pct", "zero_or_negative_kwh_pct")})


_EXPECTED = """
top AS (SELECT max(reference_date) AS mx FROM std),
exp AS (SELECT strftime(cast(mx - to_months(cast(i AS int)) AS date), '%Y-%m') AS month FROM top, range(13) t(i))"""


@query("quality_expected_months", with_base(_CONTRACT, f", {_EXPECTED} SELECT month FROM exp"))
def quality_expected_months(spark, folder):
    return QU.expected_months(standard(spark, folder)).select(F.explode("expected").alias("month"))


@query("quality_missing_months", with_base(_CONTRACT, f""", {_EXPECTED}
SELECT uc, municipio, consumer_class, present AS months_present_count, count(*) AS missing_months_count, string_agg(month, ', ' ORDER BY month) AS missing_months FROM (
  SELECT u.*, month FROM (SELECT uc, min(municipio) AS municipio, min(consumer_class) AS consumer_class, count(DISTINCT reference_month) AS present FROM std GROUP BY 1) u, exp
  WHERE NOT EXISTS (SELECT 1 FROM std s WHERE s.uc = u.uc AND s.reference_month = exp.month)) GROUP BY 1, 2, 3, 4"""))
def quality_missing_months(spark, folder):
    out = QU.quality_report(standard(spark, folder))["ucs_with_missing_months"]
    return out.withColumns({n: c(n).cast("bigint") for n in ("months_present_count", "missing_months_count")})


@query("quality_all_zero", with_base(_CONTRACT, """
SELECT uc, min(municipio) AS municipio, min(consumer_class) AS consumer_class, count(*) AS rows, 0.0::double AS total_kwh FROM std GROUP BY 1
HAVING max(consumption_kwh) <= 0"""))
def quality_all_zero(spark, folder):
    return QU.units_all_zero(standard(spark, folder))


@query("quality_missing_reference", with_base(_CONTRACT, """
SELECT DISTINCT municipio, uc, consumer_class, source_file FROM std WHERE reference_date IS NULL"""))
def quality_missing_reference(spark, folder):
    return QU.rows_without_reference(standard(spark, folder))


@query("quality_summary", with_base(_CONTRACT, """,
f AS (SELECT count(*) AS total_rows, count(DISTINCT uc) AS unique_ucs, count(DISTINCT reference_month) AS month_count, count(*) FILTER (reference_date IS NULL) AS missing_reference_count,
  count(*) FILTER (consumption_kwh <= 0) AS nonpositive_rows FROM std),
z AS (SELECT count(*) AS zero_ucs FROM (SELECT uc FROM std GROUP BY 1 HAVING max(consumption_kwh) <= 0))
SELECT *, concat_ws(' ', CASE WHEN missing_reference_count > 0 THEN 'Existem ' || missing_reference_count || ' linhas sem referencia valida.' END,
  CASE WHEN nonpositive_rows / total_rows > 0.30 THEN 'Mais de 30% das linhas estao com kWh nulo/zero/negativo.' END,
  CASE WHEN zero_ucs > 0 THEN 'Existem ' || zero_ucs || ' UCs com kWh zerado em todos os registros.' END) AS messages, true AS is_critical FROM f, z"""))
def quality_summary(spark, folder):
    out = QU.quality_summary(materialize(standard(spark, folder).select("uc", "reference_month", "reference_date", "consumption_kwh")))
    return out.withColumn("messages", F.array_join("critical_messages", " ")).drop("critical_messages")


@query("quality_report", with_base(_CONTRACT, f""", {_EXPECTED},
u AS (SELECT uc, count(DISTINCT reference_month) AS present, max(consumption_kwh) AS most, count(*) AS n FROM std GROUP BY 1)
SELECT 'expected_months' AS part, month AS name, 1::bigint AS rows FROM exp UNION ALL SELECT 'months_available', reference_month, 1 FROM std WHERE reference_month IS NOT NULL GROUP BY 2
UNION ALL SELECT 'null_zero_stats_by_class', consumer_class, count(*) FROM std WHERE consumer_class <> 'OUTROS' GROUP BY 2
UNION ALL SELECT 'ucs_all_zero_kwh', uc, n FROM u WHERE most <= 0
UNION ALL SELECT 'ucs_with_missing_months', u.uc, count(*) FROM u, exp WHERE NOT EXISTS (SELECT 1 FROM std s WHERE s.uc = u.uc AND s.reference_month = exp.month) GROUP BY 2
UNION ALL SELECT 'missing_references_list', uc, count(*) FROM (SELECT DISTINCT municipio, uc, consumer_class, source_file FROM std WHERE reference_date IS NULL) GROUP BY 2
UNION ALL SELECT 'summary', 'total_rows', count(*) FROM std UNION ALL SELECT 'summary', 'month_count', count(DISTINCT reference_month) FROM std"""))
def quality_report(spark, folder):
    """All seven tables of one report, a row of each with its name and count."""
    parts = QU.quality_report(standard(spark, folder))
    named = {
        "expected_months": ("month", F.lit(1)), "months_available": ("reference_month", F.lit(1)), "null_zero_stats_by_class": ("consumer_class", c("rows")),
        "ucs_all_zero_kwh": ("uc", c("rows")), "ucs_with_missing_months": ("uc", c("missing_months_count")), "missing_references_list": ("uc", F.lit(1))}
    out = [parts[k].select(F.lit(k).alias("part"), c(name).alias("name"), rows.cast("bigint").alias("rows")) for k, (name, rows) in named.items()]
    total = parts["summary"].select(F.lit("summary").alias("part"), F.expr("stack(2, 'total_rows', total_rows, 'month_count', month_count) AS (name, rows)"))
    return reduce(DataFrame.unionByName, [*out, total]).groupBy("part", "name").agg(F.sum("rows").alias("rows"))


@query("contract_profile", with_base(_CONTRACT, """
SELECT 'v1' AS schema_version, 'uc' AS missing, count(*) AS row_count, 0::bigint AS uc_count, count(DISTINCT CASE WHEN custkey % 10 <> 0 THEN strftime(reference_date, '%m/%Y') ELSE 'sem data' END) AS months_count FROM std"""))
def contract_profile(spark, folder):
    out = RD.contract_profile(contract(spark, folder))
    return out.select("schema_version", F.array_join("missing_columns", ",").alias("missing"), "row_count", "uc_count", "months_count")


# =================================================================== sizing and tariffs
_WINDOW = """
town_last AS (SELECT municipio, max(ix) AS last FROM master GROUP BY 1),
win AS (SELECT m.*, t.last FROM master m JOIN town_last t USING (municipio) WHERE t.last - ix BETWEEN 0 AND 12)"""
_CLASS_VALUES = {"B3": "categoria = 'B3' THEN kwh_b3_ip", "B4A": "categoria = 'IP' THEN kwh_b3_ip",
                 "A4_HP": "categoria = 'A4' THEN consumo_hp_kwh", "A4_FHP": "categoria = 'A4' THEN consumo_fhp_kwh"}
_MEANS = ", ".join(f"{total(f'CASE WHEN {v} END')} / 13.0 AS {k.lower()}" for k, v in _CLASS_VALUES.items())
_SIZED = f"""{_WINDOW},
towns AS (SELECT municipio, max(last) AS last, {_MEANS} FROM win GROUP BY 1),
kwp AS (SELECT *, b3 / 117.60000000000001 + b4a / 117.60000000000001 + a4_hp / 117.60000000000001 + a4_fhp / 117.60000000000001 AS kwp FROM towns)"""


@query("municipal_sizing", with_base(MASTER, f""", {_SIZED}
SELECT municipio, round(kwp / 1000.0, 6) AS mwp, round(kwp, 6) AS kwp, round((b3 + b4a + a4_hp + a4_fhp) * 13.0, 4) AS total_kwh, round(kwp / 1000.0 * 8500000.0, 3) AS investment_brl,
       round(b3, 6) AS b3, round(a4_hp, 6) AS a4_hp, printf('%02d/%04d', (last - 12 - 1) % 12 + 1, (last - 12 - 1) // 12) AS first_month, printf('%02d/%04d', (last - 1) % 12 + 1, (last - 1) // 12) AS last_month,
       CASE WHEN b4a > 0 OR a4_hp > 0 THEN NULL ELSE round(b3 * 0.8 + a4_fhp * 0.5, 4) END AS monthly_cost, b4a > 0 OR a4_hp > 0 AS payback_needs_tariff_input FROM kwp"""))
def municipal_sizing(spark, folder):
    tariffs = SZ.given_tariffs(spark, {"B3": 0.8, "A4_FHP": 0.5, "B4A": -1.0})
    out = SZ.municipal_sizing(B.master(spark, folder), tariffs=tariffs)
    use, cost = c("consumo_medio_mensal_kwh"), c("monthly_energy_cost_brl")
    return out.select(
        "municipio", *r6("mwp", "kwp"), F.round("total_kwh", 4).alias("total_kwh"), F.round("investment_brl", 3).alias("investment_brl"),
        F.round(use["B3"], 6).alias("b3"), F.round(use["A4_HP"], 6).alias("a4_hp"), F.element_at("month_labels", 1).alias("first_month"),
        F.element_at("month_labels", -1).alias("last_month"), F.round(cost["TOTAL"], 4).alias("monthly_cost"), "payback_needs_tariff_input")


@query("municipal_series", with_base(MASTER, f""", {_WINDOW}
SELECT municipio, cast(i AS bigint) AS pos, {', '.join(total(f'CASE WHEN last - ix = 12 - i AND {v.replace(" THEN", " THEN")} END') + f' AS {k.lower()}' for k, v in _CLASS_VALUES.items())}
FROM win, range(13) t(i) GROUP BY 1, 2"""))
def municipal_series(spark, folder):
    out = SZ.municipal_sizing(B.master(spark, folder))
    s = c("consumo_mensal_janela_kwh")
    zipped = F.arrays_zip(*[s[k].alias(k.lower()) for k in SZ.CLASSES])
    return out.select("municipio", F.posexplode(zipped).alias("pos", "z")).select("municipio", c("pos").cast("bigint").alias("pos"), *[
        c("z")[k.lower()].alias(k.lower()) for k in SZ.CLASSES])


def _weighted_sql(price: str, weight: str, where: str) -> str:
    return (f"coalesce(cast(sum(cast(CASE WHEN {where} AND {price} > 0 AND {weight} > 0 THEN {price} * {weight} END AS decimal(28,6))) AS double) / "
            f"nullif(cast(sum(cast(CASE WHEN {where} AND {price} > 0 AND {weight} > 0 THEN {weight} END AS decimal(28,6))) AS double), 0), "
            f"cast(sum(cast(CASE WHEN {where} AND {price} > 0 THEN {price} END AS decimal(28,6))) AS double) / nullif(count(CASE WHEN {where} AND {price} > 0 THEN 1 END), 0))")


_PRICED = """
priced AS (SELECT *, coalesce(itens_fatura_preco_medio_rs_kwh, itens_fatura_preco_all_in_fhp_rs_kwh, itens_fatura_preco_all_in_hp_rs_kwh) AS blended,
  coalesce(itens_fatura_preco_all_in_hp_rs_kwh, itens_fatura_preco_medio_rs_kwh) AS hp_price, coalesce(itens_fatura_preco_all_in_fhp_rs_kwh, itens_fatura_preco_medio_rs_kwh) AS fhp_price FROM master)"""
_TARIFF_SQL = f"""tariffs AS (SELECT {_weighted_sql('blended', 'kwh_b3_ip', "categoria = 'B3'")} AS dim_tariff_b3, {_weighted_sql('blended', 'kwh_b3_ip', "categoria = 'IP'")} AS dim_tariff_b4a,
  {_weighted_sql('hp_price', 'consumo_hp_kwh', "categoria = 'A4'")} AS dim_tariff_a4_hp, {_weighted_sql('fhp_price', 'consumo_fhp_kwh', "categoria = 'A4'")} AS dim_tariff_a4_fhp FROM priced)"""


def _tariff_source(spark, folder):
    """Without the subgroup, which names B3 for rows of other categories too."""
    return B.master(spark, folder).drop("subgrupo", "classificacao_uc", "grupo_tensao")


@query("infer_tariffs", with_base(MASTER, f", {_PRICED}, {_TARIFF_SQL} SELECT round(dim_tariff_b3, 4) AS dim_tariff_b3, round(dim_tariff_b4a, 4) AS dim_tariff_b4a, round(dim_tariff_a4_hp, 4) AS dim_tariff_a4_hp, round(dim_tariff_a4_fhp, 4) AS dim_tariff_a4_fhp FROM tariffs"))
def infer_tariffs(spark, folder):
    out = SZ.infer_tariffs(_tariff_source(spark, folder))
    return out.select(*[F.round(n, 4).alias(n) for n in out.columns])


@query("payback_after_tariffs", with_base(MASTER, f""", {_PRICED}, {_TARIFF_SQL}, {_SIZED}
SELECT municipio, round(kwp / 1000.0 * 8500000.0 / nullif(b3 * dim_tariff_b3 + b4a * dim_tariff_b4a + a4_hp * dim_tariff_a4_hp + a4_fhp * dim_tariff_a4_fhp, 0), 3) AS payback_months, false AS payback_needs_tariff_input FROM kwp, tariffs"""))
def payback_after_tariffs(spark, folder):
    out = SZ.sizing_with_inferred_tariffs(materialize(_tariff_source(spark, folder)))
    return out.select("municipio", F.round("payback_months", 3).alias("payback_months"), "payback_needs_tariff_input")


_TOP_TOWN = f"""{_SIZED}, top_town AS (SELECT * FROM kwp ORDER BY kwp DESC, municipio LIMIT 1)"""
_REVIEW = ("Tarifa ausente -> payback indisponivel/estimado. Categoria/fornecimento com deteccao incerta (needs_review).")


@query("dimension_largest", with_base(MASTER, f""", {_TOP_TOWN}
SELECT municipio, round(kwp / 1000.0, 6) AS mwp_ac, round(kwp, 6) AS kwp_total, 'Multiplos cenarios detectados; usado o de maior MWp (Megawatt-pico). {_REVIEW}' AS warnings, true AS needs_review FROM top_town"""))
def dimension_largest(spark, folder):
    df = staged_master(spark, folder)
    out = SZ.dimension(SZ.municipal_sizing(df), df)
    return out.select("municipio", *r6("mwp_ac", "kwp_total"), F.array_join("warnings", " ").alias("warnings"), "needs_review")


@query("dimension_preferred", with_base(MASTER, f""", {_SIZED}
SELECT municipio, round(kwp / 1000.0, 6) AS mwp_ac, '{_REVIEW}' AS warnings FROM kwp WHERE municipio = 'NATION_3'"""))
def dimension_preferred(spark, folder):
    df = staged_master(spark, folder)
    out = SZ.dimension(SZ.municipal_sizing(df), df, preferred=" nation_3 ")
    return out.select("municipio", *r6("mwp_ac"), F.array_join("warnings", " ").alias("warnings"))


@query("month_coverage", with_base(MASTER, "SELECT count(DISTINCT ix) AS month_count FROM master"))
def month_coverage(spark, folder):
    return SZ.month_coverage(B.master(spark, folder))


@query("sizing_summary_scan", """
SELECT n_name AS municipio, 'Base' AS cenario, n_nationkey / 1000.0 AS mwp, n_nationkey::double AS kwp, 1350.0::double AS produtividade_kwh_kwp_ano, n_regionkey::double AS total_kwh FROM nation WHERE n_nationkey % 4 <> 0""")
def sizing_summary_scan(spark, folder):
    k = c("n_nationkey")
    df = B.table(spark, folder, "nation").select(
        c("n_name").alias("Município"), F.lit("Base").alias("Cenário"), F.lit("1.350,0").alias("Produtividade (kWh/kWp.ano)"),
        F.when(k % 4 != 0, k.cast("string")).alias("Potencia Necessaria (kWp)"), c("n_regionkey").cast("string").alias("Total 13m (kWh)"))
    return SZ.read_sizing_summary(df).drop("source_file")


# =================================================================== budget and scenarios
_INPUTS = BU.BudgetInputs(
    mwp_ac=1.0, dc_ac_ratio=1.2, module_wp=550.0, inverter_kw=100.0, module_price_com_bdi_per_kwp=3500.0, inverter_price_com_bdi=60000.0,
    module_price_sem_bdi_per_kwp=2800.0, inverter_price_sem_bdi=48000.0, additional_capex=1000.0)


@query("budget_metrics", with_base(_CONTRACT, f""",
t AS (SELECT {total('consumption_kwh')} AS use_kwh FROM std), b AS (SELECT use_kwh, 1200.0 * 3500.0 + 10 * 60000.0 + 1000.0 AS capex, 1200.0 * 1350.0 AS gen FROM t),
s AS (SELECT *, CASE WHEN use_kwh > 0 THEN least(gen, use_kwh) ELSE gen END AS off FROM b)
SELECT 2182::bigint AS module_count, 10::bigint AS inverter_qty, capex::double AS total_capex_com, (1200.0 * 2800.0 + 10 * 48000.0 + 1000.0)::double AS total_capex_sem, round(off, 4) AS annual_offset_kwh,
       round(off * 0.85 * 0.7, 4) AS annual_ppp_investor_revenue, round(off * 0.85 * 0.7 - capex * 0.02, 4) AS annual_project_cashflow,
       round(CASE WHEN off * 0.85 * 0.7 - capex * 0.02 > 0 THEN capex / (off * 0.85 * 0.7 - capex * 0.02) END, 4) AS simple_payback_years FROM s"""))
def budget_metrics(spark, folder):
    out = BU.budget_metrics(standard(spark, folder), BU.inputs_frame(spark, _INPUTS))
    return out.select(
        *big("module_count", "inverter_qty"), "total_capex_com", "total_capex_sem",
        *[F.round(n, 4).alias(n) for n in ("annual_offset_kwh", "annual_ppp_investor_revenue", "annual_project_cashflow", "simple_payback_years")])


@query("budget_pipeline", with_base(_CONTRACT, f"SELECT consumer_class, {total('consumption_kwh')} AS kwh, 'copel' AS adapter FROM std GROUP BY 1"))
def budget_pipeline(spark, folder):
    raw = contract(spark, folder).withColumn("distribuidora", F.lit("COPEL - Companhia Paranaense")).withColumnRenamed("Unidade Consumidora", "uc")
    result = BU.budget_pipeline(raw, "auto", _INPUTS)
    return result["standardized"].groupBy("consumer_class").agg(
        N.sum_or_zero(c("consumption_kwh")).alias("kwh"), F.max("adapter_name").alias("adapter"))


def _scenario_frames(spark, folder):
    sized = SC.size_scenarios(SC.resolve_equipment(B.scenarios(spark, folder), B.modules(spark, folder), B.inverters(spark, folder)))
    return sized, SC.line_items(SC.normalize_items(B.map_rows(spark, folder)), sized, B.overrides(spark, folder))


_EQUIP = """
mods AS (SELECT *, p_partkey AS pos FROM part), scen AS (
  SELECT r_regionkey AS k, r_name AS name, 1.0 + r_regionkey * 0.1 AS ratio, r_regionkey + 20 AS per_string, r_regionkey + 16 AS per_comb, (r_regionkey + 1.0)::double AS mwp,
         coalesce((SELECT arg_min(400.0 + 10.0 * p_size, p_partkey) FROM part WHERE r_regionkey <> 0 AND p_name = 'red widget'), (SELECT arg_min(400.0 + 10.0 * p_size, p_partkey) FROM part)) AS wp,
         coalesce((SELECT arg_min(p_retailprice, p_partkey) FROM part WHERE r_regionkey <> 0 AND p_name = 'red widget'), (SELECT arg_min(p_retailprice, p_partkey) FROM part)) AS m_sem,
         (100.0 + s_nationkey * 10)::double AS kw, abs(s_acctbal) AS i_sem
  FROM region JOIN supplier ON s_suppkey = r_regionkey + 3),
s1 AS (SELECT *, mwp * 1000.0 AS ac, mwp * 1000.0 * ratio AS dc FROM scen),
s2 AS (SELECT *, ceil(dc / (wp / 1000.0)) AS modules, ceil(ac / kw) AS inv FROM s1),
s3 AS (SELECT *, ceil(modules / per_string) AS strings FROM s2), s4 AS (SELECT *, ceil(strings / per_comb) AS comb FROM s3),
sized AS (SELECT *, ceil(comb * 1.05) AS comb_spare, CASE WHEN k = 1 THEN 0.0 ELSE m_sem END AS msem, round(m_sem * 1.25, 4) AS mcom, CASE WHEN k = 2 THEN 999.5 ELSE i_sem END AS isem, round(i_sem * 1.25, 4) AS icom,
  dc * round(m_sem * 1.25, 4) + inv * round(i_sem * 1.25, 4) AS total_com FROM s4)"""


@query("scenario_sizing", f"""WITH {_EQUIP.strip()}
SELECT name, round(dc, 6) AS dc_kwp, modules::bigint AS module_count, inv::bigint AS inverter_qty, strings::bigint AS strings, comb_spare::bigint AS combiners_with_spare, round(per_string * 41.0, 6) AS vstring_vmp_stc,
       round(per_string * (49.5 * (1.0 + -0.29 / 100.0 * -25.0)), 4) AS vstring_voc_cold, round(dc * msem + inv * isem, 3) AS total_sem, round(total_com, 3) AS total_com,
       (CASE WHEN ratio < 1.05 OR ratio > 1.40 THEN 1 ELSE 0 END + CASE WHEN per_string * (41.0 * (1.0 + -0.29 / 100.0 * 40.0)) < 500 THEN 1 ELSE 0 END)::bigint AS warnings FROM sized""")
def scenario_sizing(spark, folder):
    sized, _ = _scenario_frames(spark, folder)
    return sized.select(
        "name", *r6("dc_kwp"), *big("module_count", "inverter_qty", "strings", "combiners_with_spare"), *r6("vstring_vmp_stc"),
        F.round("vstring_voc_cold", 4).alias("vstring_voc_cold"), F.round("modules_inverters_total_sem", 3).alias("total_sem"),
        F.round("modules_inverters_total_com", 3).alias("total_com"), F.size("warnings").cast("bigint").alias("warnings"))


_RULE = "(['fixed', 'per_mwp_ac', 'per_kwp_dc', 'per_string', 'percent_of_capex'])"
_LINE_SQL = f"""{_EQUIP},
ov AS (SELECT n_nationkey AS k, 'I' || n_nationkey AS item_code, n_nationkey % 2 = 0 AS enabled, {_RULE}[n_nationkey % 5 + 1] AS rule, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 10.0 + 5 END AS sem, n_nationkey * 12.5 + 6.25 AS com FROM nation WHERE n_nationkey % 3 = 0),
it AS (SELECT p_partkey AS pk, p_size % 31 AS sheet_pos, 'SHEET ' || (p_size % 31) AS sheet, 'I' || (p_partkey % 40) AS item_code, p_partkey % 9 <> 0 AS has_q, p_partkey % 13 <> 0 AS dflt, CASE WHEN p_partkey % 5 = 4 THEN 0.01 ELSE p_size END::double AS base,
  p_retailprice AS bsem, round(p_retailprice * 1.25, 4) AS bcom, {_RULE}[p_partkey % 5 + 1] AS rule, p_partkey % 6 = 0 AS up, p_partkey % 50 AS look FROM part),
j AS (SELECT s.*, it.*, ov.item_code IS NOT NULL AS hit, ov.k AS ok, ov.rule AS orule, ov.sem AS osem, ov.com AS ocom, ov.enabled AS oen FROM sized s, it LEFT JOIN ov ON it.item_code = ov.item_code),
q AS (SELECT *, CASE WHEN hit THEN oen ELSE dflt END AS enabled, CASE WHEN hit THEN orule ELSE rule_1 END AS srule,
  CASE WHEN hit THEN CASE orule WHEN 'per_mwp_ac' THEN (ok + 1.5) * mwp WHEN 'per_kwp_dc' THEN 0.25 * dc WHEN 'per_string' THEN 2.0 * strings WHEN 'percent_of_capex' THEN 0.01 * total_com ELSE ok + 2.0 END
       ELSE CASE rule_1 WHEN 'per_mwp_ac' THEN base * (mwp / 30.0) WHEN 'per_kwp_dc' THEN base * (dc / 30000.0) WHEN 'per_string' THEN base * strings WHEN 'percent_of_capex' THEN base * total_com ELSE base END END AS qty0,
  CASE WHEN hit THEN coalesce(osem, bsem) ELSE bsem END AS sem0, CASE WHEN hit THEN coalesce(ocom, bcom) ELSE bcom END AS com0 FROM (SELECT *, rule AS rule_1 FROM j)),
l AS (SELECT *, CASE look WHEN 1 THEN dc WHEN 2 THEN inv WHEN 3 THEN modules WHEN 4 THEN strings WHEN 5 THEN comb_spare ELSE qty0 END AS qty1, CASE look WHEN 1 THEN msem WHEN 2 THEN isem ELSE sem0 END AS sem, CASE look WHEN 1 THEN mcom WHEN 2 THEN icom ELSE com0 END AS com FROM q),
w AS (SELECT *, CASE WHEN NOT has_q THEN NULL WHEN NOT enabled AND look NOT IN (1, 2) THEN 0 WHEN up THEN ceil(qty1) ELSE qty1 END AS qty FROM l),
li AS (SELECT *, CASE WHEN has_q THEN qty * sem ELSE sem END AS sub_sem, CASE WHEN has_q THEN qty * com ELSE com END AS sub_com FROM w)"""


@query("scenario_line_items", f"WITH {_LINE_SQL.strip()} SELECT name AS scenario, pk AS row_pos, item_code, enabled, srule AS scaling_rule, round(coalesce(qty, 0), 4) AS quantity, round(sem, 4) AS price_sem, round(com, 4) AS price_com FROM li")
def scenario_line_items(spark, folder):
    _, lines = _scenario_frames(spark, folder)
    return lines.select("scenario", "row_pos", "item_code", "enabled", "scaling_rule", F.round("quantity", 4).alias("quantity"),
                        F.round("unit_price_sem", 4).alias("price_sem"), F.round("unit_price_com", 4).alias("price_com"))


# Whole cents, cut off-grid: sums of prices often end on half a cent, where the
# two engines round differently.
_CENT_OFFSET = 0.3712345


def _sum2(col: str) -> str:
    return f"cast(floor(cast(sum(cast({col} AS decimal(28,6))) AS double) * 100.0 + {_CENT_OFFSET}) AS bigint)"


def _cents(name: str, alias: str):
    return F.floor(c(name) * 100.0 + _CENT_OFFSET).alias(alias)


@query("scenario_sheet_totals", f"WITH {_LINE_SQL.strip()} SELECT name AS scenario, sheet, cast(any_value(sheet_pos) AS bigint) AS sheet_pos, {_sum2('sub_sem')} AS sem_cents, {_sum2('sub_com')} AS com_cents FROM li GROUP BY 1, 2")
def scenario_sheet_totals(spark, folder):
    _, lines = _scenario_frames(spark, folder)
    return SC.sheet_totals(lines).select("scenario", "sheet", *big("sheet_pos"), _cents("total_sem_bdi", "sem_cents"), _cents("total_com_bdi", "com_cents"))


@query("scenario_comparison", f"""WITH {_LINE_SQL.strip()} SELECT name AS cenario, 'V1' AS versao_preco, round(any_value(dc), 4) AS dc_kwp, any_value(modules)::bigint AS qtd_modulos, any_value(inv)::bigint AS qtd_inversores,
  round(any_value(total_com), 3) AS modulos_inversores_com_bdi, {_sum2('sub_com')} AS com_cents FROM li GROUP BY 1""")
def scenario_comparison(spark, folder):
    out = SC.comparison(*_scenario_frames(spark, folder))
    return out.select("cenario", "versao_preco", F.round("dc_kwp", 4).alias("dc_kwp"), *big("qtd_modulos", "qtd_inversores"),
                      F.round("modulos_inversores_com_bdi", 3).alias("modulos_inversores_com_bdi"), _cents("total_com_bdi_mapeado", "com_cents"))


@query("scenario_snapshot", f"""WITH {_LINE_SQL.strip()},
sheets AS (SELECT name, count(DISTINCT sheet) AS n FROM li GROUP BY 1)
SELECT name AS scenario, n + 1 + row_number() OVER (PARTITION BY name ORDER BY sheet_pos, pk) AS line_no, sheet, item_code, enabled, srule AS scaling_rule,
  round(coalesce(qty, 0), 4) AS quantity, round(sem, 4) AS unit_price_sem FROM li JOIN sheets USING (name)""")
def scenario_snapshot(spark, folder):
    """Every line item of every scenario's written document, with its line in the document."""
    path = f"{checkpoint_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    WR.snapshots(WR.snapshot_lines(*_scenario_frames(spark, folder), {"project": "plant", "version": "V1"}), path)
    items = RD.snapshot_items(RD.snapshot_documents(spark, path))
    return items.select("scenario", "line_no", "sheet", "item_code", "enabled", "scaling_rule", F.round("quantity", 4).alias("quantity"),
                        F.round("unit_price_sem", 4).alias("unit_price_sem"))


@query("audit_log", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS timestamp, 'batch' AS user, 'project ' || o_custkey AS project, 'V1, "' || o_orderstatus || '"' AS version, o_orderpriority AS scenario_name,
       'out/' || o_orderkey || '.xlsx' AS excel_file, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'out/' || o_orderkey || '.json' END AS snapshot_file FROM orders""")
def audit_log(spark, folder):
    """The log after three runs: a first part, all of it, and all of it again."""
    k = c("o_orderkey")
    rows = B.table(spark, folder, "orders").select(
        k, F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.concat(F.lit("project "), c("o_custkey").cast("string")).alias("project"),
        F.concat(F.lit('V1, "'), "o_orderstatus", F.lit('"')).alias("version"), c("o_orderpriority").alias("scenario_name"),
        F.concat(F.lit("out/"), k.cast("string"), F.lit(".xlsx")).alias("excel_file"),
        F.when(k % 5 != 0, F.concat(F.lit("out/"), k.cast("string"), F.lit(".json"))).alias("snapshot_file"))
    path = f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}"
    for part in (rows.filter(k % 3 == 0), rows, rows.union(rows.filter(k % 2 == 0))):
        WR.append_audit_log(part, path, "batch")
    return WR.audit_log(spark, path)


_DIRTY = """lines AS (SELECT o_orderkey AS k, lpad(o_custkey::varchar, 10, '0') AS uc, strftime(o_orderdate, '%m/%Y') AS referencia, o_totalprice AS kwh FROM orders)"""


@query("contract_rejects", f"""WITH {_DIRTY}
SELECT uc, referencia, kwh, NULL AS unreadable FROM lines WHERE k % 7 > 2
UNION ALL SELECT uc, referencia, NULL, 'kwh_total_te' FROM lines WHERE k % 7 = 0
UNION ALL SELECT uc, referencia, NULL, 'page_first_seen, kwh_total_te' FROM lines WHERE k % 7 = 1
UNION ALL SELECT uc, referencia, NULL, '' FROM lines WHERE k % 7 = 2""")
def contract_rejects(spark, folder):
    """A contract of text lines, of which some have a value that is no number, two of them, or a field too many."""
    k, kwh = c("o_orderkey"), c("o_totalprice").cast("string")
    lines = B.table(spark, folder, "orders").select(
        k, F.lpad(c("o_custkey").cast("string"), 10, "0").alias("uc"), F.date_format("o_orderdate", "MM/yyyy").alias("referencia"),
        F.when(k % 7 == 1, "first").otherwise("1").alias("page_first_seen"), F.when(k % 7 == 0, "n/d").when(k % 7 == 1, "-").otherwise(kwh).alias("kwh_total_te"))
    path = f"{checkpoint_folder(spark)}/contract-{uuid.uuid4().hex}.csv"
    lines.filter(k % 7 != 2).drop("o_orderkey").write.option("header", True).csv(path)
    lines.filter(k % 7 == 2).drop("o_orderkey").withColumn("extra", F.lit("extra")).write.mode("append").option("header", True).csv(path)
    rows, rejects = RD.contract_rows(spark, path, "uc string, referencia string, page_first_seen int, kwh_total_te double")
    field = lambda n: F.split("record", ",")[n]
    return rows.select("uc", "referencia", c("kwh_total_te").alias("kwh"), F.lit(None).cast("string").alias("unreadable")).unionByName(
        rejects.select(field(0).alias("uc"), field(1).alias("referencia"), F.lit(None).cast("double").alias("kwh"), F.array_join("unreadable", ", ").alias("unreadable")))


@query("drifting_map", """
SELECT 'SHEET ' || (p_partkey % 4) AS sheet_name, p_partkey AS row_pos, 'I' || p_partkey AS item_code,
  CASE WHEN p_partkey % 5 = 3 THEN 0.0 ELSE p_size END::double AS base_quantity, CASE WHEN p_partkey % 5 = 3 THEN 'base_quantity' ELSE '' END AS unreadable FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT 'SHEET ' || (p_partkey % 4), p_partkey, NULL, NULL, 'row' FROM part WHERE p_partkey % 5 = 4""")
def drifting_map(spark, folder):
    """A line-item map whose quantities are numbers, texts, missing or nested, and whose rows are not always objects."""
    k, size = c("p_partkey"), c("p_size").cast("string")
    quantity = F.when(k % 5 == 0, size).when(k % 5 == 1, F.concat(F.lit('"'), size, F.lit(',0"'))).when(k % 5 == 2, F.concat(size, F.lit(".0"))).otherwise('{"min": 1}')
    row = F.when(k % 5 == 4, '"comment"').otherwise(F.concat(F.lit('{"item_code": "I'), k.cast("string"), F.lit('", "base_quantity": '), quantity, F.lit("}")))
    text = F.concat(F.lit('{"sheets": [{"sheet_name": "SHEET '), (k % 4).cast("string"), F.lit('", "rows": ['), row, F.lit("]}]}"))
    maps = B.table(spark, folder, "part").select(k.alias("map"), text.alias("text"))
    found = SC.drifting_items(maps, "text")
    return found.select("sheet_name", c("map").alias("row_pos"), "item_code", "base_quantity", F.array_join("unreadable", ", ").alias("unreadable"))


@query("contract_files", with_base(MASTER, """
SELECT DISTINCT uc, referencia, categoria, municipio, cast(kwh_total_te AS varchar) AS kwh_total_te FROM master WHERE categoria <> 'OUTROS'"""))
def contract_files(spark, folder):
    """A contract written as CSV and as TSV and read from both, one scan per format, equal rows once."""
    rows = B.master(spark, folder).select("uc", "referencia", "categoria", "municipio", "kwh_total_te")
    path = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
    WR.csv_and_tsv(materialize(rows), f"{path}/m.csv", f"{path}/m.tsv")
    return RD.merged_contracts(spark, [f"{path}/m.csv", f"{path}/m.tsv"])


@query("page_files", with_base(MASTER, f"SELECT {_PAGE}, count(*) AS blocks FROM master GROUP BY ALL"))
def page_files(spark, folder):
    """A written table of page texts, read through the page reader and cut into blocks."""
    path = f"{checkpoint_folder(spark)}/pages-{uuid.uuid4().hex}.parquet"
    B.labelled_pages(spark, folder).write.parquet(path)
    blocks = EX.uc_blocks(RD.page_texts(spark, path))
    return blocks.groupBy("pdf_source", "page_no").agg(F.count(F.lit(1)).alias("blocks"))


@query("scenario_defaults", """
SELECT name, 'ECONOMY' AS pricing_version, (SELECT arg_min(p_name, p_partkey) FROM part) AS module_model, (SELECT arg_min(s_name, s_suppkey) FROM supplier) AS inverter_model, CASE WHEN name = 'Scenario B' THEN 1.3 ELSE 1.2 END::double AS dc_ac_ratio, 28::bigint AS modules_per_string
FROM (VALUES ('Scenario A'), ('Scenario B'), ('Scenario C')) v(name)""")
def scenario_defaults(spark, folder):
    given = spark.range(1).select(F.lit("Scenario B").alias("name"), F.lit(1.3).alias("dc_ac_ratio"))
    versions = B.table(spark, folder, "part").select(c("p_type").alias("version_id"), c("p_partkey").alias("pos"))
    out = SC.complete_scenarios(given, spark, B.modules(spark, folder), B.inverters(spark, folder), versions)
    return out.select("name", "pricing_version", "module_model", "inverter_model", "dc_ac_ratio", *big("modules_per_string"))


@query("scenario_bos_sync", """
SELECT r_name AS scenario, 'I' || n_nationkey AS item_code, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 ELSE true END AS enabled,
       CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 10.0 + 5 END::double AS unit_price_sem FROM region, nation""")
def scenario_bos_sync(spark, folder):
    names = B.table(spark, folder, "region").select(c("r_name").alias("name"))
    out = SC.complete_bos_overrides(B.overrides(spark, folder), names, B.bos(spark, folder))
    return out.select("scenario", "item_code", "enabled", "unit_price_sem")


@query("bos_editor", """
SELECT r_name AS scenario, 'I' || n_nationkey AS item_code, n_name AS item_name, n_nationkey % 2 = 0 AS enabled, n_nationkey * 10.0 + 5 AS unit_price_sem, CASE WHEN n_nationkey % 5 = 3 THEN 2.0 END::double AS base_qty_per_string
FROM region, nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT NULL, 'I' || n_nationkey, n_name, true, n_nationkey * 10.0 + 5, CASE WHEN n_nationkey % 5 = 3 THEN 2.0 END FROM nation WHERE n_nationkey % 3 <> 0""")
def bos_editor(spark, folder):
    return SC.bos_editor(B.bos(spark, folder), B.overrides(spark, folder)).select(
        "scenario", "item_code", "item_name", "enabled", "unit_price_sem", "base_qty_per_string")


@query("step_messages", """
SELECT n_nationkey AS k, 'A' AS step, 'warning' AS level, 'Cliente nao informado.' AS text FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'A', 'info', 'MWp AC nao definido. Aplique um dimensionamento.' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, 'D', 'warning', 'MWp nao definido — revisao parcial.' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, 'E', 'error', 'MWp AC nao definido. Aplique um dimensionamento antes de exportar.' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, 'B', 'error', 'Nenhum inversor selecionado.' FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey, 'C', 'error', 'BOS ''' || n_name || ''': preco negativo nao permitido.' FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey % 7 <> 0
UNION ALL SELECT n_nationkey, 'C', 'warning', 'BOS ''' || n_name || ''': regra de escalonamento invalida ''per_moon''.' FROM nation WHERE n_nationkey % 6 = 0 AND n_nationkey % 7 <> 0""")
def step_messages(spark, folder):
    k = c("n_nationkey")
    df = B.table(spark, folder, "nation").select(
        k.alias("k"), F.when(k % 2 != 0, "Cliente").otherwise("").alias("client"), c("n_name").alias("project_name"), c("n_name").alias("city"),
        F.when(k % 3 != 0, 1.5).alias("mwp_ac"), F.lit("m").alias("module_model"), F.when(k % 5 != 0, "i").alias("inverter_model"),
        c("n_name").alias("item_name"), (k % 7 != 0).alias("enabled"), F.when(k % 4 == 0, -1.0).otherwise(1.0).alias("unit_price_sem"), F.lit(1.0).alias("unit_price_com"),
        F.when(k % 6 == 0, "per_moon").otherwise("fixed").alias("scaling_rule"))
    parts = [SC.step_messages(df, s).select("k", F.lit(s).alias("step"), "level", "text") for s in "ABCDE"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("step_status", "SELECT n_nationkey AS k, n_nationkey % 2 <> 0 AND n_nationkey % 3 <> 0 AS \"A\", n_nationkey % 5 <> 0 AS \"B\", true AS \"C\", true AS \"D\", n_nationkey % 3 <> 0 AS \"E\" FROM nation")
def step_status(spark, folder):
    k = c("n_nationkey")
    df = B.table(spark, folder, "nation").select(
        k.alias("k"), F.when(k % 2 != 0, "x").alias("client"), c("n_name").alias("city"), F.when(k % 3 != 0, 1.5).alias("mwp_ac"),
        F.lit("m").alias("module_model"), F.when(k % 5 != 0, "i").alias("inverter_model"))
    return SC.step_status(df).select("k", "A", "B", "C", "D", "E")


# =================================================================== catalogs, places, runs
@query("catalog_typed", "SELECT p_name AS model, p_brand AS brand, (400.0 + 10.0 * p_size)::double AS wp, p_retailprice AS price_sem_bdi_per_kwp, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 49.5 END::double AS voc FROM part")
def catalog_typed(spark, folder):
    raw = B.modules(spark, folder).select(
        F.concat(F.lit(" "), "model").alias("model"), "brand", F.translate(F.format_number("wp", 1), ",.", ".,").alias("wp"),
        F.concat(F.lit("R$ "), F.format_number("price_sem_bdi_per_kwp", 2)).alias("price_sem_bdi_per_kwp"),
        F.when(c("pos") % 3 == 0, "-").otherwise("49,5").alias("voc"), "pos")
    return CT.modules(raw).select("model", "brand", "wp", "price_sem_bdi_per_kwp", "voc")


def _catalog_sides(spark, folder):
    """Catalog with one row per key, and an incoming batch of which two thirds are known."""
    m = B.modules(spark, folder).select(
        F.concat("model", F.lit(" "), c("pos").cast("string")).alias("model"), "brand", "wp", "supplier", "pricing_version", "pos")
    existing = m.filter(c("pos") % 3 != 2)
    incoming = m.filter(c("pos") % 3 != 0).select(
        F.upper(F.concat(F.lit(" "), "model")).alias("model"), F.lit("NEW").alias("brand"), "wp", "supplier", "pricing_version", "pos")
    return existing.drop("pos"), incoming.drop("pos")


@query("catalog_upsert", """
SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_partkey ELSE upper(' ' || p_name || ' ' || p_partkey) END AS model, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'NEW' END AS brand, (400.0 + 10.0 * p_size)::double AS wp FROM part""")
def catalog_upsert(spark, folder):
    return CT.upsert(*_catalog_sides(spark, folder)).select("model", "brand", "wp")


@query("catalog_upsert_actions", "SELECT CASE WHEN p_partkey % 3 = 1 THEN 'updated' ELSE 'added' END AS action, count(*) AS rows FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1")
def catalog_upsert_actions(spark, folder):
    return CT.upsert_actions(*_catalog_sides(spark, folder)).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


@query("catalog_filter", "SELECT p_partkey AS pos, p_brand AS brand FROM part WHERE p_brand = 'Brand#2' AND (p_type = 'ECONOMY' OR p_partkey % 2 = 0)")
def catalog_filter(spark, folder):
    df = B.modules(spark, folder).withColumn("pricing_version", F.when(c("pos") % 2 == 0, "").otherwise(c("pricing_version")))
    return CT.filter_rows(df, brand="Brand#2", pricing_version="ECONOMY").select("pos", "brand")


@query("catalog_options", "SELECT 'All' AS option UNION ALL SELECT DISTINCT p_brand FROM part WHERE p_brand <> ''")
def catalog_options(spark, folder):
    return CT.value_options(B.modules(spark, folder), "brand")


@query("catalog_model_lookup", """
SELECT r_name AS name, coalesce((SELECT arg_min(p_brand, p_partkey) FROM part WHERE r_regionkey <> 0 AND p_name = 'red widget'), (SELECT arg_min(p_brand, p_partkey) FROM part)) AS brand FROM region""")
def catalog_model_lookup(spark, folder):
    return SC.by_model(B.scenarios(spark, folder), B.modules(spark, folder), "module_model", "module").select("name", c("module_brand").alias("brand"))


@query("catalog_versions", "SELECT r_name AS name, n_name AS version_description FROM region LEFT JOIN nation ON n_nationkey = r_regionkey * 6")
def catalog_versions(spark, folder):
    scen = B.table(spark, folder, "region").select(c("r_name").alias("name"), F.concat(F.lit("V"), (c("r_regionkey") * 6).cast("string")).alias("pricing_version"))
    versions = B.table(spark, folder, "nation").select(
        F.concat(F.lit("V"), c("n_nationkey").cast("string")).alias("version_id"), F.lit("").alias("date"), c("n_name").alias("description"),
        F.lit("").alias("source"), c("n_nationkey").alias("pos"))
    return SC.with_version(scen, versions).select("name", "version_description")


def _places(spark, folder):
    """Customers as cities in the nested form; every second one has its state on the second path."""
    k = c("c_custkey")
    uf = F.struct(F.concat(F.lit("s"), c("c_nationkey").cast("string")).alias("sigla"), F.concat(F.lit("State "), c("c_nationkey").cast("string")).alias("nome"))
    none = F.lit(None).cast("struct<sigla:string,nome:string>")
    raw = B.table(spark, folder, "customer").select(
        k.cast("string").alias("id"), F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("Cidade Á "), "c_mktsegment")).alias("nome"),
        F.struct(F.struct(F.when(k % 2 == 0, uf).otherwise(none).alias("UF")).alias("mesorregiao")).alias("microrregiao"),
        F.struct(F.struct(F.when(k % 4 != 3, uf).otherwise(none).alias("UF")).alias("regiao-intermediaria")).alias("regiao-imediata"))
    return CT.municipalities(raw)


_PLACES = """places AS (SELECT cast(c_custkey AS varchar) AS ibge_code, 'Cidade Á ' || c_mktsegment AS city, 'S' || c_nationkey AS state_uf, 'State ' || c_nationkey AS state_name, 'cidade a ' || lower(c_mktsegment) AS city_search
FROM customer WHERE c_custkey % 9 <> 0 AND (c_custkey % 2 = 0 OR c_custkey % 4 <> 3))"""


@query("place_catalog", f"WITH {_PLACES} SELECT * FROM places")
def place_catalog(spark, folder):
    return _places(spark, folder)


@query("place_states", f"WITH {_PLACES} SELECT state_uf AS uf, min(state_name) AS name FROM places GROUP BY 1")
def place_states(spark, folder):
    return CT.states(_places(spark, folder))


@query("place_search", f"WITH {_PLACES} SELECT city_search, count(*) AS n FROM places WHERE state_uf = 'S7' AND city_search LIKE '%a machine%' GROUP BY 1")
def place_search(spark, folder):
    cities = CT.cities_of(_places(spark, folder), " s7")
    return CT.search_cities(cities, " Á MACHINE").groupBy("city_search").agg(F.count(F.lit(1)).alias("n"))


@query("output_names", """
SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') || '_v1_' || lower(o_orderstatus) || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stem,
       strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') || '_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') || '_na' AS run_id FROM orders""")
def output_names(spark, folder):
    return B.table(spark, folder, "orders").select(
        "o_orderkey", WR.output_stem(c("o_orderpriority"), F.lit("V1"), c("o_orderstatus"), c("o_orderdate")).alias("stem"),
        WR.run_id(c("o_orderpriority"), F.lit("?"), c("o_orderdate")).alias("run_id"))


@query("run_history", """
SELECT 'r_' || o_orderkey || '_x_y_celesc' AS run_id, 'x_y' AS municipio, CASE WHEN o_orderkey % 3 = 0 THEN 'enel' ELSE 'celesc' END AS adapter,
       CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'schema_warning' ELSE 'ok' END WHEN o_orderkey % 5 = 0 THEN 'meta_missing' ELSE 'missing_contract' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'r/' || o_orderkey || '/contract_master.csv' ELSE '' END AS contract_path,
       CASE WHEN o_orderkey % 3 = 0 THEN 'r/' || o_orderkey || '/contract_master_meta' ELSE '' END AS meta_path, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS row_count
FROM orders""")
def run_history(spark, folder):
    k = c("o_orderkey")
    run = F.concat(F.lit("r_"), k.cast("string"), F.lit("_x_y_celesc"))
    inside = lambda name: F.concat(F.lit("r/"), k.cast("string"), F.lit(f"/{name}"))
    orders = B.table(spark, folder, "orders")
    runs = orders.select(run.alias("run_id"), c("o_orderdate").alias("modified"), F.when(k % 5 == 0, inside("contract_master.csv")).alias("contract_path"))
    meta = orders.filter(k % 3 == 0).select(
        run.alias("run_id"), inside("contract_master_meta").alias("meta_path"), F.lit(None).cast("string").alias("generated_at"), F.lit("enel").alias("adapter"),
        c("o_custkey").cast("bigint").alias("row_count"), F.when(k % 2 == 0, F.array(F.lit("uc"))).otherwise(F.array().cast("array<string>")).alias("missing_columns"))
    return RD.run_history(runs, meta).select("run_id", "municipio", "adapter", "status", "contract_path", "meta_path", "row_count")


@query("output_discovery", """
SELECT 'out/MUNICIPIOS/' || o_orderstatus || '/dimensionamento/' || o_orderkey || '_dimensionamento.csv' AS path, o_orderstatus AS municipio, 'dimensionamento' AS kind, '.csv' AS ext
FROM orders""")
def output_discovery(spark, folder):
    name = F.concat(c("o_orderkey").cast("string"), F.lit("_dimensionamento.csv"))
    files = B.table(spark, folder, "orders").select(
        F.concat(F.lit("out/MUNICIPIOS/"), "o_orderstatus", F.lit("/dimensionamento/"), name).alias("path"), c("o_orderdate").alias("modified"), name.alias("name"))
    return RD.sizing_sources(files).select("path", "municipio", "kind", "ext")


# =================================================================== text extraction
def printed(pages: DataFrame) -> DataFrame:
    """Pages as a user has them: a written table. Printing them from the orders is not what these queries are about."""
    return materialize(pages, fine=True)


_MONEY_SQL = "round(kwh_total_te * 0.5, 2)"


@query("layout_of_documents", """
SELECT 'doc_' || d || '.pdf' AS pdf_source, CASE d % 4 WHEN 1 THEN 'CPFL' WHEN 2 THEN 'ENERGISA' ELSE 'CELESC_COLETIVA' END AS provider_layout
FROM (SELECT DISTINCT o_custkey % 20 AS d FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def layout_of_documents(spark, folder):
    return LA.document_layouts(B.labelled_pages(spark, folder))


@query("layout_of_texts", """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'CPFL' WHEN 1 THEN 'CEMIG' WHEN 2 THEN 'COPEL' WHEN 3 THEN 'EQUATORIAL' WHEN 4 THEN 'ENERGISA' WHEN 5 THEN 'LIGHT' WHEN 6 THEN 'COELBA' ELSE 'GENERIC' END AS layout FROM part""")
def layout_of_texts(spark, folder):
    texts = ["CPFL Paulista\nItens da Fatura", "CEMIG distribuição S.A\nConta de Energia", "COPEL\nDescrição do Faturamento", "Equatorial Energia\nFatura",
             "Energisa\nFatura", "Light Serviços de Eletricidade S.A.", "Neoenergia Cosern\nx", "sem marcadores"]
    text = F.concat(F.element_at(F.array(*[F.lit(t) for t in texts]), (c("p_partkey") % 8 + 1).cast("int")), F.lit("\n"), c("p_partkey").cast("string"))
    return B.table(spark, folder, "part").select("p_partkey", LA.layout_of_text(text).alias("layout"))


@query("layout_marker_scores", """
SELECT l.layout, sum(l.n)::bigint AS markers FROM documents, LATERAL (SELECT v.layout, (CASE WHEN contains(a, v.m1) THEN 1 ELSE 0 END + CASE WHEN contains(a, v.m2) THEN 1 ELSE 0 END + CASE WHEN contains(a, v.m3) THEN 1 ELSE 0 END) AS n FROM (
  SELECT upper(trim(regexp_replace(regexp_replace(strip_accents(documents.text), '[^\\x00-\\x7F]+', '', 'g'), '\\s+', ' ', 'g'))) AS a),
  (VALUES ('CELESC_COLETIVA', 'RELACAO DE UCS DA COLETIVA', 'ITENS DA FATURA', 'UC:'), ('ENEL_A4', 'DOCUMENTO AUXILIAR DA NOTA FISCAL', 'ITENS DE FATURA', 'MES/ANO'), ('NEOENERGIA_ELEKTRO', 'CCI', 'DESCRICAO DO PRODUTO', 'GBELEKTRO'),
   ('CPFL', 'CPFL', 'DISTRIBUIDORA', 'ITENS DA FATURA'), ('CEMIG', 'CEMIG', 'DISTRIBUICAO S.A', 'CONTA DE ENERGIA'), ('COPEL', 'COPEL', 'COMPANHIA PARANAENSE', 'DESCRICAO DO FATURAMENTO'),
   ('EQUATORIAL', 'EQUATORIAL', 'EQUATORIAL ENERGIA', 'FATURA'), ('ENERGISA', 'ENERGISA', 'CONTA DE ENERGIA', 'FATURA'), ('LIGHT', 'LIGHT', 'SERVICOS DE ELETRICIDADE', 'FATURA'), ('COELBA', 'COELBA', 'NEOENERGIA COELBA', 'FATURA')) v(layout, m1, m2, m3)) l GROUP BY 1""")
def layout_marker_scores(spark, folder):
    scores = LA.marker_scores(B.table(spark, folder, "documents"), c("text"), ["doc_id"])
    return scores.groupBy("layout").agg(F.sum("markers").cast("bigint").alias("markers"))


@query("extract_blocks", with_base(MASTER, f"SELECT {_PAGE}, uc, count(*) AS blocks FROM master GROUP BY ALL"))
def extract_blocks(spark, folder):
    blocks = EX.uc_blocks(B.labelled_pages(spark, folder))
    return blocks.withColumn("uc", X.pick(c("block"), r"UC:\s*([0-9]+)")).groupBy("pdf_source", "page_no", "uc").agg(F.count(F.lit(1)).alias("blocks"))


_EXTRACTED = f"""
SELECT {_PAGE.replace(' AS page_no', ' AS page_first_seen')}, uc, referencia, CASE WHEN categoria = 'A4' THEN 'A' ELSE 'B' END AS grupo_tensao, CASE categoria WHEN 'A4' THEN 'A4' WHEN 'IP' THEN 'B4A' WHEN 'B3' THEN 'B3' ELSE 'B2' END AS subgrupo,
       categoria, tipo_fornecimento, nome, endereco, CASE WHEN categoria <> 'OUTROS' THEN CASE WHEN categoria = 'A4' THEN consumo_hp_kwh + consumo_fhp_kwh ELSE kwh_total_te END END AS kwh_total_te,
       CASE WHEN categoria = 'A4' THEN coalesce(demanda_hp_kw, 0) END AS demanda_hp_kw, CASE WHEN categoria = 'A4' THEN consumo_fhp_kwh END AS consumo_fhp_kwh,
       coalesce(total_fatura_rs, 0) AS total_fatura_rs, CASE WHEN categoria IN ('B3', 'IP') THEN nullif({_MONEY_SQL}, 0) END AS itens_valor,
       CASE WHEN categoria NOT IN ('B3', 'IP') THEN '' WHEN kwh_total_te = 0 THEN 'ITENS_CONSUMO_TE/ITEM_QUANTITY_FALLBACK' WHEN categoria = 'IP' THEN 'ITENS_CONSUMO_TE/ITEM_CONSUMO_IP_TE_QTD' ELSE 'ITENS_CONSUMO_TE/ITEM_CONSUMO_TE_QTD' END AS audit_kwh_source,
       CASE custkey % 20 % 4 WHEN 1 THEN 'CPFL' WHEN 2 THEN 'ENERGISA' ELSE 'CELESC_COLETIVA' END AS provider_layout FROM master"""


@query("extract_records", with_base(MASTER, _EXTRACTED))
def extract_records(spark, folder):
    out = EX.extract_pages(printed(B.labelled_pages(spark, folder)))
    return out.select(
        "pdf_source", "page_first_seen", "uc", "referencia", "grupo_tensao", "subgrupo", "categoria", "tipo_fornecimento", "nome", "endereco", "kwh_total_te",
        "demanda_hp_kw", "consumo_fhp_kwh", "total_fatura_rs", F.when(c("categoria").isin("B3", "IP"), c("itens_fatura_total_valor_rs")).alias("itens_valor"),
        "audit_kwh_source", "provider_layout")


_DETAILED = """printed AS (SELECT *, CASE WHEN categoria = 'A4' THEN coalesce(demanda_hp_kw, 0) END AS d_hp, CASE WHEN categoria = 'A4' THEN coalesce(demanda_fhp_kw, 0) END AS d_fhp,
  greatest(dif_demanda, 0) AS d_over, (custkey % 90 + 10)::double AS kw FROM master),
printed_rows AS (SELECT p.*, v.* FROM printed p, LATERAL (VALUES
  (categoria = 'A4', 'DEMANDA', NULL, NULL, d_hp, 1.0), (categoria = 'A4', 'DEMANDA FORA PONTA', NULL, NULL, d_fhp, 2.0), (categoria = 'A4', 'DEMANDA DE ULTRAPASSAGEM', NULL, NULL, d_over, 3.0),
  (categoria = 'A4', 'CONSUMO PONTA TE', NULL, NULL, consumo_hp_kwh, 0.5), (categoria = 'A4', 'CONSUMO FORA PONTA TE', NULL, NULL, consumo_fhp_kwh, 0.25),
  (categoria IN ('A4', 'OUTROS'), 'ENERGIA ATIVA FORNECIDA FHP TE', 'FHP', 'TE', consumo_fhp_kwh, 0.5), (categoria IN ('A4', 'OUTROS'), 'ENERGIA ATIVA FORNECIDA FHP TUSD', 'FHP', 'TUSD', consumo_fhp_kwh, 0.25),
  (categoria IN ('A4', 'OUTROS'), 'ENERGIA ATIVA FORNECIDA HP TE', 'HP', 'TE', consumo_hp_kwh, 0.5), (categoria IN ('A4', 'OUTROS'), 'ENERGIA ATIVA FORNECIDA HP TUSD', 'HP', 'TUSD', consumo_hp_kwh, 0.25),
  (categoria <> 'A4', 'ENERGIA ATIVA FORNECIDA TE', 'UNICO', 'TE', kwh_total_te, 0.5), (categoria <> 'A4', 'ENERGIA ATIVA FORNECIDA TUSD', 'UNICO', 'TUSD', kwh_total_te, 0.25)
  ) AS v(shown, item, posto, componente, quantidade, preco) WHERE v.shown)"""


def _detailed(spark, folder):
    return EX.extract_pages(printed(B.detailed_pages(spark, folder)))


@query("extract_period_rows", with_base(MASTER, f""", {_DETAILED}
SELECT uc, referencia, item, posto, componente, quantidade::double AS quantidade, preco::double AS preco, round(quantidade * preco, 2)::double AS valor FROM printed_rows"""))
def extract_period_rows(spark, folder):
    """Every item that the detailed pages print, as the parser returns it."""
    items = _detailed(spark, folder).select("uc", "referencia", F.inline(IT.parse_items(c("itens_fatura_json"))))
    return items.select("uc", "referencia", "item", "posto", "componente", "quantidade", c("preco_unitario_com_tributos").alias("preco"), "valor")


@query("extract_a4_items", with_base(MASTER, f""", {_DETAILED}
SELECT uc, referencia, categoria, d_hp AS demanda_hp_kw, d_fhp AS demanda_fhp_kw, CASE WHEN categoria = 'A4' THEN d_over END AS dif_demanda, CASE WHEN categoria = 'A4' THEN consumo_hp_kwh END AS consumo_hp_kwh,
  CASE WHEN categoria = 'A4' THEN consumo_fhp_kwh END AS consumo_fhp_kwh, CASE categoria WHEN 'A4' THEN consumo_hp_kwh + consumo_fhp_kwh WHEN 'OUTROS' THEN NULL ELSE nullif(kwh_total_te, 0) END AS kwh_total_te FROM printed"""))
def extract_a4_items(spark, folder):
    return _detailed(spark, folder).select(
        "uc", "referencia", "categoria", "demanda_hp_kw", "demanda_fhp_kw", "dif_demanda", "consumo_hp_kwh", "consumo_fhp_kwh", "kwh_total_te")


@query("extract_contracted_demand", with_base(MASTER, f""", {_DETAILED}
SELECT {_PAGE.replace(' AS page_no', ' AS page_first_seen')}, uc, referencia, CASE WHEN categoria = 'A4' THEN CASE WHEN custkey % 5 < 4 THEN kw ELSE d_hp END END AS demanda_contratada_kw FROM printed"""))
def extract_contracted_demand(spark, folder):
    return _detailed(spark, folder).select("pdf_source", "page_first_seen", "uc", "referencia", "demanda_contratada_kw")


_DOC = "'doc_' || (custkey % 20)"


def _built(spark, folder):
    pages = printed(B.labelled_pages(spark, folder))
    town = F.concat(F.lit("TOWN "), F.regexp_extract("pdf_source", r"(\d+)", 1))
    stamps = pages.select("pdf_source").distinct().filter(~c("pdf_source").endswith("5.pdf")).select("pdf_source", town.alias("municipio"))
    return MA.build_master(pages, stamps)


@query("build_master", with_base(MASTER, f"""
SELECT uc, referencia, categoria, {_DOC} || '.pdf' AS uploaded_file, {_DOC} || ': ' || (custkey // 20 + 1) AS audit_pdf_pages,
       CASE WHEN custkey % 10 <> 5 THEN 'TOWN ' || (custkey % 20) END AS municipio, reference_date::date AS reference_date FROM master"""))
def build_master(spark, folder):
    return _built(spark, folder).select("uc", "referencia", "categoria", "uploaded_file", "audit_pdf_pages", "municipio", "reference_date")


@query("master_counts", with_base(MASTER, f"""
SELECT {_DOC} || '.pdf' AS pdf_source, count(*) AS rows, 0::bigint AS missing_ref, 0::bigint AS blank_kwh FROM master GROUP BY 1"""))
def master_counts(spark, folder):
    return MA.master_counts(_built(spark, folder))


@query("discovery_summary", with_base(MASTER, f"""
SELECT {_DOC} || '.pdf' AS pdf_source, 'categoria' AS kind, categoria AS value, count(*) AS rows FROM master GROUP BY ALL
UNION ALL SELECT {_DOC} || '.pdf', 'kwh_source', audit_kwh_source, count(*) FROM (SELECT custkey, CASE WHEN categoria NOT IN ('B3', 'IP') THEN '' WHEN kwh_total_te = 0 THEN 'ITENS_CONSUMO_TE/ITEM_QUANTITY_FALLBACK'
  WHEN categoria = 'IP' THEN 'ITENS_CONSUMO_TE/ITEM_CONSUMO_IP_TE_QTD' ELSE 'ITENS_CONSUMO_TE/ITEM_CONSUMO_TE_QTD' END AS audit_kwh_source FROM master) GROUP BY ALL"""))
def discovery_summary(spark, folder):
    return MA.discovery_summary(EX.extract_pages(printed(B.labelled_pages(spark, folder))))


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY ix DESC) AS rn FROM master) WHERE rn = 1)"""


_FILLED_MONTHS = """filled AS (SELECT l.*, i, printf('%02d/%04d', (l.ix - i - 1) % 12 + 1, (l.ix - i - 1) // 12) AS month,
  m.kwh_total_te AS kwh, m.demanda_hp_kw AS d_hp, m.demanda_fhp_kw AS d_fhp, m.consumo_hp_kwh AS c_hp, m.consumo_fhp_kwh AS c_fhp
  FROM latest l CROSS JOIN range(13) t(i) LEFT JOIN master m ON m.custkey = l.custkey AND m.ix = l.ix - i)"""
_BILLED_ONCE = "CASE WHEN i = 0 THEN coalesce(total_fatura_rs, 0) END AS total_fatura_rs"


@query("extract_history", with_base(MASTER, f""", {_LATEST}, {_FILLED_MONTHS}
SELECT uc, month AS referencia, categoria, coalesce(kwh, 0) AS kwh_total_te, {_BILLED_ONCE} FROM filled WHERE categoria IN ('B3', 'IP')
UNION ALL SELECT uc, month, categoria, CASE WHEN i = 0 THEN consumo_hp_kwh + consumo_fhp_kwh ELSE 0 END, {_BILLED_ONCE} FROM filled WHERE categoria = 'A4'
UNION ALL SELECT uc, referencia, categoria, NULL, coalesce(total_fatura_rs, 0) FROM latest WHERE categoria = 'OUTROS'"""))
def extract_history(spark, folder):
    out = EX.extract_pages(printed(B.history_pages(spark, folder)), expand=True)
    return out.select("uc", "referencia", "categoria", "kwh_total_te", "total_fatura_rs")


@query("extract_repeated_months", with_base(MASTER, f""", shown AS (SELECT * FROM master WHERE month(reference_date) % 3 <> 0),
top AS (SELECT custkey, max(ix) AS last FROM shown GROUP BY 1), {_LATEST}
SELECT l.uc, printf('%02d/%04d', (last - i - 1) % 12 + 1, (last - i - 1) // 12) AS referencia, l.categoria, coalesce(m.kwh_total_te, 0) AS kwh_total_te, NULL::double AS demanda_hp_kw
FROM latest l JOIN top USING (custkey) CROSS JOIN range(13) t(i) LEFT JOIN shown m ON m.custkey = l.custkey AND m.ix = last - i WHERE l.categoria IN ('B3', 'IP')
UNION ALL SELECT l.uc, l.referencia, l.categoria, l.kwh_total_te, NULL FROM latest l WHERE l.categoria IN ('B3', 'IP') AND l.custkey NOT IN (SELECT custkey FROM top)
UNION ALL SELECT l.uc, m.referencia, 'A4', m.consumo_hp_kwh + m.consumo_fhp_kwh, coalesce(m.demanda_hp_kw, 0) FROM latest l JOIN shown m USING (custkey) WHERE l.categoria = 'A4'
UNION ALL SELECT uc, referencia, categoria, NULL, NULL FROM latest WHERE categoria = 'OUTROS'"""))
def extract_repeated_months(spark, folder):
    """Histories with repeated and missing months: the last row of a month counts on blocks, the first on medium-voltage pages."""
    out = EX.extract_pages(printed(B.repeated_pages(spark, folder)), expand=True)
    return out.select("uc", "referencia", "categoria", "kwh_total_te", "demanda_hp_kw")


@query("extract_series", with_base(MASTER, f""", {_LATEST}, {_FILLED_MONTHS}
SELECT uc, month AS referencia, coalesce(d_hp, 0) AS demanda_hp_kw, coalesce(d_fhp, 0) AS demanda_fhp_kw, coalesce(c_hp, 0) AS consumo_hp_kwh, coalesce(c_fhp, 0) AS consumo_fhp_kwh FROM filled WHERE categoria = 'A4'"""))
def extract_series(spark, folder):
    """Histories printed as four series of 13 numbers."""
    out = EX.extract_pages(printed(B.series_pages(spark, folder)), expand=True)
    return out.select("uc", "referencia", "demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh")


@query("extract_unlabelled_a4", with_base(MASTER, f""", {_LATEST}, {_FILLED_MONTHS}
SELECT l.uc, m.referencia, l.categoria, coalesce(m.demanda_hp_kw, 0) AS demanda_hp_kw, coalesce(m.demanda_fhp_kw, 0) AS demanda_fhp_kw, m.consumo_hp_kwh, m.consumo_fhp_kwh, m.consumo_hp_kwh + m.consumo_fhp_kwh AS kwh_total_te,
       CASE WHEN m.ix = l.ix THEN coalesce(l.total_fatura_rs, 0) END AS total_fatura_rs, l.nome, l.endereco, 'Poder publico Municipal' AS origem, l.tipo_fornecimento, 'ENEL_A4' AS provider_layout
FROM latest l JOIN master m USING (custkey) WHERE l.categoria = 'A4'
UNION ALL SELECT uc, month, categoria, NULL, NULL, NULL, NULL, coalesce(kwh, 0), {_BILLED_ONCE}, 'MUNICIPIO DE ' || nome, endereco, CASE WHEN categoria = 'IP' THEN 'Iluminacao Publica' ELSE '' END, tipo_fornecimento, 'ENEL_A4' FROM filled WHERE categoria IN ('B3', 'IP')"""))
def extract_unlabelled_a4(spark, folder):
    out = EX.extract_pages(printed(B.fiscal_pages(spark, folder)), expand=True)
    return out.select("uc", "referencia", "categoria", "demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh", "kwh_total_te", "total_fatura_rs",
                      "nome", "endereco", "origem", "tipo_fornecimento", "provider_layout")


@query("extract_unlabelled_b", with_base(MASTER, f""", {_LATEST}
SELECT uc, referencia, categoria, CASE categoria WHEN 'IP' THEN 'B4A' WHEN 'A4' THEN 'A4' ELSE 'B3' END AS subgrupo, CASE WHEN categoria = 'A4' THEN consumo_hp_kwh + consumo_fhp_kwh ELSE kwh_total_te END AS kwh_total_te, coalesce(total_fatura_rs, 0) AS total_fatura_rs,
       CASE WHEN categoria = 'A4' THEN nome ELSE 'MUNICIPIO DE ' || nome END AS nome, endereco, CASE WHEN categoria = 'A4' THEN '' ELSE 'HISTORICO_CONSUMO_KWH' END AS audit_kwh_source FROM latest WHERE categoria <> 'OUTROS'"""))
def extract_unlabelled_b(spark, folder):
    out = EX.extract_pages(printed(B.fiscal_pages(spark, folder)))
    return out.select("uc", "referencia", "categoria", "subgrupo", "kwh_total_te", "total_fatura_rs", "nome", "endereco", "audit_kwh_source")


@query("extract_grouped", with_base(MASTER, f""", {_LATEST}
SELECT uc, '01/2001' AS referencia, 'B3' AS categoria, kwh_total_te, coalesce(total_fatura_rs, 0) AS total_fatura_rs, 'MUNICIPIO DE ' || nome AS nome, endereco || ' Competencia ' || referencia AS endereco, 'TEXTO_CONSUMO_TE' AS audit_kwh_source, 'NEOENERGIA_ELEKTRO' AS provider_layout
FROM latest"""))
def extract_grouped(spark, folder):
    out = EX.extract_pages(printed(B.grouped_pages(spark, folder)))
    return out.select("uc", "referencia", "categoria", "kwh_total_te", "total_fatura_rs", "nome", "endereco", "audit_kwh_source", "provider_layout")


@query("extract_single_layout", with_base(MASTER, f"""
SELECT uc, referencia, CASE WHEN categoria = 'OUTROS' THEN 'OUTROS' WHEN categoria = 'IP' THEN 'IP' ELSE categoria END AS categoria, CASE WHEN categoria IN ('B3', 'IP') THEN kwh_total_te END AS kwh_total_te, nome, endereco, tipo_fornecimento FROM master"""))
def extract_single_layout(spark, folder):
    out = EX.single_layout_records(B.labelled_pages(spark, folder))
    return out.select("uc", "referencia", "categoria", "kwh_total_te", "nome", "endereco", "tipo_fornecimento")


@query("extract_two_tabs", with_base(MASTER, f"""
SELECT uc, CASE WHEN categoria = 'A4' THEN 'A4' ELSE 'B3' END AS tab, CASE WHEN categoria IN ('B3', 'OUTROS') THEN {ptbr('kwh_total_te')} ELSE '' END AS consumo_te, tipo_fornecimento FROM master"""))
def extract_two_tabs(spark, folder):
    a4, b3 = EX.two_tab_rows(printed(B.labelled_pages(spark, folder)))
    return a4.select("uc", F.lit("A4").alias("tab"), F.lit("").alias("consumo_te"), "tipo_fornecimento").unionByName(
        b3.select("uc", F.lit("B3").alias("tab"), "consumo_te", "tipo_fornecimento"))


@query("field_report", with_base(MASTER, f""", {_LATEST},
fields AS (SELECT *, categoria IN ('B3', 'IP') AND kwh_total_te > 0 AS has_kwh FROM latest)
SELECT {_PAGE}, 'uc' AS field, true AS found, 'UC' AS source_pattern, uc AS value FROM fields
UNION ALL SELECT {_PAGE}, 'reference', true, 'REFERENCIA', referencia FROM fields
UNION ALL SELECT {_PAGE}, 'categoria', true, 'CLASSIFICACAO_HEADER', categoria FROM fields
UNION ALL SELECT {_PAGE}, 'kwh', kwh_total_te > 0 AND categoria <> 'A4', CASE WHEN categoria = 'A4' OR kwh_total_te <= 0 THEN '' WHEN categoria = 'IP' THEN 'ITEM_CONSUMO_IP_TE_QTD' ELSE 'ITEM_CONSUMO_TE_QTD' END,
  CASE WHEN categoria <> 'A4' AND kwh_total_te > 0 THEN cast(kwh_total_te AS varchar) END FROM fields
UNION ALL SELECT {_PAGE}, 'demand', false, '', NULL FROM fields"""))
def field_report(spark, folder):
    return EX.field_report(B.history_pages(spark, folder))


@query("field_report_detailed", with_base(MASTER, f""", {_LATEST}
SELECT {_PAGE}, 'uc' AS field, true AS found, CASE custkey % 4 WHEN 0 THEN 'UC' WHEN 1 THEN 'INSTALACAO' WHEN 2 THEN 'UNIDADE_CONSUMIDORA' ELSE 'NUMERO_CLIENTE' END AS source_pattern, uc AS value FROM latest
UNION ALL SELECT {_PAGE}, 'demand', true, CASE custkey % 3 WHEN 0 THEN 'DEMANDA_CONTRATADA' WHEN 1 THEN 'DEMANDA_REGISTRADA' ELSE 'DEMANDA_MEDIDA' END, cast((custkey % 90 + 10)::double AS varchar) FROM latest"""))
def field_report_detailed(spark, folder):
    """Unit and demand as four and three labels print them."""
    return EX.field_report(B.demand_pages(spark, folder)).filter("field IN ('uc', 'demand')")


@query("discovery_lines", with_base(MASTER, f"""
SELECT DISTINCT 'doc_' || (custkey % 20) || '.pdf' AS pdf_source, 'candidate_consumption_line' AS kind,
  CASE categoria WHEN 'IP' THEN 'Consumo IP TE ' ELSE 'Consumo TE ' END || {ptbr('kwh_total_te')} || ' 0,500000 ' || {ptbr(_MONEY_SQL)} AS line FROM master WHERE categoria <> 'A4'"""))
def discovery_lines(spark, folder):
    return EX.discovery_lines(B.labelled_pages(spark, folder))


@query("discovery_months", with_base(MASTER, "SELECT DISTINCT 'doc_' || (custkey % 20) || '.pdf' AS pdf_source, referencia AS token FROM master"))
def discovery_months(spark, folder):
    return EX.discovery_months(B.labelled_pages(spark, folder))


@query("text_number_runs", r"""
SELECT doc_id, len(regexp_extract_all(text, '\b[0-9]{6,12}\b'))::bigint AS runs, coalesce(regexp_extract(text, '(?i)\bReferencia:\s*(\d{2}/\d{4})\b', 1), '') AS reference FROM documents""")
def text_number_runs(spark, folder):
    return B.table(spark, folder, "documents").select(
        "doc_id", F.size(X.pick_all(c("text"), r"\b[0-9]{6,12}\b")).cast("bigint").alias("runs"),
        F.coalesce(X.pick(c("text"), r"\bReferencia:\s*(\d{2}/\d{4})\b"), F.lit("")).alias("reference"))
