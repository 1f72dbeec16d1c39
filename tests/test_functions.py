"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from wattledger.functions import dates as D
from wattledger.functions import domain as K
from wattledger.functions import numbers as N
from wattledger.functions import text as X
from wattledger.functions.fixed_values import EXPORT_DEFAULT_NAME
from wattledger.functions.columns import (
    ContractSchemaError, check_contract, first_number, fits_template, header_name, reorder, resolve_exact_first,
    resolve_loose, with_output_contract,
)
from wattledger.operators.cascade import normalize_uc


def values(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("fn, cases", [
    (N.ptbr_number, {"1.234,56": 1234.56, "1.700": 1700.0, "1700": 1700.0, "742.835,781": 742835.781, "abc": None, "": None, "12d": None}),
    (N.flexible_number, {"1.700": 1700.0, "231.00": 231.0, "1.234,5": 1234.5, "1 200": 1200.0, "1.234.567": 1234567.0, "x": None}),
    (N.brl_number, {"R$ 8.500.000,00": 8.5e6, "1,234.56": 1234.56, "1.700": 1700.0, "1.75": 1.75, "1,5": 1.5, "1,234,567": 1234567.0, "": None}),
    (N.locale_number, {"1.700": 1.7, "1.234,56": 1234.56, "1,234.56": 1234.56, "R$ 10,5": 10.5, "n/a": None}),
    (N.contract_number, {"1,234.56": None, "1.234,56": 1234.56, "1.7": 1.7, "2,5": 2.5}),
    (D.month_reference, {"1/25": "01/2025", "Fev-2024": "02/2024", "202511": "11/2025", "JAN25": "01/2025", "13/2025": "", "SET/123": ""}),
    (D.compact_reference, {"202511": "11/2025", "2025-11": "11/2025", "20251": ""}),
    (D.reference_of_date, {"24/11/2025": "11/2025", "x 01/02/2024.": "02/2024", "2024": ""}),
    (normalize_uc, {"00123": "0000000123", "UC: 000123-4": "0000001234", "123456789012": "123456789012", "": ""}),
    (lambda c: normalize_uc(c, 6), {"UC: 000123-4": "0001234"}),
    (X.ascii_upper, {"Ação  nº\n½": "ACAO NO 12", "é": "E", "": ""}),
    (X.plain_lower, {" São  João ": "sao joao"}),
    (X.tidy_lines, {" a\r\n\n b\t\tc ": "a\n b c"}),
    (X.file_slug, {"Ilha Bela/Ção": "ilha_bela_cao", "": "arquivo"}),
    (X.project_slug, {"Usina Ção 1": "usina_o_1", "--": "project"}),
    (X.export_name, {"A b-c": "A_b-c", "": EXPORT_DEFAULT_NAME}),
    (X.municipality_of_file, {"x/palhoca_faturas_2.pdf": "palhoca", "sao-jose_invoices.pdf": "sao jose", "faturas.pdf": "NAO INFORMADO"}),
    (X.spell_abbreviations, {"FHP e HP": "FHP (Fora de Horario de Ponta) e HP (Horario de Ponta)"}),
    (K.availability_kwh, {"Trifásico": 100.0, "BIFASICO": 50.0, "mono": 30.0, "": 0.0}),
    (K.bridge_class, {"B4A": "IP", "Alta Tensão": "A4", "comercial": "B3", "": "OUTROS"}),
    (K.contract_class, {"B4A": "OUTROS", "amt": "A4", "ip rural": "IP"}),
    (lambda c: F.date_format(D.contract_date(c), "yyyy-MM-dd"), {"09/2025": "2025-09-01", "SET/2025": "2025-09-01", "24/11/2025": "2025-11-24", "x": None}),
    (lambda c: F.date_format(D.bridge_date(c), "yyyy-MM-dd"), {"02/03/2025": "2025-02-03", "25/03/2025": "2025-03-25", "FEV-24": "2024-02-01"}),
])
def test_scalar(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_money_text(spark):
    row = spark.range(1).select(
        X.format_brl(F.lit(1234.5)).alias("a"), X.format_currency(F.lit(None).cast("double")).alias("b"),
        X.page_label(F.lit("d/f.pdf"), F.lit("3")).alias("c"), X.page_label(F.lit(""), F.lit("0")).alias("d")).first()
    assert tuple(row) == ("R$ 1.234,50", "N/A", "f page: 3", "")


def test_column_wide_parse_choice(spark):
    df = spark.createDataFrame([("1.5", "R$ 1.500"), ("R$ 2,00", "2,5")], "a string, b string")
    rows = [tuple(r) for r in N.numeric_columns(df, ["a", "b", "c"], 0.0).select("a", "b", "c").collect()]
    assert sorted(rows) == [(0.0, 2.5, 0.0), (1.5, 1500.0, 0.0)]


def test_exact_sum_is_order_free(spark):
    df = spark.range(100_000).select((F.col("id") % 1000 * 0.1).alias("v"))
    sums = {df.repartition(n).agg(N.exact_sum(F.col("v"))).first()[0] for n in (1, 3, 7)}
    assert sums == {4_995_000.0}


def test_column_resolution():
    columns = ["Município", "KWH Total_TE", "Unidade Consumidora"]
    assert header_name("Endereço (UC)") == "endereco_uc"
    assert resolve_loose(columns, ["kw"]) == "KWH Total_TE"
    assert resolve_exact_first(["kwh_total", "kwh"], ["kwh"]) == "kwh"
    assert resolve_loose(["kwh_total", "kwh"], ["kwh"]) == "kwh_total"


def test_schema_helpers(spark):
    df = spark.createDataFrame([("1", None, 2.0)], "uc string, nome string, z double")
    out = with_output_contract(df).first()
    assert (out.nome, out.kwh_total_te, out.needs_review) == ("", 0.0, False)
    assert reorder(df, ["z", "nope"]).columns == ["z", "uc", "nome"]
    assert not fits_template(df)
    whole = spark.createDataFrame([("1", "B3", "01/2025", 2.0)], "UC string, Categoria string, referencia string, kwh_total_te double")
    assert fits_template(whole) and not fits_template(whole.limit(0)) and not fits_template(whole.drop("referencia"))
    assert df.select(first_number(df, ["missing", "z"]).alias("v")).first().v == 2.0
    with pytest.raises(ContractSchemaError) as error:
        check_contract(df)
    assert error.value.missing_columns == ["referencia", "kwh_total_te"]


def test_unique_messages(spark):
    row = spark.range(1).select(K.unique_messages(
        F.array(F.lit(" a "), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("a"))).alias("m")).first()
    assert row.m == ["a", "b"]


def test_searches_run_once_and_only_where_their_word_is(spark):
    """A found text is not searched for twice, and guards by word lose no match: marks, long s, Kelvin sign, dotted and dotless i."""
    assert X.needed_word(r"\bRefer[êe]ncia:\s*(\d{2}/\d{4})\b") == "REFER"
    assert X.needed_word(r"\bTotal\s+(?:da\s+)?Faturas?:") == "FATURA"
    assert X.needed_word(r"\bJAN|FEV\b") == X.needed_word(r"\b(?:UC)?[A-Z]\d{2}") == ""
    texts = ["Orıgem: Sul", "ORİGEM: Sul", "origem:  Sul", "Origem Sul", "", None, "x\n\nORIGEM: Sul", "Classe de Conſumo: Rural", "KWh 12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\bOrigem:\s*(\w+)", r"\bClasse\s+(?:de\s+)?Consumo:\s*(.+?)(?:\n|$)", r"\bkWh\b\s*([0-9]+)"):
        rows = df.select(X.pick(F.col("t"), pattern).alias("all"), X.pick(F.col("t"), pattern, plain=X.ascii_upper(F.col("t"))).alias("guarded")).collect()
        assert [r["all"] for r in rows] == [r["guarded"] for r in rows] and any(r["all"] for r in rows)
    once = df.select(F.transform(F.array("t"), lambda t: F.coalesce(F.nullif(t, t), X.pick(t, r"\bOrigem:\s*(\w+)"))).alias("o"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_single_spaces_of_any_mix(spark):
    texts = ["a b", " a\nb ", "a \n b", "a b", "a  b", "a\tb", "\n\n", "", None, "a\x1cb\x85c", "á\n\té"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        X.squeeze(F.col("t")).alias("s"), F.trim(F.regexp_replace("t", r"[\s\x1c-\x1f\x85\x{a0}]+", " ")).alias("e")).collect()
    assert [r["s"] for r in rows] == [r["e"] for r in rows]
