"""Awkward inputs: amounts that are no numbers, rows over several partitions, order within a page, letters of other blocks."""

import pytest
from pyspark.sql import functions as F

from wattledger.functions.numbers import sum_or_zero
from wattledger.functions.text import ascii_upper
from wattledger.operators.analytics import savings_opportunities, with_costs, with_reference_date
from wattledger.operators.audit import with_page_trail
from wattledger.operators.matrix import category_table, month_matrix
from wattledger.operators.quality import units_all_zero, units_missing_months
from wattledger.operators.rows import numbered
from wattledger.operators.sizing import read_sizing_summary

MONTHS = "uc string, referencia string, kwh_total_te double"


def test_amounts_that_are_no_numbers(spark):
    rows = [("a", "01/2025", x) for x in (1.5, float("nan"), float("inf"), float("-inf"), None, 2.25)]
    df = spark.createDataFrame(rows, MONTHS)
    assert df.agg(sum_or_zero(F.col("kwh_total_te"))).first()[0] == 3.75
    assert month_matrix(df, ["uc"]).first().m00 == 3.75


@pytest.mark.parametrize("value", [0.1, 123456789012.123456, -7.000001, 9e12])
def test_large_sums_take_the_same_path(spark, value):
    df = spark.createDataFrame([(value,)] * 3, "v double")
    assert df.agg(sum_or_zero(F.col("v"))).first()[0] == pytest.approx(3 * value, rel=1e-15)


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") * 2)
    out = numbered(df, "n").collect()
    assert sorted(r.n for r in out) == list(range(1000)) and all(r.id == r.n for r in out)
    assert numbered(df.limit(0), "n").count() == 0


def test_default_names_count_up(spark):
    rows = spark.createDataFrame([("T", "", str(k)) for k in range(1, 7)], "municipio string, cenario string, `potencia necessaria mwp` string")
    names = [r.cenario for r in read_sizing_summary(rows.repartition(1).repartition(3)).collect()]
    assert sorted(names) == [f"Scenario Row {k}" for k in range(1, 7)]


def test_first_text_of_a_page_follows_its_blocks(spark):
    rows = [("u", "01/2025", "B3", "ZETA", "R", "f", 1, 0), ("u", "01/2025", "B3", "ALFA", "R", "f", 1, 1), ("u", "01/2025", "B3", " ", "Q", "e", 9, 0)]
    df = spark.createDataFrame(rows, "uc string, referencia string, categoria string, nome string, endereco string, pdf_source string, page_first_seen int, block_no int")
    df = df.withColumns({"tipo_fornecimento": F.lit("TRIFÁSICO"), "kwh_total_te": F.lit(2.0)})
    row = category_table(df, ["B3"], "B3").first()
    assert (row.LOCAL, row.ENDERECO, row.m00, row.first_page) == ("ZETA", "Q", 6.0, 1.0)


def test_letters_of_other_blocks(spark):
    texts = ["100 ㎾ ① x", "ﬁcção Nº ½", "ＡＢＣ １", "Straße", "çãé", "𝐀𝟏", "日本 3"]
    out = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_upper(F.col("t")).alias("a")).collect()]
    assert out[0] == "100 KW 1 X" and out[1].startswith("FICCAO NO 1") and out[2] == "ABC 1" and out[4] == "CAE" and out[5] == "A1" and out[6].strip() == "3"


def test_advice_without_rows(spark):
    df = spark.createDataFrame([("a", "M", "01/2025", "B3", 10.0, 1.0, 1.0, 0.0, 10.0, 5.0)], "uc string, municipio string, referencia string, categoria string, "
                               "kwh_total_te double, consumo_hp_kwh double, consumo_fhp_kwh double, dif_demanda double, itens_fatura_energia_kwh double, itens_fatura_energia_valor_rs double")
    enriched = with_costs(with_reference_date(df))
    assert [r[0] for r in savings_opportunities(enriched.limit(0)).collect()] == ["Sem dados de extração para análise."]
    assert "Sem dados" not in savings_opportunities(enriched).first()[0]


def test_quality_lists_are_whole(spark):
    df = spark.createDataFrame([(f"u{k}", "m", "B3", "2025-01", 0.0) for k in range(450)], "uc string, municipio string, consumer_class string, reference_month string, consumption_kwh double")
    df = df.withColumn("reference_date", F.to_date(F.lit("2025-01-01")))
    assert units_all_zero(df).count() == 450 and units_all_zero(df, top=7).count() == 7
    longest = units_missing_months(df, months=40)
    assert longest.count() == 450 and len(longest.first().missing_months.split(", ")) == 39


def test_trail_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, "01/2025", "f.pdf", 1), ("a", "01/2025", "f.pdf", 2), ("a", "01/2025", "g.pdf", 3)], "uc string, referencia string, pdf_source string, page_first_seen int")
    out = with_page_trail(df)
    assert out.count() == 3 and {r.audit_pdf_pages for r in out.filter("uc = 'a'").collect()} == {"f: 2 | g: 3"}
