"""Operators on small literal tables."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wattledger.operators import adapters as AD
from wattledger.operators import audit as AU
from wattledger.operators import budget as BU
from wattledger.operators import catalog as CT
from wattledger.operators import items as IT
from wattledger.operators import matrix as MX
from wattledger.operators import quality as QU
from wattledger.operators import scenario as SC
from wattledger.operators import sizing as SZ
from wattledger.sources import readers as RD
from wattledger.sources import writers as WR


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_page_trail(spark):
    df = spark.createDataFrame(
        [("123", "01/2025", "x/a.pdf", 3), ("123", "01/2025", "a.pdf", 1), ("123", "01/2025", "b.pdf", 2), ("123", "02/2025", "b.pdf", 4)],
        "uc string, referencia string, pdf_source string, page_first_seen int")
    assert rows(AU.page_trail(df, ["uc", "referencia"])) == [("123", "01/2025", "a: 1, 3 | b: 2"), ("123", "02/2025", "b: 4")]
    assert AU.page_trail(df.limit(0)).columns == ["uc", "audit_pdf_pages"]
    assert AU.with_page_trail(df).count() == 4


@pytest.fixture(scope="module")
def master(spark):
    data = [
        ("1", "01/2025", "B3", "TRIFÁSICO", 10.0), ("1", "01/2025", "B3", "", 5.0), ("1", "12/2024", "B3", "TRIFÁSICO", 7.0),
        ("2", "03/2020", "B3", "", 9.0), ("3", "bad", "IP", "BIFÁSICO", 4.0), ("4", "01/2025", "A4", "", 3.0),
    ]
    df = spark.createDataFrame(data, "uc string, referencia string, categoria string, tipo_fornecimento string, kwh_total_te double")
    extra = {c: F.lit(2.0) for c in ("demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh")}
    return df.withColumns({**extra, "dif_demanda": F.lit(-1.0), "demanda_contratada_kw": F.lit(0.0), "nome": F.lit("n"), "endereco": F.lit("e"),
                           "pdf_source": F.lit("p"), "page_first_seen": F.col("uc").cast("int")})


def test_matrix_keeps_units_outside_the_window(master):
    out = {r.uc: r for r in MX.month_matrix(master, ["uc"]).collect()}
    assert (out["1"].m00, out["1"].m01, out["2"].m00, out["3"].m00) == (15.0, 7.0, 0.0, 0.0)


def test_matrix_total_equals_window_total(master):
    r = MX.reconciliation(master).first()
    assert (r.master_total, r.template_total, r.difference) == (25.0, 25.0, 0.0)


def test_category_and_a4_tables(master):
    b3 = MX.in_page_order(MX.category_table(master, ["B3"], "B3")).collect()
    assert [r.UC for r in b3] == ["1", "2"]
    assert (b3[0].m00, b3[0].m02, b3[0].DISPONIBILIDADE, b3[1].m00, b3[1].PDF_INFO) == (15.0, 100.0, 100.0, 0.0, "p")
    a4 = MX.a4_table(master).first()
    assert a4.consumo_hp == [2.0] + [0.0] * 12 and a4.DEMANDA_CONTRATADA_UNICA_KW == 2.0 and a4.DEMANDA_ULTRAPASSADA_KW == 0.0
    assert MX.category_table(master, ["none"], "B3").count() == 0


def test_sizing_inputs_match_the_tables(master):
    r = MX.sizing_inputs(master).first()
    table = MX.mean_month_total(MX.category_table(master, ["B3"], "B3")).first()[0]
    series = MX.mean_series_total(MX.a4_table(master), "consumo_hp").first()[0]
    assert r.b3_media == pytest.approx(table) and r.a4_hp_media == pytest.approx(series)


def test_quality_of_an_empty_contract(spark):
    df = AD.standardize(spark.createDataFrame([("1", "01/2025", "5")], "uc string, referencia string, kwh_total_te string"), "celesc")
    empty = QU.quality_summary(df.limit(0)).first()
    assert empty.critical_messages == ["Contrato vazio apos adaptacao."] and empty.is_critical
    one = QU.quality_summary(df).first()
    assert one.critical_messages == ["Meses disponiveis (1) abaixo do esperado (13)."]
    missing = QU.units_missing_months(df).first()
    assert missing.missing_months_count == 12 and missing.missing_months.startswith("2024-01, 2024-02")


def test_adapters(spark, tmp_path):
    df = spark.createDataFrame([("1", "SET/2025", "1,234.56", "b4 rural")], "instalacao string, competencia string, `consumo_kwh` string, classe string")
    out = AD.standardize(df, "light").first()
    assert (out.uc, str(out.reference_date), out.consumption_kwh, out.consumer_class, out.municipio) == ("1", "2025-09-01", 0.0, "IP", "NAO INFORMADO")
    with pytest.raises(ValueError):
        AD.standardize(df.drop("consumo_kwh"), "celesc")
    with pytest.raises(ValueError):
        AD.get_adapter("nope")
    assert AD.detect_adapter(df)["is_confident"] is False
    path = AD.save_adapter(AD.Adapter("mine", AD._mappings({"consumption_kwh": ["z"]}), [("^x", "IP")]), str(tmp_path))
    back = AD.adapters_with([path])["mine"]
    assert back.class_rules == [("^x", "IP")] and back.required_columns() == ["z"]


def test_municipal_sizing_and_tariff_rules(spark):
    df = spark.createDataFrame(
        [("X", "1", "01/2025", "B3", 130.0), ("X", "1", "01/2020", "B3", 999.0), ("Y", "2", "02/2025", "A4", 26.0), ("Y", "2", "bad", "A4", 1.0)],
        "municipio string, uc string, referencia string, categoria string, kwh_total_te double")
    out = {r.municipio: r for r in SZ.municipal_sizing(df, tariffs=SZ.given_tariffs(spark, {"B3": 0.5})).collect()}
    assert out["X"].consumo_medio_mensal_kwh["B3"] == 10.0 and out["X"].monthly_energy_cost_brl["TOTAL"] == 5.0
    assert not out["X"].payback_needs_tariff_input and out["X"].payback_months > 0
    assert out["Y"].payback_needs_tariff_input and out["Y"].payback_months is None
    assert out["Y"].consumo_medio_mensal_kwh["A4_FHP"] == 2.0 and len(out["Y"].warnings) == 1
    assert out["X"].month_labels[-1] == "01/2025" and out["X"].month_labels[0] == "01/2024"
    with pytest.raises(ValueError):
        SZ.SizingParameters(sun_hours=0)


def test_scenario_numbers(spark):
    base = {"name": "S", "pricing_version": "V", "mwp_ac": 1.0, "dc_ac_ratio": 1.2, "modules_per_string": 20, "strings_per_combiner": 24,
            "spare_factor": 1.05, "module_model": "M", "inverter_model": "gone"}
    overrides = {k: F.lit(None).cast("double") for k in ("module_price_sem_override", "module_price_com_override", "inverter_price_sem_override", "inverter_price_com_override")}
    scenarios = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()], *[v.alias(k) for k, v in overrides.items()])
    module = CT.modules(spark.createDataFrame([("M", "B", "550", "41.0", "49.5", "-0.29", "2800", "R$ 3.500,00")],
                                              "model string, brand string, wp string, vmp string, voc string, temp_coeff_voc string, price_sem_bdi_per_kwp string, price_com_bdi_per_kwp string"))
    inverter = CT.inverters(spark.createDataFrame([("I", "100", "200", "800", "48000", "60000")],
                                                  "model string, kw string, mppt_min_v string, mppt_max_v string, price_sem_bdi string, price_com_bdi string"))
    r = SC.size_scenarios(SC.resolve_equipment(scenarios, module, inverter)).first()
    assert (r.ac_kwp, r.dc_kwp, r.module_count, r.inverter_qty, r.strings, r.combiners, r.combiners_with_spare) == (1000.0, 1200.0, 2182, 10, 110, 5, 6)
    assert r.inverter_resolved == "I" and r.modules_inverters_total_com == 1200 * 3500 + 10 * 60000
    assert r.vstring_vmp_stc == 820.0 and len(r.warnings) == 2  # above the range at STC and in the cold


def test_budget(spark):
    df = AD.standardize(spark.createDataFrame([("1", "01/2025", "1000", "B3")], "uc string, referencia string, kwh_total_te string, subgrupo string"), "celesc")
    inputs = BU.BudgetInputs(1.0, 1.2, 550.0, 100.0, 3500.0, 60000.0, ppp_investor_share_pct=7.0)
    r = BU.nested_metrics(BU.budget_metrics(df, BU.inputs_frame(spark, [inputs]))).first()
    assert r.ppp.annual_offset_kwh == 1000.0 and r.ppp.investor_share_pct == 1.0 and r.ppp.simple_payback_years is None
    assert r.sizing.module_count == 2182 and r.consumption_by_class_kwh.B3 == 1000.0
    with pytest.raises(ValueError):
        BU.BudgetInputs(1.0, 0.0, 550.0, 100.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        BU.budget_pipeline(df, "auto", inputs)


def test_catalog_upsert_is_idempotent(spark):
    schema = "model string, supplier string, pricing_version string, wp double"
    old = spark.createDataFrame([("A", "s", "v", 1.0), ("B", "s", "v", 2.0)], schema)
    new = spark.createDataFrame([(" a", "S", "V", 9.0), ("C", "s", "v", 3.0)], schema)
    once = CT.upsert(old, new)
    assert rows(once) == rows(CT.upsert(once, new)) and once.count() == 3
    assert sorted(r.action for r in CT.upsert_actions(old, new).collect()) == ["added", "updated"]
    saved = CT.saved_text(spark.createDataFrame([(0.27, 1258000.0, 1e-7, " x ")], "a double, b double, c double, d string"), ["a", "b", "d"]).first()
    assert tuple(saved) == ("0.27", "1258000", "x")


def test_sources_and_sinks(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([("0012", "01/2025", 1.5)], "uc string, referencia string, kwh_total_te double")
    WR.csv_and_tsv(df, f"{base}/m.csv", f"{base}/m.tsv")
    assert rows(RD.contract(spark, f"{base}/m.csv")) == rows(RD.contract(spark, f"{base}/m.tsv")) == [("0012", "01/2025", "1.5")]
    with open(f"{base}/bom.csv", "w", encoding="utf-8-sig") as f:
        f.write("uc,referencia\n007,01/2025\n")
    assert RD.contract(spark, f"{base}/bom.csv").columns == ["uc", "referencia"]
    with pytest.raises(ValueError):
        RD.contract(spark, f"{base}/x.xlsx")
    for _ in range(2):
        assert WR.blocks({"a": df, "none": df.limit(0), "two": df.union(df)}, f"{base}/blocks") == {"a": 1, "none": 0, "two": 2}
    assert spark.read.json(f"{base}/blocks/block=none").collect() == [Row(info=WR.EMPTY_BLOCK)]
    assert spark.read.json(f"{base}/blocks/block=two").select("uc", "referencia", "kwh_total_te").collect() == [("0012", "01/2025", 1.5)] * 2
    assert spark.read.parquet(WR.block(df.limit(0), f"{base}/one")).first().info == WR.EMPTY_BLOCK
    run = "2025-01-02_03-04-05_sao_jose_celesc"
    WR.contract_with_profile(df, f"{base}/runs/{run}", run, "celesc")
    history = RD.run_history(*RD.run_folders(spark, f"{base}/runs")).first()
    assert (history.municipio, history.adapter, history.status, history.row_count) == ("sao_jose", "celesc", "ok", 1)
    assert history.contract_path.endswith(f"{run}/contract_master") and history.meta_path.endswith(f"{run}/contract_master_meta")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "doc.pdf.2.txt").write_text("UC: 1", encoding="utf-8")
    assert rows(RD.page_texts(spark, f"{base}/pages")) == [("doc.pdf", 2, "UC: 1")]
    (tmp_path / "map.json").write_text('{"reference_mwp_ac": 30, "reference_dc_kwp": 30000, "sheets": [{"sheet_name": "S", "rows": [{"item_code": "1", "base_quantity": "1.000,5"}]}]}', encoding="utf-8")
    item = RD.line_item_map(spark, f"{base}/map.json").first()
    assert (item.sheet_name, item.base_quantity, item.scaling_rule, item.default_enabled) == ("S", 1000.5, "fixed", True)
    log = spark.createDataFrame([("t", "p", "v", "s", "x", "j")], "timestamp string, project string, version string, scenario_name string, excel_file string, snapshot_file string")
    for _ in range(2):
        WR.append_audit_log(log, f"{base}/log", "me")
    assert [tuple(r) for r in WR.audit_log(spark, f"{base}/log").collect()] == [("t", "me", "p", "v", "s", "x", "j")]
    assert WR.audit_log(spark, f"{base}/no log").count() == 0


def test_snapshot_documents_are_json(spark, tmp_path):
    sized = spark.createDataFrame([("A \"1\"", 2.0, None), ("B", 3.0, 4), ("none", 1.0, 1)], "name string, dc_kwp double, strings int")
    lines = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 'A "1"').otherwise("B").alias("scenario"), (F.col("id") % 5).cast("int").alias("sheet_pos"), (F.col("id") % 7).alias("row_pos"),
        F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("sheet"), F.format_string("I,%d", "id").alias("item_code"), F.lit("d {}").alias("description"),
        F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("scaling_rule"), F.col("id").cast("double").alias("quantity"), F.lit(1.0).alias("unit_price_sem"),
        F.lit(2.0).alias("unit_price_com"), F.col("id").cast("double").alias("subtotal_sem"), F.col("id") * 2.0)
    lines = lines.withColumnRenamed(lines.columns[-1], "subtotal_com")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        WR.snapshots(WR.snapshot_lines(sized, lines, {"project": "P"}), f"{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = RD.snapshot_documents(spark, f"{tmp_path}/s")
    texts = {}
    for r in sorted(read.collect(), key=lambda r: (r.scenario, r.line_no)):
        texts[r.scenario] = texts.get(r.scenario, "") + r.line
    documents = {k: json.loads(t) for k, t in texts.items()}
    assert set(documents) == {'A "1"', "B", "none"} and documents["none"]["line_items"] == [] == documents["none"]["sheet_totals"]
    a = documents['A "1"']
    assert a["setup"] == {"project": "P"} and a["scenario_name"] == 'A "1"' and a["sizing_results"] == {"dc_kwp": 2.0, "strings": None}
    want = sorted((k % 5, k % 7, k) for k in range(0, 300, 3))
    assert sorted((int(x["sheet"][1:]), int(x["item_code"][2:]) % 7, int(x["item_code"][2:])) for x in a["line_items"]) == want
    assert [(int(x["sheet"][1:]), int(x["item_code"][2:]) % 7) for x in a["line_items"]] == [w[:2] for w in want]
    assert [x["sheet"] for x in a["sheet_totals"]] == ["S0", "S1", "S2", "S3", "S4"] and a["totals"]["grand_total_sem_bdi"] == sum(range(0, 300, 3))
    assert RD.snapshot_items(read).count() == 300


def test_page_lists_of_a_hot_unit(spark):
    pages = spark.range(200_000).select(F.lit("u").alias("uc"), F.lit("a.pdf").alias("pdf_source"), (F.col("id") % 100_000 - 40).alias("page_first_seen"))
    text = AU.page_trail(pages.repartition(7)).first().audit_pdf_pages
    assert text == "a: " + ", ".join(map(str, range(-40, 99_960)))
    plan = AU.page_lists(pages, ["uc"], F.col("page_first_seen"))._jdf.queryExecution().toString()
    assert "collect_set" not in plan
    few = spark.createDataFrame([("u", 5), ("u", None), ("u", 64), ("u", 63), ("u", 64), (None, 7), ("v", None)], "uc string, p int")
    assert rows(AU.page_lists(few.filter("uc is not null"), ["uc"], F.col("p"))) == [("u", "5, 63, 64", 5)]


def test_quality_tables_read_the_contract_once(spark):
    data = [("T", "1", "B3", "2023-12", "2023-12-01", 1.5), ("T", "1", "B3", "2018-01", "2018-01-01", 0.0), ("S", "1", "A4", "2023-12", "2023-12-01", None),
            ("T", "2", "IP", None, None, -1.0), ("T", "2", "IP", "", None, 0.0), (None, None, "B3", "2023-11", "2023-11-01", 2.0)]
    df = spark.createDataFrame(data, "municipio string, uc string, consumer_class string, reference_month string, reference_date string, consumption_kwh double").withColumn(
        "reference_date", F.to_date("reference_date"))
    report = QU.quality_report(df)
    summary = report["summary"].first()
    assert (summary.total_rows, summary.unique_ucs, summary.month_count, summary.missing_reference_count, summary.nonpositive_rows, summary.zero_ucs) == (6, 2, 3, 2, 4, 1)
    assert [r[0] for r in report["months_available"].collect()] == ["2018-01", "2023-11", "2023-12"]
    missing = {r.uc: (r.municipio, r.months_present_count, r.missing_months_count, r.missing_months[:16]) for r in report["ucs_with_missing_months"].collect()}
    assert missing == {"1": ("S", 2, 12, "2022-12, 2023-01"), "2": ("T", 0, 13, "2022-12, 2023-01"), None: (None, 1, 12, "2022-12, 2023-01")}
    assert [(r.uc, r.rows, r.total_kwh) for r in report["ucs_all_zero_kwh"].collect()] == [("2", 2, -1.0)]
    assert [tuple(r)[1:3] for r in report["missing_references_list"].collect()] == [("2", "IP")]
    assert {r.consumer_class: tuple(r)[1:4] for r in report["null_zero_stats_by_class"].collect()} == {"B3": (3, 0, 1), "IP": (2, 0, 2), "A4": (1, 1, 1)}
    assert QU.quality_report(df.limit(0))["summary"].first().total_rows == 0


def test_sheets_read_a_written_template(spark, folder):
    """A task of the union would otherwise hold the aggregates of all sheets at once."""
    from wattledger.plans.queries import QUERIES

    assert "Aggregate" not in QUERIES["sheet_split"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_items_read_at_once_are_those_read_one_by_one(spark):
    texts = {
        None: [], "": [], "[]": [], '{"item":"a"}': [], '[{"item":"a"},{"item":"b"': [], '[{"item":"a"},]': [], '[{"item":"a"}],[{"item":"b"}]': [("a", None)],
        ' [{"item":"a","valor":1.50},{"valor":null}] ': [("a", 1.5), (None, None)], '[{"item":1.50}]': [("1.5", None)],
        '[{"item":"a","valor":2}, 7, "x", null, [1]]': [("a", 2.0)], '[{"item":"a"},null,{"item":"b"}]': [("a", None), ("b", None)],
        '[{"valor":"5"},{"valor":"12d"},{"valor":true},{"valor":2}]': [(None, 5.0), (None, None), (None, None), (None, 2.0)],
        '[{"valor":5,"valor":"x"}]': [(None, None)], '[7,{"valor":5,"valor":"x"}]': [(None, None)],
        '[{"item":NaN,"valor":NaN},{"item":1e400,"valor":-1e400}]': [("NaN", None), ("Infinity", None)],
        '[7,{"item":NaN,"valor":NaN}]': [("NaN", None)], '[{"item":"\\u00e9"}]': [("é", None)], '["{\\"item\\":5}"]': [("5", None)],
        '[{"item":"a"}],"__array":[{"item":"b"}]': [("a", None)], '[{"item":"a"}]}, {}]': [("a", None)], "[{'item':'a'}]": [("a", None)],
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    read = df.select("i", IT.parse_items(F.col("v")).alias("x")).orderBy("i").collect()
    assert [[(x["item"], x["valor"]) for x in r["x"]] for r in read] == list(texts.values())
    costly = df.select(IT.parse_items(F.upper("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert costly.count("upper(") == 1  # the text, however made, is made once


def test_items_become_text_once(spark):
    df = spark.createDataFrame([(["a", None],), ([],)], "v array<string>")
    out = df.select(IT.items_json(F.array_distinct("v")).alias("x"))
    assert [r["x"] for r in out.collect()] == ['["a",null]', ""]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1
