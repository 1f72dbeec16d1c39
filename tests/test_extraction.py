"""Invoice texts of each layout, all extracted in one job."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.text import ascii_upper, strip, tidy_lines
from wattledger.operators import cascade as C
from wattledger.operators import extraction as EX
from wattledger.operators import history as H
from wattledger.operators import items as I
from wattledger.operators import rules as RU
from wattledger.operators.extraction import extract_pages, grouped_blocks
from wattledger.operators.layouts import document_layouts, layout_of_text

MONTH_LINE = "SET/25 AGO/25 JUL/25 JUN/25 MAI/25 ABR/25 MAR/25 FEV/25 JAN/25 DEZ/24 NOV/24 OUT/24 SET/24"
TEXTS = {
    "items.pdf": """
UC: 1234567890
Referencia: 09/2025
Grupo / Subgrupo Tensao:B-B3
Classificacao / Modalidade Tarifaria / Tipo de Fornecimento: PODER PUBLICO-TRIFASICO Municipio:
Nome: MUNICIPIO TESTE Endereco: RUA A, 10 Etapa:
Itens da Fatura
Consumo TE 4.240,00 0,309625 1.312,81
Energia Unico Apurado 9999
""",
    "text.pdf": """
UC: 1234567891
Referencia: 09/2025
Grupo / Subgrupo Tensao:B-B3
Classificacao / Modalidade Tarifaria / Tipo de Fornecimento: PODER PUBLICO-TRIFASICO Municipio:
Consumo TE 3210,00
""",
    "ip.pdf": """
UC: 1234567892
Referencia: 09/2025
Grupo / Subgrupo Tensao:B-B4A
Classificacao / Modalidade Tarifaria / Tipo de Fornecimento: ILUMINACAO PUBLICA-TRIFASICO Municipio:
Itens da Fatura
Consumo IP TE 1.234,00 0,200000 246,80
""",
    "grouped.pdf": f"""
47430001
MUNICIPIO DE EXEMPLO
Data de Emissao: 11/09/2025
Setembro/2025
CCI* Descricao do Produto Quantidade
0601 CONSUMO TE 4.240,00 0,309625 1.312,81
4240 2600 3160 5160 4960 7200 8160 0 0 0 0 0 0
{MONTH_LINE}
GBELEKTRO1
""",
    "labels.pdf": """
Instalacao: 1234567
Mes/Ano: 01/2025
Subgrupo: B3
Classe de Consumo: Comercial
Modalidade Tarifaria: Convencional
Energia Ativa 1.234,00
Demanda Registrada 45,00
Valor Total: R$ 987,65
""",
    "nothing.pdf": "FATURA SEM DADOS",
    "stray.pdf": "NEOENERGIA x DESCRICAO DO PRODUTO",
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(name, 1, text) for name, text in TEXTS.items()]
    rows += [("stray.pdf", 2, "UC: 1234\nCONSUMO TE 10,00 1,00 1,00\nSetembro/2025")]
    pages = spark.createDataFrame(rows, "pdf_source string, page_no int, text string")
    out = RU.finalize(extract_pages(pages, expand=True)).collect()
    by_file = {}
    for r in out:
        by_file.setdefault(r.pdf_source, {})[r.referencia] = r
    return by_file


def test_energy_priority_and_flags(extracted):
    items, text, ip = (extracted[f]["09/2025"] for f in ("items.pdf", "text.pdf", "ip.pdf"))
    assert (items.categoria, items.kwh_total_te, items.needs_review) == ("B3", 4240.0, False)
    assert items.audit_kwh_source == "ITENS_CONSUMO_TE/ITEM_CONSUMO_TE_QTD"
    assert (items.nome, items.endereco, items.tipo_fornecimento) == ("MUNICIPIO TESTE", "RUA A, 10", "TRIFÁSICO")
    assert (text.kwh_total_te, text.needs_review) == (3210.0, True)
    assert text.audit_kwh_source.startswith("TEXTO_CONSUMO_TE")
    assert (ip.categoria, ip.kwh_total_te, ip.needs_review) == ("IP", 1234.0, False)


def test_grouped_invoice_expands_to_13_months(extracted):
    rows = extracted["grouped.pdf"]
    assert len(rows) == 13
    assert rows["09/2025"].uc == "47430001" and rows["09/2025"].provider_layout == "NEOENERGIA_ELEKTRO"
    assert [rows[m].kwh_total_te for m in ("09/2025", "08/2025", "03/2025")] == [4240.0, 2600.0, 8160.0]
    assert all(r.needs_review for r in rows.values())


def test_generic_labels(extracted):
    row = extracted["labels.pdf"]["01/2025"]
    assert (row.uc, row.categoria, row.kwh_total_te, row.demanda_item, row.total_fatura_rs) == (
        "0001234567", "B3", 1234.0, 45.0, 987.65)


def test_pages_without_data_and_last_resort(extracted):
    assert "nothing.pdf" not in extracted
    # No page of the document has a row of its own, so the short UC counts.
    assert extracted["stray.pdf"]["09/2025"].uc == "1234"


def test_layout_names(spark):
    cases = {
        "RELACAO DE UCs DA COLETIVA\nITENS DA FATURA\nUC: 123": "CELESC_COLETIVA",
        "DOCUMENTO AUXILIAR DA NOTA FISCAL\nITENS de Fatura Unid Quant\nMÊS/ANO": "ENEL_A4",
        TEXTS["grouped.pdf"]: "NEOENERGIA_ELEKTRO",
        "CPFL PAULISTA\nItens da Fatura": "CPFL", "CEMIG DISTRIBUICAO S.A\nConta de Energia": "CEMIG",
        "COPEL\nDescricao do Faturamento": "COPEL", "Equatorial Energia\nFatura": "EQUATORIAL", "Energisa\nFatura": "ENERGISA",
        "Light Servicos de Eletricidade S.A.": "LIGHT", "Neoenergia Coelba\nFatura": "COELBA",
        "FATURA XYZ SEM MARCADORES CONHECIDOS": "GENERIC", "": "GENERIC",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", layout_of_text(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == cases


def test_layout_of_a_long_document(spark):
    """A marker counts on whatever page it stands, and also across a page break."""
    rows = [("late", n, "CPFL Paulista Itens da Fatura" if n == 77 else f"folha {n}") for n in range(1, 121)]
    rows += [("split", n, {50: "texto CONTA DE", 51: "ENERGIA e CEMIG distribuição S.A"}.get(n, "folha")) for n in range(1, 90)]
    pages = spark.createDataFrame(rows, "pdf_source string, page_no int, text string")
    assert {r.pdf_source: r.provider_layout for r in document_layouts(pages).collect()} == {"late": "CPFL", "split": "CEMIG"}


def test_histories(spark):
    texts = [
        "HISTORICO DO FATURAMENTO\nSET/25 10 11 2545 2660\nAGO/25 9 10 171 181",
        "SET/25 1.200 30\n08/2025 900,50 31\nJUL25 77 30 LID",
        "HISTORICO " + MONTH_LINE.replace("/25", "/2025").replace("/24", "/2024"),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", H.a4_history(F.col("t")).alias("a"), H.b_history(F.col("t")).alias("b"),
                     H.a4_month_lines(F.col("t")).alias("m")).orderBy("i").collect()
    a4 = {r.referencia: r for r in rows[0].a}
    assert len(a4) == 13 and a4["09/2025"].consumo_fhp_kwh == 2660.0 and a4["07/2025"].consumo_hp_kwh == 0.0
    assert [r.referencia for r in rows[0].m] == ["08/2025", "09/2025"]
    assert [(r.referencia, r.consumo_kwh) for r in rows[1].b][-3:] == [("07/2025", 77.0), ("08/2025", 900.5), ("09/2025", 1200.0)]
    assert rows[2].a is None and rows[2].b is None


def test_items(spark):
    section = ("ITENS DA FATURA CONSUMO TE 4240 0,309625 1312,81 DIFERENCA DA DEMANDA CONTRATADA 10,00 2,00 20,00 "
               "ENERGIA ATIVA FORNECIDA TUSD KWH 1,0 2,0 3,0")
    df = spark.createDataFrame([(section,)], "s string").select(
        I.labelled_items(F.col("s")).alias("i"), I.energy_items(F.col("s"), F.lit("B3")).alias("e"),
        I.energy_items(F.col("s"), F.lit("A4")).alias("a"))
    row = df.select("i", "e", "a", F.size(I.unique_items(F.concat("i", "e", "i"))).alias("n")).first()
    # Numbers are read in groups of three digits, so an ungrouped 4240 gives 424.
    assert [(x.item, x.quantidade) for x in row.i] == [
        ("CONSUMO TE", 424.0), ("DIFERENCA DA DEMANDA CONTRATADA", 10.0), ("DEMANDA", 10.0)]
    assert [(x.componente, x.posto) for x in row.e] == [("TUSD", "UNICO")] and row.a == [] and row.n == 4


def test_grouped_blocks(spark):
    pages = spark.createDataFrame([("a", 1, "x CCI 1234 one CCI: 5678 two"), ("a", 2, "plain")], "pdf_source string, page_no int, text string")
    assert sorted(r.block for r in grouped_blocks(pages).collect()) == ["CCI 1234 one", "CCI: 5678 two", "plain"]


def test_an_id_below_the_first_lines(spark):
    """A formatted id on line 20; labels above an id win over other numbers; dates are no ids."""
    filler = "\n".join(f"linha {chr(97 + k % 26)}" for k in range(19))
    texts = {
        filler + "\n12.345.678-9": ("0123456789", "DIGIT_FALLBACK"),
        "01/02/2024\n" + filler + "\nUnidade Consumidora\n98.765.432": ("0098765432", "DIGIT_FALLBACK"),
        filler + "\nCódigo de barras 11223344 fim\nInstalação\n55-667788": ("0055667788", "DIGIT_FALLBACK"),
        filler + "\nCódigo de barras 11223344 fim\n55-667788": ("0011223344", "DIGIT_FALLBACK"),
        filler + "\n01/02/2024": None, "UC: 1234567\n" + filler: ("0001234567", "UC"),
        "RUA 12\nCEP 88.000-100\n" + filler: ("0088000100", "DIGIT_FALLBACK"),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("a", ascii_upper(F.col("text")))
    for r in df.select("text", C.uc_of(F.col("text"), F.col("a")).alias("uc")).collect():
        assert (tuple(r.uc) if r.uc else None) == texts[r.text]


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Filter (.*)", plan)


def test_costly_columns_are_not_repeated_in_filters(spark):
    """A filter on a parsed column reads the column; below it, its patterns would run again, once per mention."""
    pages = spark.createDataFrame([("d.pdf", 1, "UC: 123456\nReferencia: 01/2025", "01/2025")], "pdf_source string, page_no int, text string, default_ref string")
    blocks = EX.block_records(EX.uc_blocks(pages))
    fiscal = EX._unlabelled(pages.withColumns({"t": tidy_lines(F.col("text")), "a": F.upper("text")}))
    for df in (blocks, EX.unlabelled_b_records(fiscal), EX.unlabelled_a4_records(fiscal), EX.grouped_records(EX.grouped_blocks(pages))):
        assert _filters(df) and not any("regexp" in f for f in _filters(df))
    assert blocks.count() == 1


def test_pages_without_a_label_are_parsed_beside_labelled_ones(spark):
    """One scan deals the pages: each parser sees its own, with and without white space and marks to tidy."""
    rows = [
        ("d.pdf", 1, "x \t y\r\n\nUC:\t 123456 \x0b\nReferência: 01/2025\n\n Nome:  Ação  Endereço: Rúá  Etapa: 1"),
        ("d.pdf", 2, None), ("e.pdf", 1, ""), ("e.pdf", 2, "nothing here")]
    out = EX.extract_pages(spark.createDataFrame(rows, "pdf_source string, page_no int, text string")).collect()
    assert [(r.pdf_source, r.uc, r.referencia, r.nome) for r in out] == [("d.pdf", "0000123456", "01/2025", "Ação")]


def test_plain_ascii_of_odd_texts(spark):
    """The quick way for Latin letters gives what the decomposition gives."""
    texts = ["", " \t ", "ḉ² µx ıKſ", "ﬁm ①㎥ \U0001f600z", "a\x0b\x1c\x85b  c", "ºª½"]
    def plain(text):
        marks = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
        return " ".join("".join(ch for ch in marks if ch.isascii()).split()).upper()
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_upper(F.col("t")).alias("a"), strip(F.col("t")).alias("s"))
    for row in df.collect():
        assert row.s == re.sub(r"^[ \t-\r]+|[ \t-\r]+\Z", "", row.t)
        if "\x85" not in row.t and "\x1c" not in row.t:
            assert row.a == plain(row.t), row.t


def test_a_page_is_cut_once_and_its_white_space_tidied(spark):
    pages = spark.createDataFrame(
        [("a", 1, "before\r\n\r\n\n UC:  0000001 \t x\n\n\nUC: 0000002\ty  z\n"), ("a", 2, "no label"), ("b", 1, ""), ("b", 2, None)],
        "pdf_source string, page_no int, text string")
    blocks = EX.uc_blocks(pages)
    assert [(r.page_no, r.block_no, r.block) for r in blocks.orderBy("block_no").collect()] == [(1, 0, "UC: 0000001 x"), (1, 1, "UC: 0000002 y z")]
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_texts_to_parse_are_cut_into_small_splits(spark):
    from wattledger.sources.staging import finely_split, materialize

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = spark.range(0, 3000, 1, 1).select("id", F.concat_ws("", F.transform(
        F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256))).alias("text"))
    written = materialize(texts, fine=True)
    with finely_split(spark):
        tasks = written.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 2 and sum(r["count"] for r in tasks) == 3000 and max(r["count"] for r in tasks) < 2500
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_months_are_written_with_records_only_to_be_expanded(spark, monkeypatch):
    written = []

    def noted(df, *args, **kwargs):
        written.append(df.columns)
        return materialize(df, *args, **kwargs)

    materialize = EX.materialize
    monkeypatch.setattr(EX, "materialize", noted)
    text = "CPFL PAULISTA\nUC: 0000000042\nReferencia: 02/2024\nGrupo / Subgrupo Tensao:B-B3\nItens da Fatura\nConsumo TE 10,00 0,500000 5,00\nHISTORICO DE CONSUMO\n02/2024 10,00 30\n01/2024 8,00 30"
    pages = spark.createDataFrame([("a.pdf", 1, text)], "pdf_source string, page_no int, text string")
    rows = {expand: EX.extract_pages(pages, expand).select("referencia", "kwh_total_te").collect() for expand in (False, True)}
    assert ["__months" in c for c in written if "__rank" in c] == [False, True]
    assert [tuple(r) for r in rows[False]] == [("02/2024", 10.0)]
    assert len(rows[True]) == 13 and {("02/2024", 10.0), ("01/2024", 8.0)} <= {tuple(r) for r in rows[True]}


def test_low_voltage_history_is_found_wherever_months_stand(spark):
    texts = {
        "line": "x\n01/2024 8,00 30\n02/2024 9,00 30", "named": "x\n  jan/24 8,00 30\r\n\tFEV24 9,00 30 LID", "none": "Referencia: 01/2024\nConsumo TE 10,00",
        "split": "1 2 3 4 5 6\nJAN/24 FEV/24 MAR/24 ABR/24 MAI/24 jun/24", "few": "1 2\nJAN/24 FEV/24", "null": None}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").select("name", H.b_history(F.col("text")).alias("h")).collect()
    found = {r["name"]: [x["consumo_kwh"] for x in r["h"] if x["consumo_kwh"]] if r["h"] else None for r in rows}
    assert found == {"line": [8.0, 9.0], "named": [8.0, 9.0], "none": None, "split": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "few": None, "null": None}


def test_the_row_of_a_month_needs_no_other_months_of_the_grid(spark):
    months = {"given": "02/2024", "twice": "03/2024", "gap": "01/2024", "first": "03/2023", "before": "02/2023", "after": "04/2024", "short": "2/2024", "blank": "", "null": None}
    text = "HISTORICO\n03/2024 1,00 2,00 3,00 4,00\n02/2024 5,00 6,00 7,00 8,00\n03/2024 9,00 9,00 9,00 9,00"
    shown = [(n, m, t) for n, m in months.items() for t in (text, "UC: 1")]
    df = spark.createDataFrame(shown, "name string, month string, text string")
    rows = df.select("name", "text", H.row_of(H.a4_history(F.col("text")), F.col("month")).alias("of_grid"),
                     H.grid_row(H.a4_dated(F.col("text")), F.col("month"), V.HISTORY_MEASURES).alias("alone")).collect()
    assert all(r["alone"] == r["of_grid"] for r in rows) and all(r["alone"] is None for r in rows if r["text"] != text)
    found = {r["name"]: r["alone"] and r["alone"]["demanda_hp_kw"] for r in rows if r["text"] == text}
    assert found == {"given": 5.0, "twice": 9.0, "gap": 0.0, "first": 0.0, "before": None, "after": None, "short": None, "blank": None, "null": None}


def test_records_without_expansion_build_no_month_grid(spark):
    blocks = spark.createDataFrame([("a.pdf", 1, "UC: 0000000042", "", "")], "pdf_source string, page_no int, block string, default_ref string, provider_layout string")
    records = EX.block_records(blocks)
    plans = [records.select(c)._jdf.queryExecution().optimizedPlan().toString() for c in ("demanda_hp_kw", "__months")]
    assert [plan.count("sequence(") > 0 for plan in plans] == [False, True]
