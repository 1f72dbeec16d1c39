"""The table bindings of `plans.binding` as SQL, for checking query results."""

from __future__ import annotations


def total(expr: str) -> str:
    """Exact sum, 0 for no rows."""
    return f"coalesce(cast(sum(cast({expr} AS decimal(28,6))) AS double), 0)"


def total_or_null(expr: str) -> str:
    return f"cast(sum(cast({expr} AS decimal(28,6))) AS double)"


def ptbr(expr: str) -> str:
    return f"translate(format('{{:,.2f}}', {expr}), ',.', '.,')"


LINES = """
lines AS (
  SELECT o_custkey AS custkey, lpad(cast(o_custkey AS varchar), 10, '0') AS uc,
         strftime(o_orderdate, '%m/%Y') AS referencia, cast(date_trunc('month', o_orderdate) AS date) AS reference_date,
         'doc_' || (l_suppkey % 20) || '.pdf' AS pdf_source, cast(l_linenumber AS int) AS page_first_seen,
         l_quantity AS quantidade, l_extendedprice / 1000.0 AS valor, l_returnflag, l_linestatus,
         l_discount * 100.0 AS disc, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_PERIOD = {"hp": "A", "fhp": "N", "unico": "R"}


def _sums() -> str:
    out = []
    for tag, flag in _PERIOD.items():
        for k, status in (("te", "F"), ("tusd", "O")):
            out.append(total(f"CASE WHEN l_returnflag = '{flag}' AND l_linestatus = '{status}' THEN quantidade END") + f" AS {tag}_{k}")
        out.append(total(f"CASE WHEN l_returnflag = '{flag}' THEN valor END") + f" AS {tag}_valor")
    return ",\n         ".join(out)


MONTHS = LINES + f""",
line_months AS (
  SELECT custkey, reference_date, {_sums()},
         {total('disc')} AS discounts,
         max(CASE WHEN l_returnflag = 'A' THEN quantidade END) AS max_hp,
         max(CASE WHEN l_returnflag = 'N' THEN quantidade END) AS max_fhp,
         min(l_suppkey % 20) AS doc, min(page_first_seen) AS page
  FROM lines GROUP BY 1, 2),
order_months AS (
  SELECT o_custkey AS custkey, cast(date_trunc('month', o_orderdate) AS date) AS reference_date,
         {total_or_null("CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN 0 END")} AS billed,
         min(o_orderpriority) AS priority
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2),
months AS (
  SELECT l.*, o.billed, o.priority, strftime(l.reference_date, '%m/%Y') AS referencia,
         lpad(cast(l.custkey AS varchar), 10, '0') AS uc,
         CASE substr(priority, 1, 1) WHEN '1' THEN 'TRIFÁSICO' WHEN '2' THEN 'BIFÁSICO' WHEN '3' THEN 'MONOFÁSICO' ELSE '' END AS tipo_fornecimento
  FROM line_months l JOIN order_months o USING (custkey, reference_date))"""

CATEGORY = "CASE c_mktsegment WHEN 'BUILDING' THEN 'B3' WHEN 'HOUSEHOLD' THEN 'B3' WHEN 'MACHINERY' THEN 'IP' WHEN 'AUTOMOBILE' THEN 'A4' ELSE 'OUTROS' END"

MASTER = MONTHS + f""",
master0 AS (
  SELECT custkey, uc, referencia, reference_date, n_name AS municipio, {CATEGORY} AS categoria, tipo_fornecimento,
         c_name AS nome, 'RUA ' || c_nationkey AS endereco, c_mktsegment,
         hp_te + fhp_te + unico_te AS kwh_total_te, hp_te AS consumo_hp_kwh, fhp_te AS consumo_fhp_kwh,
         max_hp AS demanda_hp_kw, max_fhp AS demanda_fhp_kw, discounts - 20.0 AS dif_demanda,
         50.0::double AS demanda_contratada_kw, billed AS total_fatura_rs,
         round(hp_valor + fhp_valor + unico_valor, 6) AS valor, hp_valor, fhp_valor,
         greatest(hp_te, hp_tusd) AS hp_kwh, greatest(fhp_te, fhp_tusd) AS fhp_kwh,
         greatest(hp_te, hp_tusd) + greatest(fhp_te, fhp_tusd) + greatest(unico_te, unico_tusd) AS energia_kwh,
         'doc_' || doc || '.pdf' AS pdf_source, page AS page_first_seen
  FROM months JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
master AS (
  SELECT *, CASE WHEN categoria = 'A4' THEN 'A' ELSE 'B' END AS grupo_tensao,
         CASE categoria WHEN 'A4' THEN 'A4' WHEN 'IP' THEN 'B4A' ELSE 'B3' END AS subgrupo,
         CASE WHEN categoria = 'A4' THEN 'A4 HOROSAZONAL VERDE' ELSE c_mktsegment END AS classificacao_uc,
         CASE WHEN custkey % 3 = 0 THEN 0 ELSE valor END AS itens_fatura_total_valor_rs,
         valor AS itens_fatura_energia_valor_rs, energia_kwh AS itens_fatura_energia_kwh,
         valor / nullif(energia_kwh, 0) AS itens_fatura_preco_medio_rs_kwh,
         hp_valor / nullif(hp_kwh, 0) AS itens_fatura_preco_all_in_hp_rs_kwh,
         fhp_valor / nullif(fhp_kwh, 0) AS itens_fatura_preco_all_in_fhp_rs_kwh,
         CASE WHEN categoria IN ('B3', 'IP') THEN kwh_total_te ELSE 0 END AS kwh_b3_ip,
         CASE WHEN custkey % 4 = 0 THEN 'TEXTO_CONSUMO_TE/CONS_TE' ELSE 'ITENS_CONSUMO_TE/ITEM_CONSUMO_TE_QTD' END AS audit_kwh_source,
         CASE WHEN custkey % 7 = 0 THEN 'GENERIC' ELSE 'CELESC_COLETIVA' END AS provider_layout,
         CASE tipo_fornecimento WHEN 'TRIFÁSICO' THEN 100.0 WHEN 'BIFÁSICO' THEN 50.0 WHEN 'MONOFÁSICO' THEN 30.0 ELSE 0.0 END::double AS disp,
         year(reference_date) * 12 + month(reference_date) AS ix
  FROM master0),
last AS (SELECT max(ix) AS last FROM master)"""

# Enriched month table: costs per row.
COSTS = MASTER + """,
costs AS (
  SELECT *, coalesce(kwh_total_te, 0) * 0.85 AS est_energy, greatest(dif_demanda, 0) AS extra_demand_kw,
         greatest(dif_demanda, 0) * 42.0 AS est_demand,
         CASE WHEN total_fatura_rs > 0 THEN total_fatura_rs WHEN itens_fatura_total_valor_rs > 0 THEN itens_fatura_total_valor_rs END AS actual_total_cost_rs,
         CASE WHEN total_fatura_rs > 0 THEN 'actual_fatura' WHEN itens_fatura_total_valor_rs > 0 THEN 'actual_itens' ELSE 'estimated' END AS cost_source
  FROM master),
enriched AS (
  SELECT *, est_energy + est_demand AS estimated_total_cost_rs,
         coalesce(actual_total_cost_rs, est_energy + est_demand) AS total_cost_rs FROM costs)"""

# Six possible items per month, long form.
ITEMS = MONTHS + f""",
item_rows AS (
  SELECT m.custkey, m.uc, m.referencia, m.reference_date, m.tipo_fornecimento, {CATEGORY} AS categoria, v.posto, v.comp, v.qty, v.price,
         v.qty * v.price AS valor, 'CONSUMO ' || v.posto || ' ' || v.comp AS item
  FROM months m JOIN customer ON custkey = c_custkey,
       LATERAL (VALUES ('HP', 'TE', hp_te, 0.5), ('HP', 'TUSD', hp_tusd, 0.25), ('FHP', 'TE', fhp_te, 0.5),
                       ('FHP', 'TUSD', fhp_tusd, 0.25), ('UNICO', 'TE', unico_te, 0.5), ('UNICO', 'TUSD', unico_tusd, 0.25))
               AS v(posto, comp, qty, price)
  WHERE v.qty > 0),
unit_items AS (
  SELECT m.custkey, m.uc, m.referencia, m.tipo_fornecimento, {CATEGORY} AS categoria,
         hp_te, hp_tusd, fhp_te, fhp_tusd, unico_te, unico_tusd
  FROM months m JOIN customer ON custkey = c_custkey)"""


def slots(value: str, months: int = 13, slot: str = "slot") -> str:
    """Conditional sums over month slots, latest first."""
    return ", ".join(f"{total(f'CASE WHEN {slot} = {i} THEN {value} END')} AS m{i:02d}" for i in range(months))


def mean(months: int = 13, prefix: str = "") -> str:
    return "(" + " + ".join(f"{prefix}m{i:02d}" for i in range(months)) + f") / {float(months)}"


def with_base(base: str, body: str) -> str:
    return f"WITH {base.strip()}\n{body}"
