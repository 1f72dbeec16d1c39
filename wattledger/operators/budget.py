"""Budget metrics of a standardized contract, and the contract-to-budget job."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.columns import check_contract
from wattledger.functions.numbers import positive
from wattledger.operators.adapters import detect_adapter, get_adapter, standardize
from wattledger.operators.quality import class_totals, quality_report


@dataclass
class BudgetInputs:
    mwp_ac: float
    dc_ac_ratio: float
    module_wp: float
    inverter_kw: float
    module_price_com_bdi_per_kwp: float
    inverter_price_com_bdi: float
    module_price_sem_bdi_per_kwp: float = 0.0
    inverter_price_sem_bdi: float = 0.0
    additional_capex: float = 0.0
    opex_pct_capex: float = 0.02
    productivity_kwh_kwp_year: float = 1350.0
    energy_tariff_rs_kwh: float = 0.85
    ppp_investor_share_pct: float = 0.70

    def __post_init__(self) -> None:
        if self.mwp_ac < 0:
            raise ValueError("mwp must be >= 0")
        for name in ("dc_ac_ratio", "module_wp", "inverter_kw"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be > 0")


def inputs_frame(spark, inputs: BudgetInputs | list[BudgetInputs]) -> DataFrame:
    """Parameter rows; a list gives one budget per row."""
    rows = inputs if isinstance(inputs, list) else [inputs]
    fields = list(asdict(rows[0]))
    structs = [F.struct(*[F.lit(float(asdict(r)[f])).alias(f) for f in fields]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def budget_metrics(standardized: DataFrame, inputs: DataFrame) -> DataFrame:
    """Plant, cost and savings columns per parameter row; consumption is aggregated once."""
    c = F.col
    rows = inputs.crossJoin(F.broadcast(class_totals(standardized)))
    rows = rows.withColumn("ac_kwp", c("mwp_ac") * 1000.0).withColumn("dc_kwp", c("ac_kwp") * c("dc_ac_ratio"))
    rows = rows.withColumns({
        "module_count": F.ceil(c("dc_kwp") / (c("module_wp") / 1000.0)),
        "inverter_qty": F.ceil(c("ac_kwp") / c("inverter_kw")),
    })
    for bdi in ("sem", "com"):
        rows = rows.withColumns({
            f"modules_capex_{bdi}": c("dc_kwp") * c(f"module_price_{bdi}_bdi_per_kwp"),
            f"inverters_capex_{bdi}": c("inverter_qty") * c(f"inverter_price_{bdi}_bdi"),
        }).withColumn(
            f"total_capex_{bdi}", c(f"modules_capex_{bdi}") + c(f"inverters_capex_{bdi}") + c("additional_capex"))
    rows = rows.withColumns({
        "annual_opex": c("total_capex_com") * c("opex_pct_capex"),
        "annual_generation_kwh": c("dc_kwp") * c("productivity_kwh_kwp_year"),
        "annual_consumption_kwh": c("TOTAL"),
        "investor_share_pct": F.least(F.greatest("ppp_investor_share_pct", F.lit(0.0)), F.lit(1.0)),
    })
    rows = rows.withColumn("annual_offset_kwh", F.when(
        c("annual_consumption_kwh") > 0, F.least("annual_generation_kwh", "annual_consumption_kwh")
    ).otherwise(c("annual_generation_kwh")))
    rows = rows.withColumn("annual_gross_savings", c("annual_offset_kwh") * c("energy_tariff_rs_kwh"))
    rows = rows.withColumn("annual_ppp_investor_revenue", c("annual_gross_savings") * c("investor_share_pct"))
    return rows.withColumns({
        "annual_ppp_customer_savings": c("annual_gross_savings") - c("annual_ppp_investor_revenue"),
        "annual_project_cashflow": c("annual_ppp_investor_revenue") - c("annual_opex"),
        "simple_payback_years": c("total_capex_com") / positive(c("annual_ppp_investor_revenue") - c("annual_opex")),
    })


def nested_metrics(metrics: DataFrame) -> DataFrame:
    """The same row as nested groups, the shape of a snapshot."""
    def group(name: str, fields: dict[str, str]):
        return F.struct(*[F.col(c).alias(a) for a, c in fields.items()]).alias(name)

    def capex(bdi: str):
        return group(f"capex_{bdi}_bdi", {
            "modules": f"modules_capex_{bdi}", "inverters": f"inverters_capex_{bdi}",
            "additional": "additional_capex", "total": f"total_capex_{bdi}"})

    ppp = ["annual_generation_kwh", "annual_consumption_kwh", "annual_offset_kwh", "annual_gross_savings",
           "investor_share_pct", "annual_ppp_investor_revenue", "annual_ppp_customer_savings",
           "annual_project_cashflow", "simple_payback_years"]
    return metrics.select(
        group("inputs", {f: f for f in BudgetInputs.__dataclass_fields__}),
        group("consumption_by_class_kwh", {x: x for x in ("B3", "IP", "A4", "OUTROS", "TOTAL")}),
        group("sizing", {x: x for x in ("ac_kwp", "dc_kwp", "module_count", "inverter_qty")}),
        capex("sem"), capex("com"),
        group("opex", {"annual_opex": "annual_opex", "opex_pct_capex": "opex_pct_capex"}),
        group("ppp", {x: x for x in ppp}),
    )


def budget_pipeline(
    contract: DataFrame, adapter: str, inputs: BudgetInputs | list[BudgetInputs],
    months: int = V.MONTHS_IN_WINDOW, source: str = "", allow_critical: bool = True,
) -> dict:
    """Validate, choose the adapter, standardize, judge quality, compute metrics.

    `adapter="auto"` detects it and fails when that is not certain.
    `allow_critical=False` refuses metrics for a contract with critical findings.
    """
    requested = str(adapter or "").strip().lower()
    found = None
    used = requested
    if requested in ("", "auto"):
        found = detect_adapter(contract)
        if not found["is_confident"]:
            raise ValueError("AUTO adapter nao conseguiu detectar com confianca. Escolha manualmente CELESC/ENEL/CPFL.")
        used = found["adapter"]
    else:
        check_contract(contract, get_adapter(used).required_columns(), source)
    standardized = standardize(contract, used)
    quality = quality_report(standardized, months)
    if not allow_critical and quality["summary"].first()["is_critical"]:
        raise ValueError("Contrato com achados criticos de qualidade.")
    return {
        "standardized": standardized,
        "quality": quality,
        "metrics": budget_metrics(standardized, inputs_frame(contract.sparkSession, inputs)),
        "adapter_requested": requested,
        "adapter_used": used,
        "adapter_detection": found,
    }
