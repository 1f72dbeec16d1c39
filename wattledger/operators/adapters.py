"""Foreign contract tables -> the standard contract."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.functions import fixed_values as V
from wattledger.functions.columns import column_type, resolve_loose
from wattledger.functions.dates import contract_date, iso_label
from wattledger.functions.domain import contract_class, known_class, rule_class
from wattledger.functions.numbers import as_number, contract_number
from wattledger.functions.text import strip
from wattledger.operators.rows import numbered

STANDARD_COLUMNS = [
    "municipio", "uc", "consumer_class", "reference_date", "reference_month", "consumption_kwh",
    "demand_kw", "source_file", "adapter_name", "adapted_at",
]


@dataclass
class FieldMapping:
    """Where a standard field comes from."""

    aliases: list[str]
    required: bool = False
    fallback: str | None = None
    fallback_mode: str | None = None  # "index" or "today_first_of_month"


@dataclass
class Adapter:
    """Rules that turn one distributor's table into the standard contract.

    `class_rules=None` means the fixed class words of the first family.
    """

    name: str
    mappings: dict[str, FieldMapping]
    class_rules: list[tuple[str, str]] | None = None
    class_default: str = "OUTROS"
    column_keywords: list[str] = field(default_factory=list)
    content_keywords: list[str] = field(default_factory=list)
    column_signature: list[str] = field(default_factory=list)
    signature_points: float = V.DETECTION_POINTS["signature"]
    description: str = ""

    def required_columns(self) -> list[str]:
        """What a contract must hold before this adapter may run."""
        if self.class_rules is None:
            return list(V.CONTRACT_COLUMNS)
        return [m.aliases[0] for m in self.mappings.values() if m.required and m.aliases] or list(V.CONTRACT_COLUMNS)


def _mappings(aliases: dict[str, list[str]]) -> dict[str, FieldMapping]:
    fallback = {"municipio": "NAO INFORMADO", "consumer_class": "OUTROS", "source_file": "extraction_output"}
    mode = {"uc": "index", "reference_date": "today_first_of_month"}
    return {
        name: FieldMapping(list(names), name == "consumption_kwh", fallback.get(name), mode.get(name))
        for name, names in aliases.items()
    }


def built_in_adapters() -> dict[str, Adapter]:
    out = {}
    for name in V.FIRST_FAMILY_ADAPTERS:
        signature = V.FIRST_FAMILY_SIGNATURE[1] if name == V.FIRST_FAMILY_SIGNATURE[0] else []
        out[name] = Adapter(name, _mappings(V.FIRST_FAMILY_ALIASES), None, "OUTROS", [name], [name], list(signature))
    for name, hints in V.RULE_ADAPTER_HINTS.items():
        out[name] = Adapter(
            name, _mappings(V.RULE_FAMILY_ALIASES), list(V.RULE_FAMILY_CLASSES), "OUTROS",
            list(hints["columns"]), list(hints["content"]))
    return dict(sorted(out.items()))


def adapter_from_dict(raw: dict) -> Adapter:
    """Read an adapter file: `column_mappings`, `consumer_class_rules`, `detection_hints`."""
    mappings = {
        name: FieldMapping(list(m.get("aliases", [])), bool(m.get("required", False)), m.get("fallback"), m.get("fallback_mode"))
        for name, m in raw.get("column_mappings", {}).items()
    }
    rules, default = [], "OUTROS"
    for rule in raw.get("consumer_class_rules", []):
        if "default" in rule:
            default = str(rule["default"])
            break  # rules are ordered, nothing after the default is reached
        if rule.get("pattern"):
            rules.append((rule["pattern"], rule.get("value", "OUTROS")))
    hints = raw.get("detection_hints", {})
    return Adapter(
        raw["name"], mappings, rules, default, list(hints.get("column_keywords", [])),
        list(hints.get("content_keywords", [])), list(hints.get("column_signature", [])),
        float(hints.get("signature_score_boost", V.DETECTION_POINTS["signature"])), raw.get("description", ""))


def adapter_to_dict(adapter: Adapter) -> dict:
    return {
        "name": adapter.name,
        "description": adapter.description,
        "column_mappings": {n: {k: v for k, v in asdict(m).items() if v is not None} for n, m in adapter.mappings.items()},
        "consumer_class_rules": [{"pattern": p, "value": v} for p, v in adapter.class_rules or []]
        + [{"default": adapter.class_default}],
        "detection_hints": {
            "column_keywords": adapter.column_keywords, "content_keywords": adapter.content_keywords,
            "column_signature": adapter.column_signature, "signature_score_boost": adapter.signature_points},
    }


def adapters_with(files: list[str]) -> dict[str, Adapter]:
    """Built-in adapters plus JSON (or, where a YAML reader is installed, YAML) files; the first family wins its names."""
    own = {}
    for path in sorted(files):
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
        if path.endswith(".json"):
            raw = json.loads(text)
        else:
            import yaml  # optional

            raw = yaml.safe_load(text)
        adapter = adapter_from_dict(raw)
        own[adapter.name] = adapter
    known = built_in_adapters()
    own = {n: a for n, a in own.items() if n not in V.FIRST_FAMILY_ADAPTERS}
    return dict(sorted({**known, **own}.items()))


def get_adapter(name: str, adapters: dict[str, Adapter] | None = None) -> Adapter:
    adapters = adapters or built_in_adapters()
    key = str(name or "").strip().lower()
    if key not in adapters:
        raise ValueError(f"Unsupported adapter '{name}'. Supported: {', '.join(sorted(adapters))}")
    return adapters[key]


def bindings(df: DataFrame, adapter: Adapter) -> dict[str, str | None]:
    """Which column every field would use. Short aliases bind widely, so look before you trust it."""
    return {name: resolve_loose(df.columns, m.aliases) for name, m in adapter.mappings.items()}


def _trimmed(df: DataFrame, name: str) -> Column:
    return strip(F.col(f"`{name}`").cast("string"))


def _number(df: DataFrame, name: str) -> Column:
    dtype = column_type(df, name)
    value = F.col(f"`{name}`")
    parsed = contract_number(value) if isinstance(dtype, T.StringType) else as_number(value, dtype)
    return F.coalesce(parsed, F.lit(0.0))


def standardize(df: DataFrame, adapter: Adapter | str) -> DataFrame:
    """The ten standard columns. Fails before any job when there is no consumption column."""
    adapter = get_adapter(adapter) if isinstance(adapter, str) else adapter
    bound, maps = bindings(df, adapter), adapter.mappings

    def mapping(name: str) -> FieldMapping:
        return maps.get(name, FieldMapping([]))

    kwh = bound.get("consumption_kwh")
    if kwh is None and (mapping("consumption_kwh").required or adapter.class_rules is None):
        raise ValueError("No consumption column found (expected kWh column).")

    def text(name: str, default: str) -> Column:
        column = bound.get(name)
        return _trimmed(df, column) if column else F.lit(str(mapping(name).fallback or default))

    class_column, reference = bound.get("consumer_class"), bound.get("reference_date")
    if class_column:
        raw = F.coalesce(F.col(f"`{class_column}`").cast("string"), F.lit(""))
        klass = contract_class(raw) if adapter.class_rules is None else rule_class(raw, adapter.class_rules, adapter.class_default)
    else:
        klass = F.lit(str(mapping("consumer_class").fallback or "OUTROS"))
    date = contract_date(F.col(f"`{reference}`"), column_type(df, reference)) if reference else F.trunc(F.current_date(), "MM")
    uc = bound.get("uc")
    demand = bound.get("demand_kw")
    rows = df if uc else numbered(df, "__position")
    return rows.select(
        text("municipio", "NAO INFORMADO").alias("municipio"),
        (_trimmed(df, uc) if uc else F.col("__position").cast("string")).alias("uc"),
        known_class(klass).alias("consumer_class"),
        date.alias("reference_date"),
        (F.greatest(_number(df, kwh), F.lit(0.0)) if kwh else F.lit(0.0)).alias("consumption_kwh"),
        (_number(df, demand) if demand else F.lit(0.0)).alias("demand_kw"),
        text("source_file", "extraction_output").alias("source_file"),
    ).select(
        "municipio", "uc", "consumer_class", "reference_date", iso_label(F.col("reference_date")).alias("reference_month"),
        "consumption_kwh", "demand_kw", "source_file", F.lit(adapter.name).alias("adapter_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("adapted_at"),
    )


def adapter_scores(df: DataFrame, files: list[str] | None = None, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """(adapter, score). Names are judged on the driver, contents in one aggregate over all rows."""
    adapters = adapters or built_in_adapters()
    columns = [c.lower() for c in df.columns]
    joined = " | ".join(columns)
    file_text = " | ".join(f.lower() for f in files or [])
    texts = [c for c in V.DETECTION_TEXT_COLUMNS if c in df.columns]
    points = V.DETECTION_POINTS

    words = sorted({w.lower() for a in adapters.values() for w in a.content_keywords})
    seen = {}
    for c in texts:
        for w in words:
            seen[(c, w)] = F.coalesce(F.bool_or(F.lower(F.col(c).cast("string")).contains(w)), F.lit(False))
    flags = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        e.alias(f"__{texts.index(c)}_{words.index(w)}") for (c, w), e in seen.items()])

    rows = []
    for name, a in sorted(adapters.items()):
        by_name = 0.0
        if a.column_signature and {s.lower() for s in a.column_signature} <= set(columns):
            by_name += a.signature_points
        by_name += points["column"] * sum(1 for w in a.column_keywords if w.lower() in joined)
        by_name += points["file"] * sum(1 for w in a.content_keywords if w.lower() in file_text)
        score = F.lit(float(by_name))
        for c in texts:
            for w in a.content_keywords:
                hit = F.col(f"__{texts.index(c)}_{words.index(w.lower())}")
                score = score + F.when(hit, F.lit(points["content"])).otherwise(0.0)
        rows.append(F.struct(F.lit(name).alias("adapter"), F.when(F.col("__rows") > 0, score).otherwise(0.0).alias("score")))
    return flags.select(F.inline(F.array(*rows)))


def detection(df: DataFrame, files: list[str] | None = None, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """One row: best adapter, score, gap to the second, and whether that is good enough."""
    ranked = adapter_scores(df, files, adapters).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("neg"), F.col("adapter")))).alias("r"))  # one entry per adapter
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    row = ranked.select(
        best["adapter"].alias("best"), (-best["neg"]).alias("confidence"),
        (-best["neg"] + F.coalesce(second["neg"], F.lit(0.0))).alias("gap"))
    sure = (F.col("confidence") >= V.DETECTION_MIN_SCORE) & (F.col("gap") >= V.DETECTION_MIN_GAP)
    return row.select(
        F.when(sure, F.col("best")).alias("adapter"), sure.alias("is_confident"), "confidence", "gap",
        F.when(sure, F.format_string("Detectado por heuristica: score=%.2f, gap=%.2f", "confidence", "gap"))
        .otherwise("Heuristica sem confianca suficiente").alias("reason"))


def detect_adapter(df: DataFrame, files: list[str] | None = None, adapters: dict[str, Adapter] | None = None) -> dict:
    """The detection row on the driver."""
    return detection(df, files, adapters).first().asDict()


_NAME = re.compile(r"^[a-z0-9_]+$")


def save_adapter(adapter: Adapter, folder: str) -> str:
    """Write an adapter file next to the others."""
    if not _NAME.match(adapter.name):
        raise ValueError(f"Invalid adapter name: {adapter.name}")
    path = f"{folder}/{adapter.name}.json"
    with open(path, "w", encoding="utf-8") as handle:
        json.dump(adapter_to_dict(adapter), handle, indent=2, ensure_ascii=False)
    return path
