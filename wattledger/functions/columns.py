"""Driver-side column resolution and shaping: works on schemas, runs no job."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.functions import fixed_values as V
from wattledger.functions.numbers import as_number


def _unmarked(name: object) -> str:
    text = unicodedata.normalize("NFKD", str(name if name is not None else ""))
    return "".join(ch for ch in text if not unicodedata.combining(ch))


def plain_name(name: object) -> str:
    return " ".join(_unmarked(name).lower().split())


def header_name(name: object) -> str:
    """Letters and digits in lower case, anything else as one underscore."""
    return re.sub(r"[^a-zA-Z0-9]+", "_", _unmarked(name)).strip("_").lower()


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_name(c) for c in df.columns])


def resolve_loose(columns: list[str], aliases: list[str]) -> str | None:
    """Alias by alias, the first column that equals or contains it.

    Short aliases bind widely (`kw` also finds `kwh_total_te`); that is part of
    the contract, so callers show the binding instead of guarding against it.
    """
    for alias in map(plain_name, aliases):
        for column in columns:
            if alias in plain_name(column):
                return column
    return None


def resolve_exact_first(columns: list[str], aliases: list[str]) -> str | None:
    """Equal names over all aliases first, contained names after."""
    wanted = [plain_name(a) for a in aliases]
    for alias in wanted:
        for column in columns:
            if plain_name(column) == alias:
                return column
    for alias in wanted:
        for column in columns:
            if alias and alias in plain_name(column):
                return column
    return None


def resolve_one(columns: list[str], name: str) -> str | None:
    """One candidate: the equal column, else the first containing one."""
    return resolve_exact_first(columns, [name])


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def first_number(df: DataFrame, candidates: list[str]) -> Column:
    """Left-to-right fill over the candidate columns that exist."""
    names = [n for n in (resolve_one(df.columns, c) for c in candidates) if n is not None]
    if not names:
        return F.lit(None).cast("double")
    return F.coalesce(*[as_number(F.col(n), column_type(df, n)) for n in names])


def or_default(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def with_output_contract(df: DataFrame) -> DataFrame:
    """All promised columns, with promised types and no nulls."""
    columns = {}
    for name in V.OUTPUT_TEXT_COLUMNS:
        columns[name] = F.coalesce(or_default(df, name, "").cast("string"), F.lit(""))
    for name in V.OUTPUT_FLAG_COLUMNS:
        columns[name] = F.coalesce(or_default(df, name, False).cast("boolean"), F.lit(False))
    for name in V.OUTPUT_NUMBER_COLUMNS:
        value = as_number(F.col(name), column_type(df, name)) if name in df.columns else F.lit(0.0)
        columns[name] = F.coalesce(value, F.lit(0.0))
    return df.withColumns(columns)


def reorder(df: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    front = [c for c in (preferred or V.DISPLAY_COLUMN_ORDER) if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def fits_template(df: DataFrame) -> bool:
    """Whether the columns allow a template export and there is a row; only a frame with the columns is asked for one."""
    names = {header_name(c) for c in df.columns}
    return (
        {"categoria", "uc"} <= names
        and bool(names & {"referencia", "reference_date"})
        and bool(names & {"kwh_total_te", "itens_fatura_energia_kwh"})
        and not df.isEmpty()
    )


class ContractSchemaError(ValueError):
    """Columns that a contract promises are missing."""

    def __init__(self, missing: list[str], actual: list[str], required: list[str], source: str = ""):
        self.missing_columns, self.actual_columns, self.required_columns = missing, actual, required
        self.source, self.schema_version = source, V.CONTRACT_VERSION
        super().__init__(
            f"Contract schema validation failed (schema={V.CONTRACT_VERSION}). "
            f"Missing columns: {', '.join(missing) or '-'}. Contract: {source or '-'}"
        )


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_contract(df: DataFrame, required: list[str] | None = None, source: str = "") -> DataFrame:
    """Raise before any job starts when required columns are absent."""
    required = V.CONTRACT_COLUMNS if required is None else required
    missing = missing_columns(df, required)
    if missing:
        raise ContractSchemaError(missing, list(df.columns), list(required), source)
    return df
