"""Equipment, price and municipality catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import fixed_values as V
from wattledger.functions.numbers import locale_number
from wattledger.functions.text import found, search_key, strip


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(found(strip(value)), F.lit(default)).alias(name)


def _number(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    value = locale_number(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("double")
    return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)


def _with_position(df: DataFrame) -> DataFrame:
    return df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())


def _typed(df: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    df = _with_position(df)
    return df.select(*[_number(df, c) if c in numbers else _text(df, c) for c in columns], "pos")


def modules(raw: DataFrame) -> DataFrame:
    """All-text rows to typed modules; `pos` keeps the row order."""
    return _typed(raw, V.MODULE_COLUMNS, V.MODULE_NUMBERS)


def inverters(raw: DataFrame) -> DataFrame:
    return _typed(raw, V.INVERTER_COLUMNS, V.INVERTER_NUMBERS)


def bos_items(raw: DataFrame) -> DataFrame:
    """Base quantities stay null when blank."""
    df = _with_position(raw)
    rules = {"bdi_rule": "direct_com_bdi", "scaling_rule": "fixed"}
    out = []
    for c in V.BOS_COLUMNS:
        if c in V.BOS_QUANTITIES:
            out.append(_number(df, c, None))
        elif c in ("unit_price_sem", "unit_price_com"):
            out.append(_number(df, c))
        else:
            out.append(_text(df, c, rules.get(c, "")))
    return df.select(*out, "pos")


def pricing_versions(raw: DataFrame) -> DataFrame:
    return _typed(raw, V.PRICING_VERSION_COLUMNS, [])


def _key(prefix: str = "") -> list[Column]:
    return [F.lower(strip(F.coalesce(F.col(c), F.lit("")))).alias(f"{prefix}{c}") for c in V.CATALOG_KEY]


def saved_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """All-text form for saving; numbers with up to 12 significant digits and no trailing zeros."""
    out = []
    for c in columns:
        value = F.col(c) if c in df.columns else F.lit("")
        if c in df.columns and dict(df.dtypes)[c] in ("double", "float"):
            text = F.format_string("%.12g", value)
            plain = F.when(F.abs(value).between(1e-4, 1e12), F.format_string("%.12f", value))
            digits = F.coalesce(plain, text)
            trimmed = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
            value = F.when(F.col(c) == 0, "0").otherwise(trimmed)
        out.append(strip(F.coalesce(value.cast("string"), F.lit(""))).alias(c))
    return df.select(*out)


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace whole rows by (model, supplier, pricing_version), trimmed and in any case; add the others."""
    keep = existing.select(*existing.columns, *_key("__"))
    keys = incoming.select(*_key("__")).distinct()
    kept = keep.join(keys, [f"__{c}" for c in V.CATALOG_KEY], "left_anti").select(*existing.columns)
    return kept.unionByName(incoming, allowMissingColumns=True).select(*existing.columns)


def upsert_actions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """`added` or `updated` per incoming row."""
    names = [f"__{c}" for c in V.CATALOG_KEY]
    known = existing.select(*_key("__")).distinct().withColumn("__known", F.lit(True))
    rows = incoming.select(*incoming.columns, *_key("__")).join(known, names, "left")
    return rows.withColumn("action", F.when(F.col("__known"), "updated").otherwise("added")).drop(*names, "__known")


def filter_rows(df: DataFrame, brand: str = "All", supplier: str = "All", pricing_version: str = "All") -> DataFrame:
    """`All` lifts a condition; rows without a version fit every version."""
    if brand != "All":
        df = df.filter(F.col("brand") == brand)
    if supplier != "All":
        df = df.filter(F.col("supplier") == supplier)
    if pricing_version != "All":
        df = df.filter(F.coalesce("pricing_version", F.lit("")).isin("", pricing_version))
    return df


def value_options(df: DataFrame, column: str) -> DataFrame:
    """`All` first, then the sorted distinct values."""
    values = df.select(F.col(column).alias("option")).filter("option <> ''").distinct().withColumn("rank", F.lit(1))
    everything = df.sparkSession.range(1).select(F.lit("All").alias("option"), F.lit(0).alias("rank"))
    return everything.unionByName(values).orderBy("rank", "option").select("option")


# ------------------------------------------------------------------ municipalities
_UF = "struct<sigla:string,nome:string>"
MUNICIPALITY_SCHEMA = (
    "id string, nome string,"
    f"microrregiao struct<mesorregiao:struct<UF:{_UF}>>,"
    f"`regiao-imediata` struct<`regiao-intermediaria`:struct<UF:{_UF}>>"
)


def municipalities(raw: DataFrame) -> DataFrame:
    """Flat rows from nested ones; the state comes from the micro-region, else from the immediate region."""
    uf = F.coalesce(F.col("microrregiao.mesorregiao.UF"), F.col("`regiao-imediata`.`regiao-intermediaria`.UF"))
    flat = raw.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("ibge_code"),
        strip(F.coalesce("nome", F.lit(""))).alias("city"),
        F.upper(strip(F.coalesce(uf["sigla"], F.lit("")))).alias("state_uf"),
        strip(F.coalesce(uf["nome"], F.lit(""))).alias("state_name"))
    return located(flat)


def located(flat: DataFrame) -> DataFrame:
    """Rows with a city and a state, with a search key, sorted by both."""
    key = search_key(F.col("city"))
    if "city_search" in flat.columns:
        key = F.coalesce(found(strip(F.col("city_search"))), key)
    return flat.filter((F.col("city") != "") & (F.col("state_uf") != "")).select(
        *V.LOCATION_COLUMNS[:-1], key.alias("city_search")).orderBy("state_uf", "city_search")


def states(locations: DataFrame) -> DataFrame:
    """One row per state with its first name."""
    return locations.groupBy("state_uf").agg(
        F.min_by("state_name", F.struct("city_search", "state_name")).alias("name")
    ).select(F.col("state_uf").alias("uf"), "name").orderBy("uf")


def cities_of(locations: DataFrame, state_uf: str) -> DataFrame:
    return locations.filter(F.col("state_uf") == str(state_uf).strip().upper())


def search_cities(cities: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Accent-free substring search; `limit` keeps the first by state and city."""
    wanted = search_key(F.lit(str(text)))
    found = cities.filter(F.col("city_search").contains(wanted))
    return found if limit is None else found.orderBy("state_uf", "city_search").limit(limit)
