"""Reading page texts, contract tables, catalogs, maps, outputs and run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.functions import fixed_values as V
from wattledger.functions.columns import missing_columns
from wattledger.functions.text import strip
from wattledger.operators import catalog
from wattledger.operators.rows import numbered
from wattledger.sources.staging import materialize

PAGE_SCHEMA = "pdf_source string, page_no int, text string"
_CONTRACT_FORMATS = (".csv", ".tsv", ".parquet")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Page texts: a Parquet table, or text files `<document>/<page>.txt` (or `<document>.<page>.txt`)."""
    if path.rstrip("/").endswith(".parquet"):
        pages = spark.read.parquet(path)
    else:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        full = F.col("_metadata.file_path")
        pages = files.select(
            F.url_decode(F.regexp_extract(full, r"([^/]+?)[./]\d+\.txt$", 1)).alias("pdf_source"),
            F.regexp_extract(full, r"[./](\d+)\.txt$", 1).try_cast("int").alias("page_no"),
            F.col("value").alias("text"))
    return pages.select("pdf_source", F.col("page_no").cast("int").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))


def contract(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, line_breaks: bool = False
) -> DataFrame:
    """A contract or month table; several paths of one format are one scan.

    Without a schema every CSV column is text, so ids keep their zeros. Files are split between tasks; `line_breaks` is
    for CSV with line breaks inside quotes, which takes a task per file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    names = {p.rstrip("/").lower().rpartition(".")[2] for p in paths}
    if names == {"parquet"}:
        return spark.read.parquet(*paths)
    if len(names) != 1 or not names <= {"csv", "tsv"}:
        raise ValueError(f"Unsupported contract format: {', '.join(paths)} (expected one of {', '.join(_CONTRACT_FORMATS)})")
    reader = spark.read.option("header", True).option("sep", "\t" if names == {"tsv"} else ",").option(
        "multiLine", line_breaks).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(paths)


def contract_rows(spark: SparkSession, path: str | list[str], schema: str, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of contract text files: every record is in one of the two.

    A record with values that do not fit `schema` (simple types), or with fields too many or too few, is a reject: its file,
    its text and the columns that could not be read (none where the number of fields is wrong). Files are read once.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    reader = spark.read.option("header", True).option("sep", separator).option("escape", '"').option("mode", "PERMISSIVE")
    typed = reader.option("columnNameOfCorruptRecord", "__record").schema(f"{schema}, __record string").csv(path)
    staged = materialize(typed.select("*", F.col("_metadata.file_path").alias("file")))
    texts = F.from_csv("__record", ", ".join(f"`{n}` string" for n in names), {"sep": separator, "escape": '"'})
    unreadable = F.array_compact(F.array(*[
        F.when((F.trim(F.col(f"texts.`{n}`")) != "") & F.col(f"`{n}`").isNull(), F.lit(n)) for n in names]))
    rejects = staged.filter("__record is not null").withColumn("texts", texts).select("file", F.col("__record").alias("record"), unreadable.alias("unreadable"))
    return staged.filter("__record is null").select(*[F.col(f"`{n}`") for n in names]), rejects


def union_tables(frames: list[DataFrame], categories: list[str] | None = None) -> DataFrame:
    """Union by name, chosen categories, exact duplicate rows once."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.filter(F.col("categoria").isin(categories or ["B3", "A4", "IP"])).dropDuplicates()


def merged_contracts(spark: SparkSession, paths: list[str], categories: list[str] | None = None) -> DataFrame:
    """Tables with the same columns, one scan per format."""
    formats = sorted({p.rstrip("/").lower().rpartition(".")[2] for p in paths})
    return union_tables([contract(spark, [p for p in paths if p.rstrip("/").lower().endswith(f)]) for f in formats], categories)


def _csv_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def modules(spark: SparkSession, path: str) -> DataFrame:
    return catalog.modules(_csv_texts(spark, path))


def inverters(spark: SparkSession, path: str) -> DataFrame:
    return catalog.inverters(_csv_texts(spark, path))


def bos_items(spark: SparkSession, path: str) -> DataFrame:
    return catalog.bos_items(_csv_texts(spark, path))


def pricing_versions(spark: SparkSession, path: str) -> DataFrame:
    return catalog.pricing_versions(_csv_texts(spark, path))


def line_item_map(spark: SparkSession, path: str) -> DataFrame:
    """A line-item map in JSON, flattened to one row per item."""
    from wattledger.operators.scenario import map_items

    return map_items(spark.read.option("multiLine", True).json(path))


def snapshot_documents(spark: SparkSession, path: str) -> DataFrame:
    """scenario, line_no (from 0), line of the written scenario documents, in their order."""
    lines = numbered(spark.read.schema("line string, scenario string").text(path), "at")
    first = lines.groupBy("scenario").agg(F.min("at").alias("first"))
    # One row a scenario is sent out, so that a scenario's lines stay where they were read.
    return lines.join(F.broadcast(first), "scenario").select("scenario", (F.col("at") - F.col("first")).alias("line_no"), "line")


def snapshot_items(documents: DataFrame) -> DataFrame:
    """The line items in the lines of `snapshot_documents`, one row each."""
    item = F.from_json(F.ltrim("line", F.lit(",")), "sheet string, item_code string, description string, enabled boolean, scaling_rule string, "
                       "quantity double, unit_price_sem double, unit_price_com double, subtotal_sem double, subtotal_com double")
    return documents.filter(F.col("line").rlike('^,?\\{"sheet":.*"item_code":')).select("scenario", "line_no", item.alias("i")).select("scenario", "line_no", "i.*")


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """A nested municipality list (JSON), or the flat catalog (CSV)."""
    if path.rstrip("/").endswith(".csv"):
        return catalog.located(_csv_texts(spark, path))
    return catalog.municipalities(spark.read.schema(catalog.MUNICIPALITY_SCHEMA).option("multiLine", True).json(path))


# ------------------------------------------------------------------ files and runs
def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, name) under a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def output_candidates(files: DataFrame) -> DataFrame:
    """Extraction outputs, newest first, CSV before workbooks. `files(path, modified, name)`."""
    name = F.lower("name")
    table = name.rlike(r"master.*\.csv$|filtered_flat.*\.csv$|dimensionamento.*\.csv$")
    book = name.rlike(r"^outputs?\.xlsx$|master.*\.xlsx$|filtered_flat.*\.xlsx$|dimensionamento.*\.xlsx$")
    kind = F.when(table, "csv").when(book, "xlsx")
    return files.withColumn("kind", kind).filter("kind is not null").orderBy("kind", F.desc("modified"), "path")


def preferred_output(files: DataFrame) -> DataFrame:
    return output_candidates(files).limit(1)


def sizing_sources(files: DataFrame, limit: int | None = None, app_words: list[str] | None = None) -> DataFrame:
    """Sizing files and app exports with the municipality their folder names; `limit` keeps the newest.

    `app_words` are the words (patterns, lower case) that an installation's app exports have in their names.
    """
    name = F.lower("name")
    app = "|".join(app_words or V.APP_EXPORT_WORDS)
    wanted = name.rlike(rf"(dimensionamento|{app}).*\.(csv|xlsx)$")
    kind = F.when(name.rlike(app), "streamlit_export").otherwise("dimensionamento")
    found = files.filter(wanted).select(
        "path", F.col("name").alias("filename"), F.regexp_extract("path", r"(?i)/municipios/([^/]+)/", 1).alias("municipio"),
        F.date_format("modified", "yyyy-MM-dd HH:mm").alias("modified_at"),
        F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).alias("ext"), kind.alias("kind"), "modified")
    return found if limit is None else found.orderBy(F.desc("modified"), "path").limit(limit)


def contract_profile(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row: row, UC and month counts, and the columns that are there or missing."""
    required = list(required or V.CONTRACT_COLUMNS)
    reference = next((c for c in ("referencia", "reference_date", "data_referencia") if c in df.columns), None)

    def distinct(name: str | None):
        if name is None or name not in df.columns:
            return F.lit(0).cast("bigint")
        return F.count_distinct(F.nullif(strip(F.col(name).cast("string")), F.lit("")))

    def texts(names: list[str]):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("row_count"), distinct("uc").alias("uc_count"), distinct(reference).alias("months_count")).select(
        F.lit(V.CONTRACT_VERSION).alias("schema_version"), texts(required).alias("required_columns"),
        texts(list(df.columns)).alias("actual_columns"), texts(missing_columns(df, required)).alias("missing_columns"),
        "row_count", "uc_count", "months_count")


def parse_run_ids(runs: DataFrame) -> DataFrame:
    """Municipality and adapter spelled in `date_time_municipality.._adapter`."""
    parts = F.split("run_id", "_")
    whole = F.size(parts) >= 4
    return runs.withColumns({
        "id_municipio": F.when(whole, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "_")).otherwise(""),
        "id_adapter": F.when(whole, F.element_at(parts, -1)).otherwise("")})


def run_history(runs: DataFrame, metadata: DataFrame, limit: int | None = None) -> DataFrame:
    """Status of each run folder.

    `runs(run_id, modified, contract_path)`, `metadata(run_id, meta_path,
    generated_at, adapter, row_count, missing_columns array)`; a run without a
    contract has a null path. What the metadata says wins over what the run id
    spells. `limit` keeps the newest folders.
    """
    meta = metadata.select("run_id", F.lit(True).alias("has_meta"), "meta_path", "generated_at", F.col("adapter").alias("meta_adapter"),
                           "row_count", "missing_columns")
    newest = parse_run_ids(runs)
    if limit is not None:
        newest = newest.orderBy(F.desc("modified"), "run_id").limit(limit)
    rows = newest.join(meta, "run_id", "left")
    has_meta = F.coalesce("has_meta", F.lit(False))
    status = (
        F.when(has_meta, F.when(F.coalesce(F.size("missing_columns"), F.lit(0)) > 0, "schema_warning").otherwise("ok"))
        .when(F.col("contract_path").isNotNull(), "meta_missing").otherwise("missing_contract"))
    return rows.select(
        "run_id", F.coalesce("generated_at", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.col("id_municipio").alias("municipio"),
        F.coalesce(F.nullif("meta_adapter", F.lit("")), "id_adapter").alias("adapter"), status.alias("status"), "row_count",
        F.coalesce("contract_path", F.lit("")).alias("contract_path"), F.coalesce("meta_path", F.lit("")).alias("meta_path"),
    ).orderBy(F.desc("timestamp"), "run_id")


def run_folders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, metadata) of an output root with one folder per run, ready for `run_history`."""
    inside = r"/([^/]+)/contract_master[^/]*(?:/[^/]+)?$"

    def run_of(path) -> Column:
        return F.regexp_extract(path, inside, 1)

    files = list_files(spark, root).withColumn("run_id", run_of(F.col("path"))).filter("run_id <> ''")
    files = files.filter(~F.col("run_id").isin("contract", "logs"))
    runs = files.groupBy("run_id").agg(
        F.max("modified").alias("modified"),
        F.min(F.when(F.col("path").rlike(r"/contract_master(\.csv$|/)"), F.regexp_extract("path", r"^(.*/contract_master(?:\.csv)?)(?:/|$)", 1))).alias("contract_path"))
    schema = "generated_at string, adapter string, row_count bigint, missing_columns array<string>"
    meta = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.json").json(root)
    where = F.regexp_extract("_metadata.file_path", r"^(.*/contract_master[^/]*)", 1)
    meta = meta.withColumns({"meta_path": where, "run_id": run_of(F.col("_metadata.file_path"))}).filter("run_id <> ''")
    return runs, meta
