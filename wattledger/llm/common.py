"""What several corpus operators share: the shared folder, held-out rows, Arrow batches in bounded slices."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that become Python objects at once.
SLICE_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; only a local[..] session, one process, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and go on from there: lineage ends, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as `--py-files` does."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="corpus-"), "package"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that a join may broadcast, at most.
BROADCAST_IDS = 2_000_000


def matched(df: DataFrame, ids: DataFrame, name: str, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of `df` whose id is (or, with left_anti, is not) in the written one-column table `ids`.

    A list of bounded size is broadcast, so that `df` does not move; a longer one takes a join that Spark plans.
    """
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, name, how).select(*[F.col(f"`{c}`") for c in df.columns])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Every `folds`-th document by the checksum of its id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are; pure ASCII takes the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(prefix: str, taken: list[str]) -> str:
    """A column name that clashes with none of `taken`, however Spark compares names."""
    lower, name = {c.lower() for c in taken}, prefix
    while name.lower() in lower:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
