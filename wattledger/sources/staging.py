"""Keeping an intermediate table between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. There is no machine-local stand-in: executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    return folder


# Texts that cost much to parse lie in small row groups, and small splits of them go to the tasks.
_GROUP_BYTES, _SPLIT_BYTES, _OPEN_BYTES = 1 << 20, 4 << 20, 1 << 18


def materialize(df: DataFrame, fine: bool = False) -> DataFrame:
    """Write a table once to the shared folder and go on from there.

    Lineage is cut, lost executors cost nothing, and, unlike a cached or
    checkpointed frame, the written table is read back with column pruning.
    With `fine` its files can be cut anywhere: a task takes whole row groups, and
    packed text in one of the usual size is many minutes of parsing.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", _GROUP_BYTES) if fine else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def finely_split(spark: SparkSession) -> Iterator[None]:
    """Files are read in small splits by jobs that run inside, so that no task gets much more to parse than the others."""
    names = {"spark.sql.files.maxPartitionBytes": _SPLIT_BYTES, "spark.sql.files.openCostInBytes": _OPEN_BYTES}
    before = {n: spark.conf.get(n) for n in names}
    for n, most in names.items():
        spark.conf.set(n, str(min(most, _bytes(spark, before[n]))))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _bytes(spark: SparkSession, size: str) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)
