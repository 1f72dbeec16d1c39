"""Numbers for rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattledger.sources.staging import materialize

_ID, _FILE, _OFFSET, _TASK = "__row_id", "__row_file", "__row_offset", "__row_task"
_TASK_BITS = 33


def _placed(df: DataFrame) -> DataFrame:
    """Rows with an id that counts up within a task, and the part of a file they come from ('' where no file is known)."""
    own = F.monotonically_increasing_id()
    try:
        return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_OFFSET), own.alias(_ID))
    except AnalysisException:
        return df.select("*", F.lit("").alias(_FILE), F.lit(0).cast("long").alias(_OFFSET), own.alias(_ID))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the position of each row, 0 to n - 1.

    Rows of a file scan are numbered as the files hold them, by path and place in the file, however they are dealt to
    tasks; rows that moved since (by a join, a sort or a shuffle) by task and place in the task. The rows are written once
    with their places, and both the counts and the numbers come from what was written, so no later plan can count them
    otherwise. The running sum is over one row per file part or task. An empty frame stays empty.
    """
    rows = materialize(_placed(df)).withColumn(_TASK, F.shiftright(_ID, _TASK_BITS))

    def sizes(part: list[str]) -> DataFrame:
        return rows.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"), F.min(_ID).alias("__first"), F.max(_ID).alias("__last"))

    # A part whose ids have gaps was mixed with others on the way; then only the tasks have an order.
    moved = sizes([_FILE, _OFFSET]).filter("__last - __first + 1 <> __n or __row_file = ''")
    part = [_TASK] if moved.limit(1).count() else [_FILE, _OFFSET]
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes(part).select(*part, (before - F.col("__first")).alias("__shift"))
    # As small as the running sum's input, so it is sent out and the rows stay where they were read.
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(_ID) + F.col("__shift")).drop(_FILE, _OFFSET, _TASK, _ID, "__shift")
