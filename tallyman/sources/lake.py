"""The event lake: gzip JSON lines in year, month and day folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import LAKE_TIME
from ..schemas import LAKE

PARTITIONS = ("year", "month", "day")
ROWS_PER_FILE = 5_000_000
# Shuffle buckets of a delivery, more than there are days in a usual one: what the planner splits then holds about one day.
DAY_BUCKETS = 4096


def write_lake(rows: DataFrame, path: str, mode: str = "append", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write rows that carry year, month and day.

    The rebalance hint brings the rows of a day together, so that a day gets few files, and lets the
    adaptive planner split a day that is much larger than the others over several tasks. Small buckets are put together
    into one task; a bucket of many days that is split would write a file for each of its days from every task.
    """
    (
        rows.hint("rebalance", DAY_BUCKETS, *PARTITIONS)
        .write.mode(mode)
        .partitionBy(*PARTITIONS)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", rows_per_file)
        .json(path)
    )


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """Read the lake with its fixed schema; unreadable lines land in ``_malformed``."""
    return (
        spark.read.schema(LAKE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_malformed")
        .option("timestampFormat", LAKE_TIME)
        .json(path)
    )


def write_quarantine(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Failed records under their error type and date."""
    rows.write.mode(mode).partitionBy("error_type", "date").option("compression", "gzip").json(path)
