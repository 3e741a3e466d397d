"""Streaming delivery into the event lake, with quarantine, retry and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import flatten_events, lake_rows, quarantined, split_failed, with_partitions
from ..sources.lake import PARTITIONS, ROWS_PER_FILE, read_lake, write_lake
from .feeds import LAKE_INTERVAL, run_of, start, with_attempt

RECORD = "record_id string, data string"


def stream_records(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files).json(path)


def deliver(
    records: DataFrame, path: str, checkpoint: str, now: Column | None = None, interval: str | None = LAKE_INTERVAL
) -> StreamingQuery:
    """Append usable records to the lake. Bad records are skipped here; ``quarantine`` keeps them."""
    stamp = F.current_timestamp() if now is None else now
    rows = with_partitions(lake_rows(flatten_events(records, stamp)), stamp)
    writer = (
        rows.writeStream.format("json").partitionBy(*PARTITIONS).option("path", path)
        .option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("checkpointLocation", checkpoint)
    )
    return start(writer, interval)


def quarantine(
    records: DataFrame, path: str, checkpoint: str, now: Column | None = None, interval: str | None = LAKE_INTERVAL
) -> StreamingQuery:
    """Keep failed records of every batch, with their first attempt counted."""
    stamp = F.current_timestamp() if now is None else now

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that runs again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{path}/run={run_of(batch)}/batch_id={batch_id}")

    failed = quarantined(flatten_events(records, stamp), stamp).withColumn("timestamp", stamp)
    attempted = with_attempt(failed.withColumn("attempt", F.lit(0)))
    return start(attempted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), interval)


class Delivery:
    """Both sinks from one pass: usable records go to the lake, failed ones to quarantine, under ``root``.

    A micro-batch is decoded and parsed once. Both results go to folders of its run and batch, which a batch that runs again
    replaces, so a failure between the two sinks is repaired by the retry.
    """

    def __init__(self, spark: SparkSession, root: str, now: Column | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.now = F.current_timestamp() if now is None else now

    def _folder(self, sink: str, batch: DataFrame, batch_id: int) -> str:
        return f"{self.root}/{sink}/run={run_of(batch)}/batch_id={batch_id}"

    def _quarantine(self, failed: DataFrame, path: str) -> None:
        failed.write.mode("overwrite").parquet(path)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        flattened = flatten_events(batch, self.now).persist()
        try:
            rows = with_partitions(lake_rows(flattened), self.now)
            write_lake(rows, self._folder("lake", batch, batch_id), mode="overwrite")
            failed = quarantined(flattened, self.now).withColumn("timestamp", self.now)
            attempted = with_attempt(failed.withColumn("attempt", F.lit(0)))
            self._quarantine(attempted, self._folder("quarantine", batch, batch_id))
        finally:
            flattened.unpersist()

    def start(self, records: DataFrame, checkpoint: str, interval: str | None = LAKE_INTERVAL) -> StreamingQuery:
        writer = records.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return start(writer, interval)

    def lake(self) -> DataFrame:
        return read_lake(self.spark, f"{self.root}/lake").drop("run", "batch_id")

    def failed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/quarantine").drop("run", "batch_id")


def redrive(
    failed: DataFrame, repair: Callable[[DataFrame], DataFrame], as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Try failed records again after ``repair``.

    Returns the lake rows that now succeed, the records that failed once more with their attempt counted,
    and the dead letters: records that have used up their attempts.
    """
    split = split_failed(failed, as_of)
    again = repair(split.where(F.col("destination") == "retry").drop("destination"))
    flattened = flatten_events(again.select("record_id", "data", "attempt"), as_of, keep=("attempt",))
    still = quarantined(flattened, as_of, keep=("attempt",)).withColumn("timestamp", as_of)
    dead = split.where(F.col("destination") == "dead_letter").drop("destination")
    return lake_rows(flattened), with_attempt(still), dead
