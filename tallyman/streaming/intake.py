"""Streaming order intake with idempotency across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.intake import accepted, build_orders, idempotent_intake, parse_requests, rejected, validate_requests
from ..sources.tables import BUCKETS, FAN, BucketedTable, Store, is_applied, mark_applied
from .feeds import FEED_INTERVAL, run_of, start

KEYS = ["customer_id", "idempotency_key"]


class Intake:
    """Order requests to order rows under ``root``: the table ``orders``, and ``rejected``, a folder for each run and batch.

    A run is a checkpoint: batch numbers start again with a new one. The orders are bucketed by their idempotency key and
    have Bloom filters, so a batch opens only the folders that may hold one of its keys, whatever the number of
    earlier batches. A batch that has been committed is not taken again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark = spark
        self.root = root.rstrip("/")
        self.store = Store(spark, f"{self.root}/accepted")
        self.table = BucketedTable(self.store, "orders", KEYS, buckets, filters=True, fan=fan)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Keep the first request of every key that no earlier batch has taken."""
        run, state = run_of(batch), self.store.state()
        if is_applied(state, run, batch_id):
            return
        # Several results are taken from the batch: parse it once.
        checked = validate_requests(parse_requests(batch)).drop("document").persist()
        try:
            rejected(checked).write.mode("overwrite").parquet(f"{self.root}/rejected/run={run}/batch_id={batch_id}")
            # A request that is delivered twice in one batch is one request.
            first = idempotent_intake(accepted(checked)).where("created").dropDuplicates(KEYS)
            taken = self.table.lookup(first, state)
            added = self.table.append(build_orders(first.join(taken, KEYS, "left_anti")))
            seen = state["version"]

            def change(newest) -> None:
                if newest["version"] != seen and not self._only_merged(state, newest):
                    raise RuntimeError("another stream has taken orders meanwhile; the batch runs again")
                added(newest)
                mark_applied(newest, run, batch_id)

            self.store.commit(change)
        finally:
            checked.unpersist()
        self.table.merge()

    @staticmethod
    def _only_merged(old, new) -> bool:
        return old["applied"] == new["applied"]

    def start(self, requests: DataFrame, checkpoint: str, interval: str | None = FEED_INTERVAL) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return start(writer, interval)

    def orders(self) -> DataFrame:
        return self.table.read()
