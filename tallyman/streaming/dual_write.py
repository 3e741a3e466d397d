"""Dual write: a change feed applied to the relational tables, micro-batch by micro-batch.

A micro-batch only adds its records to a change log, so its cost follows the batch and not the table. The current state
is the tables with the log applied; ``compact`` folds the log into the buckets of the tables that it touches. Orders
carry ``last_seq``, so records older than what the tables hold are ignored later.

Tables, log and the batches taken are one manifest (``sources.tables``): a batch counts when its commit does, and a batch
that runs again after its commit is not taken again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.legacy import upsert_items, upsert_orders
from ..sources.tables import BUCKETS, BucketedTable, State, Store, is_applied, mark_applied
from .feeds import FEED_INTERVAL, run_of, start


class DualWrite:
    """The two flat tables under ``root``, bucketed by order, and the log of later batches."""

    def __init__(self, spark: SparkSession, root: str, enabled: Callable[[], bool] = lambda: True, buckets: int = BUCKETS):
        self.spark = spark
        self.store = Store(spark, root)
        self.orders = BucketedTable(self.store, "orders", ["order_id"], buckets)
        self.items = BucketedTable(self.store, "items", ["order_id"], buckets)
        self.enabled = enabled

    def _flag(self) -> bool:
        """The feature flag; one that cannot be read counts as off."""
        try:
            return bool(self.enabled())
        except Exception:
            return False

    def version(self) -> int:
        """How often the log has been folded into the tables."""
        return self.store.state()["notes"].get("folds", 0)

    def initialize(self, orders: DataFrame, items: DataFrame) -> None:
        """Start from these tables; what was there before goes."""
        everything = list(range(self.orders.buckets))
        changes = [
            self.orders.rewrite(everything, orders.withColumn("last_seq", F.lit(None).cast("bigint"))),
            self.items.rewrite(everything, items),
        ]

        def change(state: State) -> None:
            for each in changes:
                each(state)
            state["lists"].pop("log", None)
            state["notes"]["folds"] = 0

        self.store.commit(change)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Log one micro-batch. Skipped while the flag is off, and if the batch has been committed."""
        run = run_of(batch)
        if not self._flag() or is_applied(self.store.state(), run, batch_id):
            return
        folder = self.store.folder("log")
        batch.write.parquet(folder)

        def change(state: State) -> None:
            state["lists"].setdefault("log", []).append(self.store.relative(folder))
            mark_applied(state, run, batch_id)

        self.store.commit(change)

    def start(self, changes: DataFrame, checkpoint: str, interval: str | None = FEED_INTERVAL) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return start(writer, interval)

    @staticmethod
    def _applied(orders: DataFrame, items: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = orders.select("order_id", "last_seq")
        fresh = log.join(known, "order_id", "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(-1)))
        newest = fresh.groupBy("order_id").agg(F.max("seq").alias("_seq"))
        merged = (
            upsert_orders(orders, fresh.drop("last_seq"))
            .join(known, "order_id", "left")
            .join(newest, "order_id", "left")
            .withColumn("last_seq", F.greatest("last_seq", "_seq"))
            .drop("_seq")
        )
        return merged, upsert_items(items, fresh.drop("last_seq"))

    def state(self) -> tuple[DataFrame, DataFrame]:
        """Current orders (with ``last_seq``) and items."""
        state = self.store.state()
        orders, items = self.orders.read(state=state), self.items.read(state=state)
        log = self.store.read_list("log", state)
        return (orders, items) if log is None else self._applied(orders, items, log)

    def compact(self) -> int:
        """Fold the log into the buckets it touches; returns :meth:`version`. Batches may be logged meanwhile."""
        state = self.store.state()
        log = self.store.read_list("log", state)
        if log is None:
            return self.version()
        folded = state["lists"]["log"]
        buckets = self.orders.touched(log)
        orders, items = self._applied(self.orders.read(buckets, state), self.items.read(buckets, state), log)
        changes = [self.orders.rewrite(buckets, orders, state), self.items.rewrite(buckets, items, state)]

        def change(newest: State) -> None:
            if newest["lists"].get("log", [])[: len(folded)] != folded:
                raise RuntimeError("the log has been folded by another run")
            for each in changes:
                each(newest)
            newest["lists"]["log"] = newest["lists"]["log"][len(folded) :]
            newest["notes"]["folds"] = newest["notes"].get("folds", 0) + 1

        return self.store.commit(change)["notes"]["folds"]
