"""Resumable backfill of the relational tables into order documents, one key range at a time.

The ranges are cut once and stored with the progress. Every range is an ordinary distributed job; its documents count from
the commit that also moves the progress (``sources.tables``), so a failure at any point leaves neither gaps nor copies.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.legacy import nest_orders, not_deleted
from .tables import State, Store

ACTIONS = ("START", "CONTINUE", "STATUS")
_NOT_STARTED = {
    "status": "NOT_STARTED", "last_processed_id": None, "total_processed": 0, "started_at": None, "updated_at": None, "error": None,
}


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


class Backfill:
    def __init__(self, spark: SparkSession, root: str, orders: DataFrame, items: DataFrame, ranges: int = 64):
        self.spark = spark
        self.store = Store(spark, root)
        self.orders, self.items = orders, items
        self.ranges = ranges

    def progress(self) -> dict[str, object]:
        return self.store.state()["notes"].get("progress", _NOT_STARTED)

    def _save(self, folder: str | None = None, **changes: object) -> dict[str, object]:
        """Commit new progress, together with the folder of the documents that it counts."""

        def change(state: State) -> None:
            old = state["notes"].get("progress", _NOT_STARTED)
            if folder is not None and old["last_processed_id"] != seen:
                raise RuntimeError("another run has moved the backfill on")
            state["notes"]["progress"] = {**old, **changes, "updated_at": _now()}
            if folder is not None:
                state["lists"].setdefault("documents", []).append(self.store.relative(folder))

        seen = self.progress()["last_processed_id"]
        return self.store.commit(change)["notes"]["progress"]

    def bounds(self) -> list[str]:
        """Upper ids of the ranges, cut by a range partitioning of the ids and stored on first use: at most ``ranges``."""
        stored = self.store.state()["notes"].get("bounds")
        if stored is None:
            cut = (
                not_deleted(self.orders).select("order_id")
                .repartitionByRange(self.ranges, "order_id")
                .groupBy(F.spark_partition_id().alias("part"))
                .agg(F.max("order_id").alias("upper"))
            )
            found = sorted(row["upper"] for row in cut.collect())
            stored = self.store.commit(lambda state: state["notes"].setdefault("bounds", found))["notes"]["bounds"]
        return stored

    def documents(self) -> DataFrame:
        """The documents of all committed ranges."""
        found = self.store.read_list("documents")
        return nest_orders(self.orders, self.items).limit(0) if found is None else found

    def _copy_range(self, low: str | None, high: str | None, **changes: object) -> tuple[int, dict[str, object]]:
        """Write the documents of one range and commit them; returns their number and the progress."""

        def inside(df: DataFrame) -> DataFrame:
            kept = df if high is None else df.where(F.col("order_id") <= high)
            return kept if low is None else kept.where(F.col("order_id") > low)

        folder = self.store.folder("documents")
        nest_orders(inside(self.orders), inside(self.items)).write.parquet(folder)
        written, newest = self.spark.read.parquet(folder).agg(F.count("*"), F.max("order_id")).first()
        total = self.progress()["total_processed"] + written
        return written, self._save(
            folder, **{"error": None, "last_processed_id": high or newest, "total_processed": total, **changes}
        )

    def run(self, action: str = "CONTINUE", max_ranges: int | None = None) -> dict[str, object]:
        """Process the ranges that are left, or the next ``max_ranges``; then whatever lies above the last range.

        Orders with larger ids that arrive later make a range of their own in the run that finds them; the job is
        completed when there are none. The result has status, processed_in_this_run, total_processed,
        last_processed_id and has_more, which is true until the job is completed.
        """
        if action not in ACTIONS:
            raise ValueError(f"action must be one of {', '.join(ACTIONS)}")
        progress = self.progress()
        if action == "STATUS":
            return self._result(progress, 0)
        if progress["status"] == "NOT_STARTED":
            progress = self._save(status="IN_PROGRESS", started_at=_now())
        processed = 0
        try:
            uppers = self.bounds()
            last = progress["last_processed_id"]
            left = [n for n, upper in enumerate(uppers) if last is None or upper > last]
            todo = left if max_ranges is None else left[:max_ranges]
            for n in todo:
                written, progress = self._copy_range(uppers[n - 1] if n else None, uppers[n], status="IN_PROGRESS")
                processed += written
            if len(todo) == len(left):
                last = progress["last_processed_id"]
                later = not_deleted(self.orders)
                later = later if last is None else later.where(F.col("order_id") > last)
                if later.limit(1).count():
                    written, progress = self._copy_range(last, None, status="COMPLETED")
                    processed += written
                else:
                    progress = self._save(status="COMPLETED", error=None)
            return self._result(progress, processed)
        except Exception as error:
            self._save(status="FAILED", error=str(error)[:1000])
            raise

    @staticmethod
    def _result(progress: dict[str, object], processed: int) -> dict[str, object]:
        return {
            "status": progress["status"],
            "processed_in_this_run": processed,
            "total_processed": progress["total_processed"],
            "last_processed_id": progress["last_processed_id"],
            "has_more": progress["status"] in ("IN_PROGRESS", "FAILED"),
        }
