"""Streams from the change feed: events to the archive, routes, and rate alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import derive_events
from ..operators.events import route
from ..operators.rates import rate_violations
from ..schemas import FEED_OPS, RATE_LIMIT

DEDUP_DELAY = "10 minutes"
FEED_INTERVAL = "5 seconds"
LAKE_INTERVAL = "60 seconds"


def start(writer, interval: str | None) -> StreamingQuery:
    """Start on a fixed interval, or drain what is there and stop when the interval is None."""
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def run_of(batch: DataFrame) -> str:
    """The id of the stream a micro-batch belongs to, which its checkpoint keeps; ``none`` outside of a stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def deduplicated(changes: DataFrame, delay: str = DEDUP_DELAY) -> DataFrame:
    """Drop repeated deliveries that arrive within ``delay`` of each other."""
    return changes.withWatermark("changed_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def archive_events(
    changes: DataFrame, path: str, checkpoint: str, ops: tuple[str, ...] = FEED_OPS, interval: str | None = FEED_INTERVAL
) -> StreamingQuery:
    """Derive domain events and append them to the archive. The file sink writes each batch exactly once."""
    events = derive_events(changes, ops)
    return start(
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint), interval
    )


def route_events(
    events: DataFrame, path: str, checkpoint: str, interval: str | None = FEED_INTERVAL
) -> StreamingQuery:
    """Append every event to the folder of each rule it matches."""
    routed = route(events)
    return start(
        routed.writeStream.format("json").partitionBy("rule").option("path", path)
        .option("checkpointLocation", checkpoint),
        interval,
    )


def rate_alarms(hits: DataFrame, limit: int = RATE_LIMIT, lateness: str = "1 minute") -> DataFrame:
    """The rate rule on a stream of hits (``ts``, ``key``); closed windows only in append mode."""
    return rate_violations(hits.withWatermark("ts", lateness), limit)


def with_attempt(failed: DataFrame) -> DataFrame:
    """Count one more try of failed records."""
    return failed.withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1)
