"""Queries: change feed, events, routing and the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import computed_once, items_text
from ..operators import analytics, changes, events
from ..schemas import EVENT_SOURCE, LAKE_COLUMNS
from ..session import cut_lineage, working_path
from ..sources import feeds, lake, model
from ..streaming.reports import LakeReports
from .registry import query

ALL_OPS = ("INSERT", "MODIFY", "REMOVE")
DAY = ("1998", "03", "15")
REPLAY_START, REPLAY_END = "2001-06-01 00:00:00", "2001-07-31 23:59:59"


@query("cdc_op_filter", ("changes_v",), "SELECT event_id, op, changed_at FROM changes_v WHERE op IN ('INSERT', 'MODIFY')")
def cdc_op_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.with_ops(model.changes(spark, sf_dir)).select("event_id", "op", "changed_at")


@query("cdc_decode_images", ("changes_v",), """
SELECT event_id, op, CASE WHEN has_new THEN order_id END AS new_order_id, new_status, new_payment,
       CASE WHEN has_new THEN CAST(total AS DOUBLE) END AS new_total, new_updated_at,
       CASE WHEN has_new THEN items_text END AS new_items, CASE WHEN has_new THEN zip END AS new_zip,
       CASE WHEN has_new THEN ttl END AS new_ttl, old_status, old_payment,
       CASE WHEN has_old THEN order_id END AS old_order_id
FROM changes_v
""")
def cdc_decode_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The feed travels as text; each text is made once and parsed once.
    feed = feeds.encode_changes(model.changes(spark, sf_dir))
    for image in ("new_image", "old_image"):
        feed = computed_once(feed.withColumnRenamed(image, "_text"), image, F.col("_text")).drop("_text")
    decoded = changes.decode_changes(feed)
    new, old = F.col("new_image"), F.col("old_image")
    return decoded.select(
        "event_id", "op",
        new["order_id"].alias("new_order_id"),
        new["status"].alias("new_status"),
        new["payment_state"].alias("new_payment"),
        new["total"].cast("double").alias("new_total"),
        new["updated_at"].alias("new_updated_at"),
        items_text(new["items"]).alias("new_items"),
        new["shipping_address"]["zip"].alias("new_zip"),
        new["ttl"].alias("new_ttl"),
        old["status"].alias("old_status"),
        old["payment_state"].alias("old_payment"),
        old["order_id"].alias("old_order_id"),
    )


@query("cdc_dedup", ("changes_v",), "SELECT DISTINCT event_id, seq, op, order_id FROM changes_v")
def cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.deduplicated(model.changes(spark, sf_dir).select("event_id", "seq", "op", "order_id"))


@query("cdc_latest_per_key", ("changes_v",), """
SELECT order_id, CAST(seq AS BIGINT) AS seq, op, new_status AS status, changed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn FROM changes_v) WHERE rn = 1
""")
def cdc_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = model.changes(spark, sf_dir).select(
        "order_id", "seq", "op", F.col("new_image.status").alias("status"), "changed_at"
    )
    return changes.latest_per_key(feed)


@query("cdc_old_from_lag", ("changes_v",), """
SELECT order_id, CAST(seq AS BIGINT) AS seq, new_status AS status, lag(new_status) OVER w AS old_status,
       lag(new_payment) OVER w AS old_payment
FROM (SELECT DISTINCT order_id, seq, new_status, new_payment FROM changes_v WHERE has_new)
WINDOW w AS (PARTITION BY order_id ORDER BY seq)
""")
def cdc_old_from_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = model.changes(spark, sf_dir).where(F.col("new_image").isNotNull())
    # Repeated deliveries meet without the parts of the image that nothing reads.
    slim = feed.select(
        "event_id", "order_id", "seq", F.struct("new_image.status", "new_image.payment_state").alias("new_image"),
        F.lit(None).alias("old_image"),
    )
    rebuilt = changes.with_previous_image(changes.deduplicated(slim))
    return rebuilt.select(
        "order_id", "seq", F.col("new_image.status").alias("status"),
        F.col("old_image.status").alias("old_status"), F.col("old_image.payment_state").alias("old_payment"),
    )


@query("events_from_changes", ("events_v",), """
SELECT event_id, event_type, label AS detail_type, changed_at AS time, order_id, customer_id,
       CASE WHEN event_type NOT IN ('PAYMENT_STATE_CHANGED', 'ORDER_DELETED') THEN store_id END AS store_id,
       CASE WHEN event_type NOT IN ('PAYMENT_STATE_CHANGED', 'ORDER_DELETED', 'ORDER_SHIPPED') THEN county_id END AS county_id,
       CASE WHEN event_type = 'ORDER_CREATED' THEN new_status END AS status,
       CASE WHEN event_type = 'ORDER_STATUS_CHANGED' THEN old_status END AS old_status,
       CASE WHEN event_type = 'ORDER_STATUS_CHANGED' THEN new_status END AS new_status,
       CASE WHEN event_type = 'PAYMENT_STATE_CHANGED' THEN old_payment END AS old_state,
       CASE WHEN event_type = 'PAYMENT_STATE_CHANGED' THEN new_payment END AS new_state,
       CASE WHEN event_type NOT IN ('ORDER_SHIPPED', 'ORDER_DELETED') THEN CAST(total AS DOUBLE) END AS total,
       CASE WHEN event_type = 'ORDER_CREATED' THEN item_count END AS item_count,
       CASE WHEN event_type = 'ORDER_CONFIRMED' THEN items_text END AS items,
       CASE WHEN event_type IN ('ORDER_CONFIRMED', 'ORDER_SHIPPED') THEN zip END AS zip
FROM events_v
""")
def events_from_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = changes.derive_events(model.changes(spark, sf_dir), ops=ALL_OPS)
    d = F.col("detail")
    same = ("event_type", "order_id", "customer_id", "store_id", "county_id", "status", "old_status", "new_status",
            "old_state", "new_state", "item_count")
    return derived.select(
        "event_id", "detail_type", "time", *[d[c].alias(c) for c in same],
        d["total"].cast("double").alias("total"),
        items_text(d["items"]).alias("items"),
        d["shipping_address"]["zip"].alias("zip"),
    )


@query("events_routed", ("events_v",), """
SELECT event_id, event_type, rule
FROM events_v JOIN (VALUES ('all-events'), ('order-confirmed'), ('order-cancelled'), ('high-value-order')) AS r(rule)
  ON CASE rule WHEN 'all-events' THEN true
       WHEN 'order-confirmed' THEN event_type = 'ORDER_STATUS_CHANGED' AND new_status = 'CONFIRMED'
       WHEN 'order-cancelled' THEN event_type = 'ORDER_STATUS_CHANGED' AND new_status = 'CANCELLED'
       ELSE event_type = 'ORDER_CREATED' AND total > 500 END
WHERE op IN ('INSERT', 'MODIFY')
""")
def events_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = changes.derive_events(model.changes(spark, sf_dir))
    return events.route(derived).select("event_id", F.col("detail.event_type").alias("event_type"), "rule")


@query("events_replay", ("events_v", "as_of_v"), f"""
SELECT event_id, event_type, changed_at AS time FROM events_v, as_of_v
WHERE op IN ('INSERT', 'MODIFY') AND changed_at BETWEEN TIMESTAMP '{REPLAY_START}' AND TIMESTAMP '{REPLAY_END}'
  AND changed_at >= as_of - INTERVAL 90 DAY
""")
def events_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(t).cast("timestamp") for t in (REPLAY_START, REPLAY_END))
    # Changes follow their order within minutes, so older orders need not be read.
    recent = model.orders(spark, sf_dir, since=start - F.expr("interval 1 day"))
    archive = changes.derive_events(model.changes(spark, sf_dir, recent))
    replayed = events.replay(archive, EVENT_SOURCE, start, end, model.latest_order_time(spark, sf_dir))
    return replayed.select("event_id", F.col("detail.event_type").alias("event_type"), "time")


@query("events_base64_decode", ("records_v",), """
SELECT record_id, coalesce(error_type, 'none') AS error_type,
       CASE WHEN error_type IS NULL AND orderkey % 41 <> 0 THEN order_id END AS order_id
FROM records_v
""")
def events_base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = events.decode_records(model.raw_events(spark, sf_dir))
    order_id = F.when(
        F.col("error_type").isNull(),
        F.coalesce(F.get_json_object("text", "$.detail.order_id"), F.get_json_object("text", "$.order_id")),
    )
    return decoded.select(
        "record_id", F.coalesce("error_type", F.lit("none")).alias("error_type"), order_id.alias("order_id")
    )


def _flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.flatten_events(model.raw_events(spark, sf_dir), model.latest_order_time(spark, sf_dir))


@query("events_flatten", ("lake_v",), f"SELECT record_id, {', '.join(LAKE_COLUMNS)} FROM lake_v")
def events_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flattened = _flattened(spark, sf_dir)
    return flattened.where(F.col("result") == "Ok").select("record_id", *LAKE_COLUMNS)


@query("events_quarantine", ("records_v", "as_of_v"), """
SELECT record_id, error_type, strftime(as_of, '%Y-%m-%d') AS date, error_type = 'bad_base64' AS is_placeholder
FROM records_v, as_of_v WHERE error_type IS NOT NULL
""")
def events_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = events.quarantined(_flattened(spark, sf_dir), model.latest_order_time(spark, sf_dir))
    return failed.select(
        "record_id", "error_type", "date", (F.col("data") == "*not base64*").alias("is_placeholder")
    )


@query("transform_run_counts", ("records_v",), """
SELECT CASE WHEN error_type IS NULL THEN 'Ok' ELSE 'ProcessingFailed' END AS result, count(*) AS records
FROM records_v GROUP BY 1
""")
def transform_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_counts(_flattened(spark, sf_dir))


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.lake_rows(_flattened(spark, sf_dir))
    return events.with_partitions(rows, model.latest_order_time(spark, sf_dir))


@query("lake_events_by_type", ("lake_v",), """
SELECT strftime(filed_at, '%Y') AS year, strftime(filed_at, '%m') AS month, strftime(filed_at, '%d') AS day,
       event_type, count(*) AS events FROM lake_v GROUP BY ALL
""")
def lake_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lake_events_by_type(_filed(spark, sf_dir))


@query("lake_current_status", ("lake_v",), """
SELECT order_id, status, event_timestamp AS status_since FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY event_timestamp DESC, status DESC) AS rn
  FROM lake_v WHERE status IS NOT NULL AND order_id <> '') WHERE rn = 1
""")
def lake_current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lake_current_status(events.lake_rows(_flattened(spark, sf_dir)))


@query("lake_status_incremental", ("lake_v",), """
SELECT order_id, status, event_timestamp AS status_since FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY event_timestamp DESC, status DESC) AS rn
  FROM lake_v WHERE status IS NOT NULL AND order_id <> '') WHERE rn = 1
""")
def lake_status_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lake in two batches, the later years first."""
    rows = cut_lineage(_filed(spark, sf_dir).select("year", "month", "day", "event_type", "order_id", "status", "event_timestamp"))
    reports = LakeReports(spark, working_path(spark, "lake-reports"), buckets=8)
    for number, batch in enumerate((rows.where("year >= '1995'"), rows.where("year < '1995'"))):
        reports.write_batch(batch, number)
    return reports.current_status()


_lakes: dict[tuple[str, str], str] = {}


def _written_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake of the given tables, written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        path = working_path(spark, "lake")
        lake.write_lake(_filed(spark, sf_dir), path)
        _lakes[key] = path
    return lake.read_lake(spark, _lakes[key])


def _json_line() -> str:
    """A lake row as it is written, in DuckDB: members in the order of the columns, nulls left out."""
    numbers = ("subtotal", "tax", "total", "item_count")
    value = lambda c: f"CAST({c} AS VARCHAR)" if c in numbers else f"""'"' || {c} || '"'"""
    members = " || ".join(f"""coalesce(',"{c}":' || {value(c)}, '')""" for c in LAKE_COLUMNS)
    return f"'{{' || substr({members}, 2) || '}}'"


@query("lake_write", ("lake_v",), f"""
SELECT {", ".join(c for c in LAKE_COLUMNS if not c.endswith(("_timestamp", "_at")))},
       TRY_CAST(event_timestamp AS TIMESTAMP) AS event_timestamp, TRY_CAST(created_at AS TIMESTAMP) AS created_at,
       CASE WHEN event_timestamp = 'not-a-time' THEN {_json_line()} END AS _malformed,
       strftime(filed_at, '%Y') AS year, strftime(filed_at, '%m') AS month, strftime(filed_at, '%d') AS day
FROM lake_v
""")
def lake_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_lake(spark, sf_dir)


@query("lake_scan_day", ("lake_v",), f"""
SELECT event_type, order_id, store_id, status, payment_state, total, item_count,
       CAST(event_timestamp AS TIMESTAMP) AS event_timestamp, '{DAY[1]}' AS month
FROM lake_v WHERE filed_at >= TIMESTAMP '{"-".join(DAY)}' AND filed_at < TIMESTAMP '{"-".join(DAY)}' + INTERVAL 1 DAY
""")
def lake_scan_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month, day = DAY
    table = _written_lake(spark, sf_dir)
    chosen = table.where((F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day))
    return chosen.select(
        "event_type", "order_id", "store_id", "status", "payment_state", "total", "item_count", "event_timestamp", "month"
    )


@query("dead_letter_split", ("heads_v", "as_of_v"), """
SELECT CASE WHEN orderkey % 30 = 0 THEN 'ORD-X' || lpad(CAST(orderkey AS VARCHAR), 25, '0') ELSE order_id END AS order_id,
       CAST(orderkey % 5 AS INTEGER) AS attempt,
       CASE WHEN CAST(orderkey % 5 AS INTEGER) < 3 THEN 'retry'
            WHEN order_ts < as_of - INTERVAL 14 DAY THEN 'expired' ELSE 'dead_letter' END AS destination
FROM heads_v, as_of_v
""")
def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = events.split_failed(model.messages(spark, sf_dir), model.latest_order_time(spark, sf_dir))
    return split.select("order_id", "attempt", "destination")
