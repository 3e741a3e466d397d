"""Event routing, envelopes, flattening into lake rows, quarantine and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import iso_millis
from ..functions.text import computed_once, filled, first_filled, lake_time
from ..schemas import (
    ARCHIVE_DAYS,
    DEAD_LETTER_DAYS,
    EVENT_SOURCE,
    HIGH_VALUE_ABOVE,
    LAKE_COLUMNS,
    MAX_ATTEMPTS,
    RAW_EVENT,
)


def routing_rules(source: str = EVENT_SOURCE, high_value: int = HIGH_VALUE_ABOVE) -> dict[str, Column]:
    """Rule name and condition over ``source``, ``detail_type`` and ``detail``."""
    ours = F.col("source") == source
    changed = ours & (F.col("detail_type") == "Order Status Changed")
    return {
        "all-events": ours,
        "order-confirmed": changed & (F.col("detail.new_status") == "CONFIRMED"),
        "order-cancelled": changed & (F.col("detail.new_status") == "CANCELLED"),
        "high-value-order": ours & (F.col("detail_type") == "Order Created") & (F.col("detail.total") > high_value),
    }


def route(events: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """One row per event and rule it matches (column ``rule``)."""
    rules = routing_rules() if rules is None else rules
    matched = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return events.select("*", F.explode(matched).alias("rule"))


def envelope(events: DataFrame, forwarded_at: Column | None = None) -> Column:
    """JSON envelope of an event, optionally stamped by the forwarder."""
    fields = [
        F.col("source"),
        F.col("detail_type").alias("detail-type"),
        iso_millis(F.col("time")).alias("time"),
        F.col("detail"),
    ]
    if forwarded_at is not None:
        fields.append(iso_millis(forwarded_at).alias("forwarded_at"))
    return F.to_json(F.struct(*fields))


def forward(events: DataFrame, forwarded_at: Column | None = None) -> DataFrame:
    """Events as base64 records for the lake transform: ``record_id`` and ``data``."""
    stamp = F.current_timestamp() if forwarded_at is None else forwarded_at
    return events.select(
        F.concat_ws(":", "event_id", "detail.event_type").alias("record_id"),
        F.base64(F.encode(envelope(events, stamp), "UTF-8")).alias("data"),
    )


def decode_records(records: DataFrame) -> DataFrame:
    """Add ``text`` (null when ``data`` is not base64) and ``error_type`` (null for a usable record)."""
    decoded = computed_once(records, "text", F.decode(F.try_to_binary("data", F.lit("base64")), "UTF-8"))
    value = F.col("_value")
    return computed_once(
        computed_once(decoded, "_value", F.try_parse_json("text")),
        "error_type",
        F.when(F.col("text").isNull(), "bad_base64")
        .when(value.isNull(), "bad_json")
        .when(F.is_variant_null(value), "no_event"),
    ).drop("_value")


def flatten_events(records: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lake rows of base64 records: the lake columns plus ``record_id``, ``result``, ``error_type``, ``data``.

    Failed records keep their data and have no lake values. Times stay text here, in the lake's format. Columns in
    ``keep`` go along unchanged.
    """
    decoded = decode_records(records)
    parsed = computed_once(decoded, "e", F.from_json("text", RAW_EVENT, {"allowNonNumericNumbers": "false"}))
    event, inner = F.col("e"), F.col("e.detail")

    def field(name: str) -> Column:
        # A present detail is used alone; it does not fall back to the top level field by field.
        return F.when(inner.isNotNull(), inner[name]).otherwise(event[name])

    # Each field is found once and then read as a column: copies of it in every rule that uses it make a method too long for
    # the compiler.
    names = ("event_type", "order_id", "customer_id", "store_id", "county_id", "status", "new_status", "payment_state",
             "new_state", "subtotal", "tax", "total", "item_count", "items", "created_at", "timestamp")
    found = parsed.select(
        "record_id", "error_type", "data", *keep, event["time"].alias("_sent"), event["detail-type"].alias("_label"),
        *[field(name).alias(f"_{name}") for name in names],
    )
    f = {name: F.col(f"_{name}") for name in names}
    timed = found.withColumn("_moment", F.coalesce(filled(F.col("_sent")), filled(f["timestamp"]), iso_millis(now)))
    values = {
        "event_type": F.coalesce(filled(f["event_type"]), filled(F.col("_label")), F.lit("UNKNOWN")),
        "order_id": F.coalesce(f["order_id"], F.lit("")),
        "customer_id": F.coalesce(f["customer_id"], F.lit("")),
        "store_id": filled(f["store_id"]),
        "county_id": filled(f["county_id"]),
        "status": first_filled(f["status"], f["new_status"]),
        "payment_state": first_filled(f["payment_state"], f["new_state"]),
        "subtotal": f["subtotal"],
        "tax": f["tax"],
        "total": f["total"],
        "item_count": F.coalesce(f["item_count"].cast("int"), F.when(f["items"].isNotNull(), F.size(f["items"]))),
        "event_timestamp": lake_time(F.col("_moment")),
        "created_at": F.when(filled(f["created_at"]).isNotNull(), lake_time(f["created_at"])),
    }
    usable = F.col("error_type").isNull()
    return timed.select(
        "record_id",
        F.when(usable, "Ok").otherwise("ProcessingFailed").alias("result"),
        "error_type",
        "data",
        *keep,
        *[F.when(usable, values[name]).alias(name) for name in LAKE_COLUMNS],
    )


def lake_rows(flattened: DataFrame) -> DataFrame:
    return flattened.where(F.col("result") == "Ok").select(*LAKE_COLUMNS)


def quarantined(flattened: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Failed records with their original data, by error type and date."""
    return flattened.where(F.col("result") != "Ok").select(
        "record_id", "data", "error_type", F.date_format(now, "yyyy-MM-dd").alias("date"), *keep
    )


def run_counts(flattened: DataFrame) -> DataFrame:
    return flattened.groupBy("result").agg(F.count(F.lit(1)).alias("records"))


def with_partitions(rows: DataFrame, now: Column, by: str = "event_time") -> DataFrame:
    """Add the text partitions year, month and day of the event time, or of ``now``.

    Rows whose event time cannot be read are filed under ``now``.
    """
    if by not in ("event_time", "ingest_time"):
        raise ValueError("by must be event_time or ingest_time")
    moment = F.coalesce(F.try_to_timestamp("event_timestamp"), now) if by == "event_time" else now
    return rows.withColumns(
        {
            "year": F.date_format(moment, "yyyy"),
            "month": F.date_format(moment, "MM"),
            "day": F.date_format(moment, "dd"),
        }
    )


def replay(
    events: DataFrame, source: str, start: Column, end: Column, as_of: Column, days: int = ARCHIVE_DAYS
) -> DataFrame:
    """Archived events of one source in a time range, as far as the archive still keeps them."""
    kept = F.col("time") >= as_of - F.expr(f"interval {days} days")
    return events.where((F.col("source") == source) & F.col("time").between(start, end) & kept)


def split_failed(failed: DataFrame, as_of: Column, attempts: int = MAX_ATTEMPTS, days: int = DEAD_LETTER_DAYS) -> DataFrame:
    """Add ``destination``: retry below the attempt limit, else dead_letter, or expired after ``days``."""
    old = F.col("timestamp") < as_of - F.expr(f"interval {days} days")
    return failed.withColumn(
        "destination",
        F.when(F.col("attempt") < attempts, "retry").when(old, "expired").otherwise("dead_letter"),
    )
