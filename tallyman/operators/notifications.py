"""Customer notifications about order status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import iso_millis
from ..functions.text import filled

# ---- fixed values: message and next step per status ----
MESSAGES = {
    "CONFIRMED": ("Your order has been confirmed!", "Your order is being prepared for shipment."),
    "FAILED": (
        "Unfortunately, your order could not be processed.",
        "Please try placing your order again or contact support.",
    ),
    "CANCELLED": (
        "Your order has been cancelled.",
        "If you did not request this cancellation, please contact support.",
    ),
    "SHIPPED": ("Your order has been shipped!", "Track your package using the tracking number in your email."),
    "DELIVERED": (
        "Your order has been delivered!",
        "We hope you enjoy your purchase. Please leave a review!",
    ),
}
UNKNOWN_REASON = "Unknown error"


def _by_status(status: Column, position: int, otherwise: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for name, pair in MESSAGES.items() for x in (name, pair[position])])
    return F.coalesce(F.try_element_at(texts, status), otherwise)


def build_notifications(events: DataFrame, as_of: Column) -> DataFrame:
    """One notification per row of ``order_id, customer_id, status, total, reason``."""
    status = F.col("status")
    kind = F.concat(F.lit("ORDER_"), status)
    no_text = F.lit(None).cast("string")
    details = F.struct(
        _by_status(status, 0, F.concat(F.lit("Order status updated to "), status)).alias("message"),
        F.when(status == "CONFIRMED", F.col("total")).alias("total"),
        F.when(status == "FAILED", F.coalesce(filled(F.col("reason")), F.lit(UNKNOWN_REASON))).alias("reason"),
        _by_status(status, 1, no_text).alias("next_step"),
    )
    return events.select(
        kind.alias("type"),
        F.concat(F.lit("Order "), F.col("order_id"), F.lit(" - "), status).alias("subject"),
        "order_id",
        "customer_id",
        "status",
        iso_millis(as_of).alias("timestamp"),
        details.alias("details"),
    )


def notification_messages(notifications: DataFrame) -> DataFrame:
    """The form handed to a transport: subject, JSON body and attributes."""
    body = F.to_json(F.struct("type", "order_id", "customer_id", "status", "timestamp", "details"))
    return notifications.select(
        "subject",
        body.alias("message"),
        "order_id",
        "customer_id",
        "status",
        F.col("type").alias("event_type"),
    )
