"""The fulfilment workflow: which messages to work on, and how their orders end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INVENTORY_FAILED, PAYMENT_FAILED
from .inventory import add_reservations, reservations, reserve_in_order
from .mutations import Mutation, set_status


def classify_messages(messages: DataFrame, orders: DataFrame) -> DataFrame:
    """Add ``outcome``: eligible, not_found, or already_processed, and the order's status.

    An order without a status exists and is not PENDING.
    """
    current = orders.select("order_id", F.col("status").alias("current_status"), F.lit(True).alias("_present"))
    return messages.join(current, "order_id", "left").withColumn(
        "outcome",
        F.when(F.col("_present").isNull(), "not_found")
        .when(F.col("current_status") == "PENDING", "eligible")
        .otherwise("already_processed"),
    ).drop("_present")


def eligible_orders(messages: DataFrame, orders: DataFrame) -> DataFrame:
    """The PENDING orders that have a message."""
    classified = classify_messages(messages.select("order_id").distinct(), orders)
    return classified.where(F.col("outcome") == "eligible").select("order_id")


def settle_orders(
    orders: DataFrame, messages: DataFrame, reservations: DataFrame, payments: DataFrame, as_of: Column
) -> Mutation:
    """Confirm or fail the PENDING orders that have a message.

    ``reservations`` has ``order_id`` and ``reserved``; ``payments`` has ``order_id`` and ``payment_result``.
    Stock is asked first, so a shortage is reported before a declined payment. The outcome carries what a
    notification needs.
    """
    eligible = eligible_orders(messages, orders)
    reserved = F.coalesce("reserved", F.lit(False))
    paid = F.coalesce(F.col("payment_result") == "CAPTURED", F.lit(False))
    decided = (
        eligible.join(reservations.select("order_id", "reserved"), "order_id", "left")
        .join(payments.select("order_id", "payment_result"), "order_id", "left")
        .select(
            "order_id",
            F.when(reserved & paid, "CONFIRMED").otherwise("FAILED").alias("new_status"),
            F.when(~reserved, F.lit(INVENTORY_FAILED)).when(~paid, F.lit(PAYMENT_FAILED)).alias("reason"),
        )
    )
    updates = decided.select(
        "order_id", F.lit("PENDING").alias("expected_status"), "new_status", as_of.alias("requested_at")
    )
    outcome = decided.join(orders.select("order_id", "customer_id", "total"), "order_id").select(
        "order_id",
        "customer_id",
        F.col("new_status").alias("status"),
        F.when(F.col("new_status") == "CONFIRMED", F.col("total")).alias("total"),
        "reason",
    )
    return Mutation(set_status(orders, updates), outcome)


class Fulfilment(NamedTuple):
    """What a run of the workflow leaves behind."""

    orders: DataFrame  # with their new status
    outcome: DataFrame  # one row for each order that was worked on
    held: DataFrame  # reservations that stay
    stock: DataFrame  # with what is held


def fulfil_orders(
    orders: DataFrame, messages: DataFrame, lines: DataFrame, inventory: DataFrame, payments: DataFrame, as_of: Column
) -> Fulfilment:
    """Reserve, pay, settle and release, order by order in the order of their time and id.

    ``lines`` has ``order_id``, ``order_ts``, ``store_sku`` and ``quantity``; ``payments`` as in :func:`settle_orders`. Orders
    compete for stock as they come. One whose payment fails gives its stock back before the next is tried.
    """
    paid = payments.where(F.col("payment_result") == "CAPTURED").select("order_id", F.lit(True).alias("keeps"))
    eligible = eligible_orders(messages, orders).join(paid, "order_id", "left")
    asked = lines.join(eligible, "order_id").withColumn("keeps", F.coalesce("keeps", F.lit(False)))
    verdicts = reserve_in_order(asked, inventory)
    settled = settle_orders(orders, messages, verdicts, payments, as_of)
    held = reservations(asked.where("keeps").drop("keeps"), verdicts, as_of)
    return Fulfilment(settled.table, settled.outcome, held, add_reservations(inventory, held))
