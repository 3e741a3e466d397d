"""Order access patterns: by key, by attribute, newest first, page by page."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HISTORY_LIMIT, LISTING_LIMIT, MAX_HISTORY_LIMIT, ORDER_BY_ID_COLUMNS


def check_limit(limit: int | str | None, default: int = HISTORY_LIMIT, maximum: int = MAX_HISTORY_LIMIT) -> int:
    """Page size argument: absent gives the default; outside 1..maximum or not a whole number raises."""
    if limit is None or limit == "":
        return default
    try:
        value = int(limit)
    except (TypeError, ValueError):
        raise ValueError(f"limit must be a whole number between 1 and {maximum}, got {limit!r}") from None
    if isinstance(limit, float) and limit != value or not 1 <= value <= maximum:
        raise ValueError(f"limit must be between 1 and {maximum}, got {limit!r}")
    return value


def list_arguments(params: dict[str, str | None] | None) -> dict[str, object]:
    """Arguments of a history listing from query parameters, with defaults for what is absent."""
    params = params or {}
    if not params.get("customer_id"):
        raise ValueError("customer_id is required")
    return {
        "customer_id": params["customer_id"],
        "limit": check_limit(params.get("limit")),
        "token": params.get("next_token"),
    }


def get_by_keys(orders: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per wanted key with a ``found`` flag; order columns are null when not found."""
    keys = list(keys)
    marked = orders.withColumn("_present", F.lit(True))
    return (
        wanted.select(*keys).distinct().join(marked, keys, "left")
        .withColumn("found", F.col("_present").isNotNull())
        .drop("_present")
    )


def get_by_order_id(orders: DataFrame, wanted: DataFrame) -> DataFrame:
    return get_by_keys(orders, wanted, ["order_id"])


def get_by_sort_key(orders: DataFrame, wanted: DataFrame) -> DataFrame:
    return get_by_keys(orders, wanted, ["customer_id", "order_ts_id"])


def in_time_range(
    orders: DataFrame, start: Column | None = None, end: Column | None = None, strict: bool = False
) -> DataFrame:
    """Both bounds: inclusive range; start only: from there on; end only: no filter, or an error if strict."""
    if start is not None and end is not None:
        return orders.where(F.col("order_ts").between(start, end))
    if start is not None:
        return orders.where(F.col("order_ts") >= start)
    if end is not None and strict:
        raise ValueError("an end time needs a start time")
    return orders


def newest_first(orders: DataFrame, limit: int, tie: str = "order_id") -> DataFrame:
    return orders.orderBy(F.desc("order_ts"), F.desc(tie)).limit(limit)


def county_orders(
    orders: DataFrame,
    county_id: str,
    start: Column | None = None,
    end: Column | None = None,
    limit: int = LISTING_LIMIT,
    strict: bool = False,
    tie: str = "order_id",
) -> DataFrame:
    return newest_first(in_time_range(orders.where(F.col("county_id") == county_id), start, end, strict), limit, tie)


def store_orders(orders: DataFrame, store_id: str, limit: int = LISTING_LIMIT, tie: str = "order_id") -> DataFrame:
    return newest_first(orders.where(F.col("store_id") == store_id), limit, tie)


def status_queue(orders: DataFrame, status: str, limit: int = LISTING_LIMIT, tie: str = "order_id") -> DataFrame:
    return newest_first(orders.where(F.col("status") == status), limit, tie)


def page_token(customer_id: Column, order_ts_id: Column) -> Column:
    return F.to_json(F.struct(customer_id.alias("customer_id"), order_ts_id.alias("order_ts_id")))


def parse_token(token: str) -> tuple[str, str]:
    parsed = json.loads(token)
    return parsed["customer_id"], parsed["order_ts_id"]


def customer_history(
    orders: DataFrame,
    customer_id: str,
    limit: int | str | None = None,
    token: str | None = None,
) -> DataFrame:
    """One customer's orders, newest first; ``token`` resumes strictly after the order it names."""
    limit = check_limit(limit)
    mine = orders.where(F.col("customer_id") == customer_id)
    if token:
        owner, last = parse_token(token)
        if owner != customer_id:
            raise ValueError("the token belongs to another customer")
        mine = mine.where(F.col("order_ts_id") < last)
    return mine.orderBy(F.desc("order_ts_id")).limit(limit)


def next_token(page: DataFrame, limit: int) -> DataFrame:
    """One row: the token of the last row of a full page, null when the page is not full."""
    last = F.min_by(page_token(F.col("customer_id"), F.col("order_ts_id")), "order_ts_id")
    return page.agg(F.when(F.count(F.lit(1)) == limit, last).alias("next_token"))


def top_per_group(orders: DataFrame, group: str, limit: int, tie: str = "order_id") -> DataFrame:
    """The newest ``limit`` orders of every group, with their ``rank``.

    The rank filter is applied before the shuffle too (group limit), so a large group sends at most
    ``limit`` rows per task.
    """
    window = Window.partitionBy(group).orderBy(F.desc("order_ts"), F.desc(tie))
    return orders.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def live_at(orders: DataFrame, as_of: Column) -> DataFrame:
    """Rows without expiry or expiring after ``as_of``."""
    return orders.where(F.col("ttl").isNull() | (F.col("ttl") > F.unix_timestamp(as_of)))


def by_id_copy(orders: DataFrame) -> DataFrame:
    """The fourteen columns of the copy keyed by order id."""
    return orders.select(*ORDER_BY_ID_COLUMNS)
