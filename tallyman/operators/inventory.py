"""Stock availability, reservation, release and demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sortable_id
from ..functions.ordered import running_totals, running_totals_of_stored
from ..schemas import RESERVATION_MINUTES, SHORTAGE
from ..session import cut_lineage


# Contended lines of a store that are decided in one task; a store with more takes rounds.
STORE_LINES = 2000


def stock_on_hand(inventory: DataFrame) -> DataFrame:
    """``store_sku`` and what can still be promised; missing numbers count as zero."""
    return inventory.select(
        "store_sku",
        (F.coalesce("quantity_available", F.lit(0)) - F.coalesce("quantity_reserved", F.lit(0))).alias("available"),
    )


def availability(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per order line what is available (0 without a stock row) and whether it suffices."""
    return (
        lines.join(stock_on_hand(inventory), "store_sku", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("sufficient", F.col("available") >= F.col("quantity"))
    )


def snapshot_check(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per order whether every line fits the stock as it is now, and how many do not.

    Orders do not see each other here; ``reserve_in_order`` lets them compete.
    """
    return (
        availability(lines, inventory)
        .groupBy("order_id")
        .agg(
            F.bool_and("sufficient").alias("reserved"),
            F.count_if(~F.col("sufficient")).alias("failed_lines"),
        )
        .withColumn("error", F.when(~F.col("reserved"), F.lit(SHORTAGE)))
    )


def shortages(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """The failing lines behind ``snapshot_check``, one row each: what was asked and what there is."""
    return availability(lines, inventory).where(~F.col("sufficient")).select(
        "order_id", "sku", F.col("quantity").alias("requested"), "available"
    )


def _order_buckets() -> list[Column]:
    """Buckets that never decrease along ``order_ts, order_id``: the minute, then time and id without its last digits.

    Ids have one width, so their first 20 characters follow their order.
    """
    exact = F.struct(F.col("order_ts").alias("at"), F.substring("order_id", 1, 20).alias("id"))
    return [F.date_trunc("minute", "order_ts"), exact]


def cumulative_demand(lines: DataFrame) -> DataFrame:
    """Running demand per stock row in order of ``order_ts, order_id``.

    The lines are stored once: they are counted by stock row, then ordered in one shuffle.
    """
    return running_totals_of_stored(
        cut_lineage(lines), ["store_sku"], ["order_ts", "order_id"], {"cumulative": "quantity"}, _order_buckets()
    )


def _contended(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Lines summed by order and stock row, with the stock row's ``room``, whether it is ``contended``, and what the order
    would hold of it (nothing where ``keeps`` is false)."""
    if "keeps" not in lines.columns:
        lines = lines.withColumn("keeps", F.lit(True))
    merged = lines.groupBy("order_id", "order_ts", "store_sku").agg(
        F.sum("quantity").alias("quantity"), F.bool_and(F.coalesce("keeps", F.lit(False))).alias("keeps")
    )
    demand = merged.groupBy("store_sku").agg(F.sum("quantity").alias("demand"))
    rooms = demand.join(stock_on_hand(inventory), "store_sku", "left").select(
        "store_sku", "demand", F.coalesce("available", F.lit(0)).cast("bigint").alias("room")
    )
    return merged.join(rooms, "store_sku").select(
        "order_id", "order_ts", "store_sku", "quantity", "room", (F.col("demand") > F.col("room")).alias("contended"),
        F.when(F.col("keeps"), F.col("quantity")).otherwise(F.lit(0)).alias("held"),
    )


def _decided_by_store(work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts on the orders of stores with few contended lines, and the lines of the others.

    Orders of different stores never compete. A store's orders are tried one by one in one expression, over the room that
    is left in each of its contended stock rows; ``STORE_LINES`` bounds what such a row gathers. Orders with lines
    of several stores are left to the rounds, together with their stores.
    """
    store = F.substring_index("store_sku", "#", 1)
    placed = work.withColumn("store", store)
    mixed = placed.groupBy("order_id").agg(F.min("store").alias("low"), F.max("store").alias("high")).where("low != high")
    touched = placed.join(mixed.select("order_id"), "order_id", "left_semi").select("store").distinct()
    small = placed.groupBy("store").count().where(F.col("count") <= STORE_LINES).join(touched, "store", "left_anti")
    few = placed.join(small.select("store"), "store", "left_semi")
    rooms = few.groupBy("store").agg(F.map_from_entries(F.collect_set(F.struct("store_sku", "room"))).alias("rooms"))
    tried = few.groupBy("store", "order_id", "order_ts").agg(
        F.collect_list(F.struct("store_sku", "quantity")).alias("asked"),
        F.map_from_entries(F.collect_list(F.struct("store_sku", "held"))).alias("held"),
    )
    queues = tried.groupBy("store").agg(
        F.sort_array(F.collect_list(F.struct("order_ts", "order_id", "asked", F.map_entries("held").alias("held")))).alias("queue")
    )

    def step(done: Column, order: Column) -> Column:
        left = done["rooms"]
        fits = F.forall(order["asked"], lambda line: left[line["store_sku"]] >= line["quantity"])
        held = F.map_from_entries(order["held"])
        after = F.when(fits, F.transform_values(left, lambda sku, room: room - F.coalesce(held[sku], F.lit(0)))).otherwise(left)
        verdict = F.struct(order["order_id"].alias("order_id"), fits.alias("reserved"))
        return F.struct(after.alias("rooms"), F.array_append(done["verdicts"], verdict).alias("verdicts"))

    nothing = F.array().cast("array<struct<order_id:string,reserved:boolean>>")
    walked = queues.join(rooms, "store").select(
        F.inline(F.aggregate("queue", F.struct("rooms", nothing.alias("verdicts")), step)["verdicts"])
    )
    return walked, placed.join(small.select("store"), "store", "left_anti").drop("store")


def reserve_in_order(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """First come, first served reservation: per order ``reserved``, as if orders were tried one by one.

    An order takes stock only if all its lines fit, so a rejected order must not count against later ones. Lines may have
    ``keeps``: an order without it is asked like others but gives its stock back at once, so it does not count either.

    Before any ordering, orders with a line above what its stock row holds are rejected, and lines of stock rows that
    suffice for everybody are set aside; only orders with lines of contended stock rows compete. Stores with few of those
    are decided at once, each on its own. Larger ones take rounds: each looks at the undecided lines with two bounds on the
    demand ahead of them: at least that of
    the orders accepted earlier, at most that plus all undecided ones. An order whose lines fit under the
    upper bound is accepted; one with a line that misses even the lower bound is rejected. The earliest
    undecided order is always decided, so the rounds end; decided lines leave the working set.
    """
    asked = _contended(lines, inventory)
    first = asked.groupBy("order_id").agg(
        F.when(F.bool_or(F.col("quantity") > F.col("room")), F.lit(False))
        .when(~F.bool_or("contended"), F.lit(True)).alias("reserved")
    )
    judged = cut_lineage(asked.join(first, "order_id"))
    decided = judged.where(F.col("reserved").isNotNull()).select("order_id", "reserved").distinct()
    work = judged.where(F.col("reserved").isNull() & F.col("contended")).drop("contended")
    walked, work = _decided_by_store(work)
    decided = decided.unionByName(walked)
    if work.isEmpty():
        return decided
    while True:
        # ``room`` already excludes orders accepted in earlier rounds that come before the line.
        work = work.withColumns(
            {
                "undecided": F.when(F.col("reserved").isNull(), F.col("held")).otherwise(0),
                "accepted": F.when(F.col("reserved"), F.col("held")).otherwise(0),
            }
        )
        totals = running_totals(
            work,
            ["store_sku"],
            ["order_ts", "order_id"],
            {"ahead": "undecided", "taken": "accepted"},
            _order_buckets(),
        )
        open_lines = totals.where(F.col("reserved").isNull()).select(
            "order_id", "order_ts", "store_sku", "quantity", "held",
            (F.col("room") - F.col("taken")).alias("room"), (F.col("ahead") - F.col("held")).alias("ahead"),
        )
        verdicts = open_lines.groupBy("order_id").agg(
            F.bool_and(F.col("ahead") + F.col("quantity") <= F.col("room")).alias("_fits"),
            F.bool_or(F.col("quantity") > F.col("room")).alias("_misses"),
        )
        verdict = F.when(F.col("_fits"), F.lit(True)).when(F.col("_misses"), F.lit(False))
        judged = cut_lineage(
            open_lines.join(verdicts.select("order_id", verdict.alias("reserved")), "order_id").drop("ahead")
        )
        done = judged.where(F.col("reserved").isNotNull()).select("order_id", "reserved").distinct()
        decided = decided.unionByName(done)
        if judged.where(F.col("reserved").isNull()).isEmpty():
            return decided
        work = judged.where(F.col("reserved").isNull() | F.col("reserved"))


def reservations(lines: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """One PENDING reservation row per line of the orders that got their stock."""
    expires = as_of + F.expr(f"interval {RESERVATION_MINUTES} minutes")
    return lines.join(verdicts.where("reserved").select("order_id"), "order_id", "left_semi").select(
        sortable_id("RES-", as_of, F.col("order_id"), F.col("store_sku")).alias("reservation_id"),
        "order_id",
        "store_sku",
        "quantity",
        F.lit("PENDING").alias("status"),
        as_of.alias("created_at"),
        expires.alias("expires_at"),
    )


def add_reservations(inventory: DataFrame, reserved: DataFrame) -> DataFrame:
    """Stock with the quantities of new reservations added to ``quantity_reserved``."""
    added = reserved.groupBy("store_sku").agg(F.sum("quantity").alias("_added"))
    joined = inventory.join(added, "store_sku", "left")
    total = (F.coalesce("quantity_reserved", F.lit(0)) + F.col("_added")).cast("int")
    return joined.withColumn(
        "quantity_reserved", F.when(F.col("_added").isNotNull(), total).otherwise(F.col("quantity_reserved"))
    ).drop("_added")


def release(inventory: DataFrame, held: DataFrame, failed: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Release PENDING reservations that expired or whose order failed.

    Returns the stock with the quantities given back (never below zero) and the reservations with the
    released ones marked.
    """
    lost = failed.select("order_id").distinct().withColumn("_failed", F.lit(True))
    gone = (F.col("status") == "PENDING") & (F.col("_failed").isNotNull() | (F.col("expires_at") <= as_of))
    marked = (
        held.join(lost, "order_id", "left")
        .withColumn("_given_back", gone)
        .withColumn("status", F.when(F.col("_given_back"), "RELEASED").otherwise(F.col("status")))
        .drop("_failed")
    )
    deltas = marked.where("_given_back").select("store_sku", (-F.col("quantity")).alias("quantity_delta"))
    summed = deltas.groupBy("store_sku").agg(F.sum("quantity_delta").alias("_delta"))
    stock = inventory.join(summed, "store_sku", "left")
    left = F.greatest(F.coalesce("quantity_reserved", F.lit(0)) + F.col("_delta"), F.lit(0)).cast("int")
    stock = stock.withColumn(
        "quantity_reserved", F.when(F.col("_delta").isNotNull(), left).otherwise(F.col("quantity_reserved"))
    ).drop("_delta")
    return stock, marked.drop("_given_back")


def apply_deltas(inventory: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add signed ``quantity_delta`` rows to ``quantity_available``, never below zero."""
    summed = deltas.groupBy("store_sku").agg(F.sum("quantity_delta").alias("_delta"))
    moved = F.greatest(F.coalesce("quantity_available", F.lit(0)) + F.coalesce("_delta", F.lit(0)), F.lit(0))
    return (
        inventory.join(summed, "store_sku", "left")
        .withColumn("quantity_available", moved.cast("int"))
        .drop("_delta")
    )
