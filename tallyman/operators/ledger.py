"""Reservations over time: stock that is held for a while, expires or is released, and counts again for later orders.

A reservation holds stock from the time of its order until ``until`` (null: for good). As signed events, plus at its start
and minus at its end, the stock that is held at any moment is a running total along time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_totals_of_stored
from ..session import cut_lineage
from .inventory import stock_on_hand

# The end of a reservation that stays.
FOREVER = "9999-12-31 00:00:00"
# Contended lines of a store that are decided in one task; a store with more takes rounds.
STORE_LINES = 500

_ORDER = ["at", "starts", "order_id"]


def _buckets() -> list[Column]:
    """Buckets that never decrease along time, ends before starts, and id."""
    exact = F.struct("at", "starts", F.substring("order_id", 1, 20).alias("id"))
    return [F.date_trunc("minute", "at"), exact]


def _events(holds: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """Two rows for each hold: the numbers (output: column) added at its start and taken away at its end.

    At one moment ends come before starts, so stock that is given back then can be taken then. A hold that ends when it
    starts, or before, adds nothing.
    """
    holding = F.col("until") > F.col("order_ts")

    def side(starts: int, at: str) -> Column:
        times = F.when(holding, F.lit(1 if starts else -1)).otherwise(0)
        signed = [(F.col(source) * times).cast("long").alias(out) for out, source in numbers.items()]
        return F.struct(F.lit(starts).alias("starts"), F.col(at).alias("at"), *signed)

    both = F.array(side(0, "until"), side(1, "order_ts"))
    ends_later = F.filter(both, lambda e: (e["starts"] == 1) | holding)
    return holds.withColumn("_event", F.explode(ends_later)).select("*", "_event.*").drop("_event")


def _asked(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Lines summed by order and stock row, with the row's ``room`` and whether all demand together exceeds it.

    The sums are stored, since demand is found from them and joined with them; so is the result, which is read by order and line.
    """
    until = F.coalesce("until", F.lit(FOREVER).cast("timestamp"))
    sums = lines.groupBy("order_id", "order_ts", "store_sku").agg(
        F.sum("quantity").alias("quantity"), F.max(until).alias("until")
    )
    merged = cut_lineage(sums, "ledger")
    demand = merged.groupBy("store_sku").agg(F.sum("quantity").alias("demand"))
    rooms = demand.join(stock_on_hand(inventory), "store_sku", "left").select(
        "store_sku", "demand", F.coalesce("available", F.lit(0)).cast("long").alias("room")
    )
    asked = merged.join(rooms, "store_sku").withColumn("contended", F.col("demand") > F.col("room")).drop("demand")
    return cut_lineage(asked, "ledger")


def _by_store(work: DataFrame, store_lines: int) -> tuple[DataFrame, DataFrame]:
    """Verdicts on the orders of stores with few contended lines, and the lines of the others.

    A store's orders are tried one by one in one expression, which carries the holds that have not ended. Orders with lines of several stores are left to the rounds, together with their stores.
    """
    placed = work.withColumn("store", F.substring_index("store_sku", "#", 1))
    mixed = placed.groupBy("order_id").agg(F.min("store").alias("low"), F.max("store").alias("high")).where("low != high")
    touched = placed.join(mixed.select("order_id"), "order_id", "left_semi").select("store").distinct()
    small = placed.groupBy("store").count().where(F.col("count") <= store_lines).join(touched, "store", "left_anti")
    few = placed.join(small.select("store"), "store", "left_semi")
    tried = few.groupBy("store", "order_id", "order_ts").agg(
        F.collect_list(F.struct("until", "store_sku", F.col("quantity").cast("long").alias("quantity"), "room")).alias("asked")
    )
    queues = tried.groupBy("store").agg(
        F.sort_array(F.collect_list(F.struct("order_ts", "order_id", "asked"))).alias("queue")
    )
    nothing = F.lit(0).cast("long")

    def step(done: Column, order: Column) -> Column:
        still = F.filter(done["holds"], lambda hold: hold["until"] > order["order_ts"])

        def held(sku: Column) -> Column:
            return F.aggregate(
                still, nothing, lambda total, hold: total + F.when(hold["store_sku"] == sku, hold["quantity"]).otherwise(nothing)
            )

        fits = F.forall(order["asked"], lambda line: held(line["store_sku"]) + line["quantity"] <= line["room"])
        taken = F.filter(order["asked"], lambda line: fits & (line["until"] > order["order_ts"]))
        verdict = F.struct(order["order_id"].alias("order_id"), fits.alias("reserved"))
        return F.struct(
            F.concat(still, taken).alias("holds"), F.array_append(done["verdicts"], verdict).alias("verdicts")
        )

    holds = F.array().cast("array<struct<until:timestamp,store_sku:string,quantity:bigint,room:bigint>>")
    verdicts = F.array().cast("array<struct<order_id:string,reserved:boolean>>")
    start = F.struct(holds.alias("holds"), verdicts.alias("verdicts"))
    walked = queues.select(F.inline(F.aggregate("queue", start, step)["verdicts"]))
    return walked, placed.join(small.select("store"), "store", "left_anti").drop("store")


def reserve_over_time(lines: DataFrame, inventory: DataFrame, store_lines: int = STORE_LINES) -> DataFrame:
    """Per order ``reserved``, as if orders were tried one by one and holds ended at their time.

    ``lines`` has ``order_id``, ``order_ts``, ``store_sku``, ``quantity`` and ``until``: when the order would give its stock
    back, null if never. An order takes its stock only if all lines fit what is free at its time; orders of one
    time follow their ids, and stock that is given back at that time is free. With ``until`` null everywhere this is
    :func:`inventory.reserve_in_order`.

    A stock row that is not in the inventory is empty; lines without ``store_sku`` are left out.

    Orders with a line above what its row holds at all are rejected; those that meet no contended row are accepted. Stores
    with at most ``store_lines`` contended lines are decided each on its own. The others take rounds with two bounds on
    what is held at an order's time: at least by orders accepted already, at most also by all undecided ones
    before it. The earliest undecided order is always decided, so the rounds end. A store leaves the rounds
    as soon as it has at most ``store_lines`` undecided lines.
    """
    asked = _asked(lines, inventory)
    first = asked.groupBy("order_id").agg(
        F.when(F.bool_or(F.col("quantity") > F.col("room")), F.lit(False))
        .when(~F.bool_or("contended"), F.lit(True)).alias("reserved")
    )
    first = cut_lineage(first.where(F.col("order_id").isNotNull()), "ledger")
    decided = first.where(F.col("reserved").isNotNull())
    undecided = first.where(F.col("reserved").isNull()).select("order_id")
    work = asked.where("contended").drop("contended").join(undecided, "order_id", "left_semi")
    work = cut_lineage(work.withColumn("reserved", F.lit(None).cast("boolean")), "ledger")
    walked, work = _by_store(work, store_lines)
    decided = decided.unionByName(walked)
    if work.isEmpty():
        return decided
    tried = False
    while True:
        # ``room`` already excludes what orders accepted in earlier rounds hold at the line's time.
        work = work.withColumns(
            {
                "undecided": F.when(F.col("reserved").isNull(), F.col("quantity")).otherwise(0),
                "accepted": F.when(F.col("reserved"), F.col("quantity")).otherwise(0),
            }
        )
        events = _events(work, {"maybe": "undecided", "surely": "accepted"})
        totals = running_totals_of_stored(events, ["store_sku"], _ORDER, {"ahead": "maybe", "taken": "surely"}, _buckets())
        open_lines = cut_lineage(
            totals.where(F.col("reserved").isNull() & (F.col("starts") == 1)).select(
                "order_id", "order_ts", "store_sku", "quantity", "until",
                (F.col("room") - F.col("taken")).alias("room"), (F.col("ahead") - F.col("maybe")).alias("ahead"),
            ),
            "ledger",
        )
        if tried:
            # Stores that have few lines left are walked from here: the rooms of their lines are up to date.
            walked, open_lines = _by_store(open_lines, store_lines)
            decided = decided.unionByName(walked)
        tried = True
        verdicts = open_lines.groupBy("order_id").agg(
            F.when(F.bool_and(F.col("ahead") + F.col("quantity") <= F.col("room")), F.lit(True))
            .when(F.bool_or(F.col("quantity") > F.col("room")), F.lit(False)).alias("reserved")
        )
        judged = cut_lineage(open_lines.drop("ahead").join(verdicts, "order_id"), "ledger")
        decided = decided.unionByName(judged.where(F.col("reserved").isNotNull()).select("order_id", "reserved").distinct())
        if judged.where(F.col("reserved").isNull()).isEmpty():
            return decided
        work = judged.where(F.col("reserved").isNull() | F.col("reserved"))


def held_over_time(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What is held of each stock row after every start and end of a reservation: ``store_sku``, ``at``, ``held``.

    One row for each row and moment at which something changes.
    """
    granted = lines.join(verdicts.where("reserved").select("order_id"), "order_id", "left_semi")
    until = F.coalesce("until", F.lit(FOREVER).cast("timestamp"))
    holds = granted.groupBy("order_id", "order_ts", "store_sku").agg(
        F.sum("quantity").alias("quantity"), F.max(until).alias("until")
    )
    events = _events(holds, {"change": "quantity"}).where("change != 0 AND (starts = 1 OR until < timestamp '9999-12-31')")
    moments = events.groupBy("store_sku", "at").agg(F.sum("change").alias("change"))
    minute = F.date_trunc("minute", "at")
    return running_totals_of_stored(cut_lineage(moments, "ledger"), ["store_sku"], ["at"], {"held": "change"}, [minute]).drop("change")
