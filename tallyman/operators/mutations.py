"""Changes to order tables as pure functions from a table and its changes to a new table and an outcome."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CANCELLABLE_STATUSES, CANCELLED, DECLINED, NOT_CANCELLABLE, NOT_FOUND, STATUS_CHANGED
from ..session import cut_lineage

# Updates of one key are folded in blocks of this many sequence numbers, and blocks in groups of this many.
FOLD_BLOCK = 1024
FOLD_FAN = 1024
_STATE = "struct<status:string,touched_at:timestamp>"


class Mutation(NamedTuple):
    """The new table and one outcome row per requested change."""

    table: DataFrame
    outcome: DataFrame


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> Mutation:
    """Insert rows whose key the target does not hold; within the batch the first row of a key wins.

    ``order`` must be unique within a key. The outcome has every incoming row's key and ``order`` value,
    ``created`` and ``stored_status``. A stored row counts as present whatever its status. Rows with a null in their
    key are never created.
    """
    keys = list(keys)
    first = incoming.groupBy(*keys).agg(F.min(order).alias("_first"), F.min_by("status", order).alias("_won"))
    existing = target.select(*keys, F.col("status").alias("_held"), F.lit(True).alias("_present"))
    ranked = incoming.join(first, keys, "left").join(existing, keys, "left")
    created = F.coalesce(F.col("_present").isNull() & (F.col(order) == F.col("_first")), F.lit(False))
    new_rows = ranked.where(created).select(*target.columns)
    outcome = ranked.select(
        *keys,
        order,
        created.alias("created"),
        F.when(F.col("_present"), F.col("_held")).otherwise(F.col("_won")).alias("stored_status"),
    )
    return Mutation(target.unionByName(new_rows), outcome)


def bulk_put(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Overwrite by key: the last incoming row of a key replaces the target's row."""
    keys = list(keys)
    last = incoming
    if order is not None:
        row = F.struct(*target.columns)
        last = incoming.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")
    kept = target.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(last.select(*target.columns))


def _matches(status: Column, expected: Column) -> Column:
    return expected.isNull() | F.coalesce(expected == status, F.lit(False))


def _fold(updates: Column, start: Column) -> Column:
    """Status and time after applying a sorted array of updates; a null start stands for any other status."""
    return F.aggregate(
        updates,
        _begin(start),
        lambda acc, u: F.when(
            _matches(acc["status"], u["expected_status"]),
            F.struct(u["new_status"].alias("status"), u["requested_at"].alias("touched_at")),
        ).otherwise(acc).cast(_STATE),
    )


def _advance(state: Column, step: Column) -> Column:
    """The state behind a block, from the state before it and the block as a function of the status."""
    result = F.coalesce(F.try_element_at(step["guarded"], state["status"]), step["otherwise"])
    return F.struct(
        F.coalesce(result["status"], state["status"]).alias("status"),
        F.coalesce(result["touched_at"], state["touched_at"]).alias("touched_at"),
    ).cast(_STATE)


def _begin(status: Column) -> Column:
    return F.struct(status.alias("status"), F.lit(None).cast("timestamp").alias("touched_at")).cast(_STATE)


def _as_function(guards: Column, run: Callable[[Column], Column]) -> Column:
    """A block as a function: the end for each status that it asks for, and the one for all others."""
    ends = F.map_from_arrays(guards, F.transform(guards, run))
    return F.struct(ends.alias("guarded"), run(F.lit(None).cast("string")).alias("otherwise"))


def _block_of(number: Column, size: int) -> Column:
    return F.call_function("div", number - F.pmod(number, F.lit(size)), F.lit(size).cast("bigint"))


def update_status(target: DataFrame, updates: DataFrame) -> Mutation:
    """Guarded status updates, applied per order in ``seq`` order.

    ``updates`` has ``order_id``, ``seq``, ``expected_status`` (null for no guard), ``new_status`` and
    ``requested_at``. An update applies when the order exists and its status at that moment is the expected
    one.

    This is a parallel scan. A block of neighbouring updates is summarized as a function from status to status; such
    functions are composed, ``FOLD_FAN`` neighbours at a time, until one is left for each order. From the order's status
    the statuses before each block are handed down again, and every block finds out which of its updates applied. No
    array holds more than one block or group, however sparse the numbers are; dense ones need a single level.
    """
    lowest, highest = updates.agg(F.min("seq"), F.max("seq")).first()
    in_block = F.struct("seq", "expected_status", "new_status", "requested_at")
    number = F.col("seq").cast("bigint") - F.lit(lowest or 0)  # from 0 on, so that all blocks end in one
    folded = updates.withColumn("block", _block_of(number, FOLD_BLOCK)).groupBy("order_id", "block")
    folded = folded.agg(F.array_sort(F.collect_list(in_block)).alias("_updates"))
    guards = F.array_distinct(F.array_compact(F.transform("_updates", lambda u: u["expected_status"])))
    folded = folded.withColumn("step", _as_function(guards, lambda g: _fold(F.col("_updates"), g)))
    last = 0 if lowest is None else (highest - lowest) // FOLD_BLOCK
    levels = [folded]
    while last:
        levels[-1] = cut_lineage(levels[-1], "blocks")
        last //= FOLD_FAN
        child = F.struct("block", "step")
        group = levels[-1].select("order_id", _block_of(F.col("block"), FOLD_FAN).alias("_group"), child.alias("child"))
        in_order = F.array_sort(F.collect_list("child"), lambda a, b: F.when(a["block"] < b["block"], -1).otherwise(1))
        group = group.groupBy("order_id", F.col("_group").alias("block")).agg(in_order.alias("children"))
        asked = F.array_distinct(F.flatten(F.transform("children", lambda c: F.map_keys(c["step"]["guarded"]))))
        through = lambda g: F.aggregate("children", _begin(g), lambda acc, c: _advance(acc, c["step"]))
        levels.append(group.withColumn("step", _as_function(asked, through)))

    # One block is left for each order.
    top = target.select("order_id", "status").join(levels[-1].select("order_id", "block", "step"), "order_id")
    ends = top.select("order_id", _advance(_begin(F.col("status")), F.col("step")).alias("_end")).select(
        "order_id", F.col("_end.status").alias("_status"), F.col("_end.touched_at").alias("_touched")
    )
    table = target.join(ends, "order_id", "left").select(
        *[
            F.coalesce("_status", "status").alias(c) if c == "status"
            else F.coalesce("_touched", "updated_at").alias(c) if c == "updated_at"
            else F.col(c)
            for c in target.columns
        ]
    )
    starts = top.select("order_id", "block", F.col("status").alias("_start"), F.lit(True).alias("_known"))
    for level in levels[:0:-1]:
        begin = F.struct(F.col("_start").alias("status"), F.array().cast("array<struct<block:bigint,status:string>>").alias("starts"))
        passed = F.aggregate(
            "children", begin,
            lambda acc, c: F.struct(
                _advance(_begin(acc["status"]), c["step"])["status"].alias("status"),
                F.array_append(acc["starts"], F.struct(c["block"].alias("block"), acc["status"].alias("status"))).alias("starts"),
            ),
        )
        handed = level.join(starts, ["order_id", "block"]).select("order_id", F.explode(passed["starts"]).alias("_s"))
        starts = handed.select(
            "order_id", F.col("_s.block").alias("block"), F.col("_s.status").alias("_start"), F.lit(True).alias("_known")
        )
    walk = F.aggregate(
        "_updates",
        F.struct(
            F.col("_start").alias("status"),
            F.array().cast("array<struct<seq:bigint,applied:boolean,status_before:string>>").alias("log"),
        ),
        lambda acc, u: F.struct(
            F.when(_matches(acc["status"], u["expected_status"]), u["new_status"])
            .otherwise(acc["status"]).alias("status"),
            F.array_append(
                acc["log"],
                F.struct(
                    u["seq"].cast("bigint").alias("seq"),
                    _matches(acc["status"], u["expected_status"]).alias("applied"),
                    acc["status"].alias("status_before"),
                ),
            ).alias("log"),
        ),
    )
    outcome = (
        levels[0].join(starts, ["order_id", "block"], "left")
        .select("order_id", "_known", F.explode(walk["log"]).alias("_l"))
        .select(
            "order_id",
            "_l.seq",
            (F.col("_l.applied") & F.col("_known").isNotNull()).alias("applied"),
            "_l.status_before",
            F.col("_known").isNotNull().alias("found"),
        )
    )
    return Mutation(table, outcome)


def set_status(target: DataFrame, updates: DataFrame) -> DataFrame:
    """One guarded update per order: ``order_id``, ``expected_status``, ``new_status``, ``requested_at``."""
    joined = target.join(
        updates.select("order_id", F.col("expected_status").alias("_expected"), F.col("new_status").alias("_new"),
                       F.col("requested_at").alias("_at")),
        "order_id",
        "left",
    )
    applies = F.col("_new").isNotNull() & _matches(F.col("status"), F.col("_expected"))
    return joined.select(
        *[
            F.when(applies, F.col("_new")).otherwise(F.col("status")).alias(c) if c == "status"
            else F.when(applies, F.col("_at")).otherwise(F.col("updated_at")).alias(c) if c == "updated_at"
            else F.col(c)
            for c in target.columns
        ]
    )


def cancel_orders(target: DataFrame, requests: DataFrame, as_of: Column) -> Mutation:
    """Cancel orders that are PENDING or CONFIRMED.

    ``seen_status`` of a request is the status its sender read; null means the current one. Outcomes: 200
    cancelled, 404 unknown order, 409 not cancellable (with the status), 409 changed since it was read.
    """
    current = target.select("order_id", F.col("status").alias("current_status"), F.lit(True).alias("_present"))
    seen = F.coalesce("seen_status", "current_status")
    found = F.col("_present").isNotNull()
    cancellable = F.coalesce(seen.isin(*CANCELLABLE_STATUSES), F.lit(False))
    unchanged = seen.eqNullSafe(F.col("current_status"))
    outcome = requests.join(current, "order_id", "left").select(
        "order_id",
        F.when(~found, 404).when(cancellable & unchanged, 200).otherwise(409).alias("status_code"),
        F.when(~found, NOT_FOUND)
        .when(~cancellable, NOT_CANCELLABLE)
        .when(~unchanged, STATUS_CHANGED)
        .otherwise(CANCELLED).alias("message"),
        F.when(found & ~cancellable, seen).alias("current_status"),
    )
    granted = (
        outcome.where(F.col("status_code") == 200)
        .select(
            "order_id",
            F.lit(None).cast("string").alias("expected_status"),
            F.lit("CANCELLED").alias("new_status"),
            as_of.alias("requested_at"),
        )
        .distinct()
    )
    return Mutation(set_status(target, granted), outcome)


def apply_payments(target: DataFrame, results: DataFrame) -> Mutation:
    """Set ``payment_state`` from payment results; an amount of zero or less always fails.

    One result per order: ``order_id``, ``approved``, ``amount``, ``settled_at``.
    """
    approved = F.col("approved") & (F.col("amount") > 0)
    outcome = results.select(
        "order_id",
        F.when(approved, "CAPTURED").otherwise("FAILED").alias("payment_result"),
        F.when(~approved, F.lit(DECLINED)).alias("error"),
        "settled_at",
    )
    joined = target.join(
        outcome.select("order_id", F.col("payment_result").alias("_state"), F.col("settled_at").alias("_at")),
        "order_id",
        "left",
    )
    table = joined.select(
        *[
            F.coalesce("_state", c).alias(c) if c == "payment_state"
            else F.coalesce("_at", c).alias(c) if c == "updated_at"
            else F.col(c)
            for c in target.columns
        ]
    )
    return Mutation(table, outcome)
