from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyman.operators import fulfilment, inventory, mutations
from tallyman.schemas import ORDER_STATUSES

AT = dt.datetime(2024, 5, 1, 12)


def orders_frame(spark, rows):
    return spark.createDataFrame(
        [(o, s, "PENDING", AT) for o, s in rows], "order_id string, status string, payment_state string, updated_at timestamp"
    )


def test_cancel_outcomes(spark):
    orders = orders_frame(spark, [("p", "PENDING"), ("c", "CONFIRMED"), ("s", "SHIPPED"), ("raced", "PROCESSING")])
    requests = spark.createDataFrame(
        [("p", None), ("c", "CONFIRMED"), ("s", None), ("raced", "PENDING"), ("none", None)],
        "order_id string, seen_status string",
    )
    changed = mutations.cancel_orders(orders, requests, F.lit(AT))
    got = {r.order_id: (r.status_code, r.current_status) for r in changed.outcome.collect()}
    assert got == {"p": (200, None), "c": (200, None), "s": (409, "SHIPPED"), "raced": (409, None), "none": (404, None)}
    assert {r.order_id: r.status for r in changed.table.collect()} == {
        "p": "CANCELLED", "c": "CANCELLED", "s": "SHIPPED", "raced": "PROCESSING"}


@pytest.mark.parametrize("seed", range(3))
def test_guarded_updates_equal_a_sequential_replay(spark, monkeypatch, seed):
    monkeypatch.setattr(mutations, "FOLD_BLOCK", 4)
    monkeypatch.setattr(mutations, "FOLD_FAN", 3 if seed else 64)
    rng = random.Random(seed)
    status = {f"o{i}": rng.choice([*ORDER_STATUSES, "ODD"]) for i in range(6)}
    updates = []
    for order in [*status, "missing"]:
        count = 40 if order == "o0" else rng.randrange(6)
        for seq in sorted(rng.sample(range(100), count)):
            expected = rng.choice([None, "ODD", *ORDER_STATUSES[:4]]) if rng.random() < 0.9 else "FAILED"
            if expected is None and rng.random() < 0.6:
                expected = "PENDING"
            updates.append((order, seq, expected, rng.choice(ORDER_STATUSES), AT + dt.timedelta(seconds=seq)))
    frame = spark.createDataFrame(
        updates, "order_id string, seq bigint, expected_status string, new_status string, requested_at timestamp"
    )
    changed = mutations.update_status(orders_frame(spark, status.items()), frame)
    now, touched, applied = dict(status), {o: AT for o in status}, {}
    for order, seq, expected, new, at in sorted(updates, key=lambda u: (u[0], u[1])):
        ok = order in now and (expected is None or now[order] == expected)
        applied[(order, seq)] = ok
        if ok:
            now[order], touched[order] = new, at
    assert {r.order_id: (r.status, r.updated_at) for r in changed.table.collect()} == {
        o: (now[o], touched[o]) for o in now}
    assert {(r.order_id, r.seq): r.applied for r in changed.outcome.collect()} == applied


def test_sparse_updates_of_one_order(spark):
    """Numbers far apart: no block holds more than a few updates, and no array more than one group."""
    n = 30000
    status = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "CONFIRMED", "SHIPPED")]), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int"))
    wanted = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "CONFIRMED", "SHIPPED")]), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) + 1).cast("int"))
    updates = spark.range(n).select(
        F.lit("o").alias("order_id"), (F.col("id") * 977 * 1_000_003 - 10**12).alias("seq"), status.alias("expected_status"),
        wanted.alias("new_status"), F.lit(AT).alias("requested_at"))
    rows = sorted((r.seq, r.expected_status, r.new_status) for r in updates.collect())
    changed = mutations.update_status(orders_frame(spark, [("o", "PENDING"), ("other", "FAILED")]), updates)
    now, applied = "PENDING", {}
    for seq, expected, new in rows:
        applied[seq] = expected == now
        now = new if applied[seq] else now
    assert {r.order_id: r.status for r in changed.table.collect()} == {"o": now, "other": "FAILED"}
    assert {r.seq: r.applied for r in changed.outcome.collect()} == applied
    nothing = mutations.update_status(orders_frame(spark, [("o", "PENDING")]), updates.limit(0))
    assert nothing.outcome.count() == 0 and [r.status for r in nothing.table.collect()] == ["PENDING"]


def test_insert_if_absent_and_bulk_put(spark):
    target = spark.createDataFrame([("c", "a", "SHIPPED", 0)], "customer_id string, order_id string, status string, n int")
    incoming = spark.createDataFrame(
        [("c", "a", "PENDING", 1), ("c", "b", "PENDING", 2), ("c", "b", "CONFIRMED", 3)],
        "customer_id string, order_id string, status string, n int",
    )
    changed = mutations.insert_if_absent(target, incoming, ["customer_id", "order_id"], "n")
    assert sorted(map(tuple, changed.table.collect())) == [("c", "a", "SHIPPED", 0), ("c", "b", "PENDING", 2)]
    assert {r.n: (r.created, r.stored_status) for r in changed.outcome.collect()} == {
        1: (False, "SHIPPED"), 2: (True, "PENDING"), 3: (False, "PENDING")}
    put = mutations.bulk_put(target, incoming, ["order_id"], "n")
    assert sorted(map(tuple, put.collect())) == [("c", "a", "PENDING", 1), ("c", "b", "CONFIRMED", 3)]


def test_zero_amount_fails_payment(spark):
    orders = orders_frame(spark, [("a", "PENDING"), ("b", "PENDING"), ("c", "PENDING")])
    results = spark.createDataFrame(
        [("a", True, 10.0, AT), ("b", True, 0.0, AT)], "order_id string, approved boolean, amount double, settled_at timestamp"
    )
    table = mutations.apply_payments(orders, results).table
    assert {r.order_id: r.payment_state for r in table.collect()} == {"a": "CAPTURED", "b": "FAILED", "c": "PENDING"}


STOCK = "store_sku string, quantity_available int, quantity_reserved int"
LINES = "order_id string, order_ts timestamp, store_sku string, sku string, quantity int"


def line(order, minute, sku, quantity):
    return (order, AT + dt.timedelta(minutes=minute), f"S#{sku}", sku, quantity)


def test_snapshot_check_cases(spark):
    stock = spark.createDataFrame([("S#a", 100, 10), ("S#b", 5, 3), ("S#c", 1, 0), ("S#d", 4, None)], STOCK)
    lines = spark.createDataFrame(
        [line("ok", 0, "a", 5), line("short", 0, "b", 10), line("one", 0, "c", 10), line("null", 0, "d", 4),
         line("nostock", 0, "z", 1)], LINES)
    got = {r.order_id: r for r in inventory.snapshot_check(lines, stock).collect()}
    assert got["ok"].reserved and got["null"].reserved
    assert {o: r.failed_lines for o, r in got.items()} == {"ok": 0, "null": 0, "short": 1, "one": 1, "nostock": 1}
    assert {tuple(r) for r in inventory.shortages(lines, stock).collect()} == {
        ("short", "b", 10, 2), ("one", "c", 10, 1), ("nostock", "z", 1, 0)}


def one_by_one(lines, stock, kept=lambda order: True):
    left, want = dict(stock), {}
    for order in sorted({x[0] for x in lines}):
        need: dict[str, int] = {}
        for o, _, sku, _, q in lines:
            if o == order:
                need[sku] = need.get(sku, 0) + q
        want[order] = all(left.get(k, 0) >= q for k, q in need.items())
        if want[order] and kept(order):
            for k, q in need.items():
                left[k] -= q
    return want, left


@pytest.mark.parametrize("store_lines", [inventory.STORE_LINES, 100, 0])
@pytest.mark.parametrize("seed", range(2))
def test_reservation_equals_trying_orders_one_by_one(spark, seed, store_lines, monkeypatch):
    monkeypatch.setattr(inventory, "STORE_LINES", store_lines)
    rng = random.Random(seed)
    stock = {f"{store}#{i}": rng.randrange(5, 60) for store in "ST" for i in range(6)}
    lines = []
    for o in range(110):
        skus = rng.sample(range(7), rng.randrange(1, 4))
        skus = [0, *skus] if rng.random() < 0.5 else skus  # one hot stock row
        store = "T" if o % 5 == 0 else "S"
        lines += [(f"o{o:03d}", AT + dt.timedelta(minutes=o // 4), f"{store}#{s}", str(s), rng.randrange(1, 9)) for s in skus]
    if seed:  # an order of two stores ties them together
        lines += [("o050", AT + dt.timedelta(minutes=12), f"{store}#1", "1", 3) for store in "ST"]
    rows = spark.createDataFrame(lines, LINES)
    verdicts = inventory.reserve_in_order(rows, spark.createDataFrame([(k, v, None) for k, v in stock.items()], STOCK))
    got = {r.order_id: r.reserved for r in verdicts.collect()}
    want, _ = one_by_one(lines, stock)
    assert got == want
    assert 0 < sum(want.values()) < len(want)
    # Every third order gives its stock back at once.
    given_back = rows.withColumn("keeps", F.substring("order_id", 2, 3).cast("int") % 3 != 0)
    verdicts = inventory.reserve_in_order(given_back, spark.createDataFrame([(k, v, None) for k, v in stock.items()], STOCK))
    kept, _ = one_by_one(lines, stock, lambda order: int(order[1:]) % 3 != 0)
    assert {r.order_id: r.reserved for r in verdicts.collect()} == kept and sum(kept.values()) > sum(want.values())


def test_fulfilment_gives_the_stock_of_failed_payments_back(spark):
    rng = random.Random(9)
    stock = {f"S#{i}": rng.randrange(5, 40) for i in range(4)}
    lines = [line(f"o{o:03d}", o // 3, s, rng.randrange(1, 9)) for o in range(60) for s in rng.sample(range(4), 2)]
    names = sorted({x[0] for x in lines})
    status = {o: "SHIPPED" if o.endswith("7") else "PENDING" for o in names}
    orders = spark.createDataFrame([(o, "C", status[o], 10.0, AT) for o in names],
                                   "order_id string, customer_id string, status string, total double, updated_at timestamp")
    messages = spark.createDataFrame([(o,) for o in names if not o.endswith("3")] + [("none",)], "order_id string")
    paid = {o: rng.random() < 0.6 for o in names}
    payments = spark.createDataFrame([(o, "CAPTURED" if p else "FAILED") for o, p in paid.items() if not o.endswith("5")],
                                     "order_id string, payment_result string")
    done = fulfilment.fulfil_orders(
        orders, messages, spark.createDataFrame([(a, b, c, str(d), e) for a, b, c, d, e in lines], LINES),
        spark.createDataFrame([(k, v, None) for k, v in stock.items()], STOCK), payments, F.lit(AT))
    ok = lambda o: paid[o] and not o.endswith("5")
    worked = [x for x in lines if status[x[0]] == "PENDING" and not x[0].endswith("3")]
    want, left = one_by_one(worked, stock, ok)
    reason = {o: None if r and ok(o) else "Payment processing failed" if r else "Inventory reservation failed" for o, r in want.items()}
    assert {r.order_id: r.reason for r in done.outcome.collect()} == reason and len(set(reason.values())) == 3
    assert {r.order_id for r in done.orders.where("status = 'CONFIRMED'").collect()} == {o for o, r in reason.items() if r is None}
    assert {r.store_sku: r.quantity_available - (r.quantity_reserved or 0) for r in done.stock.collect()} == left
    assert min(left.values()) >= 0
    assert {r.order_id for r in done.held.collect()} == {o for o, r in reason.items() if r is None}


def test_reservations_never_exceed_stock_and_release_gives_back(spark):
    stock = spark.createDataFrame([("S#a", 10, 2), ("S#b", 3, None)], STOCK)
    lines = spark.createDataFrame(
        [line("o1", 1, "a", 6), line("o2", 2, "a", 3), line("o3", 3, "a", 2), line("o3", 3, "b", 3)], LINES)
    held = inventory.reservations(lines, inventory.reserve_in_order(lines, stock), F.lit(AT)).cache()
    after = inventory.add_reservations(stock, held)
    assert {r.store_sku: r.quantity_reserved for r in after.collect()} == {"S#a": 10, "S#b": 3}
    assert held.select("reservation_id").distinct().count() == 3
    failed = spark.createDataFrame([("o1",)], "order_id string")
    back, marked = inventory.release(after, held, failed, F.lit(AT))
    assert {r.store_sku: r.quantity_reserved for r in back.collect()} == {"S#a": 4, "S#b": 3}
    assert {(r.order_id, r.status) for r in marked.collect()} == {("o1", "RELEASED"), ("o3", "PENDING")}


def test_settle(spark):
    orders = spark.createDataFrame(
        [(o, "C", s, 10.0, AT) for o, s in [("ok", "PENDING"), ("short", "PENDING"), ("declined", "PENDING"), ("done", "SHIPPED")]],
        "order_id string, customer_id string, status string, total double, updated_at timestamp")
    messages = spark.createDataFrame([(o,) for o in ("ok", "short", "declined", "done", "none", "ok")], "order_id string")
    reserved = spark.createDataFrame([("ok", True), ("short", False), ("declined", True)], "order_id string, reserved boolean")
    paid = spark.createDataFrame([("ok", "CAPTURED"), ("declined", "FAILED")], "order_id string, payment_result string")
    changed = fulfilment.settle_orders(orders, messages, reserved, paid, F.lit(AT))
    assert {r.order_id: r.status for r in changed.table.collect()} == {
        "ok": "CONFIRMED", "short": "FAILED", "declined": "FAILED", "done": "SHIPPED"}
    assert {r.order_id: (r.status, r.reason) for r in changed.outcome.collect()} == {
        "ok": ("CONFIRMED", None), "short": ("FAILED", "Inventory reservation failed"),
        "declined": ("FAILED", "Payment processing failed")}


def test_a_stored_row_without_status_is_present(spark):
    stored = spark.createDataFrame([("a", None, None)], "order_id string, status string, updated_at timestamp")
    incoming = spark.createDataFrame([("a", "PENDING", None, 1), ("b", "PENDING", None, 2), (None, "PENDING", None, 3)],
                                     "order_id string, status string, updated_at timestamp, n int")
    result = mutations.insert_if_absent(stored, incoming, ["order_id"], "n")
    assert {(r.order_id, r.created, r.stored_status) for r in result.outcome.collect()} == {
        ("a", False, None), ("b", True, "PENDING"), (None, False, None)}
    assert sorted(r.order_id for r in result.table.collect()) == ["a", "b"]
    requests = spark.createDataFrame([("a", None), ("z", None)], "order_id string, seen_status string")
    codes = mutations.cancel_orders(stored, requests, F.current_timestamp()).outcome.collect()
    assert {(r.order_id, r.status_code) for r in codes} == {("a", 409), ("z", 404)}
    messages = spark.createDataFrame([("a",), ("z",)], "order_id string")
    assert {(r.order_id, r.outcome) for r in fulfilment.classify_messages(messages, stored).collect()} == {
        ("a", "already_processed"), ("z", "not_found")}
