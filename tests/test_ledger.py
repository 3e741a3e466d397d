"""Reservations that end, against trying the orders one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyman.operators import inventory, ledger

START = dt.datetime(2024, 5, 1)
LINES = "order_id string, order_ts timestamp, store_sku string, quantity int, until timestamp"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def one_by_one(lines, stock):
    """The model: every hold is a row of a list, and is looked at again for each order."""
    orders, holds, verdicts = {}, [], {}
    for order_id, when, sku, quantity, until in lines:
        orders.setdefault((when, order_id), []).append((sku, quantity, until))
    for (when, order_id), asked in sorted(orders.items()):
        wanted = {}
        for sku, quantity, _ in asked:
            wanted[sku] = wanted.get(sku, 0) + quantity
        free = {s: stock.get(s, 0) - sum(q for h, q, end in holds if h == s and (end is None or end > when)) for s in wanted}
        verdicts[order_id] = all(free[s] >= q for s, q in wanted.items())
        if verdicts[order_id]:
            holds += [(s, q, u) for s, q, u in asked if u is None or u > when]
    return verdicts


def stock_table(spark, stock):
    return spark.createDataFrame([(k, v, 0) for k, v in stock.items()], "store_sku string, quantity_available int, quantity_reserved int")


def found(df):
    return {r["order_id"]: r["reserved"] for r in df.collect()}


@pytest.mark.parametrize("store_lines", [0, 25, 500])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_by_one(spark, seed, store_lines):
    rng, lines = random.Random(seed), []
    for n in range(60):
        when = rng.randrange(90)
        until = rng.choice([None, at(when), at(when + 1), at(when + 5), at(when + 30)])
        store = rng.randrange(3) if n % 15 else "mixed"
        for _ in range(rng.randrange(1, 4)):
            shop = rng.randrange(3) if store == "mixed" and seed == 2 else store
            lines.append((f"ORD-{n:026d}", at(when), f"S{shop}#{rng.choice('ab')}", rng.randrange(1, 6), until))
    stock = {f"S{s}#{k}": 9 for s in (0, 1, "mixed") for k in "ab"} | {"S2#a": 7}
    got = ledger.reserve_over_time(spark.createDataFrame(lines, LINES), stock_table(spark, stock), store_lines)
    want = one_by_one(lines, stock)
    assert found(got) == want and got.count() == len(want) and set(want.values()) == {True, False}


def test_expiry_between_two_orders(spark):
    lines = [("o1", at(0), "S#a", 5, at(30)), ("o2", at(29), "S#a", 5, None), ("o3", at(30), "S#a", 5, None), ("o4", at(90), "S#a", 1, None)]
    frame = spark.createDataFrame(lines, LINES)
    for store_lines in (0, 500):
        got = ledger.reserve_over_time(frame, stock_table(spark, {"S#a": 5}), store_lines)
        assert found(got) == {"o1": True, "o2": False, "o3": True, "o4": False}
    levels = ledger.held_over_time(frame, got).orderBy("at").collect()
    assert [(r["at"], r["held"]) for r in levels] == [(at(0), 5), (at(30), 5)]


def test_without_ends_it_is_reservation_in_order(spark):
    rng = random.Random(5)
    lines = [(f"ORD-{n:026d}", at(rng.randrange(9)), f"S{rng.randrange(2)}#{rng.choice('abc')}", rng.randrange(1, 5), None) for n in range(40)]
    frame, stock = spark.createDataFrame(lines, LINES), stock_table(spark, {f"S{s}#{k}": 11 for s in range(2) for k in "ab"})
    assert found(ledger.reserve_over_time(frame, stock)) == found(inventory.reserve_in_order(frame.drop("until"), stock))


def test_never_more_held_than_there_is(spark):
    rng = random.Random(8)
    lines = [(f"o{n:03d}", at(n // 2), "S#a", rng.randrange(1, 4), rng.choice([at(n), at(n + 9), None])) for n in range(80)]
    frame = spark.createDataFrame(lines, LINES)
    verdicts = ledger.reserve_over_time(frame, stock_table(spark, {"S#a": 20}))
    levels = ledger.held_over_time(frame, verdicts).agg(F.min("held"), F.max("held")).first()
    assert levels[0] >= 0 and 15 < levels[1] <= 20


def test_no_orders_and_no_stock(spark):
    empty = spark.createDataFrame([], LINES)
    assert ledger.reserve_over_time(empty, stock_table(spark, {"S#a": 1})).count() == 0
    lines = spark.createDataFrame([("o", at(0), "S#z", 1, None), ("p", at(0), None, 1, None)], LINES)
    assert found(ledger.reserve_over_time(lines, stock_table(spark, {"S#a": 1}))) == {"o": False}


def test_a_store_leaves_the_rounds_when_few_of_its_lines_are_left(spark, monkeypatch):
    chain = [(f"o{n:02d}", at(n), "S#a", 3, at(n + 2)) for n in range(20)]
    pairs = [(f"p{s}{n}", at(n), f"S#b{s}", 5, None) for s in range(8) for n in range(2)]
    stock = {"S#a": 5} | {f"S#b{s}": 9 for s in range(8)}
    stored = []
    cut = ledger.cut_lineage
    monkeypatch.setattr(ledger, "cut_lineage", lambda *args: stored.append(1) or cut(*args))
    got = ledger.reserve_over_time(spark.createDataFrame(chain + pairs, LINES), stock_table(spark, stock), 30)
    assert found(got) == one_by_one(chain + pairs, stock)
    # Sums, demand, first verdicts and open lines, then two tables for each of two rounds; the chain alone would take twenty.
    assert len(stored) <= 8
