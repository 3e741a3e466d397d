from __future__ import annotations

import datetime as dt
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from tallyman.functions import hashing, keys, ordered, text
from tallyman.functions.keys import id_time, is_order_id, sortable_id
from tallyman.operators.pricing import price_orders


def expected_hash(value: str) -> str:
    h = 0
    units = value.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i:i + 2], "big")) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    return format(abs(h), "x")


def test_rolling_hash_matches_a_direct_computation(spark):
    words = ["hello", "", "a", "zzzzzzzzzzzzzzzzzz", "Ünïcode", "pair 😀 of surrogates", '{"a":1,"b":[2,3]}']
    rows = spark.createDataFrame([(w,) for w in words], "s string").select("s", hashing.rolling_hash(F.col("s")).alias("h"))
    got = {r.s: r.h for r in rows.collect()}
    assert got["hello"] == "5e918d2"
    assert got == {w: expected_hash(w) for w in words}


def test_sortable_ids_fit_the_pattern_sort_by_time_and_repeat(spark):
    start = dt.datetime(2024, 1, 1)
    frame = spark.range(100).select(
        "id", (F.lit(start) + F.expr("make_dt_interval(0, 0, 0, cast(id as int))")).alias("ts")
    ).select("id", keys.sortable_id("ORD-", F.col("ts"), F.col("id")).alias("oid"))
    first = {r.id: r.oid for r in frame.collect()}
    assert len(set(first.values())) == 100
    assert all(re.fullmatch(r"ORD-[0-9A-HJKMNP-TV-Z]{26}", v) for v in first.values())
    assert [first[i] for i in range(100)] == sorted(first.values())
    assert first == {r.id: r.oid for r in frame.collect()}


def test_sort_key_round_trip_and_missing_part(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.678Z#ORD-1#tail",), ("no separator",)], "k string")
    at, order_id = keys.sort_key_parts(F.col("k"))
    assert [tuple(r) for r in df.select(at, order_id).collect()] == [
        ("2024-01-02T03:04:05.678Z", "ORD-1"), ("no separator", None),
    ]


def test_lake_time_renders_iso_and_passes_other_text(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.678Z",), ("2024-01-02T03:04:05+02:00",), ("soon",)], "t string")
    assert [r[0] for r in df.select(text.lake_time(F.col("t"))).collect()] == [
        "2024-01-02 03:04:05.678", "2024-01-02 01:04:05.000", "soon",
    ]


def test_bucketed_running_totals_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", n // 3, n, rng.randrange(10)) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, n int, v int")
    order = ["t", "n"]
    plain = ordered.running_totals(df, ["k"], order, {"s": "v"})
    bucketed = ordered.running_totals(
        df, ["k"], order, {"s": "v"}, [F.floor(F.col("t") / 20), F.floor(F.col("t") / 5)]
    )
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, bucketed.select(plain.columns).collect()))


def test_previous_value_across_buckets(spark):
    rows = [("a", n * n, f"v{n}") for n in range(30)] + [("b", 7, None), ("b", 8, "x")]
    df = spark.createDataFrame(rows, "k string, seq bigint, v string")
    got = ordered.previous_value(df, ["k"], "seq", "v", "before", F.floor(F.col("seq") / 50))
    found = {(r.k, r.seq): r.before for r in got.collect()}
    assert found[("a", 0)] is None and found[("b", 7)] is None and found[("b", 8)] is None
    assert all(found[("a", n * n)] == f"v{n - 1}" for n in range(1, 30))


def test_only_hot_keys_are_cut_into_buckets(spark):
    rows = [("hot", n // 3, n, n % 10) for n in range(300)] + [(f"k{n % 40}", n // 3, n, n % 7) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, n int, v int")
    few, many = ordered.split_hot(df, ["k"], key_rows=100)
    assert {r["k"] for r in many.select("k").distinct().collect()} == {"hot"}
    assert few.count() + many.count() == 500
    plain = ordered.running_totals(df, ["k"], ["t", "n"], {"s": "v"})
    buckets = [F.floor(F.col("t") / 20), F.floor(F.col("t") / 5)]
    for limit in (100, 1000):
        got = ordered.running_totals_of_stored(df, ["k"], ["t", "n"], {"s": "v"}, buckets, limit)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.select(plain.columns).collect()))
        before = ordered.previous_value_of_stored(df, ["k"], "n", "v", "before", F.floor(F.col("n") / 50), limit)
        found = {(r["k"], r["n"]): r["before"] for r in before.collect()}
        assert all(found["hot", n] == (None if n == 0 else (n - 1) % 10) for n in range(300))
        assert all(found[f"k{n % 40}", n] == (None if n < 40 else (n - 40) % 7) for n in range(200))
    empty = df.limit(0)
    assert ordered.running_totals_of_stored(empty, ["k"], ["t", "n"], {"s": "v"}, buckets, 1).count() == 0


def test_ids_tell_their_time(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 5, 1, 12, 0, 1), "k"), (dt.datetime(1999, 1, 2), "other")], "at timestamp, key string")
    made = rows.select("at", sortable_id("ORD-", F.col("at"), F.col("key"), F.lit(7)).alias("id")).orderBy("at")
    found = made.select("at", "id", id_time(F.col("id")).alias("time"), is_order_id(F.col("id")).alias("ok")).collect()
    assert all(r["at"] == r["time"] and r["ok"] and len(r["id"]) == 30 for r in found)
    assert found[0]["id"] < found[1]["id"]
    odd = spark.createDataFrame([("ORD-short",), ("",), (None,)], "id string").select(id_time(F.col("id")).alias("time"))
    assert {r["time"] for r in odd.collect()} == {None}


def test_totals_are_rounded_once(spark):
    item = "array<struct<sku:string,name:string,quantity:int,unit_price:decimal(18,6)>>"
    rows = spark.createDataFrame([([("a", "A", 3, Decimal("1.005"))],), ([("a", "A", 1, Decimal("0.004"))],), ([],)], f"items {item}")
    found = [(r["subtotal"], r["tax"], r["total"]) for r in price_orders(rows).collect()]
    assert found == [
        (Decimal("3.02"), Decimal("0.2412"), Decimal("3.2562")),
        (Decimal("0.00"), Decimal("0.0003"), Decimal("0.0043")),
        (Decimal("0.00"), Decimal("0.0000"), Decimal("0.0000")),
    ]
