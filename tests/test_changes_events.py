from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyman.operators import changes, events, legacy
from tallyman.schemas import CHANGE, EVENT_LABELS
from tallyman.sources import feeds, model

AT = dt.datetime(2024, 5, 1, 12)


def image(order_id, status="PENDING", payment="PENDING", items=((("A", 1),)), updated=AT, customer="C"):
    lines = [{"sku": s, "name": f"name {s}", "quantity": q, "unit_price": None, "total_price": None} for s, q in items]
    return {
        "customer_id": customer, "order_id": order_id, "status": status, "payment_state": payment, "items": lines,
        "store_id": "S", "county_id": "K", "created_at": AT, "updated_at": updated,
        "shipping_address": {"street": "st", "city": "ci", "state": "TX", "zip": "12345"},
    }


def feed(spark, records):
    """records: (order_id, seq, op, new, old)"""
    rows = []
    schema = spark.createDataFrame([], CHANGE).schema
    names = schema["new_image"].dataType.names

    def full(img):
        return None if img is None else {n: img.get(n) for n in names}

    for order_id, seq, op, new, old in records:
        rows.append({"event_id": f"{order_id}:{seq}", "seq": seq, "op": op, "changed_at": AT + dt.timedelta(minutes=seq),
                     "new_image": full(new), "old_image": full(old)})
    return spark.createDataFrame(rows, schema).withColumn(
        "order_id", F.coalesce("new_image.order_id", "old_image.order_id"))


def kinds(df):
    return sorted((r.event_id, r.detail.event_type) for r in df.collect())


def test_event_rules(spark):
    p = image("o")
    data = feed(spark, [
        ("o", 1, "INSERT", p, None),
        ("o", 2, "MODIFY", image("o", "CONFIRMED", "CAPTURED"), p),
        ("o", 3, "MODIFY", image("o", "CONFIRMED", "CAPTURED"), image("o", "CONFIRMED", "CAPTURED")),
        ("o", 4, "MODIFY", image("o", None), p),
        ("o", 5, "MODIFY", None, p),
        ("o", 6, "REMOVE", None, p),
        ("o", 7, "INSERT", None, None),
    ])
    expected = [("o:1", "ORDER_CREATED"), ("o:2", "ORDER_CONFIRMED"), ("o:2", "ORDER_STATUS_CHANGED"),
                ("o:2", "PAYMENT_STATE_CHANGED"), ("o:4", "ORDER_STATUS_CHANGED")]
    assert kinds(changes.derive_events(data)) == expected
    every = changes.derive_events(data, ops=("INSERT", "MODIFY", "REMOVE"))
    assert kinds(every) == [*expected, ("o:6", "ORDER_DELETED")]
    assert {EVENT_LABELS[r.detail.event_type] == r.detail_type for r in every.collect()} == {True}


def test_decode_is_the_inverse_of_encode(spark, sf_dir):
    source = model.changes(spark, sf_dir).drop("orderkey", "order_id")
    back = changes.decode_changes(feeds.encode_changes(source)).select(source.columns)
    assert back.exceptAll(source).isEmpty() and source.exceptAll(back).isEmpty()


def flat(spark, raw):
    text = raw if isinstance(raw, str) else json.dumps(raw)
    df = spark.createDataFrame([("r", text)], "record_id string, t string").select(
        "record_id", F.base64(F.encode("t", "UTF-8")).alias("data"))
    return events.flatten_events(df, F.lit("2024-06-01 00:00:00").cast("timestamp")).first()


def test_flatten_rules(spark):
    row = flat(spark, {"time": "2024-01-02T03:04:05Z", "detail-type": "Order Created",
                       "detail": {"order_id": "o", "new_status": "SHIPPED", "new_state": "CAPTURED", "total": "12",
                                  "tax": 1.5, "items": [{"a": 1}, {"b": 2}], "store_id": "", "created_at": "soon"},
                       "customer_id": "outside"})
    assert row.result == "Ok" and row.event_type == "Order Created" and row.order_id == "o"
    assert row.customer_id == "" and row.store_id is None and row.status == "SHIPPED" and row.payment_state == "CAPTURED"
    assert row.total is None and row.tax == 1.5 and row.item_count == 2
    assert row.event_timestamp == "2024-01-02 03:04:05.000" and row.created_at == "soon"
    bare = flat(spark, {"event_type": "X", "status": "PENDING", "new_status": "Y", "item_count": 4, "items": [1]})
    assert (bare.event_type, bare.status, bare.item_count) == ("X", "PENDING", 4)
    assert bare.event_timestamp == "2024-06-01 00:00:00.000"
    unknown = flat(spark, {"detail": None})
    assert unknown.result == "Ok" and unknown.event_type == "UNKNOWN" and unknown.order_id == ""


@pytest.mark.parametrize("text, error", [("{broken", "bad_json"), ("null", "no_event")])
def test_failed_records_keep_their_data(spark, text, error):
    row = flat(spark, text)
    assert row.result == "ProcessingFailed" and row.error_type == error and row.data and row.event_type is None


def test_forwarded_stamp_does_not_change_lake_rows(spark, sf_dir):
    some = changes.derive_events(model.changes(spark, sf_dir))
    plain = some.select(F.concat_ws(":", "event_id", "detail.event_type").alias("record_id"),
                        F.base64(F.encode(events.envelope(some), "UTF-8")).alias("data"))
    now = F.lit(AT)
    with_stamp = events.lake_rows(events.flatten_events(events.forward(some), now))
    without = events.lake_rows(events.flatten_events(plain, now))
    assert with_stamp.exceptAll(without).isEmpty() and without.exceptAll(with_stamp).isEmpty()


def replay(target, items, records):
    """Sequential model of the dual write."""
    orders, lines = {k: dict(v) for k, v in target.items()}, {k: dict(v) for k, v in items.items()}
    for order_id, seq, op, new, old in records:
        if op in ("INSERT", "MODIFY") and new:
            row = orders.setdefault(order_id, {"customer_id": new["customer_id"]})
            row.update(status=new["status"], payment_state=new["payment_state"], updated_at=new["updated_at"])
            for item in new["items"]:
                line = lines.setdefault((order_id, item["sku"]), {"name": item["name"]})
                line["quantity"] = item["quantity"]
        elif op == "REMOVE" and old and order_id in orders:
            orders[order_id].update(status="DELETED", updated_at=AT + dt.timedelta(minutes=seq))
    return orders, lines


def legacy_frames(spark, target, items):
    cols = legacy.LEGACY_ORDER_COLUMNS
    types = {"created_at": "timestamp", "updated_at": "timestamp", "subtotal": "decimal(18,2)", "tax": "decimal(21,4)",
             "total": "decimal(23,4)"}
    orders = spark.createDataFrame(
        [tuple({**v, "order_id": k}.get(c) for c in cols) for k, v in target.items()],
        ", ".join(f"{c} {types.get(c, 'string')}" for c in cols))
    lines = spark.createDataFrame(
        [(k[0], k[1], v["name"], v["quantity"], None, None) for k, v in items.items()],
        "order_id string, sku string, name string, quantity int, unit_price decimal(18,2), total_price decimal(18,2)")
    return orders, lines


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_sequential_replay_and_is_idempotent(spark, seed):
    rng = random.Random(seed)
    target = {f"o{i}": {"customer_id": "old", "status": "PENDING", "payment_state": "PENDING", "updated_at": AT} for i in range(3)}
    items = {("o0", "A"): {"name": "old A", "quantity": 9}, ("o1", "Z"): {"name": "old Z", "quantity": 9}}
    records = []
    for o in range(7):
        for seq in range(1, rng.randrange(2, 8)):
            op = rng.choice(["INSERT", "MODIFY", "MODIFY", "REMOVE"])
            lines = tuple((s, rng.randrange(1, 9)) for s in rng.sample("ABCD", rng.randrange(0, 3)))
            img = image(f"o{o}", rng.choice(["PENDING", "SHIPPED"]), rng.choice(["PENDING", "CAPTURED"]), lines,
                        AT + dt.timedelta(hours=seq), f"customer {seq}")
            empty = rng.random() < 0.15
            new = None if op == "REMOVE" or empty else img
            old = img if op == "REMOVE" and not empty else None
            records.append((f"o{o}", seq, op, new, old))
    data = feed(spark, records)
    orders, lines = legacy_frames(spark, target, items)
    want_orders, want_lines = replay(target, items, records)

    def check(got_orders, got_lines):
        assert {r.order_id: (r.customer_id, r.status, r.payment_state, r.updated_at) for r in got_orders.collect()} == {
            k: (v["customer_id"], v["status"], v["payment_state"], v["updated_at"]) for k, v in want_orders.items()}
        assert {(r.order_id, r.sku): (r.name, r.quantity) for r in got_lines.collect()} == {
            k: (v["name"], v["quantity"]) for k, v in want_lines.items()}

    once = legacy.upsert_orders(orders, data), legacy.upsert_items(lines, data)
    check(*once)
    if not any(r[2] == "REMOVE" for r in records):
        check(legacy.upsert_orders(once[0], data), legacy.upsert_items(once[1], data))
    # Repeated deliveries change nothing.
    check(legacy.upsert_orders(orders, data.unionByName(data)), legacy.upsert_items(lines, data.unionByName(data)))


def test_null_status_is_not_backfilled_and_no_items_give_an_empty_array(spark):
    orders, items = legacy_frames(spark, {
        "a": {"status": None}, "b": {"status": "DELETED"}, "c": {"status": "PENDING", "created_at": AT}}, {})
    rows = legacy.nest_orders(orders, items).collect()
    assert [(r.order_id, r["items"], r.idempotency_key, r.order_ts_id) for r in rows] == [
        ("c", [], "backfill-c", "2024-05-01T12:00:00.000Z#c")]


def test_an_order_with_very_many_items_is_one_document(spark):
    orders, _ = legacy_frames(spark, {"big": {"status": "PENDING", "created_at": AT, "total": Decimal(5)},
                                      "small": {"status": "PENDING", "created_at": AT, "total": Decimal(7)}}, {})
    items = {("big", f"S{i:05d}"): {"name": "n", "quantity": 1} for i in range(6000)}
    items[("small", "A")] = {"name": "n", "quantity": 1}
    rows = {r.order_id: r for r in legacy.nest_orders(orders, legacy_frames(spark, {}, items)[1]).collect()}
    assert len(rows) == 2 and len(rows["big"]["items"]) == 6000 and len(rows["small"]["items"]) == 1
    assert [float(rows[o].total) for o in ("big", "small")] == [5.0, 7.0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_derived_in_compiled_code(spark, sf_dir):
    """A lambda in the feed or in the events would be evaluated row by row outside of the compiled stage."""
    derived = changes.derive_events(model.changes(spark, sf_dir), ops=("INSERT", "MODIFY", "REMOVE"))
    assert "lambda" not in plan_of(derived)


def test_one_change_gives_all_its_events_with_their_own_fields(spark):
    paid = image("O", "CONFIRMED", "CAPTURED", items=(("A", 2),))
    rows = changes.derive_events(feed(spark, [("O", 2, "MODIFY", paid, image("O"))])).collect()
    assert [r["detail"]["event_type"] for r in rows] == ["ORDER_STATUS_CHANGED", "ORDER_CONFIRMED", "PAYMENT_STATE_CHANGED"]
    assert [r["detail_type"] for r in rows] == [EVENT_LABELS[r["detail"]["event_type"]] for r in rows]
    told = [{k for k, v in r["detail"].asDict().items() if v is not None} for r in rows]
    common = {"event_type", "order_id", "customer_id", "timestamp"}
    assert told[0] == common | {"store_id", "county_id", "old_status", "new_status"}
    assert told[1] == common | {"store_id", "county_id", "items", "shipping_address"}
    assert told[2] == common | {"old_state", "new_state"}


def test_a_record_is_parsed_once_for_its_error(spark):
    records = spark.createDataFrame([("R", "e30=")], "record_id string, data string")
    assert plan_of(events.decode_records(records)).count("parseJson") == 1
