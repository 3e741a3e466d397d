from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyman.operators import access, intake, pricing

AT = dt.datetime(2024, 5, 1, 12)
ITEM = {"sku": "SKU-001", "name": "Test Wine", "quantity": 2, "unit_price": 25.0}
REQUEST = {
    "customer_id": "CUST-001", "store_id": "STORE-001", "county_id": "COUNTY-001", "items": [ITEM],
    "shipping_address": {"street": "123 Test St", "city": "Test City", "state": "TX", "zip": "12345"},
}


def checked(spark, rows):
    """rows: (body or None, idempotency key)"""
    data = [(f"R{i}", AT + dt.timedelta(minutes=i), key, body) for i, (body, key) in enumerate(rows)]
    df = spark.createDataFrame(data, "request_id string, received_at timestamp, idempotency_key string, body string")
    return intake.validate_requests(intake.parse_requests(df))


def errors(spark, body, key="test-idempotency-key"):
    text = body if body is None or isinstance(body, str) else json.dumps(body)
    row = checked(spark, [(text, key)]).first()
    return [(e.field, e.code) for e in row.errors]


def test_good_request_and_unknown_keys(spark):
    assert errors(spark, REQUEST) == []
    assert errors(spark, {**REQUEST, "extra": {"x": 1}, "items": [{**ITEM, "note": "hi"}]}) == []


@pytest.mark.parametrize(
    "body, expected",
    [
        (None, [("body", "required")]),
        ("", [("body", "required")]),
        ("{invalid: data}", [("body", "invalid_json")]),
        ("5", [("", "invalid_type")]),
        ({**REQUEST, "customer_id": "", "items": []}, [("customer_id", "too_small"), ("items", "too_small")]),
        (
            {**REQUEST, "items": [ITEM, {**ITEM, "quantity": -0.5, "sku": 7}]},
            [("items.1.sku", "invalid_type"), ("items.1.quantity", "invalid_type"), ("items.1.quantity", "too_small")],
        ),
        ({**REQUEST, "items": {"0": ITEM}}, [("items", "invalid_type")]),
        ({**REQUEST, "shipping_address": []}, [("shipping_address", "invalid_type")]),
        (
            {},
            [("customer_id", "invalid_type"), ("store_id", "invalid_type"), ("county_id", "invalid_type"),
             ("items", "invalid_type"), ("shipping_address", "invalid_type")],
        ),
    ],
)
def test_bad_requests(spark, body, expected):
    assert errors(spark, body) == expected


def test_missing_key_is_reported_alone(spark):
    assert errors(spark, {"invalid": "data"}, key=None) == [("idempotency_key", "required")]
    assert errors(spark, {"invalid": "data"}, key="") == [("idempotency_key", "required")]


def test_totals(spark):
    items = "array<struct<sku:string,name:string,quantity:int,unit_price:decimal(18,2)>>"
    df = spark.createDataFrame([(1, "[]")], "id int, x string")
    def totals(lines):
        text = json.dumps([{"sku": f"S{i}", "name": "n", "quantity": q, "unit_price": p} for i, (q, p) in enumerate(lines)])
        row = pricing.price_orders(df.select(F.from_json(F.lit(text), items).alias("items"))).first()
        return float(row.subtotal), float(row.tax), float(row.total)

    assert totals([(2, 10.0), (1, 25.0)]) == (45.0, 3.6, 48.6)
    assert totals([(2, 25.0), (6, 8.0)]) == (98.0, 7.84, 105.84)
    assert totals([]) == (0.0, 0.0, 0.0)


def test_repeated_key_returns_the_first_and_conflicts_are_seen(spark):
    other = {**REQUEST, "items": [{**ITEM, "quantity": 3}]}
    turned = json.dumps(dict(reversed(REQUEST.items())))
    rows = checked(spark, [
        (json.dumps(REQUEST), "same-key-1"), (turned, "same-key-1"), (json.dumps(other), "other-key-2"),
        (json.dumps(REQUEST), "other-key-2"),
    ])
    good = intake.accepted(rows)
    outcome = {r.request_id: (r.status_code, r.first_request_id, r.message) for r in intake.idempotent_intake(good).collect()}
    assert outcome["R0"] == (201, "R0", None)
    assert outcome["R1"] == (200, "R0", "Order already exists (idempotent)")
    assert [r.idempotency_key for r in intake.idempotency_conflicts(good).collect()] == ["other-key-2"]
    orders = intake.build_orders(intake.idempotent_intake(good).where("created")).collect()
    assert sorted((float(o.total), o.status, o.payment_state) for o in orders) == [
        (54.0, "PENDING", "PENDING"), (81.0, "PENDING", "PENDING")]
    assert len({o.order_id for o in orders}) == 2


def test_limit_argument():
    assert access.check_limit(None) == 20 and access.check_limit("100") == 100
    for bad in ("0", "200", "x", 101, 2.5):
        with pytest.raises(ValueError):
            access.check_limit(bad)
    with pytest.raises(ValueError):
        access.list_arguments({"limit": "5"})
    assert access.list_arguments({"customer_id": "C"}) == {"customer_id": "C", "limit": 20, "token": None}


def test_end_without_start(spark):
    df = spark.range(1).withColumn("order_ts", F.lit(AT))
    end = F.lit(AT) - F.expr("interval 1 day")
    assert access.in_time_range(df, None, end).count() == 1
    with pytest.raises(ValueError):
        access.in_time_range(df, None, end, strict=True)


def test_paging_visits_every_order_once(spark):
    rows = [("C", f"2024-01-{d:02d}T00:00:00.000Z#ORD-{d}") for d in range(1, 8)]
    orders = spark.createDataFrame(rows + [("D", "x")], "customer_id string, order_ts_id string")
    seen, token = [], None
    for _ in range(5):
        page = access.customer_history(orders, "C", 3, token)
        seen += [r.order_ts_id for r in page.collect()]
        token = access.next_token(page, 3).first()[0]
        if token is None:
            break
    assert seen == sorted((r[1] for r in rows), reverse=True)


def test_numbers_that_records_cannot_hold_are_errors_not_nulls(spark):
    def item(**changes):
        return json.dumps({**REQUEST, "items": [{**ITEM, **changes}]})

    rows = [(item(quantity=3_000_000_000), "key-00000001"), (item(unit_price=1e17), "key-00000002"),
            (item(quantity=3, unit_price=0.004), "key-00000003"), (item(quantity=3, unit_price=1.005), "key-00000004"),
            (item(quantity=2_000_000_000, unit_price=1e14), "key-00000005")]
    validated = checked(spark, rows)
    assert [[(e.field, e.code) for e in r.errors] for r in validated.orderBy("request_id").collect()] == [
        [("items.0.quantity", "too_big")], [("items", "too_big"), ("items.0.unit_price", "too_big")], [], [],
        [("items", "too_big")]]
    built = intake.build_orders(intake.accepted(validated)).orderBy("request_id").collect()
    assert [float(r.subtotal) for r in built] == [0.01, 3.02] and all(r.total is not None for r in built)


def test_items_and_parts_of_a_request_are_read_by_one_cast_each(spark):
    plan = checked(spark, [("{}", "key-00000001")])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "array<variant>" not in plan and "$.unit_price" not in plan


def test_odd_items_keep_their_places(spark):
    items = [ITEM, None, 5, [], {}, {**ITEM, "sku": None, "quantity": "2", "unit_price": True}]
    row = checked(spark, [(json.dumps({**REQUEST, "items": items}), "key-00000001")]).first()
    assert [e.field for e in row.errors] == [
        "items.1", "items.2", "items.3", *[f"items.4.{name}" for name in ITEM], "items.5.sku", "items.5.quantity",
        "items.5.unit_price"]
    assert {e.code for e in row.errors} == {"invalid_type"}
    read = [None if x is None else x.asDict() for x in row.request["items"]]
    assert len(read) == 6 and read[1] == read[2] == read[3] == dict.fromkeys(ITEM) and read[5]["sku"] is None
