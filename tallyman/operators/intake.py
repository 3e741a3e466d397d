"""Order intake: parse and validate JSON requests, price them, and apply idempotency."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import request_hash
from ..functions.keys import is_idempotency_key, sort_key, sortable_id
from ..functions.text import computed_once
from ..schemas import ADDRESS, ALREADY_EXISTS, ORDER_COLUMNS, REQUEST_ITEM, VALIDATION_FAILED
from .pricing import price_orders

ERRORS = "array<struct<field:string,code:string>>"
# What the records hold: whole numbers of 32 bits, prices of eight decimals, order values of 18 digits.
MOST_QUANTITY = 2**31 - 1
LEAST_PRICE, MOST_PRICE = 1e-8, 1e15
MOST_VALUE = 9e15

_ITEM_FIELDS = {"sku": "string", "name": "string", "quantity": "int", "unit_price": "decimal(26,8)"}


def _get(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def parse_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``document`` (the JSON value), ``parse_error`` and the typed ``request``.

    ``parse_error`` is ``required`` for an absent or empty body and ``invalid_json`` for text that is not JSON.
    Fields of the wrong type are null in ``request``; ``validate_requests`` reports them.
    """
    text = F.col(body)
    absent = text.isNull() | (text == "")
    parsed = computed_once(requests, "document", F.try_parse_json(text)).withColumn(
        "parse_error",
        F.when(absent, F.lit("required")).when(F.col("document").isNull(), F.lit("invalid_json")),
    )
    doc = F.col("document")
    # One cast reads all fields of all items; an item that is no object has none of them.
    nothing = F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in _ITEM_FIELDS.items()])
    kinds = ",".join(f"{name}:{kind}" for name, kind in _ITEM_FIELDS.items())
    items = F.transform(
        _get(doc, "items", f"array<struct<{kinds}>>"), lambda x: F.coalesce(x, nothing)
    ).cast(f"array<{REQUEST_ITEM}>")
    address = _get(doc, "shipping_address")
    place = F.struct(*[_get(address, part, "string").alias(part) for part in ("street", "city", "state", "zip")])
    return parsed.withColumn(
        "request",
        F.struct(
            _get(doc, "customer_id", "string").alias("customer_id"),
            _get(doc, "store_id", "string").alias("store_id"),
            _get(doc, "county_id", "string").alias("county_id"),
            items.alias("items"),
            place.cast(ADDRESS).alias("shipping_address"),
        ),
    )


def _error(field: Column | str, code: str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(field.alias("field"), F.lit(code).alias("code"))


def _type_of(value: Column) -> Column:
    """Type name of a JSON value, empty text when the value is missing."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _typed(value: Column, kind: str, name: str) -> Column:
    """Type and content of a JSON value, so that the rules look at plain columns."""
    return F.struct(_type_of(value).alias("type"), F.try_variant_get(value, "$", kind).alias("value")).alias(name)


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL(")


def _text_rules(field: Column | str, part: Column, least: int = 1, most: int | None = None) -> list[Column]:
    size = F.length(part["value"])
    is_text = part["type"] == "STRING"
    rules = [
        F.when(~is_text, _error(field, "invalid_type")),
        F.when(is_text & (size < least), _error(field, "too_small")),
    ]
    if most is not None:
        rules.append(F.when(is_text & (size > most), _error(field, "too_big")))
    return rules


def _positive_rules(field: Column | str, part: Column, whole: bool) -> list[Column]:
    """Numbers above zero that the record can hold."""
    number = part["value"]
    least, most = (1, MOST_QUANTITY) if whole else (LEAST_PRICE, MOST_PRICE)
    is_number = _is_number(part["type"])
    rules = [F.when(~is_number, _error(field, "invalid_type"))]
    if whole:
        rules.append(F.when(is_number & (number != F.floor(number)), _error(field, "invalid_type")))
    small = (number <= 0) if whole else (number < least)
    rules.append(F.when(is_number & small, _error(field, "too_small")))
    rules.append(F.when(is_number & (number > most), _error(field, "too_big")))
    return rules


_TOP_TEXTS = ("customer_id", "store_id", "county_id")
_ADDRESS_RULES = {"street": (1, None), "city": (1, None), "state": (2, 2), "zip": (5, 10)}
_ITEM_KINDS = {"sku": "string", "name": "string", "quantity": "double", "unit_price": "double"}


def _parts(value: Column, names: Iterable[str], path: str = "$", listed: bool = False) -> Column:
    """The named members of a JSON object as JSON values, read by one cast; null for what is no object."""
    record = f"struct<{','.join(f'{name}:variant' for name in names)}>"
    return F.try_variant_get(value, path, f"array<{record}>" if listed else record)


def _facts(doc: Column) -> Column:
    """Types and contents of all parts of a request the rules refer to.

    ``top``, ``address`` and an item are null unless they are objects, and ``items`` unless it is a list.
    """

    def typed(parts: Column, kinds: Mapping[str, str]) -> Column:
        return F.when(parts.isNotNull(), F.struct(*[_typed(parts[name], kind, name) for name, kind in kinds.items()]))

    top, address = _parts(doc, _TOP_TEXTS), _parts(doc, _ADDRESS_RULES, "$.shipping_address")
    items = _parts(doc, _ITEM_KINDS, "$.items", listed=True)
    return F.struct(
        typed(top, dict.fromkeys(_TOP_TEXTS, "string")).alias("top"),
        F.transform(items, lambda x: typed(x, _ITEM_KINDS)).alias("items"),
        typed(address, dict.fromkeys(_ADDRESS_RULES, "string")).alias("address"),
    )


def _value(items: Column) -> Column:
    """About what the items cost together."""
    return F.aggregate(
        items,
        F.lit(0.0),
        lambda total, x: total + F.coalesce(x["quantity"]["value"] * x["unit_price"]["value"], F.lit(0.0)),
    )


def _item_rules(item: Column, index: Column) -> Column:
    place = F.concat(F.lit("items."), index.cast("string"))

    def path(name: str) -> Column:
        return F.concat(place, F.lit(f".{name}"))

    fields = F.array(
        *_text_rules(path("sku"), item["sku"]),
        *_text_rules(path("name"), item["name"]),
        *_positive_rules(path("quantity"), item["quantity"], whole=True),
        *_positive_rules(path("unit_price"), item["unit_price"], whole=False),
    )
    return F.when(item.isNotNull(), fields).otherwise(F.array(_error(place, "invalid_type")))


def validate_requests(parsed: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Add ``errors`` (array of field and code), ``is_valid`` and ``key_well_formed``.

    A missing idempotency key rejects the request before its body is looked at. Keys of unusual length only
    clear ``key_well_formed``. Keys of the body the record does not know are ignored.
    """
    known = computed_once(parsed, "_facts", _facts(F.col("document")))
    facts, text = F.col("_facts"), F.col(key)
    is_list = facts["items"].isNotNull()
    item_errors = F.when(is_list, F.flatten(F.transform(facts["items"], _item_rules))).otherwise(
        F.array().cast(ERRORS)
    )
    address_fields = [
        rule for name, (least, most) in _ADDRESS_RULES.items()
        for rule in _text_rules(f"shipping_address.{name}", facts["address"][name], least, most)
    ]
    in_body = F.array_compact(
        F.concat(
            F.array(*[rule for name in _TOP_TEXTS for rule in _text_rules(name, facts["top"][name])]),
            F.array(
                F.when(~is_list, _error("items", "invalid_type")),
                F.when(is_list & (F.size(facts["items"]) == 0), _error("items", "too_small")),
                F.when(is_list & (_value(facts["items"]) > MOST_VALUE), _error("items", "too_big")),
            ),
            item_errors,
            F.when(facts["address"].isNotNull(), F.array(*address_fields)).otherwise(
                F.array(_error("shipping_address", "invalid_type"))
            ),
        )
    )
    errors = (
        F.when(text.isNull() | (text == ""), F.array(_error("idempotency_key", "required")))
        .when(F.col("parse_error") == "required", F.array(_error("body", "required")))
        .when(F.col("parse_error") == "invalid_json", F.array(_error("body", "invalid_json")))
        .when(facts["top"].isNull(), F.array(_error("", "invalid_type")))
        .otherwise(in_body)
        .cast(ERRORS)
    )
    return (
        computed_once(known, "errors", errors)
        .drop("_facts")
        .withColumn("is_valid", F.size("errors") == 0)
        .withColumn("key_well_formed", is_idempotency_key(text))
    )


def accepted(validated: DataFrame) -> DataFrame:
    """Valid requests with the record's fields as columns."""
    return validated.where("is_valid").select("request_id", "received_at", "idempotency_key", "request.*")


def rejected(validated: DataFrame) -> DataFrame:
    """Invalid requests with their raw text and an error report."""
    report = F.to_json(F.struct(F.lit(VALIDATION_FAILED).alias("message"), F.col("errors").alias("details")))
    return validated.where(~F.col("is_valid")).select(
        "request_id", "received_at", "idempotency_key", "body", "errors", report.alias("report")
    )


def build_orders(requests: DataFrame) -> DataFrame:
    """Accepted requests as new PENDING orders with ids, totals and keys."""
    order_id = sortable_id("ORD-", F.col("received_at"), F.col("customer_id"), F.col("request_id"))
    pending = F.lit("PENDING")
    return (
        price_orders(requests)
        .withColumn("order_id", order_id)
        .withColumns(
            {
                "order_ts": F.col("received_at"),
                "order_ts_id": sort_key(F.col("received_at"), F.col("order_id")),
                "status": pending,
                "payment_state": pending,
                "created_at": F.col("received_at"),
                "updated_at": F.col("received_at"),
                "ttl": F.lit(None).cast("bigint"),
            }
        )
        .select(*ORDER_COLUMNS, "request_id")
    )


def idempotent_intake(requests: DataFrame) -> DataFrame:
    """The first request per customer and idempotency key wins; every repeat points to it.

    Adds ``first_request_id``, ``created``, ``status_code`` (201 or 200) and ``message``. The first request
    is found by a partial aggregate, so a key repeated very often is reduced before the shuffle.
    """
    keys = ["customer_id", "idempotency_key"]
    firsts = requests.groupBy(*keys).agg(F.min(F.struct("received_at", "request_id"))["request_id"].alias("first_request_id"))
    created = F.col("first_request_id") == F.col("request_id")
    return requests.join(firsts, keys).withColumns(
        {
            "created": created,
            "status_code": F.when(created, 201).otherwise(200),
            "message": F.when(~created, F.lit(ALREADY_EXISTS)),
        }
    )


def idempotency_conflicts(requests: DataFrame) -> DataFrame:
    """Keys that were used for more than one payload."""
    keys = ["customer_id", "idempotency_key"]
    payload = F.struct("customer_id", "store_id", "county_id", "items", "shipping_address")
    per_payload = (
        requests.withColumn("payload_hash", request_hash(payload))
        .groupBy(*keys, "payload_hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_payload.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("payloads"), F.sum("n").alias("requests"))
        .where(F.col("payloads") > 1)
    )


def _row_rules(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules)).cast(ERRORS)


def validate_orders(orders: DataFrame) -> DataFrame:
    """Errors of stored orders: the item rules of intake plus a positive line total."""

    def item(x: Column, i: Column) -> Column:
        def path(name: str) -> Column:
            return F.concat(F.lit("items."), i.cast("string"), F.lit(f".{name}"))

        texts = [F.when(x[f].isNull(), _error(path(f), "invalid_type")).when(x[f] == "", _error(path(f), "too_small"))
                 for f in ("sku", "name")]
        numbers = [F.when(x[f].isNull(), _error(path(f), "invalid_type")).when(x[f] <= 0, _error(path(f), "too_small"))
                   for f in ("quantity", "unit_price", "total_price")]
        return F.array(*texts, *numbers)

    errors = F.array_compact(F.flatten(F.transform("items", item))).cast(ERRORS)
    return orders.withColumn("errors", F.coalesce(errors, F.array().cast(ERRORS)))


def validate_inventory(inventory: DataFrame) -> DataFrame:
    """Errors of stock rows: non-empty ids and name, counts at least zero, positive cost."""
    texts = [F.when(F.col(c).isNull(), _error(c, "invalid_type")).when(F.col(c) == "", _error(c, "too_small"))
             for c in ("store_sku", "store_id", "sku", "product_name")]
    counts = [F.when(F.col(c).isNull(), _error(c, "invalid_type")).when(F.col(c) < 0, _error(c, "too_small"))
              for c in ("quantity_available", "quantity_reserved", "reorder_level")]
    cost = F.when(F.col("unit_cost").isNull(), _error("unit_cost", "invalid_type")).when(
        F.col("unit_cost") <= 0, _error("unit_cost", "too_small")
    )
    return inventory.withColumn("errors", _row_rules(*texts, *counts, cost))
