"""Change feed operators: decoding, filtering, per-key ordering, and domain events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import iso_millis
from ..functions.ordered import previous_value_of_stored
from ..session import cut_lineage
from ..functions.text import computed_once
from ..schemas import ADDRESS, DETAIL, EVENT_LABELS, EVENT_SOURCE, FEED_OPS, IMAGE, ITEMS, TAGGED_IMAGE

_TEXT_FIELDS = ("customer_id", "order_ts_id", "order_id", "store_id", "county_id", "status", "payment_state",
                "idempotency_key")
_TIME_FIELDS = ("order_ts", "created_at", "updated_at")
_NUMBER_FIELDS = {"subtotal": "decimal(18,2)", "tax": "decimal(21,4)", "total": "decimal(23,4)", "ttl": "bigint"}
_IMAGE_ORDER = ("customer_id", "order_ts_id", "order_id", "order_ts", "store_id", "county_id", "status",
                "payment_state", "items", "subtotal", "tax", "total", "shipping_address", "idempotency_key",
                "created_at", "updated_at", "ttl")
SEQUENCE_BLOCK = 16384


def encode_image(image: Column) -> Column:
    """Attribute-value JSON of an order image; null stays null."""

    def text(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(value.cast("string").alias("S")))

    def number(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(value.cast("string").alias("N")))

    def item(x: Column) -> Column:
        fields = F.struct(
            text(x["sku"]).alias("sku"), text(x["name"]).alias("name"), number(x["quantity"]).alias("quantity"),
            number(x["unit_price"]).alias("unit_price"), number(x["total_price"]).alias("total_price"),
        )
        return F.struct(fields.alias("M"))

    address = image["shipping_address"]
    encoded = {f: text(image[f]) for f in _TEXT_FIELDS}
    encoded.update({f: text(iso_millis(image[f])) for f in _TIME_FIELDS})
    encoded.update({f: number(image[f]) for f in _NUMBER_FIELDS})
    encoded["items"] = F.struct(F.transform(image["items"], item).alias("L"))
    encoded["shipping_address"] = F.struct(
        F.struct(*[text(address[f]).alias(f) for f in ("street", "city", "state", "zip")]).alias("M")
    )
    return F.when(image.isNotNull(), F.to_json(F.struct(*[encoded[f].alias(f) for f in _IMAGE_ORDER])))


def _typed_image(tagged: Column) -> Column:
    """Order image from the parsed attribute-value record; null for a missing image."""

    def item(x: Column) -> Column:
        m = x["M"]
        return F.struct(
            m["sku"]["S"].alias("sku"), m["name"]["S"].alias("name"),
            m["quantity"]["N"].try_cast("int").alias("quantity"),
            m["unit_price"]["N"].try_cast("decimal(18,2)").alias("unit_price"),
            m["total_price"]["N"].try_cast("decimal(18,2)").alias("total_price"),
        )

    address = tagged["shipping_address"]["M"]
    decoded = {f: tagged[f]["S"] for f in _TEXT_FIELDS}
    decoded.update({f: F.try_to_timestamp(tagged[f]["S"]) for f in _TIME_FIELDS})
    decoded.update({f: tagged[f]["N"].try_cast(kind) for f, kind in _NUMBER_FIELDS.items()})
    decoded["items"] = F.transform(tagged["items"]["L"], item).cast(ITEMS)
    decoded["shipping_address"] = F.struct(
        *[address[f]["S"].alias(f) for f in ("street", "city", "state", "zip")]
    ).cast(ADDRESS)
    image = F.struct(*[decoded[f].alias(f) for f in _IMAGE_ORDER]).cast(IMAGE)
    return F.when(tagged["order_id"].isNotNull(), image)


def decode_changes(raw: DataFrame) -> DataFrame:
    """Replace the JSON texts ``new_image`` and ``old_image`` by typed images; each text is parsed once."""
    parsed = computed_once(raw, "_new", F.from_json("new_image", TAGGED_IMAGE))
    parsed = computed_once(parsed, "_old", F.from_json("old_image", TAGGED_IMAGE))
    return parsed.withColumns(
        {"new_image": _typed_image(F.col("_new")), "old_image": _typed_image(F.col("_old"))}
    ).drop("_new", "_old")


def with_ops(changes: DataFrame, ops: Sequence[str] = FEED_OPS) -> DataFrame:
    return changes.where(F.col("op").isin(*ops))


def deduplicated(changes: DataFrame) -> DataFrame:
    """One record per ``event_id``; repeated deliveries are equal."""
    return changes.dropDuplicates(["event_id"])


def latest_per_key(changes: DataFrame) -> DataFrame:
    """The record with the highest ``seq`` of every order, by a partial aggregate."""
    row = F.struct(*changes.columns)
    return changes.groupBy(F.col("order_id").alias("_key")).agg(F.max_by(row, "seq").alias("_row")).select("_row.*")


def with_previous_image(changes: DataFrame) -> DataFrame:
    """Rebuild ``old_image`` from a feed that carries new images only (one record per order and ``seq``).

    The feed is stored once: it is counted by order, then ordered in one shuffle.
    """
    bucket = F.floor(F.col("seq") / SEQUENCE_BLOCK)
    stored = cut_lineage(changes.drop("old_image"))
    return previous_value_of_stored(stored, ["order_id"], "seq", "new_image", "old_image", bucket)


def derive_events(
    changes: DataFrame,
    ops: Sequence[str] = FEED_OPS,
    source: str = EVENT_SOURCE,
    stamp: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Domain events of a change feed: zero to three per record, one scan and no shuffle.

    ``stamp`` is the time of all events of a record, by default the change's own ``changed_at``.
    """
    stamp = F.col("changed_at") if stamp is None else stamp
    new, old = F.col("new_image"), F.col("old_image")
    inserted = (F.col("op") == "INSERT") & new.isNotNull()
    modified = (F.col("op") == "MODIFY") & new.isNotNull() & old.isNotNull()
    moved = modified & ~new["status"].eqNullSafe(old["status"])
    repaid = modified & ~new["payment_state"].eqNullSafe(old["payment_state"])
    removed = (F.col("op") == "REMOVE") & old.isNotNull()

    def became(status: str) -> Column:
        return moved & (new["status"] == status)

    conditions = {
        "ORDER_CREATED": inserted,
        "ORDER_STATUS_CHANGED": moved,
        "ORDER_CONFIRMED": became("CONFIRMED"),
        "ORDER_CANCELLED": became("CANCELLED"),
        "ORDER_SHIPPED": became("SHIPPED"),
        "PAYMENT_STATE_CHANGED": repaid,
        "ORDER_DELETED": removed,
    }
    # Only the kinds go through the generator; the details are built behind it, without lambdas, in compiled code.
    kinds = F.array(*[F.when(condition, F.lit(kind)) for kind, condition in conditions.items()])
    kind = F.col("_kind")
    label = F.coalesce(*[F.when(kind == k, F.lit(EVENT_LABELS[k])) for k in conditions])

    def of(value: Column, *its_kinds: str) -> Column:
        return F.when(kind.isin(*its_kinds), value)

    changed = ("ORDER_STATUS_CHANGED", "ORDER_CONFIRMED", "ORDER_CANCELLED")
    deleted = kind == "ORDER_DELETED"
    fields = {
        "event_type": kind,
        "order_id": F.when(deleted, old["order_id"]).otherwise(new["order_id"]),
        "customer_id": F.when(deleted, old["customer_id"]).otherwise(new["customer_id"]),
        "store_id": of(new["store_id"], "ORDER_CREATED", *changed, "ORDER_SHIPPED"),
        "county_id": of(new["county_id"], "ORDER_CREATED", *changed),
        "status": of(new["status"], "ORDER_CREATED"),
        "old_status": of(old["status"], "ORDER_STATUS_CHANGED"),
        "new_status": of(new["status"], "ORDER_STATUS_CHANGED"),
        "old_state": of(old["payment_state"], "PAYMENT_STATE_CHANGED"),
        "new_state": of(new["payment_state"], "PAYMENT_STATE_CHANGED"),
        "total": of(new["total"], "ORDER_CREATED", *changed, "PAYMENT_STATE_CHANGED"),
        "item_count": of(F.coalesce(F.size(new["items"]), F.lit(0)), "ORDER_CREATED"),
        "items": of(new["items"], "ORDER_CONFIRMED"),
        "shipping_address": of(new["shipping_address"], "ORDER_CONFIRMED", "ORDER_SHIPPED"),
        "timestamp": iso_millis(F.col("time")),
    }
    told = with_ops(changes, ops).select(
        "event_id", *keep, stamp.alias("time"), "new_image", "old_image", F.explode(kinds).alias("_kind")
    ).where(kind.isNotNull())
    return told.select(
        "event_id", *keep, F.lit(source).alias("source"), label.alias("detail_type"), "time",
        F.struct(*[value.alias(name) for name, value in fields.items()]).cast(DETAIL).alias("detail"),
    )
