"""The order model derived from the given star-schema tables.

Orders come in two halves: *heads* (everything but the lines) and *documents* (heads with their nested
items). Queries that list a few orders pick the heads first and attach items to those only.

An order is one document whatever its size. Totals and counts come from flat lines behind a partial aggregate; items are
nested only where a query returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import iso_millis, sort_key, store_sku
from ..operators.pricing import tax_and_total
from ..schemas import ADDRESS, IMAGE, ITEMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, value: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(value.cast("string"), width, "0"))


def order_id_of(key: Column) -> Column:
    """``ORD-`` and 26 digits: twenty of the key, then six zeros."""
    return F.concat(F.lit("ORD-"), F.lpad(key.cast("string"), 20, "0"), F.lit("000000"))


def _order_ts() -> Column:
    return F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400)")


def latest_order_time(spark: SparkSession, sf_dir: str) -> Column:
    """The newest order time as a literal: the default ``as_of`` of time-dependent operators."""
    newest = table(spark, sf_dir, "orders").agg(iso_millis(F.max(_order_ts()))).first()[0]
    return F.lit(newest).cast("timestamp")


def _status() -> Column:
    key = F.col("o_orderkey") % 5
    return (
        F.when(F.col("o_orderstatus") == "O", "PENDING")
        .when(F.col("o_orderstatus") == "P", "PROCESSING")
        .when(key == 0, "CONFIRMED")
        .when(key == 1, "SHIPPED")
        .when(key == 2, "DELIVERED")
        .when(key == 3, "CANCELLED")
        .otherwise("FAILED")
    )


def _payment_state(status: Column) -> Column:
    return (
        F.when(status == "PENDING", "PENDING")
        .when(status == "FAILED", "FAILED")
        .when(status == "CANCELLED", "REFUNDED")
        .otherwise("CAPTURED")
    )


# Source code of each status, so that a status filter reaches the scan.
SOURCE_STATUS = {
    "PENDING": "O", "PROCESSING": "P", "CONFIRMED": "F", "SHIPPED": "F", "DELIVERED": "F", "CANCELLED": "F",
    "FAILED": "F",
}


def order_heads(
    spark: SparkSession,
    sf_dir: str,
    since: Column | None = None,
    statuses: tuple[str, ...] | None = None,
    customer_id: str | None = None,
) -> DataFrame:
    """Orders without lines, one row per order key. The restrictions reach the scan as filters."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if since is not None:
        first_date = (since - F.expr("interval 1 day")).cast("timestamp_ntz")
        orders = orders.where(F.col("o_orderdate") >= first_date)
    if statuses is not None:
        orders = orders.where(F.col("o_orderstatus").isin(*sorted({SOURCE_STATUS[s] for s in statuses})))
    if customer_id is not None:
        orders = orders.where(F.col("o_custkey") == int(customer_id.removeprefix("CUST-")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        nation, customer.c_nationkey == nation.n_nationkey, "left"
    )
    key = F.col("o_orderkey")
    heads = joined.select(
        key.alias("orderkey"),
        padded("CUST-", F.col("o_custkey"), 12).alias("customer_id"),
        _order_ts().alias("order_ts"),
        padded("STORE-", key % 50, 3).alias("store_id"),
        padded("COUNTY-", F.col("c_nationkey"), 3).alias("county_id"),
        _status().alias("status"),
        F.struct(
            F.col("c_name").alias("street"),
            F.col("n_name").alias("city"),
            F.upper(F.substring("n_name", 1, 2)).alias("state"),
            F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0").alias("zip"),
        ).cast(ADDRESS).alias("shipping_address"),
    )
    if since is not None:
        heads = heads.where(F.col("order_ts") >= since)
    if statuses is not None:
        heads = heads.where(F.col("status").isin(*statuses))
    return heads.select(
        "*",
        _payment_state(F.col("status")).alias("payment_state"),
        F.col("order_ts").alias("created_at"),
        F.when(F.col("status") == "PENDING", F.col("order_ts"))
        .otherwise(F.col("order_ts") + F.expr("interval 2 hours"))
        .alias("updated_at"),
        F.when(F.col("orderkey") % 20 == 0, F.unix_timestamp("order_ts") + 365 * 86400).alias("ttl"),
    )


def _raw_lines(spark: SparkSession, sf_dir: str, keys: DataFrame | None) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), "l_quantity"
    )
    return raw if keys is None else raw.join(keys, "orderkey", "left_semi")


def order_lines(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """One row per order and sku. ``keys`` (column ``orderkey``) restricts the orders read."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"),
    )
    lines = (
        _raw_lines(spark, sf_dir, keys)
        .groupBy("orderkey", "partkey")
        .agg(F.sum("l_quantity").cast("int").alias("quantity"))
        .join(part, "partkey")
    )
    return lines.select(
        "orderkey",
        "partkey",
        order_id_of(F.col("orderkey")).alias("order_id"),
        padded("SKU-", F.col("partkey"), 12).alias("sku"),
        "name",
        "quantity",
        "unit_price",
        (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("total_price"),
    )


def documents(
    spark: SparkSession, sf_dir: str, heads: DataFrame, few: bool = False, selective: bool = False
) -> DataFrame:
    """Attach items and totals to heads.

    ``few`` says that heads are bounded by a small limit, so their keys may travel to the line scan.
    ``selective`` says that they are a small share of all orders: lines of other orders are dropped before
    they are aggregated, by whatever join the planner finds fitting.

    The join follows the partitioning that the nesting left behind, so nested items are not moved again. Items
    that a query does not use are not collected.
    """
    keys = heads.select("orderkey") if few or selective else None
    if few:
        keys = F.broadcast(keys)
    nested = (
        order_lines(spark, sf_dir, keys)
        .groupBy("orderkey")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("sku", "name", "quantity", "unit_price", "total_price"))
            ).alias("items"),
            F.sum("total_price").cast("decimal(18,2)").alias("subtotal"),
        )
    )
    joined = heads.join(nested, "orderkey", "left").select(
        *heads.columns,
        order_id_of(F.col("orderkey")).alias("order_id"),
        F.coalesce("items", F.array().cast(ITEMS)).cast(ITEMS).alias("items"),
        F.coalesce("subtotal", F.lit(0).cast("decimal(18,2)")).alias("subtotal"),
    )
    tax, total = tax_and_total(F.col("subtotal"))
    return joined.select(
        "*",
        sort_key(F.col("order_ts"), F.col("order_id")).alias("order_ts_id"),
        tax.alias("tax"),
        total.alias("total"),
        F.concat(F.lit("idem-"), F.col("order_id")).alias("idempotency_key"),
    )


def orders(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """All order documents, or those of the orders from ``since`` on."""
    return documents(spark, sf_dir, order_heads(spark, sf_dir, since), selective=since is not None)


def line_facts(spark: SparkSession, sf_dir: str, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Flat lines with the order attributes that stock and picking operators need."""
    heads = order_heads(spark, sf_dir, statuses=statuses).select(
        "orderkey", "store_id", "status", "order_ts", "customer_id"
    )
    return (
        order_lines(spark, sf_dir)
        .join(heads, "orderkey")
        .withColumn("store_sku", store_sku(F.col("store_id"), F.col("sku")))
    )


# ---- change feed -------------------------------------------------------------------------------------


def _image(status: Column, payment: Column, updated: Column) -> Column:
    names = IMAGE[len("struct<"):-1]
    fields = {"status": status, "payment_state": payment, "updated_at": updated}
    columns = [
        "customer_id", "order_ts_id", "order_id", "order_ts", "store_id", "county_id", "status", "payment_state",
        "items", "subtotal", "tax", "total", "shipping_address", "idempotency_key", "created_at", "updated_at", "ttl",
    ]
    assert names.startswith(columns[0])
    return F.struct(*[fields.get(name, F.col(name)).alias(name) for name in columns]).cast(IMAGE)


def changes(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Change feed of the orders, with repeated deliveries, touch-only changes and empty records.

    Per order: 1 INSERT, 2 MODIFY payment, 3 MODIFY status, then by key 4 a touch (``%11``), 5 a record
    without images (``%101``), 6 REMOVE (``%97``). Change 3 is delivered twice where ``%13``.
    """
    source = orders(spark, sf_dir) if source is None else source
    key, created = F.col("orderkey"), F.col("created_at")

    pending = F.lit("PENDING")
    status, payment = F.col("status"), F.col("payment_state")

    def step(seq: int, op: str, new: int | None, old: int | None) -> Column:
        return F.struct(
            F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"),
            F.lit(new).cast("int").alias("new"), F.lit(old).cast("int").alias("old"),
        )

    # Only what tells the steps apart goes through the generator; the images are built behind it. Steps an order does not
    # have are dropped as rows: a lambda over the array would take the whole stage out of compiled code.
    steps = F.array(
        step(1, "INSERT", 1, None),
        step(2, "MODIFY", 2, 1),
        step(3, "MODIFY", 3, 2),
        F.when(key % 13 == 0, step(3, "MODIFY", 3, 2)),
        F.when(key % 11 == 0, step(4, "MODIFY", 4, 3)),
        F.when(key % 101 == 0, step(5, "MODIFY", None, None)),
        F.when(key % 97 == 0, step(6, "REMOVE", None, 3)),
    )

    def minutes(count: Column) -> Column:
        return created + F.make_dt_interval(mins=count)

    def image(version: Column) -> Column:
        """The order after its first, second, third or fourth change; null without a version."""
        return F.when(
            version.isNotNull(),
            _image(
                F.when(version <= 2, pending).otherwise(status),
                F.when(version == 1, pending).otherwise(payment),
                minutes(version),
            ),
        ).cast(IMAGE)

    return source.withColumn("c", F.explode(steps)).where(F.col("c").isNotNull()).select(
        "orderkey",
        "order_id",
        F.concat_ws(":", "order_id", F.col("c.seq").cast("string")).alias("event_id"),
        "c.seq",
        "c.op",
        minutes(F.col("c.seq").cast("int")).alias("changed_at"),
        image(F.col("c.new")).alias("new_image"),
        image(F.col("c.old")).alias("old_image"),
    )


# ---- stock -------------------------------------------------------------------------------------------


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock rows for every ordered (store, sku) except ``partkey % 41 = 0``; some fail validation."""
    pairs = (
        table(spark, sf_dir, "lineitem")
        .select((F.col("l_orderkey") % 50).alias("store_no"), F.col("l_partkey").alias("partkey"))
        .where(F.col("partkey") % 41 != 0)
        .distinct()
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"), "p_name", F.col("p_retailprice").cast("decimal(18,2)").alias("price")
    )
    key = F.col("partkey")
    store, sku = padded("STORE-", F.col("store_no"), 3), padded("SKU-", key, 12)
    return pairs.join(part, "partkey").select(
        store_sku(store, sku).alias("store_sku"),
        store.alias("store_id"),
        sku.alias("sku"),
        F.when(key % 47 == 0, F.lit("")).otherwise(F.col("p_name")).alias("product_name"),
        (F.lit(20) + (F.col("store_no") * 7 + key) % 60).cast("int").alias("quantity_available"),
        F.when(key % 5 != 0, (key % 8).cast("int")).alias("quantity_reserved"),
        F.when(key % 37 == 0, F.lit(-1)).otherwise((key % 10).cast("int")).alias("reorder_level"),
        F.when(key % 43 == 0, F.lit(0)).otherwise(F.col("price") / 2).cast("decimal(18,2)").alias("unit_cost"),
    )


# ---- relational tables being replaced ------------------------------------------------------------------


def flatten_orders(source: DataFrame) -> DataFrame:
    """Order documents as flat relational rows."""
    return source.select(
        "order_id", "customer_id", "store_id", "county_id", "status", "payment_state", "subtotal", "tax", "total",
        F.col("shipping_address.street").alias("shipping_street"),
        F.col("shipping_address.city").alias("shipping_city"),
        F.col("shipping_address.state").alias("shipping_state"),
        F.col("shipping_address.zip").alias("shipping_zip"),
        "created_at", "updated_at",
    )


def legacy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat orders of the even keys; every 46th key is soft-deleted."""
    deleted = F.when(F.col("orderkey") % 23 == 0, F.lit("DELETED")).otherwise(F.col("status"))
    return flatten_orders(orders(spark, sf_dir).where(F.col("orderkey") % 2 == 0).withColumn("status", deleted))


def legacy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat lines of the even keys, with old names and quantities."""
    return (
        order_lines(spark, sf_dir)
        .where(F.col("orderkey") % 2 == 0)
        .select(
            "order_id",
            "sku",
            F.concat(F.lit("legacy "), F.col("name")).alias("name"),
            (F.col("quantity") + 1).alias("quantity"),
            "unit_price",
            ((F.col("quantity") + 1) * F.col("unit_price")).cast("decimal(18,2)").alias("total_price"),
        )
    )


# ---- messages and request tables -----------------------------------------------------------------------


def _unknown_id(key: Column) -> Column:
    return F.concat(F.lit("ORD-X"), F.lpad(key.cast("string"), 25, "0"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue message for every order, the ones with ``% 30 = 0`` naming an unknown order."""
    heads = order_heads(spark, sf_dir)
    known = order_id_of(F.col("orderkey"))
    order_id = F.when(F.col("orderkey") % 30 == 0, _unknown_id(F.col("orderkey"))).otherwise(known)
    return heads.select(
        order_id.alias("order_id"),
        "customer_id",
        sort_key(F.col("order_ts"), order_id).alias("order_ts_id"),
        F.lit("PROCESS_ORDER").alias("action"),
        (F.col("orderkey") % 5).cast("int").alias("attempt"),
        F.col("order_ts").alias("timestamp"),
    )


def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancel requests for every seventh order; some saw an older status, some name unknown orders."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(key % 7 == 0).select(
        F.when(key % 49 == 0, _unknown_id(key)).otherwise(order_id_of(key)).alias("order_id"),
        F.when(key % 21 == 0, F.lit("PENDING")).alias("seen_status"),
    )


def payment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment outcome for every order: approved unless ``% 20 = 0``, amount zero where ``% 70 = 0``."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order_id_of(key).alias("order_id"),
        (key % 20 != 0).alias("approved"),
        F.when(key % 70 == 0, F.lit(0)).otherwise(F.lit(100)).cast("decimal(23,4)").alias("amount"),
        (F.expr("cast(o_orderdate as timestamp)") + F.expr("interval 4 days")).alias("settled_at"),
    )


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded updates, up to three per order of ``orderkey % 4 = 0``."""
    key = F.col("o_orderkey")

    def step(seq: int, expected: str | None, new: str) -> Column:
        return F.struct(
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit(expected).cast("string").alias("expected_status"),
            F.lit(new).alias("new_status"),
        )

    steps = F.array_compact(
        F.array(
            step(1, "PENDING", "CONFIRMED"),
            F.when(key % 8 == 0, step(2, "CONFIRMED", "PROCESSING")),
            F.when(key % 12 == 0, step(3, None, "SHIPPED")),
            F.when(key % 16 == 0, step(4, "PENDING", "FAILED")),
        )
    )
    target = F.when(key % 52 == 0, _unknown_id(key)).otherwise(order_id_of(key))
    return (
        table(spark, sf_dir, "orders")
        .where(key % 4 == 0)
        .select(
            target.alias("order_id"),
            (F.expr("cast(o_orderdate as timestamp)") + F.expr("interval 3 days")).alias("requested_at"),
            F.explode(steps).alias("u"),
        )
        .select(
            "order_id", "u.seq", "u.expected_status", "u.new_status",
            (F.col("requested_at") + F.expr("make_dt_interval(0, 0, cast(u.seq as int), 0)")).alias("requested_at"),
        )
    )


# ---- raw order requests --------------------------------------------------------------------------------


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw intake requests made from the order documents, with defects seeded by ``orderkey % 50``.

    Kinds 21, 22 and 36 are sent twice under one idempotency key: the same body, another body, and the same
    content with its fields in another order.
    """
    source = orders(spark, sf_dir).where(F.size("items") > 0)
    kind = (F.col("orderkey") % 50).cast("int")

    def pick(cases: dict[int, str], default: Column) -> Column:
        chosen = default
        for number, text in cases.items():
            chosen = F.when(kind == number, F.lit(text)).otherwise(chosen)
        return chosen

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    def item_text(item: Column, index: Column, second: Column) -> Column:
        first = index == 0
        quantity = item["quantity"] + F.when(first & second & (kind == 22), 1).otherwise(0)
        quantity = F.when(
            first, pick({5: "0", 6: "1.5", 7: '"two"', 27: "-1.5", 32: "2.0"}, quantity.cast("string"))
        ).otherwise(quantity.cast("string"))
        price = F.when(
            first, pick({8: "-1", 33: '"12"', 35: "0"}, item["unit_price"].cast("string"))
        ).otherwise(item["unit_price"].cast("string"))
        sku = F.when(first & (kind == 31), F.lit("")).otherwise(item["sku"])
        name = F.when(first & (kind == 20), F.lit("")).otherwise(
            F.concat(F.lit('"name":"'), item["name"], F.lit('",'))
        )
        whole = F.concat(
            F.lit('{"sku":"'), sku, F.lit('",'), name, F.lit('"quantity":'), quantity,
            F.lit(',"unit_price":'), price, F.lit("}"),
        )
        return F.when(first & (kind == 28), F.lit("null")).otherwise(whole)

    def body(second: Column) -> Column:
        customer = pick({3: '""', 14: "123", 31: '""'}, quoted(F.col("customer_id")))
        customer = F.when(kind == 13, F.lit("")).otherwise(
            F.concat(F.lit('"customer_id":'), customer, F.lit(","))
        )
        lines = F.array_join(F.transform("items", lambda x, i: item_text(x, i, second)), ",")
        listed = F.concat(F.lit('"items":'), pick({4: "[]", 19: '"none"'}, F.concat(F.lit("["), lines, F.lit("]"))))
        listed = F.when(kind == 15, F.lit('"note":1')).otherwise(listed)
        address = F.col("shipping_address")
        place = F.concat(
            F.lit('"shipping_address":{"street":'), pick({23: '""'}, quoted(address["street"])),
            F.lit(',"city":'), quoted(address["city"]),
            F.lit(',"state":'), pick({9: '"TEX"', 29: '"T"', 31: '"TEX"'}, quoted(address["state"])),
            F.lit(',"zip":'), pick({10: '"1234"', 24: '"12345678901"'}, quoted(address["zip"])),
            F.lit("}"),
        )
        place = F.when(kind == 16, F.lit('"remark":"none"')).when(
            kind == 34, F.lit('"shipping_address":"here"')
        ).otherwise(place)
        shop = F.concat(
            F.lit('"store_id":'), quoted(F.col("store_id")), F.lit(',"county_id":'), quoted(F.col("county_id"))
        )
        extra = F.when(kind == 12, F.lit(',"gift":true,"tags":["a"]')).otherwise(F.lit(""))
        straight = F.concat(F.lit("{"), customer, shop, F.lit(","), listed, F.lit(","), place, extra, F.lit("}"))
        turned = F.concat(F.lit("{ "), place, F.lit(", "), listed, F.lit(", "), customer, shop, F.lit(" }"))
        text = F.when((kind == 36) & second, turned).otherwise(straight)
        text = pick({1: "", 2: '{"customer_id": ', 18: "[1]", 25: "{invalid: data}", 30: "null"}, text)
        return F.when(kind != 0, text)

    key = F.concat(F.lit("key-"), F.substring("order_id", 5, 26))
    key = F.when(kind == 17, F.lit("short")).when(kind == 26, F.repeat(key, 5)).otherwise(key)
    key = F.when(kind != 11, key)
    sends = F.when(kind.isin(21, 22, 36), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        source.withColumn("send", F.explode(sends))
        .select(
            "orderkey",
            F.concat(F.lit("REQ-"), "order_id", F.lit("-"), F.col("send").cast("string")).alias("request_id"),
            (F.col("order_ts") + F.expr("make_dt_interval(0, 0, 5 * (send - 1), 0)")).alias("received_at"),
            key.alias("idempotency_key"),
            body(F.col("send") == 2).alias("body"),
        )
    )


# ---- raw events ----------------------------------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 event records with seeded defects, for the lake transform.

    By order key: unwrapped ``% 7``, total as text ``% 17``, unreadable time ``% 19``, no envelope time
    ``% 23``, empty envelope time ``% 29``, no event type ``% 31``, empty store ``% 37``, no order id
    ``% 41``, broken JSON ``% 103``, broken base64 ``% 107``.
    """
    from ..operators.changes import derive_events

    events = derive_events(changes(spark, sf_dir), ops=("INSERT", "MODIFY", "REMOVE"), keep=("orderkey",))
    key, d = F.col("orderkey"), F.col("detail")
    stamp = F.when(key % 19 == 0, F.lit("not-a-time")).otherwise(iso_millis(F.col("time")))
    plain = [f for f in ("customer_id", "county_id", "status", "old_status", "new_status", "old_state", "new_state",
                         "item_count", "items", "shipping_address")]
    common = [
        F.when(key % 31 != 0, d["event_type"]).alias("event_type"),
        F.when(key % 41 != 0, d["order_id"]).alias("order_id"),
        F.when((key % 37 == 0) & d["store_id"].isNotNull(), F.lit("")).otherwise(d["store_id"]).alias("store_id"),
        *[d[f].alias(f) for f in plain],
        stamp.alias("timestamp"),
    ]
    # The JSON writer leaves nulls out, so a record has one of the two totals. Each text is made in one place: copies in several
    # branches make a method too long for the compiler.
    as_text = key % 17 == 0
    totals = [
        F.when(as_text, d["total"].cast("string")).alias("total"),
        F.when(as_text, F.lit(None)).otherwise(d["total"]).alias("total"),
    ]
    payload = F.to_json(F.struct(*common, *totals))
    time_field = (
        F.when(key % 23 == 0, F.lit(""))
        .when(key % 29 == 0, F.lit('"time":"",'))
        .otherwise(F.concat(F.lit('"time":"'), stamp, F.lit('",')))
    )
    before = F.when(key % 7 == 0, F.lit("")).otherwise(
        F.concat(
            F.lit('{"source":"'), F.col("source"), F.lit('","detail-type":"'), F.col("detail_type"), F.lit('",'),
            time_field, F.lit('"detail":'),
        )
    )
    after = F.when(key % 7 == 0, F.lit("")).otherwise(F.lit("}"))
    length = F.when(key % 103 == 0, 40).otherwise(2**31 - 1)
    text = F.substr(F.concat(before, payload, after), F.lit(1), length)
    data = F.when(key % 107 == 0, F.lit("*not base64*")).otherwise(F.base64(F.encode(text, "UTF-8")))
    return events.select("orderkey", F.concat_ws(":", "event_id", "detail.event_type").alias("record_id"), data.alias("data"))
