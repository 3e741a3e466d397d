"""The order model in plain SQL, written apart from the Spark code, for checking query results.

Each view is a common table expression over the given tables. ``with_views`` puts the views a query needs,
and those they need, in front of its text. The given tables have no order with more than 100 lines, so the
splitting of larger line groups into several documents has no counterpart here.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: tuple[str, ...], text: str) -> None:
    VIEWS[name] = (needs, text.strip())


_view("heads_v", (), """
SELECT o_orderkey AS orderkey,
       'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '000000' AS order_id,
       'CUST-' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS customer_id,
       o_orderdate + to_seconds(o_orderkey % 86400) AS order_ts,
       'STORE-' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 3, '0') AS store_id,
       'COUNTY-' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS county_id,
       CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'PROCESSING'
            ELSE CASE o_orderkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'SHIPPED' WHEN 2 THEN 'DELIVERED'
                                     WHEN 3 THEN 'CANCELLED' ELSE 'FAILED' END END AS status,
       CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'CAPTURED'
            ELSE CASE o_orderkey % 5 WHEN 3 THEN 'REFUNDED' WHEN 4 THEN 'FAILED' ELSE 'CAPTURED' END
       END AS payment_state,
       c_name AS street, n_name AS city, upper(substr(n_name, 1, 2)) AS state,
       lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS zip
FROM orders
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey
""")

_view("lines_v", (), """
SELECT q.l_orderkey AS orderkey, q.l_partkey AS partkey,
       'ORD-' || lpad(CAST(q.l_orderkey AS VARCHAR), 20, '0') || '000000' AS order_id,
       'SKU-' || lpad(CAST(q.l_partkey AS VARCHAR), 12, '0') AS sku,
       p_name AS name, q.quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
       CAST(q.quantity * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total_price
FROM (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS INTEGER) AS quantity
      FROM lineitem GROUP BY l_orderkey, l_partkey) q
JOIN part ON p_partkey = q.l_partkey
""")

_view("docs_v", ("lines_v",), """
SELECT orderkey,
       string_agg(sku || ':' || quantity || ':' || total_price, ',' ORDER BY sku) AS items_text,
       CAST(count(*) AS INTEGER) AS item_count,
       CAST(sum(total_price) AS DECIMAL(18,2)) AS subtotal
FROM lines_v GROUP BY orderkey
""")

_view("orders_v", ("heads_v", "docs_v"), """
SELECT h.*, coalesce(d.items_text, '') AS items_text, coalesce(d.item_count, 0) AS item_count,
       coalesce(d.subtotal, CAST(0 AS DECIMAL(18,2))) AS subtotal,
       CAST(coalesce(d.subtotal, CAST(0 AS DECIMAL(18,2))) * CAST(0.08 AS DECIMAL(5,4)) AS DECIMAL(21,4)) AS tax,
       CAST(coalesce(d.subtotal, CAST(0 AS DECIMAL(18,2))) * CAST(1.08 AS DECIMAL(5,4)) AS DECIMAL(23,4)) AS total,
       strftime(h.order_ts, '%Y-%m-%dT%H:%M:%S') || '.000Z#' || h.order_id AS order_ts_id,
       'idem-' || h.order_id AS idempotency_key,
       h.order_ts AS created_at,
       CASE WHEN h.status = 'PENDING' THEN h.order_ts ELSE h.order_ts + INTERVAL 2 HOUR END AS updated_at,
       CASE WHEN h.orderkey % 20 = 0 THEN CAST(epoch(h.order_ts) AS BIGINT) + 365 * 86400 END AS ttl
FROM heads_v h LEFT JOIN docs_v d ON d.orderkey = h.orderkey
""")

_view("as_of_v", (), """
SELECT max(o_orderdate + to_seconds(o_orderkey % 86400)) AS as_of FROM orders
""")

_view("inventory_v", (), """
SELECT s.store_id || '#' || s.sku AS store_sku, s.store_id, s.sku,
       CASE WHEN s.partkey % 47 = 0 THEN '' ELSE p_name END AS product_name,
       CAST(20 + (s.store_no * 7 + s.partkey) % 60 AS INTEGER) AS quantity_available,
       CASE WHEN s.partkey % 5 = 0 THEN NULL ELSE CAST(s.partkey % 8 AS INTEGER) END AS quantity_reserved,
       CAST(CASE WHEN s.partkey % 37 = 0 THEN -1 ELSE s.partkey % 10 END AS INTEGER) AS reorder_level,
       CASE WHEN s.partkey % 43 = 0 THEN 0 ELSE 1 END AS cost_sign
FROM (SELECT DISTINCT l_orderkey % 50 AS store_no, l_partkey AS partkey,
             'STORE-' || lpad(CAST(l_orderkey % 50 AS VARCHAR), 3, '0') AS store_id,
             'SKU-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS sku
      FROM lineitem WHERE l_partkey % 41 <> 0) s
JOIN part ON p_partkey = s.partkey
""")

# Change feed: one row per record; the images differ only in status, payment state and update time.
_view("changes_v", ("orders_v",), """
SELECT o.*, c.seq, c.op, o.order_id || ':' || c.seq AS event_id,
       o.created_at + to_minutes(c.seq) AS changed_at,
       c.has_new, c.has_old,
       CASE WHEN has_new THEN CASE WHEN c.seq <= 2 THEN 'PENDING' ELSE o.status END END AS new_status,
       CASE WHEN has_new THEN CASE WHEN c.seq = 1 THEN 'PENDING' ELSE o.payment_state END END AS new_payment,
       CASE WHEN has_new THEN o.created_at + to_minutes(c.seq) END AS new_updated_at,
       CASE WHEN has_old THEN CASE WHEN c.seq <= 3 THEN 'PENDING' ELSE o.status END END AS old_status,
       CASE WHEN has_old THEN CASE WHEN c.seq = 2 THEN 'PENDING' ELSE o.payment_state END END AS old_payment
FROM orders_v o
JOIN (VALUES (1, 'INSERT', 1, 1, true, false), (2, 'MODIFY', 1, 1, true, true), (3, 'MODIFY', 1, 1, true, true),
             (3, 'MODIFY', 13, 2, true, true), (4, 'MODIFY', 11, 1, true, true), (5, 'MODIFY', 101, 1, false, false),
             (6, 'REMOVE', 97, 1, false, true)) AS c(seq, op, every, delivery, has_new, has_old)
  ON o.orderkey % c.every = 0
""")

# Domain events of the change feed, all change kinds.
_view("events_v", ("changes_v",), """
SELECT c.*, e.event_type, e.label
FROM changes_v c
JOIN (VALUES ('ORDER_CREATED', 'Order Created'), ('ORDER_STATUS_CHANGED', 'Order Status Changed'),
             ('ORDER_CONFIRMED', 'Order Confirmed'), ('ORDER_CANCELLED', 'Order Cancelled'),
             ('ORDER_SHIPPED', 'Order Shipped'), ('PAYMENT_STATE_CHANGED', 'Payment State Changed'),
             ('ORDER_DELETED', 'Order Deleted')) AS e(event_type, label)
  ON CASE e.event_type
       WHEN 'ORDER_CREATED' THEN c.op = 'INSERT' AND c.has_new
       WHEN 'ORDER_DELETED' THEN c.op = 'REMOVE' AND c.has_old
       WHEN 'PAYMENT_STATE_CHANGED' THEN c.op = 'MODIFY' AND c.new_payment <> c.old_payment
       WHEN 'ORDER_STATUS_CHANGED' THEN c.op = 'MODIFY' AND c.new_status <> c.old_status
       ELSE c.op = 'MODIFY' AND c.new_status <> c.old_status AND 'ORDER_' || c.new_status = e.event_type
     END
""")

# Records of the lake transform (see raw_events in the Spark model for the seeded defects).
_view("records_v", ("events_v",), """
SELECT *, event_id || ':' || event_type AS record_id,
       CASE WHEN orderkey % 107 = 0 THEN 'bad_base64' WHEN orderkey % 103 = 0 THEN 'bad_json' END AS error_type
FROM events_v
""")

# Flattened lake rows of the usable records.
_view("lake_v", ("records_v", "as_of_v"), """
SELECT record_id,
       CASE WHEN orderkey % 31 <> 0 THEN event_type WHEN orderkey % 7 = 0 THEN 'UNKNOWN' ELSE label END AS event_type,
       CASE WHEN orderkey % 41 = 0 THEN '' ELSE order_id END AS order_id, customer_id,
       CASE WHEN event_type IN ('PAYMENT_STATE_CHANGED', 'ORDER_DELETED') OR orderkey % 37 = 0 THEN NULL
            ELSE store_id END AS store_id,
       CASE WHEN event_type IN ('PAYMENT_STATE_CHANGED', 'ORDER_DELETED', 'ORDER_SHIPPED') THEN NULL
            ELSE county_id END AS county_id,
       CASE WHEN event_type IN ('ORDER_CREATED', 'ORDER_STATUS_CHANGED') THEN new_status END AS status,
       CASE WHEN event_type = 'PAYMENT_STATE_CHANGED' THEN new_payment END AS payment_state,
       CAST(NULL AS DOUBLE) AS subtotal, CAST(NULL AS DOUBLE) AS tax,
       CASE WHEN event_type IN ('ORDER_SHIPPED', 'ORDER_DELETED') OR orderkey % 17 = 0 THEN NULL
            ELSE CAST(total AS DOUBLE) END AS total,
       CASE WHEN event_type IN ('ORDER_CREATED', 'ORDER_CONFIRMED') THEN item_count END AS item_count,
       CASE WHEN orderkey % 19 = 0 THEN 'not-a-time'
            ELSE strftime(changed_at, '%Y-%m-%d %H:%M:%S') || '.000' END AS event_timestamp,
       CAST(NULL AS VARCHAR) AS created_at,
       CASE WHEN orderkey % 19 = 0 THEN as_of ELSE changed_at END AS filed_at, orderkey
FROM records_v, as_of_v WHERE error_type IS NULL
""")

_view("legacy_orders_v", ("orders_v",), """
SELECT order_id, customer_id, store_id, county_id,
       CASE WHEN orderkey % 23 = 0 THEN 'DELETED' ELSE status END AS status, payment_state, subtotal, tax, total,
       street AS shipping_street, city AS shipping_city, state AS shipping_state, zip AS shipping_zip,
       created_at, updated_at, orderkey, item_count
FROM orders_v WHERE orderkey % 2 = 0
""")

_view("legacy_items_v", ("lines_v",), """
SELECT order_id, sku, 'legacy ' || name AS name, quantity + 1 AS quantity, unit_price,
       CAST((quantity + 1) * unit_price AS DECIMAL(18,2)) AS total_price, orderkey
FROM lines_v WHERE orderkey % 2 = 0
""")


# Raw requests by kind of defect (``orderkey % 50``); kinds 21, 22 and 36 are sent twice.
_view("requests_v", ("orders_v",), """
SELECT o.*, o.orderkey % 50 AS kind, s.send, 'REQ-' || o.order_id || '-' || s.send AS request_id,
       o.order_ts + to_minutes(5 * (s.send - 1)) AS received_at,
       CASE o.orderkey % 50 WHEN 11 THEN NULL WHEN 17 THEN 'short'
            WHEN 26 THEN repeat('key-' || substr(o.order_id, 5), 5)
            ELSE 'key-' || substr(o.order_id, 5) END AS request_key
FROM orders_v o JOIN (VALUES (1), (2)) AS s(send) ON s.send = 1 OR o.orderkey % 50 IN (21, 22, 36)
WHERE o.item_count > 0
""")

# The known result of validating each kind.
_view("checked_v", ("requests_v",), """
SELECT *, CASE kind
  WHEN 0 THEN 'body:required' WHEN 1 THEN 'body:required' WHEN 2 THEN 'body:invalid_json'
  WHEN 3 THEN 'customer_id:too_small' WHEN 4 THEN 'items:too_small' WHEN 5 THEN 'items.0.quantity:too_small'
  WHEN 6 THEN 'items.0.quantity:invalid_type' WHEN 7 THEN 'items.0.quantity:invalid_type'
  WHEN 8 THEN 'items.0.unit_price:too_small' WHEN 9 THEN 'shipping_address.state:too_big'
  WHEN 10 THEN 'shipping_address.zip:too_small' WHEN 11 THEN 'idempotency_key:required'
  WHEN 13 THEN 'customer_id:invalid_type' WHEN 14 THEN 'customer_id:invalid_type'
  WHEN 15 THEN 'items:invalid_type' WHEN 16 THEN 'shipping_address:invalid_type' WHEN 18 THEN ':invalid_type'
  WHEN 19 THEN 'items:invalid_type' WHEN 20 THEN 'items.0.name:invalid_type'
  WHEN 23 THEN 'shipping_address.street:too_small' WHEN 24 THEN 'shipping_address.zip:too_big'
  WHEN 25 THEN 'body:invalid_json' WHEN 27 THEN 'items.0.quantity:invalid_type,items.0.quantity:too_small'
  WHEN 28 THEN 'items.0:invalid_type' WHEN 29 THEN 'shipping_address.state:too_small' WHEN 30 THEN ':invalid_type'
  WHEN 31 THEN 'customer_id:too_small,items.0.sku:too_small,shipping_address.state:too_big'
  WHEN 33 THEN 'items.0.unit_price:invalid_type' WHEN 34 THEN 'shipping_address:invalid_type'
  WHEN 35 THEN 'items.0.unit_price:too_small' ELSE '' END AS errors
FROM requests_v
""")


def sequential_reservation(where: str, keeps: str) -> str:
    """Orders tried one by one: ``asked`` lines and ``verdicts``, over ``heads_v``, ``lines_v`` and ``inventory_v``.

    Orders that can never fit and those that meet no scarce stock row are decided at once; the others are walked through
    with a list of what each scarce row has left. An order that does not keep its stock takes nothing.
    """
    return f"""
, asked AS (
  SELECT l.order_id, h.order_ts, h.store_id || '#' || l.sku AS store_sku, CAST(l.quantity AS BIGINT) AS quantity, {keeps} AS keeps
  FROM lines_v l JOIN heads_v h ON h.orderkey = l.orderkey WHERE {where}
), rooms AS (
  SELECT store_sku, sum(quantity) AS demand,
         CAST(coalesce(any_value(quantity_available), 0) - coalesce(any_value(quantity_reserved), 0) AS BIGINT) AS room
  FROM asked LEFT JOIN inventory_v USING (store_sku) GROUP BY store_sku
), slots AS (
  SELECT store_sku, room, row_number() OVER (ORDER BY store_sku) AS slot FROM rooms WHERE demand > room
), hopeless AS (
  SELECT DISTINCT order_id FROM asked JOIN rooms USING (store_sku) WHERE quantity > room
), queue AS (
  SELECT *, row_number() OVER (ORDER BY order_ts, order_id) AS turn FROM (
    SELECT order_id, order_ts, any_value(keeps) AS keeps, list(slot ORDER BY slot) AS places, list(quantity ORDER BY slot) AS wanted
    FROM asked JOIN slots USING (store_sku) WHERE order_id NOT IN (SELECT order_id FROM hopeless) GROUP BY order_id, order_ts)
), walk AS (
  SELECT CAST(0 AS BIGINT) AS turn, '' AS order_id, false AS reserved, (SELECT coalesce(list(room ORDER BY slot), []) FROM slots) AS free
  UNION ALL
  SELECT turn, order_id, reserved,
         CASE WHEN reserved AND keeps
              THEN list_transform(free, lambda r, i: r - coalesce(wanted[list_position(places, i)], 0)) ELSE free END
  FROM (SELECT q.turn, q.order_id, q.keeps, q.places, q.wanted, w.free,
               list_bool_and(list_transform(q.places, lambda s, i: w.free[s] >= q.wanted[i])) AS reserved
        FROM walk w JOIN queue q ON q.turn = w.turn + 1)
), verdicts AS (
  SELECT order_id, reserved FROM walk WHERE turn > 0
  UNION ALL SELECT DISTINCT order_id, order_id NOT IN (SELECT order_id FROM hopeless) FROM asked
            WHERE order_id NOT IN (SELECT order_id FROM queue)
)
"""


def reservation_over_time(where: str, until: str) -> str:
    """As :func:`sequential_reservation`, with holds that end: ``asked`` lines and ``verdicts``.

    The walk carries every hold that has not ended; what is free of a row is its room less the holds on it.
    """
    return f"""
, asked AS (
  SELECT l.order_id, h.order_ts, h.store_id || '#' || l.sku AS store_sku, CAST(l.quantity AS BIGINT) AS quantity,
         coalesce({until}, TIMESTAMP '9999-12-31') AS until
  FROM lines_v l JOIN heads_v h ON h.orderkey = l.orderkey WHERE {where}
), rooms AS (
  SELECT store_sku, sum(quantity) AS demand,
         CAST(coalesce(any_value(quantity_available), 0) - coalesce(any_value(quantity_reserved), 0) AS BIGINT) AS room
  FROM asked LEFT JOIN inventory_v USING (store_sku) GROUP BY store_sku
), scarce AS (
  SELECT store_sku, room FROM rooms WHERE demand > room
), hopeless AS (
  SELECT DISTINCT order_id FROM asked JOIN rooms USING (store_sku) WHERE quantity > room
), queue AS (
  SELECT *, row_number() OVER (ORDER BY order_ts, order_id) AS turn FROM (
    SELECT order_id, order_ts, any_value(until) AS until, list(store_sku ORDER BY store_sku) AS places,
           list(quantity ORDER BY store_sku) AS wanted, list(room ORDER BY store_sku) AS room
    FROM asked JOIN scarce USING (store_sku) WHERE order_id NOT IN (SELECT order_id FROM hopeless) GROUP BY order_id, order_ts)
), walk AS (
  SELECT CAST(0 AS BIGINT) AS turn, '' AS order_id, false AS reserved,
         CAST([] AS STRUCT(place VARCHAR, quantity BIGINT, until TIMESTAMP)[]) AS holds
  UNION ALL
  SELECT turn, order_id, reserved,
         CASE WHEN reserved THEN list_concat(holds, list_transform(places, lambda p, i: {{place: p, quantity: wanted[i], until: until}}))
              ELSE holds END
  FROM (SELECT turn, order_id, until, places, wanted, holds,
               list_bool_and(list_transform(places, lambda p, i: wanted[i] <= room[i]
                 - coalesce(list_sum(list_transform(list_filter(holds, lambda h: h.place = p), lambda h: h.quantity)), 0))) AS reserved
        FROM (SELECT q.turn, q.order_id, q.until, q.places, q.wanted, q.room,
                     list_filter(w.holds, lambda h: h.until > q.order_ts) AS holds
              FROM walk w JOIN queue q ON q.turn = w.turn + 1))
), verdicts AS (
  SELECT order_id, reserved FROM walk WHERE turn > 0
  UNION ALL SELECT DISTINCT order_id, order_id NOT IN (SELECT order_id FROM hopeless) FROM asked
            WHERE order_id NOT IN (SELECT order_id FROM queue)
)
"""


def with_views(needs: tuple[str, ...], body: str) -> str:
    """``body`` behind the common table expressions it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dependency in VIEWS[name][0]:
            visit(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    text = ",\n".join(f"{name} AS (\n{VIEWS[name][1]}\n)" for name in ordered)
    return f"WITH RECURSIVE {text}\n{body.strip()}"
