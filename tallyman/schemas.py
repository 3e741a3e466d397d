"""Record types of the order model and the fixed values that go with them."""

from __future__ import annotations

# ---- fixed values: order status, payment state, reservation and backfill status ----
ORDER_STATUSES = ("PENDING", "CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "FAILED")
PAYMENT_STATES = ("PENDING", "AUTHORIZED", "CAPTURED", "FAILED", "REFUNDED")
RESERVATION_STATUSES = ("PENDING", "CONFIRMED", "RELEASED")
BACKFILL_STATUSES = ("NOT_STARTED", "IN_PROGRESS", "COMPLETED", "FAILED")
LEGACY_DELETED = "DELETED"
CANCELLABLE_STATUSES = ("PENDING", "CONFIRMED")
TO_PICK_STATUSES = ("CONFIRMED", "PROCESSING")

# ---- fixed values: rates and limits ----
TAX_RATE = "0.08"
RESERVATION_MINUTES = 30
HISTORY_LIMIT = 20
MAX_HISTORY_LIMIT = 100
LISTING_LIMIT = 100
HIGH_VALUE_ABOVE = 500
BACKFILL_BATCH = 25
BACKFILL_PAGE_FACTOR = 10
FEED_OPS = ("INSERT", "MODIFY")
MAX_ATTEMPTS = 3
DEAD_LETTER_DAYS = 14
ARCHIVE_DAYS = 90
RATE_LIMIT = 2000

# ---- fixed values: response texts ----
ALREADY_EXISTS = "Order already exists (idempotent)"
VALIDATION_FAILED = "Validation failed"
NOT_FOUND = "Order not found"
NOT_CANCELLABLE = "Order cannot be cancelled"
STATUS_CHANGED = "Order status changed, please retry"
CANCELLED = "Order cancelled successfully"
DECLINED = "Payment declined"
INVENTORY_FAILED = "Inventory reservation failed"
PAYMENT_FAILED = "Payment processing failed"
SHORTAGE = "Insufficient inventory"

# ---- fixed values: event type and display label ----
EVENT_LABELS = {
    "ORDER_CREATED": "Order Created",
    "ORDER_STATUS_CHANGED": "Order Status Changed",
    "ORDER_CONFIRMED": "Order Confirmed",
    "ORDER_CANCELLED": "Order Cancelled",
    "ORDER_SHIPPED": "Order Shipped",
    "ORDER_DELIVERED": "Order Delivered",
    "PAYMENT_STATE_CHANGED": "Payment State Changed",
    "ORDER_DELETED": "Order Deleted",
}
EVENT_SOURCE = "orders"

# ---- record types, as DDL ----
ITEM = "struct<sku:string,name:string,quantity:int,unit_price:decimal(18,2),total_price:decimal(18,2)>"
ITEMS = f"array<{ITEM}>"
ADDRESS = "struct<street:string,city:string,state:string,zip:string>"

# Prices keep the digits they were sent with until totals are rounded.
REQUEST_ITEM = "struct<sku:string,name:string,quantity:int,unit_price:decimal(26,8)>"
REQUEST = (
    "customer_id string, store_id string, county_id string, "
    f"items array<{REQUEST_ITEM}>, shipping_address {ADDRESS}"
)

ORDER_COLUMNS = (
    "customer_id", "order_ts_id", "order_id", "order_ts", "store_id", "county_id", "status", "payment_state",
    "items", "subtotal", "tax", "total", "shipping_address", "idempotency_key", "created_at", "updated_at", "ttl",
)
ORDER_BY_ID_COLUMNS = (
    "order_id", "customer_id", "order_ts", "status", "payment_state", "store_id", "county_id", "items",
    "subtotal", "tax", "total", "shipping_address", "created_at", "updated_at",
)
LIST_COLUMNS = (
    "order_id", "customer_id", "status", "payment_state", "items", "subtotal", "tax", "total", "created_at",
)
DETAIL_COLUMNS = (
    "order_id", "customer_id", "status", "payment_state", "store_id", "county_id", "items", "subtotal", "tax",
    "total", "shipping_address", "created_at", "updated_at",
)

# An order image as carried by the change feed.
IMAGE = (
    "struct<customer_id:string,order_ts_id:string,order_id:string,order_ts:timestamp,store_id:string,"
    f"county_id:string,status:string,payment_state:string,items:{ITEMS},subtotal:decimal(18,2),"
    f"tax:decimal(21,4),total:decimal(23,4),shipping_address:{ADDRESS},idempotency_key:string,"
    "created_at:timestamp,updated_at:timestamp,ttl:bigint>"
)
CHANGE = f"event_id string, seq bigint, op string, changed_at timestamp, new_image {IMAGE}, old_image {IMAGE}"

# The same image in attribute-value JSON: every leaf is wrapped in a type tag.
_TEXT = "struct<S:string>"
_NUMBER = "struct<N:string>"
TAGGED_ITEM = (
    f"struct<M:struct<sku:{_TEXT},name:{_TEXT},quantity:{_NUMBER},unit_price:{_NUMBER},total_price:{_NUMBER}>>"
)
TAGGED_IMAGE = (
    f"struct<customer_id:{_TEXT},order_ts_id:{_TEXT},order_id:{_TEXT},order_ts:{_TEXT},store_id:{_TEXT},"
    f"county_id:{_TEXT},status:{_TEXT},payment_state:{_TEXT},items:struct<L:array<{TAGGED_ITEM}>>,"
    f"subtotal:{_NUMBER},tax:{_NUMBER},total:{_NUMBER},"
    f"shipping_address:struct<M:struct<street:{_TEXT},city:{_TEXT},state:{_TEXT},zip:{_TEXT}>>,"
    f"idempotency_key:{_TEXT},created_at:{_TEXT},updated_at:{_TEXT},ttl:{_NUMBER}>"
)

# Payload of a domain event: the union of all variants, absent fields null.
DETAIL = (
    "struct<event_type:string,order_id:string,customer_id:string,store_id:string,county_id:string,status:string,"
    "old_status:string,new_status:string,old_state:string,new_state:string,total:decimal(23,4),item_count:int,"
    f"items:{ITEMS},shipping_address:{ADDRESS},timestamp:string>"
)

MESSAGE = (
    "order_id string, customer_id string, order_ts_id string, action string, attempt int, timestamp timestamp"
)

# What flattening reads from a raw event, either inside ``detail`` or at the top level.
RAW_FIELDS = (
    "event_type:string,order_id:string,customer_id:string,store_id:string,county_id:string,status:string,"
    "new_status:string,payment_state:string,new_state:string,subtotal:double,tax:double,total:double,"
    "item_count:double,items:array<string>,timestamp:string,created_at:string"
)
RAW_EVENT = f"struct<source:string,`detail-type`:string,time:string,detail:struct<{RAW_FIELDS}>,{RAW_FIELDS}>"

LAKE_FIELDS = (
    "event_type string, order_id string, customer_id string, store_id string, county_id string, status string, "
    "payment_state string, subtotal double, tax double, total double, item_count int, event_timestamp timestamp, "
    "created_at timestamp"
)
LAKE_COLUMNS = tuple(field.split()[0] for field in LAKE_FIELDS.split(", "))
LAKE = LAKE_FIELDS + ", _malformed string, year string, month string, day string"

LEGACY_ORDER_COLUMNS = (
    "order_id", "customer_id", "store_id", "county_id", "status", "payment_state", "subtotal", "tax", "total",
    "shipping_street", "shipping_city", "shipping_state", "shipping_zip", "created_at", "updated_at",
)
LEGACY_ITEM_COLUMNS = ("order_id", "sku", "name", "quantity", "unit_price", "total_price")

BACKFILL_PROGRESS = (
    "status string, last_processed_id string, total_processed bigint, started_at timestamp, "
    "updated_at timestamp, error string"
)
