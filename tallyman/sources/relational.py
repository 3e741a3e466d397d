"""The relational orders and items tables, from a database or from parquet copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LEGACY_ITEM_COLUMNS, LEGACY_ORDER_COLUMNS

_MONEY = {"subtotal": "decimal(18,2)", "tax": "decimal(21,4)", "total": "decimal(23,4)",
          "unit_price": "decimal(18,2)", "total_price": "decimal(18,2)"}


def _typed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Numbers that arrive as text become decimals, null when they are not numbers."""
    return df.select(
        *[F.col(c).try_cast(_MONEY[c]).alias(c) if c in _MONEY
          else F.col(c).try_cast("int").alias(c) if c == "quantity" else F.col(c) for c in columns]
    )


def id_ranges(bounds: list[str]) -> list[str]:
    """Predicates that cut a table into one read per range of ``order_id``, covering every non-null id."""
    if not bounds:
        return ["order_id is not null"]
    if any("'" in b for b in bounds):
        raise ValueError("range bounds must not contain quotes")
    bounds = sorted(bounds)
    middle = [f"order_id > '{low}' and order_id <= '{high}'" for low, high in zip(bounds, bounds[1:])]
    return [f"order_id <= '{bounds[0]}'", *middle, f"order_id > '{bounds[-1]}'"]


def read_jdbc(
    spark: SparkSession, url: str, bounds: list[str], properties: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both tables over JDBC, one partition per range; filters are pushed to the database."""
    options = {"fetchsize": "10000", **(properties or {})}
    predicates = id_ranges(bounds)
    orders = spark.read.jdbc(url, "orders", predicates=predicates, properties=options)
    items = spark.read.jdbc(url, "order_items", predicates=predicates, properties=options)
    return _typed(orders, LEGACY_ORDER_COLUMNS), _typed(items, LEGACY_ITEM_COLUMNS)


def read_parquet(spark: SparkSession, orders_path: str, items_path: str) -> tuple[DataFrame, DataFrame]:
    orders, items = spark.read.parquet(orders_path), spark.read.parquet(items_path)
    return _typed(orders, LEGACY_ORDER_COLUMNS), _typed(items, LEGACY_ITEM_COLUMNS)
