"""Order and line totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ITEMS, TAX_RATE


def line_total(item: Column) -> Column:
    return (item["quantity"] * item["unit_price"]).cast("decimal(18,2)")


def price_items(items: Column) -> Column:
    """Items with ``total_price`` filled in."""
    return F.transform(
        items,
        lambda x: F.struct(
            x["sku"].alias("sku"),
            x["name"].alias("name"),
            x["quantity"].alias("quantity"),
            x["unit_price"].alias("unit_price"),
            line_total(x).alias("total_price"),
        ),
    ).cast(ITEMS)


def subtotal(items: Column) -> Column:
    """Sum of quantity times price with all its digits, independent of the item order."""
    zero = F.lit(0).cast("decimal(38,8)")
    return F.aggregate(items, zero, lambda acc, x: (acc + x["quantity"] * x["unit_price"]).cast("decimal(38,8)"))


def tax_and_total(amount: Column, tax_rate: str = TAX_RATE) -> tuple[Column, Column]:
    """Tax and total of an amount that has not been rounded; each is rounded once."""
    exact = amount.cast("decimal(28,8)")
    tax = exact * F.lit(tax_rate).cast("decimal(5,4)")
    return tax.cast("decimal(21,4)"), (exact + tax).cast("decimal(23,4)")


def price_orders(requests: DataFrame, tax_rate: str = TAX_RATE) -> DataFrame:
    """Add line totals, subtotal, tax and total to rows that carry an ``items`` array.

    Records hold line totals and the subtotal in cents, tax and total in four digits. All are rounded from the exact sum.
    """
    exact = subtotal(F.col("items"))
    tax, total = tax_and_total(exact, tax_rate)
    priced = requests.withColumns({"subtotal": exact.cast("decimal(18,2)"), "tax": tax, "total": total})
    return priced.withColumn("items", price_items(F.col("items")))
