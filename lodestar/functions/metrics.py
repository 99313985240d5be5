"""Metrics: named aggregates over the star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """agg: over grouped rows, as reported (double, or a count); row: its value for a row, if it has one.

    columns: what it reads of its table.
    """

    id: str
    table: str
    columns: tuple[str, ...]
    agg: Callable[[], Column]
    row: Callable[[], Column] | None
    label: str
    description: str


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _sum(id: str, table: str, columns: tuple[str, ...], row: Callable[[], Column], label: str, description: str, whole: bool = False) -> Metric:
    return Metric(id, table, columns, lambda: F.sum(row()).cast("long" if whole else "double"), row, label, description)


def _distinct(id: str, table: str, columns: tuple[str, ...], key: Callable[[], Column], label: str, description: str, row: bool = True) -> Metric:
    return Metric(id, table, columns, lambda: F.count_distinct(key()), key if row else None, label, description)


#: Order matters: names resolve to the first that fits. Labels and descriptions are fixed values.
METRICS = {m.id: m for m in (
    _sum("revenue", "Order", ("OrderTotal", "RefundedAmount"), lambda: _or_zero("o.OrderTotal") - _or_zero("o.RefundedAmount"), "Total Revenue", "Sum of order totals excluding refunded amounts"),
    _distinct("order_count", "Order", ("Id",), lambda: F.col("o.Id"), "Number of Orders", "Total count of unique orders"),
    Metric("avg_order_value", "Order", ("OrderTotal",), lambda: F.sum(_or_zero("o.OrderTotal")).cast("double") / F.count(F.lit(1)), lambda: _or_zero("o.OrderTotal"), "Average Order Value", "Average revenue per order"),
    _sum("item_quantity", "OrderItem", ("Quantity",), lambda: _or_zero("oi.Quantity"), "Quantity Sold", "Total number of items sold", whole=True),
    _sum("shipping_cost", "Order", ("OrderShippingExclTax",), lambda: F.col("o.OrderShippingExclTax"), "Shipping Cost", "Total shipping fees (excluding tax)"),
    _distinct("customer_count", "Customer", ("Id",), lambda: F.col("cu.Id"), "Number of Customers", "Total unique customers"),
    _distinct("refund_count", "Order", ("Id", "RefundedAmount"), lambda: F.when(F.col("o.RefundedAmount") > 0, F.col("o.Id")), "Number of Refunds", "Total count of orders with refunds", row=False),
    _sum("refund_amount", "Order", ("RefundedAmount",), lambda: F.col("o.RefundedAmount"), "Total Refunded", "Sum of all refunded amounts"),
    _sum("discount_amount", "Order", ("OrderDiscount",), lambda: F.col("o.OrderDiscount"), "Total Discount", "Sum of all order discounts"),
    _sum("profit", "Order", ("OrderTotal", "OrderSubtotalExclTax"), lambda: _or_zero("o.OrderTotal") - _or_zero("o.OrderSubtotalExclTax"), "Profit", "Gross profit (order total minus subtotal cost)"),
    _sum("line_item_revenue", "OrderItem", ("PriceExclTax",), lambda: F.col("oi.PriceExclTax"), "Product Revenue", "Total revenue from line items (product-level sales)"),
    _sum("tax_amount", "Order", ("OrderTax",), lambda: F.col("o.OrderTax"), "Tax Amount", "Total order tax collected"),
    _sum("line_item_cost", "OrderItem", ("OriginalProductCost",), lambda: F.col("oi.OriginalProductCost"), "Product Cost", "Total original product cost from line items"),
    _sum("line_item_discount", "OrderItem", ("DiscountAmountExclTax",), lambda: F.col("oi.DiscountAmountExclTax"), "Line Item Discount", "Total discount applied at line-item level"),
    _distinct("shipment_count", "Shipment", ("Id",), lambda: F.col("sh.Id"), "Shipment Count", "Total number of shipments created"),
)}


def metric(id: str) -> Metric:
    """The metric of that id; an unknown one is refused with the list of those there are."""
    if id not in METRICS:
        raise ValueError(f"unknown metric {id!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[id]
