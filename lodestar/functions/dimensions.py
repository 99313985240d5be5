"""Dimensions: named grouping and filtering expressions over the star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of status codes.
ORDER_STATUS = {10: "Pending", 20: "Processing", 30: "Complete", 40: "Cancelled"}
PAYMENT_STATUS = {10: "Pending", 20: "Authorized", 30: "Paid", 35: "PartiallyRefunded", 40: "Refunded", 50: "Voided"}
SHIPPING_STATUS = {10: "Not Required", 20: "Not Yet Shipped", 30: "Shipped", 40: "Delivered", 50: "Partially Shipped"}


@dataclass(frozen=True)
class Dimension:
    """expr: the raw expression; dtype: string, number or date."""

    id: str
    table: str
    columns: tuple[str, ...]
    dtype: str
    expr: Callable[[], Column]
    label: str
    description: str

    def as_label(self) -> Column:
        """As reports show it: dates as ISO strings of the day, decimals as doubles."""
        x = self.expr()
        if self.dtype == "date":
            return F.date_format(F.to_date(x), "yyyy-MM-dd")
        return x.cast("double") if self.id in ("product_price", "product_cost") else x


def _column(id: str, table: str, ref: str, dtype: str, label: str, description: str) -> Dimension:
    return Dimension(id, table, (ref.split(".")[1],), dtype, lambda: F.col(ref), label, description)


def _named(id: str, column: str, names: dict[int, str], label: str, description: str) -> Dimension:
    def expr() -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for code, name in names.items():
            out = out.when(F.col(f"o.{column}") == code, name)
        return out.otherwise("Unknown")

    return Dimension(id, "Order", (column,), "string", expr, label, description)


#: Order matters: names resolve to the first that fits. Labels and descriptions are fixed values.
DIMENSIONS = {d.id: d for d in (
    _column("product_name", "Product", "p.Name", "string", "Product Name", "Name of the product"),
    _column("product_sku", "Product", "p.Sku", "string", "Product SKU", "Stock keeping unit code"),
    _column("product_price", "Product", "p.Price", "number", "Product Price", "Current listed price of the product"),
    _column("product_cost", "Product", "p.ProductCost", "number", "Product Cost", "Manufacturing/acquisition cost of the product"),
    _column("product_stock", "Product", "p.StockQuantity", "number", "Stock Level", "Quantity in stock"),
    _column("product_rating", "Product", "p.ApprovedTotalReviews", "number", "Rating", "Number of approved customer reviews"),
    _column("product_published", "Product", "p.Published", "number", "Product Published", "Whether the product is published (1=yes, 0=no)"),
    _column("product_created_date", "Product", "p.CreatedOnUtc", "date", "Product Created Date", "Date product was added to catalog"),
    _column("category_name", "Category", "c.Name", "string", "Category", "Category name"),
    _column("manufacturer_name", "Manufacturer", "mf.Name", "string", "Manufacturer", "Brand/manufacturer name"),
    Dimension("customer_name", "Customer", ("FirstName", "LastName"), "string", lambda: F.concat("cu.FirstName", F.lit(" "), "cu.LastName"), "Customer Name", "Full name of the customer (FirstName LastName)"),
    _column("customer_email", "Customer", "cu.Email", "string", "Customer Email", "Email address of the customer"),
    _column("customer_active", "Customer", "cu.Active", "number", "Customer Active", "Whether customer account is active (1=yes, 0=no)"),
    _column("customer_registration_date", "Customer", "cu.CreatedOnUtc", "date", "Customer Registration Date", "Date customer registered"),
    _column("order_id", "Order", "o.Id", "number", "Order ID", "Unique identifier of the order"),
    _column("order_date", "Order", "o.CreatedOnUtc", "date", "Order Date", "Date order was placed"),
    Dimension("order_month", "Order", ("CreatedOnUtc",), "string", lambda: F.date_format("o.CreatedOnUtc", "yyyy-MM"), "Order Month", "Month when order was placed (YYYY-MM format)"),
    Dimension("order_year", "Order", ("CreatedOnUtc",), "number", lambda: F.year("o.CreatedOnUtc"), "Order Year", "Year when order was placed"),
    _column("OrderStatusId", "Order", "o.OrderStatusId", "number", "Order Status ID", "Internal status code of the order"),
    _column("PaymentStatusId", "Order", "o.PaymentStatusId", "number", "Payment Status ID", "Internal payment status code"),
    _column("ShippingStatusId", "Order", "o.ShippingStatusId", "number", "Shipping Status ID", "Internal shipping status code"),
    _named("order_status", "OrderStatusId", ORDER_STATUS, "Order Status", "Human-readable order status (Pending, Processing, Complete, Cancelled)"),
    _named("payment_status", "PaymentStatusId", PAYMENT_STATUS, "Payment Status", "Human-readable payment status (Pending, Authorized, Paid, PartiallyRefunded, Refunded, Voided)"),
    _named("shipping_status", "ShippingStatusId", SHIPPING_STATUS, "Shipping Status", "Human-readable shipping status (Not Required, Not Yet Shipped, Shipped, Delivered)"),
    _column("payment_method", "Order", "o.PaymentMethodSystemName", "string", "Payment Method", "Payment method used for the order"),
    _column("currency_code", "Order", "o.CustomerCurrencyCode", "string", "Currency", "Currency code used for the order"),
    _column("shipping_method", "Order", "o.ShippingMethod", "string", "Shipping Method", "Shipping method chosen for the order"),
    _column("order_number", "Order", "o.CustomOrderNumber", "string", "Order Number", "Custom order number (e.g. ORD-00001)"),
    _column("country_name", "Country", "co.Name", "string", "Billing Country", "Country name from the billing address"),
    _column("billing_city", "Address", "addr.City", "string", "Billing City", "City from the billing address"),
    _column("tracking_number", "Shipment", "sh.TrackingNumber", "string", "Tracking Number", "Shipment tracking number"),
    _column("shipped_date", "Shipment", "sh.ShippedDateUtc", "date", "Shipped Date", "Date the shipment was dispatched"),
    _column("delivery_date", "Shipment", "sh.DeliveryDateUtc", "date", "Delivery Date", "Date the shipment was delivered"),
    _column("store_name", "Store", "st.Name", "string", "Store", "Store name for multi-store setups"),
)}


def dimension(id: str) -> Dimension:
    """The dimension of that id; an unknown one is refused with the list of those there are."""
    if id not in DIMENSIONS:
        raise ValueError(f"unknown dimension {id!r}; known: {', '.join(sorted(DIMENSIONS))}")
    return DIMENSIONS[id]
