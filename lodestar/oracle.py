"""Plain SQL of the star queries, for checking them against another engine on the same tables."""

from __future__ import annotations

VIEWS = """
product AS (
  SELECT p_partkey AS "Id", p_name AS "Name", p_brand || '-' || p_partkey AS "Sku", CAST(p_retailprice AS DECIMAL(18,4)) AS "Price",
    CAST(CAST(p_retailprice AS DECIMAL(18,4)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(18,4)) AS "ProductCost", p_size AS "StockQuantity", 5 AS "MinStockQuantity",
    CAST(p_partkey % 400 AS INTEGER) AS "ApprovedTotalReviews", CASE WHEN p_partkey % 10 <> 0 THEN 1 ELSE 0 END AS "Published",
    DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS "CreatedOnUtc" FROM part),
order_item AS (
  SELECT l_orderkey AS "OrderId", l_partkey AS "ProductId", CAST(l_quantity AS INTEGER) AS "Quantity", CAST(l_extendedprice AS DECIMAL(18,4)) AS "PriceExclTax",
    CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS "DiscountAmountExclTax",
    CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS line_tax,
    CAST(CAST(l_quantity AS INTEGER) * product."ProductCost" AS DECIMAL(18,4)) AS "OriginalProductCost", l_returnflag
  FROM lineitem LEFT JOIN product ON l_partkey = product."Id"),
line_sums AS (
  SELECT "OrderId" AS k, SUM("PriceExclTax") AS subtotal, SUM(line_tax) AS tax, SUM("DiscountAmountExclTax") AS discount,
    SUM(CASE WHEN l_returnflag = 'R' THEN "PriceExclTax" ELSE 0 END) AS refunded FROM order_item GROUP BY 1),
order_ AS (
  SELECT o_orderkey AS "Id", 'ORD-' || o_orderkey AS "CustomOrderNumber", o_custkey AS "CustomerId", o_custkey AS "BillingAddressId", o_orderkey % 5 AS "StoreId",
    CASE o_orderstatus WHEN 'P' THEN 10 WHEN 'O' THEN 20 ELSE 30 END AS "OrderStatusId",
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 10 WHEN '2' THEN 20 WHEN '3' THEN 30 WHEN '4' THEN 35 ELSE 40 END AS "PaymentStatusId",
    CAST((o_orderkey % 5 + 1) * 10 AS INTEGER) AS "ShippingStatusId", o_orderpriority AS "PaymentMethodSystemName",
    CASE o_custkey % 4 WHEN 0 THEN 'BDT' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'INR' END AS "CustomerCurrencyCode",
    CASE WHEN o_orderkey % 2 = 0 THEN 'Ground' ELSE 'Express' END AS "ShippingMethod",
    CAST(CASE o_orderkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 120 ELSE 150 END AS DECIMAL(18,4)) AS "OrderShippingExclTax", CAST(o_totalprice AS DECIMAL(18,4)) AS "OrderTotal",
    o_orderdate AS "CreatedOnUtc", COALESCE(subtotal, 0) AS "OrderSubtotalExclTax", COALESCE(tax, 0) AS "OrderTax", COALESCE(discount, 0) AS "OrderDiscount", COALESCE(refunded, 0) AS "RefundedAmount"
  FROM orders LEFT JOIN line_sums ON k = o_orderkey),
category AS (SELECT DISTINCT n AS "Id", n AS "Name" FROM (SELECT p_type AS n FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part)),
product_category AS (SELECT p_partkey AS "ProductId", p_type AS "CategoryId" FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2) FROM part),
manufacturer AS (SELECT DISTINCT p_brand AS "Id", p_brand AS "Name" FROM part),
product_manufacturer AS (SELECT p_partkey AS "ProductId", p_brand AS "ManufacturerId" FROM part WHERE p_partkey % 5 <> 0),
customer_ AS (
  SELECT c_custkey AS "Id", c_mktsegment AS "FirstName", c_name AS "LastName", lower(c_mktsegment) || '.' || c_custkey || '@example.com' AS "Email",
    CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS "Active", CASE WHEN c_custkey % 7 = 0 THEN 'ref:' || lower(c_mktsegment) END AS "AdminComment",
    DATE '1994-01-01' + CAST(c_custkey % 2500 AS INTEGER) AS "CreatedOnUtc" FROM customer),
address AS (SELECT c_custkey AS "Id", c_nationkey AS "CountryId", 'CITY_' || c_custkey % 50 AS "City" FROM customer),
country AS (SELECT n_nationkey AS "Id", n_name AS "Name" FROM nation),
store AS (SELECT r_regionkey AS "Id", r_name AS "Name" FROM region),
shipment AS (
  SELECT l_orderkey || '/' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS "Id", l_orderkey AS "OrderId", 'TRK' || l_orderkey AS "TrackingNumber", CAST(l_shipdate AS DATE) AS "ShippedDateUtc",
    CASE WHEN MIN(l_linestatus) = 'F' THEN CAST(l_shipdate AS DATE) + 3 END AS "DeliveryDateUtc" FROM lineitem GROUP BY l_orderkey, CAST(l_shipdate AS DATE))
"""

JOINS = (
    ("OrderItem", "Order", "LEFT JOIN order_item oi ON o.\"Id\" = oi.\"OrderId\""),
    ("Product", "OrderItem", "LEFT JOIN product p ON oi.\"ProductId\" = p.\"Id\""),
    ("pcm", "Product", "LEFT JOIN product_category pcm ON p.\"Id\" = pcm.\"ProductId\""),
    ("Category", "pcm", "LEFT JOIN category c ON pcm.\"CategoryId\" = c.\"Id\""),
    ("Customer", "Order", "JOIN customer_ cu ON o.\"CustomerId\" = cu.\"Id\""),
    ("pmm", "Product", "JOIN product_manufacturer pmm ON p.\"Id\" = pmm.\"ProductId\""),
    ("Manufacturer", "pmm", "JOIN manufacturer mf ON pmm.\"ManufacturerId\" = mf.\"Id\""),
    ("Address", "Order", "JOIN address addr ON o.\"BillingAddressId\" = addr.\"Id\""),
    ("Country", "Address", "JOIN country co ON addr.\"CountryId\" = co.\"Id\""),
    ("Shipment", "Order", "JOIN shipment sh ON o.\"Id\" = sh.\"OrderId\""),
    ("Store", "Order", "JOIN store st ON o.\"StoreId\" = st.\"Id\""),
)
_NEEDS = {t: n for t, n, _ in JOINS}

METRIC = {
    "revenue": "CAST(SUM(COALESCE(o.\"OrderTotal\",0) - COALESCE(o.\"RefundedAmount\",0)) AS DOUBLE)", "order_count": "COUNT(DISTINCT o.\"Id\")",
    "avg_order_value": "CAST(SUM(COALESCE(o.\"OrderTotal\",0)) AS DOUBLE) / COUNT(*)", "item_quantity": "CAST(SUM(COALESCE(oi.\"Quantity\",0)) AS BIGINT)",
    "shipping_cost": "CAST(SUM(o.\"OrderShippingExclTax\") AS DOUBLE)", "customer_count": "COUNT(DISTINCT cu.\"Id\")",
    "refund_count": "COUNT(DISTINCT CASE WHEN o.\"RefundedAmount\" > 0 THEN o.\"Id\" END)", "refund_amount": "CAST(SUM(o.\"RefundedAmount\") AS DOUBLE)",
    "discount_amount": "CAST(SUM(o.\"OrderDiscount\") AS DOUBLE)", "profit": "CAST(SUM(COALESCE(o.\"OrderTotal\",0) - COALESCE(o.\"OrderSubtotalExclTax\",0)) AS DOUBLE)",
    "line_item_revenue": "CAST(SUM(oi.\"PriceExclTax\") AS DOUBLE)", "tax_amount": "CAST(SUM(o.\"OrderTax\") AS DOUBLE)",
    "line_item_cost": "CAST(SUM(oi.\"OriginalProductCost\") AS DOUBLE)", "line_item_discount": "CAST(SUM(oi.\"DiscountAmountExclTax\") AS DOUBLE)",
    "shipment_count": "COUNT(DISTINCT sh.\"Id\")",
}
METRIC_TABLE = {"item_quantity": "OrderItem", "line_item_revenue": "OrderItem", "line_item_cost": "OrderItem", "line_item_discount": "OrderItem", "customer_count": "Customer", "shipment_count": "Shipment"}


def _case(column: str, names: dict[int, str]) -> str:
    return f"CASE o.\"{column}\" " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'Unknown' END"


def _day(ref: str) -> str:
    return f"CAST(CAST({ref} AS DATE) AS VARCHAR)"


DIMENSION = {
    "product_name": ("Product", "p.\"Name\""), "product_sku": ("Product", "p.\"Sku\""), "product_price": ("Product", "CAST(p.\"Price\" AS DOUBLE)"), "product_cost": ("Product", "CAST(p.\"ProductCost\" AS DOUBLE)"),
    "product_stock": ("Product", "p.\"StockQuantity\""), "product_rating": ("Product", "p.\"ApprovedTotalReviews\""), "product_published": ("Product", "p.\"Published\""), "product_created_date": ("Product", _day("p.\"CreatedOnUtc\"")),
    "category_name": ("Category", "c.\"Name\""), "manufacturer_name": ("Manufacturer", "mf.\"Name\""), "customer_name": ("Customer", "cu.\"FirstName\" || ' ' || cu.\"LastName\""), "customer_email": ("Customer", "cu.\"Email\""),
    "customer_active": ("Customer", "cu.\"Active\""), "customer_registration_date": ("Customer", _day("cu.\"CreatedOnUtc\"")), "order_id": ("Order", "o.\"Id\""), "order_date": ("Order", _day("o.\"CreatedOnUtc\"")),
    "order_month": ("Order", "strftime(o.\"CreatedOnUtc\", '%Y-%m')"), "order_year": ("Order", "CAST(YEAR(o.\"CreatedOnUtc\") AS INTEGER)"), "OrderStatusId": ("Order", "o.\"OrderStatusId\""), "PaymentStatusId": ("Order", "o.\"PaymentStatusId\""),
    "ShippingStatusId": ("Order", "o.\"ShippingStatusId\""), "order_status": ("Order", _case("OrderStatusId", {10: "Pending", 20: "Processing", 30: "Complete", 40: "Cancelled"})),
    "payment_status": ("Order", _case("PaymentStatusId", {10: "Pending", 20: "Authorized", 30: "Paid", 35: "PartiallyRefunded", 40: "Refunded", 50: "Voided"})),
    "shipping_status": ("Order", _case("ShippingStatusId", {10: "Not Required", 20: "Not Yet Shipped", 30: "Shipped", 40: "Delivered", 50: "Partially Shipped"})),
    "payment_method": ("Order", "o.\"PaymentMethodSystemName\""), "currency_code": ("Order", "o.\"CustomerCurrencyCode\""), "shipping_method": ("Order", "o.\"ShippingMethod\""), "order_number": ("Order", "o.\"CustomOrderNumber\""),
    "country_name": ("Country", "co.\"Name\""), "billing_city": ("Address", "addr.\"City\""), "tracking_number": ("Shipment", "sh.\"TrackingNumber\""), "shipped_date": ("Shipment", _day("sh.\"ShippedDateUtc\"")),
    "delivery_date": ("Shipment", _day("sh.\"DeliveryDateUtc\"")), "store_name": ("Store", "st.\"Name\""),
}


def with_views(sql: str) -> str:
    return f"WITH {VIEWS.strip()}\n{sql}"


def joined(*tables: str) -> str:
    wanted = set()
    for t in tables:
        while t != "Order":
            wanted.add(t)
            t = _NEEDS[t]
    return " ".join(["FROM order_ o", *[j for t, _, j in JOINS if t in wanted]])


#: By root, the table a report begins with; the order of trial is the shop's: an order before its lines, their products, and customers.
ROOTS = {"Order": "order_ o", "OrderItem": "order_item oi", "Product": "product p", "Customer": "customer_ cu", "Address": "address addr", "Shipment": "shipment sh"}
_WITHOUT_ORDER = (("Shipment",), ("Customer",), ("Address", "Country"), ("Product", "pcm", "Category", "pmm", "Manufacturer"), ("OrderItem", "Product", "pcm", "Category", "pmm", "Manufacturer"))


def rooted(*tables: str) -> str:
    """FROM and the joins of a report that needs these tables: without orders where one branch holds them all."""
    for branch in _WITHOUT_ORDER:
        if {*tables} <= {*branch} and "Order" not in tables:
            wanted = {n for t in tables for n in (t, {"Category": "pcm", "Manufacturer": "pmm"}.get(t, t))} - {branch[0]}
            wanted |= {"Product"} if branch[0] == "OrderItem" and wanted else set()
            wanted |= set() if branch[0] != "Address" or "Country" not in tables else {"Country"}
            return " ".join([f"FROM {ROOTS[branch[0]]}", *[j for t, _, j in JOINS if t in wanted]])
    return joined(*tables)


def report(metric: str, dimension: str | None = None, where: str = "", also: tuple[str, ...] = (), order: str = "", limit: int | None = None, having: str = "") -> str:
    tables = [METRIC_TABLE.get(metric, "Order"), *also]
    label = ""
    if dimension:
        tables.append(DIMENSION[dimension][0])
        label = f"{DIMENSION[dimension][1]} AS label, "
    tables += [t for c, t in ((" o.", "Order"), ("(o.", "Order")) if c in f" {where}"]
    sql = f"SELECT {label}{METRIC[metric]} AS value {rooted(*tables)}"
    sql += f" WHERE {where}" * bool(where) + " GROUP BY 1" * bool(dimension)
    if having:
        sql = f"SELECT * FROM ({sql}) WHERE {having}"
    return with_views(sql + (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else ""))


TOP = "value DESC NULLS LAST, label ASC NULLS FIRST"
BOTTOM = "value ASC NULLS LAST, label ASC NULLS FIRST"
