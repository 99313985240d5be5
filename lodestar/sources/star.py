"""The star schema: table names, aliases, and the shop's tables as views of the test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

#: Alias of each table.
ALIASES = {
    "Order": "o", "OrderItem": "oi", "Product": "p", "Category": "c",
    "Product_Category_Mapping": "pcm", "Product_Manufacturer_Mapping": "pmm",
    "Manufacturer": "mf", "Address": "addr", "Country": "co", "Shipment": "sh",
    "Store": "st", "Customer": "cu",
}

#: Columns of Order that are sums over its lines.
ORDER_LINE_SUMS = ("OrderSubtotalExclTax", "OrderTax", "OrderDiscount", "RefundedAmount")

#: Lines that a task sorts or groups at once.
PIECE = 250_000


def pieces(lines: DataFrame) -> int | None:
    """The parts into which lines are dealt before they are grouped, so that a task holds about PIECE of them
    however many there are; adaptive execution leaves that number. None if they are one piece."""
    n = -(-lines.count() // PIECE)
    return max(n, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else None


@dataclass(frozen=True)
class StarSchema:
    """Named tables. A table is a function of the columns asked for, so that columns which cost a join
    are only made when a report uses them."""

    tables: dict[str, Callable[[frozenset[str]], DataFrame]]
    #: Order with columns and a condition, where it can be made cheaper than by filtering the table.
    filtered: Callable[[frozenset[str], Column], DataFrame] | None = None

    def table(self, name: str, columns: Iterable[str] = ()) -> DataFrame:
        """The table under its alias, with these columns at least."""
        return self.tables[name](frozenset(columns)).alias(ALIASES[name])

    def orders(self, columns: Iterable[str], where: Column) -> DataFrame:
        """Order under its alias, with these columns at least, filtered. where reads no sums over lines."""
        if self.filtered:
            return self.filtered(frozenset(columns), where).alias(ALIASES["Order"])
        return self.table("Order", columns).where(where)

    def replaced(self, **tables: DataFrame) -> StarSchema:
        return StarSchema(self.tables | {k: (lambda _, d=d: d) for k, d in tables.items()}, None if "Order" in tables else self.filtered)


def of_frames(frames: dict[str, DataFrame]) -> StarSchema:
    return StarSchema({k: (lambda _, d=d: d) for k, d in frames.items()})


def money(x: Column) -> Column:
    return x.cast(MONEY)


def _days(start: str, n: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), n.cast("int")).cast("timestamp_ntz")


def load_star(spark: SparkSession, path: str) -> StarSchema:
    """The shop's tables over orders, lineitem, part, customer, nation and region in path."""
    base = lambda name: spark.read.parquet(f"{path}/{name}.parquet")

    def lines() -> DataFrame:
        price = money(F.col("l_extendedprice"))
        share = lambda c: money(price * F.col(c).cast("decimal(4,2)"))
        return base("lineitem").withColumns({"price": price, "discount": share("l_discount"), "tax": share("l_tax")})

    def product(_: frozenset[str]) -> DataFrame:
        key, price = F.col("p_partkey"), money(F.col("p_retailprice"))
        return base("part").select(
            key.alias("Id"), F.col("p_name").alias("Name"), F.concat("p_brand", F.lit("-"), key.cast("string")).alias("Sku"),
            price.alias("Price"), money(price * F.lit("0.6").cast("decimal(2,1)")).alias("ProductCost"), F.col("p_size").cast("int").alias("StockQuantity"),
            F.lit(5).alias("MinStockQuantity"), (key % 400).cast("int").alias("ApprovedTotalReviews"), (key % 10 != 0).cast("int").alias("Published"),
            _days("1995-01-01", key % 2000).alias("CreatedOnUtc"),
        )

    def order(columns: frozenset[str], where: Column | None = None) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        rank = F.substring("o_orderpriority", 1, 1)
        out = base("orders").select(
            key.alias("Id"), F.concat(F.lit("ORD-"), key.cast("string")).alias("CustomOrderNumber"), customer.alias("CustomerId"), customer.alias("BillingAddressId"),
            (key % 5).alias("StoreId"), F.when(F.col("o_orderstatus") == "P", 10).when(F.col("o_orderstatus") == "O", 20).otherwise(30).alias("OrderStatusId"),
            F.when(rank == "1", 10).when(rank == "2", 20).when(rank == "3", 30).when(rank == "4", 35).otherwise(40).alias("PaymentStatusId"),
            ((key % 5 + 1) * 10).cast("int").alias("ShippingStatusId"), F.col("o_orderpriority").alias("PaymentMethodSystemName"),
            F.element_at(F.array(*map(F.lit, ("BDT", "USD", "GBP", "INR"))), (customer % 4 + 1).cast("int")).alias("CustomerCurrencyCode"),
            F.when(key % 2 == 0, "Ground").otherwise("Express").alias("ShippingMethod"),
            money(F.element_at(F.array(*map(F.lit, (60, 120, 150))), (key % 3 + 1).cast("int"))).alias("OrderShippingExclTax"),
            money(F.col("o_totalprice")).alias("OrderTotal"), F.col("o_orderdate").cast("timestamp_ntz").alias("CreatedOnUtc"),
        )
        if where is not None:
            out = out.alias(ALIASES["Order"]).where(where)
        if not columns & {*ORDER_LINE_SUMS}:
            return out
        zero = F.lit(0).cast(MONEY)
        # of filtered orders, only their own lines are summed; the join that finds them has the grouping's key.
        # Most lines are another order's than those before them: summing them before they move would only fill tables
        if where is None:
            own = lines() if (n := pieces(base("lineitem"))) is None else lines().repartition(n, "l_orderkey")
        else:
            own = lines().join(out.select(F.col("Id").alias("own")), F.col("l_orderkey") == F.col("own"), "left_semi")
        sums = own.groupBy(F.col("l_orderkey").alias("k")).agg(
            F.sum("price").alias("OrderSubtotalExclTax"), F.sum("tax").alias("OrderTax"), F.sum("discount").alias("OrderDiscount"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("price")).otherwise(zero)).alias("RefundedAmount"),
        )
        return out.join(sums, out["Id"] == sums["k"], "left").withColumns({c: F.coalesce(money(F.col(c)), zero) for c in ORDER_LINE_SUMS}).drop("k")

    def order_item(columns: frozenset[str]) -> DataFrame:
        cost = {"OriginalProductCost"} & columns
        found = lines()
        if cost:
            found = found.join(product(frozenset()).select(F.col("Id").alias("pid"), "ProductCost"), F.col("l_partkey") == F.col("pid"), "left")
        quantity = F.col("l_quantity").cast("int")
        return found.select(
            F.col("l_orderkey").alias("OrderId"), F.col("l_partkey").alias("ProductId"), quantity.alias("Quantity"), F.col("price").alias("PriceExclTax"),
            F.col("discount").alias("DiscountAmountExclTax"), *([money(quantity * F.col("ProductCost")).alias("OriginalProductCost")] if cost else []),
        )

    def second_word() -> Column:
        return F.get(F.split("p_name", " "), F.lit(1))

    def category(_: frozenset[str]) -> DataFrame:
        names = base("part").select(F.col("p_type").alias("Name")).union(base("part").select(second_word())).distinct()
        return names.select(F.col("Name").alias("Id"), "Name")

    def product_category(_: frozenset[str]) -> DataFrame:
        link = base("part").select(F.col("p_partkey").alias("ProductId"), F.col("p_type").alias("CategoryId"))
        return link.union(base("part").select("p_partkey", second_word()))

    def manufacturer(_: frozenset[str]) -> DataFrame:
        return base("part").select(F.col("p_brand").alias("Id"), F.col("p_brand").alias("Name")).distinct()

    def product_manufacturer(_: frozenset[str]) -> DataFrame:
        return base("part").where(F.col("p_partkey") % 5 != 0).select(F.col("p_partkey").alias("ProductId"), F.col("p_brand").alias("ManufacturerId"))

    def customer(_: frozenset[str]) -> DataFrame:
        key, segment = F.col("c_custkey"), F.lower("c_mktsegment")
        return base("customer").select(
            key.alias("Id"), F.col("c_mktsegment").alias("FirstName"), F.col("c_name").alias("LastName"), F.concat(segment, F.lit("."), key.cast("string"), F.lit("@example.com")).alias("Email"),
            (F.col("c_acctbal") >= 0).cast("int").alias("Active"), F.when(key % 7 == 0, F.concat(F.lit("ref:"), segment)).alias("AdminComment"), _days("1994-01-01", key % 2500).alias("CreatedOnUtc"),
        )

    def address(_: frozenset[str]) -> DataFrame:
        return base("customer").select(F.col("c_custkey").alias("Id"), F.col("c_nationkey").alias("CountryId"), F.concat(F.lit("CITY_"), (F.col("c_custkey") % 50).cast("string")).alias("City"))

    def shipment(_: frozenset[str]) -> DataFrame:
        day = F.to_date("l_shipdate")
        each = base("lineitem").groupBy(F.col("l_orderkey").alias("OrderId"), day.alias("day")).agg(F.min("l_linestatus").alias("status"))
        return each.select(
            F.concat(F.col("OrderId").cast("string"), F.lit("/"), F.date_format("day", "yyyy-MM-dd")).alias("Id"), "OrderId", F.concat(F.lit("TRK"), F.col("OrderId").cast("string")).alias("TrackingNumber"),
            F.col("day").cast("timestamp_ntz").alias("ShippedDateUtc"), F.when(F.col("status") == "F", F.date_add("day", 3)).cast("timestamp_ntz").alias("DeliveryDateUtc"),
        )

    return StarSchema({
        "Order": order, "OrderItem": order_item, "Product": product, "Category": category, "Product_Category_Mapping": product_category,
        "Manufacturer": manufacturer, "Product_Manufacturer_Mapping": product_manufacturer, "Customer": customer, "Address": address,
        "Country": lambda _: base("nation").select(F.col("n_nationkey").alias("Id"), F.col("n_name").alias("Name")),
        "Shipment": shipment, "Store": lambda _: base("region").select(F.col("r_regionkey").alias("Id"), F.col("r_name").alias("Name")),
    }, order)


def load_star_jdbc(spark: SparkSession, url: str, bounds: dict[str, tuple[str, int, int, int]], properties: dict[str, str], quote: str = '"') -> StarSchema:
    """The tables from a database: for each, the split column, its bounds and the number of connections.

    quote: the database's mark around names, as Order is a word of SQL.
    """

    def read(name: str) -> Callable[[frozenset[str]], DataFrame]:
        column, low, high, n = bounds[name]
        return lambda _: spark.read.jdbc(url, f"{quote}{name}{quote}", column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=properties)

    return StarSchema({name: read(name) for name in bounds})
