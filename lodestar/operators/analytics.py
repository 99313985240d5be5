"""Standard shop reports and window analytics over the star schema.

Windows without partitions only run over grouped results (months, stages), never over facts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import dimension
from ..functions.metrics import metric
from ..functions.timewin import in_window
from ..plans.reports import ReportSpec, report, rows, share
from ..sources.star import StarSchema, pieces
from ..plans.star_join import star_join
from .evaluation import at_ranks, between_ranks

_MONTH = "yyyy-MM"


def _day(c: str) -> Column:
    return F.date_format(F.to_date(c), "yyyy-MM-dd")


def _since(moment: datetime) -> Column:
    return in_window(F.col("o.CreatedOnUtc"), (moment, None))


# ------------------------------------------------------------------ standard reports


def sales_summary(star: StarSchema) -> DataFrame:
    """Revenue and orders by day."""
    ms = [metric("revenue"), metric("order_count")]
    return rows(star, ms).groupBy(_day("o.CreatedOnUtc").alias("label")).agg(*[m.agg().alias(m.id) for m in ms])


def bestsellers(star: StarSchema, n: int = 10) -> DataFrame:
    return report(star, ReportSpec("ranking", "item_quantity", "product_name", limit=n))


def low_stock(star: StarSchema) -> DataFrame:
    return star.table("Product").where(F.col("p.StockQuantity") < F.col("p.MinStockQuantity")).select("p.Id", "p.Sku", "p.StockQuantity", "p.MinStockQuantity")


def never_sold(star: StarSchema, since: datetime | None = None) -> DataFrame:
    """Products without a line, or without one in an order since a moment."""
    lines = star.table("OrderItem")
    if since is not None:
        lines = lines.join(star.table("Order").where(_since(since)), F.col("oi.OrderId") == F.col("o.Id"), "left_semi")
    return star.table("Product").join(lines, F.col("p.Id") == F.col("oi.ProductId"), "left_anti").select("p.Id", "p.Sku")


def country_sales(star: StarSchema) -> DataFrame:
    return report(star, ReportSpec("summary", "revenue", "country_name"))


def registered_customers(star: StarSchema) -> DataFrame:
    """Customers by the day they registered."""
    return star.table("Customer").groupBy(_day("cu.CreatedOnUtc").alias("label")).agg(F.count(F.lit(1)).alias("value"))


def best_customers(star: StarSchema, by: str, n: int = 10) -> DataFrame:
    """The customers with the most revenue or orders. by: a metric of orders."""
    return report(star, ReportSpec("ranking", by, "customer_email", limit=n))


# ------------------------------------------------------------------ windows


def month_over_month(star: StarSchema, metric_id: str = "avg_order_value") -> DataFrame:
    """A metric by month and its growth over the month before in the list."""
    by_month = report(star, ReportSpec("summary", metric_id, "order_month"))
    before = F.lag("value").over(Window.orderBy("label"))
    return by_month.select("label", "value", F.round(F.try_divide(F.col("value") - before, before), 6).alias("growth"))


def year_over_year(star: StarSchema, year: int, metric_id: str = "line_item_revenue", by: str = "category_name") -> DataFrame:
    """Labels whose metric fell from the year before: one pass, a conditional sum for each year."""
    m, d = metric(metric_id), dimension(by)
    ordered = F.year("o.CreatedOnUtc")
    window = in_window(F.col("o.CreatedOnUtc"), (datetime(year - 1, 1, 1), datetime(year + 1, 1, 1)))
    both = rows(star, [m, d], orders=window).groupBy(d.as_label().alias("label")).agg(*[F.sum(F.when(ordered == y, m.row())).cast("double").alias(n) for n, y in (("this_year", year), ("last_year", year - 1))])
    return both.where(F.col("this_year") < F.col("last_year"))


def first_order_value(star: StarSchema, n: int) -> DataFrame:
    """The customers with the largest first order."""
    o = star.table("Order")
    first = o.groupBy(F.col("o.CustomerId").alias("customer")).agg(F.min_by("o.OrderTotal", F.struct("o.CreatedOnUtc", "o.Id")).cast("double").alias("value"))
    return first.orderBy(F.desc("value"), "customer").limit(n)


def new_vs_returning(star: StarSchema) -> DataFrame:
    """Orders, share and average value of first and later orders."""
    o = star.table("Order")
    first = o.groupBy(F.col("o.CustomerId").alias("c")).agg(F.min_by("o.Id", F.struct("o.CreatedOnUtc", "o.Id")).alias("first"))
    kind = F.when(F.col("o.Id") == F.col("first"), "new").otherwise("returning").alias("label")
    grouped = o.join(first, F.col("o.CustomerId") == F.col("c")).groupBy(kind).agg(F.count(F.lit(1)).alias("value"), (F.sum("o.OrderTotal").cast("double") / F.count(F.lit(1))).alias("avg_value"))
    return share(grouped.select("label", "value")).join(grouped.select("label", "avg_value"), "label")


def top_decile_value(star: StarSchema, share_of: float = 0.1) -> DataFrame:
    """Mean lifetime value of the customers who spend most. Ranks the grouped table by value alone:
    ties at the border are in."""
    spent = star.table("Order").groupBy("o.CustomerId").agg(F.sum("o.OrderTotal").cast("double").alias("spent"))
    share = 1 - share_of
    ranked = at_ranks(spent.withColumn("all", F.lit(0)), "all", "spent", {"below": (share, lambda n: F.floor((n - 1) * F.lit(share))), "above": (share, lambda n: F.ceil((n - 1) * F.lit(share)))})
    border = ranked.select(between_ranks(F.col("n"), share, F.col("below"), F.col("above")).alias("border"))  # one row
    return spent.join(F.broadcast(border), F.col("spent") >= F.col("border")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("spent"), 2).alias("value"))


def top_n_daily(star: StarSchema, n: int) -> DataFrame:
    """Units by day of the products that sold most units overall."""
    top = star.table("OrderItem").groupBy(F.col("oi.ProductId").alias("product")).agg(F.sum("oi.Quantity").alias("q")).orderBy(F.desc("q"), "product").limit(n)
    lines = star.table("OrderItem").join(F.broadcast(top.select("product")), F.col("oi.ProductId") == F.col("product"))
    return lines.join(star.table("Order"), F.col("oi.OrderId") == F.col("o.Id")).groupBy(_day("o.CreatedOnUtc").alias("label"), "product").agg(F.sum("oi.Quantity").alias("value"))


def top_n_snapshot(star: StarSchema, n: int) -> DataFrame:
    """Month by category, for the categories with most line revenue: revenue, units and orders."""
    sold = rows(star, [metric("line_item_revenue"), dimension("category_name")])  # no orders
    top = sold.groupBy(F.col("c.Name").alias("category")).agg(F.sum("oi.PriceExclTax").alias("r")).orderBy(F.desc("r"), "category").limit(n).select("category")
    joined = rows(star, [metric("line_item_revenue"), metric("item_quantity"), dimension("category_name")], also=["Order"], once=True)
    ms = [metric(m) for m in ("line_item_revenue", "item_quantity", "order_count")]
    return joined.join(F.broadcast(top), F.col("c.Name") == F.col("category")).groupBy(F.date_format("o.CreatedOnUtc", _MONTH).alias("label"), "category").agg(*[m.agg().alias(m.id) for m in ms])


# ------------------------------------------------------------------ other questions


def quarter_by_category(star: StarSchema) -> DataFrame:
    m, d = metric("line_item_revenue"), dimension("category_name")
    quarter = F.date_format(F.to_date(F.date_trunc("quarter", "o.CreatedOnUtc")), "yyyy-MM-dd")
    return rows(star, [m, d], also=["Order"]).groupBy(quarter.alias("quarter"), d.as_label().alias("label")).agg(m.agg().alias("value"))


def refund_share_by_month(star: StarSchema) -> DataFrame:
    """Refunds as a percentage of order totals."""
    o = star.table("Order", {"RefundedAmount"})
    pct = F.round(100 * F.try_divide(F.sum("o.RefundedAmount").cast("double"), F.sum("o.OrderTotal").cast("double")), 6)
    return o.groupBy(F.date_format("o.CreatedOnUtc", _MONTH).alias("label")).agg(pct.alias("value"))


def refund_rate_by_category(star: StarSchema) -> DataFrame:
    """Share of a category's orders that have a refund."""
    d = dimension("category_name")
    refunded = F.max((F.col("o.RefundedAmount") > 0) & F.col("o.Id").isNotNull())
    once = rows(star, [metric("refund_count"), d]).groupBy(d.as_label().alias("label"), F.col("o.Id").alias("Id")).agg(refunded.alias("refunded"))
    return once.groupBy("label").agg(F.round(F.try_divide(F.count_if("refunded").cast("double"), F.count("Id")), 6).alias("value"))


def stale_low_stock(star: StarSchema, since: datetime, below: int) -> DataFrame:
    """Products with little stock that no order since a moment has."""
    products = star.table("Product").where(F.col("p.StockQuantity") < below)
    recent = star.table("OrderItem").join(star.table("Order").where(_since(since)), F.col("oi.OrderId") == F.col("o.Id"), "left_semi")
    return products.join(recent, F.col("p.Id") == F.col("oi.ProductId"), "left_anti").select("p.Id", "p.Sku", "p.StockQuantity")


def lapsed_big_spenders(star: StarSchema, spent: float, since: datetime) -> DataFrame:
    """Customers who spent more than an amount and have not ordered since a moment."""
    per = star.table("Order").groupBy(F.col("o.CustomerId").alias("customer")).agg(F.sum("o.OrderTotal").cast("double").alias("spent"), F.max("o.CreatedOnUtc").alias("last"))
    return per.where((F.col("spent") > spent) & ~in_window(F.col("last"), (since, None))).select("customer", "spent", _day("last").alias("last"))


def ship_delay(star: StarSchema, days: int) -> DataFrame:
    """Shipments that left more than some days after their order."""
    delay = F.datediff("sh.ShippedDateUtc", "o.CreatedOnUtc")
    return star_join(star, ["Shipment"]).where(delay > days).select(F.col("o.Id").alias("order_id"), F.col("sh.Id").alias("shipment_id"), delay.alias("days"))


def avg_time_to_ship(star: StarSchema) -> DataFrame:
    """Mean days from order to shipment, of shipments after their order's day."""
    delay = F.datediff("sh.ShippedDateUtc", "o.CreatedOnUtc")
    return star_join(star, ["Shipment"]).where(delay > 0).agg(F.round(F.avg(delay), 6).alias("value"), F.count(F.lit(1)).alias("n"))


def frequent_buyer_revenue(star: StarSchema, more_than: int) -> DataFrame:
    """Revenue from customers with more orders than a number: one grouping by customer."""
    m = metric("revenue")
    per = star.table("Order", m.columns).groupBy("o.CustomerId").agg(F.count(F.lit(1)).alias("orders"), F.sum(m.row()).alias("revenue"))
    return per.where(F.col("orders") > more_than).agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").cast("double").alias("value"))


def items_per_order_of_top_category(star: StarSchema) -> DataFrame:
    """Mean units per order of the category with most units."""
    joined = rows(star, [metric("item_quantity"), dimension("category_name")], also=["Order"], once=True).where(F.col("c.Name").isNotNull())
    per = joined.groupBy(F.col("c.Name").alias("label")).agg(F.sum("oi.Quantity").alias("q"), F.count_distinct("o.Id").alias("n"))
    return per.orderBy(F.desc("q"), "label").limit(1).select("label", F.round(F.col("q") / F.col("n"), 6).alias("value"))


def peak_hours(events: DataFrame, first: int = 18, last: int = 21) -> DataFrame:
    """Events by hour, from an hour up to another."""
    hour = F.hour("ts")
    return events.where((hour >= first) & (hour < last)).groupBy(hour.alias("label")).agg(F.count(F.lit(1)).alias("value"))


def per_payment_method(star: StarSchema) -> DataFrame:
    """Orders, revenue and mean shipping cost by payment method."""
    o = star.table("Order", {"RefundedAmount"})
    shipping = F.round(F.sum("o.OrderShippingExclTax").cast("double") / F.count(F.lit(1)), 6)
    return o.groupBy(F.col("o.PaymentMethodSystemName").alias("label")).agg(metric("order_count").agg().alias("orders"), metric("revenue").agg().alias("revenue"), shipping.alias("avg_shipping"))


def attribute_margin(star: StarSchema) -> DataFrame:
    """Correlation of each numeric product attribute with the margin of its lines."""
    lines = star.table("OrderItem", {"OriginalProductCost"}).join(star.table("Product"), F.col("oi.ProductId") == F.col("p.Id"))
    margin = (F.col("oi.PriceExclTax") - F.col("oi.OriginalProductCost")).cast("double")
    attributes = ("Price", "StockQuantity", "ApprovedTotalReviews")
    found = lines.agg(*[F.round(F.corr(F.col(f"p.{a}").cast("double"), margin), 6).alias(a) for a in attributes])
    return found.unpivot([], list(attributes), "attribute", "corr")


def basket_pairs(star: StarSchema, top: int) -> DataFrame:
    """The product pairs in most orders: distinct products of an order against those above them.

    Nearly every pair is another one, so pairs are counted where they meet, in as many parts as lines are.
    """
    a = star.table("OrderItem").select(F.col("oi.OrderId").alias("o"), F.col("oi.ProductId").alias("a"))
    n = pieces(a)
    spread = lambda df, *keys: df if n is None else df.repartition(n, *keys)
    a = spread(a, "o").distinct()
    b = a.select(F.col("o").alias("o2"), F.col("a").alias("b"))
    pairs = a.join(b, (F.col("o") == F.col("o2")) & (F.col("a") < F.col("b"))).select("a", "b")
    return spread(pairs, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "a", "b").limit(top)
