"""The registered queries over the star, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions.dimensions import DIMENSIONS
from .functions.metrics import METRICS
from .functions.predicates import Predicate as P
from .plans import reports as R
from .plans.star_join import product_items, star_join
from .sources.star import StarSchema, load_star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The moment that time rules refer to.
AS_OF = datetime(2001, 8, 1)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def on_star(name: str, sql: str, f: Callable[[StarSchema], DataFrame]) -> None:
    register(name, sql)(lambda spark, path: f(load_star(spark, path)))


def on_report(name: str, spec: R.ReportSpec, sql: str) -> None:
    on_star(name, sql, lambda star: R.report(star, spec, AS_OF))


# metrics and dimensions
for _m in METRICS:
    on_report(f"metric_{_m}", R.ReportSpec(metric=_m), O.report(_m))
for _d in DIMENSIONS:
    on_report(f"metric_by_{_d}", R.ReportSpec("summary", "revenue", _d), O.report("revenue", _d))

# filters
_STATUS, _CATEGORY = "o.\"OrderStatusId\"", "c.\"Name\""
for _name, _filters, _where, _also in (
    ("filter_compare", (P("product_price", ">=", "950.5"), P("order_status", "eq", "complete")), "p.\"Price\" >= 950.5 AND o.\"OrderStatusId\" = 30", ("Product",)),
    ("filter_contains", (P("customer_email", "contains", "BUILD"),), "cu.\"Email\" LIKE '%build%'", ("Customer",)),
    ("filter_in", (P("OrderStatusId", "in", "10, 20"),), f"{_STATUS} IN (10, 20)", ()),
    ("filter_not_in", (P("category_name", "not in", ["ECONOMY", "PROMO"]),), f"{_CATEGORY} NOT IN ('ECONOMY', 'PROMO')", ("Category",)),
    ("filter_between", (P("product_stock", "between", "10,20"),), "p.\"StockQuantity\" BETWEEN 10 AND 20", ("Product",)),
    ("filter_null", (P("delivery_date", "is_null"),), "sh.\"DeliveryDateUtc\" IS NULL", ("Shipment",)),
    ("filter_not_null", (P("delivery_date", "is_not_null"),), "sh.\"DeliveryDateUtc\" IS NOT NULL", ("Shipment",)),
    ("filter_date_literal", (P("order_date", ">", "2000/03/15"),), "CAST(o.\"CreatedOnUtc\" AS DATE) > DATE '2000-03-15'", ()),
    ("filter_same_field_or", (P("payment_method", "=", "1-URGENT"), P("payment_method", "=", "5-LOW"), P("OrderStatusId", "=", 30)), "o.\"PaymentMethodSystemName\" IN ('1-URGENT', '5-LOW') AND o.\"OrderStatusId\" = 30", ()),
    ("filter_negatives", (P("payment_method", "!=", "1-URGENT"), P("payment_method", "not in", "2-HIGH"), P("payment_method", "is_not_null"), P("OrderStatusId", "!=", 10), P("OrderStatusId", "=", 30)), "o.\"PaymentMethodSystemName\" NOT IN ('1-URGENT', '2-HIGH') AND o.\"OrderStatusId\" = 30", ()),
    ("filter_range_pair", (P("product_price", ">", 920), P("product_price", "<", 960)), "p.\"Price\" > 920 AND p.\"Price\" < 960", ("Product",)),
    ("filter_metric_rowwise", (P("refund_amount", ">", 50000),), "o.\"RefundedAmount\" > 50000", ()),
    ("business_term", (P("status", "=", "abandoned"),), f"{_STATUS} = 40", ()),
    ("business_term_referral", (P("referral_source"),), "cu.\"AdminComment\" LIKE '%ref:%'", ("Customer",)),
):
    on_report(_name, R.ReportSpec("summary", "order_count", "payment_method", filters=_filters), O.report("order_count", "payment_method", _where, _also))
for _name, _role, _params, _where, _also in (
    ("row_policy", "analyst", {}, "cu.\"Active\" = 1", ("Customer",)),
    ("row_policy_region", "regional_manager", {"region_id": 3}, "addr.\"CountryId\" = 3", ("Address",)),
    ("row_policy_store", "store_manager", {"store_id": 2}, "o.\"StoreId\" = 2", ()),
    ("row_policy_chair", "dept_chair", {"department_id": 1}, "o.\"StoreId\" = 1", ()),
    ("row_policy_read_only", "read_only", {}, "", ()),
    ("row_policy_public", "public", {}, "", ()),
):
    on_report(_name, R.ReportSpec("summary", "revenue", "order_status", role=_role, role_params=_params), O.report("revenue", "order_status", _where, _also))

# time rules
_C = "o.\"CreatedOnUtc\""
for _rule, _where in {
    "today": f"CAST({_C} AS DATE) = DATE '2001-08-01'", "yesterday": f"CAST({_C} AS DATE) = DATE '2001-07-31'", "past 24 hours": f"{_C} >= TIMESTAMP '2001-07-31'",
    "past 30 days": f"{_C} >= TIMESTAMP '2001-07-02'", "90 days ago": f"{_C} <= TIMESTAMP '2001-05-03'", "this week": f"{_C} >= DATE '2001-07-30' AND {_C} < DATE '2001-08-06'",
    "last week": f"{_C} >= DATE '2001-07-23' AND {_C} < DATE '2001-07-30'", "this month": f"{_C} >= DATE '2001-08-01' AND {_C} < DATE '2001-09-01'", "last month": f"{_C} >= DATE '2001-07-01' AND {_C} < DATE '2001-08-01'",
    "this year": f"YEAR({_C}) = 2001", "last year": f"YEAR({_C}) = 2000", "this quarter": f"{_C} >= DATE '2001-07-01' AND {_C} < DATE '2001-10-01'", "last 90 days": f"{_C} >= TIMESTAMP '2001-05-03'",
    "last 6 months": f"{_C} >= DATE '2001-02-01'", "2000": f"YEAR({_C}) = 2000", "q2 2000": f"{_C} >= DATE '2000-04-01' AND {_C} < DATE '2000-07-01'", "past 48 hours": f"{_C} >= TIMESTAMP '2001-07-30'",
    "this morning": f"{_C} >= TIMESTAMP '2001-08-01' AND {_C} < TIMESTAMP '2001-08-01 12:00:00'",
}.items():
    on_report("time_" + _rule.replace(" ", "_"), R.ReportSpec("summary", "order_count", "order_status", time=_rule), O.report("order_count", "order_status", _where))

for _rule, _where in {"last week": f"{_C} >= DATE '2001-07-23'", "this month": f"{_C} >= DATE '2001-08-01'", "last month": f"{_C} >= DATE '2001-07-01'"}.items():
    on_report("time_" + _rule.replace(" ", "_") + "_open", R.ReportSpec("summary", "order_count", "order_status", time=_rule, open_windows=True), O.report("order_count", "order_status", _where))
for _m, _d in (("customer_count", "customer_registration_date"), ("item_quantity", "category_name"), ("line_item_revenue", "manufacturer_name"), ("shipment_count", "shipped_date")):
    on_report(f"rooted_{_m}", R.ReportSpec("summary", _m, _d), O.report(_m, _d))

# joins: rows and distinct keys on both sides of every edge
for _name, _tables, _keys, _sql in (
    ("join_order_customer", ("Customer",), ("o.Id", "cu.Id"), ("o.\"Id\"", "cu.\"Id\"")), ("join_order_items", ("OrderItem",), ("o.Id", "oi.ProductId"), ("o.\"Id\"", "oi.\"ProductId\"")),
    ("join_item_product", ("Product",), ("o.Id", "p.Id"), ("o.\"Id\"", "p.\"Id\"")), ("join_product_category", ("Category",), ("p.Id", "c.Id"), ("p.\"Id\"", "c.\"Id\"")),
    ("join_product_manufacturer", ("Manufacturer",), ("p.Id", "mf.Id"), ("p.\"Id\"", "mf.\"Id\"")), ("join_order_country", ("Country",), ("o.Id", "co.Name"), ("o.\"Id\"", "co.\"Name\"")),
    ("join_order_shipment", ("Shipment",), ("o.Id", "sh.Id"), ("o.\"Id\"", "sh.\"Id\"")), ("join_order_store", ("Store",), ("o.Id", "st.Name"), ("o.\"Id\"", "st.\"Name\"")),
    ("star_join", ("Category", "Country", "Customer", "Store"), ("o.Id", "c.Id"), ("o.\"Id\"", "c.\"Id\"")),
):
    on_star(_name, O.with_views(f"SELECT COUNT(*) AS n, COUNT(DISTINCT {_sql[0]}) AS n_left, COUNT(DISTINCT {_sql[1]}) AS n_right {O.joined(*_tables)}"),
            lambda star, t=_tables, k=_keys: star_join(star, t).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(k[0]).alias("n_left"), F.count_distinct(k[1]).alias("n_right")))
on_star("join_product_items", O.with_views("SELECT p.\"Id\" AS product, COUNT(oi.\"OrderId\") AS n FROM product p LEFT JOIN order_item oi ON p.\"Id\" = oi.\"ProductId\" GROUP BY 1"),
        lambda star: product_items(star).groupBy(F.col("p.Id").alias("product")).agg(F.count("oi.OrderId").alias("n")))
on_star("fanout_safe_metric", O.with_views(f"SELECT label, CAST(SUM(t) AS DOUBLE) AS value FROM (SELECT DISTINCT c.\"Name\" AS label, o.\"Id\", COALESCE(o.\"OrderTotal\",0) - COALESCE(o.\"RefundedAmount\",0) AS t {O.joined('Category')}) GROUP BY 1"),
        lambda star: R.fanout_safe(star, R.ReportSpec("summary", "revenue", "category_name")))

# patterns
on_report("report_kpi", R.ReportSpec("kpi", "profit", time="last year"), O.report("profit", None, f"YEAR({_C}) = 2000"))
on_report("report_ranking", R.ReportSpec("ranking", "line_item_revenue", "product_name", limit=5), O.report("line_item_revenue", "product_name", order=O.TOP, limit=5))
on_report("report_trend", R.ReportSpec("trend", "revenue", "order_month", time="last year"), O.report("revenue", "order_month", f"YEAR({_C}) = 2000", order="label", limit=100))
for _grain in ("day", "week", "month", "quarter", "year"):
    on_star("report_trend_grain" if _grain == "week" else f"report_trend_grain_{_grain}", O.with_views(f"SELECT CAST(CAST(date_trunc('{_grain}', {_C}) AS DATE) AS VARCHAR) AS label, {O.METRIC['order_count']} AS value {O.joined()} GROUP BY 1"),
            lambda star, g=_grain: R.trend(star, "order_count", g))
on_report("report_comparison", R.ReportSpec("comparison", "revenue", "category_name", filters=(P("category_name", "in", "ECONOMY,ring"),)), O.report("revenue", "category_name", f"{_CATEGORY} IN ('ECONOMY', 'ring')", order=O.TOP, limit=100))
on_star("report_comparison_pivot", O.with_views(f"SELECT CAST(YEAR({_C}) AS INTEGER) AS label, " + ", ".join(f"CAST(SUM(CASE WHEN o.\"ShippingMethod\" = '{v}' THEN COALESCE(o.\"OrderTotal\",0) - COALESCE(o.\"RefundedAmount\",0) END) AS DOUBLE) AS \"{v}\"" for v in ("Ground", "Express")) + f" {O.joined()} GROUP BY 1"),
        lambda star: R.comparison_pivot(star, "revenue", "order_year", "shipping_method", ["Ground", "Express"]))
on_report("report_segment", R.ReportSpec("segment", "revenue", "country_name"), O.report("revenue", "country_name", order=O.TOP, limit=100))
on_star("report_segment_share", O.with_views(f"SELECT label, value, ROUND(100 * value / SUM(value) OVER (), 4) AS pct FROM (SELECT o.\"PaymentMethodSystemName\" AS label, {O.METRIC['order_count']} AS value {O.joined()} GROUP BY 1)"),
        lambda star: R.share(R.report(star, R.ReportSpec("summary", "order_count", "payment_method"))))
on_report("report_summary", R.ReportSpec("summary", "tax_amount", "store_name"), O.report("tax_amount", "store_name"))
on_star("report_summary_multi", O.with_views(f"""SELECT a.label, revenue, order_count, item_quantity, shipment_count
  FROM (SELECT o."ShippingMethod" AS label, {O.METRIC['revenue']} AS revenue, {O.METRIC['order_count']} AS order_count {O.joined()} GROUP BY 1) a
  LEFT JOIN (SELECT o."ShippingMethod" AS label, {O.METRIC['item_quantity']} AS item_quantity {O.joined('OrderItem')} GROUP BY 1) b ON a.label = b.label
  LEFT JOIN (SELECT o."ShippingMethod" AS label, {O.METRIC['shipment_count']} AS shipment_count {O.joined('Shipment')} GROUP BY 1) c ON a.label = c.label"""),
        lambda star: R.summary(star, ["revenue", "order_count", "item_quantity", "shipment_count"], "shipping_method"))
on_star("report_funnel", O.with_views("""SELECT step, stage, orders, ROUND(CAST(orders AS DOUBLE) / LAG(orders) OVER (ORDER BY step), 6) AS step_rate FROM (
  SELECT 0 AS step, 'Pending' AS stage, COUNT(*) AS orders FROM order_ WHERE "OrderStatusId" >= 10 UNION ALL SELECT 1, 'Processing', COUNT(*) FROM order_ WHERE "OrderStatusId" >= 20
  UNION ALL SELECT 2, 'Complete', COUNT(*) FROM order_ WHERE "OrderStatusId" = 30)"""),
        lambda star: R.funnel(star, {"Pending": F.col("o.OrderStatusId") >= 10, "Processing": F.col("o.OrderStatusId") >= 20, "Complete": F.col("o.OrderStatusId") == 30}))
on_star("report_cohort", O.with_views("""SELECT CASE WHEN n = 1 THEN 'new' ELSE 'returning' END AS label, CAST(SUM("OrderTotal" - "RefundedAmount") AS DOUBLE) AS value
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "CustomerId" ORDER BY "CreatedOnUtc", "Id") AS n FROM order_) GROUP BY 1"""), lambda star: R.cohort(star))  # fmt: skip
on_star("report_correlate", O.with_views(f"SELECT ROUND(CORR(x, y), 6) AS corr, COUNT(*) AS n FROM (SELECT p.\"Name\" AS label, CAST({O.METRIC['line_item_revenue']} AS DOUBLE) AS x, CAST({O.METRIC['item_quantity']} AS DOUBLE) AS y {O.rooted('OrderItem', 'Product')} GROUP BY 1)"),
        lambda star: R.correlate(star, "line_item_revenue", "item_quantity", "product_name")[1])
on_star("report_tabular", O.with_views(f"SELECT o.\"CustomOrderNumber\" AS label, CAST(COALESCE(o.\"OrderTotal\",0) - COALESCE(o.\"RefundedAmount\",0) AS DOUBLE) AS value, CAST(o.\"OrderTotal\" AS DOUBLE) AS total, {O._day(_C)} AS date FROM order_ o WHERE {_STATUS} = 10 ORDER BY value DESC, label, total, date LIMIT 100"),
        lambda star: R.tabular(star, R.ReportSpec("tabular", "revenue", "order_number", filters=(P("OrderStatusId", "=", 10),)), AS_OF))
on_star("report_tabular_products", O.with_views(f"SELECT \"Sku\" AS label, \"StockQuantity\" AS stock, \"ApprovedTotalReviews\" AS reviews FROM product WHERE \"StockQuantity\" < 5 ORDER BY label NULLS FIRST, stock, reviews LIMIT 20"),
        lambda star: R.tabular(star, R.ReportSpec("tabular", None, "product_sku", filters=(P("product_stock", "<", 5),), limit=20), AS_OF))
on_star("report_exception", O.with_views(f"SELECT o.\"Id\" AS label, CAST(o.\"RefundedAmount\" AS DOUBLE) AS value, CAST(o.\"OrderTotal\" AS DOUBLE) AS total, {O._day(_C)} AS date FROM order_ o WHERE o.\"RefundedAmount\" > 50 ORDER BY value DESC, label, total, date LIMIT 100"),
        lambda star: R.exception(star, R.ReportSpec("exception", "refund_amount", "order_id", filters=(P("refund_amount", ">", 50),)), AS_OF))
on_star("report_exception_group", O.report("order_count", "customer_email", having="value > 15"), lambda star: R.exception_group(star, R.ReportSpec("exception", "order_count", "customer_email"), F.col("value") > 15))

# sort and limit
on_report("topk", R.ReportSpec("ranking", "revenue", "customer_name", limit=10), O.report("revenue", "customer_name", order=O.TOP, limit=10))
on_report("bottomk", R.ReportSpec("ranking", "revenue", "customer_name", sort="asc", limit=10), O.report("revenue", "customer_name", order=O.BOTTOM, limit=10))
on_report("default_limit", R.ReportSpec("ranking", "order_count", "order_id", sort="whatever"), O.report("order_count", "order_id", order=O.TOP, limit=100))
on_star("listing_limit", O.with_views(f"SELECT \"Email\" AS label, {O._day('"CreatedOnUtc"')} AS registered_on FROM customer_ ORDER BY label, registered_on LIMIT 100"),
        lambda star: R.tabular(star, R.ReportSpec("tabular", None, "customer_email"), AS_OF))
