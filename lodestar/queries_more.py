"""More registered queries: shop reports, windows, text tagging, evaluation, catalog and preparation jobs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from . import oracle as O
from .operators import analytics as A
from .plans import reports as R
from .queries import AS_OF, QUERIES, SQL, on_report, on_star, register

__all__ = ["QUERIES", "SQL"]
_C = "o.\"CreatedOnUtc\""
_MONTH = f"strftime({_C}, '%Y-%m')"

# standard reports
on_star("sales_summary", O.with_views(f"SELECT {O._day(_C)} AS label, {O.METRIC['revenue']} AS revenue, {O.METRIC['order_count']} AS order_count {O.joined()} GROUP BY 1"), A.sales_summary)
on_star("bestsellers", O.report("item_quantity", "product_name", order=O.TOP, limit=10), A.bestsellers)
on_star("low_stock", O.with_views('SELECT "Id", "Sku", "StockQuantity", "MinStockQuantity" FROM product WHERE "StockQuantity" < "MinStockQuantity"'), A.low_stock)
_RECENT = 'SELECT oi."ProductId" FROM order_item oi JOIN order_ o ON oi."OrderId" = o."Id" WHERE o."CreatedOnUtc" >= DATE \'2001-06-02\''
on_star("never_sold", O.with_views(f'SELECT "Id", "Sku" FROM product WHERE "Id" NOT IN ({_RECENT})'), lambda star: A.never_sold(star, AS_OF - timedelta(days=60)))
on_star("country_sales", O.report("revenue", "country_name"), A.country_sales)
on_star("registered_customers", O.with_views(f"SELECT {O._day('"CreatedOnUtc"')} AS label, COUNT(*) AS value FROM customer_ GROUP BY 1"), A.registered_customers)
on_star("best_customers_by_total", O.report("revenue", "customer_email", order=O.TOP, limit=10), lambda star: A.best_customers(star, "revenue"))
on_star("best_customers_by_orders", O.report("order_count", "customer_email", order=O.TOP, limit=10), lambda star: A.best_customers(star, "order_count"))

# windows
on_star("growth_rate_mom", O.with_views(f"SELECT label, value, ROUND((value - LAG(value) OVER w) / LAG(value) OVER w, 6) AS growth FROM (SELECT {_MONTH} AS label, {O.METRIC['avg_order_value']} AS value {O.joined()} GROUP BY 1) WINDOW w AS (ORDER BY label)"), A.month_over_month)
on_star("yoy_decline", O.with_views(f"""SELECT * FROM (SELECT c."Name" AS label, CAST(SUM(CASE WHEN YEAR({_C}) = 2000 THEN oi."PriceExclTax" END) AS DOUBLE) AS this_year,
  CAST(SUM(CASE WHEN YEAR({_C}) = 1999 THEN oi."PriceExclTax" END) AS DOUBLE) AS last_year {O.joined('Category')} GROUP BY 1) WHERE this_year < last_year"""), lambda star: A.year_over_year(star, 2000))
on_star("first_order_value_top", O.with_views("""SELECT "CustomerId" AS customer, CAST("OrderTotal" AS DOUBLE) AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "CustomerId" ORDER BY "CreatedOnUtc", "Id") AS n FROM order_)
  WHERE n = 1 ORDER BY value DESC, customer LIMIT 20"""), lambda star: A.first_order_value(star, 20))
on_star("new_vs_returning", O.with_views("""SELECT label, value, ROUND(100 * value / SUM(value) OVER (), 4) AS pct, avg_value FROM (
  SELECT CASE WHEN n = 1 THEN 'new' ELSE 'returning' END AS label, COUNT(*) AS value, CAST(SUM("OrderTotal") AS DOUBLE) / COUNT(*) AS avg_value
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "CustomerId" ORDER BY "CreatedOnUtc", "Id") AS n FROM order_) GROUP BY 1)"""), A.new_vs_returning)
on_star("top_decile_ltv", O.with_views("""SELECT COUNT(*) AS customers, ROUND(AVG(spent), 2) AS value FROM (SELECT CAST(SUM("OrderTotal") AS DOUBLE) AS spent FROM order_ GROUP BY "CustomerId")
  WHERE spent >= (SELECT QUANTILE_CONT(spent, 0.9) FROM (SELECT CAST(SUM("OrderTotal") AS DOUBLE) AS spent FROM order_ GROUP BY "CustomerId"))"""), A.top_decile_value)
on_star("top_n_daily", O.with_views(f"""SELECT {O._day(_C)} AS label, oi."ProductId" AS product, CAST(SUM(oi."Quantity") AS BIGINT) AS value FROM order_item oi JOIN order_ o ON oi."OrderId" = o."Id"
  WHERE oi."ProductId" IN (SELECT "ProductId" FROM order_item GROUP BY 1 ORDER BY SUM("Quantity") DESC, 1 LIMIT 5) GROUP BY 1, 2"""), lambda star: A.top_n_daily(star, 5))
on_star("top_n_snapshot", O.with_views(f"""SELECT {_MONTH} AS label, c."Name" AS category, {O.METRIC['line_item_revenue']} AS line_item_revenue, {O.METRIC['item_quantity']} AS item_quantity, {O.METRIC['order_count']} AS order_count {O.joined('Category')}
  WHERE c."Name" IN (SELECT c."Name" {O.joined('Category')} GROUP BY 1 ORDER BY SUM(oi."PriceExclTax") DESC NULLS LAST, 1 LIMIT 5) GROUP BY 1, 2"""), lambda star: A.top_n_snapshot(star, 5))

# other questions
on_star("weekly_orders", O.with_views(f"SELECT CAST(CAST(date_trunc('week', {_C}) AS DATE) AS VARCHAR) AS label, {O.METRIC['order_count']} AS value {O.joined()} WHERE {_C} >= DATE '2001-02-01' GROUP BY 1"),
        lambda star: R.trend(star, "order_count", "week", R.ReportSpec(time="last 6 months"), AS_OF))
on_star("quarter_by_category", O.with_views(f"SELECT CAST(CAST(date_trunc('quarter', {_C}) AS DATE) AS VARCHAR) AS quarter, c.\"Name\" AS label, {O.METRIC['line_item_revenue']} AS value {O.joined('Category')} GROUP BY 1, 2"), A.quarter_by_category)
on_star("refund_pct_trend", O.with_views(f"SELECT {_MONTH} AS label, ROUND(100 * CAST(SUM(o.\"RefundedAmount\") AS DOUBLE) / CAST(SUM(o.\"OrderTotal\") AS DOUBLE), 6) AS value {O.joined()} GROUP BY 1"), A.refund_share_by_month)
on_star("refund_rate_by_category", O.with_views(f"SELECT c.\"Name\" AS label, ROUND(CAST({O.METRIC['refund_count']} AS DOUBLE) / COUNT(DISTINCT o.\"Id\"), 6) AS value {O.joined('Category')} GROUP BY 1"), A.refund_rate_by_category)
on_star("stale_low_stock", O.with_views(f'SELECT "Id", "Sku", "StockQuantity" FROM product WHERE "StockQuantity" < 5 AND "Id" NOT IN ({_RECENT})'), lambda star: A.stale_low_stock(star, AS_OF - timedelta(days=60), 5))
on_star("lapsed_big_spenders", O.with_views(f"""SELECT * FROM (SELECT "CustomerId" AS customer, CAST(SUM("OrderTotal") AS DOUBLE) AS spent, {O._day('MAX("CreatedOnUtc")')} AS last FROM order_ GROUP BY 1)
  WHERE spent > 2000000 AND CAST(last AS DATE) < DATE '2001-05-03'"""), lambda star: A.lapsed_big_spenders(star, 2_000_000, AS_OF - timedelta(days=90)))
_DELAY = f"CAST(date_diff('day', CAST({_C} AS DATE), sh.\"ShippedDateUtc\") AS INTEGER)"
on_star("ship_delay", O.with_views(f"SELECT o.\"Id\" AS order_id, sh.\"Id\" AS shipment_id, {_DELAY} AS days {O.joined('Shipment')} WHERE {_DELAY} > 5"), lambda star: A.ship_delay(star, 5))
on_star("avg_time_to_ship", O.with_views(f"SELECT ROUND(AVG({_DELAY}), 6) AS value, COUNT(*) AS n {O.joined('Shipment')} WHERE {_DELAY} > 0"), A.avg_time_to_ship)
on_star("frequent_buyer_revenue", O.with_views("""SELECT COUNT(*) AS customers, CAST(SUM(r) AS DOUBLE) AS value FROM (SELECT COUNT(*) AS n, SUM("OrderTotal" - "RefundedAmount") AS r FROM order_ GROUP BY "CustomerId") WHERE n > 5"""), lambda star: A.frequent_buyer_revenue(star, 5))
on_star("items_per_order_top_category", O.with_views(f"SELECT label, ROUND(q / n, 6) AS value FROM (SELECT c.\"Name\" AS label, SUM(oi.\"Quantity\") AS q, COUNT(DISTINCT o.\"Id\") AS n {O.joined('Category')} WHERE c.\"Name\" IS NOT NULL GROUP BY 1 ORDER BY q DESC, label LIMIT 1)"), A.items_per_order_of_top_category)
register("peak_hours", "SELECT CAST(HOUR(ts) AS INTEGER) AS label, COUNT(*) AS value FROM events WHERE HOUR(ts) BETWEEN 18 AND 20 GROUP BY 1")(lambda spark, path: A.peak_hours(spark.read.parquet(f"{path}/events.parquet")))
on_star("avg_per_payment_method", O.with_views(f"SELECT o.\"PaymentMethodSystemName\" AS label, {O.METRIC['order_count']} AS orders, {O.METRIC['revenue']} AS revenue, ROUND(CAST(SUM(o.\"OrderShippingExclTax\") AS DOUBLE) / COUNT(*), 6) AS avg_shipping {O.joined()} GROUP BY 1"), A.per_payment_method)
_MARGIN = 'CAST(oi."PriceExclTax" - oi."OriginalProductCost" AS DOUBLE)'
on_star("attribute_margin_corr", O.with_views(" UNION ALL ".join(f"SELECT '{a}' AS attribute, ROUND(CORR(CAST(p.\"{a}\" AS DOUBLE), {_MARGIN}), 6) AS corr FROM order_item oi JOIN product p ON oi.\"ProductId\" = p.\"Id\"" for a in ("Price", "StockQuantity", "ApprovedTotalReviews"))), A.attribute_margin)
on_star("basket_pairs", O.with_views("""SELECT a."ProductId" AS a, b."ProductId" AS b, COUNT(*) AS orders FROM (SELECT DISTINCT "OrderId", "ProductId" FROM order_item) a
  JOIN (SELECT DISTINCT "OrderId", "ProductId" FROM order_item) b ON a."OrderId" = b."OrderId" AND a."ProductId" < b."ProductId" GROUP BY 1, 2 ORDER BY orders DESC, a, b LIMIT 50"""), lambda star: A.basket_pairs(star, 50))

# ------------------------------------------------------------------ texts: whole documents and turns of conversations, and requests and SQL made from events
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from .functions import textrules as X  # noqa: E402
from .functions.dimensions import DIMENSIONS  # noqa: E402
from .functions.metrics import METRICS  # noqa: E402
from .functions.predicates import Predicate as P  # noqa: E402
from .functions.rule_values import (  # noqa: E402
    DIMENSION_KEYWORDS,
    EXPECTED_DIMENSION,
    EXPECTED_METRIC,
    EXPECTED_TIME,
    INTENT_PATTERNS,
    METRIC_KEYWORDS,
    SCORE_REASONS,
    UNSUPPORTED_MARKERS,
)
from .operators import catalog as K  # noqa: E402
from .operators import evaluation as E  # noqa: E402
from .operators import prep as Q  # noqa: E402
from .sources import io  # noqa: E402
from .sources.star import load_star  # noqa: E402

#: Texts of requests; {n} is a number of the event.
REQUESTS = (
    "Show me all orders above ${n},000 by customer", "Top {n} products by revenue in the past {n} days", "Compare sales vs refunds by country this month", "What was the average order value yesterday?",
    "Bottom {n} categories by units sold last month", "Weekly trend of shipments over time", "Which 5 brands exceed {n} orders this year", "Cart abandonment funnel for the last week",
    "New vs returning customers by month", "Is there a correlation between price and rating", "Overview of tax and discount per payment method", "Breakdown of shipping cost by shipping method, {n} days ago",
    "How many homepage visitors came through google ads?", "List SKU stock under {n} today", "Profit margin this morning", "Forecast revenue by store for the current quarter",
)
#: SQL texts, some fenced, some unsafe.
STATEMENTS = (
    "SELECT SUM(o.OrderTotal) FROM `Order` o WHERE o.CreatedOnUtc >= DATE_SUB(UTC_DATE(), INTERVAL {n} DAY)", "```sql\nSELECT c.Name, COUNT(DISTINCT o.Id) FROM `Order` o GROUP BY c.Name\n```",
    "DROP TABLE orders", "Here it is: ```SELECT updated_at, {n} FROM t```", "UPDATE t SET x = {n}; DELETE FROM t", "SELECT alternatively FROM created", "  SELECT 1 UNION SELECT {n}  ",
    "I cannot answer that: not available", "SELECT p.Name, SUM(oi.Quantity) FROM OrderItem oi GROUP BY p.Name LIMIT {n}", "exec xp_cmdshell",
)


def _texts(spark: SparkSession, path: str, texts: tuple[str, ...]) -> DataFrame:
    """(id, n, system, text) of all documents and conversations, and of the texts dealt to events; n numbers them by kind."""
    number = (F.col("event_id") % 97 + 1).cast("string")
    at = F.nullif((F.col("event_id") % len(texts)).cast("int") + 1, F.lit(0))  # as the SQL's lists: from the end if negative, null if 0
    of = lambda t, id, n, system, text: spark.read.parquet(f"{path}/{t}.parquet").select(id.alias("id"), F.col(n).alias("n"), F.col(system).alias("system"), text.alias("text"))
    events = of("events", F.concat(F.lit("e"), "event_id"), "event_id", "event_type", F.replace(F.try_element_at(F.array(*map(F.lit, texts)), at), F.lit("{n}"), number))
    docs = of("documents", F.concat(F.lit("d"), "doc_id"), "doc_id", "source", F.col("text"))
    turns = of("conversations", F.concat(F.lit("c"), "conv_id", F.lit("."), "turn"), "conv_id", "role", F.col("text"))
    return events.unionByName(docs).unionByName(turns)


def _normalised(d: DataFrame) -> DataFrame:
    return d.withColumn("q", X.normalise_text(F.col("text")))


def _sql_texts(texts: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    events = f"SELECT 'e' || event_id AS id, event_id AS n, event_type AS system, replace([{quoted}][CAST(event_id % {len(texts)} AS INTEGER) + 1], '{{n}}', CAST(event_id % 97 + 1 AS VARCHAR)) AS text FROM events"
    return f"({events} UNION ALL SELECT 'd' || doc_id, doc_id, source, text FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, conv_id, role, text FROM conversations)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(rules, test, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(test(p) for p in patterns)} THEN {_quote(label)}" for label, patterns in rules) + f" ELSE {default} END"


def _has(column: str):
    return lambda p: f"contains({column}, {_quote(p)})"


_REQ, _STM = _sql_texts(REQUESTS), _sql_texts(STATEMENTS)
_INTENT = _case(INTENT_PATTERNS, lambda p: f"regexp_matches(lower(text), {_quote(p)})", "'kpi'")
_METRIC_OF, _DIMENSION_OF = _case(METRIC_KEYWORDS, _has("lower(text)")), _case(DIMENSION_KEYWORDS, _has("lower(text)"))


def _lowered(d: DataFrame) -> DataFrame:
    return d.withColumn("q", F.lower("text"))


def _clean(d: DataFrame) -> DataFrame:
    return d.withColumn("q", F.lower(F.trim("text")))


def tagging(name: str, sql: str, f, texts: tuple[str, ...] = REQUESTS) -> None:
    register(name, sql)(lambda spark, path: f(_texts(spark, path, texts)))


tagging("classify_intent", f"SELECT id, {_INTENT} AS label FROM {_REQ}", lambda d: _lowered(d).select("id", X.classify_intent(F.col("q"), True).alias("label")))
tagging("classify_metric", f"SELECT id, {_METRIC_OF} AS label FROM {_REQ}", lambda d: _lowered(d).select("id", X.classify_metric(F.col("q"), True).alias("label")))
tagging("classify_dimension", f"SELECT id, {_DIMENSION_OF} AS label FROM {_REQ}", lambda d: _lowered(d).select("id", X.classify_dimension(F.col("q"), True).alias("label")))
_PHRASES = " ".join(f"WHEN regexp_matches(lower(text), '\\b{p}\\b') THEN '{label}'" for p, label in X.TIME_PHRASES)
tagging("extract_time_term", rf"""SELECT id, CASE WHEN regexp_matches(lower(text), '\bpast (\d+) days?\b') THEN 'past ' || regexp_extract(lower(text), '\bpast (\d+) days?\b', 1) || ' days'
  WHEN regexp_matches(lower(text), '\b(\d+) days? ago\b') THEN regexp_extract(lower(text), '\b(\d+) days? ago\b', 1) || ' days ago' {_PHRASES} END AS term FROM {_REQ}""", lambda d: _lowered(d).select("id", X.extract_time_term(F.col("q"), True).alias("term")))
tagging("extract_topn", rf"""SELECT id, CAST(NULLIF(regexp_extract(lower(text), '\b(top|bottom) (\d+)', 2), '') AS BIGINT) AS n, CASE regexp_extract(lower(text), '\b(top|bottom) \d+', 1) WHEN 'top' THEN 'desc' WHEN 'bottom' THEN 'asc' END AS sort FROM {_REQ}""",
        lambda d: _lowered(d).select("id", X.extract_topn(F.col("q"), True).alias("x")).select("id", "x.n", "x.sort"))
_OVER, _UNDER = r"\b(?:exceeds?|greater than|more than|above|over)\s+\$?([\d,]+)", r"\b(?:less than|below|under)\s+\$?([\d,]+)"
tagging("extract_threshold", f"""SELECT id, CASE WHEN amount IS NOT NULL THEN op END AS op, amount FROM (SELECT id, CASE WHEN regexp_matches(lower(text), '{_OVER}') THEN '>' ELSE '<' END AS op,
  CASE WHEN {_DIMENSION_OF} IS NOT NULL THEN TRY_CAST(replace(NULLIF(COALESCE(NULLIF(regexp_extract(lower(text), '{_OVER}', 1), ''), regexp_extract(lower(text), '{_UNDER}', 1)), ''), ',', '') AS BIGINT) END AS amount FROM {_REQ})""",
        lambda d: _lowered(d).select("id", X.extract_threshold(F.col("q"), True).alias("x")).select("id", "x.op", "x.amount"))
_NAMES = ("Revenue", "top_n", "comparison", "by_category", "trending", "correlations", "shopping list", "pipeline", "kpi", "segments", "get_top_customers")
_PARTS = " ".join(f"WHEN contains(lower(text), '{part}') THEN '{target}'" for part, target in X.INTENT_PARTS)
tagging("normalise_intent", f"SELECT id, CASE text WHEN 'Revenue' THEN 'kpi' WHEN 'top_n' THEN 'ranking' WHEN 'by_category' THEN 'segment' WHEN 'trending' THEN 'trend' WHEN 'correlations' THEN 'correlate' WHEN 'shopping list' THEN 'tabular' WHEN 'pipeline' THEN 'funnel' WHEN 'segments' THEN 'segment' WHEN 'get_top_customers' THEN 'ranking' ELSE CASE WHEN id LIKE 'e%' THEN text {_PARTS} ELSE lower(text) END END AS label FROM {_sql_texts(_NAMES)}",
        lambda d: d.select("id", X.normalise_intent(F.col("text")).alias("label")), _NAMES)
_JSON = ('```json\n{"intent": "sales", "filters": {}, "metric_term": "revenue"}\n```', '[{"intent_class": "top_n", "filters": [{"dimension": "status", "op": "!=", "value": "{n}"}, {"field": "x"}]}]', '{"metric_term": "profit", "needs_clarification": true, "confidence": "low"}', '{"intent_class": "plot", "filters": [{"name": "a", "value": "b"}]}')
_WANT = (("kpi", "revenue", "", "high", False), ("ranking", None, "status != {n}", "high", False), ("kpi", "profit", "", "low", True), ("trend", None, "a = b", "high", False))
_ONE = lambda i, f, other: "CASE WHEN id NOT LIKE 'e%' THEN " + other + " " + " ".join(f"WHEN n % 4 = {k} THEN {f(w[i])}" for k, w in enumerate(_WANT)) + " END"
tagging("normalise_request", f"SELECT id, {_ONE(0, _quote, _quote('kpi'))} AS intent_class, {_ONE(1, lambda v: 'NULL' if v is None else _quote(v), 'NULL')} AS metric_term, replace({_ONE(2, _quote, _quote(''))}, '{{n}}', CAST(n % 97 + 1 AS VARCHAR)) AS filters, {_ONE(3, _quote, _quote('high'))} AS confidence, {_ONE(4, str, 'FALSE')} AS needs_clarification FROM {_sql_texts(_JSON)}",
        lambda d: d.select("id", X.normalise_request(F.col("text")).alias("r")).select("id", "r.intent_class", "r.metric_term", F.array_join(F.transform("r.filters", lambda f: F.concat_ws(" ", f["field"], f["operator"], f["value"])), ";").alias("filters"), "r.confidence", "r.needs_clarification"), _JSON)

_TERMS = ("revenue", "total revenue by store", "refunds", "number of orders", "coupon_redemption", "unique customers", "ORDER_COUNT ", "profit", "shipments created", "")


def _resolved(kind: str) -> str:
    words, t = X.vocabulary(kind), "lower(trim(text))"
    tiers = [[f"{t} = {_quote(i.lower())}" for _, i, _, _ in words], [f"contains({t}, {_quote(i.lower())}) OR contains({_quote(i.lower())}, {t})" for _, i, _, _ in words], [f"contains({_quote(d.lower())}, {t})" for _, _, d, _ in words], [f"{t} = {_quote(l.lower())}" for _, _, _, l in words]]
    return f"CASE WHEN {t} = '' THEN '' " + " ".join(f"WHEN {c} THEN {_quote(w[1])}" for tier in tiers for c, w in zip(tier, words, strict=True)) + " ELSE 'unknown' END"


tagging("resolve_terms", f"SELECT id, {_resolved('metric')} AS metric, {_resolved('dimension')} AS dimension FROM {_sql_texts(_TERMS)}",
        lambda d: X.resolve_terms(X.resolve_terms(d, "text", "metric", "metric"), "text", "dimension", "dimension").select("id", "metric", "dimension"), _TERMS)
_LISTED = {k: ", ".join(sorted(v)) for k, v in (("metric", METRICS), ("dimension", DIMENSIONS))}
_REASON = {k: f"CASE WHEN {_resolved(k)} = 'unknown' THEN 'Unknown {k} ''' || lower(trim(text)) || '''. Available: {_LISTED[k]}' END" for k in _LISTED}
tagging("coverage_check", f"SELECT id, m IS NULL AND d IS NULL AS valid, CONCAT_WS('. ', m, d) AS reason FROM (SELECT id, {_REASON['metric']} AS m, {_REASON['dimension']} AS d FROM {_sql_texts(_TERMS)})",
        lambda d: _clean(d).select("id", X.coverage(F.col("q"), F.col("q"), True).alias("c")).select("id", "c.valid", "c.reason"), _TERMS)
tagging("closed_vocabulary", f"SELECT m IS NULL AND d IS NULL AS valid, COUNT(*) AS n FROM (SELECT {_REASON['metric']} AS m, {_REASON['dimension']} AS d FROM {_sql_texts(_TERMS)}) GROUP BY 1",
        lambda d: _clean(d).groupBy(X.coverage(F.col("q"), F.col("q"), True)["valid"].alias("valid")).agg(F.count(F.lit(1)).alias("n")), _TERMS)

_NORM = "regexp_replace(translate(lower(text), '‑–—`[]', '---'), '[\\s\\x0B]+', ' ', 'g')"
_REASONS = "[" + ", ".join(f"CASE WHEN contains({_NORM}, {_quote(m)}) THEN {_quote(r)} END" for m, r in UNSUPPORTED_MARKERS) + "]"
_UNSUPPORTED = f"array_to_string(list_filter({_REASONS}, lambda x: x IS NOT NULL), '; ')"
tagging("unsupported_reasons", f"SELECT id, {_UNSUPPORTED} AS reason, CASE WHEN {_UNSUPPORTED} = '' THEN 'answer' ELSE 'clarify_or_reject' END AS behavior FROM {_REQ}",
        lambda d: _normalised(d).select("id", X.unsupported_reasons(F.col("q")).alias("reason")).withColumn("behavior", F.when(F.col("reason") == "", "answer").otherwise("clarify_or_reject")))


def _pattern():
    return F.get(F.array(*map(F.lit, E.PATTERNS)), (F.col("n") % 11).cast("int"))


_PATTERN_SQL = f"[{', '.join(map(_quote, E.PATTERNS))}][CAST(n % 11 AS INTEGER) + 1]"
_GROUPED = ", ".join(map(_quote, X.GROUPED_PATTERNS))
_EXPECTED = f"""SELECT id, n, text, {_PATTERN_SQL} AS pattern, CASE WHEN {_UNSUPPORTED} = '' THEN 'answer' ELSE 'clarify_or_reject' END AS behavior,
  CASE WHEN contains({_NORM}, 'average number of items per order') THEN 'quantity' ELSE {_case(EXPECTED_METRIC, _has(_NORM), "'order_count'")} END AS metric,
  CASE WHEN {_PATTERN_SQL} IN ({_GROUPED}) THEN CASE WHEN contains({_NORM}, 'by month') OR contains({_NORM}, 'daily') OR contains({_NORM}, 'weekly') THEN 'date' ELSE {_case(EXPECTED_DIMENSION, _has(_NORM))} END
    WHEN contains({_NORM}, ' per payment method') THEN 'payment_method' END AS dimension, {_case(EXPECTED_TIME, _has(_NORM))} AS time, {_UNSUPPORTED} AS unsupported FROM {_REQ}"""
tagging("expected_labels", f"SELECT id, behavior, metric, dimension, time, unsupported FROM ({_EXPECTED})", lambda d: _normalised(d).select("id", X.expected_labels(F.col("q"), _pattern()).alias("e")).select("id", "e.*"))

_FENCED = r"(?is)```(?:sql)?\s*(.*?)```"
_BODY = f"trim(CASE WHEN regexp_matches(text, '{_FENCED}') THEN trim(regexp_extract(text, '{_FENCED}', 1), E' \\n\\t') ELSE text END)"
tagging("extract_sql", f"SELECT id, {_BODY} AS sql FROM {_STM}", lambda d: d.select("id", F.trim(X.extract_sql(F.col("text")), F.lit(" \n\t")).alias("sql")), STATEMENTS)
for _name, _rules in (("scan_unsafe", "long"), ("scan_unsafe_short", "short"), ("scan_unsafe_full", "full")):
    tagging(_name, f"SELECT id, NULLIF(regexp_extract(lower({_BODY}), '\\b({'|'.join(X.UNSAFE[_rules])})(?:\\b|$)', 1), '') AS word FROM {_STM}", lambda d, r=_rules: d.select("id", X.unsafe_word(F.col("text"), r).alias("word")), STATEMENTS)
tagging("scan_unsafe_substring", f"SELECT id, {' OR '.join(_has('lower(text)')(w) for w in X.UNSAFE_SUBSTRINGS)} AS unsafe FROM {_STM}", lambda d: d.select("id", X.unsafe_substring(F.col("text")).alias("unsafe")), STATEMENTS)
_IS_UNSAFE = f"regexp_matches(lower({_BODY}), '\\b({'|'.join(X.UNSAFE['long'])})(?:\\b|$)')"
tagging("unsafe_rate", f"SELECT system, COUNT(*) FILTER (u) AS unsafe, ROUND(100.0 * COUNT(*) FILTER (u) / COUNT(*), 4) AS pct FROM (SELECT system, {_IS_UNSAFE} AS u FROM {_STM}) GROUP BY 1",
        lambda d: E.unsafe_rate(d, X.unsafe_word(F.col("text")).isNotNull()), STATEMENTS)
tagging("unsafe_ids", f"SELECT system, id FROM {_STM} WHERE {_IS_UNSAFE}", lambda d: E.unsafe_ids(d, X.unsafe_word(F.col("text")).isNotNull()), STATEMENTS)


def _tokens(label: str, tokens: dict, text: str) -> str:
    return f"CASE WHEN {label} IS NULL THEN TRUE " + " ".join(f"WHEN {label} = '{k}' THEN {' OR '.join('(' + ' AND '.join(_has(text)(t) for t in g) + ')' for g in groups)}" for k, groups in tokens.items()) + " ELSE TRUE END"


_S = f"regexp_replace(translate(lower({_BODY} || ' '), '‑–—`[]', '---'), '[\\s\\x0B]+', ' ', 'g')"
_OK = "(n % 7 <> 0)"
_SAY = {k: _quote(v) for k, v in SCORE_REASONS.items()}
SQL_SCORE = f"""SELECT id, reason IN ({_SAY['avoided']}, {_SAY['correct']}) AS correct, reason FROM (SELECT id, CASE WHEN behavior <> 'answer' AND refused THEN {_SAY['avoided']} WHEN behavior <> 'answer' THEN COALESCE(NULLIF(unsupported, ''), {_SAY['should_reject']})
  WHEN NOT {_OK} THEN {_SAY['not_executed']} WHEN unsupported <> '' THEN unsupported WHEN NOT {_tokens('metric', X.METRIC_SQL_TOKENS, 's')} THEN {_SAY['metric']} || metric WHEN NOT {_tokens('dimension', X.DIM_SQL_TOKENS, 's')} THEN {_SAY['dimension']} || dimension
  WHEN NOT {_tokens('time', X.TIME_SQL_TOKENS, 's')} THEN {_SAY['time']} || time WHEN pattern NOT IN ({_GROUPED}) AND dimension IS NULL AND contains(s, ' group by ') THEN {_SAY['grouped']} ELSE {_SAY['correct']} END AS reason
  FROM (SELECT e.*, {_S.replace('text', 't.text').replace('t.t.text', 't.text')} AS s, ({' OR '.join(_has(_S.replace('text', 't.text'))(w) for w in ('cannot answer', 'not available', 'not supported', 'outside', 'clarify'))}) AND NOT ({' OR '.join(_has(_S.replace('text', 't.text'))(w) for w in ('select ', 'update ', 'delete ', 'insert ', 'drop ', 'alter '))}) AS refused
    FROM ({_EXPECTED}) e JOIN {_STM} t USING (id)))"""


@register("score_rows", SQL_SCORE)
def _score_rows(spark: SparkSession, path: str) -> DataFrame:
    asked = X.score_questions(_texts(spark, path, REQUESTS).select("id", "text", _pattern().alias("pattern"), (F.col("n") % 7 != 0).alias("executed")))
    answered = X.score_answers(_texts(spark, path, STATEMENTS).select("id", "text"))
    return X.score_labelled(asked.join(answered, "id")).select("id", "f.correct", "f.reason")


# ------------------------------------------------------------------ evaluation, over labels, documents and events


def _judged(spark: SparkSession, path: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("labels", "documents"))
    return labels.join(docs.select("doc_id", "source", "lang"), "doc_id")


def judged(name: str, sql: str, f) -> None:
    register(name, sql)(lambda spark, path: f(_judged(spark, path)))


_LABELS = "(SELECT * FROM labels JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id))"
judged("validity_rate", f"SELECT source AS system, COUNT(*) FILTER (quality = 1) AS ok, COUNT(*) AS total, ROUND(100.0 * COUNT(*) FILTER (quality = 1) / COUNT(*), 1) AS pct FROM {_LABELS} GROUP BY 1", lambda d: E.validity_rate(d.select(F.col("source").alias("system"), (F.col("quality") == 1).alias("ok"))))
register("execution_ok", "SELECT range AS id FROM range(1, (SELECT COUNT(*) + 1 FROM documents)) WHERE range NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")(lambda spark, path: E.execution_ok(spark, spark.read.parquet(f"{path}/documents.parquet").count(), spark.read.parquet(f"{path}/labels.parquet").where("quality = 0").select(F.col("doc_id").alias("id"))))


def _behavior():
    return F.when(F.col("lang") == "en", "answer").when(F.col("lang") == "de", "clarify_or_reject").otherwise("multi_part_answer").alias("behavior")


_BEHAVIOR_SQL = "CASE lang WHEN 'en' THEN 'answer' WHEN 'de' THEN 'clarify_or_reject' ELSE 'multi_part_answer' END"
judged("accuracy_summary", f"""SELECT system, COUNT(*) FILTER (correct) AS correct, COUNT(*) FILTER (NOT correct) AS incorrect, ROUND(100.0 * COUNT(*) FILTER (correct) / COUNT(*), 1) AS accuracy,
  COUNT(*) FILTER (b = 'answer') AS answerable, ROUND(100.0 * COUNT(*) FILTER (b = 'answer' AND correct) / COUNT(*) FILTER (b = 'answer'), 1) AS answerable_accuracy, COUNT(*) FILTER (b = 'clarify_or_reject') AS unsupported,
  ROUND(100.0 * COUNT(*) FILTER (b = 'clarify_or_reject' AND correct) / COUNT(*) FILTER (b = 'clarify_or_reject'), 1) AS unsupported_accuracy
  FROM (SELECT {_BEHAVIOR_SQL} AS b, 'good' AS system, quality = 1 AS correct FROM {_LABELS} UNION ALL SELECT {_BEHAVIOR_SQL}, 'harmless', toxic = 0 FROM {_LABELS}) GROUP BY 1""",
       lambda d: E.accuracy_summary(d.select(_behavior(), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("harmless")), ["good", "harmless"]))
judged("behavior_counts", f"SELECT {_BEHAVIOR_SQL} AS behavior, COUNT(*) AS n FROM {_LABELS} GROUP BY 1", lambda d: E.behavior_counts(d.select(_behavior())))
_LOWER = "(" + " UNION ALL ".join(f"SELECT '{p}' AS pattern" for p in E.PATTERNS) + ")"
tagging("pattern_distribution", f"SELECT p.pattern, COUNT(r.label) AS count, ROUND(100.0 * COUNT(r.label) / SUM(COUNT(r.label)) OVER (), 1) AS pct FROM {_LOWER} p LEFT JOIN (SELECT {_INTENT} AS label FROM {_REQ}) r ON lower(p.pattern) = r.label GROUP BY 1",
        lambda d: E.pattern_distribution(_lowered(d).select(X.classify_intent(F.col("q"), True).alias("c")).select(F.when(F.col("c") == "kpi", "KPI").otherwise(F.initcap("c")).alias("pattern"))))
register("latency_summary", """SELECT event_type AS stage, COUNT(*) AS count, ROUND(AVG(value), 2) AS mean_ms, ROUND(QUANTILE_CONT(value, 0.5), 2) AS median_ms, ROUND(MAX(value), 2) AS max_ms,
  ROUND(MIN(value) FILTER (i >= round_even((n - 1) * 0.95, 0)), 2) AS p95_ms FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1""")(
    lambda spark, path: E.latency_summary(spark.read.parquet(f"{path}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))))


@register("annotation_template", "SELECT d.doc_id AS id, d.lang, l.quality AS result, COALESCE(CASE WHEN d.doc_id % 3 = 0 THEN 'kept' END, CAST(l.toxic AS VARCHAR)) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def _annotation(spark: SparkSession, path: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    questions = docs.select(F.col("doc_id").alias("id"), "lang")
    results = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("result"), F.col("toxic").cast("string").alias("label"))
    return E.annotation_template(questions, results, questions.where("id % 3 = 0").select("id", F.lit("kept").alias("label")))


@register("pattern_join", "SELECT d.doc_id AS id, COALESCE(CASE WHEN l.quality = 1 THEN 'KPI' WHEN l.quality = 0 THEN 'Trend' END, 'Unsupported/Mixed') AS pattern FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id + 1")
def _pattern_join(spark: SparkSession, path: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    return E.pattern_join(docs.select(F.col("doc_id").alias("id")), labels.select(F.col("doc_id").alias("index"), F.when(F.col("quality") == 1, "KPI").otherwise("Trend").alias("pattern")))


judged("class_prf", f"""SELECT class, ROUND(SUM(tp) / NULLIF(SUM(p), 0), 6) AS precision, ROUND(SUM(tp) / NULLIF(SUM(a), 0), 6) AS recall, ROUND(2 * SUM(tp) / NULLIF(SUM(a) + SUM(p), 0), 6) AS f1 FROM (
  SELECT quality AS class, 1.0 AS a, 0.0 AS p, CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END AS tp FROM {_LABELS} UNION ALL SELECT 1 - toxic, 0.0, 1.0, 0.0 FROM {_LABELS}) GROUP BY 1""",
       lambda d: E.class_prf(d.select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))))


def _orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


register("upsert_results", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")(lambda spark, path: E.upsert(_orders(spark, path), _orders(spark, path).where("id % 2 = 0").select("id", F.lit("new").alias("status"))))
register("resume_pending", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderstatus = 'F')")(lambda spark, path: E.resume_pending(_orders(spark, path), _orders(spark, path).where("id % 2 = 0").select("id", (F.col("status") == "F").alias("ok"))))
register("result_set_equal", "SELECT (SELECT COUNT(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders)) = 0 AS equal")(lambda spark, path: E.result_set_equal(_orders(spark, path), _orders(spark, path).orderBy("status")))
register("result_set_differs", "SELECT (SELECT COUNT(*) FROM orders WHERE o_orderkey % 100 = 0) = 0 AS equal")(lambda spark, path: E.result_set_equal(_orders(spark, path), _orders(spark, path).where("id % 100 <> 0")))

# ------------------------------------------------------------------ catalog, over events


def _catalog(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.parquet(f"{path}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    plan = {"k": k, "pattern": F.col("event_type")}
    return e.select(K.report_id(plan).alias("id"), F.col("event_id"), F.col("event_type").alias("pattern"), (k % 5).alias("metric"), (k % 3).alias("dimension"), F.col("user_id").cast("string").alias("scope"), F.col("ts").cast("timestamp_ntz").alias("updated_at"), F.concat("event_type", F.lit(" of "), k.cast("string")).alias("question"))


def catalogued(name: str, sql: str, f) -> None:
    register(name, f"WITH catalog AS (SELECT substr(sha256('{{\"k\":' || k || ',\"pattern\":\"' || event_type || '\"}}'), 1, 16) AS id, event_id, event_type AS pattern, k % 5 AS metric, k % 3 AS dimension, CAST(user_id AS VARCHAR) AS scope, ts AS updated_at, event_type || ' of ' || k AS question FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))\n{sql}")(lambda spark, path: f(_catalog(spark, path)))


_LAST = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY updated_at DESC, event_id DESC) AS n FROM catalog) WHERE n = 1"
_latest = lambda c: K.latest(c, by=("updated_at", "event_id"))
catalogued("report_id", "SELECT event_id, id FROM catalog", lambda c: c.select("event_id", "id"))
catalogued("dedupe_reports", f"SELECT id, event_id, pattern FROM ({_LAST})", lambda c: _latest(c).select("id", "event_id", "pattern"))
catalogued("catalog_latest", f"SELECT id, event_id FROM ({_LAST}) WHERE scope = '8' ORDER BY updated_at DESC, id LIMIT 50", lambda c: K.listed(_latest(c), 50, "8").select("id", "event_id"))
catalogued("similar_reports", "SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY pattern, metric, dimension) AS n FROM (SELECT DISTINCT pattern, metric, dimension, id FROM catalog)) WHERE n > 1", K.similar)
catalogued("reuse_check", "SELECT event_id, id IN (SELECT id FROM catalog WHERE event_id % 50 <> 0 AND event_id % 3 = 0) AS reused FROM catalog WHERE event_id % 50 = 0", lambda c: K.reuse(c.where("event_id % 50 = 0"), c.where("event_id % 50 <> 0 and event_id % 3 = 0")).select("event_id", "reused"))
catalogued("search_reports", "SELECT event_id FROM catalog WHERE contains(lower(question), 'click of 1')", lambda c: K.search(c, "CLICK of 1").select("event_id"))
catalogued("delete_reports", "SELECT event_id FROM catalog WHERE id NOT IN (SELECT id FROM catalog WHERE event_id % 50 = 0)", lambda c: K.delete(c, c.where("event_id % 50 = 0").select("id").distinct()).select("event_id"))
catalogued("record_runs", f"SELECT l.id, COUNT(c.id) + 1 AS runs, strftime(MAX(c.updated_at), '%Y-%m-%d %H:%M:%S') AS updated FROM ({_LAST}) l JOIN catalog c ON l.id = c.id GROUP BY 1",
           lambda c: K.record_runs(_latest(c).select("id", F.array("updated_at").alias("run_history"), "updated_at"), c.select("id", F.col("updated_at").alias("ts"))).select("id", F.size("run_history").cast("long").alias("runs"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")))
_SAVED = (("revenue", "payment_method"), ("order_count", "payment_method"), ("item_quantity", "payment_method"), ("revenue", "store_name"))
on_star("refresh_reports", O.with_views(" UNION ALL ".join(f"SELECT '{d}' AS dimension, '{m}' AS metric, CAST({O.DIMENSION[d][1]} AS VARCHAR) AS label, CAST({O.METRIC[m]} AS DOUBLE) AS value {O.joined(O.METRIC_TABLE.get(m, 'Order'), O.DIMENSION[d][0])} GROUP BY 3" for m, d in _SAVED)),
        lambda star: K.refresh(star, [R.ReportSpec("summary", m, d) for m, d in _SAVED]))

# ------------------------------------------------------------------ preparation
_MOVED = "TIMESTAMP '2001-08-01' - CAST((\"Id\" * 17 + 3) % 360 AS INTEGER) * INTERVAL 1 DAY"


def _paid(star) -> DataFrame:
    return star.table("Order").select("Id", "CreatedOnUtc", F.when(F.col("o.OrderStatusId") == 30, F.col("o.CreatedOnUtc")).alias("PaidDateUtc"))


def _iso(df: DataFrame) -> DataFrame:
    return io.normalise_result(df)


on_star("refresh_order_dates", O.with_views(f"SELECT \"Id\", strftime({_MOVED}, '%Y-%m-%dT%H:%M:%S') AS \"CreatedOnUtc\", CASE WHEN \"OrderStatusId\" = 30 THEN strftime({_MOVED}, '%Y-%m-%dT%H:%M:%S') END AS \"PaidDateUtc\" FROM order_"),
        lambda star: _iso(Q.refresh_order_dates(_paid(star), AS_OF)))
on_star("refresh_shipments", O.with_views("SELECT sh.\"Id\", strftime(o.\"CreatedOnUtc\" + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS \"ShippedDateUtc\", CASE WHEN sh.\"DeliveryDateUtc\" IS NOT NULL THEN strftime(o.\"CreatedOnUtc\" + INTERVAL 3 DAY, '%Y-%m-%dT%H:%M:%S') END AS \"DeliveryDateUtc\" FROM shipment sh JOIN order_ o ON sh.\"OrderId\" = o.\"Id\""),
        lambda star: _iso(Q.refresh_shipments(star.table("Shipment"), star.table("Order")).select("Id", "ShippedDateUtc", "DeliveryDateUtc")))
on_star("order_rollup", O.with_views("""SELECT o."Id", CAST(s AS DOUBLE) AS subtotal, CAST(c AS DOUBLE) AS cost, CAST(floor(s * 0.05) AS DOUBLE) AS tax, CAST(s + floor(s * 0.05) + o."OrderShippingExclTax" - 10 AS DOUBLE) AS total
  FROM order_ o JOIN (SELECT "OrderId", SUM("PriceExclTax") AS s, SUM("OriginalProductCost") AS c FROM order_item GROUP BY 1) ON o."Id" = "OrderId\""""),
        lambda star: Q.order_rollup(star.table("OrderItem", {"OriginalProductCost"}), star.table("Order").select("Id", F.col("OrderShippingExclTax").alias("shipping"), F.lit(10).cast("decimal(18,4)").alias("discount"))).select("Id", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "cost", "tax", "total")]))
on_star("fill_required", O.with_views("SELECT \"Id\", COALESCE(\"AdminComment\", '') AS \"AdminComment\", '1970-01-01T00:00:00' AS \"LastLoginUtc\", 1 AS \"AllowsBilling\", 0 AS \"Points\" FROM customer_"),
        lambda star: _iso(Q.fill_required(star.table("Customer").select("Id", "AdminComment"), Q.T.StructType().add("Id", "long", False).add("AdminComment", "string", False).add("LastLoginUtc", "timestamp_ntz", False).add("AllowsBilling", "integer", False).add("Points", "integer", False).add("Note", "string", True))))

# ------------------------------------------------------------------ sources and sinks: through files in the shared folder
#: Records of a JSON array or object that the readers' files hold at most.
RECORDS = 1000


@register("read_questions", "SELECT ROW_NUMBER() OVER (ORDER BY item_id) AS id, text AS question FROM benchmark")
def _read_questions(spark: SparkSession, path: str) -> DataFrame:
    at = io.scratch(spark, "questions")
    items = spark.read.parquet(f"{path}/benchmark.parquet")
    first = F.col("item_id") - F.col("item_id") % RECORDS
    listed = items.groupBy(first.alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda s: s["text"]).alias("q"))
    listed.select("first", F.to_json("q").alias("value")).write.partitionBy("first").text(at)
    return io.read_questions(spark, at)


@register("read_results", "SELECT item_id AS id, 'a' AS system, text AS sql, CASE WHEN item_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM benchmark")
def _read_results(spark: SparkSession, path: str) -> DataFrame:
    at = io.scratch(spark, "results")
    items = spark.read.parquet(f"{path}/benchmark.parquet")
    rows = items.select(F.col("item_id").alias("id"), F.lit("a").alias("system"), F.col("text").alias("sql"), F.when(F.col("item_id") % 7 == 0, "failed").otherwise("success").alias("status"))
    rows.groupBy(F.floor(F.col("id") / RECORDS)).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).select("value").write.text(at)
    return io.read_results(spark, at, lines=True).select("id", "system", "sql", "status")


@register("read_report_catalog", SQL["dedupe_reports"].replace("SELECT id, event_id, pattern FROM", "SELECT id, event_id, pattern, metric FROM"))
def _read_catalog(spark: SparkSession, path: str) -> DataFrame:
    at = io.scratch(spark, "catalog")
    c = _latest(_catalog(spark, path))
    report = F.struct("id", F.struct("event_id", "pattern", "metric"))
    c.groupBy(F.floor(F.col("event_id") / RECORDS)).agg(F.to_json(F.map_from_entries(F.collect_list(report))).alias("value")).select("value").write.text(at)
    return io.read_report_catalog(spark, at, "struct<event_id:bigint,pattern:string,metric:bigint>", lines=True)


@register("write_catalog", SQL["dedupe_reports"])
def _write_catalog(spark: SparkSession, path: str) -> DataFrame:
    at = io.scratch(spark, "catalog")
    io.write_catalog(_latest(_catalog(spark, path)).select("id", "event_id", "pattern"), at)
    return spark.read.parquet(at)


@register("write_annotations", f"SELECT id, text FROM {_STM} UNION ALL SELECT id, text FROM {_STM}")
def _write_annotations(spark: SparkSession, path: str) -> DataFrame:
    at = io.scratch(spark, "annotations")
    io.write_annotations(_texts(spark, path, STATEMENTS).select("id", "text"), at)
    json, csv = io.read_annotations(spark, at, "id string, text string")
    return json.unionByName(csv)


@register("run_saved_query", "SELECT o_orderstatus AS label, COUNT(*) AS value FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def _run_saved(spark: SparkSession, path: str) -> DataFrame:
    spark.read.parquet(f"{path}/orders.parquet").createOrReplaceTempView("saved_query_orders")
    return io.run_saved_query(spark, "SELECT 1; SELECT o_orderstatus AS label, COUNT(*) AS value FROM saved_query_orders WHERE o_totalprice > :least GROUP BY 1;", {"least": 200000})


on_star("normalise_result", O.with_views(f"SELECT \"Id\", CAST(\"OrderTotal\" AS DOUBLE) AS \"OrderTotal\", strftime(\"CreatedOnUtc\", '%Y-%m-%dT%H:%M:%S') AS \"CreatedOnUtc\" FROM order_"), lambda star: io.normalise_result(star.table("Order").select("Id", "OrderTotal", "CreatedOnUtc")))
register("load_star", "SELECT COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders")(lambda spark, path: load_star(spark, path).table("Order").agg(F.count(F.lit(1)).alias("n"), F.sum("OrderTotal").cast("double").alias("total")))
