"""Fixed values of the text rules: the order of a list is its meaning, the first that fits wins."""

#: Words that name a metric in a request.
METRIC_KEYWORDS = (
    ("avg_order_value", ["average order value", "aov"]),
    ("line_item_revenue", ["product revenue"]),
    ("line_item_cost", ["product cost"]),
    ("line_item_discount", ["line item discount"]),
    ("refund_amount", ["refund amount", "refunded amount", "total refund"]),
    ("refund_count", ["refunds", "number of refunds"]),
    ("discount_amount", ["discount"]),
    ("shipping_cost", ["shipping cost", "shipping fee"]),
    ("shipment_count", ["shipments", "shipment count"]),
    ("tax_amount", ["tax"]),
    ("profit", ["profit", "margin"]),
    ("item_quantity", ["quantity sold", "units sold", "items sold", "sold units"]),
    ("customer_count", ["customers", "new customers"]),
    ("revenue", ["revenue", "sales", "sold for"]),
    ("order_count", ["orders", "order count", "how many orders"]),
)

#: Words that name a dimension in a request.
DIMENSION_KEYWORDS = (
    ("product_sku", ["sku"]),
    ("product_stock", ["stock"]),
    ("product_rating", ["rating"]),
    ("product_price", ["price"]),
    ("product_cost", ["product cost"]),
    ("product_name", ["product"]),
    ("category_name", ["category", "categories"]),
    ("manufacturer_name", ["manufacturer", "brand"]),
    ("customer_email", ["customer", "buyer"]),
    ("order_status", ["status"]),
    ("payment_method", ["payment method"]),
    ("shipping_method", ["shipping method"]),
    ("country_name", ["country"]),
    ("store_name", ["store"]),
    ("order_month", ["month", "monthly"]),
    ("order_year", ["year", "yearly", "annual"]),
    ("order_date", ["date", "daily", "day"]),
)

#: Patterns that name the class of a request.
INTENT_PATTERNS = (
    ("tabular", ["^\\s*list\\b", "\\bshow all\\b", "\\bshow me\\b", "\\bget all\\b", "\\bdetails of\\b", "\\breport of\\b"]),
    ("ranking", ["\\btop \\d+", "\\bbottom \\d+", "\\bwhich \\d+", "\\brank\\b"]),
    ("trend", ["\\btrend\\b", "\\bover time\\b", "\\bweekly\\b", "\\bdaily\\b", "\\bmonth-over-month\\b", "\\bchart the\\b", "\\bplot the\\b", "\\bgrowth rate\\b"]),
    ("comparison", ["\\bcompare\\b", "\\bvs\\.?\\b", "\\bversus\\b", "\\bcontrast\\b", "\\bdifference between\\b"]),
    ("exception", ["\\bexceed", "\\bbelow \\d", "\\bgreater than\\b", "\\bless than\\b", "\\bmore than \\d", "\\bunder \\d", "\\bflagged\\b"]),
    ("funnel", ["\\babandon", "\\bconversion\\b", "\\bfunnel\\b"]),
    ("cohort", ["\\bcohort\\b", "\\bnew vs\\.? returning\\b", "\\bfirst-time\\b", "\\bfirst‑time\\b"]),
    ("correlate", ["\\bcorrelat", "\\brelationship between\\b"]),
    ("summary", ["\\boverview\\b", "\\bsummary\\b", "\\bsnapshot\\b", "\\bdashboard\\b", "\\bhealth score\\b"]),
    ("segment", ["\\bbreakdown\\b", "\\bby category\\b", "\\bby country\\b", "\\bsegment"]),
)

#: Other names of request classes.
INTENT_ALIASES = {
    "revenue": "kpi",
    "sales": "kpi",
    "count": "kpi",
    "total": "kpi",
    "get_total": "kpi",
    "get_count": "kpi",
    "get_top_n": "ranking",
    "get_top_customers": "ranking",
    "get_top_products": "ranking",
    "growth": "trend",
    "chart": "trend",
    "plot": "trend",
    "compare": "comparison",
    "difference": "comparison",
    "breakdown": "segment",
    "by_category": "segment",
    "distribution": "segment",
    "conversion": "funnel",
    "pipeline": "funnel",
    "stages": "funnel",
    "group_analysis": "cohort",
    "new_vs_returning": "cohort",
    "customer_type": "cohort",
    "correlation": "correlate",
    "relationship": "correlate",
    "association": "correlate",
    "list": "tabular",
    "show": "tabular",
    "details": "tabular",
    "report": "tabular",
    "records": "tabular",
    "datatable": "tabular",
    "data_table": "tabular",
    "lookup": "tabular",
}

#: What a question holds that the tables cannot answer, and why.
UNSUPPORTED_MARKERS = (
    ("homepage", "homepage visitor/conversion source is not in the benchmark schema"),
    ("visitor", "visitor/session/pageview source is not in the benchmark schema"),
    ("supplier", "supplier delivery concept is not in the semantic layer"),
    ("product bundles", "bundle or basket-pair analysis is not directly supported"),
    ("referral source", "referral-source attribution is not directly supported"),
    ("cart abandonment", "cart-abandonment event data is not in the benchmark schema"),
    ("google ads", "ad-channel traffic data is not in the benchmark schema"),
    ("facebook ads", "ad-channel traffic data is not in the benchmark schema"),
    ("mobile versus desktop", "device-channel data is not in the benchmark schema"),
    ("mobile devices versus desktop", "device-channel data is not in the benchmark schema"),
    ("site redesign", "redesign event marker is not in the benchmark schema"),
    ("invalid coupon", "coupon validity history is not in the benchmark schema"),
    ("shipping delays", "shipping-delay calculation is not a supported semantic metric"),
    ("time from order placement to shipment", "order-to-shipment duration is not a supported semantic metric"),
    ("department", "department grouping is not in the benchmark schema"),
    ("marketing campaign", "marketing campaign performance is not linked to orders in the semantic layer"),
    ("sales channel", "sales-channel grouping is not in the semantic layer"),
    ("abandoned carts", "cart recovery event data is not in the benchmark schema"),
    ("payment method has the highest failure rate", "checkout failure data is not in the benchmark schema"),
    ("sales promotions", "promotion ROI data is not in the benchmark schema"),
    ("product variants", "variant attributes are not in the semantic layer"),
    ("gift-wrapped", "gift-wrap flag is not in the benchmark schema"),
    ("free shipping coupon", "coupon-type history is not in the semantic layer"),
    ("customer segments", "age/segment/cross-sell model is not in the semantic layer"),
    ("referral programs", "referral-program acquisition-cost data is not in the benchmark schema"),
    ("saved payment method", "saved-payment-method flag is not in the benchmark schema"),
    ("subscription-based", "subscription product type is not in the semantic layer"),
    ("manual fraud review", "fraud-review flag is not in the benchmark schema"),
    ("shipping carriers", "carrier/on-time-rate data is not in the semantic layer"),
    ("loyalty point", "loyalty redemption detail is not in the semantic layer"),
    ("top 10% of spenders", "percentile/customer-lifetime-value calculation is not supported"),
    ("through the api", "API order source is not in the semantic layer"),
    ("email campaigns", "email click-through data is not in the benchmark schema"),
    ("peak traffic hours", "hour-of-day traffic context is not in the semantic layer"),
    ("shipping distance", "shipping distance is not stored in the benchmark schema"),
    ("promotional code that expired", "promotion expiry history is not in the semantic layer"),
    ("out-of-stock items", "lost revenue from stockout events is not stored"),
    ("product attributes", "attribute-correlation analysis is not in the semantic layer"),
    ("social media login", "social-login source is not in the benchmark schema"),
    ("support tickets", "support-ticket data is not in the benchmark schema"),
    ("product pages", "product-page analytics are not in the benchmark schema"),
    ("duplicate payment", "duplicate-payment review flag is not in the benchmark schema"),
    ("incorrect product descriptions", "return reason text is not in the benchmark schema"),
    ("upsell offers", "upsell offer attribution is not in the benchmark schema"),
    ("forecast", "forecasting is outside the current SQL-only evaluation scope"),
    ("third-party marketplace", "marketplace integration source is not in the semantic layer"),
    ("automating order invoicing", "automation cost saving is not in the benchmark schema"),
    ("what do customers say", "free-text sentiment/review analysis is outside current analytics scope"),
    ("which employee", "employee/support ownership data is not in the benchmark schema"),
    ("page load time", "web-performance telemetry is not in the benchmark schema"),
)

#: Phrases that name the expected metric of a question.
EXPECTED_METRIC = (
    ("avg_order_value", ["average order value", "aov", "average customer lifetime value"]),
    ("profit", ["gross profit", "profit margin", "net profit", "higher margins", "margin"]),
    ("refund", ["refund", "returns", "returned"]),
    ("discount", ["discount", "coupon", "promotional code"]),
    ("shipping_cost", ["shipping cost"]),
    ("shipment", ["shipment", "shipped", "delivered"]),
    ("customer_count", ["new customers", "customers signed up", "first-time buyers", "repeat buyers"]),
    ("quantity", ["quantity", "units sold", "items", "sold units"]),
    ("revenue", ["revenue", "sales", "total spending", "spend", "order total"]),
    ("order_count", ["orders", "order count"]),
    ("stock", ["stock", "inventory"]),
    ("rating", ["rating", "stars"]),
)

#: Phrases that name the expected grouping.
EXPECTED_DIMENSION = (
    ("category", ["category", "categories", "clothing", "home-goods", "electronics", "apparel"]),
    ("product", ["product", "sku", "items", "bundles", "variants"]),
    ("customer", ["customer", "buyers"]),
    ("country", ["country", "countries", "us", "canada", "international"]),
    ("payment_method", ["payment method"]),
    ("shipping_method", ["shipping method", "standard", "express"]),
    ("order_status", ["pending status", "status"]),
    ("date", ["by month", "daily", "weekly", "quarterly", "trend", "month-over-month", "month by month"]),
    ("store", ["store"]),
)

#: Phrases that name the expected time rule.
EXPECTED_TIME = (
    ("today", ["today", "this morning"]),
    ("yesterday", ["yesterday"]),
    ("current_week", ["current week", "this week"]),
    ("last_month", ["last month"]),
    ("current_month", ["this month"]),
    ("current_quarter", ["current quarter", "this quarter"]),
    ("last_30_days", ["last 30 days", "past 30 days"]),
    ("last_90_days", ["last 90 days", "past 90 days"]),
    ("last_180_days", ["past 180 days"]),
    ("last_year", ["last year", "past year", "last 12 months"]),
    ("year_2023", ["2023"]),
    ("year_2022_2023", ["2022-2023", "2022‑2023"]),
)

#: Tokens of SQL that show a metric: any group, all of its tokens.
METRIC_SQL_TOKENS = {
    "revenue": [["ordertotal"], ["priceexcltax", "priceincltax", "unitprice"]],
    "order_count": [["count", "o.id"], ["count", "order"]],
    "avg_order_value": [["avg", "ordertotal"], ["sum", "ordertotal", "count"]],
    "profit": [["profit"], ["productcost"], ["originalproductcost"], ["ordersubtotalexcltax"]],
    "refund": [["refund"]],
    "discount": [["discount"], ["coupon"]],
    "shipping_cost": [["shipping"]],
    "shipment": [["shipment"], ["shippeddateutc"], ["deliverydateutc"]],
    "customer_count": [["count", "customer"], ["count", "cu.id"]],
    "quantity": [["quantity"], ["item_quantity"]],
    "stock": [["stockquantity"], ["stock"]],
    "rating": [["rating"], ["approvedtotalreviews"], ["review"]],
}

#: What is said of a scored answer.
SCORE_REASONS = {
    "avoided": "correctly avoided unsupported or unsafe request",
    "should_reject": "request should be clarified or rejected",
    "not_executed": "SQL did not execute",
    "multi_part": "requires both monthly revenue trend and top customer ranking",
    "metric": "missing expected metric evidence: ",
    "dimension": "missing expected grouping/filter evidence: ",
    "time": "missing expected time/filter evidence: ",
    "grouped": "query asks for one aggregate value but SQL groups the result",
    "correct": "executed SQL matches expected metric/grouping/time at conservative keyword level",
}

#: Tokens of SQL that show a grouping.
DIM_SQL_TOKENS = {
    "category": [["category"], ["c.name"]],
    "product": [["product"], ["p.name"], ["sku"]],
    "customer": [["customer"], ["cu.email"], ["c.email"], ["firstname"], ["lastname"]],
    "country": [["country"], ["co.name"]],
    "payment_method": [["paymentmethodsystemname"], ["payment method"]],
    "shipping_method": [["shippingmethod"], ["shipping method"]],
    "order_status": [["orderstatusid"], ["order status"]],
    "date": [["createdonutc"], ["date_format"], ["yearweek"], ["quarter("]],
    "store": [["store"]],
}

#: Tokens of SQL that show a time rule.
TIME_SQL_TOKENS = {
    "today": [["utc_date"], ["curdate"], ["utc_timestamp"], ["createdonutc"]],
    "yesterday": [["interval 1 day"], ["date_sub"], ["createdonutc"]],
    "current_week": [["weekday"], ["week"], ["interval 7 day"], ["createdonutc"]],
    "last_month": [["interval 1 month"], ["last month"], ["createdonutc"]],
    "current_month": [["date_format"], ["month("], ["createdonutc"]],
    "current_quarter": [["quarter"], ["createdonutc"]],
    "last_30_days": [["interval 30 day"], ["30 day"], ["createdonutc"]],
    "last_90_days": [["interval 90 day"], ["90 day"], ["createdonutc"]],
    "last_180_days": [["interval 180 day"], ["180 day"], ["createdonutc"]],
    "last_year": [["interval 1 year"], ["12 month"], ["year"], ["createdonutc"]],
    "year_2023": [["2023"], ["createdonutc"]],
    "year_2022_2023": [["2022"], ["2023"], ["createdonutc"]],
}
