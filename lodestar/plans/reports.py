"""Report patterns over the star schema."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import Dimension, dimension
from ..functions.metrics import Metric, metric
from ..functions.predicates import Predicate, bound_to, combined, policy
from ..functions.timewin import in_window, time_window, up_to
from ..sources.star import ALIASES, ORDER_LINE_SUMS, StarSchema
from .star_join import by_order, root_of, star_join

DEFAULT_LIMIT = 100
UNLIMITED = ("kpi", "summary")
#: Metrics that count distinct orders.
COUNTS_ORDERS = ("order_count", "refund_count")


@dataclass(frozen=True)
class ReportSpec:
    pattern: str = "kpi"
    metric: str = "revenue"
    dimension: str | None = None
    time: str | None = None
    filters: tuple[Predicate, ...] = ()
    sort: str = "desc"
    limit: int | None = None
    role: str = "public"
    role_params: dict = field(default_factory=dict)
    #: Last week, this week, last month and this month without their ends.
    open_windows: bool = False


def _reads(parts: Iterable[Metric | Dimension], filters: Iterable[Predicate], more: Iterable[tuple[str, tuple[str, ...]]] = ()) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for table, columns in [*((p.table, p.columns) for p in parts), *map(bound_to, filters), *more]:
        out.setdefault(table, set()).update(columns)
    return out


def _when(column: str, spec: ReportSpec, as_of: datetime) -> Column:
    low, high = time_window(spec.time, as_of, spec.open_windows)
    return up_to(F.col(column), high) if low is None else in_window(F.col(column), (low, high))


def rows(star: StarSchema, parts: Iterable[Metric | Dimension], spec: ReportSpec = ReportSpec(), as_of: datetime | None = None, orders: Column | None = None, also: Iterable[str] = (), once: bool = False) -> DataFrame:
    """The joined rows of a report: what its parts, filters and the tables also need, filtered.

    They begin at the table where those needed meet, so a report that reads nothing of orders does not join
    them, and counts customers or products without any. The time rule, the role and conditions on orders
    alone are applied to orders before any join, and before sums over their lines are made.

    Where a metric counts distinct orders or each order once, the rows of all orders come in small pieces (by_order).
    """
    parts = list(parts)
    rule = policy(spec.role)
    more = [("Order", ("CreatedOnUtc",))] * bool(spec.time or orders is not None) + [(t, ()) for t in also]
    reads = _reads(parts, spec.filters, [*more, *([rule[:2]] if rule else [])])
    at = root_of(reads)
    if at == "Order":
        tests = [
            _when("o.CreatedOnUtc", spec, as_of) if spec.time else None, orders, rule[2](spec.role_params) if rule and rule[0] == "Order" else None,
            combined(f for f in spec.filters if (b := bound_to(f))[0] == "Order" and not {*b[1]} & {*ORDER_LINE_SUMS}),
        ]
        tests = [t for t in tests if t is not None]
        root = star.orders(reads.get("Order", ()), reduce(lambda a, b: a & b, tests)) if tests else star.table("Order", reads.get("Order", ()))
        once = not tests and (once or any(p.id in COUNTS_ORDERS for p in parts))
    else:
        root = star.table(at, reads.get(at, ()))
    out = by_order(star, reads, reads, root) if at == "Order" and once else star_join(star, reads, reads, root, at)
    if rule and rule[0] != "Order":
        out = out.where(rule[2](spec.role_params))
    condition = combined(spec.filters)
    return out if condition is None else out.where(condition)


def report(star: StarSchema, spec: ReportSpec, as_of: datetime | None = None) -> DataFrame:
    """label and value (value alone without a dimension): grouped, in a total order, limited.

    Trends are in the order of their labels, all else by value and then label. The limit is the
    spec's, or DEFAULT_LIMIT but for kpi and summary.
    """
    m = metric(spec.metric)
    if spec.dimension is None:
        return rows(star, [m], spec, as_of).agg(m.agg().alias("value"))
    d = dimension(spec.dimension)
    grouped = rows(star, [m, d], spec, as_of).groupBy(d.as_label().alias("label")).agg(m.agg().alias("value"))
    limit = spec.limit or (None if spec.pattern in UNLIMITED else DEFAULT_LIMIT)
    if spec.pattern == "trend":
        grouped = grouped.orderBy(F.col("label").asc_nulls_first())
    elif limit or spec.pattern not in UNLIMITED:
        by = F.col("value").asc_nulls_last() if spec.sort == "asc" else F.col("value").desc_nulls_last()
        grouped = grouped.orderBy(by, F.col("label").asc_nulls_first())
    return grouped.limit(limit) if limit else grouped


def fanout_safe(star: StarSchema, spec: ReportSpec, as_of: datetime | None = None) -> DataFrame:
    """A header metric by a dimension that repeats orders: each order counts once for a label."""
    m, d = metric(spec.metric), dimension(spec.dimension)
    joined = rows(star, [m, d], spec, as_of, once=True)
    once = joined.select(d.as_label().alias("label"), F.col("o.Id").alias("Id"), *[F.col(f"o.{c}") for c in m.columns if c != "Id"]).dropDuplicates(["label", "Id"])
    return once.alias("o").groupBy("label").agg(m.agg().alias("value"))


def trend(star: StarSchema, metric_id: str, grain: str, spec: ReportSpec = ReportSpec(), as_of: datetime | None = None) -> DataFrame:
    """A metric by day, week (from Monday), month, quarter or year of the order, in time order."""
    m = metric(metric_id)
    bucket = F.date_format(F.to_date(F.date_trunc(grain, "o.CreatedOnUtc")), "yyyy-MM-dd").alias("label")
    return rows(star, [m], spec, as_of, also=["Order"]).groupBy(bucket).agg(m.agg().alias("value")).orderBy("label")


def comparison_pivot(star: StarSchema, metric_id: str, rows_by: str, members_of: str, members: list[str]) -> DataFrame:
    """A metric by one dimension, with a column for each of a few members of another."""
    m, by, of = metric(metric_id), dimension(rows_by), dimension(members_of)
    joined = rows(star, [m, by, of], ReportSpec(filters=(Predicate(members_of, "in", members),)))
    return joined.withColumn("member", of.expr()).groupBy(by.as_label().alias("label")).pivot("member", members).agg(m.agg())


def share(grouped: DataFrame) -> DataFrame:
    """label, value and the percentage of the total; grouped is small, so one window over all is."""
    return grouped.select("label", "value", F.round(100 * F.col("value") / F.sum("value").over(Window.partitionBy()), 4).alias("pct"))


def summary(star: StarSchema, metric_ids: list[str], dimension_id: str, spec: ReportSpec = ReportSpec(), as_of: datetime | None = None) -> DataFrame:
    """Several metrics by one dimension. Metrics of one table share a join and an aggregation; those of
    different grain are grouped apart and meet on the label, so none is repeated by another's joins."""
    d = dimension(dimension_id)
    by_table: dict[str, list[Metric]] = {}
    for m in map(metric, metric_ids):
        by_table.setdefault(m.table, []).append(m)
    out: DataFrame | None = None
    for group in by_table.values():
        part = rows(star, [*group, d], spec, as_of).groupBy(d.as_label().alias("label")).agg(*[m.agg().alias(m.id) for m in group])
        if out is None:
            out = part
        else:
            right = part.withColumnRenamed("label", "other")
            out = out.join(right, out["label"].eqNullSafe(right["other"]), "full").withColumn("label", F.coalesce("label", "other")).drop("other")
    return out.select("label", *metric_ids)


def funnel(star: StarSchema, stages: dict[str, Column]) -> DataFrame:
    """Orders that reach each stage, and the share of the stage before it. stages: name to condition."""
    o = star.table("Order", {"OrderStatusId"})
    counts = o.agg(*[F.count_distinct(F.when(c, F.col("o.Id"))).alias(f"s{i}") for i, c in enumerate(stages.values())])
    listed = counts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"s{i}").alias("orders")) for i, n in enumerate(stages)])).alias("step", "x")).select("step", "x.stage", "x.orders")
    before = F.lag("orders").over(Window.orderBy("step"))
    return listed.select("step", "stage", "orders", F.round(F.try_divide(F.col("orders").cast("double"), before), 6).alias("step_rate"))


def cohort(star: StarSchema, metric_id: str = "revenue") -> DataFrame:
    """A metric of orders by new (a customer's first order) and returning."""
    m = metric(metric_id)
    orders = star.table("Order", m.columns)
    first = orders.groupBy(F.col("o.CustomerId").alias("c")).agg(F.min_by("o.Id", F.struct("o.CreatedOnUtc", "o.Id")).alias("first"))
    kind = F.when(F.col("o.Id") == F.col("first"), "new").otherwise("returning")
    return orders.join(first, F.col("o.CustomerId") == F.col("c")).groupBy(kind.alias("label")).agg(m.agg().alias("value"))


def correlate(star: StarSchema, x: str, y: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The points (label, x, y) of two metrics by a dimension, and their correlation."""
    d = dimension(by)
    points = rows(star, [metric(x), metric(y), d]).groupBy(d.as_label().alias("label")).agg(metric(x).agg().cast("double").alias("x"), metric(y).agg().cast("double").alias("y"))
    return points, points.agg(F.round(F.corr("x", "y"), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


#: Columns added to listings: of which table, under which name, and how.
NATURAL = (
    ("Product", "stock", "StockQuantity", lambda c: c),
    ("Product", "reviews", "ApprovedTotalReviews", lambda c: c),
    ("Customer", "registered_on", "CreatedOnUtc", lambda c: F.date_format(F.to_date(c), "yyyy-MM-dd")),
    ("Order", "total", "OrderTotal", lambda c: c.cast("double")),
    ("Order", "date", "CreatedOnUtc", lambda c: F.date_format(F.to_date(c), "yyyy-MM-dd")),
)
_SAME = {"stock": "product_stock", "reviews": "product_rating", "registered_on": "customer_registration_date", "date": "order_date"}


def tabular(star: StarSchema, spec: ReportSpec, as_of: datetime | None = None) -> DataFrame:
    """A row listing: label, the metric's value of the row if it has one, natural columns; no grouping.

    The root is Order if the report needs it, else Product, else Customer; the time rule tests the
    root's own date. In the order of the value, else of the label, and then of the other columns.
    """
    d = dimension(spec.dimension)
    m = metric(spec.metric) if spec.metric else None
    tables = {d.table} | {bound_to(f)[0] for f in spec.filters} | ({m.table} if m else set())
    if tables <= {"Product"} or tables <= {"Customer"}:
        root = tables.pop()
        out = star.table(root, {*d.columns, "CreatedOnUtc"})
        if (condition := combined(spec.filters)) is not None:
            out = out.where(condition)
        if spec.time:
            out = out.where(_when(f"{ALIASES[root]}.CreatedOnUtc", spec, as_of))
        present = {root}
    else:
        out = rows(star, [p for p in (m, d) if p], spec, as_of, also=["Order"])
        present = {"Order", d.table} | ({m.table} if m else set())
    row = m.row() if m and m.row else None
    value = [] if row is None else [(row if m.id in ("order_count", "customer_count", "shipment_count", "item_quantity") else row.cast("double")).alias("value")]
    extra = [f(F.col(f"{ALIASES[t]}.{c}")).alias(n) for t, n, c, f in NATURAL if t in present and t in (d.table, "Order" if m and m.table == "Order" else d.table) and _SAME.get(n) != d.id]
    listed = out.select(d.as_label().alias("label"), *value, *extra)
    first = [F.col("value").asc_nulls_last() if spec.sort == "asc" else F.col("value").desc_nulls_last()] if value else []
    return listed.orderBy(*first, *[F.col(c).asc_nulls_first() for c in listed.columns if c != "value"]).limit(spec.limit or DEFAULT_LIMIT)


def exception(star: StarSchema, spec: ReportSpec, as_of: datetime | None = None) -> DataFrame:
    """Rows beyond a threshold, which is a filter on the metric."""
    return tabular(star, spec, as_of)


def exception_group(star: StarSchema, spec: ReportSpec, condition: Column, as_of: datetime | None = None) -> DataFrame:
    """Groups beyond a threshold: condition tests value after grouping."""
    return report(star, replace(spec, pattern="summary"), as_of).where(condition)
