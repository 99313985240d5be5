"""Preparation of base tables: date refresh, header sums, required columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.star import money


def _back(id: Column, as_of: datetime) -> Column:
    """A moment up to 359 days before as_of, spread by the id."""
    days = F.pmod(id * 17 + 3, F.lit(360)).cast("int")
    return F.lit(as_of.isoformat(" ")).cast("timestamp_ntz") - F.make_dt_interval(days)


def refresh_order_dates(orders: DataFrame, as_of: datetime) -> DataFrame:
    """Orders with dates of the year before as_of; a paid date only where there was one."""
    moved = _back(F.col("Id"), as_of)
    return orders.withColumns({"CreatedOnUtc": moved, "PaidDateUtc": F.when(F.col("PaidDateUtc").isNotNull(), moved)})


def refresh_shipments(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """Shipments with dates after their order's: sent a day later, delivered three days later if at all."""
    created = orders.select(F.col("Id").alias("order_id"), F.col("CreatedOnUtc").alias("ordered"))
    day = lambda n: F.col("ordered") + F.make_dt_interval(F.lit(n))
    moved = {"CreatedOnUtc": day(1), "ShippedDateUtc": day(1), "DeliveryDateUtc": F.when(F.col("DeliveryDateUtc").isNotNull(), day(3))}
    return shipments.join(created, shipments["OrderId"] == created["order_id"]).withColumns(moved).drop("order_id", "ordered")


def order_rollup(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Header money from lines: subtotal, cost, 5 % tax in whole units, and the total with shipping and discount."""
    sums = lines.groupBy(F.col("OrderId").alias("Id")).agg(F.sum("PriceExclTax").alias("subtotal"), F.sum("OriginalProductCost").alias("cost"))
    tax = F.floor(F.col("subtotal") * F.lit("0.05").cast("decimal(3,2)"))
    out = orders.join(sums, "Id").withColumn("tax", tax)
    return out.withColumn("total", money(F.col("subtotal") + F.col("tax") + F.col("shipping") - F.col("discount")))


#: Flags that default to true.
TRUE_BY_DEFAULT = ("Published", "VisibleIndividually", "AllowsBilling", "AllowsShipping")


def fill_required(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema that allow no null: missing or null ones get their type's default."""

    def default(f: T.StructField) -> Column:
        if f.name in TRUE_BY_DEFAULT:
            value = F.lit(1)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            value = F.lit("1970-01-01")
        else:
            value = F.lit(0) if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.lit("")
        return value.cast(f.dataType)

    filled = {f.name: F.coalesce(F.col(f.name), default(f)) if f.name in df.columns else default(f) for f in schema if not f.nullable}
    return df.withColumns(filled)
