"""Upkeep of a large table of saved reports, keyed by a hash of their plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import dimension
from ..functions.metrics import metric
from ..plans.reports import ReportSpec, rows
from ..sources.star import StarSchema


def report_id(plan: dict[str, Column], sets: tuple[str, ...] = ()) -> Column:
    """16 hexadecimal digits of the SHA-256 of the plan as JSON, fields in order of name.

    sets: fields that are arrays whose order means nothing; they are sorted first.
    """
    fields = [(F.array_sort(plan[k]) if k in sets else plan[k]).alias(k) for k in sorted(plan)]
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def latest(catalog: DataFrame, key: str = "id", by: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in by]))
    return catalog.withColumn("_n", n).where("_n = 1").drop("_n")


def listed(catalog: DataFrame, n: int, scope: str | None = None) -> DataFrame:
    """The last updated reports, perhaps of one scope."""
    found = catalog if scope is None else catalog.where(F.col("scope") == scope)
    return found.orderBy(F.desc("updated_at"), "id").limit(n)


def similar(catalog: DataFrame) -> DataFrame:
    """Reports that share pattern, metric and dimension with others: a row each, and how many share them."""
    of = ["pattern", "metric", "dimension"]
    each = catalog.select(*of, "id").distinct()
    sizes = each.groupBy(*[F.col(c).alias(f"g_{c}") for c in of]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = F.lit(True)
    for c in of:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return each.join(sizes, same).select(*of, "n", "id")


def reuse(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """incoming with a flag: is its id in the catalog."""
    known = catalog.select(F.col("id").alias("known")).distinct()
    return incoming.join(known, F.col("id") == F.col("known"), "left").withColumn("reused", F.col("known").isNotNull()).drop("known")


def search(catalog: DataFrame, words: str, column: str = "question") -> DataFrame:
    return catalog.where(F.contains(F.lower(column), F.lit(words.lower())))


def delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids, "id", "left_anti")


def record_runs(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """catalog (id, run_history, updated_at) with run times (id, ts) appended in order."""
    each = runs.groupBy("id").agg(F.array_sort(F.collect_list("ts")).alias("new"), F.max("ts").alias("last"))
    out = catalog.join(each, "id", "left")
    return out.withColumn("run_history", F.concat("run_history", F.coalesce("new", F.array().cast("array<timestamp_ntz>")))).withColumn("updated_at", F.greatest("updated_at", "last")).drop("new", "last")


def refresh(star: StarSchema, specs: list[ReportSpec]) -> DataFrame:
    """(dimension, metric, label, value) of saved specs on fresh data.

    Specs that need the same joins and filters share one aggregation: one pass for each group.
    """
    groups: dict[tuple, list[ReportSpec]] = {}
    for s in specs:
        groups.setdefault((metric(s.metric).table, s.dimension, s.time, s.filters, s.role), []).append(s)
    out: DataFrame | None = None
    for group in groups.values():
        d, ms = dimension(group[0].dimension), [metric(i) for i in dict.fromkeys(s.metric for s in group)]
        wide = rows(star, [*ms, d], group[0]).groupBy(d.as_label().cast("string").alias("label")).agg(*[m.agg().cast("double").alias(m.id) for m in ms])
        long = wide.unpivot(["label"], [m.id for m in ms], "metric", "value").select(F.lit(d.id).alias("dimension"), "metric", "label", "value")
        out = long if out is None else out.unionByName(long)
    return out
