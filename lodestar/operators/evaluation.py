"""Evaluation jobs over results of several systems: rates, accuracy, distributions, latencies, upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Report patterns, in the order in which they are listed.
PATTERNS = ("KPI", "Ranking", "Trend", "Comparison", "Exception", "Summary", "Segment", "Funnel", "Cohort", "Correlate", "Tabular")
#: Shares of rows to either side of a rank that its bracket spans; accuracy of the bracket (its error is 1 / ACCURACY).
BRACKET, ACCURACY = 0.001, 10_000
#: Quantiles that a bracket is divided by.
STEPS = 1000


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.coalesce(F.try_divide(100 * part.cast("double"), whole), F.lit(0.0)), digits)


def validity_rate(results: DataFrame) -> DataFrame:
    """By system: results that are ok, all, and the percentage. results: system, ok."""
    ok = F.count_if("ok")
    return results.groupBy("system").agg(ok.alias("ok"), F.count(F.lit(1)).alias("total"), _pct(ok, F.count(F.lit(1))).alias("pct"))


def execution_ok(spark: SparkSession, total: int, failures: DataFrame) -> DataFrame:
    """Ids 1 to total that are not among the failures (column id)."""
    return spark.range(1, total + 1).join(failures, "id", "left_anti")


def unsafe_rate(texts: DataFrame, unsafe: Column) -> DataFrame:
    """By system: unsafe texts and their percentage. texts: system."""
    flagged = texts.withColumn("unsafe", unsafe)
    return flagged.groupBy("system").agg(F.count_if("unsafe").alias("unsafe"), _pct(F.count_if("unsafe"), F.count(F.lit(1)), 4).alias("pct"))


def unsafe_ids(texts: DataFrame, unsafe: Column) -> DataFrame:
    """(system, id) of each unsafe text: a row each, as there may be any number of them."""
    return texts.where(unsafe).select("system", "id")


def accuracy_summary(rows: DataFrame, systems: list[str]) -> DataFrame:
    """By system: right and wrong, accuracy overall, of questions to answer, and of those to decline.

    rows: behavior, and a boolean column for each system.
    """
    long = rows.unpivot(["behavior"], systems, "system", "correct")
    answer, decline = F.col("behavior") == "answer", F.col("behavior").isin("clarify_or_reject", "reject_write_request")
    count = lambda c: F.count_if(c)
    return long.groupBy("system").agg(
        count(F.col("correct")).alias("correct"), count(~F.col("correct")).alias("incorrect"), _pct(count(F.col("correct")), F.count(F.lit(1))).alias("accuracy"),
        count(answer).alias("answerable"), _pct(count(answer & F.col("correct")), count(answer)).alias("answerable_accuracy"),
        count(decline).alias("unsupported"), _pct(count(decline & F.col("correct")), count(decline)).alias("unsupported_accuracy"),
    )


def behavior_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("behavior").agg(F.count(F.lit(1)).alias("n"))


def pattern_distribution(labelled: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Count and percentage of each pattern, those without rows too. labelled: pattern."""
    counts = labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    every = labelled.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string").join(counts, "pattern", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.select("pattern", F.col("n").alias("count"), _pct(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


def at_ranks(values: DataFrame, by: str, x: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """by, n (rows of the group), and the exact value of x at some ranks of each group, counted from 0.

    ranks: by name, the share of rows about that rank, and the rank as a function of n. Null x is
    skipped. An approximate quantile brackets each rank, and another one within the bracket narrows it; what
    lies below is only counted, so a group's one task sees the distinct values inside, some millionths of the group.
    """
    some = values.where(F.col(x).isNotNull()).select(by, F.col(x).alias("x"))
    points = [min(max(s + d, 0.0), 1.0) for s, _ in ranks.values() for d in (-BRACKET, BRACKET)]
    sizes = some.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", points, ACCURACY).alias("q"))
    few = F.col("n") < ACCURACY  # the bracket may be narrower than one row
    wanted = sizes.select(F.col(by).alias("g"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("name"), rank(F.col("n")).cast("long").alias("rank"), F.when(few, F.col("least")).otherwise(F.get("q", F.lit(2 * i))).alias("low"), F.when(few, F.col("most")).otherwise(F.get("q", F.lit(2 * i + 1))).alias("high"))
        for i, (k, (_, rank)) in enumerate(ranks.items())
    ])).alias("w")).select("g", "w.*")
    wanted = _narrowed(some, wanted, by)
    inside = some.join(wanted, F.col(by).eqNullSafe(F.col("g"))).where(F.col("x") <= F.col("high"))
    counted = inside.groupBy("g", "name", "rank", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy(F.col("x").asc_nulls_first()))
    reached = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & F.col("x").isNotNull())
    found = reached.groupBy("g").agg(*[F.min(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in ranks])
    return sizes.select(by, "n").join(found, F.col(by).eqNullSafe(F.col("g"))).drop("g")


def _narrowed(some: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Brackets (g, name, rank, low, high) drawn closer about their ranks, by quantiles of what they hold."""
    grid = [i / STEPS for i in range(STEPS + 1)]
    held = some.join(wanted, F.col(by).eqNullSafe(F.col("g"))).where(F.col("x") <= F.col("high"))
    within = F.when(F.col("x") >= F.col("low"), F.col("x"))
    stats = held.groupBy("g", "name", "rank", "low", "high").agg(F.count_if(F.col("x") < F.col("low")).alias("below"), F.count(within).alias("within"), F.percentile_approx(within, grid, ACCURACY).alias("q"))
    at = (F.col("rank") - F.col("below")) / F.col("within") * STEPS
    some_way = F.lit(2)  # steps to either side: more than the error of a quantile
    low, high = F.get("q", F.greatest(F.floor(at) - some_way, F.lit(0)).cast("int")), F.get("q", F.least(F.ceil(at) + some_way, F.lit(STEPS)).cast("int"))
    few = F.col("within") < ACCURACY
    return stats.select("g", "name", "rank", F.when(few, F.col("low")).otherwise(F.coalesce(low, "low")).alias("low"), F.when(few, F.col("high")).otherwise(F.coalesce(high, "high")).alias("high"))


def between_ranks(n: Column, share: float, low: Column, high: Column) -> Column:
    """The quantile of a share, from the values at the ranks below and above (n - 1) * share."""
    at = (n - 1) * F.lit(share)
    return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def latency_summary(long: DataFrame) -> DataFrame:
    """By stage: count, mean, median, p95 (the value at index round((n - 1) * 0.95), half to even), max.

    long: stage, ms; null times are skipped.
    """
    basic = long.where(F.col("ms").isNotNull()).groupBy("stage").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.round(F.max("ms"), 2).alias("max_ms"))
    ranked = at_ranks(long, "stage", "ms", {
        "below": (0.5, lambda n: F.floor((n - 1) * F.lit(0.5))), "above": (0.5, lambda n: F.ceil((n - 1) * F.lit(0.5))), "p95": (0.95, lambda n: F.rint((n - 1) * F.lit(0.95))),
    })
    median = between_ranks(F.col("n"), 0.5, F.col("below"), F.col("above"))
    ranked = ranked.select(F.col("stage").alias("s"), F.round(median, 2).alias("median_ms"), F.round("p95", 2).alias("p95_ms"))
    return basic.join(ranked, F.col("stage").eqNullSafe(F.col("s"))).drop("s")


def annotation_template(questions: DataFrame, results: DataFrame, earlier: DataFrame) -> DataFrame:
    """Questions with their results and labels; labels given before are kept. All keyed by id."""
    old = earlier.select("id", F.col("label").alias("old_label"))
    return questions.join(results, "id", "left").join(old, "id", "left").withColumn("label", F.coalesce("old_label", "label")).drop("old_label")


def pattern_join(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Questions with the pattern of the record whose index is one below their id."""
    return questions.join(records.select((F.col("index") + 1).alias("id"), "pattern"), "id", "left").withColumn("pattern", F.coalesce("pattern", F.lit("Unsupported/Mixed")))


def class_prf(pairs: DataFrame) -> DataFrame:
    """By class: precision, recall and F1 of predicted against actual, from the confusion counts."""
    confusion = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("x"), (F.col("actual") == F.col("predicted")).alias("hit"), "n")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    hits, actual, predicted = of(F.col("hit") & (F.col("x.a") == 1)), of(F.col("x.a") == 1), of(F.col("x.p") == 1)
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return sides.groupBy(F.col("x.class").alias("class")).agg(ratio(hits, predicted).alias("precision"), ratio(hits, actual).alias("recall"), ratio(2 * hits, actual + predicted).alias("f1"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new put in their place by key; new has one row for a key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_turn")))
    return both.withColumn("_n", last).where("_n = 1").drop("_turn", "_n")


def resume_pending(questions: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Questions without a successful result. results: key, ok."""
    return questions.join(results.where("ok"), key, "left_anti")


def result_set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same columns and the same rows, repeats counted."""
    spark = a.sparkSession
    if a.columns != b.columns:
        return spark.createDataFrame([(False,)], "equal boolean")
    different = a.exceptAll(b).limit(1).unionByName(b.exceptAll(a).limit(1))
    return different.agg((F.count(F.lit(1)) == 0).alias("equal"))
