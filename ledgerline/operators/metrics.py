"""Queries over metric series: rows of (entity, metric, end_d, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(metrics: DataFrame, end: str | None = None) -> DataFrame:
    """Each entity's metrics at one period end, or at its latest."""
    if end is not None:
        return metrics.where(F.col("end_d") == F.lit(end).cast("date"))
    latest = metrics.groupBy("entity", "metric").agg(F.max("end_d").alias("end_d"), F.max_by("value", "end_d").alias("value"))
    return latest.select("entity", "metric", "end_d", "value")


def metric_series(metrics: DataFrame, metric: str, n: int, priority: list[str] | None = None) -> DataFrame:
    """The last n periods of a metric; where it stands in several statements, the first of ``priority`` that has it."""
    rows = metrics.where(F.col("metric") == metric)
    if priority:
        order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("statement"))
        rows = rows.withColumn("_p", F.dense_rank().over(Window.partitionBy("entity").orderBy(order))).where("_p = 1").drop("_p")
    by = Window.partitionBy("entity").orderBy(F.desc("end_d"))
    return rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= n)


def filter_periods(series: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows in a wanted (fiscal_year, quarter); a null quarter wants the year."""
    want = F.broadcast(periods.select(F.col("fiscal_year").alias("_y"), F.col("quarter").alias("_q")).distinct())
    return series.join(want, (F.col("fiscal_year") == F.col("_y")) & (F.col("_q").isNull() | (F.col("quarter") == F.col("_q"))), "left_semi")


def period_gaps(requested: DataFrame, series: DataFrame) -> DataFrame:
    """Requested (entity, fiscal_year, quarter) that have no row, with the range that there is."""
    missing = requested.join(series, ["entity", "fiscal_year", "quarter"], "left_anti")
    span = series.groupBy("entity").agg(F.min("end_d").alias("first_d"), F.max("end_d").alias("last_d"))
    return missing.join(span, "entity", "left")


def ratio_latest(metrics: DataFrame, num: str, den: str) -> DataFrame:
    """num / den at the latest period that has both."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    both = metrics.where(F.col("metric").isin(num, den)).groupBy("entity", "end_d").agg(pick(num).alias("x"), pick(den).alias("y")).where("x IS NOT NULL AND y <> 0")
    return both.groupBy("entity").agg(F.max("end_d").alias("end_d"), (F.abs(F.max_by("x", "end_d")) / F.max_by("y", "end_d")).alias("ratio"))


def scaled(value: Column) -> tuple[Column, Column]:
    """(number, unit) in B, M or K."""
    size = F.abs(value)
    unit = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "K").otherwise("")
    return F.when(size >= 1e9, value / 1e9).when(size >= 1e6, value / 1e6).when(size >= 1e3, value / 1e3).otherwise(value), unit


def pivot_metric(rows: DataFrame, key: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """Keys by columns, those that the rows have (years, labels: a pivot takes 10,000 at most) unless they are named; holes are null."""
    return rows.groupBy(key).pivot(column, columns).agg(F.first(value, ignorenulls=True))


def income_summary(lines: DataFrame, scale: float) -> DataFrame:
    """Revenue, operating income and margin by year, scaled."""
    pick = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    by = lines.groupBy("entity", F.year("end_d").alias("year")).agg(pick("revenue").alias("r"), pick("operating_income").alias("o"))
    return by.select("entity", "year", (F.col("r") / scale).alias("revenue"), (F.col("o") / scale).alias("operating_income"), F.when(F.col("r") != 0, F.col("o") / F.col("r") * 100).alias("margin_pct"))


def first_available(rows: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """Magnitude under the first of ``labels`` that a key has (CapEx goes by several names)."""
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("metric"))
    return rows.where(F.col("metric").isin(labels)).groupBy(*keys).agg(F.abs(F.min_by("value", order)).alias("value"))


def gaps_with_newest(requested: DataFrame, series: DataFrame, n: int) -> DataFrame:
    """Requested (entity, fiscal_year, quarter) without a row, each with the newest n periods that there are."""
    there = series.select("entity", "fiscal_year", "quarter").distinct()
    by = Window.partitionBy("entity").orderBy(F.desc("fiscal_year"), F.desc("quarter"))
    label = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit(" Q"), F.col("quarter").cast("string"))
    top = there.withColumn("i", F.row_number().over(by)).where(F.col("i") <= n).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", label.alias("label")))), lambda x: x["label"]), ",").alias("newest"))
    return requested.join(there, ["entity", "fiscal_year", "quarter"], "left_anti").join(top, "entity", "left")


#: Outflows that are stored negative and shown positive.
OUTFLOWS = ["capex", "dividends_paid", "share_repurchases"]


def shown(value: Column, metric: Column) -> Column:
    return F.when(metric.isin(OUTFLOWS), -value).otherwise(value)


def series_payload(rows: DataFrame, n: int) -> DataFrame:
    """(entity, metric, label, end_d, value, n): the newest n periods of each series with their fiscal labels."""
    by = Window.partitionBy("entity", "metric").orderBy(F.desc("end_d"))
    label = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit(" Q"), F.col("quarter").cast("string"))
    return rows.withColumn("n", F.row_number().over(by).cast("long")).where(F.col("n") <= n).select("entity", "metric", label.alias("label"), "end_d", "value", "n")
