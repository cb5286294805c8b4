"""Trends over per-entity series: slopes, forecasts, growth, outliers against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def direction(slope: Column, mean: Column, cut: float = 0.05) -> Column:
    """increasing, decreasing or stable, by the slope over the absolute mean."""
    share = F.when(mean != 0, slope / F.abs(mean)).otherwise(slope)
    return F.when(share > cut, "increasing").when(share < -cut, "decreasing").otherwise("stable")


def _indexed(series: DataFrame, key: str, at: str) -> DataFrame:
    return series.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1).cast("double"))


def trend_direction(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, n, slope, direction); one point is insufficient_data."""
    fit = _indexed(series, key, at).groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope(value, "i"), F.lit(0.0)).alias("slope"), F.avg(value).alias("mean"))
    return fit.select(key, "n", "slope", F.when(F.col("n") < 2, "insufficient_data").otherwise(direction(F.col("slope"), F.col("mean"))).alias("direction"))


def linear_forecast(series: DataFrame, key: str, at: str, value: str, ahead: int) -> DataFrame:
    """(key, step, forecast, confidence): straight line through all points; confidence 100 less the residuals' spread over the mean."""
    rows = _indexed(series, key, at)
    fit = rows.groupBy(key).agg(F.regr_slope(value, "i").alias("slope"), F.regr_intercept(value, "i").alias("cut"), F.avg(value).alias("mean"), F.count("*").alias("n")).where("n >= 2")
    spread = rows.join(fit, key).groupBy(key).agg(F.stddev_samp(F.col(value) - F.col("cut") - F.col("slope") * F.col("i")).alias("residual"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("residual") / F.greatest(F.abs("mean"), F.lit(1.0)) * 100))
    steps = fit.join(spread, key).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    return steps.select(key, "step", (F.col("cut") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"), F.when(F.col("n") == 2, F.lit(50.0)).otherwise(score).alias("confidence"))


def yoy_growth(series: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Growth between the two latest years of each key; null without a year before or with 0 in it."""
    by = Window.partitionBy(key).orderBy(year)
    rows = series.withColumn("previous", F.lag(value).over(by)).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(year))))
    return rows.where("n = 1").select(key, year, value, "previous", F.when(F.col("previous") != 0, (F.col(value) - F.col("previous")) / F.abs("previous")).alias("growth"))


def latest_vs_history(series: DataFrame, key: str, year: str, value: str, flag: float = 0.2, high: float = 0.5) -> DataFrame:
    """The latest value against the mean of all before it."""
    before = Window.partitionBy(key).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    rows = series.withColumn("history", F.avg(value).over(before)).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(year))))
    change = (F.col(value) - F.col("history")) / F.abs("history")
    rows = rows.where("n = 1 AND history <> 0").withColumn("change", change)
    return rows.select(key, year, value, "history", "change", F.when(F.abs("change") >= high, "high").when(F.abs("change") >= flag, "medium").otherwise("none").alias("severity"))


def amount_anomalies(amounts: DataFrame, key: str, period: str, value: str, threshold: float = 0.2) -> DataFrame:
    """Periods whose mean lies over 1.5 deviations or ``threshold`` off the mean of all; two periods use 0.3 of it."""
    per = amounts.groupBy(key, period).agg(F.avg(value).alias("average"), F.count("*").alias("mentions"))
    whole = Window.partitionBy(key)
    per = per.withColumn("mean", F.avg("average").over(whole)).withColumn("n", F.count("*").over(whole)).withColumn("sd", F.stddev_samp("average").over(whole))
    per = per.withColumn("sd", F.when(F.col("n") > 2, F.col("sd")).otherwise(F.col("mean") * 0.3)).where("n >= 2 AND sd > 0")
    per = per.withColumn("z", (F.col("average") - F.col("mean")) / F.col("sd")).withColumn("pct", F.when(F.col("mean") > 0, (F.col("average") - F.col("mean")) / F.col("mean")).otherwise(0.0))
    flagged = per.where((F.abs("z") > 1.5) | (F.abs("pct") > threshold))
    return flagged.select(key, period, "average", "mentions", "z", "pct", F.when(F.col("z") > 0, "spike").otherwise("drop").alias("direction"), F.when(F.abs("z") > 2, "high").otherwise("medium").alias("severity"))


def compare_growth(forecasts: DataFrame, key: str) -> DataFrame:
    """Keys that grow, by confidence; rank 1 is the surest."""
    growing = forecasts.where("direction = 'increasing'")
    return growing.withColumn("place", F.rank().over(Window.orderBy(F.desc("confidence"), key)).cast("long"))
