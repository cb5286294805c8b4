"""From tagged facts to statements: durations, de-cumulation, coalescing, derived lines.

Facts are long rows: entity, concept, start_d, end_d, val, form. Windows are partitioned by
entity and concept, so work spreads over companies and never over one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMS = ["10-Q", "10-K"]


def facts_from_map(facts: DataFrame) -> DataFrame:
    """Flatten ``facts`` (entity, concepts MAP<concept, MAP<unit, ARRAY<STRUCT<start, end, val, form>>>>).

    USD rows are taken, per-share ones where a concept has no USD; other forms and null values go.
    """
    by_concept = facts.select("entity", F.explode("concepts").alias("concept", "units"))
    rows = by_concept.select("entity", "concept", F.posexplode(F.coalesce(F.try_element_at("units", F.lit("USD")), F.try_element_at("units", F.lit("USD/shares")))).alias("ordinal", "fact"))
    rows = rows.select("entity", "concept", "ordinal", F.to_date("fact.start").alias("start_d"), F.to_date("fact.end").alias("end_d"), F.col("fact.val").alias("val"), F.col("fact.form").alias("form"))
    return rows.where(F.col("val").isNotNull() & F.col("form").isin(FORMS))


def duration_class(start: Column, end: Column, form: Column) -> Column:
    """instant, annual (10-K only), quarter, cumulative, or null."""
    days = F.datediff(end, start)
    return (
        F.when(start.isNull(), "instant")
        .when(days.between(340, 380) & (form == "10-K"), "annual")
        .when(days.between(60, 105), "quarter")
        .when(days.between(106, 380), "cumulative")
    )


def classify_duration(facts: DataFrame) -> DataFrame:
    return facts.withColumn("days", F.datediff("end_d", "start_d")).withColumn("duration", duration_class(F.col("start_d"), F.col("end_d"), F.col("form")))


def decumulate(facts: DataFrame) -> DataFrame:
    """Single-quarter values: each value less the one before it from the same start, if 30 days or more lie between."""
    rows = classify_duration(facts).where("start_d IS NOT NULL AND days BETWEEN 60 AND 380")
    by = Window.partitionBy("entity", "concept", "start_d").orderBy("days", "end_d")
    rows = rows.withColumn("single", F.col("val") - F.lag("val", 1, 0.0).over(by)).withColumn("gap", F.col("days") - F.lag("days", 1, 0).over(by))
    return rows.where("gap >= 30").select("entity", "concept", "start_d", "end_d", "single")


def dedup_quarters(quarters: DataFrame) -> DataFrame:
    """One value a calendar quarter: the latest end wins, then the earlier start."""
    by = Window.partitionBy("entity", "concept", F.year("end_d"), F.quarter("end_d")).orderBy(F.desc("end_d"), "start_d")
    return quarters.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def dedup_annual(facts: DataFrame) -> DataFrame:
    """One annual value for each end date: the last by ``ordinal``."""
    by = Window.partitionBy("entity", "concept", "end_d").orderBy(F.desc("ordinal"))
    return classify_duration(facts).where("duration = 'annual'").withColumn("n", F.row_number().over(by)).where("n = 1").select("entity", "concept", "end_d", "val")


def coalesce_concepts(series: DataFrame, concept_map: DataFrame, value: str = "single") -> DataFrame:
    """Metric values: of the concepts that ``concept_map`` (concept, metric, priority) gives a metric, the first that has the period."""
    return series.join(F.broadcast(concept_map), "concept").groupBy("entity", "metric", "end_d").agg(F.min_by(value, "priority").alias("value"))


def force_sign(value: Column, metric: Column, outflows: list[str]) -> Column:
    """Outflows are negative whatever sign they were filed with."""
    return F.when(metric.isin(outflows), -F.abs(value)).otherwise(value)


def build_snapshots(metrics: DataFrame) -> DataFrame:
    """A row for each entity and period end with its metrics as a map, in the order of their names."""
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return metrics.groupBy("entity", "end_d").agg(F.map_from_entries(entries).alias("payload"))


def derive_sum(metrics: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """``metrics`` and ``name`` = a + b where a period has both (free cash flow of operating cash flow and CapEx)."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    both = metrics.where(F.col("metric").isin(a, b)).groupBy("entity", "end_d").agg(pick(a).alias("x"), pick(b).alias("y"))
    return metrics.unionByName(both.where("x IS NOT NULL AND y IS NOT NULL").select("entity", F.lit(name).alias("metric"), "end_d", (F.col("x") + F.col("y")).alias("value")))


def unpivot_statement(wide: DataFrame, ids: list[str], items: list[str]) -> DataFrame:
    return wide.unpivot(ids, items, "metric", "value").where("value IS NOT NULL")


def fallback_source(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All primary rows, and secondary rows of keys that the primary source lacks."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti").select(primary.columns))
