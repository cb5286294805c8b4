"""Batches of questions answered from metric series: mentions, intents, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fiscal as fi
from ledgerline.operators.patterns import occurrences


def resolve_metric(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, metric): the longest alias (alias, metric) that a question has as whole words; among equals the first by ``place``, if the vocabulary has one, then by name."""
    place = F.col("place") if "place" in vocabulary.columns else F.lit(0)
    named = vocabulary.select(F.lower("alias").alias("pattern"), "metric", place.alias("place"))
    asked = questions.select("query_id", F.lower("question").alias("low"))
    found = occurrences(asked, ["query_id"], "low", named.select("pattern")).select("query_id", "pattern").distinct().join(named, "pattern")
    by = Window.partitionBy("query_id").orderBy(F.desc(F.length("pattern")), "place", "pattern")
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("query_id", "metric")


def resolve_companies(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, company) for every company (company, name) whose name is a word of the question."""
    words = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("question"), F.lit(r"[A-Z0-9_]+"), 0))).alias("name"))
    return words.join(registry.select("company", F.upper("name").alias("name")), "name").select("query_id", "company").distinct()


def financial_intents(questions: DataFrame, vocabulary: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, company, metric) of questions that ask for numbers: no summary or outlook."""
    asked = questions.where(~F.lower("question").rlike("summar|outlook|explain|why"))
    return resolve_metric(asked, vocabulary).join(resolve_companies(asked, registry), "query_id").select("query_id", "company", "metric")


def answer_metrics(intents: DataFrame, metrics: DataFrame) -> DataFrame:
    """Latest value of every (company, metric) that a question asks for; null where there is none."""
    latest = metrics.groupBy(F.col("entity").alias("company"), "metric").agg(F.max("end_d").alias("end_d"), F.max_by("value", "end_d").alias("value"))
    return intents.join(latest, ["company", "metric"], "left")


def intents_with_periods(questions: DataFrame, vocabulary: DataFrame, registry: DataFrame, periods: int = 4) -> DataFrame:
    """(query_id, company, metric, period_type, periods) of questions that ask for numbers.

    Breakdowns and narratives are left out; without a period a question asks for the last four years.
    """
    asked = questions.where(~F.lower("question").rlike("breakdown|by segment|summar|outlook|explain|why"))
    _, _, n, kind = fi.mentioned_periods(F.col("question"))
    named = asked.select("query_id", F.coalesce(kind, F.lit("annual")).alias("period_type"), F.coalesce(n, F.lit(periods)).alias("periods"))
    return resolve_metric(asked, vocabulary).join(resolve_companies(asked, registry), "query_id").join(named, "query_id").select("query_id", "company", "metric", "period_type", "periods")


def split_comparisons(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, company, part): a question for every name (name) of the registry that a comparison holds, each of its names replaced by that one."""
    asked = questions.where(F.lower("question").rlike(r"compare|\bvs\b"))
    words = asked.select("query_id", "question", F.array_distinct(F.split("question", r"[^A-Za-z0-9_]+")).alias("ws"))
    named = words.select("query_id", "question", F.explode("ws").alias("name")).join(registry.select("name").distinct(), "name")
    every = named.groupBy("query_id", "question").agg(F.collect_list("name").alias("names")).select("query_id", "question", "names", F.explode("names").alias("company"))
    swapped = F.regexp_replace("question", F.concat(F.lit(r"\b(?:"), F.array_join("names", "|"), F.lit(r")\b")), F.col("company"))
    return every.select("query_id", "company", F.concat(F.lit("What about "), "company", F.lit(": "), swapped).alias("part"))
