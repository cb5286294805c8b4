"""Roll-ups of several analyses by company: anomalies, trends, comparisons, briefs, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators import corpus as co
from ledgerline.operators import trends as tr


def yearly_measures(scored: DataFrame, words: list[str]) -> DataFrame:
    """(company, measure, fiscal_year, value) of chunks with ``score``: weighted mentions, weighted word counts, weighted mean score."""
    w = co.weight_of(F.col("filing_type"))
    per = scored.groupBy("company", "fiscal_year").agg(F.sum(w).alias("mentions"), F.sum(tx.keyword_count(F.col("content"), words) * w).alias("focus"), (F.sum(F.col("score") * w) / F.sum(w)).alias("sentiment"))
    return per.unpivot(["company", "fiscal_year"], ["mentions", "focus", "sentiment"], "measure", "value")


def company_trends(measures: DataFrame) -> DataFrame:
    """(company, measure, direction, forecast, confidence) of each yearly measure with two years or more."""
    keyed = measures.withColumn("k", F.struct("company", "measure"))
    ahead = tr.linear_forecast(keyed, "k", "fiscal_year", "value", 1).join(tr.trend_direction(keyed, "k", "fiscal_year", "value"), "k")
    return ahead.select("k.company", "k.measure", "direction", "forecast", "confidence")


def outlook(trends: DataFrame) -> DataFrame:
    """(company, outlook) by the votes of the measures: positive, cautious or neutral."""
    up, down = (F.count_if(F.col("direction") == d) for d in ("increasing", "decreasing"))
    return trends.groupBy("company").agg(F.when(up > down, "positive").when(down > up, "cautious").otherwise("neutral").alias("outlook"))


def anomaly_summary(amounts: DataFrame, shifts: DataFrame, focus: DataFrame) -> DataFrame:
    """(kind, company, n, latest) of all companies with anomalies of amounts, shifts of sentiment, or a last rise of focus."""
    last = focus.groupBy("company").agg(F.max_by("change", "to_year").alias("change"), F.count("*").alias("n"), F.max("to_year").alias("latest")).where("change > 0")
    a = amounts.groupBy("company").agg(F.count("*").alias("n"), F.max("period").alias("latest")).select(F.lit("amount").alias("kind"), "company", "n", "latest")
    b = shifts.groupBy("company").agg(F.count("*").alias("n"), F.max("to_year").alias("latest")).select(F.lit("sentiment").alias("kind"), "company", "n", "latest")
    return a.unionByName(b).unionByName(last.select(F.lit("focus").alias("kind"), "company", "n", "latest"))


def analytic_alerts(amounts: DataFrame, shifts: DataFrame, focus: DataFrame, high: float = 0.3) -> DataFrame:
    """(type, company, at, severity, message) of every anomaly, shift and last rise of focus."""
    pct = lambda c: F.format_string("%d", F.floor(F.abs(c) * 100 + 1e-9).cast("int"))
    spikes = amounts.select(F.when(F.col("direction") == "spike", "capex_spike").otherwise("capex_drop").alias("type"), "company", F.col("period").cast("int").alias("at"), "severity", F.concat(F.col("company"), F.lit(" shows "), pct(F.col("pct")), F.lit("% change from mean")).alias("message"))
    moods = shifts.select(F.when(F.col("change") > 0, "sentiment_positive").otherwise("sentiment_negative").alias("type"), "company", F.col("to_year").cast("int").alias("at"), F.when(F.abs("change") > high, "high").otherwise("medium").alias("severity"), F.concat(F.col("company"), F.lit(" sentiment shifted by "), pct(F.col("change")), F.lit("%")).alias("message"))
    last = focus.groupBy("company").agg(F.max_by("change", "to_year").alias("change"), F.max("to_year").cast("int").alias("at")).where("change > 0")
    surges = last.select(F.lit("ai_investment_surge").alias("type"), "company", "at", F.lit("medium").alias("severity"), F.concat(F.col("company"), F.lit(" shows increased focus")).alias("message"))
    return spikes.unionByName(moods).unionByName(surges)


def compare_latest(series: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Latest year and value of each company beside its breakdown."""
    latest = series.groupBy("company").agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))
    return latest.join(breakdown, "company", "left")


def dashboard(sentiment: DataFrame, mix: DataFrame, votes: DataFrame, sites: DataFrame) -> DataFrame:
    """A brief a company: sentiment and its label, focus, outlook, sites; missing parts have their defaults."""
    s = F.coalesce("sentiment", F.lit(0.0))
    rows = sentiment.join(mix, "company", "left").join(votes, "company", "left").join(sites, "company", "left")
    return rows.select("company", s.alias("sentiment"), F.when(s > 0.1, "positive").when(s < -0.1, "negative").otherwise("neutral").alias("label"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("focus", F.lit("balanced")).alias("focus"), F.coalesce("outlook", F.lit("neutral")).alias("outlook"), F.coalesce("sites", F.lit(0)).cast("long").alias("sites"))


def company_dynamics(companies: DataFrame, votes: DataFrame, headlines: DataFrame, metrics: DataFrame, n: int = 3) -> DataFrame:
    """(company, outlook, headlines, value, complete): outlook, the newest headlines and a supplied metric, each with its fallback."""
    by = Window.partitionBy("company").orderBy(F.desc("at"), "id")
    top = headlines.withColumn("i", F.row_number().over(by)).where(F.col("i") <= n).groupBy("company").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"]).alias("titles"))
    rows = companies.select("company").distinct().join(votes, "company", "left").join(top, "company", "left").join(metrics, "company", "left")
    return rows.select("company", F.coalesce("outlook", F.lit("unknown")).alias("outlook"), F.coalesce("titles", F.array(F.lit("no headline"))).alias("headlines"), F.coalesce("value", F.lit(0.0)).alias("value"), (F.col("outlook").isNotNull() & F.col("titles").isNotNull() & F.col("value").isNotNull()).alias("complete"))


def reconcile_guidance(actual: DataFrame, guided: DataFrame) -> DataFrame:
    """(company, actual, forecast, growth_pct): forecasts that do not exceed the prior actual are discarded; growth only where both stand."""
    both = guided.join(actual, "company", "left")
    forecast = F.when(F.col("forecast").isNull() | (F.col("actual").isNotNull() & (F.col("forecast") <= F.col("actual"))), None).otherwise(F.col("forecast"))
    rows = both.select("company", "actual", forecast.alias("forecast"))
    return rows.withColumn("growth_pct", F.when((F.col("actual") > 0) & F.col("forecast").isNotNull(), (F.col("forecast") - F.col("actual")) / F.col("actual") * 100))


def guidance_totals(rows: DataFrame) -> DataFrame:
    """Total forecast, mean growth and the fastest grower of reconciled rows."""
    return rows.agg(F.sum("forecast").alias("total"), F.avg("growth_pct").alias("mean_growth"), F.max_by("company", "growth_pct").alias("fastest"))


def category(text: Column, lists: list[tuple[str, list[str]]], default: str) -> Column:
    """The first list with a word (in any case) in the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for name, words in reversed(lists):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, name).otherwise(out)
    return out
