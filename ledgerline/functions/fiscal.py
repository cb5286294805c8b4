"""Fiscal calendars as column expressions; a period is a pair (fiscal_year INT, quarter INT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days by which a 52/53-week year may end in the month after its last.
DRIFT_DAYS = 7


def drifted(end: Column, fy_end_month: Column) -> Column:
    """The period's end, moved back into the year's last month if it drifted a few days beyond."""
    beyond = (F.month(end) == fy_end_month + 1) & (F.dayofmonth(end) <= DRIFT_DAYS)
    return F.when(beyond, F.date_sub(end, F.dayofmonth(end))).otherwise(F.to_date(end))


def fiscal_year(end: Column, fy_end_month: Column) -> Column:
    return F.year(end) + F.when(F.month(end) > fy_end_month, 1).otherwise(0)


def fiscal_quarter(end: Column, fy_end_month: Column) -> Column:
    return F.floor(F.pmod(F.month(end) - fy_end_month - 1, F.lit(12)) / 3).cast("int") + 1


def fiscal_label(end: Column, fy_end_month: Column) -> Column:
    """``FY2024 Q3``; null where the date or the calendar is null."""
    at = drifted(end, fy_end_month)
    return F.concat(F.lit("FY"), fiscal_year(at, fy_end_month).cast("string"), F.lit(" Q"), fiscal_quarter(at, fy_end_month).cast("string"))


def short_label(end: Column, fy_end_month: Column) -> Column:
    """``FY24``: no drift rule."""
    return F.concat(F.lit("FY"), F.lpad((fiscal_year(end, fy_end_month) % 100).cast("string"), 2, "0"))


def year_of_label(label: Column) -> Column:
    """4-digit year of ``2024``, ``FY2024`` or ``FY24``; null without one."""
    digits = F.regexp_extract(F.upper(F.trim(label)), r"^(?:FY)?\s*'?(\d{4}|\d{2})$", 1)
    return F.when(F.length(digits) == 4, digits.cast("int")).when(F.length(digits) == 2, digits.cast("int") + 2000)


def fiscal_sort_key(year: Column, quarter: Column) -> Column:
    """Year * 10 + quarter, with 0 for a part that is missing."""
    digit = F.regexp_extract(F.coalesce(quarter, F.lit("")), r"([1-4])", 1)
    return F.coalesce(year_of_label(year), F.lit(0)) * 10 + F.when(digit != "", digit.cast("int")).otherwise(0)


def quarter_back(as_of: Column, fy_end_month: Column, k: Column) -> tuple[Column, Column]:
    """(fiscal_year, quarter) of the k-th completed quarter before ``as_of``."""
    shifted = F.add_months(F.to_date(as_of), k * -3)
    return fiscal_year(shifted, fy_end_month), fiscal_quarter(shifted, fy_end_month)


def recent_periods(companies: DataFrame, n: int, as_of: str) -> DataFrame:
    """The n most recent completed quarters of each row of ``companies`` (company, fy_end_month)."""
    back = companies.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    year, quarter = quarter_back(F.lit(as_of), F.col("fy_end_month"), F.col("k"))
    return back.select("company", "k", year.alias("fiscal_year"), quarter.alias("quarter"))


def calendar_to_fiscal(companies: DataFrame, year: int) -> DataFrame:
    """Fiscal quarters of each company that overlap a calendar year."""
    grid = companies.withColumn("fiscal_year", F.explode(F.array(F.lit(year), F.lit(year + 1)))).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))
    first = F.make_date(F.col("fiscal_year") - 1, F.lit(1), F.lit(1))
    start = F.add_months(first, F.col("fy_end_month") + (F.col("quarter") - 1) * 3)
    grid = grid.withColumn("start_d", start).withColumn("end_d", F.date_sub(F.add_months("start_d", 3), 1))
    return grid.where((F.col("end_d") >= F.lit(f"{year}-01-01").cast("date")) & (F.col("start_d") <= F.lit(f"{year}-12-31").cast("date"))).select("company", "fiscal_year", "quarter", "start_d", "end_d")


def available_periods(chunks: DataFrame, n: int) -> DataFrame:
    """Newest n (fiscal_year, quarter) of each company."""
    by = Window.partitionBy("company").orderBy(F.desc("fiscal_year"), F.desc("quarter"))
    return chunks.select("company", "fiscal_year", "quarter").distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= n)


def mentioned_periods(text: Column) -> tuple[Column, Column, Column, Column]:
    """(fiscal years, quarters, number of periods, quarterly or annual) that a question names, in English or Chinese.

    ``FY23``, ``FY2024``; ``Q1 to Q3`` or a list of quarters; ``last three quarters``, ``past 4 years``; ``过去三年``, ``最近2个季度``.
    """
    years = F.transform(F.regexp_extract_all(text, F.lit(r"FY(\d{4}|\d{2})"), 1), lambda y: F.when(F.length(y) == 2, y.cast("int") + 2000).otherwise(y.cast("int")))
    span = r"Q([1-4])\s*(?:to|-|–)\s*Q([1-4])"
    lo, hi = (F.regexp_extract(text, span, i).try_cast("int") for i in (1, 2))
    listed = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\bQ([1-4])\b"), 1), lambda q: q.cast("int"))))
    quarters = F.when(lo.isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(listed)
    names = {w: n for n, ws in enumerate([("one", "一"), ("two", "二", "两"), ("three", "三"), ("four", "四"), ("five", "五"), ("six", "六")], 1) for w in ws}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    word = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(?:last|past)\s+(\w+)\s+(?:quarter|year)s?", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?:过去|最近)\s*([0-9一二两三四五六]+)\s*(?:个)?(?:季度|年)", 1), F.lit("")))
    n = F.coalesce(word.try_cast("int"), F.try_element_at(known, F.lower(word)))
    kind = F.when(text.rlike(r"(?i)quarter|\bQ[1-4]\b|季度"), "quarterly").when(text.rlike(r"(?i)years?\b|FY\d|年"), "annual")
    return years, quarters, n, kind


def recent_periods_of(companies: DataFrame, n: int) -> DataFrame:
    """``recent_periods`` before each row's own date (company, fy_end_month, as_of)."""
    back = companies.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    year, quarter = quarter_back(F.col("as_of"), F.col("fy_end_month"), F.col("k"))
    return back.select("company", "k", year.alias("fiscal_year"), quarter.alias("quarter"))


def years_to_fiscal(rows: DataFrame) -> DataFrame:
    """Fiscal quarters that overlap the calendar year of each row (company, year, fy_end_month)."""
    grid = rows.withColumn("fiscal_year", F.explode(F.array(F.col("year"), F.col("year") + 1))).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))
    start = F.add_months(F.make_date(F.col("fiscal_year") - 1, F.lit(1), F.lit(1)), F.col("fy_end_month") + (F.col("quarter") - 1) * 3)
    grid = grid.withColumn("start_d", start).withColumn("end_d", F.date_sub(F.add_months("start_d", 3), 1))
    return grid.where((F.year("end_d") >= F.col("year")) & (F.year("start_d") <= F.col("year"))).select("company", "year", "fiscal_year", "quarter", "start_d", "end_d")
