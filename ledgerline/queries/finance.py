"""Fiscal periods, facts, statements, metric series and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import fiscal as fi
from ledgerline.operators import metrics as me
from ledgerline.operators import trends as tr
from ledgerline.operators import xbrl as xb
from ledgerline.queries.base import query

_MAP = [("Revenues", "revenue", 1), ("SalesRevenueNet", "revenue", 2)]
_ORDERS = "SELECT o.o_orderkey, c.c_mktsegment AS company, CAST(o.o_orderdate AS DATE) AS end_d, k.fy_end_month FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN calendar k ON k.company = c.c_mktsegment"
_FY = "(year(d) + CASE WHEN month(d) > m THEN 1 ELSE 0 END)"
_FQ = "(((month(d) - m - 1 + 12) % 12) // 3 + 1)"


def _dated(t):
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", F.col("c_mktsegment").alias("company"), F.to_date("o_orderdate").alias("end_d")).join(F.broadcast(t("calendar")), "company")


@query("fis_01_fiscal_label", f"o AS ({_ORDERS}), a AS (SELECT o_orderkey, fy_end_month AS m, CASE WHEN month(end_d) = fy_end_month + 1 AND day(end_d) <= 7 THEN end_d - CAST(day(end_d) AS INT) ELSE end_d END AS d FROM o) SELECT o_orderkey, 'FY' || {_FY} || ' Q' || {_FQ} AS label FROM a", ("calendar",))
def fis_01(t):
    return _dated(t).select("o_orderkey", fi.fiscal_label(F.col("end_d"), F.col("fy_end_month")).alias("label"))


@query("fis_02_infer_fiscal_period", f"o AS (SELECT o_orderkey, end_d AS d, fy_end_month AS m FROM ({_ORDERS})) SELECT o_orderkey, 'FY' || right(CAST({_FY} AS VARCHAR), 2) AS fy, 'Q' || {_FQ} AS q FROM o", ("calendar",))
def fis_02(t):
    end, month = F.col("end_d"), F.col("fy_end_month")
    return _dated(t).select("o_orderkey", fi.short_label(end, month).alias("fy"), F.concat(F.lit("Q"), fi.fiscal_quarter(end, month).cast("string")).alias("q"))


@query("fis_03_fiscal_from_filename", "f AS (SELECT o_orderkey, 'report_FY' || (year(o_orderdate) % 100) || '_Q' || quarter(o_orderdate) || '.htm' AS name FROM orders) SELECT o_orderkey, CAST(regexp_extract(name, 'FY(\\d{1,4})', 1) AS INT) % 100 + CASE WHEN CAST(regexp_extract(name, 'FY(\\d{1,4})', 1) AS INT) % 100 > 50 THEN 1900 ELSE 2000 END AS fiscal_year, CAST(regexp_extract(name, 'Q([1-4])', 1) AS INT) AS quarter FROM f")
def fis_03(t):
    name = F.concat(F.lit("report_FY"), (F.year("o_orderdate") % 100).cast("string"), F.lit("_Q"), F.quarter("o_orderdate").cast("string"), F.lit(".htm"))
    two = F.regexp_extract("name", r"FY(\d{1,4})", 1).cast("int") % 100
    return t("orders").withColumn("name", name).select("o_orderkey", (two + F.when(two > 50, 1900).otherwise(2000)).alias("fiscal_year"), F.regexp_extract("name", r"Q([1-4])", 1).cast("int").alias("quarter"))


_RECENT = f"k AS (SELECT company, fy_end_month AS m, n AS k, DATE '2024-01-31' - to_months(CAST(3 * n AS INT)) AS d FROM calendar, range(1, {{top}}) r(n)) SELECT company, CAST(k AS INT) AS k, {_FY} AS fiscal_year, {_FQ} AS quarter FROM k"


@query("fis_04_recent_periods", _RECENT.format(top=9), ("calendar",))
def fis_04(t):
    return fi.recent_periods(t("calendar"), 8, "2024-01-31")


@query("fis_05_quarters_ago", _RECENT.format(top=5) + " WHERE k = 4", ("calendar",))
def fis_05(t):
    return fi.recent_periods(t("calendar"), 4, "2024-01-31").where("k = 4")


@query("fis_06_calendar_to_fiscal", "g AS (SELECT company, fy_end_month, y AS fiscal_year, q AS quarter FROM calendar, range(2024, 2026) a(y), range(1, 5) b(q)), s AS (SELECT *, CAST(make_date(fiscal_year - 1, 1, 1) + to_months(CAST(fy_end_month + (quarter - 1) * 3 AS INT)) AS DATE) AS start_d FROM g), e AS (SELECT *, CAST(start_d + to_months(3) AS DATE) - 1 AS end_d FROM s) SELECT company, CAST(fiscal_year AS INT) AS fiscal_year, CAST(quarter AS INT) AS quarter, start_d, end_d FROM e WHERE end_d >= DATE '2024-01-01' AND start_d <= DATE '2024-12-31'", ("calendar",))
def fis_06(t):
    return fi.calendar_to_fiscal(t("calendar"), 2024)


@query("fis_07_fiscal_year_matches", "SELECT count(*) AS n FROM chunks WHERE fiscal_year = 2023", ("chunks",))
def fis_07(t):
    label = F.concat(F.element_at(F.array(F.lit("FY"), F.lit(""), F.lit("FY20")), (F.col("chunk_id") % 3 + 1).cast("int")), F.when(F.col("chunk_id") % 3 == 1, F.col("fiscal_year")).otherwise(F.col("fiscal_year") % 100).cast("string"))
    return t("chunks").where(fi.year_of_label(label) == 2023).agg(F.count("*").alias("n"))


@query("fis_08_extract_periods", "SELECT query_id, nullif(regexp_extract(question, 'FY(\\d{2,4})', 1), '') AS fy, CASE WHEN question LIKE '%Q1 to Q3%' THEN [1, 2, 3] END AS quarters, CASE WHEN question LIKE '%last three quarters%' THEN 3 WHEN question LIKE '%past 4 years%' THEN 4 END AS periods, CASE WHEN question LIKE '%quarters%' OR question LIKE '%Q1%' THEN 'quarterly' WHEN question LIKE '%years%' OR question LIKE '%FY23%' THEN 'annual' END AS period_type FROM questions", ("questions",))
def fis_08(t):
    q = F.col("question")
    words = F.create_map(*[F.lit(x) for w, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4)) for x in (w, n)])
    count = F.regexp_extract(q, r"(?i)(?:last|past)\s+(\w+)\s+(?:quarter|year)s?", 1)
    lo, hi = (F.regexp_extract(q, r"Q([1-4])\s*(?:to|-)\s*Q([1-4])", i).try_cast("int") for i in (1, 2))
    quarterly = q.rlike(r"(?i)quarter|\bQ[1-4]\b")
    return t("questions").select(
        "query_id", F.nullif(F.regexp_extract(q, r"FY(\d{2,4})", 1), F.lit("")).alias("fy"), F.when(lo.isNotNull(), F.sequence(lo, hi)).alias("quarters"),
        F.coalesce(count.try_cast("int"), F.try_element_at(words, F.lower(count))).alias("periods"), F.when(quarterly, "quarterly").when(q.rlike(r"(?i)years|FY\d"), "annual").alias("period_type"),
    )


@query("fis_09_fiscal_sort_key", "SELECT chunk_id, fiscal_year * 10 + quarter AS k FROM chunks", ("chunks",))
def fis_09(t):
    return t("chunks").select("chunk_id", fi.fiscal_sort_key(F.col("fiscal_year").cast("string"), F.concat(F.lit("Q"), F.col("quarter").cast("string"))).alias("k"))


@query("fis_10_latest_completed_quarter", _RECENT.format(top=2), ("calendar",))
def fis_10(t):
    return fi.recent_periods(t("calendar"), 1, "2024-01-31")


@query("fis_11_available_periods", "p AS (SELECT DISTINCT company, fiscal_year, quarter FROM chunks WHERE filing_type = 'Earnings Transcript') SELECT company, fiscal_year, quarter, row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC, quarter DESC) AS n FROM p QUALIFY n <= 4", ("chunks",))
def fis_11(t):
    return fi.available_periods(t("chunks").where("filing_type = 'Earnings Transcript'"), 4)


@query("xbr_01_facts_long", "SELECT entity, concept, start_d, end_d, round(val, 2) AS val, form FROM facts", ("facts",))
def xbr_01(t):
    facts = t("facts")
    fact = F.struct(F.col("start_d").cast("string").alias("start"), F.col("end_d").cast("string").alias("end"), "val", "form")
    nested = facts.groupBy("entity", "concept").agg(F.sort_array(F.collect_list(fact)).alias("rows")).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.create_map(F.lit("USD"), F.col("rows"))))).alias("concepts"))
    return xb.facts_from_map(nested).select("entity", "concept", "start_d", "end_d", F.round("val", 2).alias("val"), "form")


_CLASS = "CASE WHEN start_d IS NULL THEN 'instant' WHEN end_d - start_d BETWEEN 340 AND 380 AND form = '10-K' THEN 'annual' WHEN end_d - start_d BETWEEN 60 AND 105 THEN 'quarter' WHEN end_d - start_d BETWEEN 106 AND 380 THEN 'cumulative' END"


@query("xbr_02_classify_duration", f"SELECT entity, concept, end_d, end_d - start_d AS days, {_CLASS} AS duration FROM facts", ("facts",))
def xbr_02(t):
    return xb.classify_duration(t("facts")).select("entity", "concept", "end_d", F.col("days").cast("long").alias("days"), "duration")


_DECUM = "dc AS (SELECT entity, concept, start_d, end_d, val - lag(val, 1, 0) OVER w AS single, (end_d - start_d) - lag(end_d - start_d, 1, 0) OVER w AS gap FROM facts WHERE end_d - start_d BETWEEN 60 AND 380 WINDOW w AS (PARTITION BY entity, concept, start_d ORDER BY end_d - start_d))"


@query("xbr_03_decumulate", f"{_DECUM} SELECT entity, concept, start_d, end_d, round(single, 2) AS single FROM dc WHERE gap >= 30", ("facts",))
def xbr_03(t):
    return xb.decumulate(t("facts")).withColumn("single", F.round("single", 2))


@query("xbr_04_dedup_quarters", f"{_DECUM} SELECT entity, concept, end_d, round(single, 2) AS single FROM dc WHERE gap >= 30 QUALIFY row_number() OVER (PARTITION BY entity, concept, year(end_d), quarter(end_d) ORDER BY end_d DESC, start_d) = 1", ("facts",))
def xbr_04(t):
    return xb.dedup_quarters(xb.decumulate(t("facts"))).select("entity", "concept", "end_d", F.round("single", 2).alias("single"))


@query("xbr_05_dedup_annual", "SELECT entity, concept, end_d, round(val, 2) AS val FROM facts WHERE form = '10-K' AND end_d - start_d BETWEEN 340 AND 380", ("facts",))
def xbr_05(t):
    facts = t("facts")
    twice = facts.withColumn("val", F.col("val") * 0).withColumn("ordinal", F.lit(0)).unionByName(facts.withColumn("ordinal", F.lit(1)))
    return xb.dedup_annual(twice).withColumn("val", F.round("val", 2))


def _revenue(t):
    single = xb.dedup_quarters(xb.decumulate(t("facts")))
    return xb.coalesce_concepts(single, single.sparkSession.createDataFrame(_MAP, "concept string, metric string, priority int"))


_REV = f"{_DECUM}, rev AS (SELECT entity, 'revenue' AS metric, end_d, single AS value FROM dc WHERE gap >= 30)"


@query("xbr_06_coalesce_concepts", f"{_REV} SELECT entity, metric, end_d, round(value, 2) AS value FROM rev", ("facts",))
def xbr_06(t):
    return _revenue(t).withColumn("value", F.round("value", 2))


@query("xbr_07_force_sign", "SELECT entity, metric, end_d, round(CASE WHEN metric = 'capex' THEN -abs(value) ELSE value END, 2) AS value FROM metric_values", ("metric_values",))
def xbr_07(t):
    return t("metric_values").select("entity", "metric", "end_d", F.round(xb.force_sign(F.col("value"), F.col("metric"), ["capex"]), 2).alias("value"))


@query("xbr_08_build_snapshots", "SELECT entity, end_d, count(*) AS n_metrics, round(sum(value), 2) AS total FROM metric_values GROUP BY entity, end_d", ("metric_values",))
def xbr_08(t):
    shots = xb.build_snapshots(t("metric_values"))
    return shots.select("entity", "end_d", F.size("payload").cast("long").alias("n_metrics"), F.round(F.aggregate(F.map_values("payload"), F.lit(0.0), lambda a, b: a + b), 2).alias("total"))


@query("xbr_09_derive_free_cash_flow", "p AS (SELECT entity, end_d, max(CASE WHEN metric = 'revenue' THEN value END) AS x, max(CASE WHEN metric = 'capex' THEN -value END) AS y FROM metric_values GROUP BY entity, end_d) SELECT entity, end_d, round(x + y, 2) AS value FROM p WHERE x IS NOT NULL AND y IS NOT NULL", ("metric_values",))
def xbr_09(t):
    rows = t("metric_values").select("entity", "metric", "end_d", xb.force_sign(F.col("value"), F.col("metric"), ["capex"]).alias("value"))
    return xb.derive_sum(rows, "free_cash_flow", "revenue", "capex").where("metric = 'free_cash_flow'").select("entity", "end_d", F.round("value", 2).alias("value"))


@query("xbr_10_unpivot_statement", "SELECT l_orderkey, l_linenumber, 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def xbr_10(t):
    wide = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS quantity", "l_extendedprice AS price", "l_tax AS tax")
    return xb.unpivot_statement(wide, ["l_orderkey", "l_linenumber"], ["quantity", "price", "tax"])


@query("xbr_11_fallback_source", "a AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)")
def xbr_11(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return xb.fallback_source(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), orders.where("o_orderstatus = 'O'").drop("o_orderstatus"), "o_custkey")


@query("met_01_snapshot", "SELECT entity, metric, max(end_d) AS end_d, round(max_by(value, end_d), 2) AS value FROM metric_values GROUP BY entity, metric", ("metric_values",))
def met_01(t):
    return me.snapshot(t("metric_values")).withColumn("value", F.round("value", 2))


@query("met_02_metric_series", "SELECT entity, metric, end_d, round(value, 2) AS value, row_number() OVER (PARTITION BY entity ORDER BY end_d DESC) AS n FROM metric_values WHERE metric = 'revenue' QUALIFY n <= 8", ("metric_values",))
def met_02(t):
    return me.metric_series(t("metric_values"), "revenue", 8, ["income", "balance", "cashflow"]).select("entity", "metric", "end_d", F.round("value", 2).alias("value"), F.col("n").cast("long").alias("n"))


def _labelled(t):
    at, month = F.col("end_d"), F.col("fy_end_month")
    rows = t("metric_values").join(F.broadcast(t("calendar").withColumnRenamed("company", "entity")), "entity")
    return rows.withColumn("fiscal_year", fi.fiscal_year(at, month)).withColumn("quarter", fi.fiscal_quarter(at, month))


_LAB = f"lab AS (SELECT entity, metric, end_d, value, {_FY.replace('(d)', '(end_d)').replace('> m', '> fy_end_month')} AS fiscal_year, (((month(end_d) - fy_end_month - 1 + 12) % 12) // 3 + 1) AS quarter FROM metric_values v JOIN calendar k ON v.entity = k.company)"


@query("met_03_filter_periods", f"{_LAB} SELECT entity, metric, end_d, round(value, 2) AS value FROM lab WHERE fiscal_year = 1997 OR (fiscal_year = 1998 AND quarter = 2)", ("metric_values", "calendar"))
def met_03(t):
    rows = _labelled(t)
    want = rows.sparkSession.createDataFrame([(1997, None), (1998, 2)], "fiscal_year int, quarter int")
    return me.filter_periods(rows, want).select("entity", "metric", "end_d", F.round("value", 2).alias("value"))


@query("met_04_period_gaps", f"{_LAB}, req AS (SELECT company AS entity, CAST(y AS INT) AS fiscal_year, CAST(q AS INT) AS quarter FROM calendar, range(1994, 2004) a(y), range(1, 5) b(q)), s AS (SELECT entity, min(end_d) AS first_d, max(end_d) AS last_d FROM lab WHERE metric = 'revenue' GROUP BY entity) SELECT r.*, s.first_d, s.last_d FROM req r LEFT JOIN s USING (entity) WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.metric = 'revenue' AND l.entity = r.entity AND l.fiscal_year = r.fiscal_year AND l.quarter = r.quarter)", ("metric_values", "calendar"))
def met_04(t):
    years = t("calendar").select(F.col("company").alias("entity"), F.explode(F.sequence(F.lit(1994), F.lit(2003))).alias("fiscal_year"))
    return me.period_gaps(years.withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4)))), _labelled(t).where("metric = 'revenue'"))


@query("met_05_ratio_latest", "p AS (SELECT entity, end_d, max(CASE WHEN metric = 'capex' THEN value END) AS x, max(CASE WHEN metric = 'revenue' THEN value END) AS y FROM metric_values GROUP BY entity, end_d) SELECT entity, end_d, round(abs(x) / y, 6) AS ratio FROM p WHERE x IS NOT NULL AND y <> 0 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY end_d DESC) = 1", ("metric_values",))
def met_05(t):
    return me.ratio_latest(t("metric_values"), "capex", "revenue").withColumn("ratio", F.round("ratio", 6))


@query("met_06_scaled_value", "SELECT entity, metric, end_d, CASE WHEN abs(value) >= 1e9 THEN value / 1e9 WHEN abs(value) >= 1e6 THEN value / 1e6 WHEN abs(value) >= 1e3 THEN value / 1e3 ELSE value END AS number, CASE WHEN abs(value) >= 1e9 THEN 'B' WHEN abs(value) >= 1e6 THEN 'M' WHEN abs(value) >= 1e3 THEN 'K' ELSE '' END AS unit FROM metric_values", ("metric_values",))
def met_06(t):
    number, unit = me.scaled(F.col("value"))
    return t("metric_values").select("entity", "metric", "end_d", number.alias("number"), unit.alias("unit"))


@query("met_07_pivot_metric", "SELECT * FROM (PIVOT (SELECT entity, 'y' || year AS y, round(value, 2) AS value FROM yearly) ON y USING max(value) GROUP BY entity)", ("yearly",))
def met_07(t):
    wide = me.pivot_metric(t("yearly"), "entity", "year", "value")
    return wide.select("entity", *[F.round(c, 2).alias(f"y{c}") for c in wide.columns[1:]])


@query("met_08_series_table", "SELECT entity, year, round(value, 2) AS value, 'FY' || year AS label FROM yearly", ("yearly",))
def met_08(t):
    return t("yearly").select("entity", "year", F.round("value", 2).alias("value"), F.concat(F.lit("FY"), F.col("year").cast("string")).alias("label"))


@query("met_09_income_summary", "g AS (SELECT entity, CAST(year(end_d) AS INT) AS year, sum(CASE WHEN metric = 'revenue' THEN value END) AS r, sum(CASE WHEN metric = 'operating_income' THEN value END) AS o FROM metric_values GROUP BY ALL) SELECT entity, year, round(r / 1e6, 4) AS revenue, round(o / 1e6, 4) AS operating_income, round(CASE WHEN r <> 0 THEN o / r * 100 END, 4) AS margin_pct FROM g", ("metric_values",))
def met_09(t):
    return me.income_summary(t("metric_values"), 1e6).select("entity", "year", *[F.round(c, 4).alias(c) for c in ("revenue", "operating_income", "margin_pct")])


@query("met_10_capex_by_year", "SELECT entity, end_d, round(abs(coalesce(max(CASE WHEN metric = 'capex' THEN value END), max(CASE WHEN metric = 'operating_income' THEN value END))), 2) AS value FROM metric_values WHERE metric IN ('capex', 'operating_income') GROUP BY entity, end_d", ("metric_values",))
def met_10(t):
    return me.first_available(t("metric_values"), ["capex", "operating_income"], ["entity", "end_d"]).withColumn("value", F.round("value", 2))


_SLOPE = "ix AS (SELECT entity, year, value, row_number() OVER (PARTITION BY entity ORDER BY year) - 1 AS i FROM yearly), fit AS (SELECT entity, regr_slope(value, i) AS s, regr_intercept(value, i) AS c, avg(value) AS m, count(*) AS n FROM ix GROUP BY entity)"
_DIR = "CASE WHEN s / abs(m) > 0.05 THEN 'increasing' WHEN s / abs(m) < -0.05 THEN 'decreasing' ELSE 'stable' END"


@query("ana_09_trend_direction", f"{_SLOPE} SELECT entity, n, round(s, 2) AS slope, {_DIR} AS direction FROM fit", ("yearly",))
def ana_09(t):
    return tr.trend_direction(t("yearly"), "entity", "year", "value").withColumn("slope", F.round("slope", 2))


_FORECAST = f"{_SLOPE}, res AS (SELECT entity, stddev_samp(value - c - s * i) AS r FROM ix JOIN fit USING (entity) GROUP BY entity), fc AS (SELECT f.entity, CAST(k AS INT) AS step, c + s * (n - 1 + k) AS forecast, greatest(0, least(100, 100 - r / greatest(abs(m), 1) * 100)) AS confidence, {_DIR} AS direction FROM fit f JOIN res USING (entity), range(1, 4) t(k))"


@query("ana_10_linear_forecast", f"{_FORECAST} SELECT entity, step, round(forecast, 2) AS forecast, round(confidence, 4) AS confidence FROM fc", ("yearly",))
def ana_10(t):
    return tr.linear_forecast(t("yearly"), "entity", "year", "value", 3).select("entity", "step", F.round("forecast", 2).alias("forecast"), F.round("confidence", 4).alias("confidence"))


@query("ana_12_compare_trends", f"{_FORECAST} SELECT entity, round(confidence, 4) AS confidence, rank() OVER (ORDER BY confidence DESC, entity) AS place FROM fc WHERE step = 1 AND direction <> 'increasing'", ("yearly",))
def ana_12(t):
    ahead = tr.linear_forecast(t("yearly"), "entity", "year", "value", 1).join(tr.trend_direction(t("yearly"), "entity", "year", "value"), "entity")
    turned = ahead.withColumn("direction", F.when(F.col("direction") == "increasing", "other").otherwise("increasing"))
    return tr.compare_growth(turned, "entity").select("entity", F.round("confidence", 4).alias("confidence"), "place")


@query("ana_14_latest_vs_history", "h AS (SELECT entity, year, value, avg(value) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM yearly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY year DESC) = 1) SELECT entity, year, round(value, 2) AS value, round(history, 2) AS history, round((value - history) / abs(history), 6) AS change, CASE WHEN abs((value - history) / abs(history)) >= 0.5 THEN 'high' WHEN abs((value - history) / abs(history)) >= 0.2 THEN 'medium' ELSE 'none' END AS severity FROM h WHERE history <> 0", ("yearly",))
def ana_14(t):
    out = tr.latest_vs_history(t("yearly"), "entity", "year", "value")
    return out.select("entity", "year", F.round("value", 2).alias("value"), F.round("history", 2).alias("history"), F.round("change", 6).alias("change"), "severity")


@query("ana_25_yoy_growth", "SELECT entity, year, round(value, 2) AS value, round(lag(value) OVER (PARTITION BY entity ORDER BY year), 2) AS previous, round((value - lag(value) OVER (PARTITION BY entity ORDER BY year)) / abs(lag(value) OVER (PARTITION BY entity ORDER BY year)), 6) AS growth FROM yearly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY year DESC) = 1", ("yearly",))
def ana_25(t):
    return tr.yoy_growth(t("yearly"), "entity", "year", "value").select("entity", "year", F.round("value", 2).alias("value"), F.round("previous", 2).alias("previous"), F.round("growth", 6).alias("growth"))


@query("ana_04_amount_anomalies", "a AS (SELECT l_suppkey % 25 AS key, year(l_shipdate) * 10 + quarter(l_shipdate) AS period, avg(l_extendedprice) AS average, count(*) AS mentions FROM lineitem GROUP BY ALL), w AS (SELECT *, avg(average) OVER p AS mean, count(*) OVER p AS n, stddev_samp(average) OVER p AS sd0 FROM a WINDOW p AS (PARTITION BY key)), x AS (SELECT *, CASE WHEN n > 2 THEN sd0 ELSE mean * 0.3 END AS sd FROM w), z AS (SELECT *, (average - mean) / sd AS z, (average - mean) / mean AS pct FROM x WHERE n >= 2 AND sd > 0) SELECT key, CAST(period AS INT) AS period, round(average, 2) AS average, mentions, round(z, 4) AS z, round(pct, 4) AS pct, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS direction, CASE WHEN abs(z) > 2 THEN 'high' ELSE 'medium' END AS severity FROM z WHERE abs(z) > 1.5 OR abs(pct) > 0.2")
def ana_04(t):
    rows = t("lineitem").select((F.col("l_suppkey") % 25).alias("key"), (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("period"), "l_extendedprice")
    out = tr.amount_anomalies(rows, "key", "period", "l_extendedprice")
    return out.select("key", "period", F.round("average", 2).alias("average"), "mentions", F.round("z", 4).alias("z"), F.round("pct", 4).alias("pct"), "direction", "severity")


@query("flagship_revenue_forecast", f"{_REV}, rx AS (SELECT entity, end_d, value, row_number() OVER (PARTITION BY entity ORDER BY end_d) - 1 AS i FROM rev), f AS (SELECT entity, regr_slope(value, i) AS s, regr_intercept(value, i) AS c, count(*) AS n FROM rx GROUP BY entity) SELECT rx.entity, rx.end_d, round(rx.value, 2) AS revenue, round(f.c + f.s * f.n, 2) AS next_forecast FROM rx JOIN f USING (entity)", ("facts",))
def flagship(t):
    """Quarterly revenue of each entity with a forecast of the next period."""
    revenue = _revenue(t).select("entity", "end_d", "value")
    ahead = tr.linear_forecast(revenue, "entity", "end_d", "value", 1)
    return revenue.join(ahead, "entity").select("entity", "end_d", F.round("value", 2).alias("revenue"), F.round("forecast", 2).alias("next_forecast"))
