"""Questions over metrics, and the remaining scores, tags and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import metric_names as mn
from ledgerline.functions import text as tx
from ledgerline.operators import corpus as co
from ledgerline.operators import news as nw
from ledgerline.plans import answers as an
from ledgerline.queries.base import query

_VOCABULARY = [(alias, metric, place) for alias, metric, _, _, place in mn.vocabulary()]
#: Every spelling of every metric, and the longest that a question holds as whole words.
VOCABULARY_SQL = "vo(alias, metric, place) AS (VALUES " + ", ".join("('{}', '{}', {})".format(a.replace("'", "''"), m, p) for a, m, p in _VOCABULARY) + ")"
METRIC_SQL = "rm AS (SELECT query_id, metric FROM {} JOIN vo ON regexp_matches(lower(question), '\\b' || regexp_escape(alias) || '\\b') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, place) = 1)"
_V = VOCABULARY_SQL + ", " + METRIC_SQL.format("questions") + ", reg AS (SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS company FROM nation), rcs AS (SELECT DISTINCT query_id, company FROM (SELECT query_id, unnest(regexp_extract_all(upper(question), '[A-Z0-9_]+')) AS name FROM questions) w JOIN reg USING (name)), fin AS (SELECT query_id, company, metric FROM rm JOIN rcs USING (query_id) JOIN questions q USING (query_id) WHERE NOT regexp_matches(lower(q.question), 'summar|outlook|explain|why'))"


def vocabulary(t):
    return t("nation").sparkSession.createDataFrame(_VOCABULARY, "alias string, metric string, place int")


def _registry(t):
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return t("nation").select(F.col("n_name").alias("name"), F.get(names, F.col("n_nationkey") % 5).alias("company"))


@query("met_11_resolve_metric", f"{_V} SELECT query_id, metric FROM rm", ("questions",))
def met_11(t):
    return an.resolve_metric(t("questions"), vocabulary(t))


@query("met_12_resolve_companies", f"{_V} SELECT query_id, company FROM rcs", ("questions",))
def met_12(t):
    return an.resolve_companies(t("questions"), _registry(t))


@query("met_13_financial_intents", f"{_V} SELECT query_id, company, metric FROM fin", ("questions",))
def met_13(t):
    return an.financial_intents(t("questions"), vocabulary(t), _registry(t))


@query("met_14_answer_metrics", f"{_V}, la AS (SELECT entity AS company, metric, max(end_d) AS end_d, max_by(value, end_d) AS value FROM (SELECT entity, CASE metric WHEN 'revenue' THEN 'Total Revenue' WHEN 'capex' THEN 'Capital Expenditure' ELSE 'Operating Income' END AS metric, end_d, value FROM metric_values) n GROUP BY ALL) SELECT f.query_id, f.company, f.metric, la.end_d, round(la.value, 2) AS value FROM fin f LEFT JOIN la USING (company, metric)", ("questions", "metric_values"))
def met_14(t):
    named = F.when(F.col("metric") == "revenue", "Total Revenue").when(F.col("metric") == "capex", "Capital Expenditure").otherwise("Operating Income")
    return an.answer_metrics(an.financial_intents(t("questions"), vocabulary(t), _registry(t)), t("metric_values").withColumn("metric", named)).select("query_id", "company", "metric", "end_d", F.round("value", 2).alias("value"))


@query("alr_03_strategic_alerts", "k AS (SELECT company, chunk_id, w.word, row_number() OVER (PARTITION BY company, w.word ORDER BY chunk_id) AS n FROM chunks, (VALUES ('tion'), ('heit')) w(word) WHERE contains(lower(content), w.word)) SELECT company, word, chunk_id FROM k WHERE n = 1", ("chunks",))
def alr_03(t):
    words = F.array_compact(F.array(*[F.when(F.lower("content").contains(w), F.lit(w)) for w in ("tion", "heit")]))
    return t("chunks").select("company", "chunk_id", F.explode(words).alias("word")).groupBy("company", "word").agg(F.min("chunk_id").alias("chunk_id"))


@query("alr_06_apply_alert_actions", "SELECT id, is_read OR id % 5 = 0 AS is_read, dismissed OR id % 11 = 0 AS dismissed FROM alerts", ("alerts",))
def alr_06(t):
    actions = t("alerts").select("id", (F.col("id") % 5 == 0).alias("read"), (F.col("id") % 11 == 0).alias("drop")).groupBy("id").agg(F.bool_or("read").alias("read"), F.bool_or("drop").alias("drop"))
    return t("alerts").join(actions, "id", "left").select("id", (F.col("is_read") | F.coalesce("read", F.lit(False))).alias("is_read"), (F.col("dismissed") | F.coalesce("drop", F.lit(False))).alias("dismissed"))


@query("alr_08_order_alerts", "SELECT id, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM alerts", ("alerts",))
def alr_08(t):
    return t("alerts").select("id", F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2).alias("rank"))


def _kw(word):
    return f"((length(lower(content)) - length(replace(lower(content), '{word}', ''))) // {len(word)})"


@query("ana_23_top_themes", "u AS (" + " UNION ALL ".join(f"SELECT company, '{w}' AS theme, CAST(sum({_kw(w)}) AS BIGINT) AS n FROM chunks GROUP BY company" for w in ("tion", "ing", "er", "heit")) + ") SELECT company, theme, n, row_number() OVER (PARTITION BY company ORDER BY n DESC, theme) AS place FROM u QUALIFY place <= 3", ("chunks",))
def ana_23(t):
    words = ["tion", "ing", "er", "heit"]
    counts = t("chunks").groupBy("company").agg(*[F.sum(tx.keyword_count(F.col("content"), [w])).alias(w) for w in words]).unpivot(["company"], words, "theme", "n")
    return co.top_by_key(counts, "company", "n", "theme", 3)


@query("cal_02_apply_confirmed", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 2 ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'estimated' END AS status FROM orders")
def cal_02(t):
    rows = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("guess"))
    confirmed = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.date_add("guess", 2).alias("sure"))
    return rows.join(confirmed, "o_orderkey", "left").select("o_orderkey", F.coalesce("sure", "guess").alias("day"), F.when(F.col("sure").isNotNull(), "confirmed").otherwise("estimated").alias("status"))


@query("evt_01_extract_events", "SELECT l_orderkey, l_linenumber, (q_true + 0.5) AS amount_m, 'capex' AS bucket FROM metric_text", ("metric_text",))
def evt_01(t):
    amount = tx.scaled_match(F.col("content"), "capital expenditures") / 1e6
    return t("metric_text").where(amount.isNotNull()).select("l_orderkey", "l_linenumber", amount.alias("amount_m"), F.when(F.lower("content").contains("capital expenditures"), "capex").otherwise("other").alias("bucket"))


@query("geo_07_aggregate_mentions", "SELECT city, count(*) AS n, round(least(0.5 + 0.1 * count(*), 1.0), 4) AS confidence FROM facilities GROUP BY city", ("facilities",))
def geo_07(t):
    return t("facilities").groupBy("city").agg(F.count("*").alias("n"), F.round(F.least(0.5 + 0.1 * F.count("*"), F.lit(1.0)), 4).alias("confidence"))


@query("geo_08_regional_mentions", "SELECT region, company, count(*) AS n FROM facilities GROUP BY region, company QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, company) <= 3", ("facilities",))
def geo_08(t):
    return co.top_by_key(t("facilities").groupBy("region", "company").agg(F.count("*").alias("n")), "region", "n", "company", 3).drop("place")


@query("hyp_03_backfill_previous", "SELECT entity, year, round(coalesce(CASE WHEN year % 2 = 0 THEN value END, lag(value) OVER (PARTITION BY entity ORDER BY year)), 2) AS value FROM yearly", ("yearly",))
def hyp_03(t):
    before = F.lag("value").over(Window.partitionBy("entity").orderBy("year"))
    return t("yearly").select("entity", "year", F.round(F.coalesce(F.when(F.col("year") % 2 == 0, F.col("value")), before), 2).alias("value"))


@query("hyp_04_recent_years", "SELECT entity, year, round(value, 2) AS value FROM yearly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY year DESC) <= 5", ("yearly",))
def hyp_04(t):
    return co.top_by_key(t("yearly"), "entity", "year", "year", 5).select("entity", "year", F.round("value", 2).alias("value"))


@query("int_06_patent_mix", "SELECT p_type, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type")
def int_06(t):
    return co.ranked(t("part").groupBy("p_type").agg(F.count("*").alias("n")), "n", "p_type")


@query("int_07_innovation_score", "SELECT p_brand, round(least(100, sum(CASE WHEN p_size > 25 THEN 2.0 ELSE 1.0 END) / 50 * 100), 4) AS score FROM part GROUP BY p_brand")
def int_07(t):
    return t("part").groupBy("p_brand").agg(F.round(F.least(F.lit(100.0), F.sum(F.when(F.col("p_size") > 25, 2.0).otherwise(1.0)) / 50 * 100), 4).alias("score"))


@query("int_10_composite_score", "g AS (SELECT p_brand, avg(p_size) AS a, avg(p_retailprice) / 100 AS b, count(*) AS c FROM part GROUP BY p_brand) SELECT p_brand, round(0.4 * a + 0.3 * b + 0.3 * CASE WHEN c > 10 THEN 50 ELSE 25 END, 4) AS score FROM g")
def int_10(t):
    g = t("part").groupBy("p_brand").agg(F.avg("p_size").alias("a"), (F.avg("p_retailprice") / 100).alias("b"), F.count("*").alias("c"))
    return g.select("p_brand", F.round(0.4 * F.col("a") + 0.3 * F.col("b") + 0.3 * F.when(F.col("c") > 10, 50).otherwise(25), 4).alias("score"))


@query("news_16_company_relevance", "SELECT input_pos FROM news WHERE contains(' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ', ' the ')", ("news",))
def news_16(t):
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "), F.lit(" "))
    return t("news").where(padded.contains(" the ")).select("input_pos")


@query("news_17_suggest", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(n_name), '1')")
def news_17(t):
    return t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).where(F.lower("n_name").contains("1")).select("s_suppkey", "n_name")


@query("news_20_digest_lines", "SELECT input_pos, coalesce(nullif(substring(title, 1, 40), ''), url) AS line FROM news", ("news",))
def news_20(t):
    return t("news").select("input_pos", F.coalesce(F.nullif(F.substring("title", 1, 40), F.lit("")), "url").alias("line"))


@query("news_25_repair_news", "SELECT count(*) AS n FROM (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS u FROM pages)")
def news_25(t):
    raw = t("pages").select(F.col("page_id").alias("input_pos"), F.regexp_replace("url", "#.*$", "").alias("url"), F.lit("x").alias("title"), F.lit(None).cast("timestamp").alias("published"), F.lit("brave").alias("source_type"), F.lit("x").alias("intent"))
    return nw.dedup_exact(raw).agg(F.count("*").alias("n"))


@query("ret_24_merge_comparison", "SELECT l_returnflag, max_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS winner FROM lineitem GROUP BY l_returnflag")
def ret_24(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.max_by("l_orderkey", F.col("l_extendedprice") * 1000000 + F.col("l_orderkey")).alias("winner"))


@query("str_04_sessions_batch", "g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def str_04(t):
    rows = t("events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.session_window("at", "24 hours"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


