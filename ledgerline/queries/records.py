"""Sources, events, places, hiring, analysts, calendars, alerts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import duplicates as du
from ledgerline.operators import records as rc
from ledgerline.queries.base import query, register, table
from ledgerline.sources import files as fl
from ledgerline.sources.keyed import KeyedTable, refresh_partitions
from ledgerline.streaming import jobs
from ledgerline.workdir import new_path

_EV = "ev AS (SELECT event_id AS id, 'Company' || (user_id % 6) AS company, event_type AS type, CAST(ts AS DATE) AS day, value AS amount FROM events)"


def _events(t):
    return t("events").select(F.col("event_id").alias("id"), F.concat(F.lit("Company"), (F.col("user_id") % 6).cast("string")).alias("company"), F.col("event_type").alias("type"), F.to_date("ts").alias("day"), F.col("value").alias("amount"))


@query("src_05_filing_index", "SELECT 'C' || (o_custkey % 50) AS company, o_orderstatus AS form, CAST(o_orderkey AS VARCHAR) AS accession FROM orders WHERE o_orderstatus IN ('F', 'P')")
def src_05(t):
    one = F.struct(F.col("o_orderstatus").alias("form"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").cast("string").alias("accession"))
    lists = t("orders").groupBy(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("company"), F.trunc("o_orderdate", "month").alias("period")).agg(F.collect_list(one).alias("x"))  # an index a company and month
    return fl.filing_index(lists.select("company", "x.form", "x.day", "x.accession"), ["F", "P"]).select("company", "form", "accession")


@query("src_07_corpus_stats", "SELECT company, filing_type, count(*) AS n FROM chunks GROUP BY ALL", ("chunks",))
def src_07(t):
    return t("chunks").groupBy("company", "filing_type").agg(F.count("*").alias("n"))


@query("src_08_new_files", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def src_08(t):
    ledger = t("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t("orders").select("o_orderkey").join(ledger, "o_orderkey", "left_anti")


@query("src_09_list_filings", "SELECT DISTINCT company, filing_type, fiscal_year FROM chunks", ("chunks",))
def src_09(t):
    return t("chunks").select("company", "filing_type", "fiscal_year").distinct()


@query("src_10_company_documents", "SELECT chunk_id, row_number() OVER (PARTITION BY company ORDER BY chunk_id) AS n FROM chunks QUALIFY n <= 20", ("chunks",))
def src_10(t):
    from pyspark.sql import Window

    return t("chunks").select("chunk_id", F.row_number().over(Window.partitionBy("company").orderBy("chunk_id")).cast("long").alias("n")).where("n <= 20")


def _halves(t):
    e = t("events").select("event_id", "ts", "value")
    return e.where("event_id % 10 < 7"), e.where("event_id % 10 > 2").withColumn("value", F.col("value") + 1)


def _keyed(spark, sf_dir):
    """Two batches of rows, the second after a compaction and twice, in a stored table."""
    old, new = _halves(lambda name: table(spark, sf_dir, name))
    held = KeyedTable(spark, new_path(spark, "snapshots"), ", ".join(f"`{c}` {t}" for c, t in old.dtypes), ["event_id"], "ts", 8)
    held.upsert("first", old)
    held.compact()
    held.upsert("second", new)
    held.upsert("second", new)
    return held.read().select("event_id", "ts", F.round("value", 6).alias("value"))


register("src_11_upsert", _keyed, "SELECT event_id, ts, round(CASE WHEN event_id % 10 > 2 THEN value + 1 ELSE value END, 6) AS value FROM events")


def _refreshed(spark, sf_dir):
    """Views by company are there; then errors of four companies arrive, of which one has failed and one in part."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 6).cast("int").alias("company"))
    failed = F.when((F.col("company") == 3) | ((F.col("company") == 2) & (F.col("event_id") % 2 == 0)), "timeout")
    path = new_path(spark, "partitions")
    refresh_partitions(spark, path, rows.where("event_type = 'view'"), "company")
    done = refresh_partitions(spark, path, rows.where("event_type = 'error' AND company < 4").withColumn("failed", failed), "company", "failed")
    held = spark.read.parquet(path).groupBy("company").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return held.join(done, "company", "left").select("company", "n", "ids", "status", "rows_written")


register("src_12_refresh_partitions", _refreshed, "r AS (SELECT event_id, event_type, user_id % 6 AS company FROM events), b AS (SELECT *, company = 3 OR (company = 2 AND event_id % 2 = 0) AS bad FROM r WHERE event_type = 'error' AND company < 4), d AS (SELECT company, CASE WHEN bool_and(bad) THEN 'error' WHEN bool_or(bad) THEN 'partial' ELSE 'ok' END AS status, count(*) FILTER (NOT bad) AS rows_written FROM b GROUP BY company), h AS (SELECT company, event_id FROM b WHERE NOT bad UNION ALL SELECT company, event_id FROM r WHERE event_type = 'view' AND company NOT IN (SELECT company FROM b WHERE NOT bad)) SELECT CAST(h.company AS INT) AS company, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, d.status, d.rows_written FROM h LEFT JOIN d ON d.company = h.company GROUP BY h.company, d.status, d.rows_written")


@query("src_12_refresh_partition", "SELECT user_id, event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'error'")
def src_12(t):
    e = t("events").select("user_id", "event_id", "event_type")
    return rc.refresh(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'error'").drop("event_type"), "user_id")


@query("src_13_cache_summary", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id")
def src_13(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("evt_02_event_id", "SELECT event_id, substring(md5(user_id || '|' || event_type || '|' || coalesce(CAST(NULL AS VARCHAR), 'None')), 1, 16) AS id FROM events")
def evt_02(t):
    return t("events").select("event_id", rc.event_id(F.col("user_id"), F.col("event_type"), F.lit(None)).alias("id"))


# An amount that is null, zero or NaN agrees with every amount and a null day with every day. Rows are numbered by their ids; those without an
# earlier neighbour are followed to all that links reach, and the first that reaches a row names its component.
_DUPLICATES = """RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id, user_id, event_type, ts, value) AS k, event_id AS id,
 'Company' || (user_id % 6) AS company, event_type AS type, CAST(ts AS DATE) AS day, CASE WHEN value <> 0 AND NOT isnan(value) THEN value END AS amount FROM events),
 p AS MATERIALIZED (SELECT x.k AS a, y.k AS z FROM e x JOIN e y ON x.company = y.company AND x.type = y.type AND x.k <> y.k WHERE x.id IS NOT NULL AND y.id IS NOT NULL
 AND (x.day IS NULL OR y.day IS NULL OR abs(x.day - y.day) <= 30)
 AND (x.amount IS NULL OR y.amount IS NULL OR least(x.amount, y.amount) >= 0.7 * greatest(x.amount, y.amount))),
 n AS MATERIALIZED (SELECT a, count(*) AS n, min(z) AS least FROM p GROUP BY a),
 r AS (SELECT a AS seed, a AS k FROM n WHERE a < least UNION SELECT r.seed, p.z FROM r JOIN p ON p.a = r.k),
 c AS (SELECT k, min(seed) AS seed FROM r GROUP BY k)
 SELECT e.id, coalesce(n.n, 0) AS n_links, CASE WHEN c.k IS NULL THEN e.id ELSE s.id END AS component
 FROM e LEFT JOIN n ON n.a = e.k LEFT JOIN c ON c.k = e.k LEFT JOIN e s ON s.k = c.seed"""


@query("evt_04_duplicate_events", _DUPLICATES)
def evt_04(t):
    """All events with the number of their duplicates and their component."""
    return du.duplicate_classes(_events(t))


@query("evt_04_duplicate_classes")
def evt_04_classes(t):
    """All events with the number of their duplicates and their component."""
    return du.duplicate_classes(_events(t))


@query("evt_06_aggregate_events", "g AS (SELECT l_suppkey AS company, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS n, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) SELECT company, round(a, 2) AS A, round(n, 2) AS N, round(total, 2) AS total, round(a / total, 6) AS share FROM g")
def evt_06(t):
    out = rc.totals_by(t("lineitem").withColumnRenamed("l_suppkey", "company"), "company", "l_returnflag", ["A", "N"], "l_extendedprice")
    return out.select("company", *[F.round(c, 2).alias(c) for c in ("A", "N", "total")], F.round("share", 6).alias("share"))


@query("evt_07_event_comparison", f"{_EV}, c AS (SELECT company, type, count(*) AS n FROM ev GROUP BY ALL) SELECT company, type, n FROM c QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, type) <= 2")
def evt_07(t):
    from ledgerline.operators.corpus import top_by_key

    return top_by_key(_events(t).groupBy("company", "type").agg(F.count("*").alias("n")), "company", "n", "type", 2).drop("place")


@query("geo_01_market_region", "SELECT n_name, coalesce(r_name, 'Other') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def geo_01(t):
    return t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("Other")).alias("region"))


@query("geo_02_facility_profile", "p AS (SELECT company, region, count(*) AS n, count_if(facility_type = 'Headquarters') AS hq FROM facilities GROUP BY ALL) SELECT company, CAST(sum(n) AS BIGINT) AS sites, CAST(sum(hq) AS BIGINT) AS headquarters, count(*) AS regions, first(region ORDER BY n DESC, region) AS main_region FROM p GROUP BY company", ("facilities",))
def geo_02(t):
    return rc.facility_profile(t("facilities"))


@query("geo_03_facility_map", "SELECT id, city, facility_type = 'Headquarters' AS is_hq, CASE WHEN facility_type = 'Headquarters' THEN 1.0 ELSE 0.5 END AS heat FROM facilities", ("facilities",))
def geo_03(t):
    hq = F.col("facility_type") == "Headquarters"
    return t("facilities").select("id", "city", hq.alias("is_hq"), F.when(hq, 1.0).otherwise(0.5).alias("heat"))


@query("geo_04_regional_leaders", "c AS (SELECT region, company, count(*) AS n FROM facilities GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, company) = 1", ("facilities",))
def geo_04(t):
    return rc.regional_leaders(t("facilities"))


@query("geo_05_city_overlap", "SELECT city, array_to_string(list_sort(list(DISTINCT company)), ',') AS companies FROM facilities GROUP BY city HAVING count(DISTINCT company) > 1", ("facilities",))
def geo_05(t):
    return rc.city_overlap(t("facilities")).withColumn("companies", F.array_join("companies", ","))


@query("geo_06_combine_facilities", "SELECT DISTINCT lower(company) AS company, lower(city) AS city FROM facilities WHERE facility_type <> 'Headquarters' AND (company, city) NOT IN (SELECT company, city FROM facilities WHERE facility_type = 'Headquarters')", ("facilities",))
def geo_06(t):
    f = t("facilities").select(F.lower("company").alias("company"), F.lower("city").alias("city"), "facility_type")
    known = f.where("facility_type = 'Headquarters'").select("company", "city").distinct()
    return f.where("facility_type <> 'Headquarters'").select("company", "city").distinct().join(known, ["company", "city"], "left_anti")


@query("geo_09_facility_summary", "SELECT company, count(*) AS n, count(DISTINCT city) AS cities FROM facilities GROUP BY company", ("facilities",))
def geo_09(t):
    return t("facilities").groupBy("company").agg(F.count("*").alias("n"), F.count_distinct("city").alias("cities"))


@query("int_01_classify_jobs", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'metal' WHEN lower(p_type) LIKE '%b%' THEN 'b' ELSE 'other' END AS category FROM part")
def int_01(t):
    low = F.lower("p_type")
    return t("part").select("p_partkey", F.when(low.contains("steel"), "metal").when(low.contains("b"), "b").otherwise("other").alias("category"))


@query("int_03_hiring_mix", "SELECT user_id % 50 AS company, CAST(count_if(event_type = 'view') AS BIGINT) AS views, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks, count(*) AS n FROM events GROUP BY 1")
def int_03(t):
    kind = F.col("event_type")
    return t("events").groupBy((F.col("user_id") % 50).alias("company")).agg(F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"), F.count("*").alias("n"))


@query("int_04_hiring_score", "g AS (SELECT user_id % 50 AS company, 100.0 * count_if(event_type = 'view') / count(*) AS a, 100.0 * count_if(event_type = 'click') / count(*) AS b, count(*) AS n FROM events GROUP BY 1) SELECT company, round(least(100, 2 * a + 1.5 * b + least(n / 20, 1) * 30), 4) AS score FROM g")
def int_04(t):
    a, b = (100.0 * F.count_if(F.col("event_type") == k) / F.count("*") for k in ("view", "click"))
    return t("events").groupBy((F.col("user_id") % 50).alias("company")).agg(F.round(F.least(F.lit(100.0), 2 * a + 1.5 * b + F.least(F.count("*") / 20, F.lit(1.0)) * 30), 4).alias("score"))


@query("int_09_snapshot_diff", "SELECT DISTINCT user_id, CASE WHEN o THEN 'removed' ELSE 'added' END AS change FROM (SELECT user_id, bool_or(event_id % 10 < 2) AS o, bool_or(event_id % 10 > 7) AS n FROM events GROUP BY user_id) WHERE o <> n")
def int_09(t):
    e = t("events")
    return rc.snapshot_diff(e.where("event_id % 10 < 2"), e.where("event_id % 10 > 7"), ["user_id"])


@query("int_11_conversation_tail", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4")
def int_11(t):
    return rc.conversation_tail(t("conversations"), 4).select("conv_id", "turn", "back")


@query("anl_01_divergence_flags", "m AS (SELECT p_brand, avg(p_retailprice) AS mean FROM part GROUP BY p_brand) SELECT p_partkey, round((p_retailprice - mean) / mean, 6) AS gap FROM part JOIN m USING (p_brand) WHERE abs(p_retailprice - mean) >= 0.2 * mean")
def anl_01(t):
    mean = t("part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    gap = (F.col("p_retailprice") - F.col("mean")) / F.col("mean")
    return t("part").join(mean, "p_brand").where(F.abs(F.col("p_retailprice") - F.col("mean")) >= 0.2 * F.col("mean")).select("p_partkey", F.round(gap, 6).alias("gap"))


@query("anl_04_peer_benchmark", "g AS (SELECT p_brand, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand) SELECT p_brand, price, rank() OVER (ORDER BY price DESC) AS place FROM g")
def anl_04(t):
    from pyspark.sql import Window

    g = t("part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("price"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("price"))).cast("long"))  # one row a brand


@query("anl_06_latest_n", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 3")
def anl_06(t):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("events").select("user_id", "event_id", F.row_number().over(by).cast("long").alias("n")).where("n <= 3")


@query("anl_08_key_quotes", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-24 00:00:00'")
def anl_08(t):
    return t("events").where("event_type = 'click' AND ts >= TIMESTAMP_NTZ '2024-01-24 00:00:00'").select("event_id", "user_id")


@query("cal_01_estimate_calendar", "g AS (SELECT company, CAST(q AS INT) AS q, last_day(make_date(2024, CAST((fy_end_month + q * 3 - 1) % 12 + 1 AS INT), 1)) AS period_end FROM calendar, range(1, 5) r(q)), d AS (SELECT *, period_end + 30 AS raw FROM g) SELECT company, q, period_end, raw + CASE isodow(raw) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS report_day FROM d", ("calendar",))
def cal_01(t):
    return rc.estimate_calendar(t("calendar"), 2024, 30)


@query("cal_03_next_and_last", "SELECT o_custkey, min(CASE WHEN CAST(o_orderdate AS DATE) > DATE '1998-06-01' THEN CAST(o_orderdate AS DATE) END) AS next_d, max(CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-06-01' THEN CAST(o_orderdate AS DATE) END) AS last_d FROM orders GROUP BY o_custkey")
def cal_03(t):
    return rc.next_and_last(t("orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "o_custkey", "day", "1998-06-01")


@query("cal_05_upcoming", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1998-06-01' AS days_until FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-07-01'")
def cal_05(t):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"))
    return t("orders").select("o_orderkey", days.cast("long").alias("days_until")).where("days_until BETWEEN 0 AND 30")


@query("hyp_01_parse_guidance", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size + 5.0 ELSE CAST(p_size AS DOUBLE) END AS guidance FROM part")
def hyp_01(t):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(" to $"), (F.col("p_size") + 10).cast("string"), F.lit("B"))).otherwise(F.concat(F.lit("about $"), F.col("p_size").cast("string"), F.lit("B")))
    return t("part").select("p_partkey", rc.parse_guidance(text).alias("guidance"))


@query("alr_01_filing_alerts", "SELECT company, chunk_id FROM chunks WHERE filing_type = '8-K' QUALIFY row_number() OVER (PARTITION BY company ORDER BY chunk_id DESC) <= 3", ("chunks",))
def alr_01(t):
    from ledgerline.operators.corpus import top_by_key

    return top_by_key(t("chunks").where("filing_type = '8-K'"), "company", "chunk_id", "chunk_id", 3).select("company", "chunk_id")


@query("alr_04_new_alerts", "SELECT id FROM alerts a WHERE severity = 'high' AND NOT EXISTS (SELECT 1 FROM alerts b WHERE NOT b.dismissed AND b.severity = 'low' AND b.company = a.company AND b.type = a.type AND b.is_read)", ("alerts",))
def alr_04(t):
    live = t("alerts").where("severity = 'low' AND is_read")
    return rc.new_alerts(t("alerts").where("severity = 'high'"), live, ["company", "type"]).select("id")


@query("alr_05_list_alerts", "SELECT id, company FROM alerts WHERE NOT dismissed AND severity = 'high'", ("alerts",))
def alr_05(t):
    return t("alerts").where("NOT dismissed AND severity = 'high'").select("id", "company")


@query("alr_07_alert_summary", "SELECT company, count(*) AS n, CAST(count_if(NOT is_read) AS BIGINT) AS unread, CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'medium') AS BIGINT) AS medium, CAST(count_if(severity = 'low') AS BIGINT) AS low, count(DISTINCT type) AS types FROM alerts WHERE NOT dismissed GROUP BY company", ("alerts",))
def alr_07(t):
    return rc.alert_summary(t("alerts"))


@query("evl_01_evaluate_extraction", "SELECT count(*) AS n, count(*) AS exact, count(*) AS close, CAST(0 AS BIGINT) AS missing, 0.0 AS error_pct FROM (SELECT DISTINCT l_orderkey, l_linenumber, q_true FROM metric_text)", ("metric_text",))
def evl_01(t):
    from ledgerline.functions.text import scaled_match

    key = ["l_orderkey", "l_linenumber", "q_true"]
    m = t("metric_text").dropDuplicates(key).withColumn("actual", scaled_match(F.col("content"), "capital expenditures") / 1e6)
    return rc.evaluate(m.select(*key, "actual"), m.select(*key, (F.col("q_true") + 0.5).alias("truth")), key)


@query("evl_02_evaluate_answers", "SELECT role, count(*) AS n, round(avg(CASE WHEN lower(text) LIKE '%the%' THEN 1.0 ELSE 0 END), 6) AS accuracy FROM conversations GROUP BY role")
def evl_02(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.lower("text").contains("the").cast("double")), 6).alias("accuracy"))


register("str_01_ingest_stream", lambda s, d: jobs.collect_stream(s, jobs.read_stream(s, d, "events").select("event_id", "user_id"), "ingest"), "SELECT event_id, user_id FROM events")
register("str_02_dedup_stream", lambda s, d: jobs.collect_stream(s, jobs.dedup_stream(jobs.read_stream(s, d, "events"), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "dedup"), "SELECT DISTINCT user_id, event_type FROM events")
register("str_03_window_counts_stream", lambda s, d: jobs.collect_stream(s, jobs.window_counts_stream(jobs.read_stream(s, d, "events"), "event_type", "ts", "1 day", "1 day", "0 seconds"), "windows").withColumn("start", F.col("start").cast("timestamp_ntz")), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL")
register("str_05_upsert_stream", lambda s, d: jobs.upsert_stream(s, jobs.read_stream(s, d, "events").select("user_id", "ts"), ["user_id"], "ts", "latest").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")), "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
register("str_08_enrich_stream", lambda s, d: jobs.collect_stream(s, jobs.enrich_stream(jobs.read_stream(s, d, "events").withColumn("n_nationkey", (F.col("user_id") % 25).cast("int")), table(s, d, "nation"), "n_nationkey").select("event_id", "n_name"), "enrich"), "SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey")
