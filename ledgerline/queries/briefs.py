"""Roll-ups, hiring, patents, standards, analysts, calendars, guidance, alerts and stream jobs over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators import briefs as br
from ledgerline.operators import corpus as co
from ledgerline.operators import records as rc
from ledgerline.operators import trends as tr
from ledgerline.plans import hooks as hk
from ledgerline.queries.base import _NEEDS, VIEWS, query, register, table
from ledgerline.queries.text import _CLS, _SCORE, _W, _kw, _N, _P, NEG, POS, TOKEN, classed, scored
from ledgerline.streaming import jobs

VIEWS["lchunks"] = VIEWS["chunks"].replace("source AS company", "coalesce(lang, 'none') AS company")
_NEEDS["lchunks"] = ["documents"]


def _lang(t):
    """Chunks with their language as company: sources have one fiscal year each, languages have all."""
    return lambda name: t("lchunks" if name == "chunks" else name)


# Mentions, word counts and scores by year.
_MEASURES = f"{_SCORE}, me AS (SELECT company, fiscal_year, sum({_W}) AS mentions, sum(({_kw('tion')} + {_kw('ing')}) * {_W}) AS focus, sum(score * {_W}) / sum({_W}) AS sentiment FROM sc GROUP BY company, fiscal_year), mu AS (SELECT company, fiscal_year, 'mentions' AS measure, CAST(mentions AS DOUBLE) AS value FROM me UNION ALL SELECT company, fiscal_year, 'focus', focus FROM me UNION ALL SELECT company, fiscal_year, 'sentiment', sentiment FROM me), mi AS (SELECT *, row_number() OVER (PARTITION BY company, measure ORDER BY fiscal_year) - 1 AS i FROM mu), mf AS (SELECT company, measure, regr_slope(value, i) AS s, regr_intercept(value, i) AS c, avg(value) AS m, count(*) AS n FROM mi GROUP BY ALL), mr AS (SELECT company, measure, stddev_samp(value - c - s * i) AS r FROM mi JOIN mf USING (company, measure) GROUP BY ALL), mt AS (SELECT f.company, f.measure, CASE WHEN (CASE WHEN m <> 0 THEN s / abs(m) ELSE s END) > 0.05 THEN 'increasing' WHEN (CASE WHEN m <> 0 THEN s / abs(m) ELSE s END) < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction, c + s * n AS forecast, CASE WHEN n = 2 THEN 50.0 ELSE greatest(0, least(100, 100 - r / greatest(abs(m), 1) * 100)) END AS confidence FROM mf f JOIN mr USING (company, measure) WHERE n >= 2), vo AS (SELECT company, CASE WHEN count_if(direction = 'increasing') > count_if(direction = 'decreasing') THEN 'positive' WHEN count_if(direction = 'increasing') < count_if(direction = 'decreasing') THEN 'cautious' ELSE 'neutral' END AS outlook FROM mt GROUP BY company)"


def _trends(t):
    return br.company_trends(br.yearly_measures(scored(t), ["tion", "ing"]))


@query("ana_11_company_trends", (f"{_MEASURES} SELECT mt.company, measure, direction, round(forecast, 4) AS forecast, round(confidence, 3) AS confidence, outlook FROM mt JOIN vo USING (company)").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def ana_11(t):
    trends = _trends(_lang(t))
    return trends.join(br.outlook(trends), "company").select("company", "measure", "direction", F.round("forecast", 4).alias("forecast"), F.round("confidence", 3).alias("confidence"), "outlook")


# Amounts, shifts of sentiment and of density by the nation as company.
_AMOUNTS = "pa AS (SELECT 'N' || CAST(l_suppkey % 25 AS VARCHAR) AS company, CAST(year(l_shipdate) AS INT) AS period, avg(CAST(l_extendedprice AS DECIMAL(18, 2))) AS average FROM lineitem GROUP BY ALL), pw AS (SELECT *, avg(average) OVER p AS mean, count(*) OVER p AS n, stddev_samp(average) OVER p AS sd0 FROM pa WINDOW p AS (PARTITION BY company)), pz AS (SELECT company, period, (average - mean) / CASE WHEN n > 2 THEN sd0 ELSE mean * 0.3 END AS z, (average - mean) / mean AS pct FROM pw WHERE n >= 2 AND CASE WHEN n > 2 THEN sd0 ELSE mean * 0.3 END > 0), an AS (SELECT company, period, round(pct, 6) AS pct, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS direction, CASE WHEN abs(z) > 2 THEN 'high' ELSE 'medium' END AS severity FROM pz WHERE abs(z) > 1.5 OR abs(pct) > 0.2)"
_SHIFTS = f"sy AS (SELECT company, fiscal_year, sum({_P}) AS p, sum({_N}) AS q FROM chunks GROUP BY ALL), sv AS (SELECT company, fiscal_year, CASE WHEN p + q > 0 THEN (p - q) / (p + q) ELSE 0 END AS s FROM sy), sl AS (SELECT company, fiscal_year, s, lag(s) OVER (PARTITION BY company ORDER BY fiscal_year) AS b FROM sv), sh AS (SELECT company, fiscal_year AS to_year, s - b AS change FROM sl WHERE abs(s - b) > {{cut}})"
_FOCUS = f"fy AS (SELECT company, fiscal_year, sum({_kw('tion')} + {_kw('ing')}) / count(*) AS d FROM chunks GROUP BY ALL), fl AS (SELECT *, lag(d) OVER (PARTITION BY company ORDER BY fiscal_year) AS b FROM fy), fo AS (SELECT company, fiscal_year AS to_year, CASE WHEN b <> 0 THEN (d - b) / b WHEN d > 0 THEN 1.0 ELSE 0.0 END AS change FROM fl WHERE b IS NOT NULL AND abs(CASE WHEN b <> 0 THEN (d - b) / b WHEN d > 0 THEN 1.0 ELSE 0.0 END) > 0.25), fz AS (SELECT company, max_by(change, to_year) AS change, count(*) AS n, max(to_year) AS latest FROM fo GROUP BY company HAVING max_by(change, to_year) > 0)"


def _anomalies(t):
    rows = t("lineitem").select(F.concat(F.lit("N"), (F.col("l_suppkey") % 25).cast("string")).alias("company"), F.year("l_shipdate").alias("period"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return tr.amount_anomalies(rows, "company", "period", "price").withColumn("pct", F.round("pct", 6))


def _shifts(t, cut):
    tokens = F.regexp_extract_all(F.lower("content"), F.lit(TOKEN), 0)
    n = lambda ws: F.sum(F.size(F.filter(tokens, lambda x: x.isin(ws))))
    per = t("chunks").groupBy("company", "fiscal_year").agg(n(POS).alias("p"), n(NEG).alias("q")).withColumn("s", F.when(F.col("p") + F.col("q") > 0, (F.col("p") - F.col("q")) / (F.col("p") + F.col("q"))).otherwise(0.0))
    return co.yearly_shift(per, "s", cut, relative=False)


def _focus(t):
    per = t("chunks").groupBy("company", "fiscal_year").agg((F.sum(tx.keyword_count(F.col("content"), ["tion", "ing"])) / F.count("*")).alias("d"))
    return co.yearly_shift(per, "d", 0.25, relative=True)


@query("ana_06_sentiment_severity", (f"{_SHIFTS.format(cut=0.15)} SELECT company, to_year, round(change, 6) AS change, CASE WHEN abs(change) > 0.3 THEN 'high' ELSE 'medium' END AS severity FROM sh").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def ana_06_severity(t):
    return _shifts(_lang(t), 0.15).select("company", "to_year", F.round("change", 6).alias("change"), F.when(F.abs("change") > 0.3, "high").otherwise("medium").alias("severity"))


@query("ana_08_anomaly_summary", (f"{_AMOUNTS}, {_SHIFTS.format(cut=0.15)}, {_FOCUS} SELECT 'amount' AS kind, company, count(*) AS n, max(period) AS latest FROM an GROUP BY company UNION ALL SELECT 'sentiment', company, count(*), max(to_year) FROM sh GROUP BY company UNION ALL SELECT 'focus', company, n, latest FROM fz").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def ana_08(t):
    return br.anomaly_summary(_anomalies(_lang(t)), _shifts(_lang(t), 0.15), _focus(_lang(t)))


@query("alr_02_analytic_alerts", (f"{_AMOUNTS}, {_SHIFTS.format(cut=0.15)}, {_FOCUS} SELECT CASE direction WHEN 'spike' THEN 'capex_spike' ELSE 'capex_drop' END AS type, company, period AS at_year, severity, company || ' shows ' || CAST(CAST(floor(abs(pct) * 100 + 1e-9) AS INT) AS VARCHAR) || '% change from mean' AS message FROM an UNION ALL SELECT CASE WHEN change > 0 THEN 'sentiment_positive' ELSE 'sentiment_negative' END, company, to_year, CASE WHEN abs(change) > 0.3 THEN 'high' ELSE 'medium' END, company || ' sentiment shifted by ' || CAST(CAST(floor(abs(change) * 100 + 1e-9) AS INT) AS VARCHAR) || '%' FROM sh UNION ALL SELECT 'ai_investment_surge', company, latest, 'medium', company || ' shows increased focus' FROM fz").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def alr_02(t):
    return br.analytic_alerts(_anomalies(_lang(t)), _shifts(_lang(t), 0.15), _focus(_lang(t))).withColumnRenamed("at", "at_year")


_BREAK = "m5 AS (SELECT company, CAST(sum(len(regexp_extract_all(content, 'tion'))) AS BIGINT) AS a, CAST(sum(len(regexp_extract_all(content, 'ing'))) AS BIGINT) AS b, CAST(sum(len(regexp_extract_all(content, 'heit'))) AS BIGINT) AS c, CAST(sum(len(regexp_extract_all(content, 'ment'))) AS BIGINT) AS d, CAST(sum(len(regexp_extract_all(content, 'the'))) AS BIGINT) AS e FROM chunks GROUP BY company), mb AS (SELECT company, category, n, n / greatest(sum(n) OVER (PARTITION BY company), 1) AS share FROM (SELECT company, unnest(['building', 'tools', 'systems', 'vehicles', 'land']) AS category, unnest([a, b, c, d, e]) AS n FROM m5) z), mp AS (SELECT company, first(category ORDER BY n DESC, category) AS main FROM mb GROUP BY company)"
_FAMILIES = {"building": "tion", "tools": "ing", "systems": "heit", "vehicles": "ment", "land": "the"}


def _breakdown(t):
    return co.mention_families(t("chunks"), _FAMILIES)


@query("ana_17_mention_families", f"{_BREAK}, sq AS (SELECT company, category, string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY chunk_id) AS quotes FROM (SELECT company, chunk_id, category, row_number() OVER (PARTITION BY company, category ORDER BY chunk_id) AS i FROM (SELECT company, chunk_id, unnest(['building', 'tools', 'systems', 'vehicles', 'land']) AS category, unnest([contains(content, 'tion'), contains(content, 'ing'), contains(content, 'heit'), contains(content, 'ment'), contains(content, 'the')]) AS hit FROM chunks) y WHERE hit) x WHERE i <= 3 GROUP BY ALL) SELECT mb.company, mb.category, n, round(share, 6) AS share, coalesce(quotes, '') AS quotes, main FROM mb JOIN mp USING (company) LEFT JOIN sq USING (company, category)", ("chunks",))
def ana_17_families(t):
    return _breakdown(t).select("company", "category", "n", F.round("share", 6).alias("share"), F.array_join("quotes", " ").alias("quotes"), "main")


@query("ana_18_compare_financials", f"{_BREAK}, ys AS (SELECT company, fiscal_year AS year, sum(length(content)) AS value FROM chunks GROUP BY ALL), ly AS (SELECT company, max(year) AS year, max_by(value, year) AS value FROM ys GROUP BY company) SELECT ly.company, year, CAST(value AS BIGINT) AS value, main FROM ly LEFT JOIN mp USING (company)", ("chunks",))
def ana_18(t):
    """The latest year's figure of a company (here the length of its texts) beside its main family of mentions."""
    series = t("chunks").groupBy("company", F.col("fiscal_year").alias("year")).agg(F.sum(F.length("content")).alias("value"))
    return br.compare_latest(series, _breakdown(t).select("company", "main").distinct())


@query("ana_29_company_dashboard", f"{_MEASURES}, {_CLS}, g AS (SELECT company, sum(score * {_W}) / sum({_W}) AS s FROM sc GROUP BY company), mx AS (SELECT company, sum(share * {_W}) / sum({_W}) AS share FROM lb GROUP BY company), si AS (SELECT c.company, count(DISTINCT f.id) AS sites FROM (SELECT DISTINCT company FROM chunks) c JOIN facilities f ON length(c.company) % 6 = f.id % 6 GROUP BY c.company) SELECT company, round(s, 6) AS sentiment, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS label, round(share, 4) AS share, CASE WHEN share >= 60 THEN 'a' WHEN share <= 40 THEN 'b' ELSE 'balanced' END AS focus, coalesce(outlook, 'neutral') AS outlook, coalesce(sites, 0) AS sites FROM g LEFT JOIN mx USING (company) LEFT JOIN vo USING (company) LEFT JOIN si USING (company)", ("chunks", "facilities"))
def ana_29(t):
    sites = t("chunks").select("company").distinct().join(t("facilities").select((F.col("id") % 6).alias("k"), "id"), F.length("company") % 6 == F.col("k")).groupBy("company").agg(F.count_distinct("id").alias("sites"))
    rows = br.dashboard(co.company_sentiment(scored(t)), co.class_mix(classed(t)), br.outlook(_trends(t)), sites)
    return rows.withColumn("sentiment", F.round("sentiment", 6)).withColumn("share", F.round("share", 4))


@query("ana_31_company_dynamics", (f"{_MEASURES}, hd AS (SELECT company, string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY i) AS titles FROM (SELECT company, chunk_id, row_number() OVER (PARTITION BY company ORDER BY fiscal_year * 10 + quarter DESC, chunk_id) AS i FROM chunks WHERE filing_type = '8-K') z WHERE i <= 3 GROUP BY company), mv AS (SELECT lang AS company, CAST(sum(n_chars) AS DOUBLE) AS value FROM documents WHERE lang IS NOT NULL GROUP BY 1) SELECT c.company, coalesce(outlook, 'unknown') AS outlook, coalesce(titles, 'no headline') AS headlines, coalesce(value, 0) AS value, outlook IS NOT NULL AND titles IS NOT NULL AND value IS NOT NULL AS complete FROM (SELECT DISTINCT company FROM chunks) c LEFT JOIN vo USING (company) LEFT JOIN hd USING (company) LEFT JOIN mv USING (company)").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def ana_31(t):
    heads = t("lchunks").where("filing_type = '8-K'").select("company", (F.col("fiscal_year") * 10 + F.col("quarter")).alias("at"), F.col("chunk_id").alias("id"), F.col("chunk_id").cast("string").alias("title"))
    metrics = t("documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("company")).agg(F.sum("n_chars").cast("double").alias("value"))
    return br.company_dynamics(t("lchunks"), br.outlook(_trends(_lang(t))), heads, metrics).withColumn("headlines", F.array_join("headlines", " "))


# Lists of job, region and seniority words, of patent categories and of standards categories.
JOBS = [
    ("ai_ml", ["machine learning", "AI engineer", "data scientist", "deep learning", "ML ops"]), ("software", ["software engineer", "developer", "programmer", "full stack", "backend"]),
    ("hardware", ["hardware engineer", "electrical engineer", "PCB design", "FPGA", "embedded"]), ("manufacturing", ["manufacturing engineer", "process engineer", "production", "quality"]),
    ("supply_chain", ["supply chain", "logistics", "procurement", "sourcing", "operations"]), ("data_center", ["data center", "cloud engineer", "infrastructure", "DevOps", "SRE"]),
    ("leadership", ["director", "VP", "manager", "head of", "chief"]), ("sales", ["sales", "account manager", "business development", "customer success"]),
]
REGIONS = [("americas", ["USA", "United States", "Mexico", "Brazil", "Canada"]), ("asia_pacific", ["China", "Malaysia", "Singapore", "India", "Vietnam", "Thailand", "Taiwan"]), ("europe", ["Germany", "UK", "Poland", "Hungary", "Czech", "Ireland", "Netherlands"])]
PATENTS = [
    ("ai_ml", ["artificial intelligence", "machine learning", "neural network", "deep learning", "AI system"]), ("automation", ["robotic", "automation", "automated assembly", "pick and place", "automated inspection"]),
    ("manufacturing", ["PCB", "circuit board", "soldering", "surface mount", "electronics manufacturing"]), ("power_systems", ["power supply", "power management", "battery", "charging", "energy storage"]),
    ("connectivity", ["5G", "wireless", "antenna", "RF", "signal processing"]), ("sensors", ["sensor", "IoT", "monitoring", "detection", "measurement"]),
    ("thermal", ["thermal management", "cooling", "heat sink", "heat dissipation"]), ("materials", ["advanced materials", "composite", "coating", "substrate"]),
]
STANDARDS = [("Server", ["server", "compute", "motherboard", "chassis"]), ("Rack & Power", ["rack", "power", "ups", "pdu", "cooling"]), ("Storage", ["storage", "ssd", "nvme", "hdd", "jbod"]), ("Networking", ["networking", "switch", "nic", "router"]), ("Hardware Management", ["bmc", "firmware", "management", "openbmc"]), ("Sustainability", ["sustainability", "circular", "recycling", "carbon"])]
_JOBS = "jb AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '  Senior Machine Learning Engineer' WHEN 1 THEN 'Backend Developer' WHEN 2 THEN 'FPGA designer' WHEN 3 THEN 'Quality intern' WHEN 4 THEN 'Logistics lead' WHEN 5 THEN 'Cloud Engineer' WHEN 6 THEN 'Chief of staff' WHEN 7 THEN 'Account Manager' ELSE 'Cook' END || ' ' || p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'Locations Austin, USA' WHEN 1 THEN 'location Penang, Malaysia' WHEN 2 THEN 'LOCATION Dublin, Ireland ' ELSE 'Remote' END AS location, ' ' || p_type AS department FROM part)"


def _sql_category(column, lists, default):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + f" THEN '{name}'" for name, words in lists) + f" ELSE '{default}' END"


def _jobs(t):
    i = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    title = F.concat_ws(" ", pick(["  Senior Machine Learning Engineer", "Backend Developer", "FPGA designer", "Quality intern", "Logistics lead", "Cloud Engineer", "Chief of staff", "Account Manager", "Cook"], 9), "p_name")
    return t("part").select("p_partkey", title.alias("title"), pick(["Locations Austin, USA", "location Penang, Malaysia", "LOCATION Dublin, Ireland ", "Remote"], 4).alias("location"), F.concat(F.lit(" "), F.col("p_type")).alias("department"))


_SENIOR = "CASE WHEN regexp_matches(lower(title), 'chief|director|head of|vp') THEN 'executive' WHEN regexp_matches(lower(title), 'senior|lead|principal') THEN 'senior' WHEN regexp_matches(lower(title), 'intern|junior|graduate') THEN 'entry' ELSE 'mid' END"


@query("int_01_classify_job_lists", f"{_JOBS} SELECT p_partkey, {_sql_category('title', JOBS, 'other')} AS category, {_sql_category('location', REGIONS, 'other')} AS region, {_SENIOR} AS seniority FROM jb")
def int_01_lists(t):
    seniority = tx.cascade(F.lower("title"), [("executive", "chief|director|head of|vp"), ("senior", "senior|lead|principal"), ("entry", "intern|junior|graduate")], "mid")
    return _jobs(t).select("p_partkey", br.category(F.col("title"), JOBS, "other").alias("category"), br.category(F.col("location"), REGIONS, "other").alias("region"), seniority.alias("seniority"))


@query("int_02_normalize_jobs", f"{_JOBS}, n AS (SELECT p_partkey, left(trim(title), 20) AS title, left(trim(regexp_replace(regexp_replace(location, '^locations\\s*', '', 'i'), '^location\\s*', '', 'i')), 200) AS location, left(trim(department), 100) AS department FROM jb) SELECT *, trim(location || ' | ' || department, ' |') AS snippet FROM n")
def int_02(t):
    return rc.normalize_jobs(_jobs(t), 20)


_PATENT = "pt AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Patent: ' WHEN 1 THEN 'Cooling patent ' WHEN 2 THEN 'A plain page ' WHEN 3 THEN 'Wireless sensor' ELSE 'Robotic battery charging' END || p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'US ' || (7000000 + p_partkey) || ' soldering' WHEN 1 THEN 'no number' ELSE 'US12 and US' || (9000000 + p_partkey) END AS snippet, CASE p_partkey % 4 WHEN 0 THEN 'https://USPTO.example/' || p_partkey ELSE 'https://x.example/' || p_partkey END AS url FROM part)"


@query("int_05_classify_patents", f"{_PATENT} SELECT p_partkey, CASE WHEN regexp_matches(title || ' ' || snippet, 'US\\s*\\d{{7,}}') THEN 'US' || regexp_extract(title || ' ' || snippet, 'US\\s*(\\d{{7,}})', 1) END AS patent_number, {_sql_category('(title || snippet)', PATENTS, 'general')} AS category FROM pt WHERE regexp_matches(lower(title), 'patent|uspto|patentscope|espacenet') OR regexp_matches(lower(url), 'patent|uspto|patentscope|espacenet')")
def int_05(t):
    i = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*values), (i % n + 1).cast("int"))
    lit = lambda *vs: [F.lit(v) for v in vs]
    title = F.concat(pick(lit("Patent: ", "Cooling patent ", "A plain page ", "Wireless sensor", "Robotic battery charging"), 5), F.col("p_name"))
    snippet = pick([F.concat(F.lit("US "), (i + 7000000).cast("string"), F.lit(" soldering")), F.lit("no number"), F.concat(F.lit("US12 and US"), (i + 9000000).cast("string"))], 3)
    url = F.concat(F.when(i % 4 == 0, "https://USPTO.example/").otherwise("https://x.example/"), i.cast("string"))
    rows = t("part").select("p_partkey", title.alias("title"), snippet.alias("snippet"), url.alias("url"))
    return rc.classify_patents(rows).select("p_partkey", "patent_number", br.category(F.concat("title", "snippet"), PATENTS, "general").alias("category"))


_ENGAGE = "en AS (SELECT p_brand AS company, p_partkey, lower(p_name || ' ' || CASE p_partkey % 6 WHEN 0 THEN 'Open Compute server specification' WHEN 1 THEN 'rack design' WHEN 2 THEN 'hyperscale project' WHEN 3 THEN 'new member' WHEN 4 THEN 'carbon and storage' ELSE 'news' END) AS content, CASE WHEN p_partkey % 3 = 0 THEN 'contribution' ELSE 'news' END AS kind, CASE length(p_brand) % 2 WHEN 0 THEN 'Gold' ELSE 'Community' END AS status FROM part)"


@query("int_08_engagement_items", f"{_ENGAGE} SELECT p_partkey, round(least(1.0, {' + '.join(f'0.3 * CAST(contains(content, {chr(39)}{w}{chr(39)}) AS INT)' for w in ('open compute', 'ocp', 'hyperscale', 'data center hardware'))} + {' + '.join(f'0.1 * CAST(contains(content, {chr(39)}{w}{chr(39)}) AS INT)' for w in ('server', 'rack', 'infrastructure', 'manufacturing'))}), 6) AS relevance, CASE WHEN contains(content, 'spec') THEN 'Specification' WHEN contains(content, 'design') THEN 'Design Contribution' WHEN contains(content, 'project') THEN 'Project' WHEN contains(content, 'member') OR contains(content, 'partner') THEN 'Membership' ELSE 'General' END AS contribution FROM en")
def int_08_items(t):
    return rc.engagement_items(_engagement(t)).select("p_partkey", F.round("relevance", 6).alias("relevance"), "contribution")


def _engagement(t):
    more = F.element_at(F.array(*[F.lit(x) for x in ("Open Compute server specification", "rack design", "hyperscale project", "new member", "carbon and storage", "news")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    status = F.when(F.length("p_brand") % 2 == 0, "Gold").otherwise("Community")
    return t("part").select(F.col("p_brand").alias("company"), "p_partkey", F.lower(F.concat_ws(" ", "p_name", more)).alias("content"), F.when(F.col("p_partkey") % 3 == 0, "contribution").otherwise("news").alias("kind"), status.alias("status"))


@query("int_08_engagement_score", f"{_ENGAGE}, g AS (SELECT company, max(status) AS status, count_if(kind = 'news') AS n_news, count_if(kind = 'contribution') AS n_made, list_filter([" + ", ".join(f"CASE WHEN bool_or({' OR '.join(f'contains(content, {chr(39)}{w}{chr(39)})' for w in ws)}) THEN '{n}' END" for n, ws in STANDARDS) + "], lambda x: x IS NOT NULL) AS cats FROM en GROUP BY company), s AS (SELECT company, round(least(100, 30 * CASE status WHEN 'Gold' THEN 0.8 ELSE 0.2 END + least(5 * n_news, 30) + least(8 * n_made, 40)), 4) AS score, array_to_string(cats, ',') AS categories FROM g) SELECT company, score, CASE WHEN score >= 60 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END AS level, categories, rank() OVER (ORDER BY score DESC) AS place FROM s")
def int_08(t):
    return rc.engagement_score(_engagement(t), STANDARDS).select("company", F.round("score", 4).alias("score"), "level", F.array_join("categories", ",").alias("categories"), "place")


_ACTIONS = "ac AS (SELECT p_partkey, p_brand AS ticker, unnest([CASE p_partkey % 4 WHEN 0 THEN 'Ann raised target to $' || p_size WHEN 1 THEN 'Bob cut to $' || p_size WHEN 2 THEN 'Cid reiterates' ELSE 'Ann initiates at buy' END, 'Bob downgraded ' || p_type]) AS action, unnest([0, 1]) AS pos FROM part)"


def _actions(t):
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    first = F.element_at(F.array(F.concat(F.lit("Ann raised target to $"), size), F.concat(F.lit("Bob cut to $"), size), F.lit("Cid reiterates"), F.lit("Ann initiates at buy")), (i % 4 + 1).cast("int"))
    return t("part").select("p_partkey", F.col("p_brand").alias("ticker"), F.posexplode(F.array(first, F.concat(F.lit("Bob downgraded "), F.col("p_type")))).alias("pos", "action"))


@query("anl_02_ratings_feed", f"{_ACTIONS} SELECT p_partkey, pos, ticker, action, CASE WHEN regexp_matches(lower(action), 'raised|upgraded|initiates|buy|outperform|overweight') THEN 'green' WHEN regexp_matches(lower(action), 'cut|lowered|downgraded|underweight|sell|underperform') THEN 'red' ELSE 'grey' END AS colour FROM ac WHERE contains(lower(action), 'bob')")
def anl_02(t):
    return rc.ratings_feed(_actions(t), "Bob").select("p_partkey", F.col("pos").alias("pos"), "ticker", "action", "colour")


@query("anl_03_coverage_matrix", "cv AS (SELECT 'A' || (s_suppkey % 8) AS analyst, s_nationkey AS k FROM supplier), tk AS (SELECT n_nationkey AS k, n_name AS ticker, n_regionkey AS consensus FROM nation), an AS (SELECT DISTINCT analyst FROM cv) SELECT an.analyst, tk.ticker, EXISTS (SELECT 1 FROM cv WHERE cv.analyst = an.analyst AND cv.k = tk.k) AS covered, CASE WHEN EXISTS (SELECT 1 FROM cv WHERE cv.analyst = an.analyst AND cv.k = tk.k) THEN 'C' || tk.consensus END AS consensus FROM an, tk")
def anl_03(t):
    roster = t("supplier").select(F.concat(F.lit("A"), (F.col("s_suppkey") % 8).cast("string")).alias("analyst"), F.col("s_nationkey").alias("k"))
    tickers = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("ticker"), F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("consensus"))
    return rc.coverage_matrix(roster, tickers, "k").select("analyst", "ticker", "covered", "consensus")


@query("anl_05_merge_signals", "f AS (SELECT event_type, user_id % 40 AS url, event_id, value FROM events), d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_type, event_id) = 1) SELECT url, event_type, event_id, row_number() OVER (ORDER BY event_type, event_id) AS place FROM d QUALIFY place <= 25")
def anl_05(t):
    return rc.merge_signals(t("events").select((F.col("user_id") % 40).alias("url"), "event_type", "event_id"), "url", ["event_type", "event_id"], 25)


@query("anl_07_sentiment_timeline", (f"{_SCORE}, p AS (SELECT company, fiscal_year, quarter, round(avg(score), 6) AS sentiment FROM sc GROUP BY ALL) SELECT company, fiscal_year, quarter, sentiment, row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC, quarter DESC) AS back FROM p QUALIFY back <= 4").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def anl_07(t):
    rows = scored(_lang(t)).groupBy("company", "fiscal_year", "quarter").agg(F.round(F.avg("score"), 6).alias("sentiment"))
    by = Window.partitionBy("company").orderBy(F.desc("fiscal_year"), F.desc("quarter"))
    return rows.withColumn("back", F.row_number().over(by).cast("long")).where("back <= 4")


_FIRST = "make_date(y + CASE WHEN q = 4 THEN 1 ELSE 0 END, CASE q WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 10 ELSE 1 END, 1)"


@query("cal_04_generate_calendar", f"g AS (SELECT n_name AS company, CAST(year(o) AS INT) AS y, CAST(q AS INT) AS q FROM nation, (SELECT DISTINCT date_trunc('year', o_orderdate) AS o FROM orders) d, range(1, 5) r(q)), f AS (SELECT company, y, q, {_FIRST} AS d FROM g) SELECT company, y AS fiscal_year, q AS quarter, d + CAST((7 - (isodow(d) - 1)) % 7 + 14 AS INT) AS estimated FROM f")
def cal_04(t):
    years = t("orders").select(F.year("o_orderdate").alias("fiscal_year")).distinct()
    return rc.generate_calendar(t("nation").select(F.col("n_name").alias("company")), years)


@query("cal_06_upcoming_by_month", "s AS (SELECT DISTINCT c_mktsegment AS company, CAST(month(o_orderdate) AS INT) AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%'), n AS (SELECT *, (m - 11 + 12) % 12 AS diff FROM s) SELECT company, m AS expected_month, CASE WHEN m >= 11 THEN 2024 ELSE 2025 END AS expected_year, diff * 30 AS days_until FROM n WHERE diff <= 3")
def cal_06(t):
    rows = t("orders").where("o_orderpriority LIKE '1%'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("company"), F.month("o_orderdate").alias("expected_month")).distinct()
    return rc.upcoming_by_month(rows, 11, 2024)


@query("cal_07_apply_event_updates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 7 ELSE CAST(o_orderdate AS DATE) END AS day, o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 AS confirmed FROM orders WHERE o_orderkey % 10 < 8 UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), false FROM orders WHERE o_orderkey % 10 >= 8")
def cal_07(t):
    """Known events with moves (every fourth) and confirmations (every sixth); later rows are added."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    known, added = rows.where("id % 10 < 8").withColumn("confirmed", F.lit(False)), rows.where("id % 10 >= 8").withColumn("confirmed", F.lit(False))
    moved = known.where("id % 4 = 0").select("id", F.date_add("day", 7).alias("day"), F.lit(True).alias("confirmed"))
    sure = known.where("id % 6 = 0").select("id", F.lit(None).cast("date").alias("day"), F.lit(True).alias("confirmed"))
    return rc.apply_event_updates(known, moved.unionByName(sure).unionByName(added))


_GUIDE = "rk AS (SELECT entity AS company, value, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS n FROM yearly), ac AS (SELECT company, max(CASE WHEN n = 2 THEN value END) AS actual, max(CASE WHEN n = 1 THEN value END) AS forecast FROM rk GROUP BY company), re AS (SELECT company, actual, CASE WHEN forecast IS NULL OR (actual IS NOT NULL AND forecast <= actual) THEN NULL ELSE forecast END AS forecast FROM ac)"


def _guided(t):
    """The newest year of each company is its forecast, the one before it its actual."""
    rows = t("yearly").withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("year"))))
    at = lambda n, name: rows.where(F.col("n") == n).select(F.col("entity").alias("company"), F.col("value").alias(name))
    return br.reconcile_guidance(at(2, "actual"), at(1, "forecast"))


@query("hyp_02_reconcile_guidance", f"{_GUIDE} SELECT company, round(actual, 2) AS actual, round(forecast, 2) AS forecast, round(CASE WHEN actual > 0 AND forecast IS NOT NULL THEN (forecast - actual) / actual * 100 END, 6) AS growth_pct FROM re", ("yearly",))
def hyp_02(t):
    return _guided(t).select("company", *[F.round(c, 2).alias(c) for c in ("actual", "forecast")], F.round("growth_pct", 6).alias("growth_pct"))


@query("hyp_02_guidance_totals", f"{_GUIDE}, g AS (SELECT *, CASE WHEN actual > 0 AND forecast IS NOT NULL THEN (forecast - actual) / actual * 100 END AS growth FROM re) SELECT round(sum(forecast), 2) AS total, round(avg(growth), 6) AS mean_growth, max_by(company, growth) AS fastest FROM g", ("yearly",))
def hyp_02_totals(t):
    return br.guidance_totals(_guided(t)).select(F.round("total", 2).alias("total"), F.round("mean_growth", 6).alias("mean_growth"), "fastest")


# Streams over the files that are there, each against its batch result.


def _closed_windows(spark, sf_dir):
    """Sliding windows of 7, 30 and 60 days that the watermark has passed; open ones are not out."""
    out = None
    for size in (7, 30, 60):
        stream = jobs.window_counts_stream(jobs.read_stream(spark, sf_dir, "events"), "event_type", "ts", f"{size} days", "1 day", "0 seconds")
        part = jobs.collect_stream(spark, stream, f"windows-{size}").select(F.lit(size).alias("size"), F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
        out = part if out is None else out.unionByName(part)
    return out


register("str_03_closed_windows", _closed_windows, "m AS (SELECT max(ts) AS top FROM events), w AS (SELECT 7 AS size UNION ALL SELECT 30 UNION ALL SELECT 60), g AS (SELECT size, event_type, CAST(s AS TIMESTAMP) AS start FROM w, (SELECT DISTINCT event_type FROM events) k, (SELECT unnest(generate_series(DATE '2023-10-01', DATE '2024-02-28', INTERVAL 1 DAY)) AS s) d) SELECT g.size, g.start, e.event_type, count(*) AS n FROM g JOIN events e ON e.event_type = g.event_type AND e.ts >= g.start AND e.ts < g.start + to_days(CAST(g.size AS INT)), m WHERE g.start + to_days(CAST(g.size AS INT)) <= m.top GROUP BY ALL")


register("str_04_session_stream", lambda s, d: jobs.collect_stream(s, jobs.session_stream(jobs.read_stream(s, d, "events"), "user_id", "ts", "24 hours", "0 seconds"), "sessions").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), "g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), z AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, start, n FROM z WHERE last + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events)")


def _alert_stream(spark, sf_dir):
    """One alert a user and type while it is not dismissed: a value under 5 dismisses; views of every fifth user are live already."""
    events = jobs.read_stream(spark, sf_dir, "events").where("value > 60 OR value < 5").select("user_id", "event_type", "event_id", F.expr("value < 5").alias("dismissed"))
    live = table(spark, sf_dir, "events").where("event_type = 'view' AND user_id % 5 = 0").select("user_id", "event_type").distinct()
    return jobs.alert_stream(spark, events, live, ["user_id", "event_type"], "event_id", "alerts")


register("str_06_alert_stream", _alert_stream, "r AS (SELECT user_id, event_type, event_id, value < 5 AS gone FROM events WHERE value > 60 OR value < 5), b AS (SELECT *, lag(gone) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM r) SELECT user_id, event_type, event_id FROM b WHERE NOT gone AND coalesce(before, NOT (event_type = 'view' AND user_id % 5 = 0))")


def _late_rows(spark, sf_dir):
    """Even events arrive first, then odd ones: those that lie five days and more behind what has been seen are late."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.late_rows(spark, [rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")], "ts", dt.timedelta(days=5)).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


register("str_07_late_rows", _late_rows, "h AS (SELECT max(ts) AS top FROM events WHERE event_id % 2 = 0) SELECT event_id, ts FROM events, h WHERE event_id % 2 = 1 AND ts < top - INTERVAL 5 DAY")


@query("udf_01_pluggable_retriever", "a AS (SELECT chunk_id, company, content FROM chunks), qs AS (SELECT item_id AS query_id, text FROM benchmark), tq AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''))) AS term FROM qs), nq AS (SELECT query_id, count(*) AS k FROM tq GROUP BY query_id), td AS (SELECT DISTINCT chunk_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '\\s+'), lambda x: x <> '')) AS term FROM a), o AS (SELECT query_id, chunk_id AS doc_id, count(*) / k AS score FROM td JOIN tq USING (term) JOIN nq USING (query_id) GROUP BY query_id, chunk_id, k), p AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM o QUALIFY place <= 10), l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(length(content) AS DOUBLE) DESC, doc_id) AS place FROM qs, (SELECT chunk_id AS doc_id, content FROM a WHERE content IS NOT NULL ORDER BY length(content) DESC, chunk_id LIMIT 10) z QUALIFY place <= 10), u AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + place)), 12) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM l) GROUP BY ALL) SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM u QUALIFY place <= 5", ("chunks",))
def udf_01(t):
    """Two retrievers of one protocol, fused: word overlap, and a user's own that offers the longest chunks."""
    queries = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = t("chunks").select("chunk_id", "company", "content")
    return hk.fused([hk.OverlapRetriever(), hk.LongestRetriever()], queries, chunks, 10, 5).withColumn("score", F.round("score", 9))


@query("udf_02_pluggable_embedder")
def udf_02(t):
    """A user's embedder (here the hashing one) over every chunk, then neighbours of every hundredth."""
    return hk.nearest(t("chunks").select("chunk_id", "content"), hk.hashing_embedder(64), 5)


@query("udf_03_pluggable_scorer", "w AS (SELECT chunk_id, company, filing_type, list_filter(regexp_split_to_array(coalesce(content, ''), '\\s+'), lambda x: x <> '') AS ws FROM chunks), c AS (SELECT chunk_id, company, filing_type, ws[b + 1: b + 450] AS part FROM (SELECT *, unnest(range(0, greatest(len(ws), 1), 450)) AS b FROM w) z), s AS (SELECT chunk_id, company, filing_type, avg(CASE WHEN len(part) > 0 THEN len(list_filter(part, lambda x: lower(x) IN ('the', 'and', 'with'))) / len(part) - len(list_filter(part, lambda x: lower(x) IN ('of', 'by', 'to'))) / len(part) ELSE 0 END) AS score FROM c GROUP BY ALL) SELECT company, round(sum(score * {w}) / sum({w}), 6) AS sentiment, count(*) AS n FROM s GROUP BY company".format(w=_W), ("chunks",))
def udf_03(t):
    """A user's scorer of probabilities over pieces of 450 words, averaged a chunk, weighted a company."""
    return hk.company_scores(t("chunks"), hk.share_scorer(POS, NEG), 450).withColumn("sentiment", F.round("sentiment", 6))
