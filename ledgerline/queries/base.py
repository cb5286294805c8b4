"""Given tables, the views derived from them, and the registry of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Views in SQL that both engines run unchanged; later ones may use earlier ones.
VIEWS = {
    "chunks": """SELECT doc_id AS chunk_id, source AS company, text AS content, lang,
 2020 + CAST(doc_id % 5 AS INT) AS fiscal_year, 1 + CAST(doc_id % 4 AS INT) AS quarter,
 CASE doc_id % 6 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN 'Earnings Transcript' WHEN 4 THEN 'Press Release' ELSE 'Other' END AS filing_type,
 CASE doc_id % 3 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' ELSE 'table' END AS chunk_type, doc_id - doc_id % 3 AS parent_id FROM documents""",
    "facts": """SELECT entity, CASE WHEN y % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, make_date(y, 1, 1) AS start_d,
 CASE q WHEN 1 THEN make_date(y, 3, 31) WHEN 2 THEN make_date(y, 6, 30) WHEN 3 THEN make_date(y, 9, 30) ELSE make_date(y, 12, 31) END AS end_d,
 CAST(sum(v) OVER (PARTITION BY entity, y ORDER BY q) AS DOUBLE) AS val, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form
 FROM (SELECT c.c_mktsegment AS entity, CAST(year(o.o_orderdate) AS INT) AS y, CAST(quarter(o.o_orderdate) AS INT) AS q, sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS v
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, year(o.o_orderdate), quarter(o.o_orderdate)) t""",
    "calendar": """SELECT DISTINCT c_mktsegment AS company, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 8 WHEN 'FURNITURE' THEN 12 WHEN 'HOUSEHOLD' THEN 9 ELSE 6 END AS fy_end_month FROM customer""",
    "news": """SELECT u.page_id * 2 + u.copy AS input_pos, u.url, u.title, e.ts AS published,
 CASE u.page_id % 3 WHEN 0 THEN 'brave' WHEN 1 THEN 'company_news_rss' ELSE 'market_commentary_rss' END AS source_type,
 CASE (u.page_id + u.copy) % 4 WHEN 0 THEN 'official_name' WHEN 1 THEN 'stock_news' WHEN 2 THEN 'industry_news' ELSE 'supporting_query' END AS intent
 FROM (SELECT page_id, url, title, 0 AS copy FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) p1
 UNION ALL SELECT page_id, concat(regexp_replace(url, '#.*$', ''), '#dup') AS url, title, 1 AS copy FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) p2 WHERE page_id % 10 = 0) u
 JOIN events e ON e.event_id = u.page_id""",
    "metric_text": """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q_true,
 concat('Capital expenditures of $', CAST(CAST(l_quantity AS INT) AS STRING), '.5 million; revenue was $', CAST(l_linenumber AS STRING),
 '.2 billion. Gross margin of ', CAST(CAST(round(l_discount * 100) AS INT) AS STRING), '%.') AS content FROM lineitem""",
    "facilities": """SELECT s.s_suppkey AS id, concat('Company', CAST(s.s_suppkey % 6 AS STRING)) AS company, n.n_name AS city, r.r_name AS region,
 CASE WHEN s.s_suppkey % 9 = 0 THEN 'Headquarters' ELSE 'Manufacturing' END AS facility_type
 FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "alerts": """SELECT event_id AS id, concat('Company', CAST(user_id % 6 AS STRING)) AS company, event_type AS type,
 CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, ts AS created_at, event_id % 2 = 0 AS is_read, event_id % 7 = 0 AS dismissed FROM events""",
    "questions": """SELECT n_nationkey AS query_id, CASE n_nationkey % 5
 WHEN 0 THEN concat('What was revenue of ', n_name, ' in FY2024 Q1 to Q3?') WHEN 1 THEN concat('Compare capex of ', n_name, ' vs NATION_1 for the last three quarters')
 WHEN 2 THEN concat('Summarize ', n_name, ' outlook') WHEN 3 THEN concat('Show a table of gross profit for ', n_name, ' FY23')
 ELSE concat('how much free cash flow did ', n_name, ' have in the past 4 years') END AS question FROM nation""",
    "yearly": """SELECT c.c_mktsegment AS entity, CAST(year(o.o_orderdate) AS INT) AS year, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, year(o.o_orderdate)""",
    "metric_values": """SELECT c.c_mktsegment AS entity, CASE o.o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'capex' ELSE 'operating_income' END AS metric,
 CASE o.o_orderstatus WHEN 'O' THEN 'cashflow' ELSE 'income' END AS statement, last_day(CAST(o.o_orderdate AS DATE)) AS end_d, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, o.o_orderstatus, last_day(CAST(o.o_orderdate AS DATE))""",
}
_NEEDS = {"chunks": ["documents"], "facts": ["orders", "customer"], "calendar": ["customer"], "news": ["pages", "events"], "metric_text": ["lineitem"], "facilities": ["supplier", "nation", "region"], "alerts": ["events"], "questions": ["nation"], "yearly": ["orders", "customer"], "metric_values": ["orders", "customer"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view."""
    if name in VIEWS:
        for t in _NEEDS[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """Register a query that takes (spark, sf_dir), and its SQL (which may begin with more common tables) over ``views``."""
    QUERIES[name] = build
    if sql is None:
        return
    body = sql.strip().removeprefix("RECURSIVE ")
    head = "WITH RECURSIVE " if sql.startswith("RECURSIVE ") else "WITH "
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    if not heads:
        ORACLES[name] = body if body.upper().startswith("SELECT") else head + body
    else:
        ORACLES[name] = f"{head}{heads}{' ' if body.upper().startswith('SELECT') else ', '}{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of the tables' reader as a query, with its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        register(name, lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t)), sql, views)
        return f

    return add
