"""Sources, file names, sections, tables and passages over texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import filings as fg
from ledgerline.operators import chunking as ch
from ledgerline.operators import passages as ps
from ledgerline.operators import xbrl as xb
from ledgerline.queries.base import QUERIES, VIEWS, query
from ledgerline.sources import files as fl
from ledgerline.workdir import new_path

_LF = "chr(10)"
VIEWS |= {
    "named_filings": """SELECT o_orderkey, concat(CASE o_orderkey % 10 WHEN 0 THEN 'form20-F_' WHEN 1 THEN 'FORM_6k_' WHEN 2 THEN '10-K_' WHEN 3 THEN 'x10q_' WHEN 4 THEN '8-k_' WHEN 5 THEN 'Annual_Report_' ELSE 'scan_' END, CAST(o_custkey AS STRING), '.pdf') AS name,
 concat(CASE o_orderkey % 4 WHEN 0 THEN 'Annual Report. For the fiscal year ended 2021. ' WHEN 1 THEN 'QUARTERLY REPORT for the quarter ended June. ' WHEN 2 THEN 'FORM 10-K ' ELSE 'quarterly period ended; annual report on form 10-k ' END, o_orderpriority) AS content FROM orders""",
    "dated_names": """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN concat('report_FY', CAST(year(o_orderdate) AS STRING), '_Q', CAST(quarter(o_orderdate) AS STRING), '.htm') WHEN 1 THEN concat('Q', CAST(quarter(o_orderdate) AS STRING), '-fy', right(CAST(year(o_orderdate) AS STRING), 2), '.pdf')
 WHEN 2 THEN concat('X_', CAST(year(o_orderdate) AS STRING), '_10Q_Q', CAST(quarter(o_orderdate) AS STRING)) WHEN 3 THEN concat('call', right(CAST(year(o_orderdate) AS STRING), 2), 'q', CAST(quarter(o_orderdate) AS STRING)) WHEN 4 THEN concat('8K_', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), right(CAST(year(o_orderdate) AS STRING), 2), '.pdf')
 WHEN 5 THEN concat('filed ', CAST(CAST(o_orderdate AS DATE) AS STRING), '.htm') WHEN 6 THEN concat('Q', CAST(quarter(o_orderdate) AS STRING), '_', CAST(year(o_orderdate) AS STRING)) ELSE 'a5c1-noname.pdf' END AS name,
 CASE WHEN o_orderkey % 9 = 7 THEN concat('For the fiscal year ended', chr(10), 'May 31, 20', lpad(CAST(o_orderkey % 30 AS STRING), 2, '0')) ELSE 'nothing of use' END AS content FROM orders""",
    "sectioned": """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN coalesce(text, '') ELSE concat(CASE WHEN doc_id % 3 = 0 THEN concat('Opening words', chr(10)) ELSE '' END,
 CASE doc_id % 8 WHEN 0 THEN 'Item 1. Business' WHEN 1 THEN 'ITEM 1A RISK FACTORS' WHEN 2 THEN 'item 2. properties' WHEN 3 THEN 'Item 7. Management view' WHEN 4 THEN 'Consolidated Statements of Operations' WHEN 5 THEN 'our consolidated balance sheets' WHEN 6 THEN 'Liquidity and capital resources' ELSE 'Critical accounting matters' END, chr(10), coalesce(text, ''), chr(10),
 CASE doc_id % 6 WHEN 0 THEN 'Capital expenditures' WHEN 1 THEN 'Results of operations' WHEN 2 THEN 'Consolidated statements of cash flows' WHEN 3 THEN 'Item 8. Financial statements' WHEN 4 THEN 'Item 7A. Quantitative matters' ELSE 'Consolidated statement of comprehensive income' END, chr(10), 'closing words of this filing') END AS text FROM documents""",
    "statement_text": """SELECT o_orderkey, concat('Cash flows from investing activities', chr(10), CASE o_orderkey % 4 WHEN 0 THEN 'Purchases of property and equipment' WHEN 1 THEN 'Capital expenditures' WHEN 2 THEN 'acquisition of property' ELSE 'Proceeds of sales' END, '   (', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ')', chr(10), chr(10), 'Other 12,345 and 99', chr(10), 'Net change ', CAST(o_custkey AS STRING), chr(10), 'Total 54,321.5') AS content FROM orders""",
    "cash_text": """SELECT doc_id, concat(coalesce(text, ''), ' Capital expenditures were planned. ', left(coalesce(text, ''), 300), CASE WHEN doc_id % 2 = 0 THEN ' Cash flows from investing activities: purchases of property (12,345), operating activities. ' ELSE ' No statement here. ' END, coalesce(text, '')) AS content FROM documents""",
    "signal_text": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN concat('We are building a new facility for $', CAST(o_custkey AS STRING), ' million') WHEN 1 THEN 'Capex of $20 was spent on equipment' WHEN 2 THEN 'The merger closes soon' WHEN 3 THEN 'Hyperscale demand and data center growth; we invest' WHEN 4 THEN 'Nothing to see'
 WHEN 5 THEN 'Property, plant and PP&E rose' WHEN 6 THEN '12 billion dollars for a campus' ELSE concat('Equipment of ', o_orderpriority) END AS content FROM orders""",
    "place_text": """SELECT s_suppkey, concat('Our manufacturing plant in ', n_name, ' ships goods. ', CASE s_suppkey % 4 WHEN 0 THEN 'The corporate office is near ' WHEN 1 THEN 'A design center opened at ' WHEN 2 THEN 'A warehouse stands in ' ELSE 'We sold land in ' END, n_name, '; see also ', r_name, ' and ', n_name, '0.') AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "place_lines": """SELECT s_suppkey, concat(CASE s_suppkey % 4 WHEN 0 THEN 'Corporate Office' WHEN 1 THEN 'Design and innovation' WHEN 2 THEN 'Logistics hub' ELSE 'Works' END, chr(10), ' ', n_name, CASE s_suppkey % 3 WHEN 0 THEN ', Main Street 5' WHEN 1 THEN ' (Plant 2)' ELSE '' END, chr(10), '12345', chr(10), 'Privacy in ', n_name, chr(10), chr(10), 'x', chr(10), n_name, chr(10), 'We also serve ', n_name) AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "table_context": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'CONSOLIDATED STATEMENTS OF CASH FLOWS' WHEN 1 THEN concat('Schedule of leases ', CAST(o_custkey AS STRING)) WHEN 2 THEN concat('see Note ', CAST(o_custkey AS STRING), ' on debt') WHEN 3 THEN '' WHEN 4 THEN 'Consolidated Balance Sheets, in millions of dollars and without parts of the group' WHEN 5 THEN 'Results of operations' ELSE 'Statement of changes in equity (unaudited)' END AS context FROM orders""",
    "exhibits": """SELECT page_id, concat(url, CASE page_id % 4 WHEN 0 THEN '/Q3_Transcript.htm' WHEN 1 THEN '/ex991.htm' ELSE '/other.htm' END) AS name, CASE page_id % 5 WHEN 0 THEN 'EX-99.1' WHEN 1 THEN 'EX-99' WHEN 2 THEN 'EX-10.1' WHEN 3 THEN 'EX-99.2' ELSE '10-Q' END AS kind FROM pages""",
}
from ledgerline.queries.base import _NEEDS  # noqa: E402

_NEEDS |= {"named_filings": ["orders"], "dated_names": ["orders"], "sectioned": ["documents"], "statement_text": ["orders"], "cash_text": ["documents"], "signal_text": ["orders"], "place_text": ["supplier", "nation", "region"], "place_lines": ["supplier", "nation"], "table_context": ["orders"], "exhibits": ["pages"]}


def _case(column, rules, default, flags=""):
    """SQL of a cascade of (pattern, value)."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{flags}{p}') THEN {text(v)}" for p, v in rules) + f" ELSE {default} END"


@query("src_01_read_documents", "n AS (SELECT doc_id, source AS company, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS filing_type, text FROM documents), f AS (SELECT company, filing_type, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM (SELECT *, (row_number() OVER (PARTITION BY company, filing_type ORDER BY doc_id) - 1) // 20 AS part FROM n) GROUP BY company, filing_type, part) SELECT * FROM f")
def src_01(t):
    """Documents laid out as a tree company/type/file (20 texts a file), read back one row a file."""
    docs = t("documents")
    kind = F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs.select(F.col("source").alias("company"), kind.alias("filing_type"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    root = new_path(docs.sparkSession, "document-tree")
    rows.repartition("company", "filing_type").sortWithinPartitions("company", "filing_type", "doc_id").drop("doc_id").write.option("maxRecordsPerFile", 20).partitionBy("company", "filing_type").text(root)
    out = fl.read_documents(docs.sparkSession, root)
    bare = lambda c: F.regexp_replace(c, "^[^=]*=", "")
    return out.select(bare("company").alias("company"), bare("filing_type").alias("filing_type"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


_UNITS = "fu AS (SELECT entity, concept, start_d, end_d, round(val, 2) AS val, form FROM facts UNION ALL SELECT entity, 'EarningsPerShare', start_d, end_d, round(val / 1e6, 2), form FROM facts)"


def _nested(t):
    """Facts as they are filed: Revenues in USD and, wrongly doubled, in USD/shares; earnings per share in USD/shares alone."""
    facts = t("facts")
    fact = lambda v: F.sort_array(F.collect_list(F.struct(F.col("start_d").cast("string").alias("start"), F.col("end_d").cast("string").alias("end"), v.alias("val"), "form")))
    usd = facts.groupBy("entity", "concept").agg(F.create_map(F.lit("USD"), fact(F.col("val")), F.lit("USD/shares"), fact(F.col("val") * 2)).alias("units"))
    shares = facts.groupBy("entity").agg(F.create_map(F.lit("USD/shares"), fact(F.col("val") / 1e6)).alias("units")).select("entity", F.lit("EarningsPerShare").alias("concept"), "units")
    return usd.unionByName(shares)


@query("src_04_read_company_facts", f"{_UNITS} SELECT * FROM fu", ("facts",))
def src_04(t):
    """Company facts written as JSON in the filed nesting, read back and flattened."""
    nested = _nested(t).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("c")))).alias("concepts"))
    spark = nested.sparkSession
    path = new_path(spark, "company-facts")
    nested.write.json(path)
    return xb.facts_from_map(fl.read_company_facts(spark, path)).select("entity", "concept", "start_d", "end_d", F.round("val", 2).alias("val"), "form")


@query("xbr_01_unit_preference", f"{_UNITS} SELECT * FROM fu", ("facts",))
def xbr_01_units(t):
    nested = _nested(t).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("concept", "units"))).alias("concepts"))
    return xb.facts_from_map(nested).select("entity", "concept", "start_d", "end_d", F.round("val", 2).alias("val"), "form")


@query("src_06_classify_exhibits", "SELECT page_id, CASE WHEN contains(lower(name), 'transcript') THEN 'Earnings Transcript' ELSE 'Press Release' END AS kind FROM exhibits WHERE contains(lower(name), 'transcript') OR kind IN ('EX-99.1', 'EX-99.2', 'EX-99')", ("exhibits",))
def src_06(t):
    return t("exhibits").select("page_id", fg.exhibit_kind(F.col("name"), F.col("kind")).alias("kind")).where("kind IS NOT NULL")


@query("src_14_write_report", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(event_type) AS last_type FROM events GROUP BY user_id")
def src_14(t):
    """A result set as CSV with a header, read back with its own schema."""
    report = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_type").alias("last_type"))
    path = new_path(report.sparkSession, "report")
    fl.write_report(report, path, "csv")
    return report.sparkSession.read.schema(report.schema).option("header", "true").csv(path)


_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"


@query("src_16_ingest_summary", f"w AS (SELECT source, {_WORDS} AS n FROM documents) SELECT source, CAST(count_if(n > 0) AS BIGINT) AS files_processed, CAST(sum(CASE WHEN n > 0 THEN ceil(n / 200) ELSE 0 END) AS BIGINT) AS chunks_added, CAST(count_if(n = 0) AS BIGINT) AS errors FROM w GROUP BY source")
def src_16(t):
    """Files, chunks (of 200 new words each) and errors (no words) of an ingest job, by source."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return fl.ingest_summary(t("documents").select("source", n.alias("n")).select("source", F.when(F.col("n") > 0, F.ceil(F.col("n") / 200)).alias("chunks"), F.when(F.col("n") == 0, "no words").alias("error")), "source")


@query("fis_03_filename_families", rf"""p AS (SELECT o_orderkey, name, content, regexp_extract(name, '[Ff][Yy](\d{{2,4}})[_\-]?[Qq](\d)', ['y', 'q']) AS a, regexp_extract(name, '[Qq](\d)[_\-]?[Ff][Yy](\d{{2,4}})', ['q', 'y']) AS b, regexp_extract(name, '(\d{{4}}).*[Qq](\d)', ['y', 'q']) AS c, regexp_extract(name, '(\d{{2}})[Qq](\d)', ['y', 'q']) AS d, regexp_extract(name, '(?:8[Kk]|10[Kk]|10[Qq])_(\d{{2}})(\d{{2}})', ['m', 'y']) AS e, regexp_extract(name, '(\d{{4}})-(\d{{2}})-(\d{{2}})', ['y', 'm', 'x']) AS f, regexp_extract(name, '[Qq](\d)[_\-](\d{{4}})', ['q', 'y']) AS g, regexp_extract(content, '(?is)fiscal\s*year\s*ended\s*.*?(20\d{{2}})', 1) AS h FROM dated_names),
r AS (SELECT o_orderkey, CASE WHEN a.y <> '' THEN a.y WHEN b.y <> '' THEN b.y WHEN c.y <> '' THEN c.y WHEN d.y <> '' THEN d.y WHEN e.y <> '' THEN e.y WHEN f.y <> '' AND o_orderkey % 3 = 0 THEN CAST(TRY_CAST(f.y AS INT) + CASE WHEN TRY_CAST(f.m AS INT) >= 4 THEN 1 ELSE 0 END AS VARCHAR) WHEN f.y <> '' AND o_orderkey % 3 = 1 THEN f.y WHEN g.y <> '' THEN g.y WHEN h <> '' THEN h END AS y, CASE WHEN a.y <> '' THEN a.q WHEN b.y <> '' THEN b.q WHEN c.y <> '' THEN c.q WHEN d.y <> '' THEN d.q WHEN e.y <> '' THEN CAST((TRY_CAST(e.m AS INT) + 10) % 12 // 3 + 1 AS VARCHAR) WHEN f.y <> '' AND o_orderkey % 3 = 0 THEN CASE WHEN TRY_CAST(f.m AS INT) IN (7, 8) THEN '1' WHEN TRY_CAST(f.m AS INT) IN (10, 11) THEN '2' WHEN TRY_CAST(f.m AS INT) IN (1, 2) THEN '3' WHEN TRY_CAST(f.m AS INT) IN (5, 6) THEN '4' END WHEN f.y <> '' AND o_orderkey % 3 = 1 THEN CAST((TRY_CAST(f.m AS INT) + 2) // 3 AS VARCHAR) WHEN g.y <> '' THEN g.q END AS q FROM p)
SELECT o_orderkey, coalesce('FY' || right(y, 2), 'Unknown') AS fy, coalesce('Q' || q, '') AS quarter FROM r""", ("dated_names",))
def fis_03_families(t):
    company = F.concat(F.lit("C"), (F.col("o_orderkey") % 3).cast("string"))  # C0 files by fiscal year, C1 names the period's end
    fy, quarter = fg.fiscal_name(F.col("name"), F.col("content"), company, ("C0",), ("C1",))
    return t("dated_names").select("o_orderkey", fy.alias("fy"), quarter.alias("quarter"))


def _score(patterns):
    return " + ".join(f"CAST(regexp_matches(left(content, 5000), '(?i){p}') AS INT)" for p in patterns)


@query("chk_03_detect_filing_type", f"s AS (SELECT *, {_score(fg.ANNUAL)} AS a, {_score(fg.QUARTERLY)} AS q FROM named_filings) SELECT o_orderkey, {_case('lower(name)', fg.NAME_RULES, chr(39).join(['CASE WHEN a >= 2 AND a >= q THEN ', '10-K', ' WHEN q >= 2 THEN ', '10-Q', ' ELSE ', 'Other', ' END']))} AS filing_type FROM s", ("named_filings",))
def chk_03(t):
    return t("named_filings").select("o_orderkey", fg.filing_type(F.col("name"), F.col("content")).alias("filing_type"))


_NAMES, _LEVELS = [(p, n) for p, n, _ in fg.SECTIONS], [(p, lv) for p, _, lv in fg.SECTIONS]
_SECTIONS = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM sectioned), h AS (SELECT *, {_case('upper(trim(line))', _NAMES, 'NULL')} AS name, {_case('upper(trim(line))', _LEVELS, 'NULL')} AS level FROM l), s AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h), g AS (SELECT doc_id, section, max(name) AS name, max(level) AS level, string_agg(line, chr(10) ORDER BY i) AS content FROM s GROUP BY doc_id, section), se AS (SELECT doc_id, section AS section_idx, coalesce(name, CASE WHEN max(section) OVER (PARTITION BY doc_id) = 0 THEN 'Full Document' ELSE 'Document Start' END) AS section_header, coalesce(level, 0) AS section_level, content FROM g QUALIFY section > 0 OR max(section) OVER (PARTITION BY doc_id) = 0 OR trim(content) <> '')"


@query("chk_04_section_headers", f"{_SECTIONS} SELECT doc_id, section_idx, section_header, section_level, md5(content) AS digest FROM se", ("sectioned",))
def chk_04_headers(t):
    return ps.section_headers(t("sectioned"), "doc_id", "text").select("doc_id", "section_idx", "section_header", "section_level", F.md5("content").alias("digest"))


@query("chk_05_outline_levels", f"{_SECTIONS} SELECT doc_id, i, name, level FROM h WHERE name IS NOT NULL", ("sectioned",))
def chk_05_levels(t):
    lines = t("sectioned").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    upper = F.upper(F.trim("line"))
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), fg.first_match(upper, fg.SECTIONS, F.lit(None).cast("string")).alias("name"), fg.first_match(upper, _LEVELS, F.lit(None).cast("int")).alias("level")).where("name IS NOT NULL")


@query("chk_10_section_parents", rf"{_SECTIONS}, w AS (SELECT *, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS ws FROM se), c AS (SELECT *, unnest(range(0, greatest(len(ws), 1), 250)) AS b FROM w), k AS (SELECT doc_id, section_idx, CAST(b // 250 AS BIGINT) AS child_idx, section_header, array_to_string(ws[b + 1: b + 250], ' ') AS content FROM c WHERE len(ws[b + 1: b + 250]) >= 80) SELECT doc_id, section_idx, child_idx, section_header, md5(content) AS digest FROM k UNION ALL SELECT doc_id, section_idx, -1, section_header, md5(content) FROM se", ("sectioned",))
def chk_10(t):
    return ps.section_parents(t("sectioned"), "doc_id", "text").select("doc_id", "section_idx", "child_idx", "section_header", F.md5("content").alias("digest"))


_INITCAP = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"
_TN = ["(?:consolidated\\s+)?statements?\\s+of\\s+[\\w\\s]+", "(?:schedule|table)\\s+[\\w\\s]+", "note\\s+\\d+[\\w\\s]*"]


@query("chk_15_table_name", "SELECT o_orderkey, CASE WHEN context = '' THEN 'Unnamed Table' " + " ".join(f"WHEN regexp_matches(lower(context), '{p}') THEN " + _INITCAP.format(x=f"regexp_extract(lower(context), '{p}')") for p in _TN) + " ELSE trim(left(context, 50)) END AS table_name FROM table_context", ("table_context",))
def chk_15(t):
    return t("table_context").select("o_orderkey", fg.table_name(F.col("context")).alias("table_name"))


@query("chk_16_table_section", f"SELECT o_orderkey, {_case('upper(context)', _NAMES, chr(39) + 'Financial Tables' + chr(39))} AS section FROM table_context", ("table_context",))
def chk_16(t):
    return t("table_context").select("o_orderkey", fg.section_of(F.col("context")).alias("section"))


_LABEL = "capital expenditure|purchases? of property|acquisition of property"


@query("txt_04_capex_candidates", rf"l AS (SELECT o_orderkey, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM statement_text), c AS (SELECT o_orderkey, line, trim(s) AS s, array_to_string(list_filter([trim(lag(s, 2) OVER w), trim(lag(s) OVER w), trim(s), trim(lead(s) OVER w), trim(lead(s, 2) OVER w)], lambda x: coalesce(x, '') <> ''), ' | ') AS context FROM l WINDOW w AS (PARTITION BY o_orderkey ORDER BY line)), n AS (SELECT o_orderkey, line, left(context, 250) AS context, CAST(replace(unnest(regexp_extract_all(context, '[\(\$]?\s*([0-9]{{2,}},?[0-9]{{3}}(?:\.[0-9]+)?)\s*\)?', 1)), ',', '') AS DOUBLE) AS value FROM c WHERE regexp_matches(s, '(?i){_LABEL}')) SELECT * FROM n WHERE value > 10 AND value < 1000000", ("statement_text",))
def txt_04(t):
    return ps.capex_candidates(t("statement_text"), "o_orderkey", "content", _LABEL)


_CTX = ["investing activities", "operating activities", "financing activities", "cash flows from", "statements of cash flows"]
_AT = "list_transform(range(1, len(p)), lambda j: CAST(list_sum(list_transform(p[1:j], lambda z: length(z))) + (j - 1) * {n} + 1 AS BIGINT))"


def _labelled(label, i):
    return f"SELECT doc_id, low, {i} AS label, unnest({_AT.format(n=len(label))}) AS pos FROM (SELECT doc_id, lower(content) AS low, string_split(lower(content), '{label}') AS p FROM cash_text) x{i}"


@query("txt_07_statement_window", "h AS (" + " UNION ALL ".join(_labelled(x, i) for i, x in enumerate(["capital expenditures", "purchases of property"])) + "), s AS (SELECT doc_id, label, pos, 2 * (" + " + ".join(f"CAST(contains(substring(low, CAST(greatest(pos - 1000, 1) AS BIGINT), CAST(least(pos - 1, 1000) + 1000 AS BIGINT)), '{w}') AS INT)" for w in _CTX) + ") + CASE WHEN regexp_matches(substring(low, pos, 200), '\\d') THEN 3 ELSE 0 END AS score FROM h) SELECT b.doc_id, b.pos, b.score, md5(substring(c.content, CAST(greatest(b.pos - 5000, 1) AS BIGINT), CAST(least(b.pos - 1, 5000) + 5000 AS BIGINT))) AS digest FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label, pos) = 1) b JOIN cash_text c USING (doc_id)", ("cash_text",))
def txt_07(t):
    return ps.best_window(t("cash_text"), "doc_id", "content", ["capital expenditures", "purchases of property"], _CTX).select("doc_id", F.col("at").alias("pos"), "score", F.md5("passage").alias("digest"))


@query("txt_13_detect_signal", "f AS (SELECT o_orderkey, lower(content) AS low, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(content), '{p}') THEN '{n}' END" for n, p in fg.SIGNALS) + f"], lambda x: x IS NOT NULL) AS tr FROM signal_text) SELECT o_orderkey, array_to_string(tr, ',') AS triggers, {_case('low', [(p, n) for n, p in fg.SIGNAL_TYPES], chr(39) + 'UNKNOWN' + chr(39))} AS event_type, CASE WHEN len(tr) >= 2 THEN 0.8 ELSE 0.5 END AS confidence FROM f WHERE len(tr) > 0", ("signal_text",))
def txt_13(t):
    families, kind, confidence = fg.signal(F.col("content"))
    return t("signal_text").where(F.size(families) > 0).select("o_orderkey", F.array_join(families, ",").alias("triggers"), kind.alias("event_type"), confidence.alias("confidence"))


def _gazetteer(t):
    return t("nation").select(F.lower("n_name").alias("city"))


@query("txt_14_location_mentions", rf"m AS (SELECT s_suppkey, content, lower(n_name) AS city, regexp_split_to_array(lower(content), '\b' || lower(n_name) || '\b') AS p FROM place_text, nation WHERE contains(lower(content), lower(n_name))), a AS (SELECT s_suppkey, content, city, unnest({_AT.format(n='length(city)')}) AS pos FROM m WHERE len(p) > 1), c AS (SELECT *, substring(content, CAST(greatest(pos - 100, 1) AS BIGINT), CAST(least(pos - 1, 100) + length(city) + 100 AS BIGINT)) AS context FROM a) SELECT s_suppkey, city, pos, {_case('lower(context)', [(p, n) for n, p in fg.SITE_WORDS], chr(39) + 'Manufacturing' + chr(39))} AS kind, context, CASE WHEN contains(lower(context), 'facility') OR contains(lower(context), 'plant') THEN 0.8 ELSE 0.5 END AS confidence FROM c", ("place_text",))
def txt_14(t):
    return ps.location_mentions(t("place_text"), "s_suppkey", "content", _gazetteer(t)).withColumnRenamed("at", "pos")


@query("txt_15_facility_lines", r"l AS (SELECT s_suppkey, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT s_suppkey, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM place_lines) q), a AS (SELECT s_suppkey, i, s, lower(string_agg(s, ' ') OVER (PARTITION BY s_suppkey ORDER BY i ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)) AS around FROM l), c AS (SELECT *, trim(regexp_extract(lower(s), '^([^,(–—-]*)', 1)) AS city FROM a WHERE NOT contains(lower(s), 'privacy') AND NOT contains(lower(s), 'subscribe') AND length(s) BETWEEN 3 AND 80 AND NOT regexp_matches(s, '^[\d ]+$')) SELECT s_suppkey, c.city, CASE WHEN regexp_matches(around, 'headquarter|corporate office') THEN 'Headquarters' WHEN regexp_matches(around, 'design|r&d|innovation') THEN 'Design Center' WHEN regexp_matches(around, 'warehouse|logistics|distribution') THEN 'Logistics/Repair' ELSE 'Manufacturing' END AS kind FROM c JOIN (SELECT DISTINCT lower(n_name) AS city FROM nation) g ON g.city = c.city QUALIFY row_number() OVER (PARTITION BY s_suppkey, c.city ORDER BY i) = 1", ("place_lines",))
def txt_15(t):
    return ps.facility_lines(t("place_lines"), "s_suppkey", "content", _gazetteer(t), ["Privacy", "Subscribe"])


VIEWS["table_pages"] = """SELECT o_orderkey, concat('<h1>Report</h1><p>', CAST(o_custkey AS STRING), '</p>', CASE o_orderkey % 3 WHEN 0 THEN '<h2>Cash <i>flow</i></h2>' WHEN 1 THEN '' ELSE '<h3>Total &amp; parts</h3>' END, '<table>', CASE WHEN o_orderkey % 4 = 0 THEN '<caption>In millions</caption>' ELSE '' END, '<tr><th>item</th><th>amount</th></tr><tr><td>total</td><td> ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' </td></tr></table>',
 CASE WHEN o_orderkey % 5 = 0 THEN '<table><tr><td>one row</td></tr></table>' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN '<h2>Second</h2><table><tr><td>a</td></tr><tr><td>b</td></tr><tr><td></td></tr></table>' ELSE '' END) AS html FROM orders"""
_NEEDS["table_pages"] = ["orders"]


@query("chk_12_tables_with_context", "SELECT o_orderkey, 0 AS table_idx, CASE WHEN o_orderkey % 4 = 0 THEN 'In millions' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Cash flow' WHEN 1 THEN 'Report' ELSE 'Total & parts' END END AS context, 'item,amount;total,' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS cells FROM orders UNION ALL SELECT o_orderkey, 1, 'Second', 'a;b;' FROM orders WHERE o_orderkey % 7 = 0")
def chk_12_context(t):
    """Tables of two rows and more with their caption, else the heading before them."""
    found = ch.extract_tables(t("table_pages"), "o_orderkey", "html")
    return found.select("o_orderkey", "table_idx", "context", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))
