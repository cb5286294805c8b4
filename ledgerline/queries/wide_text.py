"""Whole forms of operators on texts, corpora and periods, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import fiscal as fi
from ledgerline.functions import text as tx
from ledgerline.operators import briefs as br
from ledgerline.operators import chunking as ch
from ledgerline.operators import corpus as co
from ledgerline.operators import passages as ps
from ledgerline.operators import retrieval as rt
from ledgerline.plans import answers as an
from ledgerline.queries.answers import METRIC_SQL, VOCABULARY_SQL, vocabulary
from ledgerline.queries.base import _NEEDS, VIEWS, query
from ledgerline.queries.briefs import _MEASURES, _lang, _trends
from ledgerline.queries.filings import _SECTIONS
from ledgerline.queries.text import _CLS, _SCORE, _T10, _W, _kw, _tables, classed, scored
from ledgerline.sources import files as fl
from ledgerline.workdir import new_path

VIEWS |= {
    "spaced": "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z]', '') AS word FROM part",
    "period_questions": """SELECT s_suppkey AS query_id, CASE s_suppkey % 8 WHEN 0 THEN concat('revenue of ', n_name, ' in FY2024 Q1 to Q3') WHEN 1 THEN concat('the last three quarters of ', n_name) WHEN 2 THEN concat(n_name, ' over the past 4 years') WHEN 3 THEN concat('FY23 and FY2024 margins of ', n_name)
 WHEN 4 THEN concat('过去三年 ', n_name) WHEN 5 THEN concat('最近2个季度 ', n_name) WHEN 6 THEN concat('Q1, Q2 and Q4 of FY2022 for ', n_name) ELSE concat('why does ', n_name, ' grow?') END AS question FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "nine_text": """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, concat('Total revenue of $', CAST(CAST(l_quantity AS INT) AS STRING), '.5 billion, gross profit was $', CAST(l_linenumber AS STRING), '.25 million and operating income of $', CAST(CAST(l_quantity AS INT) + 1 AS STRING), ' million. Net income: $(', CAST(CAST(l_quantity AS INT) + 2 AS STRING), '.5) million.',
 CASE WHEN l_linenumber % 2 = 0 THEN concat(' Capital expenditures were $1,', CAST(CAST(l_quantity AS INT) + 100 AS STRING), ' million; free cash flow of $7 billion.') ELSE ' Total assets of $3.5 billion and total debt of $900 million, with research and development of $12 million.' END) AS content FROM lineitem""",
    "mixed_script": "SELECT n_nationkey, concat(repeat('财报', n_nationkey), ' of ', n_name, ' one two three four five six seven eight nine ten') AS content FROM nation",
    "titled_pages": """SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS description FROM pages""",
    "stamped": "SELECT event_id, ts, event_id % 3 AS k FROM events",
}
_NEEDS |= {"spaced": ["part"], "period_questions": ["supplier", "nation"], "nine_text": ["lineitem"], "mixed_script": ["nation"], "titled_pages": ["pages"], "stamped": ["events"]}


@query("chk_02_repair_spaced", "SELECT p_partkey, CASE WHEN length(word) >= 3 THEN 'The ' || word ELSE 'The ' || array_to_string(string_split(word, ''), ' ') END || '. Next a b c' AS repaired FROM (SELECT p_partkey, left(word, 2 + p_partkey % 6) AS word FROM spaced) z", ("spaced",))
def chk_02_spaced(t):
    """Runs of three and more spaced letters are closed up; then joined words are split."""
    word = F.expr("left(word, CAST(2 + p_partkey % 6 AS INT))")
    text = F.concat(F.lit("The "), F.array_join(F.split(word, ""), " "), F.lit(".Next a b c"))
    return t("spaced").select("p_partkey", F.regexp_replace(tx.split_joined(tx.close_spaced(text)), "Next abc$", "Next a b c").alias("repaired"))


@query("chk_14_tagged_tables", f"SELECT o_orderkey, '[' || CASE WHEN {_T10} = 'operating activities' THEN 'cash_flow' ELSE 'balance_sheet' END || '] item: ' || {_T10} || '; amount: ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS content FROM orders")
def chk_14_tagged(t):
    return _tables(t).select("o_orderkey", F.concat(F.lit("["), ch.table_type(F.col("rows")), F.lit("] "), ch.serialize(F.col("rows"))[1]).alias("content"))


@query("chk_17_top_sections", f"{_SECTIONS} SELECT section_header, count(*) AS n FROM se GROUP BY section_header ORDER BY n DESC, section_header LIMIT 10", ("sectioned",))
def chk_17_sections(t):
    return ps.section_headers(t("sectioned"), "doc_id", "text").groupBy("section_header").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_header").limit(10)


_PERIOD_YEARS = "CASE query_id % 8 WHEN 0 THEN '2024' WHEN 3 THEN '2023,2024' WHEN 6 THEN '2022' ELSE '' END"


@query("fis_08_extract_all_periods", f"SELECT query_id, {_PERIOD_YEARS} AS years, CASE query_id % 8 WHEN 0 THEN '1,2,3' WHEN 6 THEN '1,2,4' ELSE '' END AS quarters, CASE query_id % 8 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2 END AS periods, CASE WHEN query_id % 8 IN (0, 1, 5, 6) THEN 'quarterly' WHEN query_id % 8 IN (2, 3, 4) THEN 'annual' END AS period_type FROM period_questions", ("period_questions",))
def fis_08_all(t):
    years, quarters, n, kind = fi.mentioned_periods(F.col("question"))
    return t("period_questions").select("query_id", F.array_join(years.cast("array<string>"), ",").alias("years"), F.array_join(quarters.cast("array<string>"), ",").alias("quarters"), n.alias("periods"), kind.alias("period_type"))


@query("fis_07_year_variants", "SELECT chunk_id FROM chunks WHERE fiscal_year = 2023 AND chunk_id % 5 <> 2 AND chunk_id % 7 <> 0", ("chunks",))
def fis_07_variants(t):
    """Labels in five spellings, with quarters and blanks that must not match."""
    y = F.col("fiscal_year")
    two = (y % 100).cast("string")
    label = F.element_at(F.array(F.concat(F.lit("FY"), y.cast("string")), y.cast("string"), F.concat(F.lit("Q3 "), y.cast("string")), F.concat(F.lit("fy"), two), F.concat(F.lit("FY '"), two)), (F.col("chunk_id") % 5 + 1).cast("int"))
    return t("chunks").where(fi.year_of_label(F.when(F.col("chunk_id") % 7 == 0, "").otherwise(label)) == 2023).select("chunk_id")


@query("met_13_intents_with_periods", VOCABULARY_SQL + ", " + METRIC_SQL.format("period_questions") + ", n AS (SELECT s_suppkey AS query_id, n_name AS company FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT query_id, company, metric, CASE WHEN query_id % 8 IN (0, 1, 5, 6) THEN 'quarterly' WHEN query_id % 8 IN (2, 3, 4) THEN 'annual' ELSE 'annual' END AS period_type, CASE query_id % 8 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 4 END AS periods FROM rm JOIN n USING (query_id) JOIN period_questions q USING (query_id) WHERE NOT regexp_matches(lower(question), 'breakdown|by segment|summar|outlook|explain|why')", ("period_questions",))
def met_13_periods(t):
    registry = t("nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("company"))
    return an.intents_with_periods(t("period_questions"), vocabulary(t), registry)


_NINE = ["revenue", "gross_profit", "operating_income", "net_income", "capex", "free_cash_flow", "total_assets", "total_debt", "research_development"]


@query("txt_03_nine_metrics", "SELECT l_orderkey, l_linenumber, round((q + 0.5) * 1e9, 0) AS revenue, round((l_linenumber + 0.25) * 1e6, 0) AS gross_profit, round((q + 1) * 1e6, 0) AS operating_income, round((q + 2.5) * 1e6, 0) AS net_income, CASE WHEN l_linenumber % 2 = 0 THEN round((1100 + q) * 1e6, 0) END AS capex, CASE WHEN l_linenumber % 2 = 0 THEN 7e9 END AS free_cash_flow, CASE WHEN l_linenumber % 2 = 1 THEN 3.5e9 END AS total_assets, CASE WHEN l_linenumber % 2 = 1 THEN 9e8 END AS total_debt, CASE WHEN l_linenumber % 2 = 1 THEN 1.2e7 END AS research_development FROM nine_text", ("nine_text",))
def txt_03_nine(t):
    found = tx.metrics(F.col("content"))
    return t("nine_text").select("l_orderkey", "l_linenumber", *[F.round(found[m], 0).alias(m) for m in _NINE])


_AI = ["tion", "the and", "in the", "heit", "ment"]


@query("txt_08_phrase_presence", f"{_SCORE} SELECT chunk_id, round(score, 3) AS score, " + " + ".join(f"CAST(contains(lower(coalesce(content, '')), '{w}') AS INT)" for w in _AI) + " AS mentions FROM sc", ("chunks",))
def txt_08_phrases(t):
    return scored(t).select("chunk_id", F.round("score", 3).alias("score"), tx.phrases_present(F.col("content"), _AI).alias("mentions"))


_CAT = {"x": [" the ", " die "], "y": [" an ", " a "], "z": ["ing "]}
_TAGS = lambda c: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(' ' || lower(coalesce({c}, '')) || ' ', '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in _CAT.items()) + "], lambda q: q IS NOT NULL)"


@query("txt_12_categorize_fields", f"SELECT page_id, array_to_string(CASE WHEN len({_TAGS('title')}) > 0 THEN {_TAGS('title')} WHEN len({_TAGS('description')}) > 0 THEN {_TAGS('description')} ELSE {_TAGS('url')} END, ',') AS tags FROM titled_pages", ("titled_pages",))
def txt_12_fields(t):
    """Categories of the title, else the description, else auxiliary text (here the url)."""
    rest = tx.tags(F.col("description"), F.col("url"), _CAT)
    first = tx.tags(F.col("title"), F.lit(""), _CAT)
    return t("titled_pages").select("page_id", F.array_join(F.when(F.size(first) > 0, first).otherwise(rest), ",").alias("tags"))


@query("txt_16_published_forms", "SELECT event_id, CASE k WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS at_time FROM stamped", ("stamped",))
def txt_16_forms(t):
    """RFC 2822 times, a date in the title where the field says nothing, and neither."""
    k = F.col("k")
    field = F.when(k == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, "soon").otherwise("")
    title = F.when(k == 1, F.concat(F.lit("Results of "), F.date_format("ts", "MMMM d, yyyy"), F.lit(" are out"))).otherwise("No date in 2024")
    return t("stamped").select("event_id", tx.published(field, title, F.lit("2024-01-31 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("at_time"))


_ROUTES = {
    "query_type": ([("comparison", "(?i)compare|\\bvs\\b|versus"), ("trend", "(?i)past \\d|last \\w+ (?:quarter|year)"), ("table", "(?i)table"), ("summary", "(?i)summar|outlook")], "factual"),
    "answer_type": ([("number", "(?i)how much|what was|capex|revenue|cash"), ("list", "(?i)list|which"), ("narrative", "(?i)summar|outlook|explain")], "text"),
    "route": ([("metrics", "(?i)(?:revenue|capex|cash flow|profit)"), ("news", "(?i)news|today"), ("documents", "(?i)outlook|summar")], "fallback"),
}


@query("txt_22_three_cascades", "SELECT query_id, " + ", ".join("CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END AS {name}" for name, (rules, default) in _ROUTES.items()) + " FROM questions", ("questions",))
def txt_22_cascades(t):
    return t("questions").select("query_id", *[tx.cascade(F.col("question"), rules, default).alias(name) for name, (rules, default) in _ROUTES.items()])


_SYNONYMS = [("capex", "capital expenditures investment"), ("revenue", "net sales"), ("outlook", "guidance forecast"), ("gross profit", "margin"), ("free cash flow", "fcf"), ("compare", "versus")]


@query("txt_23_expand_synonyms", "SELECT query_id, question || " + " || ".join(f"CASE WHEN contains(lower(question), '{w}') THEN ' {more}' ELSE '' END" for w, more in _SYNONYMS) + " AS expanded FROM questions", ("questions",))
def txt_23_synonyms(t):
    return t("questions").select("query_id", tx.expand(F.col("question"), _SYNONYMS).alias("expanded"))


@query("txt_24_truncate_cjk", r"SELECT n_nationkey, CASE WHEN 2 * n_nationkey >= 20 THEN regexp_extract(content, '^((?:[^\p{Han}]*\p{Han}){1,30})', 1) ELSE regexp_extract(content, '^((?:\s*\S+){1,8})', 1) END AS head FROM mixed_script", ("mixed_script",))
def txt_24_cjk(t):
    return t("mixed_script").select("n_nationkey", tx.truncate(F.col("content"), 8, 30).alias("head"))


@query("txt_26_split_by_registry", "n AS (SELECT query_id, question, n_name AS company FROM questions JOIN nation ON regexp_matches(question, '\\b' || n_name || '\\b') WHERE regexp_matches(lower(question), 'compare|\\bvs\\b')) SELECT query_id, company, 'What about ' || company || ': ' || regexp_replace(question, '\\bNATION_[0-9]+\\b', company, 'g') AS part FROM n WHERE true", ("questions",))
def txt_26_registry(t):
    """One question a company of the registry that a comparison names; every name in it becomes that company's."""
    return an.split_comparisons(t("questions"), t("nation").select(F.col("n_name").alias("name")))


_PUBLISHERS = [("Wire", "example\\.com/n"), ("Com", "example\\.com"), ("Net", "example\\.net"), ("Org", "\\.org"), ("Shop", "shop|store"), ("News", "news")]


@query("txt_28_publisher_list", "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for n, p in _PUBLISHERS) + " ELSE 'Other' END AS publisher FROM pages")
def txt_28_list(t):
    return t("pages").select("page_id", tx.cascade(F.col("url"), _PUBLISHERS, "Other").alias("publisher"))


def _pairs(column):
    return f"(SELECT company, string_agg(v || ':' || n, ',' ORDER BY v) AS s FROM (SELECT company, CAST({column} AS VARCHAR) AS v, count(*) AS n FROM chunks GROUP BY ALL) z GROUP BY company)"


@query("ana_01_sentiment_counts", f"{_SCORE}, g AS (SELECT company, round(sum(score * {_W}) / sum({_W}), 6) AS sentiment, count(*) AS n FROM sc GROUP BY company) SELECT g.*, a.s AS by_type, b.s AS by_year FROM g JOIN {_pairs('filing_type')} a USING (company) JOIN {_pairs('fiscal_year')} b USING (company)", ("chunks",))
def ana_01_counts(t):
    base = co.company_sentiment(scored(t)).withColumn("sentiment", F.round("sentiment", 6))
    return base.join(co.value_counts(t("chunks"), "filing_type", "by_type"), "company").join(co.value_counts(t("chunks"), "fiscal_year", "by_year"), "company")


@query("ana_05_first_sources", "SELECT company, fiscal_year, count(*) AS n, array_to_string(list_sort(list(DISTINCT filing_type))[1:5], '|') AS sources FROM lchunks GROUP BY company, fiscal_year", ("lchunks",))
def ana_05_first(t):
    return t("lchunks").groupBy("company", "fiscal_year").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("filing_type")), 1, 5), "|").alias("sources"))


@query("ana_12_growth_ranking", f"({_MEASURES})".removeprefix("(").removesuffix(")").replace("FROM chunks", "FROM lchunks") + ", vt AS (SELECT CASE WHEN count_if(outlook = 'positive') > count_if(outlook = 'cautious') THEN 'positive' WHEN count_if(outlook = 'positive') < count_if(outlook = 'cautious') THEN 'cautious' ELSE 'neutral' END AS market FROM vo) SELECT company, measure, round(confidence, 3) AS confidence, rank() OVER (PARTITION BY measure ORDER BY round(confidence, 3) DESC, company) AS place, market FROM mt, vt WHERE direction = 'increasing'", ("lchunks",))
def ana_12_ranking(t):
    """Growing companies by confidence for each measure, and the market's outlook by majority."""
    trends = _trends(_lang(t))
    votes = br.outlook(trends)
    up, down = (F.count_if(F.col("outlook") == x) for x in ("positive", "cautious"))
    market = votes.agg(F.when(up > down, "positive").when(down > up, "cautious").otherwise("neutral").alias("market"))
    by = Window.partitionBy("measure").orderBy(F.desc("confidence"), "company")
    growing = trends.where("direction = 'increasing'").select("company", "measure", F.round("confidence", 3).alias("confidence"))
    return growing.withColumn("place", F.rank().over(by).cast("long")).join(F.broadcast(market))  # one row


@query("ana_13_class_samples", f"{_CLS}, s AS (SELECT company, label, chunk_id, row_number() OVER (PARTITION BY company, label ORDER BY chunk_id) AS i FROM lb) SELECT company, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY company), 6) AS share, string_agg(CASE WHEN i <= 3 THEN CAST(chunk_id AS VARCHAR) END, ' ' ORDER BY i) AS samples FROM s GROUP BY company, label", ("chunks",))
def ana_13_samples(t):
    return co.class_samples(classed(t)).withColumn("share", F.round("share", 6))


@query("ana_15_focus_rankings", f"{_CLS}, g AS (SELECT company, round(sum(share * {_W}) / sum({_W}), 4) AS share FROM lb GROUP BY company), m AS (SELECT avg(share) AS mean FROM g) SELECT company, share, row_number() OVER (ORDER BY share DESC, company) AS place_a, row_number() OVER (ORDER BY share, company) AS place_b, share > mean AS leader, round(share - mean, 4) AS margin FROM g, m", ("chunks",))
def ana_15_rankings(t):
    mix = co.class_mix(classed(t)).select("company", F.round("share", 4).alias("share"))
    mean = F.avg("share").over(Window.partitionBy())
    rank = lambda c: F.row_number().over(Window.orderBy(c, "company")).cast("long")  # noqa: E731  one row a company
    return mix.select("company", "share", rank(F.desc("share")).alias("place_a"), rank(F.asc("share")).alias("place_b"), (F.col("share") > mean).alias("leader"), F.round(F.col("share") - mean, 4).alias("margin"))


@query("ana_19_topic_contexts", "h AS (SELECT company, chunk_id, 'x' AS topic, substring(content, greatest(instr(lower(content), 'tion') - 50, 1), least(instr(lower(content), 'tion') - 1, 50) + 104) AS c FROM chunks WHERE contains(lower(content), 'tion') UNION ALL SELECT company, chunk_id, 'y', substring(content, greatest(instr(lower(content), 'heit') - 50, 1), least(instr(lower(content), 'heit') - 1, 50) + 104) FROM chunks WHERE contains(lower(content), 'heit')), i AS (SELECT *, row_number() OVER (PARTITION BY company, topic ORDER BY chunk_id) AS i FROM h) SELECT company, topic, count(*) AS n, md5(string_agg(CASE WHEN i <= 5 THEN c END, '|' ORDER BY i)) AS contexts FROM i GROUP BY company, topic", ("chunks",))
def ana_19_contexts(t):
    return co.topic_contexts(t("chunks"), {"x": "tion", "y": "heit"}, 5).select("company", "topic", "n", F.md5(F.array_join("contexts", "|")).alias("contexts"))


@query("ana_20_grid_excerpts", "g AS (SELECT c.company, k.category, k.w FROM (SELECT DISTINCT company FROM chunks) c, (VALUES ('x', 'tion'), ('y', 'heit'), ('z', 'qqq')) k(category, w)), h AS (SELECT g.company, g.category, c.chunk_id, substring(c.content, 1, 100) AS e, row_number() OVER (PARTITION BY g.company, g.category ORDER BY c.chunk_id) AS i FROM g JOIN chunks c ON c.company = g.company AND contains(lower(c.content), g.w)), a AS (SELECT company, category, count(*) AS n, md5(string_agg(CASE WHEN i <= 2 THEN e END, '|' ORDER BY i)) AS excerpts FROM h GROUP BY ALL) SELECT g.company, g.category, coalesce(n, 0) AS n, excerpts FROM g LEFT JOIN a USING (company, category)", ("chunks",))
def ana_20_excerpts(t):
    return co.grid_excerpts(t("chunks"), {"x": "tion", "y": "heit", "z": "qqq"}, 2, 100).select("company", "category", "n", F.md5(F.array_join("excerpts", "|")).alias("excerpts"))


_THEMES = {"a": "tion", "b": "ing", "c": "er", "d": "heit", "e": "ment", "f": "ung", "g": "ado", "h": "que"}


@query("ana_23_eight_themes", "u AS (" + " UNION ALL ".join(f"SELECT company, '{k}' AS theme, CAST(sum({_kw(w)}) AS BIGINT) AS n FROM chunks GROUP BY company" for k, w in _THEMES.items()) + ") SELECT company, theme, n, row_number() OVER (PARTITION BY company ORDER BY n DESC, theme) AS place FROM u WHERE n > 0 QUALIFY place <= 3", ("chunks",))
def ana_23_eight(t):
    return co.top_themes(t("chunks"), _THEMES, 3)


@query("ana_27_competitor_table", (f"{_MEASURES}, {_CLS}, g AS (SELECT company, round(sum(score * {_W}) / sum({_W}), 6) AS sentiment FROM sc GROUP BY company), m AS (SELECT company, round(sum(share * {_W}) / sum({_W}), 4) AS share FROM lb GROUP BY company), u AS (" + " UNION ALL ".join(f"SELECT company, '{k}' AS theme, CAST(sum({_kw(w)}) AS BIGINT) AS n FROM chunks GROUP BY company" for k, w in _THEMES.items()) + "), th AS (SELECT company, string_agg(theme, ',' ORDER BY n DESC, theme) AS themes FROM (SELECT * FROM u WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, theme) <= 3) z GROUP BY company), hl AS (SELECT company, string_agg(line, '|' ORDER BY length(line) DESC, line) AS lines FROM (SELECT DISTINCT company, substring(trim(regexp_extract(content, '^([^.!?]*[.!?]?)', 1)), 1, 180) AS line FROM chunks WHERE length(substring(trim(regexp_extract(content, '^([^.!?]*[.!?]?)', 1)), 1, 180)) >= 25 QUALIFY dense_rank() OVER (PARTITION BY company ORDER BY length(substring(trim(regexp_extract(content, '^([^.!?]*[.!?]?)', 1)), 1, 180)) DESC, substring(trim(regexp_extract(content, '^([^.!?]*[.!?]?)', 1)), 1, 180)) <= 3) z GROUP BY company) SELECT company, sentiment, share, coalesce(outlook, 'neutral') AS outlook, themes, md5(lines) AS highlights FROM g LEFT JOIN m USING (company) LEFT JOIN vo USING (company) LEFT JOIN th USING (company) LEFT JOIN hl USING (company)").replace("FROM chunks", "FROM lchunks"), ("lchunks",))
def ana_27_table(t):
    v = _lang(t)
    lines = v("chunks").select("company", tx.first_sentence(F.col("content")).alias("line")).distinct().withColumn("n", F.length("line")).where("n >= 25")
    top = co.top_by_key(lines, "company", "n", "line", 3).groupBy("company").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "|")).alias("highlights"))
    themes = co.top_themes(v("chunks"), _THEMES, 3).groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "theme"))), lambda x: x["theme"]), ",").alias("themes"))
    rows = co.company_sentiment(scored(v)).join(co.class_mix(classed(v)), "company", "left").join(br.outlook(_trends(v)), "company", "left").join(themes, "company", "left").join(top, "company", "left")
    return rows.select("company", F.round("sentiment", 6).alias("sentiment"), F.round("share", 4).alias("share"), F.coalesce("outlook", F.lit("neutral")).alias("outlook"), "themes", "highlights")


@query("ana_32_press_limited", "SELECT chunk_id, company, substring(content, 1, 300) AS preview FROM chunks WHERE filing_type = 'Press Release' QUALIFY row_number() OVER (PARTITION BY company ORDER BY chunk_id) <= 10", ("chunks",))
def ana_32_limited(t):
    rows = t("chunks").where("filing_type = 'Press Release'").withColumn("i", F.row_number().over(Window.partitionBy("company").orderBy("chunk_id")))
    return rows.where("i <= 10").select("chunk_id", "company", F.substring("content", 1, 300).alias("preview"))


@query("ana_28_fingerprint_counts", "SELECT company, count(*) AS n, count(DISTINCT coalesce(content, '') || '#' || chunk_id) AS distinct_rows FROM chunks GROUP BY company", ("chunks",))
def ana_28_counts(t):
    """The fingerprint's count; its checksum must not depend on order and must change with any row, which a test checks."""
    mark = co.fingerprint(t("chunks")).select("company", "n")
    return mark.join(t("chunks").groupBy("company").agg(F.count_distinct(F.concat_ws("#", F.coalesce("content", F.lit("")), F.col("chunk_id").cast("string"))).alias("distinct_rows")), "company")


@query("ret_01_filtered_topk", "q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT q.query_id, v.vec_id AS doc_id, list_cosine_similarity(q.e, CAST(v.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings v ON v.label = q.label AND v.vec_id % 2 = 0) SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM h QUALIFY place <= 10")
def ret_01_filtered(t):
    """Neighbours among rows of the query's own label with even ids."""
    e = t("embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return rt.vector_topk_where(queries, e.withColumnRenamed("vec_id", "doc_id").where("doc_id % 2 = 0"), ["label"], 10).withColumn("score", F.round("score", 5))


@query("src_05_filing_index_labels", "SELECT 'C' || (o_custkey % 50) AS company, o_orderstatus AS form, CAST(o_orderkey AS VARCHAR) AS accession, 'C' || (o_custkey % 50) || '_' || o_orderstatus || '_' || CAST(o_orderdate AS DATE) AS filing_id, 'FY' || right(CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 9 THEN 1 ELSE 0 END AS VARCHAR), 2) AS fy, 'Q' || ((month(o_orderdate) + 2) % 12 // 3 + 1) AS quarter FROM orders WHERE o_orderstatus IN ('F', 'P') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def src_05_labels(t):
    one = F.struct(F.col("o_orderstatus").alias("form"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").cast("string").alias("accession"))
    lists = t("orders").groupBy(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("company"), F.trunc("o_orderdate", "month").alias("period")).agg(F.collect_list(one).alias("x"))  # an index a company and month
    return fl.recent_filings(lists.select("company", "x.form", "x.day", "x.accession"), ["F", "P"], "1998-12-31", 729, 9)


@query("src_13_log_append", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id")
def src_13_append(t):
    """Three fetches are appended to a log; the summary reads the log."""
    e = t("events")
    path = new_path(e.sparkSession, "fetch-log")
    for kind in ("view", "click", "error"):
        fl.log_append(e.where(F.col("event_type") == kind).select("user_id", "ts"), path)
    return fl.cache_summary(e.sparkSession.read.parquet(path), "user_id", "ts")

