"""Text features, corpus analytics, cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators import chunking as ch
from ledgerline.operators import corpus as co
from ledgerline.queries.base import query

POS, NEG = ["the", "and", "with"], ["of", "by", "to"]
A, B = {"high": ["tion"], "medium": ["an"]}, {"high": ["ing"], "medium": ["er"]}
TOKEN = r"\w+"
_HITS = "len(list_filter(regexp_extract_all(lower(content), '\\w+'), lambda x: x IN ({})))"
_P, _N = (_HITS.format(", ".join(f"'{w}'" for w in ws)) for ws in (POS, NEG))
_SCORE = f"sc AS (SELECT *, CASE WHEN {_P} + {_N} > 0 THEN ({_P} - {_N}) / ({_P} + {_N}) ELSE 0 END AS score FROM chunks)"
_W = "CASE filing_type WHEN 'Earnings Transcript' THEN 2.0 WHEN '10-K' THEN 1.5 WHEN 'Press Release' THEN 1.2 WHEN '8-K' THEN 1.1 ELSE 1.0 END"


def _kw(word, col="content"):
    return f"((length(lower({col})) - length(replace(lower({col}), '{word}', ''))) // {len(word)})"


_CLS = f"k AS (SELECT *, {_kw('tion')} * 3 + {_kw('an')} AS a, {_kw('ing')} * 3 + {_kw('er')} AS b FROM chunks), cl AS (SELECT *, CASE WHEN a + b > 0 THEN a * 100.0 / (a + b) ELSE 50.0 END AS share FROM k), lb AS (SELECT *, CASE WHEN a + b = 0 THEN 'unclassified' WHEN share >= 70 THEN 'a' WHEN share <= 30 THEN 'b' ELSE 'mixed' END AS label FROM cl)"


def scored(t):
    return t("chunks").withColumn("score", tx.lexicon_sentiment(F.col("content"), POS, NEG, TOKEN))


def classed(t):
    share, label = tx.two_sided(F.col("content"), A, B)
    return t("chunks").withColumn("share", share).withColumn("label", label)


_TAGS = "html"
for _tag in ("script", "style", "head", "meta"):
    _TAGS = rf"regexp_replace({_TAGS}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"
_TAGS = f"regexp_replace({_TAGS}, '(?s)<[^>]+>', ' ', 'g')"
for _from, _to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TAGS = f"replace({_TAGS}, '{_from}', '{_to}')"


@query("src_02_html_to_text", rf"SELECT page_id, trim(regexp_replace({_TAGS}, '\s+', ' ', 'g')) AS body FROM pages")
def src_02(t):
    return t("pages").select("page_id", tx.html_to_text(F.col("html")).alias("body"))


@query("src_03_first_image_url", """SELECT page_id, nullif(regexp_extract(html || '<img alt="x" src="https://i.example/' || page_id || '.png">', '(?i)<img[^>]+src=["''](https?://[^"'']+)', 1), '') AS image FROM pages""")
def src_03(t):
    return t("pages").select("page_id", tx.first_image_url(F.concat("html", F.lit('<img alt="x" src="https://i.example/'), F.col("page_id").cast("string"), F.lit('.png">'))).alias("image"))


@query("chk_01_clean_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', e'\n\n', 'g'), ' {2,}', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS cleaned FROM documents")
def chk_01(t):
    return t("documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("chk_02_repair_text", r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '\.([A-Z])', '. \1', 'g') AS repaired FROM documents")
def chk_02(t):
    return t("documents").select("doc_id", tx.split_joined(F.col("text")).alias("repaired"))


@query("chk_04_split_sections", "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN 1 ELSE 0 END AS head FROM l), s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h) SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY i) AS content FROM s GROUP BY doc_id, section")
def chk_04(t):
    return ch.split_sections(t("documents"), "doc_id", "text", "^[A-Z][a-z]+ ")


@query("chk_05_section_outline", "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, CAST(i AS BIGINT) AS i, line FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+ ')")
def chk_05(t):
    return ch.outline(t("documents"), "doc_id", "text", "^[A-Z][a-z]+ ")


@query("chk_06_split_paragraphs")
def chk_06(t):
    return ch.merge_paragraphs(t("documents"), "doc_id", "text", 100)


@query("chk_07_pack_sentences")
def chk_07(t):
    return ch.pack_sentences(t("documents"), "doc_id", "text", 120)


@query("chk_08_chunk_words", r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws), 1), 200)) AS b FROM w), c AS (SELECT doc_id, b // 200 AS idx, array_to_string(ws[b + 1: b + 250], ' ') AS chunk FROM s) SELECT * FROM c WHERE length(chunk) > 50")
def chk_08(t):
    return ch.chunk_words(t("documents"), "doc_id", "text", 250, 50)


@query("chk_09_chunk_parent_child")
def chk_09(t):
    return ch.parent_child(t("documents"), "doc_id", "text")


@query("chk_11_chunk_id", "SELECT chunk_id, substring(md5(company || '_' || chunk_id || '_' || chunk_type), 1, 16) AS id FROM chunks", ("chunks",))
def chk_11(t):
    return t("chunks").select("chunk_id", ch.chunk_key(F.col("company"), F.col("chunk_id"), F.col("chunk_type")).alias("id"))


@query("chk_12_extract_tables")
def chk_12(t):
    made = t("orders").select("o_orderkey", F.concat(F.lit("<h2>Cash flow</h2><table><tr><th>item</th><th>amount</th></tr><tr><td>total</td><td>"), F.col("o_totalprice").cast("string"), F.lit("</td></tr></table>")).alias("html"))
    return ch.extract_tables(made, "o_orderkey", "html")


_T10 = "CASE WHEN o_orderkey % 2 = 0 THEN 'operating activities' ELSE 'total assets' END"


@query("chk_13_table_type", f"SELECT o_orderkey, CASE WHEN {_T10} = 'operating activities' THEN 'cash_flow' ELSE 'balance_sheet' END AS table_type FROM orders")
def chk_13(t):
    return _tables(t).select("o_orderkey", ch.table_type(F.col("rows")).alias("table_type"))


@query("chk_14_serialize_tables", f"SELECT o_orderkey, '| item | amount |' || chr(10) || '| ' || {_T10} || ' | ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' |' AS markdown, 'item: ' || {_T10} || '; amount: ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS linear FROM orders")
def chk_14(t):
    markdown, linear = ch.serialize(F.col("rows"))
    return _tables(t).select("o_orderkey", markdown.alias("markdown"), linear.alias("linear"))


def _tables(t):
    label = F.when(F.col("o_orderkey") % 2 == 0, "operating activities").otherwise("total assets")
    return t("orders").select("o_orderkey", F.array(F.array(F.lit("item"), F.lit("amount")), F.array(label, F.floor("o_totalprice").cast("bigint").cast("string"))).alias("rows"))


@query("chk_17_chunk_stats", "SELECT chunk_type, company, filing_type, count(*) AS n FROM chunks GROUP BY ALL", ("chunks",))
def chk_17(t):
    return t("chunks").groupBy("chunk_type", "company", "filing_type").agg(F.count("*").alias("n"))


@query("txt_01_dollar_amounts", "SELECT l_orderkey, l_linenumber, round(q_true * 1e6 + 5e5 + l_linenumber * 1e9 + 2e8, 0) AS total, 2 AS n FROM metric_text", ("metric_text",))
def txt_01(t):
    found = tx.dollar_amounts(F.col("content"))
    return t("metric_text").select("l_orderkey", "l_linenumber", F.round(F.aggregate(found, F.lit(0.0), lambda a, b: a + b), 0).alias("total"), F.size(found).alias("n"))


@query("txt_02_percentages", "SELECT l_orderkey, l_linenumber, CAST(regexp_extract(content, '(-?\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) AS pct FROM metric_text", ("metric_text",))
def txt_02(t):
    return t("metric_text").select("l_orderkey", "l_linenumber", F.get(tx.percentages(F.col("content")), 0).alias("pct"))


@query("txt_03_extract_metrics", "SELECT l_orderkey, l_linenumber, round((q_true + 0.5) * 1e6, 0) AS capex, round((l_linenumber + 0.2) * 1e9, 0) AS revenue FROM metric_text", ("metric_text",))
def txt_03(t):
    return t("metric_text").select("l_orderkey", "l_linenumber", F.round(tx.scaled_match(F.col("content"), "capital expenditures"), 0).alias("capex"), F.round(tx.scaled_match(F.col("content"), "revenue"), 0).alias("revenue"))


@query("txt_05_parse_amount", "SELECT l_orderkey, l_linenumber, l_quantity AS value FROM lineitem")
def txt_05(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", tx.parse_amount(F.concat(F.lit("$("), F.col("l_quantity").cast("string"), F.lit(")"))).alias("value"))


@query("txt_06_to_millions", "SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN l_quantity ELSE l_quantity / 1000 END, 6) AS value FROM lineitem")
def txt_06(t):
    header = F.element_at(F.array(F.lit("(in billions)"), F.lit("(In millions)"), F.lit("in thousands of $")), F.col("l_linenumber") % 3 + 1)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(tx.to_millions(F.col("l_quantity"), tx.unit_of(header)), 6).alias("value"))


@query("txt_08_lexicon_sentiment", f"{_SCORE} SELECT chunk_id, round(score, 6) AS score FROM sc", ("chunks",))
def txt_08(t):
    return scored(t).select("chunk_id", F.round("score", 6).alias("score"))


@query("txt_09_keyword_count", f"SELECT chunk_id, {_kw('tion')} + {_kw('an')} AS n FROM chunks", ("chunks",))
def txt_09(t):
    return t("chunks").select("chunk_id", tx.keyword_count(F.col("content"), ["tion", "an"]).cast("long").alias("n"))


@query("txt_10_classify_text", f"{_CLS} SELECT chunk_id, round(share, 6) AS share, label FROM lb", ("chunks",))
def txt_10(t):
    return classed(t).select("chunk_id", F.round("share", 6).alias("share"), "label")


@query("txt_11_top_keywords", "u AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{w}' AS word, {_kw(w)} AS n FROM chunks" for w in ("tion", "an", "ing", "er")) + ") SELECT chunk_id, word, n, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, word) AS place FROM u WHERE n > 0 QUALIFY place <= 2", ("chunks",))
def txt_11(t):
    words = ["tion", "an", "ing", "er"]
    counts = t("chunks").select("chunk_id", *[tx.keyword_count(F.col("content"), [w]).cast("long").alias(w) for w in words]).unpivot(["chunk_id"], words, "word", "n")
    return co.top_by_key(counts.where("n > 0"), "chunk_id", "n", "word", 2)


@query("txt_12_categorize", "SELECT doc_id, CASE WHEN lower(left(text, 80)) LIKE '%tion%' OR lower(left(text, 80)) LIKE '%ch%' THEN array_to_string(list_filter([CASE WHEN lower(left(text, 80)) LIKE '%tion%' THEN 'x' END, CASE WHEN lower(left(text, 80)) LIKE '%ch%' THEN 'y' END], lambda z: z IS NOT NULL), ',') ELSE array_to_string(list_filter([CASE WHEN lower(text) LIKE '%tion%' THEN 'x' END, CASE WHEN lower(text) LIKE '%ch%' THEN 'y' END], lambda z: z IS NOT NULL), ',') END AS tags FROM documents")
def txt_12(t):
    return t("documents").select("doc_id", F.array_join(tx.tags(F.substring("text", 1, 80), F.col("text"), {"x": ["tion"], "y": ["ch"]}), ",").alias("tags"))


@query("txt_16_parse_published", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(event_id % 20 AS INT)) WHEN 1 THEN date_trunc('second', ts) ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS at FROM events")
def txt_16(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat((F.col("event_id") % 20).cast("string"), F.lit(" days ago"))).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "MMM d, yyyy"))
    return t("events").select("event_id", tx.age_of(text, F.lit("2024-01-31 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("at"))


_CANON = "lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][\\w+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^[^:]+://([^/?]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1)"
_ROOT = "regexp_extract(regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\\.', ''), '([^.]+\\.[^.]+)$', 1)"


@query("txt_17_canonical_url", f"SELECT page_id, {_CANON} AS url FROM pages")
def txt_17(t):
    return t("pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("txt_18_root_domain", f"SELECT page_id, {_ROOT} AS domain FROM pages")
def txt_18(t):
    return t("pages").select("page_id", tx.root_domain(F.col("url")).alias("domain"))


@query("txt_19_quick_summary", "SELECT doc_id, array_to_string(list_filter([CASE WHEN lower(text) LIKE '%license%' THEN 'License terms' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'Figures' END, CASE WHEN length(text) > 5000 THEN 'Long text' END], lambda x: x IS NOT NULL), '; ') AS summary FROM documents")
def txt_19(t):
    points = [F.when(F.lower("text").contains("license"), "License terms"), F.when(F.col("text").rlike("[0-9]{3}"), "Figures"), F.when(F.length("text") > 5000, "Long text")]
    return t("documents").select("doc_id", F.array_join(F.array_compact(F.array(*points)), "; ").alias("summary"))


@query("txt_20_snippet", "SELECT doc_id, CASE WHEN instr(lower(text), 'tion') > 0 THEN substring(text, greatest(instr(lower(text), 'tion') - 50, 1), least(instr(lower(text), 'tion') - 1, 50) + 104) END AS snippet, substring(trim(regexp_extract(text, '^([^.!?]*[.!?]?)', 1)), 1, 180) AS sentence FROM documents")
def txt_20(t):
    return t("documents").select("doc_id", tx.snippet(F.col("text"), "tion").alias("snippet"), tx.first_sentence(F.col("text")).alias("sentence"))


@query("txt_21_query_terms", "SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]{3,}'), lambda x: x NOT IN ('what', 'was', 'the', 'for', 'did', 'how')))), ' ') AS terms FROM questions", ("questions",))
def txt_21(t):
    return t("questions").select("query_id", F.array_join(F.sort_array(tx.query_terms(F.col("question"), ["what", "was", "the", "for", "did", "how"])), " ").alias("terms"))


_RULES = [("comparison", "(?i)compare|\\bvs\\b"), ("summary", "(?i)summar|outlook"), ("table", "(?i)table"), ("numeric", "(?i)how much|what was")]


@query("txt_22_classify_query", "SELECT query_id, CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{n}'" for n, p in _RULES) + " ELSE 'other' END AS kind FROM questions", ("questions",))
def txt_22(t):
    return t("questions").select("query_id", tx.cascade(F.col("question"), _RULES, "other").alias("kind"))


@query("txt_23_expand_query", "SELECT query_id, question || CASE WHEN question ILIKE '%capex%' THEN ' capital expenditures' ELSE '' END || CASE WHEN question ILIKE '%revenue%' THEN ' net sales' ELSE '' END AS expanded FROM questions", ("questions",))
def txt_23(t):
    add = [F.when(F.lower("question").contains(w), F.lit(" " + more)).otherwise("") for w, more in (("capex", "capital expenditures"), ("revenue", "net sales"))]
    return t("questions").select("query_id", F.concat("question", *add).alias("expanded"))


@query("txt_24_truncate_words", r"SELECT doc_id, regexp_extract(text, '^((?:\s*\S+){1,40})', 1) AS head FROM documents")
def txt_24(t):
    return t("documents").select("doc_id", tx.truncate_words(F.col("text"), 40).alias("head"))


@query("txt_25_is_no_hit", "SELECT conv_id, turn, regexp_matches(lower(text), 'no information|not found|the and|cannot') AS no_hit FROM conversations")
def txt_25(t):
    return t("conversations").select("conv_id", "turn", F.lower("text").rlike("no information|not found|the and|cannot").alias("no_hit"))


@query("txt_26_split_questions", "c AS (SELECT query_id, question, unnest(regexp_extract_all(question, 'NATION_\\d+')) AS company FROM questions WHERE question ILIKE '%compare%') SELECT query_id, company, regexp_replace(question, '^(.*?)NATION_\\d+', '\\1' || company) AS part FROM c", ("questions",))
def txt_26(t):
    each = t("questions").where("question ILIKE '%compare%'").select("query_id", "question", F.explode(F.regexp_extract_all("question", F.lit(r"NATION_\d+"), 0)).alias("company"))
    head = F.regexp_extract("question", r"^(.*?)NATION_\d+", 1)
    tail = F.regexp_extract("question", r"^.*?NATION_\d+((?s).*)$", 1)
    return each.select("query_id", "company", F.concat(head, "company", tail).alias("part"))


@query("txt_28_publisher", "SELECT page_id, CASE WHEN url LIKE '%example.com%' THEN 'Com' WHEN url LIKE '%example.net%' THEN 'Net' ELSE 'Other' END AS publisher FROM pages")
def txt_28(t):
    return t("pages").select("page_id", tx.cascade(F.col("url"), [("Com", r"example\.com"), ("Net", r"example\.net")], "Other").alias("publisher"))


@query("ana_01_company_sentiment", f"{_SCORE} SELECT company, round(sum(score * {_W}) / sum({_W}), 6) AS sentiment, count(*) AS n FROM sc GROUP BY company", ("chunks",))
def ana_01(t):
    return co.company_sentiment(scored(t)).withColumn("sentiment", F.round("sentiment", 6))


@query("ana_02_compare_sentiment", f"{_SCORE}, g AS (SELECT company, round(sum(score * {_W}) / sum({_W}), 6) AS sentiment FROM sc GROUP BY company) SELECT company, sentiment, row_number() OVER (ORDER BY sentiment DESC NULLS LAST, company) AS place FROM g", ("chunks",))
def ana_02(t):
    return co.ranked(co.company_sentiment(scored(t)).select("company", F.round("sentiment", 6).alias("sentiment")), "sentiment", "company")


@query("ana_03_sentiment_change", f"{_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY chunk_id) AS i FROM sc QUALIFY i <= 100), m AS (SELECT *, count(*) OVER (PARTITION BY company) AS total FROM r), g AS (SELECT company, sum(CASE WHEN i <= total // 2 THEN score * {_W} END) / sum(CASE WHEN i <= total // 2 THEN {_W} END) AS recent, sum(CASE WHEN i > total // 2 THEN score * {_W} END) / sum(CASE WHEN i > total // 2 THEN {_W} END) AS older FROM m WHERE total >= 20 GROUP BY company) SELECT company, round(recent, 6) AS recent, round(older, 6) AS older, round(recent - older, 6) AS change, CASE WHEN recent - older > 0.05 THEN 'improving' WHEN recent - older < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM g", ("chunks",))
def ana_03(t):
    return co.sentiment_change(scored(t)).select("company", *[F.round(c, 6).alias(c) for c in ("recent", "older", "change")], "trend")


@query("ana_05_period_sources", "SELECT company, fiscal_year, count(*) AS n, array_to_string(list_sort(list(DISTINCT filing_type))[1:3], '|') AS sources FROM chunks GROUP BY company, fiscal_year", ("chunks",))
def ana_05(t):
    return t("chunks").groupBy("company", "fiscal_year").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("filing_type")), 1, 3), "|").alias("sources"))


@query("ana_06_sentiment_shifts", f"y AS (SELECT company, fiscal_year, sum({_P}) AS p, sum({_N}) AS q FROM chunks GROUP BY ALL), s AS (SELECT company, fiscal_year, CASE WHEN p + q > 0 THEN (p - q) / (p + q) ELSE 0 END AS s FROM y), l AS (SELECT *, lag(s) OVER (PARTITION BY company ORDER BY fiscal_year) AS b, lag(fiscal_year) OVER (PARTITION BY company ORDER BY fiscal_year) AS f FROM s) SELECT company, f AS from_year, fiscal_year AS to_year, round(b, 6) AS before, round(s, 6) AS after, round(s - b, 6) AS change FROM l WHERE abs(s - b) > 0.02", ("chunks",))
def ana_06(t):
    tokens = F.regexp_extract_all(F.lower("content"), F.lit(TOKEN), 0)
    n = lambda ws: F.sum(F.size(F.filter(tokens, lambda x: x.isin(ws))))
    per = t("chunks").groupBy("company", "fiscal_year").agg(n(POS).alias("p"), n(NEG).alias("q")).withColumn("s", F.when(F.col("p") + F.col("q") > 0, (F.col("p") - F.col("q")) / (F.col("p") + F.col("q"))).otherwise(0.0))
    return co.yearly_shift(per, "s", 0.02, relative=False).select("company", "from_year", "to_year", *[F.round(c, 6).alias(c) for c in ("before", "after", "change")])


@query("ana_07_keyword_density_shift", f"y AS (SELECT company, fiscal_year, sum({_kw('tion')} + {_kw('ing')}) / count(*) AS d FROM chunks GROUP BY ALL), l AS (SELECT *, lag(d) OVER (PARTITION BY company ORDER BY fiscal_year) AS b, lag(fiscal_year) OVER (PARTITION BY company ORDER BY fiscal_year) AS f FROM y), c AS (SELECT *, CASE WHEN b <> 0 THEN (d - b) / b WHEN d > 0 THEN 1.0 ELSE 0.0 END AS change FROM l WHERE b IS NOT NULL) SELECT company, f AS from_year, fiscal_year AS to_year, round(b, 6) AS before, round(d, 6) AS after, round(change, 6) AS change FROM c WHERE abs(change) > 0.25", ("chunks",))
def ana_07(t):
    per = t("chunks").groupBy("company", "fiscal_year").agg((F.sum(tx.keyword_count(F.col("content"), ["tion", "ing"])) / F.count("*")).alias("d"))
    return co.yearly_shift(per, "d", 0.25, relative=True).select("company", "from_year", "to_year", *[F.round(c, 6).alias(c) for c in ("before", "after", "change")])


@query("ana_13_investment_mix", f"{_CLS}, g AS (SELECT company, count_if(label = 'a') AS n_a, count_if(label = 'b') AS n_b, count_if(label = 'mixed') AS n_mixed, sum(share * {_W}) / sum({_W}) AS share FROM lb GROUP BY company) SELECT company, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(n_mixed AS BIGINT) AS n_mixed, round(share, 4) AS share, CASE WHEN share >= 60 THEN 'a' WHEN share <= 40 THEN 'b' ELSE 'balanced' END AS focus FROM g", ("chunks",))
def ana_13(t):
    return co.class_mix(classed(t)).withColumn("share", F.round("share", 4))


@query("ana_15_focus_leaders", f"{_CLS}, g AS (SELECT company, sum(share * {_W}) / sum({_W}) AS share FROM lb GROUP BY company), m AS (SELECT avg(share) AS mean FROM g) SELECT company, round(share, 4) AS share, round(share - mean, 4) AS margin FROM g, m WHERE share > mean", ("chunks",))
def ana_15(t):
    mix = co.class_mix(classed(t))
    mean = mix.agg(F.avg("share").alias("mean"))
    return mix.join(F.broadcast(mean)).where("share > mean").select("company", F.round("share", 4).alias("share"), F.round(F.col("share") - F.col("mean"), 4).alias("margin"))


@query("ana_16_upper_median", "s AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, l_quantity AS median FROM s WHERE i = n // 2 + 1")
def ana_16(t):
    return co.upper_median(t("lineitem"), ["l_suppkey"], "l_quantity")


@query("ana_17_mention_breakdown", "m AS (SELECT company, CAST(sum(len(regexp_extract_all(content, 'tion'))) AS BIGINT) AS build, CAST(sum(len(regexp_extract_all(content, 'ing'))) AS BIGINT) AS tools FROM chunks GROUP BY company) SELECT company, build, tools, round(build / (build + tools), 6) AS share, CASE WHEN build >= tools THEN 'build' ELSE 'tools' END AS main FROM m", ("chunks",))
def ana_17(t):
    out = t("chunks").groupBy("company").agg(F.sum(F.regexp_count("content", F.lit("tion"))).alias("build"), F.sum(F.regexp_count("content", F.lit("ing"))).alias("tools"))
    return out.select("company", "build", "tools", F.round(F.try_divide("build", F.col("build") + F.col("tools")), 6).alias("share"), F.when(F.col("build") >= F.col("tools"), "build").otherwise("tools").alias("main"))


@query("ana_19_mention_counts", "SELECT company, CAST(count_if(content LIKE '%tion%') AS BIGINT) AS x, CAST(count_if(content LIKE '%heit%') AS BIGINT) AS y FROM chunks GROUP BY company", ("chunks",))
def ana_19(t):
    return t("chunks").groupBy("company").agg(F.count_if(F.col("content").contains("tion")).alias("x"), F.count_if(F.col("content").contains("heit")).alias("y"))


@query("ana_20_coverage_grid", "SELECT company, 'x' AS category, CAST(count_if(content LIKE '%tion%') AS BIGINT) AS n FROM chunks GROUP BY company UNION ALL SELECT company, 'y', CAST(count_if(content LIKE '%heit%') AS BIGINT) FROM chunks GROUP BY company", ("chunks",))
def ana_20(t):
    return co.coverage_grid(t("chunks"), {"x": "tion", "y": "heit"})


@query("ana_21_focus_level", f"SELECT company, CASE WHEN avg({_kw('tion')}) > 50 THEN 'high' WHEN avg({_kw('tion')}) > 20 THEN 'medium' ELSE 'low' END AS level FROM chunks GROUP BY company", ("chunks",))
def ana_21(t):
    mean = F.avg(tx.keyword_count(F.col("content"), ["tion"]))
    return t("chunks").groupBy("company").agg(F.when(mean > 50, "high").when(mean > 20, "medium").otherwise("low").alias("level"))


@query("ana_22_sentiment_dashboard", f"{_SCORE}, g AS (SELECT company, round(sum(score * {_W}) / sum({_W}), 6) AS s FROM sc GROUP BY company) SELECT max_by(company, s) AS best, min_by(company, s) AS worst, round(avg(s), 6) AS mean FROM g", ("chunks",))
def ana_22(t):
    g = co.company_sentiment(scored(t)).select("company", F.round("sentiment", 6).alias("s"))
    return g.agg(F.max_by("company", "s").alias("best"), F.min_by("company", "s").alias("worst"), F.round(F.avg("s"), 6).alias("mean"))


@query("ana_24_highlights", "h AS (SELECT DISTINCT company, substring(trim(regexp_extract(content, '^([^.!?]*[.!?]?)', 1)), 1, 180) AS line FROM chunks) SELECT company, line, row_number() OVER (PARTITION BY company ORDER BY length(line) DESC, line) AS place FROM h WHERE length(line) >= 25 QUALIFY place <= 3", ("chunks",))
def ana_24(t):
    lines = t("chunks").select("company", tx.first_sentence(F.col("content")).alias("line")).distinct().withColumn("n", F.length("line")).where("n >= 25")
    return co.top_by_key(lines, "company", "n", "line", 3).drop("n")


@query("ana_26_outlook_label", f"{_SCORE} SELECT chunk_id, CASE WHEN score > 0.5 THEN 'very positive' WHEN score > 0.1 THEN 'positive' WHEN score >= -0.1 THEN 'neutral' WHEN score >= -0.5 THEN 'negative' ELSE 'very negative' END AS outlook FROM sc", ("chunks",))
def ana_26(t):
    s = F.col("score")
    return scored(t).select("chunk_id", F.when(s > 0.5, "very positive").when(s > 0.1, "positive").when(s >= -0.1, "neutral").when(s >= -0.5, "negative").otherwise("very negative").alias("outlook"))


@query("ana_27_competitor_view", f"{_SCORE}, g AS (SELECT company, round(sum(score * {_W}) / sum({_W}), 6) AS sentiment FROM sc GROUP BY company), {_CLS}, m AS (SELECT company, round(sum(share * {_W}) / sum({_W}), 4) AS share FROM lb GROUP BY company) SELECT company, sentiment, share FROM g JOIN m USING (company)", ("chunks",))
def ana_27(t):
    a, b = co.company_sentiment(scored(t)), co.class_mix(classed(t))
    return a.join(b, "company").select("company", F.round("sentiment", 6).alias("sentiment"), F.round("share", 4).alias("share"))


@query("ana_28_fingerprint")
def ana_28(t):
    return co.fingerprint(t("chunks"))


@query("ana_30_latest_summaries", "SELECT company, chunk_id, filing_type, row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC, quarter DESC, chunk_id) AS place FROM chunks QUALIFY place <= 3", ("chunks",))
def ana_30(t):
    rows = t("chunks").withColumn("at", F.col("fiscal_year") * 10 + F.col("quarter"))
    return co.top_by_key(rows, "company", "at", "chunk_id", 3).select("company", "chunk_id", "filing_type", "place")


@query("ana_32_company_press", "SELECT chunk_id, company, substring(content, 1, 300) AS preview FROM chunks WHERE filing_type = 'Press Release'", ("chunks",))
def ana_32(t):
    return t("chunks").where("filing_type = 'Press Release'").select("chunk_id", "company", F.substring("content", 1, 300).alias("preview"))
