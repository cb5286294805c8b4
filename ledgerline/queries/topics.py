"""News topics, reprints, events merged by authority, and scoped, aligned and tabled retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import merging as mg
from ledgerline.operators import news as nw
from ledgerline.operators import records as rc
from ledgerline.operators import retrieval as rt
from ledgerline.operators import topics as tp
from ledgerline.queries.base import AS_OF, query
from ledgerline.queries.search import _DEDUP, _NTOK, _PRI, _TOP, _VEC_ALL, _all_queries

_REPL = "lower(coalesce(title, ''))"
for _pattern, _phrase in tp.PHRASES:
    _REPL = f"regexp_replace({_REPL}, '{_pattern}', '{_phrase}', 'g')"
_STOP = ", ".join(f"'{w}'" for w in tp.STOPWORDS)
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace({_REPL}, '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({_STOP}))"
_HITS = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(title, '')), '{p}') THEN '{n}' END" for p, n in tp.PHRASES) + "], lambda x: x IS NOT NULL))"
# Titles with the phrases that invented prose lacks.
_TITLED = "tn AS (SELECT input_pos, url, published, source_type AS company, concat(coalesce(title, ''), CASE input_pos % 11 WHEN 0 THEN ' data centers' WHEN 1 THEN ' Artificial-Intelligence' WHEN 2 THEN ' Supply chain' WHEN 3 THEN ' liquid cooling' ELSE '' END) AS title, input_pos % 12 AS cluster FROM news)"


def _titled(t):
    more = F.element_at(F.array(*[F.lit(x) for x in (" data centers", " Artificial-Intelligence", " Supply chain", " liquid cooling")]), (F.col("input_pos") % 11 + 1).cast("int"))
    title = F.concat(F.coalesce("title", F.lit("")), F.when(F.col("input_pos") % 11 < 4, more).otherwise(""))
    return t("news").select("input_pos", "url", "published", F.col("source_type").alias("company"), title.alias("title"), (F.col("input_pos") % 12).alias("cluster"))


@query("news_10_topic_features", f"{_TITLED} SELECT input_pos, array_to_string(list_filter({_WORDS}, lambda w: length(w) > 2), ' ') AS tokens, array_to_string(list_sort({_HITS}), ' ') AS phrases FROM tn", ("news",))
def news_10(t):
    return _titled(t).select("input_pos", F.array_join(tp.topic_tokens(F.col("title")), " ").alias("tokens"), F.array_join(F.array_sort(tp.phrase_hits(F.col("title"))), " ").alias("phrases"))


@query("news_11_topic_clusters")
def news_11(t):
    return tp.topic_clusters(tp.topic_features(_titled(t)))


_TOPIC = f"""{_TITLED}, ft AS (SELECT *, list_distinct(list_filter({_WORDS}, lambda w: length(w) > 2)) AS tokens, {_HITS} AS phrases FROM tn),
pc AS (SELECT cluster, v, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, v) AS i FROM (SELECT cluster, unnest(phrases) AS v FROM ft) p GROUP BY cluster, v QUALIFY i <= 3),
tc AS (SELECT cluster, v, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, v) AS i FROM (SELECT cluster, unnest(tokens) AS v FROM ft) p GROUP BY cluster, v QUALIFY i <= 5),
pl AS (SELECT cluster, list(v ORDER BY i) AS p FROM pc GROUP BY cluster), tl AS (SELECT cluster, list(v ORDER BY i) AS t FROM tc GROUP BY cluster),
la AS (SELECT c.cluster, CASE WHEN p IS NOT NULL THEN array_to_string(p[1:2], ' ') ELSE array_to_string(coalesce(t, [])[1:4], ' ') END AS label, array_to_string(list_concat(coalesce(p, []), list_filter(coalesce(t, []), lambda x: NOT list_contains(coalesce(p, []), x)))[1:4], ' ') AS keywords FROM (SELECT DISTINCT cluster FROM ft) c LEFT JOIN pl USING (cluster) LEFT JOIN tl USING (cluster)),
un AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY cluster, url ORDER BY published DESC NULLS LAST, input_pos) = 1), ag AS (SELECT *, date_diff('day', CAST(published AS DATE), DATE '2024-01-31') AS age FROM un),
su AS (SELECT cluster, CAST(count_if(age IS NULL OR age <= 7) AS BIGINT) AS d7, CAST(count_if(age IS NULL OR age <= 30) AS BIGINT) AS d30, CAST(count_if(age IS NULL OR age <= 60) AS BIGINT) AS d60, count(DISTINCT company) AS companies FROM ag GROUP BY cluster),
rp AS (SELECT cluster, string_agg(CAST(input_pos AS VARCHAR), ' ' ORDER BY i) AS representatives FROM (SELECT cluster, input_pos, row_number() OVER (PARTITION BY cluster ORDER BY published DESC NULLS LAST, input_pos) AS i FROM un) r WHERE i <= 3 GROUP BY cluster)"""


@query("news_12_cluster_summary", f"{_TOPIC} SELECT su.*, la.label, la.keywords, rp.representatives, row_number() OVER (ORDER BY d7 DESC, d30 DESC, d60 DESC, companies DESC, su.cluster) AS place FROM su JOIN la USING (cluster) JOIN rp USING (cluster) QUALIFY place <= 6", ("news",))
def news_12(t):
    """Clusters are given here: positions modulo twelve."""
    out = tp.cluster_summary(tp.topic_features(_titled(t)), AS_OF[:10])
    return out.select("cluster", "d7", "d30", "d60", "companies", "label", F.array_join("keywords", " ").alias("keywords"), F.array_join(F.transform("representatives", lambda x: x.cast("string")), " ").alias("representatives"), "place")


@query("news_13_trend_key", f"{_TITLED}, w AS (SELECT input_pos, {_WORDS}[1:4] AS ws FROM tn) SELECT input_pos, '30d:' || CASE WHEN len(ws) = 0 THEN 'unknown' ELSE array_to_string(ws, '-') END AS key FROM w", ("news",))
def news_13(t):
    return _titled(t).select("input_pos", tp.trend_key(F.col("title")).alias("key"))


_CLUSTERS = "w AS MATERIALIZED (SELECT input_pos, published, source_type, title, {ntok} AS ws FROM {rows}), e AS MATERIALIZED (SELECT a.input_pos AS a, b.input_pos AS b FROM w a JOIN w b ON a.input_pos <> b.input_pos AND (a.published IS NULL OR b.published IS NULL OR abs(date_diff('day', CAST(a.published AS DATE), CAST(b.published AS DATE))) <= 3) WHERE len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.55), cc(node, root) AS (SELECT input_pos, input_pos FROM w UNION SELECT e.b, cc.root FROM cc JOIN e ON e.a = cc.node AND cc.root < e.b), cl AS (SELECT node AS input_pos, min(root) AS cluster FROM cc GROUP BY node)"
_MERGED = "{heads}, cr AS (SELECT input_pos, cluster, row_number() OVER (PARTITION BY cluster ORDER BY {pri}, length(title) DESC, input_pos) = 1 AS kept FROM cl JOIN w USING (input_pos))"


@query("news_05_merge_clusters", "RECURSIVE " + _MERGED.format(heads=_CLUSTERS.format(ntok=_NTOK, rows="news"), pri=_PRI) + " SELECT * FROM cr", ("news",))
def news_05_merged(t):
    return nw.merge_reprints(t("news"))


@query("news_18_pipeline_diagnostics", "RECURSIVE " + _DEDUP + ", " + _MERGED.format(heads=_CLUSTERS.format(ntok=_NTOK, rows="ex"), pri=_PRI) + ", c AS (SELECT (SELECT count(*) FROM news) AS n0, (SELECT count(*) FROM n1 WHERE trim(title) <> '' AND trim(url) <> '') AS n1, (SELECT count(*) FROM ex) AS n2, (SELECT count(*) FROM cr WHERE kept) AS n3, (SELECT count(*) FROM cr JOIN w USING (input_pos) WHERE kept AND date_diff('day', CAST(published AS DATE), DATE '2024-01-31') <= 14) AS n4) SELECT 'normalize' AS stage, n0 AS n_in, n1 AS n_out FROM c UNION ALL SELECT 'dedup_exact', n1, n2 FROM c UNION ALL SELECT 'merge_reprints', n2, n3 FROM c UNION ALL SELECT 'filter_age', n3, n4 FROM c", ("news",))
def news_18(t):
    return tp.stage_counts(t("news"), AS_OF[:10], 14)


@query("evt_03_amount_millions", "SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice * 1000 WHEN 1 THEN l_extendedprice / 1000 ELSE l_extendedprice END, 6) AS millions FROM lineitem")
def evt_03(t):
    unit = F.element_at(F.array(F.lit("billions"), F.lit("thousands"), F.lit("millions")), F.col("l_linenumber") % 3 + 1)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(rc.amount_millions(F.col("l_extendedprice"), unit), 6).alias("millions"))


_AUTHORITY = ["SEC_10K", "SEC_8K", "TRANSCRIPT", "NEWS", "WEB"]


def _order_events(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in _AUTHORITY]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), (F.col("o_custkey") % 500).cast("string")).alias("company"), F.col("o_orderpriority").alias("type"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), kind.alias("doc_type"))


@query("evt_05_merge_events")
def evt_05(t):
    return mg.merge_events(_order_events(t), _AUTHORITY)


# Retrieval over hits of every query whose id is divisible by 100, with the chunk of the same id.
_HITCHUNK = f"{_VEC_ALL}, hc AS (SELECT h.query_id, h.doc_id, h.label, round(h.score, 9) AS score, c.company, c.fiscal_year, c.quarter, c.filing_type, c.chunk_type, c.content FROM hits h JOIN chunks c ON c.chunk_id = h.doc_id)"


def _hit_chunks(t, most, *groups, where="true"):
    """The ``most`` best chunks of each query (and group) at least, with the beginning of their content and a hash of it."""
    chunks = t("chunks").withColumnRenamed("chunk_id", "doc_id").where(where)
    chunks = chunks.withColumn("head", F.substring("content", 1, 120)).withColumn("said", F.xxhash64("content")).drop("lang", "content")
    vectors = t("embeddings").withColumnRenamed("vec_id", "doc_id")
    return rt.vector_best(_all_queries(t).select("query_id", "embedding"), vectors.join(chunks, "doc_id"), most, groups, 9)


def _ranked(rows, keys, most, name="place"):
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn(name, F.row_number().over(by).cast("long")).where(F.col(name) <= most)


@query("ret_06_table_search", f"{_HITCHUNK}, tt AS (SELECT query_id, doc_id, score, quarter FROM hc WHERE chunk_type = 'table' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20) SELECT query_id, doc_id, round(score, 5) AS score, {_TOP} FROM tt WHERE quarter IN (1, 3) QUALIFY place <= 10", ("chunks",))
def ret_06(t):
    """Twice as many table chunks as wanted, then those of the wanted kind, then the ten best."""
    return rt.table_search(_hit_chunks(t, 20, where="chunk_type = 'table'"), F.col("quarter").isin(1, 3), 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "place")


@query("ret_13_dedup_jaccard")
def ret_13(t):
    return tp.dedup_in_order(t("documents").select(F.col("doc_id").alias("id"), "source", "text"), "source")


@query("ret_14_dedup_hits_keyed", f"{_HITCHUNK}, k AS (SELECT query_id, doc_id, score, {_TOP} FROM hc QUALIFY place <= 50) SELECT query_id, doc_id, round(score, 5) AS score FROM (SELECT k.*, row_number() OVER (PARTITION BY k.query_id, c.company, c.filing_type, c.quarter, left(c.content, 120) ORDER BY score DESC, doc_id) AS n FROM k JOIN chunks c ON c.chunk_id = k.doc_id) z WHERE n = 1", ("chunks",))
def ret_14_keyed(t):
    return rt.dedup_hits(_ranked(_hit_chunks(t, 50), ["query_id"], 50), ["company", "filing_type", "quarter"], "head").select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("ret_15_search_by_fiscal_period", f"{_HITCHUNK}, p AS (SELECT query_id, fiscal_year, quarter, doc_id FROM hc QUALIFY row_number() OVER (PARTITION BY query_id, fiscal_year, quarter ORDER BY score DESC, doc_id) <= 2), g AS (SELECT query_id, CAST(y AS INT) AS fiscal_year, CAST(n AS INT) AS quarter FROM q, range(2023, 2027) a(y), range(1, 5) b(n)) SELECT g.*, p.doc_id, p.doc_id IS NULL AS missing FROM g LEFT JOIN p USING (query_id, fiscal_year, quarter)", ("chunks",))
def ret_15_periods(t):
    asked = _all_queries(t).select("query_id", F.explode(F.sequence(F.lit(2023), F.lit(2026))).alias("fiscal_year")).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return rt.search_by_period(_hit_chunks(t, 2, "fiscal_year", "quarter"), asked, 2)


_SCOPE = "sc AS (SELECT q.query_id, unnest([m.label, (m.label + 1) % 10, (m.label + 2) % 10]) AS label FROM q JOIN embeddings m ON m.vec_id = q.query_id)"


def _scope(t):
    label = F.col("label")
    return _all_queries(t).select("query_id", F.explode(F.array(label, (label + 1) % 10, (label + 2) % 10)).alias("label"))


@query("ret_19_search_scope", f"{_HITCHUNK}, {_SCOPE}, m AS (SELECT hc.* FROM hc JOIN sc USING (query_id, label) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) <= 12), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, label, company, quarter, left(content, 120) ORDER BY score DESC, doc_id) = 1) SELECT query_id, label, doc_id, round(score, 5) AS score, {_TOP} FROM d QUALIFY place <= 30", ("chunks",))
def ret_19(t):
    """Three labels a query as its scope: 12 hits of each (30 over 3, and 2), merged, without copies, the 30 best."""
    out = rt.search_scope(_hit_chunks(t, 12, "label"), _scope(t), "label", 30, ["company", "quarter"], "head")
    return out.select("query_id", "label", "doc_id", F.round("score", 5).alias("score"), "place")


@query("ret_23_comparison_table", f"{_HITCHUNK}, {_SCOPE}, m AS (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) <= 5), y AS (SELECT query_id, label, string_agg(CAST(fiscal_year AS VARCHAR), ', ' ORDER BY fiscal_year DESC) AS years FROM (SELECT DISTINCT query_id, label, fiscal_year FROM m QUALIFY dense_rank() OVER (PARTITION BY query_id, label ORDER BY fiscal_year DESC) <= 3) z GROUP BY ALL), a AS (SELECT query_id, label, count(*) AS n, bool_or(chunk_type = 'table') AS has_tables, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY score DESC, doc_id) AS evidence FROM m GROUP BY ALL) SELECT sc.query_id, sc.label, coalesce(n, 0) AS results, coalesce(has_tables, false) AS has_tables, coalesce(years, 'N/A') AS years, array_to_string(string_split(evidence, ' ')[1:2], ' ') AS evidence, n IS NULL AS missing FROM sc LEFT JOIN a USING (query_id, label) LEFT JOIN y USING (query_id, label)", ("chunks",))
def ret_23(t):
    """Results, tables, years and the two best pieces of evidence of every label in the scope."""
    return rt.comparison_table(_ranked(_hit_chunks(t, 5, "label"), ["query_id", "label"], 5, "n"), _scope(t), "label")


@query("ret_10_boost_rules", f"{_HITCHUNK}, k AS (SELECT *, {_TOP} FROM hc QUALIFY place <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fiscal_year * 10 + quarter DESC, doc_id) - 1 AS i FROM k) SELECT query_id, doc_id, round(score + CASE WHEN fiscal_year = 2023 THEN 0.15 ELSE 0 END + CASE WHEN fiscal_year = 2023 AND quarter = 2 THEN 0.25 ELSE -0.15 END + CASE chunk_type WHEN 'table' THEN 0.12 WHEN 'parent' THEN 0.08 ELSE 0 END + CASE WHEN filing_type = '10-K' THEN 0.1 ELSE 0 END + greatest(0, 0.1 - 0.005 * i), 5) AS score FROM r", ("chunks",))
def ret_10_rules(t):
    hits = _ranked(_hit_chunks(t, 30), ["query_id"], 30)
    year, quarter = F.col("fiscal_year") == 2023, F.col("quarter") == 2
    rules = [(year, 0.15), (year & quarter, 0.25), (~(year & quarter), -0.15), (F.col("chunk_type") == "table", 0.12), (F.col("chunk_type") == "parent", 0.08), (F.col("filing_type") == "10-K", 0.1)]
    return rt.boost(rt.recency(hits), rules).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("ret_11_evidence_coverage", f"{_HITCHUNK}, {_SCOPE}, k AS (SELECT *, {_TOP} FROM hc QUALIFY place <= 40), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) <= 4), a AS (SELECT query_id, label, count(*) AS n, bool_or(chunk_type = 'table') AS has_tables, array_to_string(list_sort(list(DISTINCT fiscal_year)), ',') AS years FROM b GROUP BY ALL) SELECT sc.query_id, sc.label, coalesce(n, 0) AS n, coalesce(has_tables, false) AS has_tables, coalesce(years, '') AS years, coalesce(n, 0) < 2 AS gap FROM sc LEFT JOIN a USING (query_id, label)", ("chunks",))
def ret_11_coverage(t):
    return rt.evidence_coverage(rt.balance(_ranked(_hit_chunks(t, 40), ["query_id"], 40), "label", 4), _scope(t), "label")


@query("ret_18_focused_excerpt", "a AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'the') > 0 THEN instr(lower(text), 'the') END AS k, CASE WHEN regexp_matches(text, '(19|20)[0-9]{2}') THEN instr(text, regexp_extract(text, '(19|20)[0-9]{2}')) END AS y FROM documents), b AS (SELECT doc_id, text, coalesce(least(k, y), k, y) AS p FROM a) SELECT doc_id, md5(CASE WHEN p IS NULL THEN left(text, 2500) ELSE substring(text, greatest(p - 500, 1), 2500) END) AS digest FROM b")
def ret_18_focused(t):
    return t("documents").select("doc_id", F.md5(rt.focused_excerpt(F.col("text"), "the", r"(19|20)[0-9]{2}")).alias("digest"))


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ('the', 'and', 'for')))"


@query("ret_20_evidence_gate_terms", f"{_HITCHUNK}, k AS (SELECT *, {_TOP} FROM hc QUALIFY place <= 5), o AS (SELECT k.query_id, k.score, len(list_intersect({_TERMS.format(c='k.content')}, {_TERMS.format(c='a.text')})) AS overlap FROM k JOIN documents a ON a.doc_id = k.query_id) SELECT query_id, bool_or(score >= 0.35) AND bool_or(overlap >= 1) AS passed, max(overlap) AS overlap FROM o GROUP BY query_id", ("chunks",))
def ret_20_terms(t):
    from ledgerline.functions.text import query_terms

    said = t("chunks").select(F.col("chunk_id").alias("doc_id"), F.xxhash64("content").alias("said"), "content")
    hits = _ranked(_hit_chunks(t, 5), ["query_id"], 5).join(said, ["doc_id", "said"]).select("query_id", "score", query_terms(F.coalesce("content", F.lit("")), ["the", "and", "for"]).alias("ws"))
    asked = t("documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), query_terms(F.coalesce("text", F.lit("")), ["the", "and", "for"]).alias("terms"))
    return rt.evidence_gate(hits, asked)


@query("ret_22_grouped_context", f"{_HITCHUNK}, k AS (SELECT *, {_TOP} FROM hc QUALIFY place <= 12) SELECT query_id, string_agg(company || ' ' || fiscal_year || ' ' || filing_type || ' ' || doc_id, ' | ' ORDER BY company, fiscal_year DESC, filing_type, CASE WHEN chunk_type = 'table' THEN 0 ELSE 1 END, score DESC, doc_id) AS context FROM k GROUP BY query_id", ("chunks",))
def ret_22_grouped(t):
    return rt.grouped_context(_ranked(_hit_chunks(t, 12), ["query_id"], 12))


@query("ret_24_pick_winner", "a AS (SELECT q.query_id, q.question, v.entity, max_by(v.value, v.end_d) AS value FROM (SELECT query_id, question || CASE query_id % 3 WHEN 0 THEN ' which is lowest?' WHEN 1 THEN ' who has the highest?' ELSE ' who has least?' END AS question FROM questions) q, (SELECT entity, end_d, value FROM metric_values WHERE metric = 'capex') v GROUP BY ALL) SELECT query_id, CASE WHEN regexp_matches(question, 'lowest|least|smallest|fewest') THEN arg_min(entity, value) ELSE arg_max(entity, value) END AS winner FROM a GROUP BY query_id, question", ("questions", "metric_values"))
def ret_24_winner(t):
    more = F.element_at(F.array(F.lit(" which is lowest?"), F.lit(" who has the highest?"), F.lit(" who has least?")), F.col("query_id") % 3 + 1)
    latest = t("metric_values").where("metric = 'capex'").groupBy("entity").agg(F.max_by("value", "end_d").alias("value"))
    answers = t("questions").select("query_id", F.concat("question", more).alias("question")).join(F.broadcast(latest))  # one row a company
    return rt.pick_winner(answers, "entity", "value")
