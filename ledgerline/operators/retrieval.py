"""Search over chunks and vectors: exact nearest neighbours, BM25, fusion, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.nearest import bm25_rows, dealt, nearest_rows

#: Rows of queries up to which these are broadcast to the corpus; more are shuffled by the caller's blocks.
MAX_QUERIES = 10_000
#: Distinct words of all queries up to which these are broadcast.
MAX_TERMS = 500_000


def unit(vector: Column) -> Column:
    """The vector over its length; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(hits: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best hits of each query; Spark limits each partition before it shuffles."""
    by = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return hits.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= k)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact cosine neighbours of a stated set of queries (query_id, embedding) in (doc_id, embedding), in blocks of queries."""
    return top_k(vector_best(queries, corpus.select("doc_id", "embedding"), k).select("query_id", "doc_id", "score"), k)


def vector_best(queries: DataFrame, corpus: DataFrame, k: int, groups: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Rows (query_id, score, and what (doc_id, embedding, ...) has beside its vector) that hold the k best of each query and group, by cosine, then doc_id.

    Each task keeps its own k best, so some more come back and the caller ranks them. With
    ``digits`` scores are rounded first. Queries go in blocks of MAX_QUERIES / 2 on average.
    """
    blocks = queries.count() * 2 // MAX_QUERIES + 1
    v = dealt(corpus).withColumn("v", unit(F.col("embedding"))).drop("embedding")
    out = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        part = nearest_rows(block.select("query_id", unit(F.col("embedding")).alias("q")), v, k, list(groups), digits)
        out = part if out is None else out.unionByName(part)
    return out if digits is None else out.withColumn("score", F.round("score", digits))


def vector_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cosine of every query and document, with the document's other columns, for few rows; queries go in blocks of MAX_QUERIES / 2 on average."""
    blocks = queries.count() * 2 // MAX_QUERIES + 1
    v = corpus.withColumn("v", unit(F.col("embedding"))).drop("embedding")
    out = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        q = F.broadcast(block.select("query_id", unit(F.col("embedding")).alias("q")))
        part = v.join(q).withColumn("score", dot(F.col("q"), F.col("v"))).drop("q", "v")
        out = part if out is None else out.unionByName(part)
    return out


def filter_chunks(chunks: DataFrame, where: dict, contains: str | None = None) -> DataFrame:
    """Equality and membership on columns, and a substring of the content."""
    out = chunks
    for column, value in where.items():
        out = out.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return out.where(F.col("content").contains(contains)) if contains else out


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _terms(queries: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, term) of the queries' distinct words, and whether they are few enough to be broadcast."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms, terms.count() <= MAX_TERMS


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi scores of (query_id, text) over (doc_id, text); only the queries' terms are looked up.

    Documents are scored against a block of queries where they lie, and each task gives its k best
    of every query. Blocks hold MAX_TERMS / 2 terms of queries on average; each reads the documents twice.
    Texts of one id score together: words count by length of text, and those scores add up.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    blocks = terms.count() * 2 // MAX_TERMS + 1
    split = dealt(docs.select("doc_id", "text")).select("doc_id", F.lit(1).alias("copies"), tokens(F.col("text")).alias("ws"))
    twice = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        each = F.array_repeat(F.size("ws"), F.size("ws"))
        words = split.withColumn("of", each).join(twice, F.col("doc_id").eqNullSafe(F.col("id")), "left")
        whole = words.where("n > 1").groupBy("doc_id").agg(F.count("*").cast("int").alias("copies"), F.collect_list(F.struct("ws", "of")).alias("x"))
        split = words.where("n IS NULL").drop("id", "n").unionByName(whole.select("doc_id", "copies", F.flatten("x.ws").alias("ws"), F.flatten("x.of").alias("of")))
    out = None
    for i in range(blocks):
        part = bm25_rows(terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), split, k, k1, b)
        out = part if out is None else out.unionByName(part)
    return top_k(out.withColumn("score", F.round("score", 9)), k)


def keyword_overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Share of a query's distinct terms that a document has; terms are broadcast as in ``bm25``."""
    terms, few = _terms(queries)
    q = terms.join(terms.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    d = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    hits = d.join(F.broadcast(q) if few else q, "term").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("c"))
    return top_k(hits.select("query_id", "doc_id", (F.col("c") / F.col("n")).alias("score")), k)


def rrf(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, place)."""
    rows = None
    for r in rankings:
        part = r.select("query_id", "doc_id", (1.0 / (constant + F.col("place"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score")), k)


def hybrid(vector: DataFrame, lexical: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """The fused top k of a vector and a lexical ranking, and which of them found each (vector, lexical or both)."""
    fused = rrf([vector, lexical], k, constant)
    seen = vector.select("query_id", "doc_id", F.lit(1).alias("bit")).unionByName(lexical.select("query_id", "doc_id", F.lit(2).alias("bit")))
    bits = seen.groupBy("query_id", "doc_id").agg(F.sum("bit").alias("bits"))
    found_by = F.element_at(F.array(F.lit("vector"), F.lit("lexical"), F.lit("both")), F.col("bits").cast("int"))
    return fused.join(bits, ["query_id", "doc_id"]).withColumn("found_by", found_by).drop("bits")


def time_decay(hits: DataFrame, as_of: str, rates: dict[str, float], default: float, kind: str = "kind", at: str = "at") -> DataFrame:
    """score * exp(-rate * days / 365), the rate by kind of document."""
    rate = F.lit(default)
    for name, r in rates.items():
        rate = F.when(F.col(kind) == name, r).otherwise(rate)
    days = F.datediff(F.lit(as_of).cast("date"), F.coalesce(F.col(at).cast("date"), F.date_sub(F.lit(as_of).cast("date"), 180)))
    return hits.withColumn("score", F.col("score") * F.exp(-rate * days / 365))


def boost(hits: DataFrame, rules: list[tuple[Column, float]]) -> DataFrame:
    """Scores plus the amount of every rule that holds."""
    out = F.col("score")
    for condition, amount in rules:
        out = out + F.when(condition, amount).otherwise(0.0)
    return hits.withColumn("score", out)


def balance(hits: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` best hits of each query and group."""
    by = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def expand_parents(hits: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Distinct parents of the hits by their best place."""
    parents = hits.join(chunks.select(F.col("chunk_id").alias("doc_id"), "parent_id"), "doc_id").groupBy("query_id", "parent_id").agg(F.min("place").alias("best"))
    by = Window.partitionBy("query_id").orderBy("best", "parent_id")
    return parents.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= most)


def inject(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of hits and rule-scored ones; the better score of a document wins."""
    return hits.select("query_id", "doc_id", "score").unionByName(extra.select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def combine_scores(hits: DataFrame, scores: DataFrame, weight: float = 0.7) -> DataFrame:
    """(1 - weight) * score + weight * a supplied score, or the score alone without one."""
    both = hits.join(scores.select("query_id", "doc_id", F.col("score").alias("other")), ["query_id", "doc_id"], "left")
    return both.withColumn("score", F.when(F.col("other").isNotNull(), (1 - weight) * F.col("score") + weight * F.col("other")).otherwise(F.col("score"))).drop("other")


def _first(rows: DataFrame, keys: list, most: int) -> DataFrame:
    by = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def table_search(hits: DataFrame, kind: Column, k: int) -> DataFrame:
    """The k best table chunks of a kind among the 2k best table chunks of each query."""
    return top_k(_first(hits.where("chunk_type = 'table'"), [], 2 * k).where(kind), k)


def dedup_hits(hits: DataFrame, keys: list[str], content: str, prefix: int = 120) -> DataFrame:
    """The best hit of each query, key and beginning of the content."""
    return _first(hits, [*keys, F.substring(content, 1, prefix)], 1)


def search_by_period(hits: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The best hits of every asked (query_id, fiscal_year, quarter); a period without one has a null doc_id and ``missing``."""
    found = _first(hits, ["fiscal_year", "quarter"], most).select("query_id", "fiscal_year", "quarter", "doc_id")
    return asked.join(found, ["query_id", "fiscal_year", "quarter"], "left").withColumn("missing", F.col("doc_id").isNull())


def search_scope(hits: DataFrame, scope: DataFrame, by: str, n: int, keys: list[str], content: str) -> DataFrame:
    """Hits within each query's ``scope`` (query_id, ``by``): max(8, n / members + 2) of each member, without copies, then the n best."""
    sized = scope.withColumn("_m", F.count("*").over(Window.partitionBy("query_id")))
    inside = hits.join(sized, ["query_id", by])
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", by).orderBy(F.desc("score"), "doc_id")))
    merged = ranked.where(F.col("_n") <= F.greatest(F.lit(8), F.floor(F.lit(n) / F.col("_m")) + 2)).drop("_n", "_m")
    return top_k(dedup_hits(merged, [by, *keys], content), n)


def comparison_table(hits: DataFrame, scope: DataFrame, by: str) -> DataFrame:
    """Results, tables, the three latest years and the two best documents of each member of a scope; members without hits are missing."""
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))), 1, 2), lambda x: x["doc_id"].cast("string"))
    years = F.slice(F.sort_array(F.collect_set("fiscal_year"), False), 1, 3)
    found = hits.groupBy("query_id", by).agg(F.count("*").alias("n"), F.bool_or(F.col("chunk_type") == "table").alias("t"), F.array_join(years.cast("array<string>"), ", ").alias("y"), F.array_join(best, " ").alias("evidence"))
    rows = scope.join(found, ["query_id", by], "left")
    return rows.select("query_id", by, F.coalesce("n", F.lit(0)).alias("results"), F.coalesce("t", F.lit(False)).alias("has_tables"), F.coalesce("y", F.lit("N/A")).alias("years"), "evidence", F.col("n").isNull().alias("missing"))


def recency(hits: DataFrame, most: float = 0.1, step: float = 0.005) -> DataFrame:
    """Scores plus ``most`` for the newest period of a query's hits and ``step`` less for each place after it, 0 at least."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("fiscal_year") * 10 + F.col("quarter")), "doc_id")) - 1
    return hits.withColumn("_i", place).withColumn("score", F.col("score") + F.greatest(F.lit(0.0), most - step * F.col("_i"))).drop("_i")


def evidence_coverage(hits: DataFrame, scope: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Hits, tables and years of each member of a scope; fewer than ``least`` hits are a gap."""
    found = hits.groupBy("query_id", by).agg(F.count("*").alias("n"), F.bool_or(F.col("chunk_type") == "table").alias("t"), F.array_join(F.sort_array(F.collect_set("fiscal_year")).cast("array<string>"), ",").alias("y"))
    n = F.coalesce("n", F.lit(0))
    return scope.join(found, ["query_id", by], "left").select("query_id", by, n.alias("n"), F.coalesce("t", F.lit(False)).alias("has_tables"), F.coalesce("y", F.lit("")).alias("years"), (n < least).alias("gap"))


def focused_excerpt(text: Column, word: str, year: str, size: int = 2500, before: int = 500) -> Column:
    """``size`` characters that begin ``before`` the first word or year, whichever comes first; else the beginning."""
    k, y = F.instr(F.lower(text), word), F.instr(text, F.regexp_extract(text, year, 0))
    at = F.least(F.when(k > 0, k), F.when(text.rlike(year), y))
    return F.when(at.isNull(), F.substring(text, 1, size)).otherwise(F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(size)))


def evidence_gate(hits: DataFrame, asked: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, passed, overlap) of hits (query_id, score, ws) and questions (query_id, terms): a score of ``least`` and one term in common."""
    both = hits.join(asked, "query_id").withColumn("overlap", F.size(F.array_intersect("ws", "terms")))
    return both.groupBy("query_id").agg((F.bool_or(F.col("score") >= least) & F.bool_or(F.col("overlap") >= 1)).alias("passed"), F.max("overlap").alias("overlap"))


def grouped_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): hits by company, falling year, section, tables first, falling score."""
    order = F.struct("company", (-F.col("fiscal_year")).alias("y"), "filing_type", (F.col("chunk_type") != "table").alias("t"), (-F.col("score")).alias("s"), "doc_id")
    line = lambda x: F.concat_ws(" ", x["company"], (-x["y"]).cast("string"), x["filing_type"], x["doc_id"].cast("string"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), line), " | ").alias("context"))


def pick_winner(answers: DataFrame, who: str, value: str) -> DataFrame:
    """(query_id, winner): the least value where the question (query_id, question, ...) asks for it, else the greatest."""
    low = F.lower("question").rlike("lowest|least|smallest|fewest")
    return answers.groupBy("query_id", "question").agg(F.min_by(who, value).alias("lo"), F.max_by(who, value).alias("hi")).select("query_id", F.when(low, F.col("lo")).otherwise(F.col("hi")).alias("winner"))


def vector_topk_where(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Cosine neighbours of queries (query_id, embedding, ``keys``) among rows (doc_id, embedding, ``keys``) of equal keys: an equality join, whatever the number of queries."""
    q = queries.select("query_id", *keys, unit(F.col("embedding")).alias("q"))
    v = corpus.select("doc_id", *keys, unit(F.col("embedding")).alias("v"))
    return top_k(v.join(q, keys).select("query_id", "doc_id", dot(F.col("q"), F.col("v")).alias("score")), k)
