"""News items: normalising, exact and near duplicates, topics, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.graph import connected_components

PRIORITY = ["company_news_rss", "brave", "market_commentary_rss"]
STOPWORDS = ["the", "a", "an", "of", "to", "in", "and", "for", "on", "with"]


def _order(col: Column, values: list[str]) -> Column:
    out = F.lit(len(values))
    for i, v in enumerate(values):
        out = F.when(col == v, i).otherwise(out)
    return out


def normalize(raw: DataFrame) -> DataFrame:
    """Items with a title and url; description of 500 characters at most; canonical url; source by domain."""
    rows = raw.where("trim(title) <> '' AND trim(url) <> ''")
    return rows.select("input_pos", tx.canonical_url(F.col("url")).alias("url"), F.trim("title").alias("title"), F.substring("title", 1, 500).alias("description"), tx.root_domain(F.col("url")).alias("source"), "published", "source_type", "intent")


def dedup_exact(news: DataFrame) -> DataFrame:
    """One item a canonical url: best source type, then a date, the longer title, the earlier input; intents of all."""
    by = Window.partitionBy("url").orderBy(_order(F.col("source_type"), PRIORITY), F.col("published").isNull(), F.desc(F.length("title")), "input_pos")
    intents = F.sort_array(F.collect_set("intent").over(Window.partitionBy("url")))
    return news.withColumn("intents", intents).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def title_tokens(title: Column) -> Column:
    """Sorted distinct words of two characters or more without stopwords."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9]+"), 0)
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))))


def similar_lists(items: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """(src, dst, jaccard) of items (id, ws and ``keys``) with equal keys and word lists at the threshold, src < dst.

    ``ws`` holds distinct words. Only rare words make pairs: of n words the n - ceil(threshold * n) + 1
    rarest, one of which two similar lists must share. Give every list once: equal lists all meet.
    """
    each = items.select("id", *keys, F.explode("ws").alias("w"))
    df = each.groupBy(*keys, "w").agg(F.count("*").alias("df"))
    ranked = each.join(df, [*keys, "w"]).groupBy("id", *keys).agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("r"))
    keep = F.size("r") - F.ceil(threshold * F.size("r")) + 1
    prefix = ranked.select("id", *keys, F.size("r").alias("n"), F.explode(F.slice("r", 1, keep.cast("int"))).alias("x")).select("id", *keys, "n", "x.w")
    left, right = prefix.select(F.col("id").alias("src"), F.col("n").alias("n_src"), *keys, "w"), prefix.select(F.col("id").alias("dst"), F.col("n").alias("n_dst"), *keys, "w")
    sized = (F.least("n_src", "n_dst") >= threshold * F.greatest("n_src", "n_dst")) & (F.col("src") < F.col("dst"))
    pairs = left.join(right, [*keys, "w"]).where(sized).select("src", "dst").distinct()
    side = lambda n: items.select(F.col("id").alias(n), F.col("ws").alias(f"ws_{n}"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    jaccard = F.size(F.array_intersect("ws_src", "ws_dst")) / F.size(F.array_union("ws_src", "ws_dst"))
    return both.select("src", "dst", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def _titles(news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (input_pos, published, title_id) and distinct token lists (id, ws); a list's id is its least input_pos."""
    items = news.select("input_pos", "published", title_tokens(F.col("title")).alias("ws")).where(F.size("ws") > 0)
    lists = items.groupBy("ws").agg(F.min("input_pos").alias("id"))
    return items.join(lists, "ws").select("input_pos", "published", F.col("id").alias("title_id")), lists


def reprint_pairs(news: DataFrame, threshold: float = 0.55, days: int = 3) -> DataFrame:
    """All pairs of items of similar titles (Jaccard over tokens) and near dates; items without a date pass.

    Titles are compared once for each distinct token list; the date is part of the join of
    their items. The output holds every pair of a title's reprints: for clusters alone, ``reprint_edges`` is linear.
    """
    items, lists = _titles(news)
    near = similar_lists(lists, threshold)
    near = near.select("src", "dst", "jaccard").union(near.select("dst", "src", "jaccard")).union(lists.select("id", "id", F.lit(1.0)))
    slot = F.floor(F.datediff("published", F.lit("1970-01-01").cast("date")) / max(days, 1))
    side = lambda n, p: items.select(F.col("title_id").alias(n), F.col("input_pos").alias(f"{p}_pos"), F.col("published").alias(f"{p}_at"), slot.alias(f"{p}_slot"))
    x, y = near.join(side("src", "x"), "src"), side("dst", "y")
    dated = x.where("x_at IS NOT NULL").withColumn("y_slot", F.explode(F.array(*[F.col("x_slot") + i for i in (-1, 0, 1)]))).join(y, ["dst", "y_slot"]).where(F.abs(F.datediff("x_at", "y_at")) <= days)
    loose = x.join(y, "dst").where("x_at IS NULL OR y_at IS NULL")
    out = dated.select("x_pos", "y_pos", "jaccard").unionByName(loose.select("x_pos", "y_pos", "jaccard")).where("x_pos < y_pos")
    return out.select(F.col("x_pos").alias("src"), F.col("y_pos").alias("dst"), "jaccard")


def reprint_edges(news: DataFrame, threshold: float = 0.55, days: int = 3) -> DataFrame:
    """(src, dst) that connect the same items as ``reprint_pairs``, in proportion to the items of similar titles.

    Of one title, and of two similar ones together, items in the order of their dates are
    linked to the next if it is near enough; every item is linked to its title's first undated one.
    """
    items, lists = _titles(news)
    near = similar_lists(lists, threshold).select("src", "dst")
    member = items.select(F.col("title_id").alias("t"), "input_pos", "published")
    both = near.select("src", "dst", F.explode(F.array("src", "dst")).alias("t")).union(lists.select("id", "id", "id"))
    met = both.join(member, "t")
    by = Window.partitionBy("src", "dst").orderBy("published", "input_pos")
    chain = met.where("published IS NOT NULL").withColumn("prev", F.lag("input_pos").over(by)).withColumn("prev_at", F.lag("published").over(by))
    chain = chain.where(F.datediff("published", "prev_at") <= days).select("prev", "input_pos")
    undated = member.where("published IS NULL").groupBy("t").agg(F.min("input_pos").alias("u"))
    ends = both.select("src", "dst", "t").join(undated, "t").select("src", "dst", "u").distinct()
    star = met.select("src", "dst", "input_pos").join(ends, ["src", "dst"]).where("u <> input_pos").select("u", "input_pos")
    return chain.union(star).toDF("src", "dst").distinct()


def merge_reprints(news: DataFrame, threshold: float = 0.55, days: int = 3) -> DataFrame:
    """(input_pos, cluster, kept): components of similar items; the best source type stays, then the longer title."""
    labels = connected_components(reprint_edges(news, threshold, days)).withColumnRenamed("node", "input_pos")
    rows = news.join(labels, "input_pos", "left").withColumn("cluster", F.coalesce("component", "input_pos"))
    by = Window.partitionBy("cluster").orderBy(_order(F.col("source_type"), PRIORITY), F.desc(F.length("title")), "input_pos")
    return rows.select("input_pos", "cluster", (F.row_number().over(by) == 1).alias("kept"))


def filter_age(news: DataFrame, as_of: str, days: int) -> DataFrame:
    """Items of the last days; those without a date stay."""
    return news.where(F.col("published").isNull() | (F.datediff(F.lit(as_of).cast("date"), F.col("published").cast("date")) <= days))


def window_counts(rows: DataFrame, key: str, at: str, as_of: str) -> DataFrame:
    """Rows of the last 7, 30 and 60 days by key; those without a date count in all."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(at).cast("date"))
    return rows.groupBy(key).agg(*[F.count_if(age.isNull() | (age <= d)).alias(f"d{d}") for d in (7, 30, 60)])


def event_key(company: Column, title: Column, day: Column) -> Column:
    """company:first-four-words-date, 80 characters at most."""
    slug = F.array_join(F.slice(F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9]+"), 0), 1, 4), "-")
    return F.substring(F.concat(F.lower(company), F.lit(":"), slug, F.lit("-"), F.date_format(day, "yyyy-MM-dd")), 1, 80)


def score(news: DataFrame, as_of: str, tier_1: list[str], tier_2: list[str], intents: dict[str, float]) -> DataFrame:
    """Freshness by steps of age + tier of the domain + weight of the intent."""
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("published").cast("timestamp"))) / 3600
    fresh = F.when(hours <= 6, 1.0).when(hours <= 24, 0.75).when(hours <= 72, 0.5).when(hours <= 168, 0.25).when(hours <= 720, 0.1).otherwise(0.0)
    domain = tx.root_domain(F.col("url"))
    tier = F.when(domain.isin(tier_1), 1.0).when(domain.isin(tier_2), 0.5).otherwise(0.2)
    weight = F.lit(0.0)
    for name, w in intents.items():
        weight = F.when(F.col("intent") == name, w).otherwise(weight)
    return news.withColumn("score", fresh + tier + weight)


def top_news(scored: DataFrame, per_domain: int, n: int) -> DataFrame:
    """The first items of each domain in input order, then the n best of each source type."""
    by_domain = Window.partitionBy("source_type", tx.root_domain(F.col("url"))).orderBy("input_pos")
    capped = scored.withColumn("_d", F.row_number().over(by_domain)).where(F.col("_d") <= per_domain).drop("_d")
    by = Window.partitionBy("source_type").orderBy(F.desc("score"), "input_pos")
    return capped.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= n)


def stale_keys(ledger: DataFrame, wanted: DataFrame, key: str, at: str, hours: int, as_of: str) -> DataFrame:
    """Wanted keys without a batch that is young enough."""
    fresh = ledger.groupBy(key).agg(F.max(at).alias("last")).where(F.col("last") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours)))
    return wanted.join(fresh, key, "left_anti")


def filter_junk(news: DataFrame, source_type: str, domains: list[str], titles: list[str]) -> DataFrame:
    """Items without those of one source type that lie on a listed host or have a listed part in the title."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[^:]+://([^/?#:]*)", 1)), r"^www\.", "")
    junk = host.isin(domains)
    for t in titles:
        junk = junk | F.lower("title").contains(t)
    return news.where(~((F.col("source_type") == source_type) & F.coalesce(junk, F.lit(False))))


def filter_age_by(news: DataFrame, as_of: str, days: dict[str, int], default: int) -> DataFrame:
    """Items of the last days, as many as their source type has; those without a date stay."""
    most = F.lit(default)
    for kind, n in days.items():
        most = F.when(F.col("source_type") == kind, n).otherwise(most)
    return news.where(F.col("published").isNull() | (F.datediff(F.lit(as_of).cast("date"), F.col("published").cast("date")) <= most))


def newest(news: DataFrame, n: int) -> DataFrame:
    """The n newest items with their ``place``; undated ones last, ties by input position."""
    order = [F.desc_nulls_last("published"), F.col("input_pos")]
    return news.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows


def aggregate_feed(parts: dict[str, DataFrame]) -> DataFrame:
    """One feed of several, each row with the name of its part."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("feed", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def with_match_bonus(scored: DataFrame) -> DataFrame:
    """Scores (0 for undated freshness) plus 0.2 for each match after the first, 0.6 at most."""
    return scored.withColumn("score", F.col("score") + F.least(0.2 * F.greatest(F.col("match_count") - 1, F.lit(0)), F.lit(0.6)))


def relevant(news: DataFrame, hosts: list[str], suffixes: list[str], terms: list[str]) -> DataFrame:
    """Items on an official host or under one of its suffixes, or with a term as a whole phrase of the title."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[^:]+://([^/?#:]*)", 1)), r"^www\.", "")
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")), F.lit(" "))
    hit = host.isin(hosts)
    for s in suffixes:
        hit = hit | host.endswith(s)
    for t in terms:
        hit = hit | padded.contains(f" {t} ")
    return news.where(hit)


def top_week(scored: DataFrame, key: str, as_of: str, days: int, per_domain: int, n: int) -> DataFrame:
    """Valid items (title, http url) of the last days or undated, the first of each root domain by input, then the n best of each key."""
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("published").cast("timestamp"))) / 3600
    valid = scored.where((F.trim("title") != "") & F.col("url").startswith("http") & (F.col("published").isNull() | (hours <= 24 * days)))
    first = Window.partitionBy(key, tx.root_domain(F.col("url"))).orderBy("input_pos")
    capped = valid.withColumn("_d", F.row_number().over(first)).where(F.col("_d") <= per_domain).drop("_d")
    by = Window.partitionBy(key).orderBy(F.desc("score"), "input_pos")
    return capped.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= n)


def fetch_diagnostics(fetches: DataFrame, key: str) -> DataFrame:
    """Attempts, outcomes (ok, empty, failed) and items of each source."""
    return fetches.groupBy(key).agg(F.count("*").alias("attempted"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "empty", "failed")], F.sum("items").alias("items"))


def digest(news: DataFrame, key: str, least: int = 4, size: int = 200) -> DataFrame:
    """(key, n, ready, fallback, status, set_key, lines): the summary, else the beginning of the description, else the title.

    Fewer summaries than ``least`` fail; any fallback is told; items without text are left out.
    The set's key is a digest of its positions.
    """
    line = F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.substring("description", 1, size), F.lit("")), F.nullif("title", F.lit("")))
    rows = news.withColumn("line", line).where("line IS NOT NULL").withColumn("ok", F.coalesce(F.col("summary") != "", F.lit(False)))
    ordered = F.array_sort(F.collect_list(F.struct("input_pos", "line")))
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if("ok").alias("ready"), ordered.alias("o"))
    fallback = F.col("n") - F.col("ready")
    status = F.when(F.col("ready") < least, "failed").when(fallback > 0, "fallback_used").otherwise("ready")
    return g.select(key, "n", "ready", fallback.alias("fallback"), status.alias("status"), F.sha2(F.array_join(F.transform("o", lambda x: x["input_pos"].cast("string")), ","), 256).alias("set_key"), F.transform("o", lambda x: x["line"]).alias("lines"))


def filter_feed(news: DataFrame, companies: list[str], preset: list[str], terms: str, n: int) -> DataFrame:
    """The newest n items a company with any preset keyword and any comma-separated term in title or description."""
    text = F.lower(F.concat_ws(" ", "title", "description"))

    def any_of(words: list[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        return hit

    rows = news.where(F.col("company").isin(companies) & any_of(preset) & any_of([w.strip().lower() for w in terms.split(",") if w.strip()]))
    by = Window.partitionBy("company").orderBy(F.desc_nulls_last("published"), "input_pos")
    return rows.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= n)


def repair(news: DataFrame, as_of: str, days: int) -> DataFrame:
    """Stored items re-keyed: canonical url, one item a url with the intents of all, age filter; ``changed`` tells whether url or intents differ."""
    keyed = news.where("trim(title) <> ''").withColumn("was", F.col("url")).withColumn("url", tx.canonical_url(F.col("url")))
    kept = filter_age(dedup_exact(keyed), as_of, days)
    return kept.withColumn("changed", (F.col("was") != F.col("url")) | (F.array_join("intents", ",") != F.col("intent")))
