"""Topics of news: features, clusters, their labels and strength; stage counts of the news pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.graph import connected_components
from ledgerline.operators import news as nw

# Words that carry no topic, and phrases with one spelling.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "remains", "remain", "continue", "continues", "continued", "strong", "rising",
    "growing", "amid", "with", "as", "its", "their", "this", "that", "from", "by", "more", "new", "report", "reports", "says", "said",
]
PHRASES = [
    (r"\bdata[\s\-]?centers?\b", "data-center"), (r"\bai[\s\-]infra(?:structure)?\b", "ai-infrastructure"), (r"\bartificial[\s\-]intelligence\b", "ai-infrastructure"), (r"\bpower[\s\-]supply\b", "power-supply"),
    (r"\bliquid[\s\-]cooling\b", "liquid-cooling"), (r"\bthermal[\s\-]management\b", "thermal-management"), (r"\bsupply[\s\-]chain\b", "supply-chain"),
]


def _words(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    for pattern, phrase in PHRASES:
        low = F.regexp_replace(low, pattern, phrase)
    return F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9\s\-]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(STOPWORDS))


def topic_tokens(text: Column, names: list[str] = []) -> Column:  # noqa: B006
    """Words of a topic in order: phrases in one spelling, no stopwords, no ``names``, three characters or more."""
    return F.filter(_words(text), lambda w: (F.length(w) > 2) & ~w.isin(["", *names]))


def phrase_hits(text: Column) -> Column:
    """Phrases that a text holds, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for p, name in PHRASES])))


def trend_key(label: Column, window: str = "30d") -> Column:
    """``30d:first-four-words``, or ``30d:unknown``."""
    slug = F.array_join(F.slice(_words(label), 1, 4), "-")
    return F.concat(F.lit(f"{window}:"), F.when(slug == "", "unknown").otherwise(slug))


def topic_features(news: DataFrame, names: list[str] = []) -> DataFrame:  # noqa: B006
    """``news`` with ``tokens`` (distinct) and ``phrases`` of title and description."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "description") if c in news.columns])
    return news.withColumn("tokens", F.array_distinct(topic_tokens(text, names))).withColumn("phrases", phrase_hits(text))


def topic_clusters(features: DataFrame, least_items: int = 2, merge_at: float = 0.4) -> DataFrame:
    """(input_pos, cluster): components of items that share a phrase, two tokens, or a quarter of their tokens.

    Items meet at hubs (a phrase, a token list) and lists at others (a pair of tokens, a token of
    short lists) whose first item stands for the rest, so a hub of n gives n edges. Tokens of one
    list alone make no pairs; others make one with each other of their list. Clusters with fewer urls than
    ``least_items`` go; clusters of one label, or with token sets alike by ``merge_at``, are one.
    """
    items = features.select("input_pos", "url", F.array_sort("tokens").alias("tokens"), "phrases")
    link = lambda src, dst: (F.col(src).alias("src"), F.col(dst).alias("dst"))
    tagged = items.select("input_pos", F.explode("phrases").alias("hub"))
    edges = tagged.join(tagged.groupBy("hub").agg(F.min("input_pos").alias("src")), "hub").where("src <> input_pos").select(*link("src", "input_pos"))
    # Items of one token list meet at its first, which alone stands for the list from here on.
    lists = items.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("input_pos").alias("head"))
    edges = edges.union(items.join(lists, "tokens").where("head <> input_pos").select(*link("head", "input_pos")))
    # A token of a single list is part of no pair that two lists share.
    words = lists.select("head", F.size("tokens").alias("n"), F.explode("tokens").alias("w"))
    shared = words.join(words.groupBy("w").agg(F.count("*").alias("in_lists")).where("in_lists > 1").select("w"), "w")
    shared = shared.groupBy("head").agg(F.array_sort(F.collect_list("w")).alias("tokens"))
    pairs = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.concat(x, F.lit(" "), y))))
    hubs = shared.select("head", F.explode(pairs).alias("hub"))
    edges = edges.union(hubs.join(hubs.groupBy("hub").agg(F.min("head").alias("src")), "hub").where("src <> head").select(*link("src", "head")))
    # One shared token is a quarter of the union where both lists have five tokens at most in all.
    short = words.where("n <= 4")
    least = short.groupBy("w").agg(F.min(F.struct("n", "head")).alias("m"))
    edges = edges.union(short.join(least, "w").where("head <> m.head AND n + m.n <= 5").select(F.col("m.head").alias("src"), F.col("head").alias("dst")))
    labels = connected_components(edges).withColumnRenamed("node", "input_pos")
    placed = items.join(labels, "input_pos", "left").withColumn("cluster", F.coalesce("component", "input_pos")).where(F.size("tokens") + F.size("phrases") > 0)
    large = placed.groupBy("cluster").agg(F.count_distinct("url").alias("n")).where(F.col("n") >= least_items)
    placed = placed.join(large, "cluster", "left_semi")
    facts = cluster_labels(placed.select("cluster", "tokens", "phrases"))
    slugs = facts.withColumn("slug", trend_key(F.col("label")))
    same = slugs.join(slugs.groupBy("slug").agg(F.min("cluster").alias("src")), "slug").where("src <> cluster").select("src", F.col("cluster").alias("dst"))
    sets = placed.select("cluster", F.explode("tokens").alias("w")).groupBy("cluster").agg(F.collect_set("w").alias("ws")).withColumnRenamed("cluster", "id")
    merged = connected_components(same.union(nw.similar_lists(sets, merge_at).select("src", "dst"))).withColumnRenamed("node", "cluster").withColumnRenamed("component", "whole")
    return placed.join(merged, "cluster", "left").select("input_pos", F.coalesce("whole", "cluster").alias("cluster"))


def _counted(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values of an array column by cluster, joined by spaces in order."""
    counts = rows.select("cluster", F.explode(column).alias("v")).groupBy("cluster", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("cluster").orderBy(F.desc("n"), "v")
    top = counts.withColumn("i", F.row_number().over(by)).where(F.col("i") <= most)
    return top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("top")).select("cluster", F.transform("top", lambda x: x["v"]).alias("top"))


def cluster_labels(rows: DataFrame) -> DataFrame:
    """(cluster, label, keywords): the two most frequent phrases, else the four most frequent tokens; four keywords, phrases first."""
    phrases, tokens = _counted(rows, "phrases", 3).withColumnRenamed("top", "p"), _counted(rows, "tokens", 5).withColumnRenamed("top", "t")
    both = rows.select("cluster").distinct().join(phrases, "cluster", "left").join(tokens, "cluster", "left")
    empty = F.array().cast("array<string>")
    p, t = F.coalesce("p", empty), F.coalesce("t", empty)
    label = F.when(F.size(p) > 0, F.array_join(F.slice(p, 1, 2), " ")).otherwise(F.array_join(F.slice(t, 1, 4), " "))
    return both.select("cluster", label.alias("label"), F.slice(F.array_union(p, t), 1, 4).alias("keywords"))


def cluster_summary(rows: DataFrame, as_of: str, most: int = 6) -> DataFrame:
    """The strongest clusters of (cluster, url, company, published, tokens, phrases): counts in windows, companies, label, keywords, representatives.

    Order: items of 7, 30 and 60 days, then companies, all falling; ties by cluster. Items without a date count in all windows.
    """
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("cluster", "url").orderBy(F.desc_nulls_last("published"), "input_pos"))).where("n = 1").drop("n")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("published").cast("date"))
    newest = F.transform(F.slice(F.sort_array(F.collect_list(F.struct(F.col("published").isNotNull().alias("d"), "published", (-F.col("input_pos")).alias("p"))), False), 1, 3), lambda x: -x["p"])
    facts = once.groupBy("cluster").agg(*[F.count_if(age.isNull() | (age <= d)).alias(f"d{d}") for d in (7, 30, 60)], F.count_distinct("company").alias("companies"), newest.alias("representatives"))
    by = Window.orderBy(F.desc("d7"), F.desc("d30"), F.desc("d60"), F.desc("companies"), "cluster")
    ranked = facts.orderBy(F.desc("d7"), F.desc("d30"), F.desc("d60"), F.desc("companies"), "cluster").limit(most)
    return ranked.withColumn("place", F.row_number().over(by).cast("long")).join(cluster_labels(rows), "cluster")


def stage_counts(raw: DataFrame, as_of: str, days: int) -> DataFrame:
    """(stage, n_in, n_out) of normalising, exact dedup, merging reprints and the age filter."""
    normal = nw.normalize(raw)
    exact = nw.dedup_exact(normal)
    merged = exact.join(nw.merge_reprints(exact).where("kept").select("input_pos"), "input_pos", "left_semi")
    young = nw.filter_age(merged, as_of, days)
    steps = [("raw", raw), ("normalize", normal), ("dedup_exact", exact), ("merge_reprints", merged), ("filter_age", young)]
    counts = None
    for i, (name, df) in enumerate(steps):
        part = df.agg(F.count("*").alias("n_out")).select(F.lit(i).alias("i"), F.lit(name).alias("stage"), "n_out")
        counts = part if counts is None else counts.unionByName(part)
    return counts.withColumn("n_in", F.lag("n_out").over(Window.orderBy("i"))).where("i > 0").select("stage", "n_in", "n_out")


def dedup_in_order(rows: DataFrame, group: str, threshold: float = 0.85) -> DataFrame:
    """(id, keeper) of rows (id, group, text) that are near duplicates of an earlier kept row of their group, with the first such.

    Alike are sets of lower-cased words with a Jaccard similarity at the threshold; ids give the
    order; texts without words are never duplicates. Equal sets are compared once.
    """
    from ledgerline.graph import kept_in_order

    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")))
    sets = rows.select("id", F.col(group).alias("g"), words.alias("ws")).where(F.size("ws") > 0)
    first = sets.groupBy("g", "ws").agg(F.min("id").alias("first"))
    near = nw.similar_lists(first.select(F.col("first").alias("id"), "g", "ws"), threshold, "g")
    lost = kept_in_order(near).withColumnRenamed("node", "first")
    placed = sets.join(first, ["g", "ws"]).select("id", "first").join(lost, "first", "left")
    return placed.select("id", F.coalesce("keeper", "first").alias("keeper")).where("id <> keeper")
