"""Aggregates over chunks: sentiment, shifts, mixes and coverage by company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a filing type in company sentiment; others weigh 1.
FILING_WEIGHTS = {"Earnings Transcript": 2.0, "Earnings Call": 2.0, "10-K": 1.5, "Annual Report": 1.5, "Press Release": 1.2, "8-K": 1.1, "10-Q": 1.0}


def weight_of(filing_type: Column) -> Column:
    out = F.lit(1.0)
    for kind, w in FILING_WEIGHTS.items():
        out = F.when(filing_type == kind, w).otherwise(out)
    return out


def company_sentiment(scored: DataFrame) -> DataFrame:
    """Weighted mean of ``score`` by company, and how many chunks."""
    w = weight_of(F.col("filing_type"))
    return scored.groupBy("company").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("sentiment"), F.count("*").alias("n"))


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``place``: 1 is the greatest; nulls last, ties by key. Rows are one a company."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(value), key)).cast("long"))


def sentiment_change(scored: DataFrame, n: int = 100, least: int = 20) -> DataFrame:
    """Weighted mean of the first half of a company's first n chunks against the second half."""
    by = Window.partitionBy("company").orderBy("chunk_id")
    rows = scored.withColumn("i", F.row_number().over(by)).where(F.col("i") <= n).withColumn("total", F.count("*").over(Window.partitionBy("company"))).where(F.col("total") >= least)
    w, early = weight_of(F.col("filing_type")), F.col("i") <= F.floor(F.col("total") / 2)
    half = lambda c: F.sum(F.when(c, F.col("score") * w)) / F.sum(F.when(c, w))
    out = rows.groupBy("company").agg(half(early).alias("recent"), half(~early).alias("older"))
    change = F.col("recent") - F.col("older")
    return out.withColumn("change", change).withColumn("trend", F.when(change > 0.05, "improving").when(change < -0.05, "declining").otherwise("stable"))


def yearly_shift(per_year: DataFrame, value: str, cut: float, relative: bool) -> DataFrame:
    """Changes between consecutive years of a company that exceed ``cut``; relative ones from 0 count as +100 %."""
    by = Window.partitionBy("company").orderBy("fiscal_year")
    rows = per_year.withColumn("before", F.lag(value).over(by)).withColumn("from_year", F.lag("fiscal_year").over(by)).where("before IS NOT NULL")
    plain = F.col(value) - F.col("before")
    change = F.when(F.col("before") != 0, plain / F.col("before")).when(F.col(value) > 0, 1.0).otherwise(0.0) if relative else plain
    return rows.withColumn("change", change).where(F.abs("change") > cut).select("company", "from_year", F.col("fiscal_year").alias("to_year"), "before", F.col(value).alias("after"), "change")


def class_mix(classed: DataFrame) -> DataFrame:
    """Counts by label and the weighted share by company."""
    w = weight_of(F.col("filing_type"))
    out = classed.groupBy("company").agg(*[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("a", "b", "mixed")], (F.sum(F.col("share") * w) / F.sum(w)).alias("share"))
    return out.withColumn("focus", F.when(F.col("share") >= 60, "a").when(F.col("share") <= 40, "b").otherwise("balanced"))


#: Bins of a histogram of ``upper_median``.
BINS = 4096


def _binned(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """``rows`` (with ``_t``, the place wanted) cut to the bin of their key that holds the place, which becomes one within the bin."""
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    named = {k: f"_{k}" for k in keys}
    v = F.col(value).cast("double")
    finite = F.when(F.abs(v) != float("inf"), v)
    ends = rows.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi")).withColumnsRenamed(named)
    share = F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    place = F.when(v == float("inf"), bins).when(v == float("-inf"), -1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")
    cut = rows.join(ends, same).withColumn("_bin", place).drop("_lo", "_hi", *named.values())
    counts = cut.groupBy(*keys, "_t", "_bin").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))  # ``bins`` + 2 rows a key at most
    home = counts.withColumn("_upto", upto).where("_t < _upto AND _t >= _upto - _n").select(*keys, F.col("_bin").alias("_home"), (F.col("_t") - F.col("_upto") + F.col("_n")).alias("_next"))
    home = home.withColumnsRenamed(named)
    return cut.drop("_t").join(home, [*same, F.col("_bin") == F.col("_home")]).withColumnRenamed("_next", "_t").drop("_bin", "_home", *named.values())


def upper_median(rows: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """The element at n // 2 (from 0) of the sorted values: the upper median of an even number; nulls and NaN are no values.

    Two passes of histograms find the bin that holds the place, so that only what is in it is
    sorted, equal values as one: a key with all rows is counted by many tasks.
    """
    known = rows.select(*keys, value).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = known.groupBy(*keys).agg(F.floor(F.count("*") / 2).alias("_t")).withColumnsRenamed({k: f"_{k}" for k in keys})
    asked = known.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    near = _binned(_binned(asked, keys, value, bins), keys, value, bins)
    counts = near.groupBy(*keys, "_t", value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    return counts.withColumn("_upto", upto).where("_t < _upto AND _t >= _upto - _n").select(*keys, F.col(value).alias("median"))


def top_by_key(rows: DataFrame, key: str, value: str, tie: str, n: int) -> DataFrame:
    """The n greatest of each key."""
    by = Window.partitionBy(key).orderBy(F.desc(value), tie)
    return rows.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= n)


def coverage_grid(chunks: DataFrame, categories: dict[str, str], text: str = "content") -> DataFrame:
    """Chunks that fit each category's pattern, for every company and category, 0 included: one pass over the text."""
    hits = chunks.groupBy("company").agg(*[F.count_if(F.col(text).rlike(p)).alias(c) for c, p in categories.items()])
    return hits.unpivot(["company"], list(categories), "category", "n")


def fingerprint(chunks: DataFrame) -> DataFrame:
    """Count and order-free checksum by company, to tell whether anything changed."""
    return chunks.groupBy("company").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_id", "content")).alias("mark"))


def mention_families(chunks: DataFrame, families: dict[str, str], text: str = "content", samples: int = 3) -> DataFrame:
    """(company, category, n, share, quotes, main): hits of each family's pattern, the first chunks that have one, and the family with most (ties by name)."""
    counts = chunks.groupBy("company").agg(*[F.coalesce(F.sum(F.regexp_count(text, F.lit(p))), F.lit(0)).alias(c) for c, p in families.items()]).unpivot(["company"], list(families), "category", "n")
    whole = Window.partitionBy("company")
    counts = counts.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(whole), F.lit(1))).withColumn("main", F.min(F.struct((-F.col("n")).alias("n"), "category")).over(whole)["category"])
    hit = F.explode(F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(c)) for c, p in families.items()])))
    by = Window.partitionBy("company", "category").orderBy("chunk_id")
    first = chunks.select("company", "chunk_id", hit.alias("category")).withColumn("i", F.row_number().over(by)).where(F.col("i") <= samples)
    quotes = first.groupBy("company", "category").agg(F.array_sort(F.collect_list("chunk_id")).cast("array<string>").alias("quotes"))
    return counts.join(quotes, ["company", "category"], "left").withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))


def value_counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(company, ``name``): ``value:n`` of every value, in its order, joined by commas."""
    counts = rows.groupBy("company", F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: F.concat_ws(":", x["v"], x["n"].cast("string")))
    return counts.groupBy("company").agg(F.array_join(pairs, ",").alias(name))


def class_samples(classed: DataFrame, most: int = 3) -> DataFrame:
    """(company, label, n, share, samples): chunks of each class, their share of the company's, and the first ids."""
    by = Window.partitionBy("company", "label").orderBy("chunk_id")
    rows = classed.withColumn("i", F.row_number().over(by))
    first = F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "chunk_id"))))
    counts = rows.groupBy("company", "label").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda x: x["chunk_id"].cast("string")), " ").alias("samples"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("company")))


def topic_contexts(chunks: DataFrame, topics: dict[str, str], most: int) -> DataFrame:
    """(company, topic, n, contexts): chunks that hold each topic's word, with the text around it in the first ones; one pass over the texts."""
    from ledgerline.functions.text import snippet

    hits = F.array_compact(F.array(*[F.when(F.lower("content").contains(w), F.struct(F.lit(k).alias("topic"), snippet(F.col("content"), w).alias("c"))) for k, w in topics.items()]))
    each = chunks.select("company", "chunk_id", F.explode(hits).alias("h")).select("company", "chunk_id", "h.*")
    rows = each.withColumn("i", F.row_number().over(Window.partitionBy("company", "topic").orderBy("chunk_id")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "c")))), lambda x: x["c"])
    return rows.groupBy("company", "topic").agg(F.count("*").alias("n"), first.alias("contexts"))


def grid_excerpts(chunks: DataFrame, categories: dict[str, str], most: int, size: int) -> DataFrame:
    """(company, category, n, excerpts) for every company and category, 0 and null without a hit."""
    hits = F.explode(F.array_compact(F.array(*[F.when(F.lower("content").contains(w), F.lit(k)) for k, w in categories.items()])))
    each = chunks.select("company", "chunk_id", F.substring("content", 1, size).alias("e"), hits.alias("category"))
    rows = each.withColumn("i", F.row_number().over(Window.partitionBy("company", "category").orderBy("chunk_id")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "e")))), lambda x: x["e"])
    found = rows.groupBy("company", "category").agg(F.count("*").alias("n"), first.alias("excerpts"))
    grid = chunks.select("company").distinct().select("company", F.explode(F.array(*[F.lit(k) for k in categories])).alias("category"))
    return grid.join(found, ["company", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_themes(chunks: DataFrame, themes: dict[str, str], most: int) -> DataFrame:
    """(company, theme, n, place): the themes whose word occurs most, ties by name."""
    from ledgerline.functions.text import keyword_count

    counts = chunks.groupBy("company").agg(*[F.sum(keyword_count(F.col("content"), [w])).alias(k) for k, w in themes.items()]).unpivot(["company"], list(themes), "theme", "n")
    return top_by_key(counts.where("n > 0"), "company", "n", "theme", most)
