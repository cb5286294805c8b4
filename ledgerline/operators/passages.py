"""Passages of filings: numbers beside labels, statement windows, places, sections with levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import filings as fg
from ledgerline.operators.patterns import occurrences


def capex_candidates(docs: DataFrame, key: str, text: str, label: str, about: int = 2, least: float = 10, most: float = 1e6) -> DataFrame:
    """(key, line, context, value): numbers of five digits and more, within ``about`` lines of a line that fits ``label``."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s")).withColumn("s", F.trim("s"))
    near = F.array(*[F.lag("s", -i).over(Window.partitionBy(key).orderBy("line")) for i in range(-about, about + 1)])
    context = F.array_join(F.filter(near, lambda s: F.coalesce(s, F.lit("")) != ""), " | ")
    hits = lines.withColumn("context", context).where(F.col("s").rlike(f"(?i){label}"))
    numbers = F.regexp_extract_all("context", F.lit(r"[\(\$]?\s*([0-9]{2,},?[0-9]{3}(?:\.[0-9]+)?)\s*\)?"), 1)
    each = hits.select(key, "line", F.substring("context", 1, 250).alias("context"), F.explode(numbers).alias("n")).withColumn("value", F.replace("n", F.lit(","), F.lit("")).cast("double"))
    return each.where((F.col("value") > least) & (F.col("value") < most)).select(key, F.col("line").cast("long").alias("line"), "context", "value")


def best_window(docs: DataFrame, key: str, text: str, labels: list[str], words: list[str], window: int = 5000) -> DataFrame:
    """(key, at, score, passage): the label's place with most context, and ``window`` characters to both sides.

    A place scores 2 for each of ``words`` within 1000 characters and 3 for a digit within 200
    after it; ties go to the earlier label, then the earlier place. Texts without a label give no row.
    """
    low = docs.select(key, F.coalesce(text, F.lit("")).alias("t"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    hits = F.concat(*[F.transform(fg.places(F.col("low"), F.lit(rf"\Q{label.lower()}\E"), F.lit(len(label))), lambda p, i=i: F.struct(F.lit(i).alias("label"), p.alias("at"))) for i, label in enumerate(labels)])
    each = low.select(key, "t", "low", F.explode(hits).alias("h")).select(key, "t", "low", "h.*")
    around = F.substring("low", F.greatest(F.col("at") - 1000, F.lit(1)), F.least(F.col("at") - 1, F.lit(1000)) + 1000)
    context = sum((around.contains(w).cast("int") for w in words), F.lit(0))
    score = context * 2 + F.when(F.substring("low", F.col("at"), F.lit(200)).rlike(r"\d"), 3).otherwise(0)
    best = each.withColumn("score", score).groupBy(key).agg(F.max(F.struct("score", (-F.col("label")).alias("l"), (-F.col("at")).alias("a"), "t")).alias("b"))
    at = -F.col("b.a")
    return best.select(key, at.cast("long").alias("at"), F.col("b.score").alias("score"), F.substring("b.t", F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)) + window).alias("passage"))


def location_mentions(docs: DataFrame, key: str, text: str, gazetteer: DataFrame, about: int = 100) -> DataFrame:
    """(key, city, at, kind, context, confidence): every mention of a place (city, lower-cased) as a whole word; ``key`` tells rows apart."""
    low = docs.select(key, F.col(text).alias("t"), F.lower(text).alias("low"))
    each = occurrences(low, [key], "low", gazetteer.select("city")).withColumnRenamed("pattern", "city")
    context = F.substring("t", F.greatest(F.col("at") - about, F.lit(1)), F.least(F.col("at") - 1, F.lit(about)) + F.length("city") + about)
    each = each.withColumn("context", context)
    sure = F.lower("context").contains("facility") | F.lower("context").contains("plant")
    return each.select(key, "city", F.col("at").cast("long").alias("at"), fg.site_kind(F.col("context")).alias("kind"), "context", F.when(sure, 0.8).otherwise(0.5).alias("confidence"))


def facility_lines(docs: DataFrame, key: str, text: str, gazetteer: DataFrame, skip: list[str]) -> DataFrame:
    """(key, city, kind): lines that are a place name (to the first comma, bracket or dash), once each, the kind from two lines before to three after."""
    lines = docs.select(key, F.posexplode(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")).alias("i", "s"))
    around = F.lower(F.array_join(F.collect_list("s").over(Window.partitionBy(key).orderBy("i").rowsBetween(-2, 3)), " "))
    skipped = F.lit(False)
    for w in skip:
        skipped = skipped | F.lower("s").contains(w.lower())
    short = lines.withColumn("around", around).where(~skipped & F.length("s").between(3, 80) & ~F.col("s").rlike(r"^[\d ]+$"))
    named = short.withColumn("city", F.trim(F.regexp_extract(F.lower("s"), r"^([^,(–—-]*)", 1)))
    kind = F.when(F.col("around").rlike("headquarter|corporate office"), "Headquarters").when(F.col("around").rlike("design|r&d|innovation"), "Design Center").when(F.col("around").rlike("warehouse|logistics|distribution"), "Logistics/Repair").otherwise("Manufacturing")
    found = named.join(gazetteer.select("city").distinct(), "city")
    return found.groupBy(key, "city").agg(F.min_by(kind, "i").alias("kind"))


def section_headers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_idx, section_header, section_level, content): lines that fit a section's pattern open it and stay in it.

    What stands before the first header is ``Document Start`` of level 0 (left out if blank); a
    text without headers is one ``Full Document``.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    upper = F.upper(F.trim("line"))
    name, level = fg.first_match(upper, fg.SECTIONS, F.lit(None).cast("string")), fg.first_match(upper, [(p, lv) for p, _, lv in fg.SECTIONS], F.lit(None).cast("int"))
    heads = lines.withColumn("name", name).withColumn("level", level)
    by = Window.partitionBy(key).orderBy("i")
    cut = heads.withColumn("section", F.count("name").over(by))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    parts = cut.groupBy(key, "section").agg(F.first("name", ignorenulls=True).alias("name"), F.first("level", ignorenulls=True).alias("level"), body.alias("content"))
    total = F.max("section").over(Window.partitionBy(key))
    parts = parts.withColumn("last", total).where("section > 0 OR last = 0 OR trim(content) <> ''")
    header = F.coalesce("name", F.when(F.col("last") == 0, "Full Document").otherwise("Document Start"))
    return parts.select(key, F.col("section").alias("section_idx"), header.alias("section_header"), F.coalesce("level", F.lit(0)).alias("section_level"), "content")


def section_parents(docs: DataFrame, key: str, text: str, size: int = 250, least: int = 80) -> DataFrame:
    """(key, section_idx, child_idx, section_header, content): each whole section (child_idx -1) and its windows of ``size`` words, of ``least`` words or more."""
    whole = section_headers(docs, key, text)
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    cut = whole.withColumn("ws", words).withColumn("child_idx", F.explode(F.sequence(F.lit(0), F.greatest((F.size("ws") - 1) / size, F.lit(0)).cast("int"))))
    children = cut.select(key, "section_idx", F.col("child_idx").cast("long").alias("child_idx"), "section_header", F.slice("ws", F.col("child_idx") * size + 1, F.lit(size)).alias("ws")).where(F.size("ws") >= least)
    return whole.select(key, "section_idx", F.lit(-1).cast("long").alias("child_idx"), "section_header", "content").unionByName(children.withColumn("content", F.array_join("ws", " ")).drop("ws"))
