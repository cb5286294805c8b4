"""Keyed tables: upserts, refreshes, diffs, alerts, events, places and calendars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.patterns import occurrences


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Target and batch with one row a key: the latest, the batch's among equals."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc(at), F.desc("_new")]).drop("_new")


def refresh(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys that the batch holds are replaced whole; an empty batch changes nothing."""
    return target.join(batch.select(key).distinct(), key, "left_anti").select(batch.columns).unionByName(batch)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``change`` added or removed."""
    added = new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("added"))
    removed = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


#: Events of a slot that meet in one task; slots with more are salted.
SLOT_ROWS = 2000


def duplicate_links(events: DataFrame, days: int = 30, ratio: float = 0.7, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Duplicate events as (a, z, link): classes, and links between their representatives.

    ``same``: z is one of the class of a, the smallest id among events of one company (in any
    case), type, day and amount. ``near``: representatives a < z of one company and type within
    some days and a ratio of amounts; all events of the two classes are duplicates. As in the
    studied project a null or zero amount agrees with every amount and a null day with every
    day. Null ids, companies or types match nothing.
    """
    what = ["company", "type", "day", "amount"]
    rows = events.select("id", F.lower("company").alias("company"), "type", "day", F.col("amount").cast("double").alias("amount")).dropna(subset=["id", "company", "type"])
    first = rows.groupBy(*what).agg(F.min("id").alias("a"))
    agree = [rows[c].eqNullSafe(first[c]) for c in what]
    same = rows.join(first, agree).where("id <> a").select("a", F.col("id").alias("z"), F.lit("same").alias("link")).distinct()

    b = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / max(days, 1))
    g = F.floor(F.ln("amount") / (-math.log(ratio) * (1 + 1e-9) if ratio < 1 else 1.0))
    slotted = first.withColumn("full", F.coalesce((F.col("amount") > 0) & F.col("day").isNotNull(), F.lit(False)))
    full = slotted.where("full").withColumn("b", b).withColumn("g", g)
    # Days or amounts that agree differ by one bucket at most: z goes to its own slot and the eight around it.
    slot = ["company", "type", "b", "g"]
    hot = full.groupBy(*slot).agg(F.ceil(F.count("*") / slot_rows).alias("salts")).where("salts > 1")
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    left = full.join(hot, slot, "left").select(*slot, F.pmod(F.xxhash64("a"), salts).alias("salt"), "a", F.col("day").alias("a_day"), F.col("amount").alias("a_amount"))
    near = F.array(*[F.struct((F.col("b") + i).alias("b"), (F.col("g") + j).alias("g")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = full.select("company", "type", F.explode(near).alias("s"), F.col("a").alias("z"), F.col("day").alias("z_day"), F.col("amount").alias("z_amount")).select("company", "type", "s.b", "s.g", "z", "z_day", "z_amount")
    right = right.join(hot, slot, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    met = left.join(right, [*slot, "salt"]).select("a", "a_day", "a_amount", "z", "z_day", "z_amount")

    # What has no slot meets all of its company and type.
    open_ = slotted.where("not full").select("company", "type", F.col("a").alias("x"), F.col("day").alias("x_day"), F.col("amount").alias("x_amount"))
    every = slotted.select("company", "type", "full", F.col("a").alias("y"), F.col("day").alias("y_day"), F.col("amount").alias("y_amount"))
    loose = open_.join(every, ["company", "type"]).where("full OR x < y")
    turn = F.col("x") < F.col("y")
    loose = loose.select(*[F.when(turn, F.col(f"x{c}")).otherwise(F.col(f"y{c}")).alias(f"a{c}") for c in ("", "_day", "_amount")], *[F.when(turn, F.col(f"y{c}")).otherwise(F.col(f"x{c}")).alias(f"z{c}") for c in ("", "_day", "_amount")])

    dated = F.coalesce(F.abs(F.datediff("a_day", "z_day")) <= days, F.lit(True))
    valued = F.coalesce((F.col("a_amount") == 0) | (F.col("z_amount") == 0), F.lit(True)) | (F.least("a_amount", "z_amount") >= ratio * F.greatest("a_amount", "z_amount"))
    links = met.unionByName(loose).where((F.col("a") < F.col("z")) & dated & valued).select("a", "z", F.lit("near").alias("link")).distinct()
    return same.unionByName(links)


def amount_millions(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "billions", 1000.0).otherwise(1.0) / F.when(unit == "thousands", 1000.0).otherwise(1.0)


def event_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 16)


def totals_by(rows: DataFrame, key: str, bucket: str, values: list[str], amount: str) -> DataFrame:
    """Sum of an amount in each bucket, and the first bucket's share."""
    out = rows.groupBy(key).agg(*[F.sum(F.when(F.col(bucket) == v, F.col(amount)).otherwise(0.0)).alias(v) for v in values], F.sum(amount).alias("total"))
    return out.withColumn("share", F.when(F.col("total") != 0, F.col(values[0]) / F.col("total")))


def facility_profile(facilities: DataFrame) -> DataFrame:
    """Sites, headquarters, regions and the main region (ties: the first by name) of each company."""
    per = facilities.groupBy("company", "region").agg(F.count("*").alias("n"), F.count_if(F.col("facility_type") == "Headquarters").alias("hq"))
    return per.groupBy("company").agg(F.sum("n").alias("sites"), F.sum("hq").alias("headquarters"), F.count("*").alias("regions"), F.min(F.struct((-F.col("n")).alias("n"), "region"))["region"].alias("main_region"))


def city_overlap(facilities: DataFrame) -> DataFrame:
    """Cities with more than one company, and which."""
    return facilities.groupBy("city").agg(F.sort_array(F.collect_set("company")).alias("companies")).where(F.size("companies") > 1)


def regional_leaders(facilities: DataFrame) -> DataFrame:
    counts = facilities.groupBy("region", "company").agg(F.count("*").alias("n"))
    return latest(counts, ["region"], [F.desc("n"), "company"])


def new_alerts(candidates: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a live (not dismissed) alert of the same keys."""
    return candidates.join(alerts.where("NOT dismissed").select(*keys).distinct(), keys, "left_anti")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Live alerts by company: all, unread, by severity, and how many types."""
    live = alerts.where("NOT dismissed")
    return live.groupBy("company").agg(F.count("*").alias("n"), F.count_if(~F.col("is_read")).alias("unread"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count_distinct("type").alias("types"))


def conversation_tail(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(by).cast("long")).where(F.col("back") <= n)


def estimate_calendar(companies: DataFrame, year: int, lag_days: int) -> DataFrame:
    """Expected report day of each company's quarters that end in a year: some days after the end, moved off weekends."""
    ends = companies.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4))))
    month = F.pmod(F.col("fy_end_month") + F.col("q") * 3 - 1, F.lit(12)) + 1
    end = F.last_day(F.make_date(F.lit(year), month.cast("int"), F.lit(1)))
    raw = F.date_add(end, lag_days)
    day = F.date_add(raw, F.when(F.weekday(raw) == 5, 2).when(F.weekday(raw) == 6, 1).otherwise(0))
    return ends.select("company", F.col("q").cast("int").alias("q"), end.alias("period_end"), day.alias("report_day"))


def next_and_last(rows: DataFrame, key: str, day: str, as_of: str) -> DataFrame:
    """Nearest day after and latest day up to a date, for each key."""
    at = F.lit(as_of).cast("date")
    return rows.groupBy(key).agg(F.min(F.when(F.col(day) > at, F.col(day))).alias("next_d"), F.max(F.when(F.col(day) <= at, F.col(day))).alias("last_d"))


def parse_guidance(text: Column) -> Column:
    """Midpoint of ``a-b`` or ``a to b``, else the first number."""
    low, high = (F.regexp_extract(text, r"([\d.]+)\s*(?:-|–|to)\s*\$?([\d.]+)", i).try_cast("double") for i in (1, 2))
    return F.coalesce((low + high) / 2, F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double"))


def evaluate(actual: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Exact (within 0.1), within 5 %, missing and mean error of extracted values."""
    both = truth.join(actual, key, "left")
    error = F.abs(F.col("actual") - F.col("truth"))
    return both.agg(F.count("*").alias("n"), F.count_if(error < 0.1).alias("exact"), F.count_if(error <= 0.05 * F.abs("truth")).alias("close"), F.count_if(F.col("actual").isNull()).alias("missing"), F.round(F.avg(error / F.abs("truth")) * 100, 4).alias("error_pct"))


def normalize_jobs(jobs: DataFrame, title_size: int = 200) -> DataFrame:
    """Jobs with a label's prefix off the location, lengths capped, and a snippet ``location | department``."""
    location = F.trim(F.regexp_replace(F.regexp_replace("location", r"(?i)^locations\s*", ""), r"(?i)^location\s*", ""))
    rows = jobs.withColumn("title", F.substring(F.trim("title"), 1, title_size)).withColumn("location", F.substring(location, 1, 200)).withColumn("department", F.substring(F.trim("department"), 1, 100))
    return rows.withColumn("snippet", F.regexp_replace(F.concat_ws(" | ", "location", "department"), r"^[ |]+|[ |]+$", ""))


def classify_patents(rows: DataFrame) -> DataFrame:
    """Rows (title, snippet, url) that look like patents, with ``patent_number`` where one is named."""
    mark = "patent|uspto|patentscope|espacenet"
    number = F.regexp_extract(F.concat_ws(" ", "title", "snippet"), r"US\s*(\d{7,})", 1)
    return rows.where(F.lower("title").rlike(mark) | F.lower("url").rlike(mark)).withColumn("patent_number", F.when(number != "", F.concat(F.lit("US"), number)))


def engagement_items(items: DataFrame) -> DataFrame:
    """Items (content, lower-cased) with relevance (0.3 and 0.1 for words of two weights, 1 at most) and kind of contribution."""
    has = lambda words: sum((F.col("content").contains(w).cast("int") for w in words), F.lit(0))
    relevance = F.least(F.lit(1.0), 0.3 * has(["open compute", "ocp", "hyperscale", "data center hardware"]) + 0.1 * has(["server", "rack", "infrastructure", "manufacturing"]))
    kind = F.when(F.col("content").contains("spec"), "Specification").when(F.col("content").contains("design"), "Design Contribution").when(F.col("content").contains("project"), "Project").when(F.col("content").rlike("member|partner"), "Membership").otherwise("General")
    return items.withColumn("relevance", relevance).withColumn("contribution", kind)


#: Weight of a membership.
MEMBERSHIP = {"Platinum": 1.0, "Gold": 0.8, "Solution Provider": 0.6, "Contributor": 0.4, "Community": 0.2}


def engagement_score(items: DataFrame, categories: list[tuple[str, list[str]]]) -> DataFrame:
    """(company, score, level, categories, place): 30 x membership + 5 an item of news (30 at most) + 8 a contribution (40 at most)."""
    weight = F.lit(0.1)
    for name, w in MEMBERSHIP.items():
        weight = F.when(F.col("status") == name, w).otherwise(weight)
    hits = [F.when(F.bool_or(F.col("content").rlike("|".join(words))), F.lit(name)) for name, words in categories]
    g = items.groupBy("company").agg(F.max("status").alias("status"), F.count_if(F.col("kind") == "news").alias("news"), F.count_if(F.col("kind") == "contribution").alias("made"), F.array_compact(F.array(*hits)).alias("categories"))
    score = F.least(F.lit(100.0), weight * 30 + F.least(F.col("news") * 5, F.lit(30)) + F.least(F.col("made") * 8, F.lit(40)))
    rows = g.withColumn("score", score)
    level = F.when(F.col("score") >= 60, "High").when(F.col("score") >= 30, "Medium").otherwise("Low")
    return rows.select("company", "score", level.alias("level"), "categories", F.rank().over(Window.orderBy(F.desc(F.round("score", 4)))).cast("long").alias("place"))  # one row a company


def ratings_feed(actions: DataFrame, analyst: str | None = None) -> DataFrame:
    """Actions of an analyst (or all) with the colour of their verbs."""
    low = F.lower("action")
    rows = actions.where(low.contains(analyst.lower())) if analyst else actions
    return rows.withColumn("colour", F.when(low.rlike("raised|upgraded|initiates|buy|outperform|overweight"), "green").when(low.rlike("cut|lowered|downgraded|underweight|sell|underperform"), "red").otherwise("grey"))


def coverage_matrix(roster: DataFrame, tickers: DataFrame, key: str) -> DataFrame:
    """Every analyst of ``roster`` (analyst, key) by every row of ``tickers`` (key, consensus, ...): covered or not, consensus only where covered."""
    grid = roster.select("analyst").distinct().join(F.broadcast(tickers))  # tickers are a list of companies
    return grid.join(roster.distinct().withColumn("covered", F.lit(True)), ["analyst", key], "left").withColumn("covered", F.coalesce("covered", F.lit(False))).withColumn("consensus", F.when(F.col("covered"), F.col("consensus")))


def merge_signals(rows: DataFrame, url: str, order: list[str], most: int) -> DataFrame:
    """The first row of each url in an order, then the first ``most`` of these."""
    first = latest(rows, [url], [F.col(c) for c in order]).orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # ``most`` rows


def generate_calendar(companies: DataFrame, years: DataFrame) -> DataFrame:
    """(company, fiscal_year, quarter, estimated): the third Monday of April, July, October, and of January of the next year."""
    grid = companies.distinct().join(F.broadcast(years.distinct())).withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))  # some years
    month = F.element_at(F.array(*[F.lit(m) for m in (4, 7, 10, 1)]), F.col("quarter"))
    first = F.make_date(F.col("fiscal_year") + F.when(F.col("quarter") == 4, 1).otherwise(0), month, F.lit(1))
    return grid.select("company", "fiscal_year", "quarter", F.date_add(F.next_day(F.date_sub(first, 1), "Mon"), 14).alias("estimated"))


def upcoming_by_month(rows: DataFrame, month: int, year: int, ahead: int = 3) -> DataFrame:
    """Rows (company, expected_month) within the next months, the year they fall in, and 30 days a month until then."""
    diff = F.pmod(F.col("expected_month") - month, F.lit(12))
    return rows.where(diff <= ahead).select("company", "expected_month", F.when(F.col("expected_month") >= month, year).otherwise(year + 1).alias("expected_year"), (diff * 30).alias("days_until"))


def apply_event_updates(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Events (id, day, confirmed) with updates of the same columns: a new id is added, a non-null day moves, any confirmation stays."""
    changes = updates.groupBy("id").agg(F.max("day").alias("new_day"), F.bool_or("confirmed").alias("sure"))
    both = events.join(changes, "id", "full")
    return both.select("id", F.coalesce("new_day", "day").alias("day"), (F.coalesce("confirmed", F.lit(False)) | F.coalesce("sure", F.lit(False))).alias("confirmed"))


def report_days(rows: DataFrame, lag_days: int, holidays: list[str], tries: int = 10) -> DataFrame:
    """Expected report day of each quarter of rows (company, year, fy_end_month): some days after its end, then the first working day that is no holiday (``MM-dd``)."""
    ends = rows.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4))))
    month = F.pmod(F.col("fy_end_month") + F.col("q") * 3 - 1, F.lit(12)) + 1
    end = F.last_day(F.make_date(F.col("year"), month.cast("int"), F.lit(1)))
    days = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.date_add(end, lag_days + i))
    free = F.filter(days, lambda d: (F.weekday(d) < 5) & ~F.date_format(d, "MM-dd").isin(holidays))
    return ends.select("company", "year", F.col("q").cast("int").alias("q"), end.alias("period_end"), F.get(free, 0).alias("report_day"))


def collection_totals(chunks: DataFrame) -> DataFrame:
    """Chunks of each company, of filings and of earnings material, and how many types and years."""
    kind = F.col("filing_type")
    return chunks.groupBy("company").agg(F.count("*").alias("n"), F.count_if(kind.isin("10-K", "10-Q", "8-K")).alias("sec"), F.count_if(kind.isin("Earnings Transcript", "Press Release")).alias("earnings"), F.count_distinct("filing_type").alias("types"), F.count_distinct("fiscal_year").alias("years"))


def pending_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed, downloaded and pending files (company, form, id) of each company, and the pending forms."""
    rows = listing.join(ledger.select("id").distinct().withColumn("done", F.lit(True)), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    forms = F.array_join(F.sort_array(F.collect_set(F.when(~F.col("done"), F.col("form")))), ",")
    return rows.groupBy("company").agg(F.count("*").alias("listed"), F.count_if("done").alias("downloaded"), F.count_if(~F.col("done")).alias("pending"), forms.alias("pending_forms"))


def refresh_status(rows: DataFrame, key: str, failed: Column) -> DataFrame:
    """ok, error or partial, by the rows of each key that failed."""
    bad = F.count_if(failed)
    return rows.groupBy(key).agg(F.when(bad == 0, "ok").when(bad == F.count("*"), "error").otherwise("partial").alias("status"), F.count("*").alias("n"))


def suggest(queries: DataFrame, registry: DataFrame, most: int) -> DataFrame:
    """(w, id, precedence): companies whose ticker (1), name (2) or alias (3) holds the typed letters, the best first; nothing typed finds nothing."""
    fields = F.concat(F.array(F.struct(F.lit(1).alias("precedence"), F.lower("ticker").alias("s")), F.struct(F.lit(2).alias("precedence"), F.lower("name").alias("s"))), F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(F.lit(3).alias("precedence"), F.lower(a).alias("s"))))
    each = registry.select("id", F.explode(fields).alias("f")).select("id", "f.*").distinct()
    found = occurrences(each, ["id", "precedence", "s"], "s", queries.select("w"), whole=False)
    best = found.groupBy(F.col("pattern").alias("w"), "id").agg(F.min("precedence").alias("precedence"))
    by = Window.partitionBy("w").orderBy("precedence", "id")
    return best.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).select("w", "id", "precedence")


def extract_events(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, label, amount, unit, bucket_l1, bucket_l2, evidence): the first labelled amount of a passage, what it is for, and whether it lies ahead."""
    pattern = r"(?i)(capital expenditures?|acquisition|equipment)\D{0,20}\$([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    low = F.lower(text)
    bucket = F.when(F.lower(part(1)).contains("capital"), "capex").when(F.lower(part(1)).contains("acqui"), "m_and_a").otherwise("equipment")
    ahead = F.when(low.rlike("expect|guidance|plan to|will "), "guidance").otherwise("actual")
    amount = F.replace(part(2), F.lit(","), F.lit("")).try_cast("double")
    return docs.where(F.col(text).rlike(pattern)).select(*keys, part(1).alias("label"), amount.alias("amount"), F.concat(F.lower(part(3)), F.lit("s")).alias("unit"), bucket.alias("bucket_l1"), ahead.alias("bucket_l2"), F.substring(text, 1, 500).alias("evidence"))


def _region(geo: str = "geo") -> Column:
    return F.split_part(geo, F.lit("/"), F.lit(1))


def event_aggregates(events: DataFrame, buckets: list[str]) -> DataFrame:
    """Totals by bucket, the first bucket's share, regions and a histogram of types of each company."""
    counts = events.groupBy("company", "type").agg(F.count("*").alias("n"))
    types = counts.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws(":", x["type"], x["n"].cast("string"))), ",").alias("types"))
    sums = events.groupBy("company").agg(*[F.sum(F.when(F.col("bucket") == b, F.col("amount")).otherwise(0)).alias(b) for b in buckets], F.sum("amount").alias("total"), F.sort_array(F.collect_set(_region())).alias("regions"))
    return sums.withColumn("share", F.when(F.col("total") != 0, F.col(buckets[0]).cast("double") / F.col("total").cast("double"))).join(types, "company")


def comparison_rows(events: DataFrame) -> DataFrame:
    """(company, types, regions, place): the two most frequent types and three regions of each company, by falling total."""
    counts = events.groupBy("company", "type").agg(F.count("*").alias("n"))
    by = Window.partitionBy("company").orderBy(F.desc("n"), "type")
    top = counts.withColumn("i", F.row_number().over(by)).where("i <= 2").groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "type"))), lambda x: x["type"]), ",").alias("types"))
    sums = events.groupBy("company").agg(F.sum("amount").alias("s"), F.array_join(F.slice(F.sort_array(F.collect_set(_region())), 1, 3), ",").alias("regions"))
    rows = sums.join(top, "company").withColumn("place", F.row_number().over(Window.orderBy(F.desc("s"), "company")).cast("long"))  # one row a company
    return rows.select("company", "types", "regions", "place")


def shared_locations(facilities: DataFrame) -> DataFrame:
    """Every site with ``shared`` and the other companies of its city."""
    there = facilities.groupBy("city").agg(F.sort_array(F.collect_set("company")).alias("all"))
    rows = facilities.join(there, "city")
    return rows.withColumn("shared", F.size("all") > 1).withColumn("others", F.array_except("all", F.array("company"))).drop("all")


def combine_facilities(known: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(company, city, source, confidence): known sites, and found ones of ``least`` confidence that are not known; names in lower case, once each."""
    names = [F.lower("company").alias("company"), F.lower("city").alias("city")]
    sure = known.select(*names).distinct()
    new = found.select(*names, "confidence").groupBy("company", "city").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= least).join(sure, ["company", "city"], "left_anti")
    return sure.select("company", "city", F.lit("known").alias("source"), F.lit(1.0).alias("confidence")).unionByName(new.select("company", "city", F.lit("discovered").alias("source"), "confidence"))


def aggregate_mentions(mentions: DataFrame) -> DataFrame:
    """(city, n, kind, confidence): mentions, their most frequent kind (ties by name), and max confidence + 0.1 a mention, 1 at most."""
    per = mentions.groupBy("city", "kind").agg(F.count("*").alias("k"), F.max("confidence").alias("c"))
    kind = F.min(F.struct((-F.col("k")).alias("k"), "kind"))["kind"]
    return per.groupBy("city").agg(F.sum("k").alias("n"), kind.alias("kind"), F.least(F.max("c") + 0.1 * F.sum("k"), F.lit(1.0)).alias("confidence"))


def hiring_profile(jobs: DataFrame, ai: list[str], tech: list[str], regions: list[str]) -> DataFrame:
    """Jobs (company, category, region, seniority) of each company: counts, shares in percent, the three largest categories, and a flag over 30 % AI."""
    by = Window.partitionBy("company").orderBy(F.desc("n"), "category")
    counts = jobs.groupBy("company", "category").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(by)).where("i <= 3")
    top = counts.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "category", "n"))), lambda x: F.concat_ws(":", x["category"], x["n"].cast("string"))), ",").alias("top"))
    share = lambda values: 100.0 * F.count_if(F.col("category").isin(values)) / F.count("*")
    g = jobs.groupBy("company").agg(F.count("*").alias("n"), *[F.count_if(F.col("region") == r).alias(r) for r in regions], F.count_if(F.col("seniority") == "senior").alias("senior"), share(ai).alias("ai_share"), share(tech).alias("tech_share"))
    return g.join(top, "company").withColumn("ai_focused", F.col("ai_share") > 30)


def with_samples(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, samples): rows (keys, id) of each key and their first ids."""
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "id")))), lambda x: x["id"].cast("string"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(first, " ").alias("samples"))


def diff_by_title(old: DataFrame, new: DataFrame) -> DataFrame:
    """(company, added, removed, replaced): titles that came and went between snapshots (company, title); a company of the new one is replaced only if any did."""
    change = snapshot_diff(old, new, ["company", "title"])
    g = change.groupBy("company").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed")])
    n = lambda c: F.coalesce(c, F.lit(0))
    return new.select("company").distinct().join(g, "company", "left").select("company", n("added").alias("added"), n("removed").alias("removed"), (n("added") + n("removed") > 0).alias("replaced"))


def composite(scores: DataFrame) -> DataFrame:
    """Rows (company, innovation, hiring, news) with .4 innovation + .3 hiring + .3 (50 with news, 25 without), rank, and the stronger part."""
    score = F.round(0.4 * F.col("innovation") + 0.3 * F.col("hiring") + 0.3 * F.when(F.col("news"), 50).otherwise(25), 4)
    rows = scores.withColumn("score", score)
    return rows.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))).cast("long")).withColumn("strength", F.when(F.col("innovation") >= F.col("hiring"), "innovation").otherwise("hiring"))  # one row a company


def session_context(turns: DataFrame, keep: int, last: int, as_of: str, hours: int) -> DataFrame:
    """(conv_id, messages, context, expired): messages that are kept, the last ones as text, and whether the session is older than ``hours``."""
    tail = conversation_tail(turns, keep)
    line = F.when(F.col("back") <= last, F.struct("turn", F.concat_ws(": ", "role", F.coalesce("text", F.lit(""))).alias("s")))
    text = F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(line))), lambda x: x["s"]), "\n")
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return tail.groupBy("conv_id").agg(F.count("*").alias("messages"), text.alias("context"), (F.max("at") < since).alias("expired"))


def peer_benchmark(rows: DataFrame) -> DataFrame:
    """(company, consensus, score, place, leader) by the rank of the consensus; the leader is the first by name among the best."""
    score = F.lit(2)
    for name, s in (("Hold", 3), ("Buy", 4), ("Strong Buy", 5)):
        score = F.when(F.col("consensus") == name, s).otherwise(score)
    ranked = rows.select("company", "consensus", score.alias("score"))
    place = F.rank().over(Window.orderBy(F.desc("score"))).cast("long")
    return ranked.withColumn("place", place).withColumn("leader", F.row_number().over(Window.orderBy(F.desc("score"), "company")) == 1)  # one row a company


def key_quotes(quotes: DataFrame, company: object, themes: list[str], as_of: str, days: int, n: int) -> DataFrame:
    """The newest n quotes (company, theme, ts) of a company and themes in the last days."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return quotes.where((F.col("company") == company) & F.col("theme").isin(themes) & (F.col("ts") >= since)).orderBy(F.desc("ts"), "event_id").limit(n)


def apply_confirmed(guesses: DataFrame, confirmed: DataFrame, as_of: str) -> DataFrame:
    """(id, day, call_day, confidence): confirmed days replace guesses, some companies call a day later, guesses are surer within 14 and 56 days."""
    day, away = F.coalesce("sure", "guess"), F.abs(F.datediff("guess", F.lit(as_of).cast("date")))
    sure = F.when(F.col("sure").isNotNull(), "confirmed").when(away <= 14, "high").when(away <= 56, "medium").otherwise("low")
    rows = guesses.join(confirmed, "id", "left")
    return rows.select("id", day.alias("day"), F.when(F.col("next_day"), F.date_add(day, 1)).otherwise(day).alias("call_day"), sure.alias("confidence"))


def calendar_summary(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """(company, month, n, next_day, next_event, days_until) of events (company, id, day) in the next days."""
    at = F.lit(as_of).cast("date")
    soon = events.where(F.datediff("day", at).between(0, days))
    return soon.groupBy("company", F.month("day").alias("month")).agg(F.count("*").alias("n"), F.min("day").alias("next_day"), F.min(F.struct("day", "id"))["id"].alias("next_event"), F.datediff(F.min("day"), at).cast("long").alias("days_until"))


def keyword_alerts(chunks: DataFrame, words: list[str], most: int) -> DataFrame:
    """(company, word, chunk_id, snippet, n): the first chunk of each company and keyword with the text around it, ``most`` a company."""
    from ledgerline.functions.text import snippet

    hits = F.array_compact(F.array(*[F.when(F.lower("content").contains(w), F.struct(F.lit(w).alias("word"), snippet(F.col("content"), w).alias("snippet"))) for w in words]))
    each = chunks.select("company", "chunk_id", F.explode(hits).alias("h")).select("company", "h.word", F.struct("chunk_id", "h.snippet").alias("first"))
    first = each.groupBy("company", "word").agg(F.min("first").alias("first")).select("company", "word", "first.*")
    by = Window.partitionBy("company").orderBy("chunk_id", "word")
    return first.withColumn("n", F.row_number().over(by).cast("long")).where(F.col("n") <= most)


def list_alerts(alerts: DataFrame, where: dict[str, list], n: int) -> DataFrame:
    """The newest n live alerts whose columns have one of the wanted values."""
    rows = alerts.where("NOT dismissed")
    for column, values in where.items():
        rows = rows.where(F.col(column).isin(values))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def order_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with their ``place`` in their company: severity, then the newest."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return alerts.withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy(rank, F.desc("created_at"), "id")).cast("long"))


def accuracy(actual: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """``evaluate`` with the share of exact values, and a billionth of room for sums of doubles."""
    both = truth.join(actual, key, "left")
    error = F.abs(F.col("actual") - F.col("truth"))
    exact = F.count_if(error < 0.1 - 1e-9)
    return both.agg(F.count("*").alias("n"), exact.alias("exact"), F.count_if(error <= 0.05 * F.abs("truth") + 1e-9).alias("close"), F.count_if(F.col("actual").isNull()).alias("missing"), F.round(F.avg(error / F.abs("truth")) * 100, 4).alias("error_pct"), F.round(100.0 * exact / F.count("*"), 4).alias("accuracy_pct"))


def answer_accuracy(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers (answer, expected) of each key that hold what is expected, in any case of letters."""
    ok = F.coalesce(F.lower("answer"), F.lit("")).contains(F.lower("expected"))
    return answers.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.avg(ok.cast("double")).alias("accuracy"))


def top_divergence(rows: DataFrame, key: str, value: str, least: float, ids: list[str], n: int) -> DataFrame:
    """The n rows (ids, gap, side) farthest from their key's mean, ``least`` of it or more away."""
    mean = rows.groupBy(key).agg(F.avg(F.col(value).cast("decimal(18,2)")).cast("double").alias("mean"))
    far = rows.join(mean, key).select(*ids, F.round((F.col(value) - F.col("mean")) / F.col("mean"), 6).alias("gap")).where(F.abs("gap") >= least)
    return far.withColumn("side", F.when(F.col("gap") > 0, "above").otherwise("below")).orderBy(F.desc(F.abs("gap")), *ids).limit(n)
