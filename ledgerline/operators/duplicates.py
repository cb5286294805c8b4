"""Duplicate events: neighbours are counted by a sweep and linked by spanning links; no pair is written out.

Events of one company and type are duplicates if their days lie within ``days`` and their amounts
within ``ratio``. Sorted by amount, an event's neighbours are a range, so their number is a
difference of two ranks; a Fenwick tree over days gives a rank for a range of days. The sorted
rows are cut into ranges of equal size, whatever a company's share of them, and each range begins
with what all ranges before it hold: sums and last events by day.

A component needs few links: of the events below that a new one meets, those on one side of its
day lie within reach of each other, so the nearest day before and the nearest day after suffice. A range
joins its links to stars around the least event of each part, so that long chains cost no rounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.graph import connected_components
from ledgerline.workdir import discard, staged

#: Stands for a day that is not known, and what makes a day's place in the tree positive.
_NO_DAY, _OFFSET, _TOP = -(1 << 30), 1 << 21, 1 << 23
_BATCH = 1 << 15
_GROUP = ["company", "type"]


class Fenwick:
    """Sums over ranges of days; it holds as much as there are days with something on them."""

    def __init__(self) -> None:
        self.tree: dict[int, int] = defaultdict(int)
        self.total = 0

    def add(self, day: int, n: int) -> None:
        self.total += n
        i = day + _OFFSET
        while i < _TOP:
            self.tree[i] += n
            i += i & -i

    def up_to(self, day: int) -> int:
        i, out, get = day + _OFFSET, 0, self.tree.get
        while i > 0:
            out += get(i, 0)
            i -= i & -i
        return out

    def between(self, first: int, last: int) -> int:
        return self.up_to(last) - self.up_to(first - 1)


class _Sweep:
    """One company and type in one range: rows come by their amount."""

    def __init__(self, days: int, ratio: float) -> None:
        self.days, self.ratio = days, ratio
        self.scaled, self.plain = Fenwick(), Fenwick()
        self.scaled_open = self.plain_open = 0  # without a day
        self.last: dict[int, tuple[float, int]] = {}
        self.last_open: tuple[float, int] | None = None
        self.next_open: tuple[float, int] | None = None
        self.waiting: list[tuple[float, int]] = []

    def carry(self, day: int, scaled: int, plain: int, last: tuple | None, first: tuple | None) -> None:
        """What the ranges before hold on a day, and the first undated event of those after."""
        if day == _NO_DAY:
            self.scaled_open, self.plain_open, self.last_open, self.next_open = scaled, plain, last, first
            return
        self.scaled.add(day, scaled)
        self.plain.add(day, plain)
        if last is not None:
            self.last[day] = last

    def _count(self, tree: Fenwick, undated: int, day: int) -> int:
        return undated + (tree.total if day == _NO_DAY else tree.between(day - self.days, day + self.days))

    def below(self, day: int, weight: int) -> int:
        """At ``ratio`` times its amount: how many lie below that, taken off."""
        out = -self._count(self.plain, self.plain_open, day)
        if day == _NO_DAY:
            self.scaled_open += weight
        else:
            self.scaled.add(day, weight)
        return out

    def at(self, day: int, amount: float, ident: int, weight: int) -> tuple[int, list[tuple[int, int]]]:
        """At its amount: how many reach down to it, and links that span what it meets below."""
        links, least = [], self.ratio * amount
        if day != _NO_DAY:
            for steps in (range(0, -self.days - 1, -1), range(1, self.days + 1)):
                for k in steps:
                    met = self.last.get(day + k)
                    if met is not None and met[0] >= least:
                        links.append((ident, met[1]))
                        break
        if self.last_open is not None and self.last_open[0] >= least:
            links.append((ident, self.last_open[1]))
        out = self._count(self.scaled, self.scaled_open, day)
        if day == _NO_DAY:
            links += self._met_by(amount, ident)
            self.last_open, self.plain_open = (amount, ident), self.plain_open + weight
        else:
            self.last[day] = (amount, ident)
            self.plain.add(day, weight)
            self.waiting.append((amount, ident))
        return out, links

    def _met_by(self, amount: float, ident: int) -> list[tuple[int, int]]:
        """Links of the dated events since the last undated one to the next undated one."""
        out = [(i, ident) for v, i in self.waiting if v >= self.ratio * amount]
        self.waiting = []
        return out

    def end(self) -> list[tuple[int, int]]:
        return [] if self.next_open is None else self._met_by(*self.next_open)


def _least(up: dict[int, int], x: int) -> int:
    """The least event that ``x`` is joined with; the way there is halved."""
    while (y := up.setdefault(x, x)) != x:
        up[x] = x = up[y]
    return x


def _swept(days: int, ratio: float):
    names = ("pid", "company", "type", "carried", "side", "day", "amount", "ident", "weight", "scaled", "plain", "last", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep, idents, others, counts = None, None, [], [], []
        up: dict[int, int] = {}  # of one company and type in one range

        def put(links: list[tuple[int, int]]) -> None:
            for a, b in links:
                x, y = _least(up, a), _least(up, b)
                up[max(x, y)] = min(x, y)

        def close() -> None:
            put(sweep.end())
            stars = [(x, y) for x in up if (y := _least(up, x)) != x]
            idents.extend(x for x, _ in stars)
            others.extend(y for _, y in stars)
            counts.extend([0] * len(stars))
            up.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(idents, pa.int64()), pa.array(others, pa.int64()), pa.array(counts, pa.int64())], names=["ident", "other", "n"])
            idents.clear(), others.clear(), counts.clear()
            return batch

        def pair(x: dict | None) -> tuple | None:
            return None if x is None or x["ident"] is None else (x["amount"], x["ident"])

        for batch in batches:
            for pid, company, kind, carried, side, day, amount, ident, weight, scaled, plain, last, first in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (pid, company, kind) != now:
                    if sweep is not None:
                        close()
                    now, sweep = (pid, company, kind), _Sweep(days, ratio)
                if carried:
                    sweep.carry(day, scaled, plain, pair(last), pair(first))
                    continue
                if side == 0:
                    n = sweep.below(day, weight)
                else:
                    n, links = sweep.at(day, amount, ident, weight)
                    put(links)
                idents.append(ident)
                others.append(None)
                counts.append(n)
                if len(idents) >= _BATCH:
                    yield out()
        if sweep is not None:
            close()
        yield out()

    return run


def _ranges(classes: DataFrame, days: int, ratio: float) -> DataFrame:
    """(ident, other, n): parts of the number of neighbours with a known amount, and spanning links, of classes with one."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A row at its amount, and one where the amounts begin that it reaches down to; that one comes first among equals.
    ends = F.array(F.struct(F.lit(0).alias("side"), (F.col("amount") * ratio).alias("key")), F.struct(F.lit(1).alias("side"), F.col("amount").alias("key")))
    rows = classes.where("amount > 0").select(*_GROUP, "day", "amount", "ident", "weight", F.explode(ends).alias("e")).select("*", "e.*").drop("e")
    order = ["key", "side", "ident"]
    rows = staged(rows.repartitionByRange(parts, *_GROUP, "key", "side").sortWithinPartitions(*_GROUP, *order).withColumn("pid", F.spark_partition_id()), "event-ranges")

    own = F.when(F.col("side") == 1, F.struct("amount", "ident"))
    sums = rows.groupBy("pid", *_GROUP, "day").agg(F.sum(F.when(F.col("side") == 0, F.col("weight")).otherwise(0)).alias("scaled"), F.sum(F.when(F.col("side") == 1, F.col("weight")).otherwise(0)).alias("plain"), F.max(own).alias("last"), F.min(own).alias("first"))
    sums = staged(sums, "event-sums")
    wide = sums.groupBy(*_GROUP).agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("lo < hi").select(*_GROUP)
    spread = sums.join(wide, _GROUP)
    grid = spread.select(*_GROUP, "day").distinct().join(spread.select(*_GROUP, "pid").distinct(), _GROUP)
    grid = grid.join(spread, [*_GROUP, "day", "pid"], "left")
    by = Window.partitionBy(*_GROUP, "day").orderBy("pid")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c)
    carried = grid.select("pid", *_GROUP, "day", zero("scaled"), zero("plain"), F.max("last").over(before).alias("last"), F.min("first").over(after).alias("first"))
    whole = rows.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("carried", F.lit(True)), allowMissingColumns=True)
    by_range = whole.repartitionById(parts, "pid").sortWithinPartitions("pid", *_GROUP, F.desc("carried"), *order)
    out = staged(by_range.select("pid", *_GROUP, "carried", "side", "day", "amount", "ident", "weight", "scaled", "plain", "last", "first").mapInArrow(_swept(days, ratio), "ident long, other long, n long"), "event-neighbours")
    discard(rows, sums)
    return out


def _keyed(events: DataFrame) -> tuple[DataFrame, list[str]]:
    """Events with what makes two of them one class, and the names of that."""
    amount, day = F.col("amount").cast("double"), F.coalesce(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(_NO_DAY))
    rows = events.select("id", F.lower("company").alias("company"), "type", day.alias("day"), F.when(~F.isnan(amount), amount).alias("amount"))
    rows = rows.withColumn("alone", F.when(F.col("amount") < 0, F.col("id"))).withColumn("amount", F.coalesce("amount", F.lit(0.0)) + F.lit(0.0))
    return rows, [*_GROUP, "day", "amount", "alone"]


def _facts(rows: DataFrame, what: list[str], days: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Classes of equal events (first_id, ident, n_links, links to open ones), and the sweep's rows."""
    # Classes are numbered in the order of their ids, which may repeat, so that a component's least class has its least id.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = rows.dropna(subset=["id", *_GROUP]).groupBy(*what).agg(F.min("id").alias("first_id"), F.count("*").alias("weight"))
    classes = staged(classes.repartitionByRange(parts, "first_id").sortWithinPartitions("first_id").withColumn("ident", F.monotonically_increasing_id()), "event-classes")
    met = _ranges(classes, days, ratio)

    dated = F.col("day") != _NO_DAY
    kind = F.when(F.col("amount") > 0, F.when(dated, "full").otherwise("undated")).when(F.col("amount") < 0, F.when(dated, "negative").otherwise("lost")).otherwise(F.when(dated, "open").otherwise("any"))
    kinds = classes.withColumn("kind", kind)
    weigh = lambda *k: F.sum(F.when(F.col("kind").isin(*k), F.col("weight")).otherwise(0))
    first = lambda *k: F.min(F.when(F.col("kind").isin(*k), F.col("ident")))
    by_day = kinds.where(dated).groupBy(*_GROUP, "day").agg(weigh("open").alias("z"), weigh("full", "negative").alias("f"), first("open").alias("rep"))
    of_day = Window.partitionBy(*_GROUP).orderBy("day")  # a row a day
    around, reach = of_day.rangeBetween(-days, days), lambda a, b: of_day.rangeBetween(a, b)
    by_day = by_day.select(
        *_GROUP, "day", F.sum("z").over(around).alias("open_near"), F.sum("f").over(around).alias("full_near"),
        F.last("rep", True).over(reach(-days, 0)).alias("left"), F.last("rep", True).over(reach(-days, -1)).alias("before"), F.first("rep", True).over(reach(1, days)).alias("right"),
    )
    totals = kinds.groupBy(*_GROUP).agg(weigh("any").alias("n_any"), weigh("open").alias("n_open"), weigh("undated", "lost").alias("n_undated"), F.sum("weight").alias("n_all"), first("any").alias("of_any"), first("open").alias("of_open"), first("undated", "lost").alias("of_undated"))
    swept = met.where("other IS NULL").groupBy("ident").agg(F.sum("n").alias("n"))
    facts = kinds.join(totals, _GROUP).join(by_day, [*_GROUP, "day"], "left").join(swept, "ident", "left")
    n = F.expr("""CASE kind WHEN 'full' THEN n + open_near + n_any - 1 WHEN 'undated' THEN n + n_open + n_any - 1 WHEN 'negative' THEN open_near + n_any
 WHEN 'lost' THEN n_open + n_any WHEN 'open' THEN full_near + open_near + n_undated + n_any - 1 ELSE n_all - 1 END""")
    facts = staged(facts.withColumn("n_links", n), "event-facts")
    discard(classes)
    return facts, met


def _with_classes(rows: DataFrame, what: list[str], of_class: DataFrame, name: str) -> DataFrame:
    """Every event with its class's columns; events without an id, a company or a type stand alone."""
    known = rows.dropna(subset=["id", *_GROUP])
    found = known.join(of_class, [known[c].eqNullSafe(of_class[c]) for c in what]).select("id", "n_links", "component")
    lost = rows.where(F.col("id").isNull() | F.col("company").isNull() | F.col("type").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return staged(found.unionByName(lost), name)


def duplicate_classes(events: DataFrame, days: int = 30, ratio: float = 0.7) -> DataFrame:
    """(id, n_links, component) of every event (id, company, type, day, amount).

    ``n_links``: other events of one company (in any case) and type within some days and a ratio
    of amounts. A null or zero amount agrees with every amount, a null day with every day, and a
    negative amount with null or zero ones alone. ``component``: the smallest id reachable by
    links. Null ids, companies or types link with nothing; repeated rows count each; an empty
    table gives no rows.
    """
    rows, what = _keyed(events)
    facts, met = _facts(rows, what, days, ratio)
    loose = F.expr("filter(array(of_any, IF(kind IN ('undated', 'lost'), of_open, NULL), IF(kind = 'open', of_undated, NULL), left, right, IF(kind = 'open', before, NULL)), x -> x IS NOT NULL AND x <> ident)")
    edges = met.where("other IS NOT NULL").select("ident", "other").unionByName(facts.select("ident", F.explode(loose).alias("other")))
    labels = connected_components(edges, "ident", "other").withColumnRenamed("node", "ident")
    names = facts.select(F.col("ident").alias("class"), F.col("first_id").alias("component"))
    of_class = facts.select(*what, "ident", "n_links").join(labels, "ident", "left").withColumn("class", F.coalesce("component", "ident")).drop("component").join(names, "class").select(*what, "n_links", "component")
    of_class = staged(of_class, "event-components")
    out = _with_classes(rows, what, of_class, "event-duplicates")
    discard(met, facts, of_class)
    return out
