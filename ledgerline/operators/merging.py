"""Events merged in the order of their authority, without a table of pairs.

Events of a company and type stream through one task in their order, as Spark sorts them, and meet
only the kept ones around them. Days and amounts are cut into cells so narrow that all events of one
cell are duplicates of each other: a cell holds one kept event at most, so what a task remembers
grows with the cells of a company and type, not with its events.

What has no day or no amount agrees with all days or amounts: such events look at rows, columns or
the whole of a company and type, where no more are kept than there are cells.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.duplicates import _NO_DAY, _keyed
from ledgerline.workdir import discard, staged

_GROUP = ["company", "type"]
#: The cell of an infinite amount.
_TOP = 1 << 40


class Kept:
    """The kept events of one company and type, in the order of their turns."""

    def __init__(self, days: int, ratio: float) -> None:
        self.days, self.ratio, self.n = days, ratio, 0
        # A little narrower than the ratio, so that rounding never puts two amounts that differ into one cell.
        self.step = -math.log(ratio) * (1 - 1e-9)
        self.full: dict[tuple[int, int], tuple[int, int, float]] = {}
        self.days_of: dict[int, set[int]] = defaultdict(set)
        self.amounts_of: dict[int, set[int]] = defaultdict(set)
        self.undated: dict[int, tuple[int, float]] = {}
        self.open: dict[int, tuple[int, int]] = {}
        self.negative: dict[int, int] = {}
        self.first: dict[str, int] = {}
        self.turns: dict[int, dict] = {}

    def _cell(self, day: int, amount: float) -> tuple[int, int]:
        return day // (self.days + 1), _TOP if amount == math.inf else math.floor(math.log(amount) / self.step) if amount > 0 else 0

    def _near(self, x: float, y: float) -> bool:
        return min(x, y) >= self.ratio * max(x, y)

    def _full_at(self, cells: list[tuple[int, int]], day: int, amount: float) -> Iterator[int]:
        for cell in cells:
            at = self.full.get(cell)
            if at and (day == _NO_DAY or abs(at[1] - day) <= self.days) and (amount == 0 or self._near(at[2], amount)):
                yield at[0]

    def _firsts(self, *kinds: str) -> Iterator[int]:
        return (self.first[k] for k in kinds if k in self.first)

    def absorbing(self, day: int, amount: float) -> int | None:
        """The place of the first kept event that agrees: days that do are one cell apart at most, amounts two (by rounding)."""
        dated = day != _NO_DAY
        d, g = self._cell(day, amount)
        found = [*self._firsts("any")]
        if amount > 0:
            amounts = range(g - 2, g + 3)
            cells = [(e, h) for e in range(d - 1, d + 2) for h in amounts] if dated else [(e, h) for h in amounts for e in self.days_of.get(h, ())]
            found += self._full_at(cells, day, amount)
            found += [at[0] for h in amounts if (at := self.undated.get(h)) and self._near(at[1], amount)]
        elif amount == 0:
            if not dated:
                return 0 if self.n else None
            found += self._full_at([(e, h) for e in range(d - 1, d + 2) for h in self.amounts_of.get(e, ())], day, amount)
            found += self._firsts("undated", "lost")
            found += [self.negative[e] for e in range(day - self.days, day + self.days + 1) if e in self.negative] if self.negative else []
        if amount <= 0 and not dated:
            found += self._firsts("open")
        elif dated:
            found += [at[0] for e in range(d - 1, d + 2) if (at := self.open.get(e)) and abs(at[1] - day) <= self.days]
        elif amount > 0:
            found += self._firsts("open")
        return min(found, default=None)

    def add(self, day: int, amount: float, turn: dict) -> None:
        """Keep an event that nothing kept absorbs; of negative amounts, which absorb none of each other, the first of a day stands for all."""
        n, dated = self.n, day != _NO_DAY
        if amount >= 0 or (day not in self.negative if dated else "lost" not in self.first):
            self.turns[n] = turn
        d, g = self._cell(day, amount)
        if amount > 0 and dated:
            self.full[d, g] = (n, day, amount)
            self.days_of[g].add(d)
            self.amounts_of[d].add(g)
        elif amount > 0:
            self.undated[g] = (n, amount)
        elif amount == 0 and dated:
            self.open[d] = (n, day)
        elif amount < 0 and dated:
            self.negative.setdefault(day, n)
        kind = ("full" if dated else "undated") if amount > 0 else ("negative" if dated else "lost") if amount < 0 else ("open" if dated else "any")
        self.first.setdefault(kind, n)
        self.n += 1


def homes(classes: DataFrame, days: int, ratio: float) -> DataFrame:
    """Classes (company, type, turn, day, amount, ...) with ``home``, the turn of the first kept class that absorbs one, its own if it is kept."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, None
        for batch in batches:
            place, turn = [], batch.column("turn")
            for i, (company, kind, day, amount) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*_GROUP, "day", "amount")), strict=True)):
                if (company, kind) != group:
                    group, kept = (company, kind), Kept(days, ratio)
                at = kept.absorbing(day, amount)
                if at is None:
                    own = turn[i].as_py()
                    kept.add(day, amount, own)
                place.append(own if at is None else kept.turns[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, turn.type)], names=[*batch.schema.names, "home"])

    ordered = classes.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "turn")
    schema = classes.schema
    return ordered.mapInArrow(sweep, schema.add("home", schema["turn"].dataType))


def merge_events(events: DataFrame, authority: list[str], days: int = 30, ratio: float = 0.7) -> DataFrame:
    """(id, n_sources, evidence) of canonical events (id, company, type, day, amount, doc_type).

    Events are taken by authority, then id (of repeated ids by day and amount); one is absorbed by
    the first canonical event that it duplicates, as ``duplicate_classes`` says, and its evidence
    (doc_type:id) is appended. Unknown doc_types come last. Events without an id, a company or a
    type stand alone; repeated rows count each, as copies even if their amount is negative; an
    empty table gives no rows.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in authority]), F.col("doc_type"))
    # Each event's own place goes along under its id: what makes a class comes from the same rows.
    known, what = _keyed(events.withColumn("id", F.struct(F.when(F.coalesce(rank, F.lit(0)) == 0, len(authority) + 1).otherwise(rank).cast("int").alias("rank"), "id", "doc_type")))
    alone = F.col("id.id").isNull() | F.col("company").isNull() | F.col("type").isNull()
    line = F.concat_ws(":", "id.doc_type", F.col("id.id").cast("string"))
    single = known.where(alone).select("id.id", F.lit(1).cast("long").alias("n_sources"), line.alias("evidence"))
    known = known.where(~alone)
    turn = F.struct("id.rank", "id.id", "day", "amount", "id.doc_type")
    classes = staged(known.groupBy(*what).agg(F.min(turn).alias("turn")), "merge-turns")
    of = staged(homes(classes, days, ratio), "merge-homes").select(*what, "home")
    discard(classes)
    k, o = known.alias("k"), of.alias("o")
    placed = k.join(o, [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in what]).select(F.col("k.company").alias("company"), F.col("k.type").alias("type"), "home", "id", line.alias("e"))
    merged = placed.groupBy(*_GROUP, "home").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "e"))), lambda x: x["e"]), " ").alias("evidence"))
    return merged.select(F.col("home.id").alias("id"), "n_sources", "evidence").unionByName(single)
