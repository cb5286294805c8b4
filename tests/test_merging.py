"""Merged events against greedy absorption in plain Python."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import merging as mg
from ledgerline.queries import QUERIES
from tests.test_whole_jobs import agree

SCHEMA = "id long, company string, type string, day date, amount double, doc_type string"
ORDER = ["SEC", "NEWS", "WEB"]


def greedy(rows, days=30, ratio=0.7):
    turn = lambda r: ((ORDER + ["OTHER"]).index(r[5] if r[5] in ORDER else "OTHER"), r[0])
    said = lambda r: ":".join(str(x) for x in (r[5], r[0]) if x is not None)
    alone = [r for r in rows if None in r[:3]]
    kept, home = [], {}
    for r in sorted((r for r in rows if None not in r[:3]), key=turn):
        first = next((k for k in kept if agree(k, r, days, ratio) or k == r), None)
        if first is None:
            kept.append(r)
        home.setdefault((first or r)[0], []).append(r)
    out = [(i, len(m), " ".join(said(r) for r in m)) for i, m in home.items()]
    return sorted([*out, *[(r[0], 1, said(r)) for r in alone]], key=str)


def found(spark, rows, **kw):
    return sorted((tuple(r) for r in mg.merge_events(spark.createDataFrame(rows, SCHEMA), ORDER, **kw).collect()), key=str)


@pytest.mark.parametrize(("seed", "known"), [(1, 1.0), (2, 0.95), (3, 0.6)])
def test_equals_greedy_absorption(spark, seed, known):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        day = date(2024, 1, 1) + timedelta(days=rng.randrange(600)) if rng.random() < known else None
        amount = rng.choice([7.0, 10.0, 1.0, 0.7]) * rng.randrange(1, 60) if rng.random() < known else rng.choice([None, 0.0, -0.0, -5.0, -5.0, -6.0, float("nan"), float(rng.randrange(1, 50))])
        rows.append((i, rng.choice(["A", "a", "B", "C"]), rng.choice(["x", "y"]), day, None if amount != amount else amount, rng.choice([*ORDER, "OTHER", None])))
    rows += [(1000 + i, "A", "x", date(2024, 1, 1), 100.0, "NEWS") for i in range(40)]
    rows += [(None, "A", "x", date(2024, 1, 1), 100.0, "SEC"), (2000, None, "x", date(2024, 1, 1), 100.0, None), (2001, "A", None, None, None, "WEB"), (2002, "Z", "z", None, -1.0, "WEB")]
    assert found(spark, rows) == greedy(rows)


def test_chains_and_ratio_edges(spark):
    rows = [(i, "A", "x", date(2020, 1, 1) + timedelta(days=20 * i), 100.0, "SEC") for i in range(40)]
    rows += [(100 + i, "B", "x", date(2020, 1, 1), 0.7**i * 1000, "NEWS") for i in range(12)] + [(200 + i, "B", "x", date(2020, 1, 31), 0.7**i * 1000 * (1 + 1e-12), "WEB") for i in range(12)]
    rows += [(300, "C", "x", date(1950, 1, 1), 1e-300, "WEB"), (301, "C", "x", date(1950, 1, 31), 1.4e-300, "SEC"), (302, "C", "x", date(1950, 3, 3), 1e300, "SEC")]
    assert found(spark, rows) == greedy(rows)
    with pytest.raises(ValueError, match="ratio"):
        found(spark, rows, ratio=1.5)


def test_copies_empty_table_and_clashing_columns(spark):
    rows = [(7, "A", "x", date(2024, 1, 1), 10.0, "WEB")] * 3 + [(8, "A", "x", None, None, "SEC")] * 2
    assert found(spark, rows) == [(8, 5, "SEC:8 SEC:8 WEB:7 WEB:7 WEB:7")]
    assert found(spark, []) == []
    more = spark.createDataFrame(rows, SCHEMA)
    for name in ("home", "turn", "kind", "key", "d", "g", "rank", "alone"):
        more = more.withColumn(name, F.lit(1))
    assert [tuple(r) for r in mg.merge_events(more, ORDER).collect()] == [(8, 5, "SEC:8 SEC:8 WEB:7 WEB:7 WEB:7")]


def test_every_event_is_in_one_home(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        got = QUERIES["evt_05_merge_events"](spark, path)
        assert got.agg(F.sum("n_sources")).first()[0] == spark.read.parquet(f"{path}/orders.parquet").count()


def test_long_chains_take_one_sweep(spark, monkeypatch):
    """Cells that wait for each other cost no jobs: rounds once staged four tables each and filled the driver with their plans."""
    calls = []
    monkeypatch.setattr(mg, "staged", lambda df, name, own=mg.staged: calls.append(name) or own(df, name))
    rows = [(i, "A", "x", date(2000, 1, 1) + timedelta(days=25 * i), 100.0 + i % 7, "SEC") for i in range(120)]
    assert found(spark, rows) == greedy(rows) and len(calls) <= 2


def test_what_a_sweep_remembers_grows_with_cells():
    kept = mg.Kept(30, 0.7)
    for i in range(5000):
        for day, amount in ((i % 300, 1.0 + i % 400), (i % 300, -1.0 - i), (mg._NO_DAY, -1.0 - i), (0, math.inf)):
            if kept.absorbing(day, amount) is None:
                kept.add(day, amount, {"i": i})
    assert len(kept.turns) < 1000 and kept.n > 9000
