"""Duplicate events against all pairs in plain Python."""

import random
from datetime import date, datetime, timedelta

import duckdb
import pytest

from ledgerline.operators import duplicates as du
from ledgerline.queries import ORACLES, QUERIES
from tests.test_whole_jobs import agree

SCHEMA = "id long, company string, type string, day date, amount double"


def brute(rows, days=30, ratio=0.7):
    n = len(rows)
    near = {i: [] for i in range(n)}
    good = [i for i in range(n) if None not in rows[i][:3]]
    for x, i in enumerate(good):
        for j in good[x + 1 :]:
            if agree(rows[i], rows[j], days, ratio):
                near[i].append(j)
                near[j].append(i)
    component = {}
    for i in range(n):
        if i in component:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        component |= dict.fromkeys(seen, least)
    return sorted(((r[0], len(near[i]), component[i]) for i, r in enumerate(rows)), key=str)


def found(spark, rows, **kw):
    return sorted((tuple(r) for r in du.duplicate_classes(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=str)


@pytest.mark.parametrize(("seed", "known"), [(1, 1.0), (2, 0.9), (3, 0.5)])
def test_counts_and_components_equal_all_pairs(spark, seed, known):
    rng = random.Random(seed)
    rows = []
    for i in range(350):
        day = date(2024, 1, 1) + timedelta(days=rng.randrange(400)) if rng.random() < known else None
        amount = rng.choice([7.0, 10.0, 1.0, 0.7]) * rng.randrange(1, 40) if rng.random() < known else rng.choice([None, 0.0, -0.0, -5.0, -5.0, -6.0, float(rng.randrange(1, 50))])
        rows.append((i, rng.choice(["A", "a", "B"]), rng.choice(["x", "y"]), day, amount))
    rows += [(1000 + i, "A", "x", date(2024, 1, 1), 100.0) for i in range(40)] + [(3, "A", "x", date(2024, 1, 1), 100.0)]
    rows += [(None, "A", "x", date(2024, 1, 1), 100.0), (2000, None, "x", date(2024, 1, 1), 100.0), (2001, "A", None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_undated_events_join_distant_days(spark):
    rows = [(i, "A", "x", date(2020, 1, 1) + timedelta(days=90 * i), 100.0 + i) for i in range(12)]
    assert {r[2] for r in found(spark, rows)} == set(range(12))
    rows += [(50, "A", "x", None, 104.0), (51, "A", "x", None, 1000.0), (52, "A", "y", None, 104.0)]
    assert found(spark, rows) == brute(rows)


def test_a_company_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(i, "A", "x", date(2024, 1, 1) + timedelta(days=rng.randrange(300)), 1.02 ** rng.randrange(400) * 10) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert found(spark, rows, days=5, ratio=0.95) == brute(rows, 5, 0.95)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table_and_growth(spark):
    assert found(spark, []) == []
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        assert QUERIES["evt_04_duplicate_classes"](spark, path).count() == spark.read.parquet(f"{path}/events.parquet").count()


def test_the_query_and_its_sql_hold_all_links_and_components(spark, tmp_path):
    rng = random.Random(6)
    rows = [
        (i, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(3600)) if rng.random() < 0.99 else None, rng.randrange(24), rng.choice(["x", "y"]), rng.choice([7.0, 10.0, 1.0, 0.7]) * rng.randrange(1, 400))
        for i in range(300)
    ]
    rows += [(300 + i, datetime(2024, 2, 1), 1, "x", v) for i, v in enumerate([0.0, -0.0, None, float("nan"), -5.0, -5.0, 1e9, 1e9])]
    rows += [(3, datetime(2024, 2, 1), 2, "x", 50.0)] * 2 + [(None, datetime(2024, 2, 1), 2, "x", 50.0), (400, datetime(2024, 2, 1), None, "x", 50.0), (401, None, 3, None, None), (402, datetime(2031, 1, 1), 5, "z", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = brute([(i, None if u is None else f"Company{u % 6}", kind, ts and ts.date(), None if v != v else v) for i, ts, u, kind, v in rows])
    got = QUERIES["evt_04_duplicate_events"](spark, str(tmp_path))
    assert got.columns == ["id", "n_links", "component"] and sorted((tuple(r) for r in got.collect()), key=str) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["evt_04_duplicate_events"]).fetchall(), key=str) == want
