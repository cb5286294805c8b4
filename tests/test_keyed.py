"""Keyed tables and partition refreshes: replays, crashes, writers that race, compaction."""

import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.sources import keyed as ky

SCHEMA = "k long, at timestamp, v string"
T0 = datetime(2024, 1, 1)


def batches(rng, n=6):
    out = []
    for b in range(n):
        rows = [(rng.choice([None, *range(40)]), rng.choice([None, *[T0 + timedelta(days=rng.randrange(30)) for _ in range(9)]]), f"{b}-{i}") for i in range(60)]
        out.append((f"b{b}", [r for r in rows]))
    return out


def brute(done):
    best = {}
    for turn, (_, rows) in enumerate(done):
        for k, at, v in rows:
            mark = (at is not None, at or T0, turn, v)
            if k not in best or mark > best[k][0]:
                best[k] = (mark, (k, at, v))
    return sorted((r for _, r in best.values()), key=str)


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_upserts_replays_and_compaction(spark, tmp_path):
    table = ky.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "at", buckets=4)
    assert rows_of(table) == [] and not table.compact()
    done = batches(random.Random(1))
    for i, (name, rows) in enumerate(done):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1))
        assert table.upsert(name, df) and not table.upsert(name, df)
        assert rows_of(table) == brute(done[: i + 1])
        if i in (1, 4):
            assert table.compact() and not table.compact() and rows_of(table) == brute(done[: i + 1])
            assert not table.upsert(name, df)
    assert table.vacuum() > 0 and rows_of(table) == brute(done)
    assert table.upsert("none", spark.createDataFrame([], SCHEMA)) and rows_of(table) == brute(done)


def test_a_read_ranks_the_deltas_alone(spark, tmp_path):
    table = ky.KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "at")
    table.upsert("a", spark.range(1000).selectExpr("id AS k", "timestamp'2024-01-01' AS at", "'x' AS v"))
    table.compact()
    assert "Window" not in table.read()._jdf.queryExecution().toString()
    table.upsert("b", spark.range(5).selectExpr("id AS k", "timestamp'2024-01-02' AS at", "'y' AS v"))
    assert table.read().where("v = 'y'").count() == 5 and table.read().count() == 1000
    plan = table.read()._jdf.queryExecution().optimizedPlan().toString()
    base = table._version()[1]["base"]
    window = plan[plan.index("Window") :] if "Window" in plan else ""
    assert window and base not in window.split("Join")[0]


def test_a_crash_before_the_manifest_and_writers_that_race(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    one, two = (ky.KeyedTable(spark, root, SCHEMA, ["k"], "at", buckets=2) for _ in range(2))
    first = spark.createDataFrame([(1, T0, "a")], SCHEMA)
    one.upsert("a", first)
    with monkeypatch.context() as m:
        m.setattr(one.folder, "put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        for act in (lambda: one.upsert("b", spark.createDataFrame([(1, T0 + timedelta(1), "b")], SCHEMA)), one.compact):
            try:
                act()
            except KeyboardInterrupt:
                pass
    assert rows_of(one) == [(1, T0, "a")]
    # The other writer commits between this one's look at the version and its own commit.
    whole = one._write
    monkeypatch.setattr(one, "_write", lambda rows: (two.upsert("c", spark.createDataFrame([(2, T0, "c")], SCHEMA)), whole(rows))[1])
    assert one.upsert("d", spark.createDataFrame([(3, T0, "d")], SCHEMA))
    assert rows_of(two) == [(1, T0, "a"), (2, T0, "c"), (3, T0, "d")]
    monkeypatch.setattr(one, "_write", lambda rows: (two.upsert("e", first), whole(rows))[1])
    assert not one.compact() and rows_of(one) == rows_of(two)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    schema = "company string, v int, error string"
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    got = ky.refresh_partitions(spark, path, df(("A", 1, None), ("B", 1, None), ("B", 2, None)), "company", "error")
    assert {tuple(r) for r in got.collect()} == {("A", "ok", 1), ("B", "ok", 2)}
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "p" / "company=A").iterdir()}
    got = ky.refresh_partitions(spark, path, df(("B", 9, None), ("B", None, "lost"), ("C", None, "down"), ("A", None, "down")), "company", "error")
    assert {tuple(r) for r in got.collect()} == {("B", "partial", 1), ("C", "error", 0), ("A", "error", 0)}
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "p" / "company=A").iterdir()} == before
    assert {(r.company, r.v) for r in spark.read.parquet(path).collect()} == {("A", 1), ("B", 9)}
    assert ky.refresh_partitions(spark, path, df(), "company", "error").count() == 0
    assert spark.read.parquet(path).count() == 2 and shutil.os.path.isdir(tmp_path / "p" / "_log")
