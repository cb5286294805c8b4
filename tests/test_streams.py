"""Alert and late-row streams over several batches."""

from datetime import datetime, timedelta

from ledgerline.streaming import jobs
from ledgerline.workdir import new_path

SCHEMA = "user long, kind string, n long, dismissed boolean"


def _files(spark, parts):
    root = new_path(spark, "stream-test")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
        assert i >= 0
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)


def test_an_alert_a_key_until_it_is_dismissed(spark):
    parts = [
        [(1, "x", 1, False), (1, "x", 2, False), (2, "x", 3, False), (3, "y", 4, False)],
        [(1, "x", 11, False), (1, "x", 12, True), (3, "y", 13, True), (3, "y", 14, False), (3, "y", 15, False), (None, "x", 16, False)],
        [(1, "x", 21, False), (2, "x", 22, False), (3, "y", 23, False), (9, "x", 24, False), (None, "x", 25, False)],
        [(9, "x", 31, True), (9, "x", 32, False), (9, "x", 33, True), (9, "x", 34, False)],
    ]
    live = spark.createDataFrame([(2, "x"), (9, "x"), (9, "x")], "user long, kind string")
    got = jobs.alert_stream(spark, _files(spark, parts), live, ["user", "kind"], "n", "test")
    assert sorted(r.n for r in got.collect()) == [1, 4, 14, 16, 21, 32, 34] and got.columns == ["user", "kind", "n"]


def test_late_rows_are_held_against_the_newest_so_far(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda *days: spark.createDataFrame([(t0 + timedelta(d),) for d in days], "ts timestamp")
    got = jobs.late_rows(spark, [at(10, 1), at(3, 6), at(2, 20), at(14, 16)], "ts", timedelta(days=5))
    assert sorted((r.ts - t0).days for r in got.collect()) == [2, 3, 14]


def test_upserts_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    parts = [[(u, "x", 10 * b + u, False) for u in range(b, b + 3)] for b in range(5)]
    got = jobs.upsert_stream(spark, _files(spark, parts).select("user", "n"), ["user"], "n", "test")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (1, 11), (2, 22), (3, 33), (4, 44), (5, 45), (6, 46)]


def test_an_alert_ends_with_its_time(spark):
    t0 = datetime(2024, 1, 1)
    root, schema = new_path(spark, "stream-test"), "user long, ts timestamp, n long, dismissed boolean"
    for rows in ([(1, 0, 1), (1, 3, 2), (2, 0, 3)], [(1, 12, 4), (1, 13, 5), (2, 9, 6)], [(2, 40, 7)]):
        spark.createDataFrame([(u, t0 + timedelta(d), n, False) for u, d, n in rows], schema).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
    live = spark.createDataFrame([(9,)], "user long")
    got = jobs.alert_stream(spark, stream, live, ["user"], "n", "timed", at="ts", days=10)
    assert sorted(r.n for r in got.collect()) == [1, 3, 4, 7]
