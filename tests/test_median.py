"""Upper medians against sorting, with ties, hot keys and odd values."""

import random

from ledgerline.operators import corpus as co


def test_upper_median_equals_sorting(spark):
    rng = random.Random(16)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, float("nan"), float("inf"), -float("inf"), 5.0, 5.0, rng.uniform(-1e9, 1e9), rng.gauss(0, 1e-6)])) for _ in range(3000)]
    rows += [("hot", 7.0)] * 2000 + [("hot", float(i)) for i in range(1500)] + [("one", -0.0), ("lost", None)]
    rows += [("tight", 1.0 + i * 2**-52) for i in range(1001)]
    want = {}
    for k, v in rows:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    want = {k: sorted(vs)[len(vs) // 2] for k, vs in want.items()}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for bins in (co.BINS, 3):
        assert {r.k: r["median"] for r in co.upper_median(df, ["k"], "v", bins).collect()} == want


def test_exact_decimals_and_two_keys(spark):
    df = spark.sql("SELECT id % 3 AS a, id % 2 AS b, CAST(12345678901234567 AS DECIMAL(20,0)) + id AS v FROM range(600)")
    got = {(r.a, r.b): int(r["median"]) for r in co.upper_median(df, ["a", "b"], "v").collect()}
    assert got == {(a, b): sorted(12345678901234567 + i for i in range(600) if (i % 3, i % 2) == (a, b))[50] for a in range(3) for b in range(2)}
