"""Operators over all of their input against brute force, where the SQL covers a part."""

import random
from datetime import date, timedelta

from ledgerline.operators import records as rc
from ledgerline.operators import retrieval as rt


def agree(x, y, days, ratio):
    if x[1].lower() != y[1].lower() or x[2] != y[2]:
        return False
    if x[3] and y[3] and abs((x[3] - y[3]).days) > days:
        return False
    return not (x[4] and y[4]) or min(x[4], y[4]) >= ratio * max(x[4], y[4])


def test_duplicate_links_hold_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        day = rng.choice([None, *[date(2024, 1, 1) + timedelta(days=rng.randrange(150)) for _ in range(30)]])
        amount = rng.choice([None, 0.0, 70.0, 100.0, 100.0, -5.0, -6.0, *[rng.choice([7.0, 10.0, 1.0]) * rng.randrange(1, 40) for _ in range(20)]])
        rows.append((i, rng.choice(["A", "a", "B"]), rng.choice(["x", "y"]), day, amount))
    rows += [(1000 + i, "A", "x", date(2024, 1, 1), 100.0) for i in range(40)] + [(None, "A", "x", date(2024, 1, 1), 100.0), (2000, None, "x", date(2024, 1, 1), 100.0)]
    df = spark.createDataFrame(rows, "id long, company string, type string, day date, amount double")
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    first = {}
    for r in sorted(known):
        first.setdefault((r[1].lower(), *r[2:]), r)
    same = {(first[r[1].lower(), *r[2:]][0], r[0], "same") for r in known} - {(r[0], r[0], "same") for r in known}
    reps = sorted(first.values())
    near = {(x[0], y[0], "near") for i, x in enumerate(reps) for y in reps[i + 1 :] if agree(x, y, 30, 0.7)}
    for slot_rows in (2000, 3):
        got = [tuple(r) for r in rc.duplicate_links(df, slot_rows=slot_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == same | near


def test_vector_scores_in_blocks(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    q, v = e.withColumnRenamed("vec_id", "query_id").select("query_id", "embedding"), e.withColumnRenamed("vec_id", "doc_id")
    one = sorted(rt.vector_scores(q, v).select("query_id", "doc_id", "score").collect())
    monkeypatch.setattr(rt, "MAX_QUERIES", 30)
    assert len(one) == 3600 and sorted(rt.vector_scores(q, v).select("query_id", "doc_id", "score").collect()) == one
