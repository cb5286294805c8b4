import duckdb
import numpy as np
import pytest

from ledgerline.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=ed.COSINE):
    """All pairs of a label, then components by search."""
    n, good = len(rows), []
    unit = [None] * n
    for i, (ident, x, label) in enumerate(rows):
        x = None if x is None or any(v is None for v in x) else np.array(x, dtype=np.float64)
        if ident is not None and label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[i] = x / np.sqrt((x * x).sum())
            good.append(i)
    near = {i: [] for i in range(n)}
    for key in {(rows[i][2], len(unit[i])) for i in good}:
        own = [i for i in good if (rows[i][2], len(unit[i])) == key]
        m = np.stack([unit[i] for i in own])
        for a, b in zip(*np.nonzero(m @ m.T >= cosine), strict=True):
            if a != b:
                near[own[a]].append(own[b])
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
        for j in seen:
            component[j] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return sorted(((r[0], len(near[i]), component[i], r[0] is None or r[0] == component[i]) for i, r in enumerate(rows)), key=str)


def found(spark, rows, schema=SCHEMA, parts=3):
    return sorted((tuple(r) for r in ed.near_duplicates(spark.createDataFrame(rows, schema).repartition(parts)).collect()), key=str)


def family(rng, base, n, noise):
    out = base + rng.standard_normal((n, len(base))) * noise * np.linalg.norm(base) / np.sqrt(len(base))
    return [x.astype(np.float32).tolist() for x in out]


def planted(rng, dims=64):
    """Tight, loose and chained families, copies and strangers over a few labels."""
    xs = []
    for noise, n in ((0.05, 60), (0.15, 40), (0.22, 30), (0.27, 30), (0.3, 20)):
        xs += [(x, 1) for x in family(rng, rng.standard_normal(dims), n, noise)]
    a, b = rng.standard_normal(dims), rng.standard_normal(dims)
    a, b = a / np.linalg.norm(a), b - (b @ a) * a / (a @ a)
    b /= np.linalg.norm(b)
    xs += [((np.cos(t) * a + np.sin(t) * b).astype(np.float32).tolist(), 2) for t in np.arange(0, 3, 0.15)]  # a chain along a circle
    xs += [(rng.standard_normal(dims).astype(np.float32).tolist(), int(k)) for k in rng.integers(0, 4, 300)]
    xs += [(xs[0][0], 1)] * 7 + [(xs[0][0], 3)] * 2 + [([2 * v for v in xs[0][0]], 1), ([-v for v in xs[0][0]], 1)]
    ids = rng.permutation(len(xs)).tolist()
    return [(i, x, k) for i, (x, k) in zip(ids, xs, strict=True)]


def test_planted_families_equal_brute_force(spark):
    rows = planted(np.random.default_rng(11))
    want = brute(rows)
    assert found(spark, rows) == want
    assert sum(r[1] > 20 for r in want) > 100 and sum(not r[3] for r in want) > 150


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 4)  # the number of blocks is the driver's choice
    rows = planted(np.random.default_rng(12))
    assert found(spark, rows, parts=5) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, one, None), (8, one, 1), (9, one, 1), (9, one, 1), (9, [3.0, -1.0, 0.5], 1), (None, one, 1), (10, [*one, 0.0], 1), (11, one, 2), (12, [1.0, 2.0, -0.0], 3), (13, [1.0, 2.0, 0.0], 3), (14, [3e38, 3e38], 4), (15, [1e-40, 1e-40], 4)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_doubles_clashing_columns_and_text_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x, 5) for i, x in enumerate(family(rng, rng.standard_normal(16), 12, 0.3))]
    wide = [(i, x, "five", 1, 2, b"x") for i, x, _ in rows]
    assert found(spark, wide, "vec_id long, embedding array<double>, label string, node int, family int, digest binary") == brute(rows)


def test_recall_at_the_threshold_and_none_below(spark):
    rng, rows, dims = np.random.default_rng(4), [], 64
    for i in range(400):  # pairs at 0.931 and at 0.929
        a, b = rng.standard_normal(dims), rng.standard_normal(dims)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.931 if i % 2 else 0.929
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
    got = {r[0]: r[1] for r in found(spark, rows, "vec_id long, embedding array<double>, label int")}
    assert sum(got[4 * i + 2] for i in range(200)) >= 199 and sum(got[4 * i] for i in range(200)) == 0


def test_plan_keeps_the_miss_bound():
    for n in (1, 10, 5000, 10**9):
        k, tables = ed.plan(n)
        assert (1 - ed.same_cell((2 - 2 * ed.COSINE) ** 0.5) ** k) ** tables <= ed.MISS
    assert ed.plan(10**9)[0] > ed.plan(5000)[0]


@pytest.mark.parametrize("sf", ["sf0.01", "check_h"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in ed.op11_embedding_dedup(spark, path).collect()), key=str)
    assert got == brute(rows)


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.sql(ed.ORACLES["op11_embedding_dedup"])
    df = ed.op11_embedding_dedup(spark, path)
    assert df.columns == want.columns and sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())
