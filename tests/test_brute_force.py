"""Operators without SQL against plain Python."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.graph import kept_in_order
from ledgerline.operators import merging as mg
from ledgerline.operators import news as nw
from ledgerline.operators import topics as tp

from tests.test_whole_jobs import agree


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_kept_in_order(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 5), (None, 3), (3, 7), (7, 3)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(max(a, b), set()).add(min(a, b))
    kept, want = set(), {}
    for n in sorted({n for a, b in edges if a is not None and a != b for n in (a, b)}):
        first = min(near.get(n, set()) & kept, default=None)
        if first is None:
            kept.add(n)
        else:
            want[n] = first
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.keeper for r in kept_in_order(df).collect()} == want
    assert kept_in_order(df.limit(0)).count() == 0


def test_reprint_edges_connect_what_pairs_connect(spark):
    rng = random.Random(2)
    words = [f"word{c}" for c in "abcdefgh"]
    rows = []
    for i in range(150):
        day = None if rng.random() < 0.1 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 40))
        rows.append((i, "" if rng.random() < 0.05 else " ".join(rng.sample(words, rng.choice([2, 3, 5, 6]))), day))
    rows += [(200 + i, "the same title again", datetime(2024, 3, 1) + timedelta(days=2 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "input_pos long, title string, published timestamp")
    tokens = {i: frozenset(w for w in t.split() if w not in nw.STOPWORDS and len(w) > 1) for i, t, _ in rows}
    at = {i: d for i, _, d in rows}
    want = {(a, b) for a in tokens for b in tokens if a < b and tokens[a] and tokens[b] and len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) >= 0.55 and (at[a] is None or at[b] is None or abs((at[a].date() - at[b].date()).days) <= 3)}
    assert {(r.src, r.dst) for r in nw.reprint_pairs(df).collect()} == want
    edges = [(r.src, r.dst) for r in nw.reprint_edges(df).collect()]
    assert components(tokens, edges) == components(tokens, want)
    assert len(edges) < 8 * len(rows)


def test_topic_clusters(spark):
    rng = random.Random(3)
    words = [f"topic{i}" for i in range(60)]
    rows = [(i, f"u{rng.randrange(70)}", " ".join(rng.sample(words, rng.choice([1, 2, 3, 6]))) + rng.choice(["", "", "", " data centers", " Supply-chain"])) for i in range(90)] + [(500, "u", None), (501, "v", "the of")]
    df = spark.createDataFrame(rows, "input_pos long, url string, title string")
    feats = {r.input_pos: (set(r.tokens), set(r.phrases), r.url) for r in tp.topic_features(df).collect()}
    own = {i: f for i, f in feats.items() if f[0] or f[1]}
    linked = [(a, b) for a in own for b in own if a < b and (own[a][1] & own[b][1] or len(own[a][0] & own[b][0]) >= 2 or own[a][0] & own[b][0] and len(own[a][0] & own[b][0]) / len(own[a][0] | own[b][0]) >= 0.25)]
    first = components(own, linked)
    members = {}
    for i, c in first.items():
        members.setdefault(c, []).append(i)
    large = {c: m for c, m in members.items() if len({own[i][2] for i in m}) >= 2}
    sets = {c: set().union(*[own[i][0] for i in m]) for c, m in large.items()}
    more = [(a, b) for a in large for b in large if a < b and len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) >= 0.4]
    got = {r.input_pos: r.cluster for r in tp.topic_clusters(tp.topic_features(df)).collect()}
    whole = components(large, more)
    assert set(got) == {i for m in large.values() for i in m}
    for c, m in large.items():  # equal labels may join more, never fewer
        assert {got[i] for i in m} == {got[m[0]]}
    for a, b in more:
        assert got[large[a][0]] == got[large[b][0]]
    assert len(set(got.values())) <= len(set(whole.values()))


def test_dedup_in_order(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        ws = list(base) if rng.random() < 0.7 else [f"x{rng.randrange(99)}" for _ in range(20)]
        for _ in range(rng.randrange(6)):
            ws[rng.randrange(len(ws))] = f"n{rng.randrange(1000)}"
        rows.append((i, rng.choice("ab"), " ".join(ws)))
    rows += [(200, "a", None), (201, "a", ""), (202, "a", rows[0][2].upper()), (203, "b", rows[0][2])]
    kept, want = [], {}
    for i, g, t in sorted(rows):
        s = set((t or "").lower().split())
        first = next((j for j, h, u in kept if h == g and s and u and len(s & u) / len(s | u) >= 0.85), None)
        if first is None:
            kept.append((i, g, s))
        else:
            want[i] = first
    df = spark.createDataFrame(rows, "id long, source string, text string")
    assert {r.id: r.keeper for r in tp.dedup_in_order(df, "source").collect()} == want


def test_merge_events(spark):
    rng = random.Random(5)
    order = ["SEC", "NEWS", "WEB"]
    rows = []
    for i in range(200):
        day = rng.choice([None, *[date(2024, 1, 1) + timedelta(days=rng.randrange(200)) for _ in range(20)]])
        rows.append((i, rng.choice(["A", "B"]), rng.choice(["x", "y", "z"]), day, rng.choice([None, 0.0, *[float(rng.randrange(1, 60)) for _ in range(15)]]), rng.choice([*order, "OTHER"])))
    rows += [(300 + i, "A", "x", date(2024, 5, 1), 50.0, order[2 - i % 3]) for i in range(7)]
    turn = lambda r: ((order + ["OTHER"]).index(r[5]), r[0])
    kept, home = [], {}
    for r in sorted(rows, key=turn):
        first = next((k for k in kept if agree(k, r, 30, 0.7)), None)
        if first is None:
            kept.append(r)
        home.setdefault((first or r)[0], []).append(r)
    want = {(i, len(m), " ".join(f"{r[5]}:{r[0]}" for r in sorted(m, key=turn))) for i, m in home.items()}
    df = spark.createDataFrame(rows, "id long, company string, type string, day date, amount double, doc_type string")
    assert {(r.id, r.n_sources, r.evidence) for r in mg.merge_events(df, order).collect()} == want


def test_embedder_and_neighbours(spark):
    from ledgerline.plans import hooks as hk

    df = spark.createDataFrame([(0, "alpha beta"), (1, "alpha beta"), (2, "gamma"), (100, None)], "chunk_id long, content string")
    got = {(r.query_id, r.doc_id): r.score for r in hk.nearest(df, hk.hashing_embedder(64), 2).collect()}
    assert abs(got[0, 1] - 1) < 1e-6 and (0, 0) in got and got[100, 0] == 0
    assert df.select(F.size(hk.hashing_embedder(8)("content")).alias("n")).distinct().collect()[0].n == 8


def test_topic_clusters_of_reprints_and_lone_tokens(spark):
    long = " ".join(f"alone{i}" for i in range(60))
    rows = [(i, f"u{i}", "alpha beta gamma delta") for i in range(5)] + [(10, "u10", "alpha beta " + long), (11, "u11", "omega " + long.upper().replace("ALONE", "other")), (12, "u12", "sigma"), (13, "u13", "sigma"), (14, "u14", "sigma tau rho phi"), (15, "u15", "sigma tau rho phi chi")]
    df = spark.createDataFrame(rows, "input_pos long, url string, title string")
    got = {r.input_pos: r.cluster for r in tp.topic_clusters(tp.topic_features(df)).collect()}
    assert got == dict.fromkeys([0, 1, 2, 3, 4, 10], 0) | dict.fromkeys([12, 13, 14, 15], 12)
    assert tp.topic_clusters(tp.topic_features(df.limit(0))).count() == 0
