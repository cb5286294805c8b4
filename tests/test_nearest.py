"""The best rows of a search against all pairs scored and ranked, and what a search may not do."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import nearest as ne
from ledgerline.operators import retrieval as rt
from ledgerline.plans import hooks as hk
from ledgerline.queries import QUERIES

SCHEMA = "doc_id long, embedding array<float>, label int, kind string"


def vectors(spark, seed, n=700):
    rng = random.Random(seed)
    few = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice(few) if rng.random() < 0.7 else [rng.gauss(0, 1) for _ in range(6)], rng.choice([1, 2, None]), rng.choice(["x", "y"])) for i in range(n)]
    rows += [(900, None, 1, "x"), (901, [0.0] * 6, 2, "y"), (902, [1.0, 2.0], 1, "x"), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2, "x"), (904, [float("nan")] * 6, 1, "y"), (905, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 1, "x"), (906, [], 1, "x")]
    return spark.createDataFrame(rows + rows[:30], SCHEMA)


@pytest.mark.parametrize(("groups", "digits", "k"), [([], None, 7), (["label"], 9, 3), (["label", "kind"], None, 400)])
def test_equals_ranking_all_pairs(spark, monkeypatch, groups, digits, k):
    monkeypatch.setattr(ne, "_PAIRS", 300)
    v = vectors(spark, k)
    q = v.where("doc_id % 50 = 0 OR doc_id >= 900").select(F.col("doc_id").alias("query_id"), "embedding").distinct()
    pairs = rt.vector_scores(q, v)
    pairs = pairs.withColumn("score", F.round("score", digits)) if digits else pairs
    from pyspark.sql import Window

    by = Window.partitionBy("query_id", *groups).orderBy(F.desc("score"), "doc_id")
    ranked = lambda df: sorted(map(str, df.withColumn("p", F.row_number().over(by)).where(F.col("p") <= k).select("query_id", *groups, "p", "doc_id", "score").collect()))
    assert ranked(rt.vector_best(q, v, k, tuple(groups), digits)) == ranked(pairs)


def test_halves_round_as_spark_rounds(spark):
    x = [0.5000000005, 0.1234567895, -0.1234567895, 0.0000000015, 0.3, 1.0, float("nan")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert np.array_equal(ne.rounded(np.array(x), 9), want, equal_nan=True)


@pytest.mark.parametrize("name", ["ret_10_boost", "ret_11_align_evidence", "ret_12_expand_parents", "ret_14_dedup_hits_keyed", "ret_15_search_by_period", "ret_19_search_scope", "ret_20_evidence_gate_all", "ret_20_evidence_gate_terms", "ret_21_combine_scores", "ret_21_supplied_scores", "ret_22_assemble_context", "ret_23_comparison_table"])
def test_searches_write_no_pairs(spark, name):
    """Every pair of a query and a row once went through a nested loop and was sorted."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def okapi(queries, docs, k, k1=1.5, b=0.75):
    split = lambda x: (x or "").lower().split()
    mean = sum(len(split(x)) for _, x in docs) / len(docs)
    tf = Counter((i, len(split(x)), w) for i, x in docs for w in split(x))
    df = Counter(w for _, _, w in tf)
    out = []
    for q in {i for i, _ in queries}:
        terms = {w for i, x in queries if i == q for w in split(x)}
        score = Counter()
        for (i, dl, w), n in tf.items():
            if w in terms:
                score[i] += math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * (k1 + 1) / (n + k1 * (1 - b + b * dl / mean))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, i, place + 1, round(s, 6)) for place, (i, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "again", "most"), [(1, False, 500_000), (2, True, 40)])
def test_bm25_equals_plain_scores(spark, monkeypatch, seed, again, most):
    """Also where ids repeat, with texts of one length and of several, and where queries go in blocks."""
    monkeypatch.setattr(rt, "MAX_TERMS", most)
    monkeypatch.setattr(ne, "_PAIRS", 4096)
    rng = random.Random(seed)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.4)) % 97}" for _ in range(rng.randrange(0, 30)))
    docs = [(i, rng.choice([None, "", "same words here w1"]) if rng.random() < 0.1 else text()) for i in range(150)]
    docs += [(rng.randrange(150), text()) for _ in range(40)] + docs[:20] if again else []
    queries = [(i, text()) for i in range(25)] + [(3, "w1 w2 w1")]
    got = rt.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and sorted((r.query_id, r.doc_id, r.place, round(r.score, 6)) for r in got.collect()) == okapi(queries, docs, 6)


def test_an_embedder_runs_once_and_meets_no_pairs(spark):
    rng = random.Random(5)
    texts = [(i, None if i % 90 == 7 else " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(12)))) for i in range(301)]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    embedder = hk.hashing_embedder(16)
    got = hk.nearest(chunks, embedder, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "ArrowEvalPython" not in plan
    vectors = chunks.select(F.col("chunk_id").alias("doc_id"), embedder("content").alias("embedding"))
    want = rt.top_k(rt.vector_scores(vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), vectors), 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    word = embedder.func(pd.Series(["a b a", None]))
    h = [zlib.crc32(w.encode()) for w in ("a", "b", "a")]
    assert [x.sum() for x in word] == [sum(1.0 if x // 16 % 2 == 0 else -1.0 for x in h), 0.0]
