"""The inverted file: recall against exact search, how much it scores, and what it holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import retrieval as rt
from ledgerline.operators.vector_index import Codebook, VectorIndex
from ledgerline.queries import QUERIES
from ledgerline.queries import search as se
from ledgerline.workdir import new_path


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_share_of_scored_rows(spark, sf):
    path = f"/root/testdata/{sf}"
    vectors = spark.read.parquet(f"{path}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    asked = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id): r.score for r in rt.vector_topk(asked, vectors, 10).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in QUERIES["ret_02_vector_topk_lsh_all"](spark, path).collect()}
    assert len(got) == len(exact) and len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    assert all(abs(got[k] - exact[k]) < 1e-9 for k in exact.keys() & got.keys()) and se.SCORED < 0.1


def test_every_row_is_indexed_and_few_are_scored(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 24))
    x = np.repeat(centers, 50, axis=0) + 0.3 * rng.standard_normal((2000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "doc_id long, embedding array<double>")
    index = VectorIndex(spark, new_path(spark, "index-test")).build(df, subspaces=8, cells=40)
    assert spark.read.parquet(f"{index.root}/codes").agg(F.count("*"), F.count_distinct("doc_id")).first()[:] == (2000, 2000)
    asked = df.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in rt.vector_topk(asked.where("embedding IS NOT NULL"), df.where("embedding IS NOT NULL"), 10).collect()}
    got = {(r.query_id, r.doc_id) for r in index.search(asked, 10, probes=6, best=60).collect()}
    assert len(exact & got) >= 0.95 * len(exact)
    ranked = index.ranked(asked, 6, 60).groupBy("query_id").count().collect()
    assert len(ranked) == 20 and all(r["count"] <= 60 for r in ranked)


def test_codes_stand_for_vectors_nearby():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 16))
    book = Codebook.fit(x, 8, 4)
    home, codes = book.encode(x)
    for i in (0, 17, 499):
        assert abs(book.score(x[3], home[i], codes[i : i + 1])[0] - x[3] @ x[i]) < 1.5
    assert VectorIndex and (np.bincount(home, minlength=8) > 0).sum() >= 6


def test_a_search_joins_no_codes_with_queries(spark):
    """Every code once met every query that probes its cell as a row that held the query's vector; all codes of all cells give exact search."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.repeat(rng.standard_normal((150, 12)), 4, axis=0))], "doc_id long, embedding array<double>")
    index = VectorIndex(spark, new_path(spark, "index-test")).build(df, subspaces=4, cells=9)
    asked = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = index.search(asked, 10, probes=9, best=600)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    want = rt.vector_topk(asked, df, 10)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
