"""What users plug in: retrievers, embedders and scorers, each called by a job that Spark spreads."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import corpus as co
from ledgerline.operators import retrieval as rt
from ledgerline.workdir import staged


class Retriever(Protocol):
    """``run`` gives hits (query_id, doc_id, score, place) of queries (query_id, text) in chunks (chunk_id, company, content)."""

    name: str

    def run(self, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame: ...


class OverlapRetriever:
    """Share of a query's words."""

    name = "overlap"

    def run(self, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        return rt.keyword_overlap(queries, chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), k)


class LongestRetriever:
    """The longest chunks for every query: a baseline that ignores what is asked."""

    name = "longest"

    def run(self, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        longest = chunks.where("content IS NOT NULL").select(F.col("chunk_id").alias("doc_id"), F.length("content").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
        return rt.top_k(queries.select("query_id").join(F.broadcast(longest)), k)  # k rows


def fused(retrievers: list[Retriever], queries: DataFrame, chunks: DataFrame, k: int, most: int) -> DataFrame:
    """Reciprocal rank fusion of the first k hits of every retriever."""
    return rt.rrf([r.run(queries, chunks, k) for r in retrievers], most)


def hashing_embedder(size: int) -> Callable:
    """A pandas UDF from texts to vectors: signed counts of words by their hash. Null texts are zero vectors."""

    def embed(texts: pd.Series) -> pd.Series:
        words = [(t or "").lower().split() for t in texts]
        # A word's hash is taken once a batch.
        place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        h = np.fromiter((zlib.crc32(w.encode()) for w in place), dtype=np.int64, count=len(place))
        at, sign = h % size, np.where(h // size % 2 == 0, 1.0, -1.0)
        out = []
        for ws in words:
            i = np.fromiter((place[w] for w in ws), dtype=np.int64, count=len(ws))
            out.append(np.bincount(at[i], sign[i], minlength=size).astype(np.float32))
        return pd.Series(out)

    return F.pandas_udf(embed, "array<float>")


def nearest(chunks: DataFrame, embedder: Callable, k: int) -> DataFrame:
    """(query_id, doc_id, score, place): neighbours of every chunk whose id is divisible by 100, in the embedder's space."""
    vectors = staged(chunks.select(F.col("chunk_id").alias("doc_id"), embedder("content").alias("embedding")), "embedded")
    queries = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return rt.top_k(rt.vector_best(queries, vectors, k).select("query_id", "doc_id", "score"), k)


def share_scorer(positive: list[str], negative: list[str]) -> Callable:
    """A pandas UDF from pieces to (positive, negative) shares of their words."""
    good, bad = frozenset(positive), frozenset(negative)

    def score(texts: pd.Series) -> pd.DataFrame:
        words = [(t or "").lower().split() for t in texts]
        share = lambda ws, own: sum(w in own for w in ws) / len(ws) if ws else 0.0
        return pd.DataFrame({"pos": [share(w, good) for w in words], "neg": [share(w, bad) for w in words]})

    return F.pandas_udf(score, "pos double, neg double")


def company_scores(chunks: DataFrame, scorer: Callable, size: int) -> DataFrame:
    """(company, sentiment, n): positive less negative, averaged over pieces of ``size`` words of a chunk, weighted by filing type."""
    words = F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda w: w != "")
    cut = chunks.select("chunk_id", "company", "filing_type", words.alias("ws")).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest((F.size("ws") - 1) / size, F.lit(0)).cast("int"))))
    scored = cut.withColumn("s", scorer(F.array_join(F.slice("ws", F.col("at") * size + 1, F.lit(size)), " ")))
    per = scored.groupBy("chunk_id", "company", "filing_type").agg((F.avg("s.pos") - F.avg("s.neg")).alias("score"))
    return co.company_sentiment(per)
