"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.workdir import discard, staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is its smallest node.

    Large-star links each node's larger neighbours to the smallest node it sees, small-star
    its smaller ones; the rounds grow with the logarithm of the longest path. Nothing is
    collected but a count and a checksum a round. Null ends are dropped; loops and repeated
    edges change nothing; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).dropna()
    now = staged(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before, now = now, staged(turned.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def kept_in_order(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, keeper): nodes that are dropped as an earlier kept node is linked to them, and the first such.

    Nodes are taken in their own order: one is kept unless an earlier kept one is linked to
    it. A round keeps every node without an undecided earlier neighbour and drops what it is
    linked to; rounds grow with the longest chain of undecided neighbours. Null ends are
    dropped; loops and repeated edges change nothing; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).dropna()
    whole = staged(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "ordered-edges")
    left, kept = whole, whole.select(F.col("a").alias("node")).where("false")
    while not left.isEmpty():
        later = left.select(F.col("b").alias("node")).distinct()
        sure = left.select(F.col("a").alias("node")).distinct().join(later, "node", "left_anti")
        sure = staged(sure, "kept-nodes")
        dropped = left.join(sure.withColumnRenamed("node", "a"), "a", "left_semi").select("b").distinct()
        rest = left.join(dropped, "b", "left_anti").join(sure.withColumnRenamed("node", "a"), "a", "left_anti").join(dropped.withColumnRenamed("b", "a"), "a", "left_anti")
        # An end that loses all its edges is kept: it has no earlier neighbour left.
        freed = left.select(F.col("b").alias("node")).union(left.select("a")).distinct().join(dropped.withColumnRenamed("b", "node"), "node", "left_anti")
        rest = staged(rest, "ordered-edges")
        still = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
        kept = kept.union(freed.join(still, "node", "left_anti"))
        kept = staged(kept, "kept")
        before, left = left, rest
        discard(sure)
        if before is not whole:
            discard(before)
    kept = kept.distinct()
    return whole.join(kept.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("keeper")).join(kept, "node", "left_anti")
