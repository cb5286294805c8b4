"""Benchmark decontamination in DataFrame operations alone.

Windows of an item's length are fingerprinted by SimHash over their 5-word shingles, each
weighted by how often it occurs. Items are indexed in a multi-index of BLOCKS blocks of the
64 bits, each entered with its one-bit neighbours: two fingerprints within RADIUS = 2 *
BLOCKS - 1 bits differ by one bit at most in some block, so probing the blocks finds all of
them. What is within the radius is verified by the exact weighted similarity, the sum of
least counts over the sum of greatest counts. (Windows at 0.75 differ in 11 +- 3 bits.)

Fingerprints are taken only of windows that can reach the threshold t: of T shingles they
share 2t/(1+t) * T with the item, so the places of shared shingles bound where they begin.
A document with fewer shingles than the item is one window, its whole list of m shingles: it
shares t/(1+t) * (m + T) and has m >= t * T.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.tables import fresh, table
from ledgerline.workdir import discard, staged

SHINGLE, PERCENT = 5, 75
BLOCKS = 11
RADIUS = 2 * BLOCKS - 1
#: Bytes of an item table, by its own counts, up to which it is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (first bit, width) of each block of the 64.
_SPLIT = [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS - 64 * i // BLOCKS) for i in range(BLOCKS)]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none for a null text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Hash of each k consecutive words, in order; none if there are fewer."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits: of each, whether most of the hashes (repeats count) have it set."""
    votes = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.expr("1L") == _bit(h, b), F.lit(1)).otherwise(F.lit(-1)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: out.bitwiseOR(F.when(votes(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _bit(h: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long"))


def _block(fp: Column, i: int) -> Column:
    first, width = _SPLIT[i]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _count(hashes: Column, one: Column) -> Column:
    return F.size(F.filter(hashes, lambda x: x == one))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts of two lists of shingles."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, h: n + F.least(_count(a, h), _count(b, h)))
    return common / (F.size(a) + F.size(b) - common)


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, k (words a shingle), n (shingles), shingles and fingerprint; items without words go."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    k = F.least(F.size("words"), F.lit(SHINGLE))
    hashes = F.coalesce(*[F.when(k == n, shingles_of(F.col("words"), n)) for n in range(1, SHINGLE + 1)])
    sized = words.select("item_id", F.size("words").alias("n_words"), k.alias("k"), hashes.alias("shingles"))
    return sized.withColumn("n", F.size("shingles")).withColumn("fingerprint", simhash(F.col("shingles")))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_windows): items that a document holds.

    One row for each document and item with a window of the item's length at PERCENT or more:
    the greatest similarity, the first word (from 0) of the first window that has it, and how
    many windows reach the threshold. A text shorter than an item is one window. Items of fewer than five words are one shingle. Null and
    empty texts match nothing; repeated documents or items under one id count once; documents
    or items with a null id, and other columns, are ignored; empty tables give no rows.
    """
    items = staged(_items(benchmark.where("item_id IS NOT NULL")), "benchmark-items")
    shapes = [(r.k, r.n, r.c) for r in items.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()]
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    found = None
    for k, n_shingles, n_items in sorted(shapes):  # k is SHINGLE, or less where items are that short
        part = _matches(texts, items.where(F.col("k") == k), k, n_shingles, n_items)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.select("doc_id", *[F.lit(0).cast(kind).alias(name) for name, kind in (("item_id", "long"), ("similarity", "double"), ("first_word", "long"), ("n_windows", "long"))]).where("false")
    return found


def _hashed(texts: DataFrame, k: int) -> DataFrame:
    """Without the text but with ``hashes`` and their number ``m``; words are a column first, lest each hash splits the text anew."""
    return texts.withColumn("words", words_of(F.col("text"))).select("*", F.greatest(F.size("words") - (k - 1), F.lit(0)).alias("m"), shingles_of(F.col("words"), k).alias("hashes")).drop("text", "words")


def _matches(texts: DataFrame, items: DataFrame, k: int, n_shingles: int, n_items: int) -> DataFrame:
    needed = F.ceil(F.lit(PERCENT) * (F.col("n") + F.least("m", "n")) / F.lit(100 + PERCENT))
    parts = items.select("item_id", "n", F.explode(F.array_distinct("shingles")).alias("h"))
    places = _hashed(texts, k).select("doc_id", "m", F.posexplode_outer("hashes").alias("place", "h")).where("h IS NOT NULL")  # outer: a filter inferred from an inner one would hash twice
    shared = places.join(_small(parts, 48 * n_shingles), "h").where(100 * F.col("m") >= PERCENT * F.col("n")).select("doc_id", "item_id", "n", needed.alias("needed"), "place").distinct()

    by = Window.partitionBy("doc_id", "item_id").orderBy("place")
    numbered = shared.withColumn("previous", F.lag("place").over(by)).withColumn("rank", F.row_number().over(by))
    return _windows(texts, numbered, items, k, n_shingles, n_items)


def _windows(texts: DataFrame, numbered: DataFrame, items: DataFrame, k: int, n_shingles: int, n_items: int) -> DataFrame:
    # A window of n shingles with ``needed`` shared ones has its needed-th within n places of its first.
    key = ["doc_id", "item_id"]
    nth = numbered.select(*key, (F.col("rank") - F.col("needed") + 1).alias("rank"), F.col("place").alias("nth"))
    starts = numbered.join(nth, [*key, "rank"]).where("nth - place < n")
    low = F.greatest(F.coalesce(F.col("previous") + 1, F.lit(0)), F.col("nth") - F.col("n") + 1, F.lit(0))
    starts = starts.select(*key, "n", F.explode(F.sequence(low.cast("long"), F.col("place").cast("long"))).alias("start")).distinct()
    # A document's windows of one length are printed once and carry the items that they are held against.
    starts = starts.groupBy("doc_id", "n", "start").agg(F.collect_list("item_id").alias("items"))
    starts = staged(starts.groupBy("doc_id").agg(F.collect_list(F.struct("n", "start", "items")).alias("starts")), "window-starts")

    hashed = _hashed(texts.join(starts, "doc_id"), k)
    windows = hashed.select("doc_id", "m", F.explode("starts").alias("w"), "hashes").where(f"w.start + w.n <= m OR (w.start = 0 AND m < w.n AND 100 * m >= {PERCENT} * w.n)")
    windows = windows.select("doc_id", "w.n", F.col("w.start").alias("start"), "w.items", F.slice("hashes", F.col("w.start").cast("int") + 1, F.col("w.n")).alias("own")).withColumn("print", simhash(F.col("own")))
    windows = staged(windows, "window-prints")

    blocks = F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("print"), i).alias("value")) for i in range(BLOCKS)])
    near = F.array(*[F.struct(F.lit(i).alias("block"), value.alias("value")) for i in range(BLOCKS) for value in [_block(F.col("fingerprint"), i), *[_block(F.col("fingerprint"), i).bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(_SPLIT[i][1])]]])
    index = items.select("item_id", "fingerprint", F.explode(near).alias("x")).select("item_id", "fingerprint", "x.block", "x.value")
    probes = windows.select("doc_id", "n", "start", "print", F.explode("items").alias("item_id")).select("doc_id", "n", "start", "print", "item_id", F.explode(blocks).alias("x")).select("doc_id", "n", "start", "print", "item_id", "x.block", "x.value")
    # The item is part of the key: a window meets the blocks of the items that it may hold, not of all items of its length.
    retrieved = probes.join(_small(index, 56 * n_items * (64 + BLOCKS)), ["item_id", "block", "value"])
    retrieved = retrieved.where(F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= RADIUS).select("doc_id", "n", "start", "item_id").distinct()

    judged = retrieved.join(windows.select("doc_id", "n", "start", "own"), ["doc_id", "n", "start"]).join(_small(items.select("item_id", "shingles"), 8 * n_shingles + 64 * n_items), "item_id")
    judged = judged.withColumn("similarity", weighted_similarity(F.col("own"), F.col("shingles"))).where(F.col("similarity") >= PERCENT / 100)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"), F.countDistinct("start").alias("n_windows"))
    out = best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word"), "n_windows")
    out = staged(out, "leaks")
    discard(starts, windows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item.

    Each row is judged by its own text, whatever its doc_id (null, repeated); null and empty
    texts stay; an empty table stays empty, and an empty benchmark keeps all; all columns
    pass, whatever their names.
    """
    row = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("tag"))  # rows of one doc_id are told apart by their texts
    gone_id, gone_tag = fresh("gone_id", docs), fresh("gone_tag", docs)
    leaked = matches(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id.doc_id").alias(gone_id), F.col("doc_id.tag").alias(gone_tag)).distinct()
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_tag)), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict[str, str] = {}
