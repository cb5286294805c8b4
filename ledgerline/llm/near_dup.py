"""MinHash near-dedup with SetSketch registers.

Every register of a document holds the truncated logarithm of the least of independent
exponential variables, one for each shingle, so sketches of parts merge by maximum and two
registers agree about as often as the sets overlap. ROWS registers make a band; documents
that agree in a band are candidates. Documents of equal sets are one node from the start,
found by a digest of the set. A bucket never emits all its pairs:

1. its members are held against its least node; the joint likelihood of two sketches (their
   cardinalities are known) drops candidates that are far below the threshold, and the rest
   is confirmed on the full sets;
2. where the links leave a bucket in several components, its members are held against its
   center, the node with the fewest shingles that no other node has: in a family of edited
   copies it lies nearest to what was copied, and most of the family links to it;
3. what is still apart is held against each other only where the numbers of shingles shared
   with the center, and of others that any node shares, leave room for the threshold. The
   bound is exact, so no link is lost.

A pair at the threshold shares no band with probability (1 - t^ROWS)^BANDS: 2.4e-8 at 0.75.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.graph import connected_components
from ledgerline.llm import postings
from ledgerline.llm.tables import fresh, table
from ledgerline.llm.words import Words, slices
from ledgerline.workdir import discard, release, staged

WORDS_IN_SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 3, 32
REGISTERS = ROWS * BANDS
#: Base and rate of the sketch; with two bytes a register the sizes reach e^60.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Candidates whose most likely similarity lies this far below the threshold go; over four standard errors.
SLACK = 0.2
#: Keys of the bands of packed registers; a clash of two keys makes a candidate and no link.
_BANDS = f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, i * {2 * ROWS} + 1, {2 * ROWS})))"

_RNG = np.random.Generator(np.random.PCG64(7))
_FACTOR = _RNG.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int = WORDS_IN_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and n_docs + 1 offsets into them."""
    words = Words.of(column)
    hashes = words.hashes(lower=True)
    counts, docs = words.counts(), words.doc()
    values, at = words.grams(hashes, n)
    owner = docs[at]
    for short in range(1, n):  # the whole sequence as one shingle
        if (own := counts == short).any():
            v, a = words.grams(hashes, short)
            take = own[docs[a]]
            values = np.concatenate([values, v[take] + np.uint64(short)])
            owner = np.concatenate([owner, docs[a][take]])
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    edge = np.searchsorted(owner, np.arange(len(counts) + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return np.concatenate(sets) if sets else values, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each non-empty set."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(begin), REGISTERS), dtype=np.uint16)
    for j in range(REGISTERS if len(begin) else 0):
        least = np.minimum.reduceat(values * _FACTOR[j] + _ADD[j], begin)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches with known set sizes."""
    above, below = (regs_a > regs_b).sum(1)[:, None], (regs_a < regs_b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * (np.arange(steps) + 0.5) / steps

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p_above, p_below = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    p_same = np.clip(1 - p_above - p_below, 1e-12, 1)
    score = above * np.log(p_above) + below * np.log(p_below) + (regs_a.shape[1] - above - below) * np.log(p_same)
    return j[np.arange(len(j)), score.argmax(1)]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, digest of the set, and packed registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingle_sets(batch.column("text"))
            raw, rows = values.tobytes(), iter(registers(values, offsets))
            digest, packed = zip(*[(_digest(raw[8 * a : 8 * b]), next(rows).tobytes()) if b > a else (None, None) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(np.diff(offsets), pa.int64()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "tag", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag")).mapInArrow(run, "doc_id long, tag long, n_shingles long, digest binary, registers binary")


def _digest(packed_set: bytes) -> bytes:
    return hashlib.blake2b(packed_set, digest_size=16).digest()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its full set as packed sorted hashes, for ``wanted`` (doc_id, digest, node).

    A repeated doc_id brings texts of other sets; the digest tells them apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingle_sets(batch.column("text"))
            raw = values.tobytes()
            items = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            own = pa.array([_digest(x) == d for x, d in zip(items, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(items, pa.binary())], names=["node", "items"]).filter(own)

    return texts.select("node", "digest", "text").mapInArrow(run, "node long, items binary")


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
        sizes = [batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
        keep = likely_similarity(*regs, *sizes) >= PERCENT / 100 - SLACK
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _plausible_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    of = lambda side: reps.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"regs_{side}"))
    sized = pairs.hint("merge").join(of("a"), "a").join(of("b"), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return sized.mapInArrow(_plausible, "a long, b long")


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, linked = [], []
        for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both.append(len(np.intersect1d(x, y, assume_unique=True)))
            linked.append(100 * both[-1] >= PERCENT * (len(x) + len(y) - both[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, linked): how many shingles the full sets of each pair share, and whether that links them."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}"))
    return pairs.hint("merge").join(of("b"), "b").join(of("a").hint("merge"), "a").mapInArrow(_intersected, "a long, b long, both long, linked boolean")


def _sharable(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """node, n_shingles, registers and ``lone``: shingles that no other node of ``sets`` has.

    Nodes with so many of them that they can link with nobody are left out. Shingles are counted by short hashes, which may take a lone one for
    a shared one but never the reverse.
    """
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column("items")]
            if not items:
                continue
            sizes = [len(x) for x in items]
            keys, nodes = np.concatenate(items), np.repeat(batch.column("node").to_numpy(), sizes)
            bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            yield postings.batch(postings.rows(bucket, nodes, np.zeros(len(nodes), dtype=np.int64), [(keys & np.uint64(0xFFFFFFFF), 4)]), ([], []))

    def alone(nodes: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        order, begin = postings.groups(keys[0])
        return postings.spread(np.diff(np.r_[begin, len(order)]) == 1, order, begin)

    lone = postings.counted(sets.mapInArrow(run, postings.SCHEMA), buckets, [4], alone).groupBy(F.col("doc_id").alias("node")).agg(F.sum("n").alias("lone"))
    found = reps.join(sets.select("node").distinct(), "node", "left_semi").join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    return found.select("node", "n_shingles", "registers", "lone").where(100 * (F.col("n_shingles") - F.col("lone")) >= PERCENT * F.col("n_shingles"))


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (band, node, ...) with their component, of the buckets that the labels leave in several components."""
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return placed.join(mixed, "band")


def _with_centers(rest: DataFrame, sharable: DataFrame) -> DataFrame:
    """(band, node, center): nodes of mixed buckets that may link at all, and their bucket's node with the fewest lone shingles."""
    able = rest.select("band", "node").join(sharable.select("node", "lone"), "node")
    centers = able.groupBy("band").agg(F.min(F.struct("lone", "node")).alias("c")).select("band", F.col("c.node").alias("center"))
    return able.join(centers, "band").select("band", "node", "center")


def _across(apart: DataFrame) -> DataFrame:
    """(a, b) of nodes in different components of a bucket that can reach the threshold, in one bucket of all that they share.

    Two sets share at most the lesser number that either shares with the center, and the lesser
    number of those not of the center that any other node has.
    """
    facts = ("component", "n_shingles", "core", "loose", "bands")
    side = lambda n: apart.select("band", F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in facts])
    common = F.least("core_a", "core_b") + F.least("loose_a", "loose_b")
    possible = 100 * common >= PERCENT * (F.col("n_shingles_a") + F.col("n_shingles_b") - common)
    once = F.col("x.band") == F.array_min(F.array_intersect("bands_a", "bands_b"))
    pairs = side("a").alias("x").join(side("b").alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & possible & once)
    return pairs.select("a", "b")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the row's text), n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(sketch(docs), "sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("r")).select("digest", "r.*")
    # Nodes are numbered in the order of their ids, so that a component's least node has its least id.
    reps = staged(first.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("node", F.monotonically_increasing_id()), "sketch-classes")
    inside = reps.select("node", F.explode(F.expr(_BANDS)).alias("band"))
    pivots = inside.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("band", "a")
    members = staged(inside.join(pivots, "band"), "bucket-members")
    release(spark)

    stars = staged(_plausible_pairs(members.where("node > a").select("a", F.col("node").alias("b")).distinct(), reps), "star-pairs")
    wanted = reps.select("doc_id", "digest", "node").join(members.select("node").distinct(), "node", "left_semi")
    sets = staged(_sets(docs, wanted), "shingle-sets")
    links = staged(_compared(stars, sets).where("linked").select("a", "b"), "links")
    release(spark)
    labels = staged(connected_components(links, "a", "b"), "labels")

    rest = staged(_placed(members, labels).select("band", "node"), "mixed-buckets")
    sharable = staged(_sharable(sets.join(rest.select("node").distinct(), "node", "left_semi"), reps), "sharable")
    held = staged(_with_centers(rest, sharable), "held")
    shared = staged(_compared(held.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), sets), "center-pairs")
    release(spark)
    links, labels = _joined(links, labels, shared)

    apart = _placed(held, labels).join(shared.select(F.col("a").alias("center"), F.col("b").alias("node"), "both"), ["center", "node"], "left").join(sharable, "node")
    core = F.coalesce("both", "n_shingles")  # the center shares all of its own
    apart = staged(apart.select("band", "node", "component", "n_shingles", core.alias("core"), F.greatest(F.col("n_shingles") - core - F.col("lone"), F.lit(0)).alias("loose"), F.expr(_BANDS).alias("bands")), "apart")
    cross = staged(_across(apart), "cross-pairs")
    more = staged(_compared(cross, sets), "compared")
    release(spark)
    links, labels = _joined(links, labels, more)

    names = labels.join(reps.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id")), "component").select("node", "component_id")
    of_class = reps.select("digest", "doc_id", "node").join(names, "node", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = staged(of_class, "class-components")  # a table of its own, so that a hot digest can be split
    facts = ["doc_id", "tag", "n_shingles"]
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select(*facts, F.col("doc_id").alias("component_id"))
    linked = full.select(*facts, "digest").join(of_class, "digest").select(*facts, "component_id")
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = staged(out, "near-classes")
    discard(rows, reps, members, stars, sets, links, labels, rest, sharable, held, shared, apart, cross, more, of_class)
    return out


def _joined(links: DataFrame, labels: DataFrame, compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with those of ``compared``, and labels anew if there are any."""
    new = compared.where("linked").select("a", "b")
    if new.isEmpty():
        return links, labels
    both = staged(links.unionByName(new), "links")
    out = staged(connected_components(both, "a", "b"), "labels")
    discard(links, labels)
    return both, out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and stand alone; a text of fewer than five
    words is one shingle; equal sets are linked. Rows that repeat a doc_id are judged each by
    its own text and give a row each; a null doc_id has a null component and is kept. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    return _classes(docs).drop("tag")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents, with one of each group of near copies: the one with the smallest doc_id.

    Each row is judged by its own text, so a repeated doc_id loses only rows that are copies;
    rows that repeat a kept one whole stay with it. Null ids, and null, empty and blank texts, stay. An empty
    table stays empty; all columns pass, whatever their names.
    """
    gone_id, gone_tag = fresh("gone_id", docs), fresh("gone_tag", docs)
    gone = _classes(docs).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag)).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_tag)), "left_anti")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_dup": op7_near_dup}
ORACLES: dict[str, str] = {}
