"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of WIDTH;
``k`` cells of one label make a bucket key, and every vector lies in a bucket of each table. At
the threshold two vectors share a cell with a known probability, so ``plan`` gives the cells
and tables that miss such a pair with MISS at most. Candidates are settled by exact cosines.

No bucket's pairs are written out:

1. equal vectors are one node with a weight;
2. every node of a bucket is held against the bucket's pivot; a node joins the family of the
   pivot whose neighbours are closest on the whole, if its exact cosine links them;
3. two families that share a bucket meet once, and only where the angle between their pivots
   leaves room for a link (members lie within the family's radius of the pivot). Sketches of a
   byte a component decide this; they err on the safe side;
4. families that meet, and each family with itself, are compared by blocks of BLOCK members. A
   block gives each member its number of links and one link of the two families. Members within
   half the threshold's angle of their pivot (the core) are all linked with each other, so a
   large group of copies is counted without comparing it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.graph import connected_components
from ledgerline.llm.tables import table
from ledgerline.llm.words import mix
from ledgerline.workdir import discard, release, staged

COSINE, MISS, WIDTH = 0.93, 1e-3, 2.0
#: Members of a family, or families of a bucket, that one block holds of each side.
BLOCK = 2048
#: Margin, in radians, of what angles decide without a comparison.
_MARGIN = 1e-6
_SEED = 20240611
_THETA = math.acos(COSINE)
#: Bucket rows that leave a task in one batch, and pairs that are multiplied at once.
_ROWS, _PAIRS = 1 << 17, 1 << 15


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at a distance share a cell of one Gaussian projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(cells a key, tables) for ``n`` vectors of a label: about one unrelated vector a bucket, a pair at ``cosine`` missed with ``miss``."""
    near, far = same_cell(math.sqrt(2 - 2 * cosine)), same_cell(math.sqrt(2))
    k = max(6, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of packed vectors of one length."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Places of the vectors of each length."""
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


class Projections:
    """Cells of ``tables`` keys of ``k`` projections, for vectors of any length."""

    def __init__(self, k: int, tables: int) -> None:
        self.k, self.tables, self.made = k, tables, {}

    def _of(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        if dims not in self.made:
            rng = np.random.Generator(np.random.PCG64([_SEED, dims]))
            self.made[dims] = rng.standard_normal((dims, self.tables * self.k)), rng.uniform(0, WIDTH, self.tables * self.k)
        return self.made[dims]

    def keys(self, unit: np.ndarray, labels: list[str]) -> np.ndarray:
        """A row of ``tables`` keys for each vector; the label, the length and the table are part of a key."""
        at, shift = self._of(unit.shape[1])
        cells = np.floor((unit @ at + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.k)
        own = np.fromiter((int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in labels), dtype=np.uint64, count=len(labels))
        key = mix(own[:, None] + np.uint64(unit.shape[1] << 32) + np.arange(self.tables, dtype=np.uint64))
        for i in range(self.k):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return key.view(np.int64)


def sketches(unit: np.ndarray) -> list[bytes]:
    """A scale and a signed byte for each component."""
    scale = (np.abs(unit).max(axis=1) / 127).astype("<f4")
    whole = np.rint(unit / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    return [s.tobytes() + q.tobytes() for s, q in zip(scale, whole, strict=True)]


def read_sketches(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Approximate vectors, and how far each may be from its own."""
    both = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
    scale = np.ascontiguousarray(both[:, :4]).view("<f4")
    return both[:, 4:].view(np.int8).astype(np.float32) * scale, scale[:, 0] * 0.51 * math.sqrt(both.shape[1] - 4) + 1e-5


def _kind(df: DataFrame) -> str:
    return "<f4" if dict(df.dtypes)["embedding"] == "array<float>" else "<f8"


def read_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, digest, vector) of every row; no digest where a vector can be linked with nothing."""
    kind = _kind(df)
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for ident, label, x in zip(batch.column("vec_id"), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                own = x.values
                digest = vector = None
                if ident.is_valid and label is not None and own is not None and len(own) and not own.null_count:
                    values = own.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # -0 is 0
                    if np.isfinite(values).all() and values.any():
                        vector = values.astype(kind).tobytes()
                        digest = hashlib.blake2b(label.encode() + b"\0" + vector, digest_size=16).digest()
                digests.append(digest)
                vectors.append(vector)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "digest", "vector"])

    return kept.mapInArrow(run, "vec_id long, label string, digest binary, vector binary")


def _bucketed(nodes: DataFrame, kind: str, k: int, tables: int) -> DataFrame:
    """(key, node, sketch): every node in a bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Projections(k, tables)
        step = max(1, _ROWS // tables)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                raw, labels, ids = part.column("vector").to_pylist(), part.column("label").to_pylist(), part.column("node").to_numpy()
                for at in by_length(raw):
                    unit = units([raw[i] for i in at], kind)
                    keys = made.keys(unit, [labels[i] for i in at])
                    sketch = [s for s in sketches(unit) for _ in range(tables)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at], tables)), pa.array(sketch, pa.binary())], names=["key", "node", "sketch"])

    return nodes.select("node", "label", "vector").mapInArrow(run, "key long, node long, sketch binary")


def _sketched(nodes: DataFrame, kind: str) -> DataFrame:
    """(node, sketch) of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids = batch.column("vector").to_pylist(), batch.column("node").to_numpy()
            for at in by_length(raw):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sketches(units([raw[i] for i in at], kind)), pa.binary())], names=["node", "sketch"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, sketch binary")


def _close_to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pivot, cosine) where the sketches may reach the threshold."""
    for batch in batches:
        for a in range(0, batch.num_rows, _PAIRS):
            part = batch.slice(a, _PAIRS)
            raw, of_pivot = part.column("sketch").to_pylist(), part.column("of_pivot").to_pylist()
            cosine, reach = np.empty(len(raw)), np.empty(len(raw))
            for at in by_length(raw):
                (x, x_off), (y, y_off) = read_sketches([raw[i] for i in at]), read_sketches([of_pivot[i] for i in at])
                cosine[at], reach[at] = (x * y).sum(axis=1), x_off + y_off
            keep = pa.array(cosine + reach >= COSINE)
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("pivot"), pa.array(cosine)], names=["node", "pivot", "cosine"]).filter(keep)


def _exact(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, other = batch.column("vector").to_pylist(), batch.column("of_pivot").to_pylist()
            cosine = np.empty(len(raw))
            for at in by_length(raw):
                cosine[at] = (units([raw[i] for i in at], kind) * units([other[i] for i in at], kind)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"), pa.array(cosine)], names=["node", "pivot", "cosine"])

    return run


def _families(nodes: DataFrame, buckets: DataFrame, kind: str) -> DataFrame:
    """(node, family, angle): the pivot that a node is linked with and its angle to it; a node without one is its own."""
    pivots = buckets.groupBy("key").agg(F.min(F.struct("node", "sketch")).alias("p"), F.count("*").alias("n")).where("n > 1")
    met = buckets.join(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.sketch").alias("of_pivot")), "key").where("node <> pivot")
    close = met.select("node", "sketch", "pivot", "of_pivot").mapInArrow(_close_to_pivot, "node long, pivot long, cosine double")
    close = staged(close.groupBy("node", "pivot").agg(F.max("cosine").alias("cosine")), "close-to-pivot")
    worth = close.groupBy("pivot").agg(F.sum("cosine").alias("worth"))
    # A pivot is closest to itself, so that it stays where its own family is the best.
    own = worth.select(F.col("pivot").alias("node"), "pivot", "worth")
    best = close.join(worth, "pivot").select("node", "pivot", "worth").unionByName(own).groupBy("node").agg(F.max(F.struct("worth", (-F.col("pivot")).alias("last"))).alias("b"))
    chosen = best.select("node", (-F.col("b.last")).alias("pivot")).where("node <> pivot")
    vectors = nodes.select("node", "vector")
    sized = chosen.join(vectors, "node").join(vectors.select(F.col("node").alias("pivot"), F.col("vector").alias("of_pivot")), "pivot")
    linked = sized.select("node", "pivot", "vector", "of_pivot").mapInArrow(_exact(kind), "node long, pivot long, cosine double").where(F.col("cosine") >= COSINE)
    out = nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("pivot", "node").alias("family"), F.when(F.col("pivot").isNull(), 0.0).otherwise(F.acos(F.least("cosine", F.lit(1.0)))).alias("angle"))
    out = staged(out, "families")
    discard(close)
    return out


def _in_blocks(rows: DataFrame, unit: list[str], run, schema: str) -> DataFrame:
    """``rows`` of each unit together, one unit after the other; a unit holds 2 BLOCK rows or so."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(run, schema)


def _whole_units(batches: Iterator[pa.RecordBatch], unit: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, and where each unit begins; a unit may be cut by the batches that bring it."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        columns = [t.column(c).to_numpy(zero_copy_only=False) for c in unit]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(c)[0] == held[-1].column(c)[-1] for c in unit):
            last = int(edges(batch)[1]) if len(edges(batch)) > 1 else batch.num_rows
            held.append(batch.slice(0, last))
            batch = batch.slice(last)
            if not batch.num_rows:
                continue
        if held:
            t = pa.Table.from_batches(held)
            yield t, edges(t)
        held = [batch]
        begin = int(edges(batch)[-1])  # the last unit may go on in the next batch
        if begin:
            t = pa.Table.from_batches([batch.slice(0, begin)])
            yield t, edges(t)
            held = [batch.slice(begin)]
    if held:
        t = pa.Table.from_batches(held)
        yield t, edges(t)


def _pairs_of(begin: np.ndarray, total: int, left: np.ndarray, right: np.ndarray, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of a left and a right row of each unit, a bounded number at a time; in units marked ``both``, i < j."""
    for a, b, same in zip(begin.tolist(), [*begin[1:].tolist(), total], both.tolist(), strict=True):
        x, y = np.flatnonzero(left[a:b]) + a, np.flatnonzero(right[a:b]) + a
        step = max(1, _PAIRS // max(1, len(y)))
        for c in range(0, len(x), step):
            i, j = np.repeat(x[c : c + step], len(y)), np.tile(y, len(x[c : c + step]))
            if same:
                up = i < j
                i, j = i[up], j[up]
            yield i, j


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of many small units together."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= _PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _near_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, g), f < g, of families of a bucket whose members may be linked."""
    for t, begin in _whole_units(batches, ["key", "i", "j"]):
        t = t.combine_chunks()
        family, radius = t.column("family").to_numpy(), t.column("radius").to_numpy()
        about, off = read_sketches(t.column("sketch").to_pylist())
        chunk, i, j = (t.column(c).to_numpy() for c in ("chunk", "i", "j"))
        for x, y in _gathered(_pairs_of(begin, len(family), chunk == i, chunk == j, (i == j)[begin])):
            room = np.cos(np.minimum(_THETA + radius[x] + radius[y] + _MARGIN, math.pi))
            near = (about[x] * about[y]).sum(axis=1) + off[x] + off[y] >= room
            f, g = np.minimum(family[x[near]], family[y[near]]), np.maximum(family[x[near]], family[y[near]])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(g)], names=["f", "g"])


def _linked_members(kind: str):
    """Links of each member of a block (node, n), and one link (node, other) of its two families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _whole_units(batches, ["f", "g", "i", "j"]):
            t = t.combine_chunks()
            node, weight, left = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "left"))
            unit = units(t.column("vector").to_pylist(), kind)
            same = ((t.column("f").to_numpy() == t.column("g").to_numpy()) & (t.column("i").to_numpy() == t.column("j").to_numpy()))[begin]
            right = ~left | np.repeat(same, np.diff(np.r_[begin, len(node)]))
            count, found = np.zeros(len(node), dtype=np.int64), []
            for x, y in _gathered(_pairs_of(begin, len(node), left, right, same)):
                linked = np.einsum("ij,ij->i", unit[x], unit[y]) >= COSINE
                x, y = x[linked], y[linked]
                np.add.at(count, x, weight[y])
                np.add.at(count, y, weight[x])
                _, first = np.unique(np.searchsorted(begin, x, "right"), return_index=True)
                found.append((node[x[first]], node[y[first]]))
            some = np.flatnonzero(count)
            a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            other = pa.array(np.r_[np.zeros(len(some), np.int64), b], mask=np.r_[np.ones(len(some), bool), np.zeros(len(b), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[some], a]), other, pa.array(np.r_[count[some], np.zeros(len(a), np.int64)])], names=["node", "other", "n"])

    return run


def _meeting(families: DataFrame, buckets: DataFrame, about: DataFrame) -> DataFrame:
    """(f, g), f < g, of families that share a bucket and may be linked."""
    sized = families.groupBy("family").agg(F.max("angle").alias("radius"))
    inside = buckets.join(families.select("node", "family"), "node").select("key", "family").distinct()
    shared = inside.groupBy("key").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / BLOCK).cast("int"))
    held = inside.join(shared.select("key", "chunks"), "key").withColumn("chunk", F.expr("CAST(pmod(xxhash64(family), chunks) AS INT)"))
    held = held.join(sized.join(about.select(F.col("node").alias("family"), "sketch"), "family"), "family").withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = held.select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "family", "radius", "sketch")
    return _in_blocks(rows, ["key", "i", "j"], _near_families, "f long, g long").distinct()


def _counted(nodes: DataFrame, families: DataFrame, meeting: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Members with the weight of their family's core, and what the blocks found."""
    members = nodes.select("node", "weight", "vector").join(families, "node").withColumn("core", F.col("angle") <= _THETA / 2 - _MARGIN)
    members = staged(members, "members")
    sizes = members.groupBy("family").agg(
        F.ceil(F.sum(F.col("core").cast("long")) / BLOCK).cast("int").alias("cores"), F.ceil(F.sum((~F.col("core")).cast("long")) / BLOCK).cast("int").alias("halos"),
        F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).alias("core_weight"), F.count("*").alias("size"),
    )
    sizes = staged(sizes, "family-sizes")
    chunk = F.expr("CAST(IF(core, pmod(xxhash64(node), cores), cores + pmod(xxhash64(node), halos)) AS INT)")
    placed = members.join(sizes.select("family", "cores", "halos"), "family").withColumn("chunk", chunk)
    themselves = sizes.where("halos > 0 AND size > 1").select(F.col("family").alias("f"), F.col("family").alias("g"))
    of = lambda c: sizes.select(F.col("family").alias(c), F.expr("cores + halos").alias(f"{c}_chunks"), F.col("cores").alias(f"{c}_cores"))
    work = meeting.select("f", "g").unionByName(themselves).join(of("f"), "f").join(of("g"), "g")
    work = work.withColumn("i", F.explode(F.expr("sequence(0, f_chunks - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, g_chunks - 1)")))
    # Within a family a pair of blocks meets once, and two of the core not at all.
    work = work.where("f <> g OR (i <= j AND (i >= f_cores OR j >= g_cores))").select("f", "g", "i", "j")
    one = placed.select("family", "chunk", "node", "weight", "vector")
    left = work.join(one.withColumnsRenamed({"family": "f", "chunk": "i"}), ["f", "i"]).withColumn("left", F.lit(True))
    right = work.where("f <> g OR i <> j").join(one.withColumnsRenamed({"family": "g", "chunk": "j"}), ["g", "j"]).withColumn("left", F.lit(False))
    rows = left.unionByName(right).select("f", "g", "i", "j", "left", "node", "weight", "vector")
    found = staged(_in_blocks(rows, ["f", "g", "i", "j"], _linked_members(kind), "node long, other long, n long"), "block-links")
    core = members.join(sizes.select("family", "core_weight"), "family").select("node", "family", "weight", F.expr("IF(core, core_weight - weight, 0)").alias("in_core"))
    return staged(core, "core-links"), found


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows are linked where their labels are equal and their cosine is COSINE or more; labels are
    compared as text, and vectors of different lengths are never linked. Rows without a vec_id
    or a label, and vectors that are null, empty, zero, or hold nulls or numbers that are not
    finite, are linked with nothing: no links, a component of their own, kept. Rows that repeat
    a vec_id are vectors of their own. Ties need no order; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    kind, spark = _kind(vectors), vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(read_vectors(vectors), "vectors")
    first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("vec_id", "label", "vector")).alias("r"), F.count("*").alias("weight")).select("digest", "weight", "r.*")
    # Nodes are numbered in the order of their ids, so that a component's least node has its least id.
    nodes = staged(first.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    most = nodes.groupBy("label", F.length("vector").alias("bytes")).count().agg(F.max("count")).first()[0]
    buckets = _bucketed(nodes, kind, *plan(most or 1))
    families = _families(nodes, buckets, kind)
    release(spark)
    meeting = staged(_meeting(families, buckets, _sketched(nodes, kind)), "meeting-families")
    release(spark)
    core, found = _counted(nodes, families, meeting, kind)
    release(spark)
    edges = families.where("node <> family").select("node", F.col("family").alias("other")).unionByName(found.where("other IS NOT NULL").select("node", "other"))
    labels = connected_components(edges, "node", "other")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("across"))
    of_node = core.join(counts, "node", "left").join(labels, "node", "left").select("node", (F.col("weight") - 1 + F.col("in_core") + F.coalesce("across", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    ids = nodes.select(F.col("node").alias("component"), F.col("vec_id").alias("component_id"))
    of_digest = staged(of_node.join(ids, "component").join(nodes.select("node", "digest"), "node").select("digest", "n_links", "component_id"), "vector-classes")  # a table of its own, so that a hot digest can be split
    linked = rows.where("digest IS NOT NULL").select("vec_id", "digest").join(of_digest, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = staged(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "embedding-classes")
    discard(rows, nodes, families, meeting, core, found, of_digest)
    return out


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_dedup": op11_embedding_dedup}
ORACLES = {
    "op11_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
}
