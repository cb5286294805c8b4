"""Phrase collocation mining by HAT-trie counting.

Every task counts sequences of word ids in a ``HatTrie``: hash containers below a shallow trie
of word ids. A container that grows too large bursts into one for each next word; when the trie
holds too much, whole subtrees leave it as sorted runs. A run goes to the prefix partition of
its first word, where all runs of the partition are merged and summed; what begins with one of
the few words that would fill a quarter of a partition is dealt by its first two words. So
everything that begins with the same two words meets in one place, and a sequence sends one
entry a run, however frequent it is.

A sequence is as frequent as its parts at most. So words are counted first, then pairs of
frequent words, then windows of three to MAX_WORDS words all of whose pairs are frequent. What
is frequent is told to the tasks by a bit map of fixed size, whatever the corpus: a bit that two
sequences share lets one through that the count then drops; none is lost.

Word ids are 64-bit hashes of a language and a word; ids of frequent words are checked to differ.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.tables import table
from ledgerline.llm.words import Words, mix, slices, text_buffers
from ledgerline.workdir import discard, release, staged

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Bits of the map of what is frequent, and of the pieces in which it is put together (8 MB in 8 kB).
MAP_BITS, PIECE_BITS = 26, 16
#: Entries that a task's trie holds before it spills, and entries at which a container bursts.
ENTRIES, BURST = 1 << 19, 1 << 13
#: Distinct words that a task counts before it hands them on.
WORDS_HELD = 1 << 19
_RUNS = "part int, payload binary"
_SEED = 0x51ED270B

#: A-Z in lower case, and what ends a piece as a line feed.
_TRANSLATE = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO = np.frombuffer(_TRANSLATE, dtype=np.uint8)


class _Node:
    """A hash container (``box``), or after its burst a trie node (``kids`` by the next word id)."""

    __slots__ = ("box", "kids", "size")

    def __init__(self) -> None:
        self.box: dict[bytes, int] = {}
        self.kids: dict[bytes, _Node] | None = None
        self.size = 0


class HatTrie:
    """Counts of sequences of ``width`` word ids (zeros pad shorter ones), by prefix partition."""

    def __init__(self, width: int, parts: int, hot: np.ndarray, limit: int = ENTRIES, burst: int = BURST) -> None:
        self.width, self.parts, self.hot, self.limit, self.burst = width, parts, hot, limit, burst
        self.roots: dict[int, _Node] = defaultdict(_Node)
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        """Count windows, a row each."""
        if not len(windows):
            return
        first = windows[:, 0]
        part = (np.where(np.isin(first, self.hot), pair_hash(first, windows[:, 1]), mix(first)) % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((*windows.T[::-1], part))
        windows, part = windows[order], part[order]
        edge = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)])
        counts = np.diff(np.r_[edge, len(windows)]).tolist()
        keys = _packed(windows[edge])
        part = part[edge]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
        for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
            self.size += self._put(self.roots[int(part[a])], 0, keys[a:b], counts[a:b])

    def _put(self, node: _Node, depth: int, keys: list[bytes], counts: list[int]) -> int:
        """Add sorted keys below a node; how many of them are new."""
        before = node.size
        if node.kids is None:
            box, get = node.box, node.box.get
            for key, n in zip(keys, counts, strict=True):
                box[key] = get(key, 0) + n
            node.size = len(box)
            if node.size > self.burst and depth < self.width - 1:
                self._burst(node, depth)
        else:
            at, a = 8 * depth, 0
            while a < len(keys):
                head = keys[a][: at + 8]
                b = bisect_left(keys, head + b"\xff" * (8 * self.width - at - 7), a)
                node.size += self._put(node.kids[head[at:]], depth + 1, keys[a:b], counts[a:b])
                a = b
        return node.size - before

    def _burst(self, node: _Node, depth: int) -> None:
        node.kids, at = defaultdict(_Node), 8 * depth
        for key, n in node.box.items():
            node.kids[key[at : at + 8]].box[key] = n
        for kid in node.kids.values():
            kid.size = len(kid.box)
        node.box = {}

    def spill(self, down_to: int) -> Iterator[tuple[int, bytes]]:
        """(prefix partition, sorted run) of whole subtrees, the largest first, until ``down_to`` entries are left."""
        for part in sorted(self.roots, key=lambda p: -self.roots[p].size):
            if self.size <= down_to:
                break
            node = self.roots.pop(part)
            self.size -= node.size
            entries = sorted(self._entries(node))
            keys = np.frombuffer(b"".join(k for k, _ in entries), dtype=">u8").astype(np.uint64).reshape(len(entries), -1)
            yield part, write_run(keys, np.fromiter((n for _, n in entries), dtype=np.int64, count=len(entries)))

    def _entries(self, node: _Node) -> Iterator[tuple[bytes, int]]:
        yield from node.box.items()
        for kid in (node.kids or {}).values():
            yield from self._entries(kid)


def _packed(sequences: np.ndarray) -> list[bytes]:
    """Rows of ids as bytes that sort like them."""
    return np.ascontiguousarray(sequences.astype(">u8")).view(f"V{8 * sequences.shape[1]}").ravel().tolist()


def write_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted windows and their counts: the ids that occur, and planes of bytes of places among them, which compress."""
    ids, at = np.unique(keys, return_inverse=True)
    columns = np.column_stack([at.reshape(keys.shape), counts]).astype(np.int64)
    columns[1:, 0] -= columns[:-1, 0].copy()
    planes = columns.astype("<i8").view(np.uint8).reshape(len(keys), -1).T
    return np.array([len(ids), len(keys)], dtype="<i8").tobytes() + ids.astype("<u8").tobytes() + planes.tobytes()


def read_run(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows and counts of a run."""
    n_ids, n = np.frombuffer(payload, dtype="<i8", count=2).tolist()
    ids = np.frombuffer(payload, dtype="<u8", offset=16, count=n_ids)
    planes = np.frombuffer(payload, dtype=np.uint8, offset=16 + 8 * n_ids).reshape(-1, n)
    columns = np.array(planes.T, order="C").view("<i8")
    columns[:, 0] = np.cumsum(columns[:, 0])
    return ids[columns[:, :-1]], columns[:, -1]


def merged(runs: list[tuple[np.ndarray, np.ndarray]], least: int, min_count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, sequences, counts) of what ``min_count`` windows begin with, of ``least`` words and more."""
    keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs])
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    for m in range(least, keys.shape[1] + 1):
        long = keys[:, m - 1] != 0
        own, n = keys[long, :m], counts[long]
        if not len(own):
            return
        edge = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
        total = np.add.reduceat(n, edge)
        often = total >= min_count
        yield m, own[edge[often]], total[often]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b))


def _lang_keys(langs: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest("und" if x is None else x, _SEED) for x in langs.to_pylist()), dtype=np.uint64, count=len(langs))


def _ids(hashes: np.ndarray, lang_keys: np.ndarray) -> np.ndarray:
    ids = mix(hashes ^ lang_keys)
    ids[ids == 0] = 1
    return ids


def _read(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a slice, and whether each goes on in the piece of the one before it."""
    data, offsets = text_buffers(batch.column("text"))
    words = Words.of_bytes(_TO[data], offsets)
    docs = words.doc()
    ids = _ids(words.hashes(seed=seed), _lang_keys(batch.column("lang"))[docs])
    ends = np.cumsum(words.data == 10, dtype=np.int64)
    piece = ends[words.starts] if len(ids) else np.empty(0, np.int64)
    joined = np.zeros(len(ids), dtype=bool)
    joined[1:] = (piece[1:] == piece[:-1]) & (docs[1:] == docs[:-1])
    return ids, joined


def _pairs(ids: np.ndarray, joined: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Pairs of words that are frequent by themselves."""
    often = _in_map(ids, bits)
    at = np.flatnonzero(often[:-1] & often[1:] & joined[1:])
    return np.stack([ids[at], ids[at + 1]], axis=1)


def _windows(ids: np.ndarray, joined: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The longest window of three to MAX_WORDS words that begins at each word and has frequent pairs only."""
    n = len(ids)
    linked = np.zeros(n + MAX_WORDS, dtype=bool)
    linked[: max(n - 1, 0)] = _in_map(pair_hash(ids[:-1], ids[1:]), bits) & joined[1:]
    at = np.flatnonzero(linked[:n] & linked[1 : n + 1])
    goes_on, columns = np.ones(len(at), dtype=bool), [ids[at], ids[at + 1], ids[at + 2]]
    for k in range(3, MAX_WORDS):
        goes_on = goes_on & linked[at + k - 1]
        columns.append(np.where(goes_on, ids[np.minimum(at + k, n - 1)], np.uint64(0)))
    return np.stack(columns, axis=1)


def _in_map(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _bit_map(keys: DataFrame, words: int):
    """Broadcast map of the sequences of ``keys`` (key binary, of one or two word ids); 2^MAP_BITS bits, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, key in zip(batch.column("piece").to_pylist(), batch.column("at").to_numpy(), strict=True):
                bits = held.setdefault(part, np.zeros(1 << (PIECE_BITS - 3), dtype=np.uint8))
                bits[(key & ((1 << PIECE_BITS) - 1)) >> 3] |= np.uint8(1 << (key & 7))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["piece", "bits"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words)
            at = np.unique((ids[:, 0] if words == 1 else pair_hash(ids[:, 0], ids[:, 1])) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> PIECE_BITS).astype(np.int32)), pa.array(at)], names=["piece", "at"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = keys.select("key").mapInArrow(place, "piece int, at long").repartition(parts, "piece").mapInArrow(run, "piece int, bits binary")
    whole = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    size = 1 << (PIECE_BITS - 3)
    for row in pieces.toLocalIterator():  # 2^(MAP_BITS - PIECE_BITS) rows at most
        whole[row["piece"] * size : (row["piece"] + 1) * size] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def word_counts(docs: DataFrame, limit: int = WORDS_HELD) -> DataFrame:
    """(lang, word, f): occurrences of every word in every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    held["und" if lang is None else lang].update(text.encode().translate(_TRANSLATE).split())
            if sum(map(len, held.values())) > limit:
                yield from out()
        yield from out()

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _with_ids(words: DataFrame, seed: int) -> DataFrame:
    """Words with ``key``, their id in eight bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = Words.of(batch.column("word"))
                ids = _ids(own.hashes(seed=seed), _lang_keys(batch.column("lang")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_packed(ids[:, None]), pa.binary())], names=["lang", "word", "f", "key"])

    return words.mapInArrow(run, "lang string, word string, f long, key binary")


def sequences(docs: DataFrame, read: Callable, bits, hot: np.ndarray, seed: int, width: int, least: int, min_count: int = MIN_COUNT, limit: int = ENTRIES) -> DataFrame:
    """(key, len, f): sequences of ``least`` to ``width`` words that begin ``min_count`` of the windows that ``read`` picks."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(width, parts, hot, limit)

        def runs(down_to: int) -> Iterator[pa.RecordBatch]:
            for part, payload in trie.spill(down_to):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([payload], pa.binary())], names=["part", "payload"])

        for batch in slices(batches):
            ids, joined = _read(batch, seed)
            if len(ids):
                trie.add(read(ids, joined, bits.value))
            if trie.size > limit:
                yield from runs(limit // 2)
        yield from runs(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for m, keys, total in merged(held, least, min_count):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(keys), pa.binary()), pa.array([m] * len(keys), pa.int32()), pa.array(total, pa.int64())], names=["key", "len", "f"])
            held.clear()

        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                if part != now and held:
                    yield from out()
                now = part
                held.append(read_run(payload.as_buffer()))
        if held:
            yield from out()

    found = docs.select("lang", "text").mapInArrow(count, _RUNS)
    return found.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(merge, "key binary, len int, f long")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, limit: int = ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to MAX_WORDS words.

    A null language is ``und``; null and empty texts have no words; repeated rows count each;
    words may be of any length; an empty table gives no rows; other columns are ignored,
    whatever their names. Ties of scores go by ``a``, then by the phrase in UTF-8 order. A
    phrase goes if a longer one holds it and is as frequent: one word more is enough to look
    at, as counts only fall from there. ``limit`` is what a task counts before it spills.
    """
    spark, docs = docs.sparkSession, docs.select("lang", "text")
    counted = staged(word_counts(docs, limit), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    for seed in (0, 1):
        words = staged(_with_ids(counted.where(F.col("f") >= min_count), seed), "frequent-words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        discard(words)
    else:
        raise ValueError("two frequent words share their ids under both seeds")
    share = F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = words.join(totals.agg(F.sum("n").alias("all")).hint("broadcast"), F.col("f") * share >= F.col("all"))  # as many words as ``share`` at most
    hot = np.frombuffer(b"".join(r["key"] for r in often.select("key").toLocalIterator()), dtype=">u8").astype(np.uint64)
    pairs = staged(sequences(docs, _pairs, _bit_map(words, 1), hot, seed, 2, 2, min_count, limit), "frequent-pairs")
    release(spark)
    longer = staged(sequences(docs, _windows, _bit_map(pairs, 2), hot, seed, MAX_WORDS, 3, min_count, limit), "frequent-phrases")
    release(spark)

    phrases = pairs.unionByName(longer)
    shorter = [longer.select(F.expr(f"substring(key, {at}, 8 * len - 8)").alias("key"), "f") for at in (1, 9)]
    held = shorter[0].unionByName(shorter[1]).distinct()
    kept = phrases.join(held, ["key", "f"], "left_anti")
    parts = words.select("key", "f").unionByName(phrases.select("key", "f"))
    cuts = kept.select("key", "len", F.col("f").alias("a"), F.explode(F.expr("sequence(1, len - 1)")).alias("k"))
    cuts = cuts.select("*", F.expr("substring(key, 1, 8 * k)").alias("left"), F.expr("substring(key, 8 * k + 1, 8 * (len - k))").alias("right"))
    sized = cuts.join(parts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    langs = words.join(totals, "lang").select(F.col("key").alias("first"), "lang", "n")
    scored = sized.withColumn("first", F.expr("substring(key, 1, 8)")).join(langs, "first")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    product = (whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    scored = scored.withColumn("num", product).withColumn("den", (whole("l") * whole("r")).cast("decimal(38,0)")).withColumn("score", F.expr("num div den"))
    best = scored.groupBy("key", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spelt = kept.select("key", F.posexplode(F.expr("transform(sequence(0, len - 1), i -> substring(key, 8 * i + 1, 8))")).alias("at", "own"))
    spelt = spelt.join(words.select(F.col("key").alias("own"), "word"), "own")
    spelt = spelt.groupBy("key").agg(F.expr("array_join(transform(array_sort(collect_list(struct(at, word))), x -> x.word), ' ')").alias("phrase"))
    rows = best.join(spelt, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank").where(F.col("rank") <= top)
    out = staged(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counted, words, pairs, longer)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, ws[i : i + m - 1] AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) t(m))),
f AS (SELECT lang, m, ph, count(*) AS f FROM g GROUP BY lang, m, ph HAVING count(*) >= 100 OR m = 1),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
held AS (SELECT lang, ph[1 : m - 1] AS ph, f FROM f WHERE m > 2 UNION SELECT lang, ph[2 : m], f FROM f WHERE m > 2),
c AS (SELECT f.lang, f.m, f.ph, f.f AS a FROM f ANTI JOIN held USING (lang, ph, f) WHERE f.m > 1),
cut AS (SELECT c.*, k, ph[1 : k] AS lp, ph[k + 1 : m] AS rp FROM c, range(1, 5) t(k) WHERE k < m),
s AS (SELECT cut.lang, cut.ph, cut.a, k, x.f AS l, y.f AS r, n.n, (1000 * CAST(cut.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.ph = lp JOIN f y ON y.lang = cut.lang AND y.ph = rp JOIN n ON n.lang = cut.lang
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.ph ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM s)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o QUALIFY rank <= 2000
""",
}
