"""Substring dedup with fixed-block anchors.

Every document indexes its non-overlapping blocks of BLOCK words and is probed with every
rolling window of BLOCK words. As a window of WIDTH = 2 * BLOCK - 1 words holds a whole block
of any document it occurs in, each repeat of WIDTH words has a hit. Hits are extended: the
WIDTH-word windows around them are compared by 96-bit hashes with those around the blocks
that they hit (at 10^13 windows two different ones agree anywhere with probability 0.001), and the windows that also begin in a smaller doc_id are joined to maximal
repeats. Copies of whole texts are settled by a digest before that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import postings
from ledgerline.llm.tables import fresh, table
from ledgerline.llm.words import Words, slices, spans
from ledgerline.workdir import discard, release, staged

WIDTH = 13
BLOCK = (WIDTH + 1) // 2
#: Bytes of a block's hash that an entry carries beside its bucket, the lowest bit marking indexed blocks: hits may be false, extension is exact.
_ANCHOR_BYTES = 4


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Entries of every rolling window, with a mark at those that are indexed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            words = Words.of(batch.column("text"))
            key, at = words.grams(words.hashes(), BLOCK)
            if not len(key):
                continue
            owner = words.doc()[at]
            place, doc = at - words.first[owner], batch.column("doc_id").to_numpy()[owner]
            block = place % BLOCK == 0
            order, begin = postings.groups(key)
            several = np.minimum.reduceat(doc[order], begin) < np.maximum.reduceat(doc[order], begin)
            near = postings.spread(several, order, begin)
            indexed = postings.spread(np.logical_or.reduceat(block[order], begin), order, begin)
            first = np.zeros(len(key), dtype=bool)
            first[order[begin]] = True
            send = np.flatnonzero(first | ~near)
            packed = postings.rows(_bucket(key[send], buckets), doc[send], place[send], [((key[send] & np.uint64(0xFFFFFFFE)) | indexed[send].astype(np.uint64), _ANCHOR_BYTES)])
            yield postings.batch(packed, postings.settled_rows(doc[near], place[near], buckets))

    return docs.select("doc_id", "text").mapInArrow(run, postings.SCHEMA)


def _hits(docs: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Entries whose key an indexed block of another place has."""
    order, begin = postings.groups(keys[0] >> np.uint64(1))
    size = np.diff(np.r_[begin, len(order)])
    good = (size > 1) & np.logical_or.reduceat(keys[0][order] & np.uint64(1) > 0, begin)
    return postings.spread(good, order, begin)


def extensions(docs: DataFrame, buckets: int) -> DataFrame:
    """Entries of the WIDTH-word windows that hold a hit, each with its row's tag; those a slice can decide are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words.of(batch.column("text"))
            counts, ids, tags = words.counts(), batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            chosen = np.zeros(len(words.starts), dtype=bool)
            for i, payloads in enumerate(batch.column("hits").to_pylist()):
                hit = postings.positions_of(payloads)
                starts = (hit[:, None] - np.arange(BLOCK)).ravel()
                starts = starts[(starts >= 0) & (starts <= counts[i] - WIDTH)]
                chosen[words.first[i] + starts] = True
            if not chosen.any():
                continue
            one, at = words.grams(words.hashes(), WIDTH)
            two, _ = words.grams(words.hashes(seed=1), WIDTH, seed=1)
            take = chosen[at]
            one, two, at = one[take], two[take], at[take]
            owner = words.doc()[at]
            place, doc, tag = at - words.first[owner], ids[owner], tags[owner].astype(np.uint64)
            order, begin = postings.groups(one, two)
            least = postings.spread(np.minimum.reduceat(doc[order], begin), order, begin)
            later = least < doc
            part = np.flatnonzero(~later)  # each window goes on with its smallest document here
            packed = postings.rows(_bucket(one[part], buckets), doc[part], place[part], [(one[part], 8), (two[part] & np.uint64(0xFFFFFFFF), 4), (tag[part], 4)])
            yield postings.batch(packed, postings.settled_rows(doc[later], place[later], buckets, [(tag[later], 4)]))

    return docs.mapInArrow(run, postings.SCHEMA)


def _later(docs: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Entries whose window also begins in a smaller document."""
    order, begin = postings.groups(*keys)
    return postings.spread(np.minimum.reduceat(docs[order], begin), order, begin) < docs


def row_tag(docs: DataFrame) -> Column:
    """32 bits of a hash of the text, which tell rows of one doc_id apart; 0 for all where no doc_id repeats, as it then costs no bytes."""
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return F.lit(0).cast("long")
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def tagged(docs: DataFrame, tag: Column) -> DataFrame:
    """(doc_id, text, tag) of all rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag.alias("tag"))


def copies(texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, copy_tags): tags of the rows of ``texts`` whose whole text of ``least`` bytes or more a smaller doc_id has."""
    marked = texts.where(f"doc_id IS NOT NULL AND octet_length(text) >= {least}").select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    first = staged(first, "first-copies")  # a table of its own, so that a hot digest can be split
    out = staged(marked.join(first, "digest").where("doc_id > first_id").groupBy("doc_id").agg(F.collect_set("tag").alias("copy_tags")), "copies")
    discard(first)
    return out


def uncopied(texts: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of ``texts`` that are no copies."""
    return texts.join(again, "doc_id", "left").where("copy_tags IS NULL OR NOT array_contains(copy_tags, tag)").drop("copy_tags")


def marked(docs: DataFrame, value: Column, covers: DataFrame, again: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with the columns ``names``: the row's tag (``value``), whether it is a copy, and the covers of its doc_id."""
    tag, copy, cover = names
    key = fresh("doc_key", docs)
    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), tag: value})
    joined = keyed.join(covers.select(F.col("doc_id").alias(key), F.col("covers").alias(cover)), key, "left").join(again.select(F.col("doc_id").alias(key), F.col("copy_tags").alias(copy)), key, "left")
    return joined.withColumn(copy, F.coalesce(F.array_contains(copy, F.col(tag)), F.lit(False))).drop(key)


def covered(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with the columns ``names``: tag, copy (bool) and packed (first word, tag) of the windows to remove.

    Nothing is settled for a null doc_id.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = row_tag(docs)
    texts = tagged(docs, tag)
    again = copies(texts, 2 * WIDTH - 1)
    hits = staged(postings.settle(anchors(texts, buckets), buckets, [_ANCHOR_BYTES], _hits), "anchor-hits")
    release(spark)
    hit = uncopied(texts.join(postings.gathered(hits, buckets, "hits"), "doc_id"), again)
    covers = staged(postings.settle(extensions(hit, buckets), buckets, [8, 4, 4], _later, carry=1), "covered-windows")
    discard(hits)
    release(spark)
    return marked(docs, tag, postings.gathered(covers, buckets, "covers", [4]), again, names)


def _kept(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of kept words, each followed by a space, and n_docs + 1 offsets of the documents."""
    starts, lengths = words.starts[keep], (words.ends - words.starts)[keep] + 1
    begin = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), dtype=np.uint8)
    for a in range(0, len(starts), 1 << 17):
        n = lengths[a : a + (1 << 17)]
        if not len(n):
            break
        at = begin[a]
        index = np.repeat(starts[a : a + len(n)] - (begin[a : a + len(n)] - at), n) + np.arange(int(n.sum()))
        out[at : at + len(index)] = words.data[np.minimum(index, len(words.data) - 1)]
    if len(starts):
        out[begin + lengths - 1] = 32
    kept_before = np.r_[0, np.cumsum(keep)][words.first]
    return out, np.r_[begin, len(out)][kept_before]


def _apply(docs: DataFrame, schema: T.StructType | str, measure) -> DataFrame:
    """``measure(batch, words, keep)`` of each slice of ``docs``, ``keep`` marking the words that stay."""
    names = tuple(fresh(n, docs) for n in ("tag", "copy", "covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words.of(batch.column("text"))
            keep = np.ones(len(words.starts), dtype=bool)
            for i, (tag, copy, payloads) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                a, b = words.first[i], words.first[i + 1]
                if copy:
                    keep[a:b] = b - a < WIDTH
                elif payloads:
                    starts, tags = np.frombuffer(payloads, dtype="<u4").astype(np.int64).reshape(-1, 2).T
                    keep[a:b] = ~spans(starts[(tags == tag) & (starts <= b - a - WIDTH)], WIDTH, b - a)
            yield measure(batch, words, keep)

    return covered(docs, names).mapInArrow(run, schema)


def _report(batch: pa.RecordBatch, words: Words, keep: np.ndarray) -> pa.RecordBatch:
    n = words.counts()
    left = np.diff(np.r_[0, np.cumsum(keep)][words.first])
    out, edge = _kept(words, keep)
    raw = out.tobytes()
    digests = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text).

    Null and empty texts have no words; texts of fewer than WIDTH words lose none; repeats
    inside one document stay; a null doc_id loses nothing. Rows that repeat a doc_id are
    judged each by its own text, against documents with a smaller doc_id only. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    return _apply(docs.select("doc_id", "text"), "doc_id long, n_words long, n_removed long, kept_sha256 string", _report)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut from their texts.

    A text that loses nothing is unchanged; otherwise its kept words are joined by one space.
    Documents that lose all their words go. ``n_chars`` follows the new text, where there is such a
    column of whole numbers. Null and repeated ids, and null, empty and long texts, are as in ``report``; all
    columns pass, whatever their names; an empty table stays empty.
    """
    columns = docs.columns

    def measure(batch: pa.RecordBatch, words: Words, keep: np.ndarray) -> pa.RecordBatch:
        changed = np.diff(np.r_[0, np.cumsum(~keep)][words.first]) > 0
        batch = batch.select(columns)
        if not changed.any():
            return batch
        out, edge = _kept(words, keep)
        raw = out.tobytes()
        old = batch.column("text").to_pylist()
        texts = [raw[a : max(a, b - 1)].decode("utf-8") if c else o for a, b, c, o in zip(edge[:-1], edge[1:], changed.tolist(), old, strict=True)]
        new = {"text": pa.array(texts, batch.column("text").type)}
        if "n_chars" in columns and pa.types.is_integer(batch.column("n_chars").type):
            new["n_chars"] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed.tolist(), batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
        stays = pa.array([not c or t != "" for t, c in zip(texts, changed.tolist(), strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns).filter(stays)

    return _apply(docs, docs.schema, measure)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 13 words over all documents."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
