"""Suffix-array dedup with a run-length index.

Equal strings of WIDTH bytes choose the same minimizer (the least hash of their GRAM-byte
parts), so a first shuffle of minimizers finds the places that may repeat at all. Each run of
windows there that share a minimizer is one stretch of text; equal windows meet where the
minimizer sends them. There the distinct stretches are indexed: suffixes are sorted by prefix
doubling, the Burrows-Wheeler transform is kept as runs with the text position sampled at run
ends, and rows that share WIDTH bytes are one entry that knows its smallest document. Every
stretch is then streamed backwards through the runs (one LF step a byte, all stretches at
once); each step tells whether WIDTH bytes match from here, and in which smallest document.
All comparisons are of bytes, so matches are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import postings
from ledgerline.llm.substring_dedup import copies, marked, row_tag, tagged, uncopied
from ledgerline.llm.tables import table
from ledgerline.llm.words import mix, slices, text_buffers
from ledgerline.workdir import discard, release, staged

WIDTH, GRAM = 50, 24
_GRAMS = WIDTH - GRAM + 1
#: Bytes of a minimizer's hash that an entry carries beside its bucket.
_KEY_BYTES = 4
#: Bytes of text whose minimizers are found at once, and of stretches that are judged at once unless one minimizer has more.
_PIECE, _INDEX = 1 << 16, 3 << 20

_BYTE = np.random.Generator(np.random.PCG64(50)).integers(0, 1 << 64, 256, dtype=np.uint64)
_A = 0xD1342543DE82EF95
_UP = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PIECE + WIDTH, _A, dtype=np.uint64)])
_DOWN = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PIECE + WIDTH, pow(_A, -1, 1 << 64), dtype=np.uint64)])


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of WIDTH bytes: where its minimizer is (leftmost of equals); and the hash of each GRAM bytes."""
    n = max(0, len(data) - WIDTH + 1)
    where, hashes = np.empty(n, dtype=np.int64), np.empty(n + _GRAMS - 1 if n else 0, dtype=np.uint64)
    place = np.arange(_PIECE + _GRAMS - 1, dtype=np.uint64)
    for a in range(0, n, _PIECE):  # pieces that stay in a core's cache
        part = data[a : a + _PIECE + WIDTH - 1]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=total[1:])
        h = mix((total[GRAM:] - total[:-GRAM]) * _DOWN[: len(part) - GRAM + 1])
        least = (h & ~np.uint64(0xFFFFFFFF)) | place[: len(h)]
        size = 1
        while 2 * size <= _GRAMS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if _GRAMS > size:
            least = np.minimum(least[: len(least) - (_GRAMS - size)], least[_GRAMS - size :])
        where[a : a + len(least)] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
        hashes[a : a + len(h)] = h
    return where, hashes


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, document offsets, and of each run of windows that share a minimizer: its first and last window, the minimizer's place and hash."""
    data, offsets = text_buffers(batch.column("text"))
    where, hashes = minimizers(data)
    inside = np.ones(len(where), dtype=bool)
    for edge in offsets[1:-1].tolist():  # windows that cross the end of a document
        inside[max(0, edge - WIDTH + 1) : edge] = False
    other = where[1:] != where[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= other | ~inside[:-1]
    last[:-1] &= other | ~inside[1:]
    start = np.flatnonzero(first)
    return data, offsets, start, np.flatnonzero(last), where[start], hashes[where[start]]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def seeds(docs: DataFrame, buckets: int) -> DataFrame:
    """Entries of every minimizer; those that several documents of a slice have are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            _, offsets, _, _, where, key = _runs(batch)
            if not len(where):
                continue
            owner = np.searchsorted(offsets, where, "right") - 1
            place, doc = where - offsets[owner], batch.column("doc_id").to_numpy()[owner]
            order, begin = postings.groups(key)
            several = np.minimum.reduceat(doc[order], begin) < np.maximum.reduceat(doc[order], begin)
            near = postings.spread(several, order, begin)
            first = np.zeros(len(key), dtype=bool)
            first[order[begin]] = True
            # A key that one document alone has more than once needs all its places, should another slice have it.
            send = np.flatnonzero(first | ~near)
            packed = postings.rows(_bucket(key[send], buckets), doc[send], place[send], [(key[send] & np.uint64(0xFFFFFFFF), _KEY_BYTES)])
            yield postings.batch(packed, postings.settled_rows(doc[near], place[near], buckets))

    return docs.select("doc_id", "text").mapInArrow(run, postings.SCHEMA)


def _shared(docs: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Entries whose key several documents have."""
    order, begin = postings.groups(keys[0])
    return postings.spread(np.minimum.reduceat(docs[order], begin) < np.maximum.reduceat(docs[order], begin), order, begin)


def stretches(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, settled, ...) of every run of windows that share a minimizer with another document.

    Of equal stretches in a slice only the smallest document's goes on; the others are settled
    as covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.take(pa.array(np.argsort(batch.column("doc_id").to_numpy(), kind="stable")))
            data, offsets, start, stop, where, key = _runs(batch)
            hit = np.zeros(len(data), dtype=bool)
            for i, payloads in enumerate(batch.column("hits").to_pylist()):
                places = postings.positions_of(payloads) + offsets[i]
                hit[places[places < offsets[i + 1]]] = True
            chosen = hit[where]
            if not chosen.any():
                continue
            a, b, key = start[chosen], stop[chosen] + WIDTH, key[chosen]
            owner = np.searchsorted(offsets, a, "right") - 1
            doc, tag, start = batch.column("doc_id").to_numpy()[owner], batch.column("tag").to_numpy()[owner], a - offsets[owner]
            raw, first, send, done = data.tobytes(), {}, [], []
            for i, (x, y, d) in enumerate(zip(a.tolist(), b.tolist(), doc.tolist(), strict=True)):
                (send if first.setdefault(raw[x:y], d) == d else done).append(i)
            send, done = np.array(send, dtype=np.int64), np.array(done, dtype=np.int64)
            bucket = _bucket(key, buckets)
            send = send[np.argsort(bucket[send], kind="stable")]
            cut = np.flatnonzero(np.r_[True, bucket[send][1:] != bucket[send][:-1]])
            rows = []
            for part in np.split(send, cut[1:]):
                text = b"".join([raw[x:y] for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)])
                packed = postings.pack(doc[part], start[part], [((b - a)[part], 4), (key[part] & np.uint64(0xFFFFFFFF), 4), (tag[part], 4)])
                rows.append((int(bucket[part[0]]), False, packed, text))
            for to, packed in zip(*postings.settled_rows(doc[done], start[done], buckets, [((b - a)[done] - WIDTH + 1, 4), (tag[done], 4)]), strict=True):
                rows.append((to, True, packed, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "settled", "payload", "bytes"])

    return docs.mapInArrow(run, "bucket int, settled boolean, payload binary, bytes binary")


class RunIndex:
    """Run-length Burrows-Wheeler index of some strings, each with a document."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> None:
        m, n = len(sizes), len(text) + len(sizes)
        self.sizes = sizes
        owner = np.repeat(np.arange(m), sizes + 1)
        self.ends = np.cumsum(sizes + 1) - 1  # where each string's terminator stands
        symbol = np.zeros(n, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[self.ends] = False
        symbol[inner] = text.astype(np.int64) + 1
        self.inner = inner
        left = self.ends[owner] - np.arange(n)  # symbols before the terminator
        packed = np.zeros(n, dtype=np.int64)
        for i in range(6):  # nine bits a symbol; nothing beyond a terminator counts
            shifted = np.zeros(n, dtype=np.int64)
            shifted[: n - i] = symbol[i:]
            packed = (packed << 9) | np.where(left >= i, shifted, 0)
        rank, depth, at_depth = self._dense(packed), 6, None
        longest = int(sizes.max(initial=0)) + 1
        at = np.arange(n)
        while True:
            if depth * 2 > WIDTH and at_depth is None and depth <= WIDTH:
                at_depth = (rank, depth)
            beyond = left < depth
            second = np.where(beyond, owner, m + rank[np.minimum(at + depth, n - 1)])
            rank = self._dense(rank * (n + m + 1) + second)
            depth *= 2
            if depth > longest:
                break
        order = np.empty(n, dtype=np.int64)
        order[rank] = at  # all ranks differ by now
        self._entries(order, left, at_depth, docs[owner])
        before = np.where(order > 0, symbol[order - 1], 0)
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.heads, self.chars = head, before[head]
        lengths = np.diff(np.r_[head, n])
        by_char = np.argsort(self.chars, kind="stable")
        start = np.empty(len(head), dtype=np.int64)
        start[by_char] = np.cumsum(lengths[by_char]) - lengths[by_char]
        self.lf = start  # row that the first row of a run maps to
        self.samples = order[np.r_[head[1:] - 1, n - 1]]  # text position at the last row of each run

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        key = key[order]
        out = np.empty(len(key), dtype=np.int64)
        out[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        return out

    def _entries(self, order: np.ndarray, left: np.ndarray, at_depth: tuple[np.ndarray, int], docs: np.ndarray) -> None:
        """Rows that share WIDTH bytes: first row of each entry, and its smallest document."""
        rank, depth = at_depth
        x, y = order[:-1], order[1:]
        skip = WIDTH - depth
        same = (left[x] >= WIDTH) & (left[y] >= WIDTH) & (rank[x] == rank[y])
        i = np.flatnonzero(same)
        same[i] = rank[x[i] + skip] == rank[y[i] + skip]
        self.first_rows = np.flatnonzero(np.r_[True, ~same])
        self.least = np.minimum.reduceat(docs[order], self.first_rows)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For each string, one after another, the smallest document of each of its windows.

        All strings are walked backwards at once from their terminators, one LF step a byte.
        """
        counts = np.maximum(self.sizes - WIDTH + 1, 0)
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int64)
        row, alive = np.arange(len(self.sizes)), np.arange(len(self.sizes))
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            going = self.sizes[alive] >= step
            row, alive = row[going], alive[going]
            run = np.searchsorted(self.heads, row, "right") - 1
            row = self.lf[run] + row - self.heads[run]
            if step >= WIDTH:
                out[begin[alive] + self.sizes[alive] - step] = self.least[np.searchsorted(self.first_rows, row, "right") - 1]
        return out, begin


def _judge(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tags: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, number of starts, tag) of runs of windows that a smaller document has.

    Equal stretches are one string with its smallest document. A string that is alone with its
    minimizer shares no window with another; the rest is indexed and streamed.
    """
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(t, len(known)) for t in texts], dtype=np.int64)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    own = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    minimizer = np.empty(len(known), dtype=keys.dtype)
    minimizer[which] = keys
    counts = own - WIDTH + 1
    begin = np.cumsum(counts) - counts
    smallest = np.repeat(least, counts)
    _, at, several = np.unique(minimizer, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(several[at] > 1)
    if len(rest):
        strings = list(known)
        found, from_ = RunIndex(np.frombuffer(b"".join([strings[i] for i in rest.tolist()]), dtype=np.uint8), own[rest], least[rest]).stream()
        smallest[np.repeat(begin[rest] - from_, counts[rest]) + np.arange(len(found))] = found
    n = sizes - WIDTH + 1
    base = np.cumsum(n) - n
    flat = np.arange(int(n.sum())) - np.repeat(base, n)
    later = smallest[np.repeat(begin[which], n) + flat] < np.repeat(docs, n)
    edge = np.zeros(len(later), dtype=bool)
    edge[base] = True
    opens = np.flatnonzero(later & (edge | ~np.r_[False, later[:-1]]))
    closes = np.flatnonzero(later & np.r_[edge[1:] | ~later[1:], True]) + 1
    entry = np.searchsorted(base, opens, "right") - 1
    return docs[entry], starts[entry] + opens - base[entry], closes - opens, tags[entry]


def _resolve(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload) by document: (start, number of starts, tag) of covered windows."""

    def close(held: list) -> Iterator[pa.RecordBatch]:
        docs, starts, parts = zip(*[postings.unpack(h[0], [4, 4, 4]) for h in held], strict=True)
        docs, starts, (sizes, keys, tags) = np.concatenate(docs), np.concatenate(starts), [np.concatenate(k) for k in zip(*parts, strict=True)]
        sizes = sizes.astype(np.int64)
        raw = b"".join(h[1] for h in held)
        held.clear()
        at = np.cumsum(sizes) - sizes
        order = np.argsort(keys, kind="stable")
        total = np.cumsum(sizes[order])
        group = np.r_[np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]), len(order)]
        i = 0
        while i < len(group) - 1:  # whole groups, as many as an index may hold
            before = total[group[i] - 1] if group[i] else 0
            j = max(i + 1, int(np.searchsorted(total[group[1:] - 1], before + _INDEX, "right")))
            part = order[group[i] : group[j]]
            found = _judge(docs[part], starts[part], sizes[part], tags[part], keys[part], [raw[a : a + s] for a, s in zip(at[part].tolist(), sizes[part].tolist(), strict=True)])
            if len(found[0]):
                yield postings.decided(postings.settled_rows(found[0], found[1], buckets, [(found[2], 4), (found[3], 4)]))
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, settled, *parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if settled:
                    yield postings.decided(([bucket], parts[:1]))
                    continue
                if bucket != now and held:
                    yield from close(held)
                now = bucket
                held.append(parts)
        if held:
            yield from close(held)

    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, payload binary")


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, text, tag, copy (bool) and covers: packed (start, number of starts, tag) of windows to remove."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = row_tag(docs)
    texts = tagged(docs, tag)
    again = copies(texts, WIDTH)
    hits = staged(postings.settle(seeds(texts, buckets), buckets, [_KEY_BYTES], _shared), "seed-hits")
    release(spark)
    hit = uncopied(texts.join(postings.gathered(hits, buckets, "hits"), "doc_id"), again)
    covers = staged(_resolve(stretches(hit, buckets), buckets), "covered-runs")
    discard(hits)
    release(spark)
    return marked(docs.select("doc_id", "text"), tag, postings.gathered(covers, buckets, "covers", [4, 4]), again, ("tag", "copy", "covers"))


def _gone(size: int, tag: int, copy: bool, payloads: bytes | None) -> np.ndarray | None:
    """Mask of the bytes to remove; None if there are none."""
    if copy:
        return np.ones(size, dtype=bool) if size >= WIDTH else None
    if not payloads:
        return None
    start, n, tags = np.frombuffer(payloads, dtype="<u4").astype(np.int64).reshape(-1, 3).T
    end = start + n + WIDTH - 1
    own = (tags == tag) & (end <= size)
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, start[own], 1)
    np.add.at(change, end[own], -1)
    return np.cumsum(change[:-1]) > 0


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes; texts under WIDTH bytes lose none; repeats inside one
    document stay; a null doc_id loses nothing. Rows that repeat a doc_id are judged each by
    its own text, against documents with a smaller doc_id only. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            rows = []
            for i, (tag, copy, payloads) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tag", "copy", "covers")), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                gone = _gone(len(own), tag, copy, payloads)
                if gone is None:
                    rows.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                else:
                    n_spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                    rows.append((len(own), int(gone.sum()), n_spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return covered(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 bytes over all documents."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLES: dict[str, str] = {}
