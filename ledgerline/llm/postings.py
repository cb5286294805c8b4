"""Packed postings: (key, document, position) entries that cross a shuffle as a few bytes each.

Entries of one slice of texts are dealt to buckets by their key. A row carries all entries of
a slice for a bucket, in document order, as planes of bytes that the shuffle's codec
compresses well. A key that a slice meets in several documents is settled there as far as it
can be, and sends one entry only, so a passage that a third of all documents share costs a
bucket one entry a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SCHEMA = "bucket int, settled boolean, payload binary"


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.view("<u8").reshape(n)


def pack(doc_ids: np.ndarray, positions: np.ndarray, keys: list[tuple[np.ndarray, int]]) -> bytes:
    """Entries sorted by document; each key array comes with its width in bytes."""
    edge = np.flatnonzero(np.r_[True, doc_ids[1:] != doc_ids[:-1]])
    counts = np.diff(np.r_[edge, len(doc_ids)])
    step = positions.astype(np.int64)
    step[1:] -= positions[:-1]
    step[edge] = positions[edge]
    head = np.array([len(edge), len(doc_ids)], dtype="<u4").tobytes()
    docs = _planes(np.diff(doc_ids[edge], prepend=0).astype(np.uint64), 8)
    return head + docs + _planes(counts, 4) + _planes(step, 4) + b"".join(_planes(k, w) for k, w in keys)


def unpack(raw: bytes, widths: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    data = np.frombuffer(raw, dtype=np.uint8)
    n_docs, n = (int(x) for x in np.frombuffer(raw, dtype="<u4", count=2))
    at = 8
    docs = np.cumsum(_unplanes(data[at:], n_docs, 8).view(np.int64))
    at += 8 * n_docs
    counts = _unplanes(data[at:], n_docs, 4).astype(np.int64)
    at += 4 * n_docs
    step = _unplanes(data[at:], n, 4).astype(np.int64)
    at += 4 * n
    total = np.cumsum(step)
    begin = np.cumsum(counts) - counts
    positions = total - np.repeat(total[begin] - step[begin], counts)
    keys = []
    for w in widths:
        keys.append(_unplanes(data[at:], n, w))
        at += w * n
    return np.repeat(docs, counts), positions, keys


def groups(key: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and where each group begins in it."""
    if second is None:
        order = np.argsort(key)
        key = key[order]
        return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    order = np.lexsort((second, key))
    key, second = key[order], second[order]
    return order, np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]) if len(key) else np.empty(0, np.int64)


def spread(values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A value of each group, at the places of its entries."""
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = np.repeat(values, np.diff(np.r_[begin, len(order)]))
    return out


def rows(bucket: np.ndarray, doc_ids: np.ndarray, positions: np.ndarray, keys: list[tuple[np.ndarray, int]]) -> tuple[list, list]:
    """(buckets, payloads): a packed row for each bucket that has entries."""
    order = np.lexsort((positions, doc_ids, bucket))
    bucket = bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    payloads = []
    for part in np.split(order, edge[1:]) if len(bucket) else []:
        payloads.append(pack(doc_ids[part], positions[part], [(k[part], w) for k, w in keys]))
    return bucket[edge].tolist(), payloads


def settled_rows(doc_ids: np.ndarray, positions: np.ndarray, buckets: int, keys: list[tuple[np.ndarray, int]] = []) -> tuple[list, list]:  # noqa: B006
    """Packed rows of what is decided, dealt by document."""
    return rows(doc_ids % buckets, doc_ids, positions, keys)


def batch(open_rows: tuple[list, list], settled: tuple[list, list]) -> pa.RecordBatch:
    flags = [False] * len(open_rows[0]) + [True] * len(settled[0])
    return pa.RecordBatch.from_arrays([pa.array(open_rows[0] + settled[0], pa.int32()), pa.array(flags, pa.bool_()), pa.array(open_rows[1] + settled[1], pa.binary())], names=["bucket", "settled", "payload"])


def decided(found: tuple[list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.binary())], names=["bucket", "payload"])


def _by_bucket(entries: DataFrame, buckets: int, widths: list[int], close: Callable, schema: str) -> DataFrame:
    """``close(docs, places, keys)`` of all entries of each bucket, one bucket a task; settled rows pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def whole() -> pa.RecordBatch:
            docs, places, keys = zip(*held, strict=True)
            held.clear()
            return close(np.concatenate(docs), np.concatenate(places), [np.concatenate(k) for k in zip(*keys, strict=True)])

        for part in batches:
            done = part.filter(part.column("settled")).select(["bucket", "payload"])
            if done.num_rows:
                yield done
            part = part.filter(pc.invert(part.column("settled")))
            for bucket, payload in zip(part.column("bucket").to_pylist(), part.column("payload"), strict=True):
                if bucket != now and held:
                    yield whole()
                now = bucket
                held.append(unpack(payload.as_buffer(), widths))
        if held:
            yield whole()

    return entries.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def settle(entries: DataFrame, buckets: int, widths: list[int], decide: Callable, carry: int = 0) -> DataFrame:
    """(bucket, payload) by document: entries that ``decide`` picks from each bucket, and those settled before.

    ``decide(doc_ids, positions, keys)`` gets all entries of a bucket and returns a mask. The
    last ``carry`` keys are not compared but go on with the entries.
    """

    def close(docs: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
        own = len(keys) - carry
        mask = decide(docs, places, keys[:own])
        return decided(settled_rows(docs[mask], places[mask], buckets, [(k[mask], w) for k, w in zip(keys[own:], widths[own:], strict=True)]))

    return _by_bucket(entries, buckets, widths, close, "bucket int, payload binary")


def counted(entries: DataFrame, buckets: int, widths: list[int], decide: Callable) -> DataFrame:
    """(doc_id, n): how many entries of each document ``decide`` picks in each bucket."""

    def close(docs: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
        ids, n = np.unique(docs[decide(docs, places, keys)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return _by_bucket(entries, buckets, widths, close, "doc_id long, n long")


def gathered(settled: DataFrame, buckets: int, name: str, widths: list[int] = []) -> DataFrame:  # noqa: B006
    """One row a document: its sorted positions (each followed by its keys) as 32-bit integers in ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def close() -> pa.RecordBatch:
            docs, places, keys = zip(*held, strict=True)
            columns = [np.concatenate(places), *(np.concatenate(k).astype(np.int64) for k in zip(*keys, strict=True))]
            docs = np.concatenate(docs)
            held.clear()
            order = np.lexsort((columns[0], docs))
            docs, packed = docs[order], np.stack(columns, axis=1)[order].astype("<u4")
            edge = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(docs[edge], pa.int64()), pa.array([p.tobytes() for p in np.split(packed, edge[1:])], pa.binary())], names=["doc_id", name])

        for part in batches:
            for bucket, payload in zip(part.column("bucket").to_pylist(), part.column("payload"), strict=True):
                if bucket != now and held:
                    yield close()
                now = bucket
                held.append(unpack(payload.as_buffer(), widths))
        if held:
            yield close()

    return settled.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"doc_id long, {name} binary")


def positions_of(payload: bytes | None) -> np.ndarray:
    """Positions of one gathered row without keys."""
    return np.frombuffer(payload or b"", dtype="<u4").astype(np.int64)
