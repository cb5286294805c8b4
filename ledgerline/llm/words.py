"""Vectorised words and word hashes over whole Arrow batches of texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which equals the
pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text, as UTF-8 never uses those bytes
inside a longer character. All temporaries are bounded by ``PIECE`` bytes of text,
whatever the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once, and bytes of text that one slice of a batch holds.
PIECE, SLICE = 1 << 19, 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLES = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 64, (2, 64 * 256), dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets into them; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size_of: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds ``size_of`` bytes of text, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(text).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(size).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size_of, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of some documents: byte range of each, and where each document's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1 offsets into starts

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = text_buffers(column)
        return cls.of_bytes(data, offsets)

    @classmethod
    def of_bytes(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        inside = ~_SPACE[data]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[edge] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[edge - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return cls(data, starts, ends, np.searchsorted(starts, offsets, "left"))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word; ``seed`` 0 or 1 gives two independent ones."""
        table, lengths = _TABLES[seed], self.ends - self.starts
        out = np.empty(len(lengths), dtype=np.uint64)
        total = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + PIECE, "right")))
            out[at:to] = self._piece(at, to, table, lower) if to > at + 1 or lengths[at] <= PIECE else self._long(at, table, lower)
            at = to
        return mix(out + lengths.astype(np.uint64) * _K3)

    def _piece(self, at: int, to: int, table: np.ndarray, lower: bool) -> np.ndarray:
        lengths = self.ends[at:to] - self.starts[at:to]
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(begin[-1] + lengths[-1])) - np.repeat(begin, lengths)
        return np.add.reduceat(self._bytes(np.repeat(self.starts[at:to], lengths) + place, place, table, lower), begin)

    def _long(self, at: int, table: np.ndarray, lower: bool) -> np.ndarray:
        """One word of more than PIECE bytes."""
        total, start, end = np.zeros(1, dtype=np.uint64), int(self.starts[at]), int(self.ends[at])
        for a in range(start, end, PIECE):
            index = np.arange(a, min(a + PIECE, end))
            total += np.add.reduce(self._bytes(index, index - start, table, lower))
        return total

    def _bytes(self, index: np.ndarray, place: np.ndarray, table: np.ndarray, lower: bool) -> np.ndarray:
        value = self.data[index]
        if lower:
            value = _LOWER[value]
        out = table[((place & 63) << 8) | value]
        if len(place) and (far := place >= 64).any():  # the table repeats: an odd factor for each 64 bytes
            out[far] *= (place[far] >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        return out

    def grams(self, hashes: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n consecutive words of one document, and the index of its first word."""
        if len(hashes) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        last = len(hashes) - n + 1
        total = hashes[:last].copy()
        for i in range(1, n):
            total *= _STEP[seed]
            total += hashes[i : i + last]
        room = np.repeat(self.first[1:], self.counts())[:last] - np.arange(last)
        at = np.flatnonzero(room >= n)
        return mix(total[at]), at


def spans(flags: np.ndarray, width: int, total: int) -> np.ndarray:
    """Mask of the ``total`` units that the windows beginning at ``flags`` cover."""
    change = np.zeros(total + 1, dtype=np.int32)
    np.add.at(change, flags, 1)
    np.add.at(change, np.minimum(flags + width, total), -1)
    return np.cumsum(change[:-1]) > 0
