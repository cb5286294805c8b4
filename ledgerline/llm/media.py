"""Media columns: content-addressed payloads in tar shards.

Each task stores the distinct payloads of its rows as members of tar shards in the shared
folder; a member is named by the SHA-256 of its payload and stored once in a shard. The
index has a row for each document: digest, shard, offset and length. Equal payloads that
several tasks have stored are pointed to one of these members, which digests and places
alone decide. Metadata columns come from range reads of a member's header alone; whole
members are read only for features.

A payload is the UTF-8 text with zero bytes up to a positive multiple of 64, kept losslessly
as a grey 8-bit PNG of width 64. A retried task writes shards under new names and only the
names in the committed index count, so a lost executor leaves no half-written member in use.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.tables import table
from ledgerline.llm.words import slices
from ledgerline.workdir import discard, new_path, staged

WIDTH = 64
#: A shard is closed when it holds this many bytes.
SHARD_BYTES = 64 << 20
#: Bytes of a member that hold its signature, size and sample format.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest string, n_bytes long, shard string, offset long, length long"


def payload(text: str | None) -> tuple[bytes, int]:
    """Padded bytes of a text, and how many of them are the text's; null is empty."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """Rows of WIDTH grey samples, unfiltered and deflated."""
    height = len(samples) // WIDTH
    rows = np.zeros((height, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(height, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample."""
    if raw[:8] != _SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG member")
    width, height, bits = struct.unpack(">IIB", raw[16:25])
    return width, height, bits


def from_png(raw: bytes) -> bytes:
    """Samples of an image that to_png wrote."""
    width, height, _ = png_header(raw)
    at, deflated = 8, []
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IDAT":
            deflated.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(deflated)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


class _Shards:
    """Tar files that one task appends to."""

    def __init__(self, root: str) -> None:
        self.files, self.base = fs.FileSystem.from_uri(root)
        self.files.create_dir(self.base, recursive=True)
        self.root, self.out = root, None

    def put(self, digest: str, samples: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
        if digest not in self.known:
            member = to_png(samples)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(member)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.out.write(member)
            self.out.write(bytes(-len(member) % tarfile.BLOCKSIZE))
            self.known[digest] = (self.at + tarfile.BLOCKSIZE, len(member))
            self.at += tarfile.BLOCKSIZE + len(member) + -len(member) % tarfile.BLOCKSIZE
        place = (f"{self.root}/{self.name}", *self.known[digest])
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every row's payload under ``root`` and return the index, one row per row of ``docs``.

    Null and empty texts are 64 zero bytes; repeated texts share a member within a shard;
    an empty table gives an empty index. Other columns of ``docs`` are not carried.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(root)
        for batch in slices(batches, text):
            rows = []
            for t in batch.column(text).to_pylist():
                samples, n = payload(t)
                digest = hashlib.sha256(samples).hexdigest()
                rows.append((digest, n, *shards.put(digest, samples)))
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c) for c in zip(*rows, strict=True))], names=[key, "digest", "n_bytes", "shard", "offset", "length"])
        shards.close()

    stored = staged(docs.select(key, text).mapInArrow(run, f"{key} {kind}, {INDEX}"), "media-stored")
    place = F.struct("shard", "offset", "length")
    one = staged(stored.groupBy("digest").agg(F.min(place).alias("place")), "media-places")  # a table of its own, so that a hot digest can be split
    out = staged(stored.select(key, "digest", "n_bytes").join(one, "digest").select(key, "digest", "n_bytes", "place.*"), "media-index")
    discard(stored, one)
    return out


class _Reader:
    """Range reads, with the last shard kept open."""

    def __init__(self) -> None:
        self.uri, self.file = "", None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file is not None:
                self.file.close()
            files, path = fs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, files.open_input_file(path)
        return self.file.read_at(length, offset)


def _read_rows(index: DataFrame, keep: list[str], columns: str, measure, whole: bool) -> DataFrame:
    """``measure`` of each index row's bytes: the header, or the whole member."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = dict(index.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            if not batch.num_rows:
                continue
            place = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True))
            found = {}
            for p in dict.fromkeys(place):
                found[p] = measure(reader.read(p[0], p[1], p[2] if whole else min(p[2], HEADER_BYTES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c) for c in zip(*(found[p] for p in place), strict=True))], names=[*keep, *names])

    return index.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), columns]))


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and bits, from header-only range reads."""
    clash = [c for c in ("width", "height", "bits") if c in index.columns]
    index = index.drop(*clash)
    return _read_rows(index, index.columns, "width long, height long, bits long", png_header, whole=False)


def _features(raw: bytes) -> tuple:
    samples = from_png(raw)
    width, height, bits = png_header(raw)
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    feature = f"{width}x{height}x{bits}:sum={int(counts @ np.arange(256))}:levels={int((counts > 0).sum())}:mode={int(counts.argmax())}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature


def features(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of what is stored, from whole-member range reads, beside the columns of the index."""
    return _read_rows(index, [key, *(c for c in index.columns if c != key)], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _features, whole=True)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a tar member, read back and measured."""
    return features(metadata(store(table(spark, sf_dir, "documents"), new_path(spark, "media"))))


QUERIES = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}
