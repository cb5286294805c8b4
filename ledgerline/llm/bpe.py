"""Byte-level BPE encoding and decoding.

Two-tier lookup. Tier one is a minimal perfect hash over the vocabulary (hash, displace
and verify): a pre-token that is a vocabulary entry as a whole is one id, found without
merging. Tier two takes the misses: the bytes form a doubly linked list, a heap holds the
adjacent pairs by (rank, position), and the lowest is merged until none is left.

The vocabulary has a fixed size that is checked before it is broadcast; documents are
encoded where they are read, with no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline.llm.tables import table
from ledgerline.llm.words import mix, slices

#: A vocabulary over this many bytes on disk is refused, as it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens whose ids a worker remembers; beyond it the memory starts anew.
MEMO = 1 << 19
#: Displacements that a bucket of the perfect hash tries before the table takes another seed.
TRIES = 1 << 17
_LOAD = 4
_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash from byte strings to slots 0..n-1, with the keys kept for checking.

    Hash, displace: buckets of keys, the fullest first, look for a displacement that brings
    all their keys to free slots. A bucket that finds none in TRIES displacements begins the
    whole table anew under another seed.
    """

    def __init__(self, keys: list[bytes], values: np.ndarray) -> None:
        if len(set(keys)) < len(keys):
            raise ValueError("keys repeat")
        self.n, self.n_buckets, self.seed = len(keys), max(1, len(keys) // _LOAD), 0
        while not self._place(h := self.digest(keys)):
            self.seed += 1
        slots = self._slot(h)
        self.keys: list[bytes] = [b""] * self.n
        self.values = np.empty(self.n, dtype=np.uint32)
        self.values[slots] = values
        for s, key in zip(slots.tolist(), keys, strict=True):
            self.keys[s] = key

    def _place(self, h: np.ndarray) -> bool:
        """Find the displacement of every bucket; False if one has none."""
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.n_buckets)
        begin = np.cumsum(size) - size
        self.shift = np.zeros(self.n_buckets, dtype=np.int64)
        taken = np.zeros(self.n, dtype=bool)
        free = None
        for k in np.argsort(-size, kind="stable").tolist():
            if not size[k]:
                break
            if size[k] == 1:  # lone keys take what is free: the shift then names the slot
                free = free or iter(np.flatnonzero(~taken).tolist())
                self.shift[k] = -1 - next(free)
                continue
            own = h[order[begin[k] : begin[k] + size[k]]]
            for d in range(0, TRIES, 64):  # 64 displacements at a time
                tries = np.sort((self._spread(own, np.arange(d, d + 64)[:, None]) % np.uint64(self.n)).astype(np.int64), axis=1)
                good = ~(taken[tries].any(axis=1) | (tries[:, 1:] == tries[:, :-1]).any(axis=1))
                if good.any():
                    break
            else:
                return False
            self.shift[k] = d + (first := int(good.argmax()))
            taken[tries[first]] = True
        return True

    def digest(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), dtype=np.uint64, count=len(keys))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        d = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, (self._spread(h, np.maximum(d, 0)) % np.uint64(self.n)).astype(np.int64))

    @staticmethod
    def _spread(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A number of h that each displacement draws anew, without a relation between two draws."""
        return mix(h ^ mix(d.astype(np.uint64) + np.uint64(_STEP)))

    def find(self, keys: list[bytes]) -> list[int]:
        """Value of each key, or -1 where it is not in the set."""
        if not self.n or not keys:
            return [-1] * len(keys)
        slots = self._slot(self.digest(keys))
        return [v if self.keys[s] == key else -1 for s, key, v in zip(slots.tolist(), keys, self.values[slots].tolist(), strict=True)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern, self.ranks = pattern, ranks
        self.whole = PerfectHash(list(ranks), np.fromiter(ranks.values(), dtype=np.uint32, count=len(ranks)))
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece

    @classmethod
    def load(cls, lines: list[bytes], pattern: str) -> Codec:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token, by lowest rank first and leftmost among equals."""
        rank, n = self.ranks.get, len(token)
        if n == 1:
            return [self.ranks[token]]
        right = list(range(1, n + 1))  # where the part that begins here ends
        left = list(range(-1, n - 1))  # where the part before begins; one longer than needed
        left.append(n - 1)
        now = [rank(token[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins here
        now.append(-1)
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            if now[i] != r:
                continue  # one of the two parts has changed since
            middle = right[i]
            end = right[i] = right[middle]
            now[middle] = -1
            left[end] = i
            if end < n:
                now[i] = r = rank(token[i : right[end]], -1)
                if r >= 0:
                    push(heap, r * n + i)
            else:
                now[i] = -1
            before = left[i]
            if before >= 0:
                now[before] = r = rank(token[before:end], -1)
                if r >= 0:
                    push(heap, r * n + before)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[token[i : right[i]]])
            i = right[i]
        return out

    def learn(self, tokens: list[str], memo: dict[str, bytes]) -> None:
        """Put the ids of pre-tokens into ``memo``, as little-endian 32-bit integers."""
        keys = [t.encode("utf-8") for t in tokens]
        for token, key, value in zip(tokens, keys, self.whole.find(keys), strict=True):
            memo[token] = value.to_bytes(4, "little") if value >= 0 else np.array(self.merge(key), dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


class Encoder:
    """A codec with the bounded memory of one worker."""

    def __init__(self, codec: Codec) -> None:
        import regex

        self.codec, self.split, self.memo = codec, regex.compile(codec.pattern).findall, {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        each = [self.split(t or "") for t in texts]
        memo = self.memo
        seen = set().union(*each)
        if unknown := seen.difference(memo):
            if len(memo) + len(unknown) > MEMO:
                memo.clear()
                unknown = seen
            self.codec.learn(list(unknown), memo)
        for tokens in each:
            yield b"".join(map(memo.__getitem__, tokens))


def codec_for(spark: SparkSession, path: str, pattern: str):
    """Broadcast codec of a rank file that Spark can read; refused over MAX_VOCABULARY_BYTES."""
    with open(path, "rb") as f:  # a parameter file of the driver, as the tokenizer package installs it
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {MAX_VOCABULARY_BYTES} bytes; a vocabulary is broadcast whole")
    return spark.sparkContext.broadcast(Codec.load(raw.splitlines(), pattern))


def encode(docs: DataFrame, codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int): the tokens of each whole text.

    A null or empty text has no tokens; an existing column named ``ids`` is replaced;
    repeated rows stay, other columns pass unchanged.
    """
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec.value)
        for batch in slices(batches, text):
            encoded = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in encoder.encode(batch.column(text).to_pylist())]
            values = pa.array(np.concatenate(encoded) if encoded else [], pa.int32())
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes that the tokens stand for; null ids give null."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [None if x is None else codec.value.decode(np.asarray(x, dtype=np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, codec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256, without ever holding ids as rows.

    A null or empty text has no tokens; a null key passes; repeated rows give a row each; an
    empty table gives no rows; other columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec.value)
        for batch in slices(batches, text):
            n, of_ids, of_bytes = [], [], []
            for packed in encoder.encode(batch.column(text).to_pylist()):
                n.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(codec.value.decode(np.frombuffer(packed, dtype="<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_codec(spark: SparkSession):
    import public_tokenizers

    return codec_for(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token fingerprints of every document."""
    return fingerprints(table(spark, sf_dir, "documents"), default_codec(spark))


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
