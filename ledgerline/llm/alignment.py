"""Cross-tokenizer alignment: divide and conquer at shared cuts.

Two tokenizers cut the same bytes. A byte offset where tokens of both end is a shared cut. To
find them all, an interval's middle end of one side is bisected in the ends of the other; where
it is no shared one, its neighbours are asked, and at last all ends of the interval, for the
one nearest to the middle. The interval is split there and both halves are cut in turn; an
interval without a cut is a leaf group. All intervals of a level are cut together.

Counts of linked id pairs never meet a text again: a task keeps the distinct pairs of a block of
documents as one sorted list, and each document's pairs as places in it. The lists are summed by
pair over the corpus, and the sums go back to their block, so a pair that every document holds
costs a row a block. A block is BLOCK bytes of text, or one longer document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.tables import table
from ledgerline.llm.words import slices
from ledgerline.workdir import discard, release, staged

#: Files of tokenizers over this many bytes are refused, as they are sent to every task.
MAX_FILE_BYTES = 64 << 20
#: Bytes of text whose pairs are listed together, and bytes that are aligned at once.
BLOCK, PIECE = 8 << 20, 1 << 20
#: Neighbours of the middle that are asked before all ends of an interval are.
_NEAR = 3
#: Pairs of a group that are written out one by one; those of larger groups are counted by id first.
_SMALL = 64

_ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, is_list boolean"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: bytes without one of their own take 256, 257, ... in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Tokenizers:
    """A (byte-level BPE from a tokenizers file) and B (sentencepiece), with the bytes of every token.

    Special tokens are never used: their strings in a text are plain text. Ids of A are its
    merge ranks, which is checked, so that one rank table encodes it.
    """

    def __init__(self, a_file: bytes, b_file: bytes, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        model = json.loads(a_file)
        special = {t["id"] for t in model["added_tokens"]}
        byte_of, vocab = _byte_of(), model["model"]["vocab"]
        pieces = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        if ranks != sorted(ranks) or len(set(ranks)) < len(ranks):
            raise ValueError("the order of the merges is not that of the ids")
        self.a_bytes = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={b: i for i, b in pieces.items()}, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        named = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        if len(self.a_bytes) * len(self.b_bytes) > 1 << 32:
            raise ValueError("a pair of ids takes more than 32 bits")

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text with a space before it; none where the text is empty or its bytes do not come back."""
        for text, b in zip(texts, self._b.encode(texts, num_threads=1), strict=True):
            a = self._a.encode_ordinary(" " + text) if text else []
            whole = (" " + text).encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, b) if same else ([], [])


def _probe(at: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bisect ends of A in those of B: the place, and whether it is an inner end of the same interval."""
    place = np.searchsorted(ends_b, ends_a[at])
    return place, (place < hi_b - 1) & (ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a[at])


def _all_ends(lo: np.ndarray, hi: np.ndarray, hi_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shared end nearest to the middle of each interval, after all its ends were asked; -1 where none is."""
    size = hi - 1 - lo
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(lo)), size)
    at = np.arange(int(size.sum())) - np.repeat(begin, size) + lo[own]
    place, good = _probe(at, ends_a, ends_b, hi_b[own])
    far = np.where(good, np.abs(at - ((lo + hi - 2) // 2)[own]), np.iinfo(np.int64).max)
    best = np.minimum.reduceat(far, begin)
    hit = np.flatnonzero(good & (far == best[own]))
    first, which = np.unique(own[hit], return_index=True)
    out, out_b = np.full(len(lo), -1), np.full(len(lo), -1)
    out[first], out_b[first] = at[hit[which]], place[hit[which]]
    return out, out_b


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token of A and of B of every group, in order.

    ``ends_*`` are the tokens' ends on one axis of bytes for all texts, ``first_*`` the n + 1
    offsets of the texts in them. A text's last end is shared.
    """
    lo, hi, lo_b, hi_b = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    full = hi > lo
    lo, hi, lo_b, hi_b = lo[full], hi[full], lo_b[full], hi_b[full]
    cuts, cuts_b = [hi - 1], [hi_b - 1]
    while len(lo):
        wide = (hi - lo > 1) & (hi_b - lo_b > 1)  # an interval with one token on a side is a leaf
        lo, hi, lo_b, hi_b = lo[wide], hi[wide], lo_b[wide], hi_b[wide]
        middle, at, at_b = (lo + hi - 2) // 2, np.full(len(lo), -1), np.full(len(lo), -1)
        todo = np.arange(len(lo))
        for step in sorted(range(-_NEAR, _NEAR + 1), key=abs):
            if not len(todo):
                break
            tried = middle[todo] + step
            inside = np.flatnonzero((tried >= lo[todo]) & (tried < hi[todo] - 1))
            place, good = _probe(tried[inside], ends_a, ends_b, hi_b[todo[inside]])
            hit = todo[inside[good]]
            at[hit], at_b[hit] = tried[inside[good]], place[good]
            todo = todo[at[todo] < 0]
        more = todo[hi[todo] - 1 - lo[todo] > 2 * _NEAR]
        if len(more):
            at[more], at_b[more] = _all_ends(lo[more], hi[more], hi_b[more], ends_a, ends_b)
        cut = at >= 0
        lo, hi, lo_b, hi_b, at, at_b = (x[cut] for x in (lo, hi, lo_b, hi_b, at, at_b))
        cuts.append(at)
        cuts_b.append(at_b)
        # Both halves, side by side, so that intervals stay in order and bisecting stays local.
        lo, hi = np.stack([lo, at + 1], 1).ravel(), np.stack([at + 1, hi], 1).ravel()
        lo_b, hi_b = np.stack([lo_b, at_b + 1], 1).ravel(), np.stack([at_b + 1, hi_b], 1).ravel()
    return np.sort(np.concatenate(cuts)), np.sort(np.concatenate(cuts_b))


@dataclass
class Alignment:
    """Groups of some texts: ids of both sides, offsets of the texts in them, and the last token of each group."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray

    @classmethod
    def of(cls, encoded: list[tuple[list[int], list[int]]], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
        sides = []
        for side in (0, 1):
            n = np.fromiter((len(x[side]) for x in encoded), dtype=np.int64, count=len(encoded))
            ids = np.fromiter(chain.from_iterable(x[side] for x in encoded), dtype=np.int64, count=int(n.sum()))
            sides.append((ids, np.r_[0, np.cumsum(n)]))
        (a, first_a), (b, first_b) = sides
        return cls(a, b, first_a, first_b, *shared_cuts(np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b]), first_a, first_b))

    def __post_init__(self) -> None:
        self.sizes_a, self.sizes_b = np.diff(self.cuts_a, prepend=-1), np.diff(self.cuts_b, prepend=-1)
        self.first_group = np.searchsorted(self.cuts_a, self.first_a)
        self.n_groups = np.diff(self.first_group)
        links = np.r_[0, np.cumsum(self.sizes_a * self.sizes_b)]
        self.n_links = links[self.first_group[1:]] - links[self.first_group[:-1]]

    def spelt(self, names: tuple[np.ndarray, ...]) -> Iterator[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; ``names`` are the ids of A with , and | and those of B with , and ; behind them."""
        in_a, in_b = (np.repeat(np.arange(len(n)), n) for n in (self.sizes_a, self.sizes_b))
        at_a = np.arange(len(self.a)) + (self.cuts_b + 1 - self.sizes_b)[in_a]
        at_b = np.arange(len(self.b)) + (self.cuts_a + 1)[in_b]
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        out[at_a], out[at_b] = names[0][self.a], names[2][self.b]
        out[at_a[self.cuts_a]], out[at_b[self.cuts_b]] = names[1][self.a[self.cuts_a]], names[3][self.b[self.cuts_b]]
        first = self.first_a + self.first_b
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield "".join(out[x:y].tolist())[:-1]

    def pairs(self, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text << 32 | a * n_b + b) of all links, sorted, and how often each occurs."""
        many = self.sizes_a * self.sizes_b
        doc = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        group = np.flatnonzero(many <= _SMALL)
        n = many[group]
        own = np.repeat(group, n)
        t = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        from_a, from_b = self.cuts_a + 1 - self.sizes_a, self.cuts_b + 1 - self.sizes_b
        i, j = from_a[own] + t // self.sizes_b[own], from_b[own] + t % self.sizes_b[own]
        keys = np.sort((doc[own] << 32) + self.a[i] * n_b + self.b[j])
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[edge], np.diff(np.r_[edge, len(keys)])
        large = np.flatnonzero(many > _SMALL).tolist()
        if not large:
            return keys, counts
        all_keys, all_counts = [keys], [counts]
        for g in large:
            ids_a, n_a = np.unique(self.a[from_a[g] : self.cuts_a[g] + 1], return_counts=True)
            ids_b, n_of_b = np.unique(self.b[from_b[g] : self.cuts_b[g] + 1], return_counts=True)
            all_keys.append(((int(doc[g]) << 32) + ids_a[:, None] * n_b + ids_b).ravel())
            all_counts.append((n_a[:, None] * n_of_b).ravel())
        keys, counts = np.concatenate(all_keys), np.concatenate(all_counts)
        order = np.argsort(keys)
        keys = keys[order]
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[edge], np.add.reduceat(counts[order], edge)


class _Worker:
    """The tokenizers and their tables in one task."""

    def __init__(self, files: tuple[bytes, bytes, str]) -> None:
        self.tokenizers = t = Tokenizers(*files)
        self.lengths = tuple(np.array([len(x) for x in side], dtype=np.int64) for side in (t.a_bytes, t.b_bytes))
        self.names = tuple(np.array([f"{i}{mark}" for i in range(len(side))], dtype=object) for side, mark in ((t.a_bytes, ","), (t.a_bytes, "|"), (t.b_bytes, ","), (t.b_bytes, ";")))

    def align(self, texts: pa.Array) -> Alignment:
        return Alignment.of(list(self.tokenizers.encode([x or "" for x in texts.to_pylist()])), *self.lengths)


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(payload: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Columns of integers that were packed as planes of bytes, which compress."""
    raw = np.frombuffer(payload or b"", dtype=np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for w in widths:
        whole = np.zeros((raw.shape[1], 8), dtype=np.uint8)
        whole[:, :w] = raw[at : at + w].T
        out.append(whole.view("<i8").ravel())
        at += w
    return out


def _encoded(docs: DataFrame, shared) -> DataFrame:
    """A row a document, and one a block with its distinct pairs and in how many of its documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(shared.value)
        n_b = len(worker.tokenizers.b_bytes)
        task, blocks = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            distinct, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            times, block, at = np.concatenate(counts), task << 32 | blocks, 0
            for a in range(0, len(rows), 512):
                part, packed = rows[a : a + 512], []
                for *_, size in part:
                    own = place[at : at + size].astype(np.int64)
                    packed.append(_planes(np.diff(own, prepend=0), 4) + _planes(times[at : at + size], 8))
                    at += size
                columns = [[block] * len(part), *(list(c) for c in zip(*part, strict=True))][:-1]
                yield _batch([*columns, packed, [False] * len(part)])
            yield _batch([[block], *([None] for _ in range(6)), [_planes(distinct, 4) + _planes(n, 4)], [True]])
            rows.clear(), keys.clear(), counts.clear()

        for batch in slices(batches, size_of=PIECE):
            found = worker.align(batch.column("text"))
            pairs, times = found.pairs(n_b)
            size = np.diff(np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1)))
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.spelt(worker.names)]
            rows += zip(batch.column("doc_id").to_pylist(), np.diff(found.first_a).tolist(), np.diff(found.first_b).tolist(), found.n_groups.tolist(), found.n_links.tolist(), digests, size.tolist(), strict=True)
            keys.append((pairs & 0xFFFFFFFF).astype(np.uint32))
            counts.append(times.astype(np.int64))
            held += batch.column("text").nbytes
            if held >= BLOCK:
                yield from close()
                blocks, held = blocks + 1, 0
        if rows:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS)


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
_NAMES = ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "is_list")


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=list(_NAMES))


def _listed(rows: DataFrame) -> DataFrame:
    """(block, pair, n) of the blocks' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                pair, n = _unplanes(payload, (4, 4))
                for a in range(0, len(pair), 1 << 16):
                    own = pair[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), pa.array(n[a : a + (1 << 16)])], names=["block", "pair", "n"])

    return rows.where("is_list").select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def _summed(key: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The rows of a block's documents with what their links count in the corpus."""
    worth = sums.column("worth").to_numpy()[np.argsort(sums.column("pair").to_numpy())]
    n_best, count_sum = [], []
    for payload in docs.column("pairs").to_pylist():
        step, times = _unplanes(payload, (4, 8))
        own = worth[np.cumsum(step)]
        n_best.append(int((times * (own & 1)).sum()))
        count_sum.append(int((times * (own >> 1)).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256").cast(pa.string()))


def files(spark: SparkSession, a_path: str, b_path: str, pattern: str):
    """Broadcast files of both tokenizers, parameter files of the driver; refused over MAX_FILE_BYTES."""
    raw = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            raw.append(f.read(MAX_FILE_BYTES + 1))
        if len(raw[-1]) > MAX_FILE_BYTES:
            raise ValueError(f"{path} holds more than {MAX_FILE_BYTES} bytes; it is sent to every task")
    return spark.sparkContext.broadcast((*raw, pattern))


def default_files(spark: SparkSession):
    import public_tokenizers as public

    return files(spark, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)


def groups(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, groups): the groups of every text as arrays of (a, b), the ids of both tokenizers; empty where there are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(shared.value)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in slices(batches, size_of=PIECE):
            found = worker.align(batch.column("text"))
            sides = [[x.tolist() for x in np.split(ids, cuts + 1)[:-1]] for ids, cuts in ((found.a, found.cuts_a), (found.b, found.cuts_b))]
            whole = [{"a": a, "b": b} for a, b in zip(*sides, strict=True)]
            first = found.first_group.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([whole[x:y] for x, y in zip(first[:-1], first[1:], strict=True)], kind)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def summary(docs: DataFrame, shared) -> DataFrame:
    """A row a document: its tokens, groups and links, and what its links count in the corpus.

    A pair's count is the number of rows that hold it linked. Null and empty texts, and texts
    whose bytes a tokenizer does not give back, have no tokens: zeros and an empty digest.
    Rows that repeat a doc_id, or have none, are documents of their own; an empty table gives
    no rows; texts may be of any length; other columns are ignored, whatever their names.
    """
    rows = staged(_encoded(docs, shared), "aligned")
    n_b = len(Tokenizers(*shared.value).b_bytes)
    counted = staged(_listed(rows).selectExpr("block", "pair", "sum(n) OVER (PARTITION BY pair) AS count"), "pair-counts")
    release(docs.sparkSession)
    # A row for each id of A at most.
    best = counted.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("count").alias("most"))
    sums = counted.withColumn("a", F.expr(f"pair div {n_b}")).join(F.broadcast(best), "a").selectExpr("block", "pair", "2 * count + IF(count = most, 1, 0) AS worth")
    own = rows.where("NOT is_list").drop("is_list")
    out = staged(own.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_summed, _OUT), "alignment")
    discard(rows, counted)
    return out


def pair_counts(docs: DataFrame, shared) -> DataFrame:
    """(a_id, b_id, count): in how many rows each pair of ids is linked."""
    n_b = len(Tokenizers(*shared.value).b_bytes)
    pairs = _listed(_encoded(docs, shared)).groupBy("pair").agg(F.sum("n").alias("count"))
    return pairs.selectExpr(f"pair div {n_b} AS a_id", f"pair % {n_b} AS b_id", "count")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over all documents."""
    return summary(table(spark, sf_dir, "documents"), default_files(spark))


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
