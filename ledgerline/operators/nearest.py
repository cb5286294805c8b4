"""The best rows of every stated query, kept where the rows lie: no pair of a query and a row is ever written.

A task streams rows past a block of queries, scores them as a product of matrices and remembers the
k best of each query (or query and group); only these are shuffled. Products of matrices round by
the place of a row, so they only tell what may be among the best; that is scored again term by
term, in the order that ``retrieval.dot`` adds, and copies of a vector tie exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Scores of rows and queries that are held at once.
_PAIRS = 1 << 21
#: What rounding of products, and to 9 places, may hide.
MARGIN = 1e-8


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go up in the shortest decimal form, as Spark rounds a double."""
    if digits is None:
        return x
    scaled = x * 10.0**digits
    out = np.where(np.isfinite(x), np.rint(scaled) / 10.0**digits, x)
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def _ranks(ids: pa.Array) -> np.ndarray:
    """Ids in a form that sorts as Spark sorts them; nulls come first."""
    if ids.null_count:
        ids = pc.fill_null(ids, -(1 << 63) if pa.types.is_int64(ids.type) else pa.scalar("", ids.type) if pa.types.is_string(ids.type) else 0)
    return ids.to_numpy(zero_copy_only=False)


class Best:
    """The k best offers of each slot, a group and one of n queries: by falling key, then id. A null score has the key -inf."""

    def __init__(self, k: int, n: int) -> None:
        self.k, self.n, self.groups, self.new = k, n, {}, 0
        self.least: list[np.ndarray] = []
        self.held: tuple | None = None
        self.offers: list[tuple] = []

    def group(self, key: tuple) -> int:
        if key not in self.groups:
            self.groups[key] = len(self.groups)
            self.least.append(np.full(self.n, -np.inf))
        return self.groups[key]

    def offer(self, group: int, queries: np.ndarray, key: np.ndarray, rows: pa.Table) -> None:
        if len(queries):
            self.offers.append((group * self.n + queries, key, _ranks(rows.column("doc_id").combine_chunks()), rows))
            self.new += len(queries)
            if self.new > 4096 + (len(self.held[0]) if self.held else 0):
                self.settle()

    def settle(self) -> None:
        """Forget what is not among the best; the k-th key of a slot is what later rows must reach."""
        parts = [*([self.held] if self.held else []), *self.offers]
        if not self.offers:
            return
        slot, key, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((ids, -key, slot))
        slot = slot[order]
        at = np.arange(len(order))
        place = at - np.maximum.accumulate(np.where(np.r_[True, slot[1:] != slot[:-1]], at, 0))
        keep = order[place < self.k]
        last = place == self.k - 1
        for s, x in zip(slot[last].tolist(), key[order][last].tolist(), strict=True):
            self.least[s // self.n][s % self.n] = x
        self.held = (slot[place < self.k], key[keep], ids[keep], pa.concat_tables([p[3] for p in parts]).take(pa.array(keep)))
        self.offers, self.new = [], 0

    def rows(self) -> tuple[np.ndarray, pa.Table] | None:
        """The queries of the best, and their rows."""
        self.settle()
        return (self.held[0] % self.n, self.held[3]) if self.held else None


def reaching(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in scores (rows, queries) that may be among the k best: within the margin of what a query has, or of the k best here."""
    if len(scores) > k and np.isneginf(least).any():
        least = np.fmax(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
    return np.nonzero(~(scores < least - MARGIN))


def batched(best: Best, ids: pa.Array, names: list[str], step: int = 10_000) -> Iterator[pa.RecordBatch]:
    """What a task gives: query_id, then the named columns of its best rows."""
    if found := best.rows():
        out = pa.Table.from_arrays([ids.take(pa.array(found[0])), *(found[1].column(c).combine_chunks() for c in names)], names=["query_id", *names])
        yield from out.to_batches(max_chunksize=step)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of vectors (-1: null, or a part is null), where each begins, and all parts."""
    flat, starts = column.values, column.offsets.to_numpy()
    lengths = np.where(np.asarray(column.is_valid()), np.diff(starts), -1)
    if flat.null_count:
        holes = np.cumsum(np.r_[0, np.asarray(flat.is_null()).astype(np.int64)])
        lengths = np.where(holes[starts[1:]] > holes[starts[:-1]], -1, lengths)
    return lengths, starts[:-1], flat.fill_null(0.0).to_numpy(zero_copy_only=False)


class Asked:
    """Unit vectors of a block of queries by their length; -1 holds those without a score."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, column = (table.column(i).combine_chunks() for i in range(2))
        lengths, starts, flat = lists(column)
        self.of = {}
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            self.of[n] = (at, np.ascontiguousarray(flat[starts[at][:, None] + np.arange(n)].T) if n >= 0 else None)

    def offer(self, best: Best, group: int, rows: pa.Table, column: pa.Array, digits: int | None) -> None:
        lengths, starts, flat = lists(column)
        for n, (asked, q) in self.of.items():
            same = np.flatnonzero(lengths == n) if n >= 0 else np.array([], dtype=np.int64)
            step = max(1, _PAIRS // len(asked))
            for a in range(0, len(same), step):
                at = same[a : a + step]
                v = flat[starts[at][:, None] + np.arange(n)]
                row, col = reaching(v @ q, best.least[group][asked], best.k)
                score, vt = np.zeros(len(row)), np.ascontiguousarray(v.T)
                for i in range(n):
                    score += q[i][col] * vt[i][row]
                key = np.where(np.isnan(score), np.inf, rounded(score, digits))
                best.offer(group, asked[col], key, rows.take(pa.array(at[row])).append_column("score", pa.array(score)))
            other = np.setdiff1d(np.arange(len(lengths)), same)
            if len(other) and np.isneginf(best.least[group][asked]).any():
                other = other[np.argsort(_ranks(rows.column("doc_id").combine_chunks())[other], kind="stable")[: best.k]]
                at = np.tile(other, len(asked))
                best.offer(group, np.repeat(asked, len(other)), np.full(len(at), -np.inf), rows.take(pa.array(at)).append_column("score", pa.nulls(len(at), pa.float64())))


def nearest_rows(queries: DataFrame, corpus: DataFrame, k: int, groups: list[str], digits: int | None) -> DataFrame:
    """(query_id, score, what corpus (doc_id, v, ...) has beside v): for each task the k best rows of every query (query_id, q) and group, by score (rounded to ``digits``) and id."""
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(Asked(queries.select("query_id", "q").toArrow()))
    names = [c for c in corpus.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = Best(k, len(asked.ids))
        for batch in batches:
            rows, column = pa.Table.from_batches([batch]).select(names), batch.column("v")
            keys = list(zip(*(batch.column(c).to_pylist() for c in groups), strict=True)) if groups else [()] * batch.num_rows
            of = np.array([best.group(x) for x in keys], dtype=np.int64)
            for g in np.unique(of).tolist():
                at = pa.array(np.flatnonzero(of == g))
                asked.offer(best, g, rows.take(at), column.take(at), digits)
        yield from batched(best, asked.ids, [*names, "score"])

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), *(StructField(f.name, f.dataType) for f in corpus.select(names).schema), StructField("score", DoubleType())])
    return corpus.mapInArrow(run, schema)


def dealt(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows over all cores, however few files they lie in."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, F.col(by))


class Words:
    """Words of a block of queries as codes of one vocabulary, and which queries hold each; a word that many hold goes into a matrix."""

    def __init__(self, table: pa.Table, dense: int = 2048) -> None:
        ids, terms = (table.column(i).combine_chunks() for i in range(2))
        coded, words = pc.dictionary_encode(ids), pc.dictionary_encode(terms)
        self.ids, self.vocabulary = coded.dictionary, words.dictionary
        query, term = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (coded, words))
        self.n, self.v = len(self.ids), len(self.vocabulary)
        self.pairs = np.sort(query * self.v + term)  # for looking up whether a query holds a word
        order = np.argsort(term, kind="stable")
        self.count = np.bincount(term, minlength=self.v)
        self.start, self.query = np.r_[0, np.cumsum(self.count)], query[order]
        common = np.argsort(-self.count, kind="stable")[:dense]
        common = common[self.count[common] * 16 >= self.n]
        self.column = np.full(self.v, -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n))
        at = self.column[term]
        self.matrix[at[at >= 0], query[at >= 0]] = 1.0

    def counts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """By row, code and length of the text that holds the word (in ``of`` where an id repeats): row, code, that length, occurrences."""
        ws = batch.column("ws")
        sizes = np.diff(ws.offsets.to_numpy())
        code = pc.fill_null(pc.index_in(ws.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        if "of" not in batch.schema.names:
            key, tf = np.unique((row * self.v + code)[code >= 0], return_counts=True)
            row, code = key // max(self.v, 1), key % max(self.v, 1)
            return row, code, sizes[row], tf
        here = code >= 0
        keys, tf = np.unique(np.stack([row[here], code[here], batch.column("of").flatten().to_numpy()[here]]), axis=1, return_counts=True)
        return *keys, tf

    def scores(self, first: int, n: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of weights by row (from ``first``, n of them) and query, nearly exact."""
        column = self.column[code]
        thick = np.zeros((n, len(self.matrix)))
        np.add.at(thick, (row[column >= 0] - first, column[column >= 0]), weight[column >= 0])
        out = thick @ self.matrix
        row, code, weight = row[column < 0] - first, code[column < 0], weight[column < 0]
        many = self.count[code]
        at = np.repeat(self.start[code] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.array([], dtype=np.int64)
        cell = np.repeat(row, many) * self.n + self.query[at]
        return out + np.bincount(cell, np.repeat(weight, many), minlength=out.size).reshape(out.shape)

    def exact(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Scores of some rows and queries, added in the order of codes, so that equal texts tie exactly."""
        out = np.empty(len(rows))
        for a in range(0, len(rows), 4096):
            r, q = rows[a : a + 4096], queries[a : a + 4096]
            lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
            many = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            pair = np.repeat(np.arange(len(r)), many)
            key = q[pair] * self.v + code[at]
            held = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
            out[a : a + 4096] = np.bincount(pair[held], weight[at][held], minlength=len(r))
        return out


def bm25_rows(terms: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score): for each task the k best documents (doc_id, copies, ws, maybe of) of every query of (query_id, term), by score to 9 places and id.

    Two passes over the documents: how many hold each word, then scores. Neither writes a document's words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Words(terms.select("query_id", "term").toArrow()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        df, total, n = np.zeros(words.v, dtype=np.int64), 0, 0
        for batch in batches:
            df = df + np.bincount(words.counts(batch)[1], minlength=words.v)
            total, n = total + len(batch.column("ws").flatten()), n + (pc.sum(batch.column("copies")).as_py() or 0)
        code = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, code].astype(np.int64)), pa.array(np.r_[n, total, df[code]].astype(np.int64))], names=["code", "n"])

    found = dict(zip(*(c.to_pylist() for c in docs.drop("doc_id").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().columns), strict=True))
    n, mean = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(shared.value.v)
    df[list(found)] = list(found.values())
    about = spark.sparkContext.broadcast((np.log((n - df + 0.5) / (df + 0.5) + 1), mean / n if mean else 1.0))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (idf, mean) = shared.value, about.value
        best = Best(k, words.n)
        group, step = best.group(()), max(1, _PAIRS // max(words.n, 2048))
        for batch in batches:
            if not words.n:
                continue
            row, code, size, tf = words.counts(batch)
            weight = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
            rows = pa.Table.from_batches([batch]).select(["doc_id"])
            for first in range(0, batch.num_rows, step):
                m = min(step, batch.num_rows - first)
                a, z = np.searchsorted(row, [first, first + m])
                score = words.scores(first, m, row[a:z], code[a:z], weight[a:z])
                at, query = reaching(np.where(score > 0, score, -np.inf), best.least[group], k)
                some = score[at, query] > 0
                at, query = at[some], query[some]
                exact = words.exact(row[a:z], code[a:z], weight[a:z], at + first, query)
                best.offer(group, query, rounded(exact, 9), rows.take(pa.array(at + first)).append_column("score", pa.array(exact)))
        yield from batched(best, words.ids, ["doc_id", "score"])

    kinds = {x: d.schema[x].dataType for d, x in ((terms, "query_id"), (docs, "doc_id"))}
    return docs.mapInArrow(rank, StructType([*(StructField(x, kind) for x, kind in kinds.items()), StructField("score", DoubleType())]))
