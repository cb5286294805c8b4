"""Toxicity with a counterfactual-regularised classifier.

A logistic model over the presence of words and of word beginnings (stems of inflected terms). In the labelled texts every identity term is
swapped for the other terms of its group, and the squared change of the model's logit is
penalised beside the log loss, so that naming a group does not move the score. Words are
chosen by counts over the labelled rows that Spark gathers; the fit is on a bounded sample
(MAX_LABELLED rows, by a hash of their ids) and a bounded vocabulary, so its size does not
depend on the corpus; scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.tables import table
from ledgerline.llm.words import slices
from ledgerline.workdir import discard, staged

#: Labelled rows that the classifier is fitted on, at most, and words it may use.
MAX_LABELLED, MAX_WORDS = 20_000, 8192
#: Lengths of the word beginnings that count as words of their own.
BEGINNINGS = (5, 6, 7, 8)
#: Labelled texts that must hold a word before it may be used, and standard errors that its log odds ratio must be from zero.
LEAST_TEXTS, LEAST_Z = 4, 3.0
THRESHOLD = 0.7
#: Weight of squared weights and of squared logit changes under a swap.
RIDGE, COUNTERFACTUAL = 3e-5, 1.0
STEPS, RATE = 400, 0.1

#: Groups of identity terms that are swapped for each other, by language.
IDENTITY_GROUPS: list[list[str]] = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"], ["female", "male", "transgender", "nonbinary"],
    ["gay", "straight", "lesbian", "bisexual", "queer"], ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"], ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["blind", "deaf", "disabled", "autistic"], ["old", "young", "elderly"], ["immigrant", "refugee", "foreigner", "citizen"],
    ["frauen", "männer", "mädchen", "jungen"], ["christen", "muslime", "juden", "atheisten"], ["schwule", "lesben", "heteros"],
    ["femmes", "hommes", "filles", "garçons"], ["chrétiens", "musulmans", "juifs", "athées"],
    ["mujeres", "hombres", "niñas", "niños"], ["cristianos", "musulmanes", "judíos", "ateos"],
]

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters and, marked by a hyphen, their beginnings; a null text has none."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in words_of(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _bags(rows: DataFrame) -> DataFrame:
    """(label, words) of (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([sorted(words_of(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["label", "words"])

    return rows.select("label", "text").mapInArrow(run, "label int, words array<string>")


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(label, text) of at most ``most`` labelled rows with a 0 or 1, by the least hashes of doc_id."""
    chosen = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int").alias("label"), "text")


def fit(docs: DataFrame, labels: DataFrame, groups: list[list[str]] | None = None, counterfactual: float = COUNTERFACTUAL, most: int = MAX_LABELLED) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label).

    Labels other than 0 and 1 and null ids are ignored; a doc_id that is labelled twice counts
    as 1 if any label is. Without labelled rows every score is 0.5.
    """
    groups = IDENTITY_GROUPS if groups is None else groups
    bags = staged(_bags(_sample(docs, labels, most)), "toxicity-bags")
    totals = {r.label: r.n for r in bags.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_one, n_zero = totals.get(1, 0), totals.get(0, 0)
    if not n_one + n_zero:
        return Model({}, 0.0)
    seen = bags.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("one"), F.count("*").alias("n"))
    a, b = F.col("one") + 0.5, F.col("n") - F.col("one") + 0.5
    c, d = F.lit(n_one) - F.col("one") + 0.5, F.lit(n_zero) - F.col("n") + F.col("one") + 0.5
    z = F.abs(F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    ranked = seen.where(F.col("n") >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS)
    terms = {t for g in groups for t in g}
    stems = {t: words_of(t) for t in terms}
    vocabulary = sorted({r.word for r in ranked.select("word").collect()}.union(*stems.values()))
    place = {w: i for i, w in enumerate(vocabulary)}
    used = docs.sparkSession.createDataFrame([(w, i) for w, i in place.items()], "word string, place int")
    features = bags.withColumn("row", F.monotonically_increasing_id()).select("row", "label", F.explode_outer("words").alias("word")).join(F.broadcast(used), "word", "left")
    rows = features.groupBy("row").agg(F.first("label").alias("label"), F.collect_list("place").alias("places")).select("label", "places").collect()
    discard(bags)
    rows.sort(key=lambda r: (r.label, sorted(r.places)))  # the fit does not depend on the order of partitions
    return _train([r.label for r in rows], [sorted(r.places) for r in rows], vocabulary, [[[place[s] for s in sorted(stems[t])] for t in g] for g in groups], counterfactual)


def swaps(places: list[int], groups: list[list[list[int]]]) -> list[tuple[list[int], list[int]]]:
    """(places lost, places gained) for every swap of an identity term (its word and beginnings) in a text."""
    own = set(places)
    return [(t, u) for g in groups for t in g if own.issuperset(t) for u in g if not own.issuperset(u)]


def _train(labels: list[int], places: list[list[int]], vocabulary: list[str], groups: list[list[list[int]]], counterfactual: float) -> Model:
    """Full-batch Adam on log loss + RIDGE * |w|^2 + counterfactual * mean squared logit change."""
    y = np.array(labels, dtype=np.float64)
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    col = np.concatenate([np.array(p, dtype=np.int64) for p in places]) if len(row) else np.empty(0, np.int64)
    pairs = [s for p in places for s in swaps(p, groups)]
    at = np.array([i for lost, gained in pairs for i in (*lost, *gained)], dtype=np.int64)
    sign = np.array([v for lost, gained in pairs for v in (*[1.0] * len(lost), *[-1.0] * len(gained))])
    pair = np.repeat(np.arange(len(pairs)), [len(lost) + len(gained) for lost, gained in pairs])
    n, w, bias = len(y), np.zeros(len(vocabulary)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, weights=w[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(col, weights=error[row], minlength=len(w)) + 2 * RIDGE * w
        if pairs:
            change = np.bincount(pair, weights=sign * w[at], minlength=len(pairs))
            g += np.bincount(at, weights=2 * counterfactual / len(pairs) * sign * change[pair], minlength=len(w))
        g = np.r_[g, error.sum()]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model({v: float(x) for v, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-9}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have the score of the bias alone; null ids pass; repeated rows give a
    row each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS weights at most, and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; those with a null id are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows that are not held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label")))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows are judged each."""
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, scored and filtered in one pass.

    Each row is judged by its own text, whatever its doc_id (null, repeated); null and empty
    texts have the score of the bias alone; an empty table stays empty; all columns pass,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS weights at most, and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([own.score(t) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
