"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas.

A change is a signed row: +1 document and +n tokens for an insert, -1 and -n for a delete,
0 and the difference for a revised count. A batch is summed by key before it is stored (so a
source with a third of all rows is a few rows a task), in a folder named by its batch id.
Totals are additive: the sum of all committed deltas. Committing a batch id again changes
nothing once its success marker is there.

``compact`` sums what is committed into one folder, beside the ids of the batches that it holds;
one rename puts it in the place of them all, and an id that it holds stays committed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe
from ledgerline.llm.tables import table
from ledgerline.llm.words import slices
from ledgerline.workdir import new_path, staged

KEYS = ["source", "lang", "tokenizer"]
#: Words, runs of letters, and runs of letters or digits.
WORDS, LETTERS, ALNUM = r"[^\x20\x09-\x0D]+", r"\p{L}+", r"[\p{L}\p{N}]+"


def count_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern in a whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def signed(counts: DataFrame, tokenizer: str, new: Column | None = None, old: Column | None = None) -> DataFrame:
    """Changes from one row a document: insert (``new``), delete (``old``), or revision (both)."""
    if new is None and old is None:
        raise ValueError("a change needs a new count, an old count or both")
    zero = F.lit(0).cast("long")
    tokens = (zero if new is None else new) - (zero if old is None else old)
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit((new is not None) - (old is not None)).cast("long").alias("d_docs"), tokens.alias("d_tokens"))


class Rollup:
    """Additive totals under one folder.

    A batch is written aside and takes its name by one rename, which fails where the name is
    taken: of two writers of one batch id one commits. Only batches that have their success
    marker count. Null sources, languages or counts are keys and zeros of their own; repeated
    rows count each; an empty batch commits nothing but its marker; no batch at all gives no
    totals; extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.fs.Path(path)

    def _listed(self, pattern: str) -> list[str]:
        place = self._path(f"{self.root}/{pattern}")
        return [str(x.getPath()) for x in place.getFileSystem(self.conf).globStatus(place) or []]

    def _committed(self, pattern: str = "*") -> list[str]:
        """Folders of committed batches; there are as many as commits since the last compaction, not as documents."""
        return [x.removesuffix("/_SUCCESS") for x in self._listed(f"batch={pattern}/_SUCCESS")]

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest compaction and the ids of the batches in it."""
        found = max(self._listed("compact=*"), key=lambda x: int(x.rpartition("=")[2]), default=None)
        return found, set() if found is None else {r[0] for r in self.spark.read.parquet(f"{found}/ids").toLocalIterator()}

    def _take(self, aside: str, place: str) -> None:
        """Give a folder its name; fails where the name is taken."""
        aside, place = self._path(aside), self._path(place)
        files, option = place.getFileSystem(self.conf), self.spark._jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(getattr(option, "Rename"), 0)
        self.jvm.fs.FileContext.getFileContext(files.makeQualified(place).toUri(), self.conf).rename(files.makeQualified(aside), files.makeQualified(place), none)

    def _delete(self, place: str) -> None:
        self._path(place).getFileSystem(self.conf).delete(self._path(place), True)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Store a batch once; False if it was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if self._committed(batch_id) or batch_id in self._base()[1]:
            return False
        deltas = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("d_docs"), F.lit(0)).alias("d_docs"), F.coalesce(F.sum("d_tokens"), F.lit(0)).alias("d_tokens"))
        aside, place = f"{self.root}/_attempt-{uuid.uuid4().hex}", f"{self.root}/batch={batch_id}"
        deltas.write.parquet(aside)
        if self._listed(f"batch={batch_id}") and not self._committed(batch_id):
            self._delete(place)  # what another way of writing has left without a marker
        try:
            self._take(aside, place)
        except Py4JJavaError:
            if not self._committed(batch_id):
                raise
            self._delete(aside)
            return False
        return True

    def _sums(self) -> tuple[DataFrame, str | None, set[str], list[str]]:
        """Sums of all deltas, the base and the batches that they come from."""
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
        base, ids = self._base()
        batches = [x for x in self._committed() if x.rpartition("=")[2] not in ids]  # a compaction may not have deleted its own yet
        paths = batches + ([f"{base}/deltas"] if base else [])
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")), base, ids, batches

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of every key that has documents or tokens: a residue of either shows."""
        return self._sums()[0].where("d_docs <> 0 OR d_tokens <> 0").withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})

    def compact(self) -> bool:
        """Put one folder in the place of all committed batches; False if there is nothing to put together or another writer was first.

        A crash before the rename leaves everything as it was; one after it leaves folders that
        no total reads, and that the next compaction deletes. Totals that were built before and
        are read only later miss the deleted files and are to be built again.
        """
        sums, base, ids, batches = self._sums()
        if not batches:
            return False
        aside = f"{self.root}/_attempt-{uuid.uuid4().hex}"
        now = ids | {x.rpartition("=")[2] for x in batches}
        sums.where("d_docs <> 0 OR d_tokens <> 0").write.parquet(f"{aside}/deltas")
        self.spark.createDataFrame([(i,) for i in sorted(now)], "batch_id string").coalesce(1).write.parquet(f"{aside}/ids")
        turn = int(base.rpartition("=")[2]) + 1 if base else 1
        try:
            self._take(aside, f"{self.root}/compact={turn:09d}")
        except Py4JJavaError:
            if not self._listed(f"compact={turn:09d}"):
                raise
            self._delete(aside)
            return False
        for old in [x for x in self._listed("batch=*") if x.rpartition("=")[2] in now] + [x for x in self._listed("compact=*") if int(x.rpartition("=")[2]) < turn]:
            self._delete(old)
        return True


def count_documents(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, and the digest of its text."""
    text = F.col("text")
    return docs.select(
        "doc_id", "source", "lang", F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"),
        count_of(text, WORDS).alias("words"), count_of(text, LETTERS).alias("letters"), count_of(text, ALNUM).alias("alnum"),
    )


def token_counts(docs: DataFrame, codec) -> DataFrame:
    """(source, lang, tokens): how many tokens of a byte-level BPE each whole text has; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(codec.value)
        for batch in slices(batches):
            n = [len(x) // 4 for x in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), pa.array(n, pa.int64())], names=["source", "lang", "tokens"])

    return docs.select("source", "lang", "text").mapInArrow(run, "source string, lang string, tokens long")


def bpe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals under the version ``bpe-multi-50k``, whose counts are those of ``op1_bpe``'s codec; documents arrive in one batch a language."""
    counts = staged(token_counts(table(spark, sf_dir, "documents"), bpe.default_codec(spark)), "bpe-counts")
    rollup = Rollup(spark, new_path(spark, "bpe-rollup"))
    changes = signed(counts, "bpe-multi-50k", new=F.col("tokens"))
    rollup.commit("001-english", changes.where("lang = 'en'"))
    rollup.commit("002-others", changes.where("lang IS NULL OR lang <> 'en'"))
    rollup.compact()
    return rollup.totals()


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A life of the corpus as five batches: two inserts, the removal of later copies, a revision, and a replay.

    Every document enters under ``words-1`` and ``letters-1``; documents whose text an earlier
    doc_id has (null ids are last, and one row a text stays) are then deleted from both; at last the counts under ``letters-1`` are revised,
    as digits count too; the first batch arrives a second time, after a compaction, and changes nothing.
    """
    counts = staged(count_documents(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()), "token-counts")
    first = counts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first_row"))
    first = staged(first, "first-rows")  # a table of its own, so that a hot digest can be split
    marked = counts.join(first, "digest").withColumn("copy", F.col("row") != F.col("first_row"))
    copies, live = marked.where("copy"), marked.where("not copy")
    rollup = Rollup(spark, new_path(spark, "token-rollup"))
    arrived = signed(counts, "words-1", new=F.col("words"))
    rollup.commit("001-words", arrived)
    rollup.commit("002-letters", signed(counts, "letters-1", new=F.col("letters")))
    rollup.commit("003-copies", signed(copies, "words-1", old=F.col("words")).unionByName(signed(copies, "letters-1", old=F.col("letters"))))
    rollup.compact()
    rollup.commit("004-digits", signed(live, "letters-1", new=F.col("alnum"), old=F.col("letters")))
    rollup.commit("001-words", arrived)
    return rollup.totals()


QUERIES = {"op3_token_rollup": op3_token_rollup, "token_rollup_bpe": bpe_rollup}
ORACLES = {
    "op3_token_rollup": r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents
  QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'letters-1', count(*), CAST(sum(len(regexp_extract_all(t, '[\p{L}\p{N}]+'))) AS BIGINT) FROM d GROUP BY source, lang
""",
}
