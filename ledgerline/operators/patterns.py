"""Many patterns in many texts: one automaton for all patterns, or anchors that meet in a shuffle.

Patterns up to MAX_PATTERN_BYTES become one Aho-Corasick automaton, which every task builds from
the broadcast list and runs over each text once, so the work does not grow with their number.
More patterns than that meet the texts by an anchor, the first word (or the first GRAM
characters) of a pattern, and each text is read once with the patterns whose anchors it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of all patterns together that are sent to every task.
MAX_PATTERN_BYTES = 16 << 20
#: Characters of an anchor where patterns may begin inside a word.
GRAM = 3
_WORD = r"[\p{L}\p{N}_]+"
_HITS = "array<struct<pattern: string, at: int>>"


def _automaton(patterns: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def _inside(a: str, b: str) -> bool:
    """Whether no word ends between two characters."""
    return (a.isalnum() or a == "_") == (b.isalnum() or b == "_")


def hits(automaton, text: str | None, whole: bool) -> list[dict]:
    """Places (from 1) of all patterns in a text, overlapping ones too; ``whole``: a word begins and ends with them."""
    out = []
    for last, p in automaton.iter(text) if text and len(automaton) else ():
        first = last + 1 - len(p)
        before, after = text[first - 1] if first else " ", text[last + 1] if last + 1 < len(text) else " "
        if not whole or not (_inside(before, p[0]) or _inside(p[-1], after)):
            out.append({"pattern": p, "at": first + 1})
    return out


def _found(rows: DataFrame, text: str, whole: bool, shared=None) -> DataFrame:
    """``rows`` with their hits, of the shared patterns or of each row's own ``patterns``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("hits", T.DataType.fromDDL(_HITS))])
    kind = pa.list_(pa.struct([("pattern", pa.string()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None if shared is None else _automaton(shared.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if one is not None:
                got = [hits(one, t, whole) for t in texts]
            else:
                got = [hits(_automaton(own), t, whole) for t, own in zip(texts, batch.column("patterns").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, "hits"])

    return rows.mapInArrow(run, schema)


def occurrences(docs: DataFrame, keys: list[str], text: str, patterns: DataFrame, whole: bool = True, limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` with ``pattern`` and ``at`` (from 1): a row for every place of a pattern (one column) in a text.

    Both are compared as they are; ``keys`` tell the rows of ``docs`` apart. ``whole``: words
    (letters, digits and _) begin and end where the pattern does. Null and empty texts and
    patterns have no places; repeated patterns count once; so do whole patterns without a word.
    """
    own = patterns.toDF("pattern").where(F.col("pattern") != "").distinct()
    if whole:
        own = own.where(F.col("pattern").rlike(_WORD))
    size = own.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    if size <= limit:
        shared = docs.sparkSession.sparkContext.broadcast([r[0] for r in own.toLocalIterator()])  # ``limit`` bytes at most
        found = _found(docs, text, whole, shared)
        return found.withColumn("hit", F.explode("hits")).select(*docs.columns, "hit.pattern", "hit.at")
    if whole:
        anchored = own.withColumn("anchor", F.regexp_extract("pattern", _WORD, 0))
        anchors = F.regexp_extract_all(text, F.lit(_WORD), 0)
    else:
        anchored = own.withColumn("anchor", F.substring("pattern", 1, GRAM))
        letters = F.split(text, "")
        anchors = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRAM - 1)), lambda n: F.transform(letters, lambda _, i: F.array_join(F.slice(letters, i + 1, n + 1), ""))))
    met = docs.where(F.length(text) > 0).select(*keys, F.explode(F.array_distinct(anchors)).alias("anchor")).join(anchored, "anchor")
    lists = met.groupBy(*keys).agg(F.collect_set("pattern").alias("patterns"))
    found = _found(docs.join(lists, keys), text, whole)
    return found.withColumn("hit", F.explode("hits")).select(*docs.columns, "hit.pattern", "hit.at")
