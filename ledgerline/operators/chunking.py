"""Sections, paragraphs, sentences, word windows and tables of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.withColumn("head", F.col("line").rlike(header))


def split_sections(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """(key, section, content): a line that fits ``header`` opens a section; what stands before the first is section 0."""
    rows = _lines(df, key, text, header).withColumn("section", F.sum(F.col("head").cast("long")).over(Window.partitionBy(key).orderBy("i")))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "section").agg(content.alias("content"))


def outline(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    return _lines(df, key, text, header).where("head").select(key, F.col("i").cast("long").alias("i"), "line")


_PARAGRAPH, _SENTENCE, _WORD = (re.compile(p, re.ASCII) for p in (r"\n\s*\n", r"(?<=[.!?])\s+", r"\S+"))
_BLANKS = re.compile(r"\s+", re.ASCII)


def packed(parts: list[str], most: int, separator: str, merge_below: bool) -> list[str]:
    """Greedy packing of strings that are not blank: runs of at most ``most`` words (a longer string stands alone), or runs that end with their ``most``-th word (``merge_below``).

    The end of a run is found by bisecting the running numbers of words, so a run costs the
    logarithm of the parts, and every part is joined once.
    """
    parts = [p for p in parts if p.strip(" ")]
    if not parts:
        return []
    total = np.cumsum([sum(1 for _ in _WORD.finditer(p)) for p in parts])
    out, i, before = [], 0, 0
    while i < len(parts):
        if merge_below:
            end = int(np.searchsorted(total, before + most, "left")) + 1
        else:  # the first part with words is in, whatever its length
            end = max(int(np.searchsorted(total, before, "right")) + 1, int(np.searchsorted(total, before + most, "right")))
        end = min(max(end, i + 1), len(parts))
        out.append(separator.join(parts[i:end]))
        i, before = end, int(total[end - 1])
    return out


def _runs(df: DataFrame, key: str, text: str, names: list[str], run_of) -> DataFrame:
    """A row for each run of each text: its places by ``names`` and the run itself, the last of them."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = run_of(value) if value else []
                for a in range(0, len(rows), 1000):  # one text may have many runs
                    part = rows[a : a + 1000]
                    columns = [pa.array(c, pa.string() if n == names[-1] else pa.int32()) for n, c in zip(names, zip(*part, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(ident, len(part)), *columns], names=[key, *names])

    schema = ", ".join([f"`{key}` {kind}", *[f"{n} int" for n in names[:-1]], f"{names[-1]} string"])
    return df.select(key, text).mapInArrow(run, schema)


def merge_paragraphs(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Paragraphs between blank lines, merged while they hold fewer than ``least`` words."""
    return _runs(df, key, text, ["idx", "paragraph"], lambda t: list(enumerate(packed(_PARAGRAPH.split(t), least, "\n\n", True))))


def pack_sentences(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Sentences packed into runs of at most ``most`` words (a longer one stands alone)."""
    return _runs(df, key, text, ["idx", "chunk"], lambda t: list(enumerate(packed(_SENTENCE.split(t), most, " ", False))))


def chunk_words(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` words that overlap; those of 50 characters or fewer go."""
    words = df.select(key, F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("ws"))
    at = words.select(key, "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(size - overlap))).alias("at"))
    return at.select(key, (F.col("at") / (size - overlap)).cast("long").alias("idx"), F.array_join(F.slice("ws", F.col("at") + 1, size), " ").alias("chunk")).where("length(chunk) > 50")


def parent_child(df: DataFrame, key: str, text: str, parent: int = 800, child: int = 375, least: int = 50) -> DataFrame:
    """Parents of whole paragraphs up to ``parent`` words, each with its children of packed sentences of ``least`` words or more."""

    def both(value: str) -> list[tuple]:
        parents = packed(_PARAGRAPH.split(value), parent, "\n\n", False)
        return [(i, p, j, c) for i, p in enumerate(parents) for j, c in enumerate(packed(_SENTENCE.split(p), child, " ", False)) if len(_BLANKS.split(c)) >= least]

    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = both(value) if value else []
                for a in range(0, len(rows), 1000):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1000], strict=True), (pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(ident, len(columns[0])), *columns], names=[key, "parent_idx", "parent", "child_idx", "child"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, parent_idx int, parent string, child_idx int, child string")


def chunk_key(*parts: Column) -> Column:
    """First 16 hex digits of the digest of the parts."""
    return F.substring(F.md5(F.concat_ws("_", *[p.cast("string") for p in parts])), 1, 16)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found, self.rows, self.cell, self.heading, self.in_heading = [], None, None, "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = ""
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.in_heading, self.heading = True, ""

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell += data
        elif self.in_heading:
            self.heading += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(self.cell.strip())
            self.cell = None
        elif tag == "table" and self.rows is not None:
            if len(self.rows) >= 2:
                self.found.append((self.heading.strip()[:100], self.rows))
            self.rows = None
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.in_heading = False


def extract_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_idx, context, rows): tables of two rows or more with the heading before them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, page in zip(part[key], part[html], strict=True):
                parser = _Tables()
                parser.feed(page or "")
                out += [(k, i, context, rows) for i, (context, rows) in enumerate(parser.found)]
            yield pd.DataFrame(out, columns=[key, "table_idx", "context", "rows"])

    return df.select(key, html).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, table_idx int, context string, rows array<array<string>>")


def table_type(rows: Column) -> Column:
    """cash_flow, balance_sheet, income_statement, capex or other, by the words of all cells."""
    words = F.lower(F.array_join(F.flatten(rows), " "))
    return (
        F.when(words.rlike("operating activities|cash flow"), "cash_flow")
        .when(words.rlike("total assets|liabilities"), "balance_sheet")
        .when(words.rlike("net income|revenue"), "income_statement")
        .when(words.rlike("capital expenditure"), "capex")
        .otherwise("other")
    )


def serialize(rows: Column) -> tuple[Column, Column]:
    """(markdown lines, ``header: value; ...`` of the rows under the header)."""
    markdown = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    head = F.get(rows, 0)
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    linear = F.transform(body, lambda r: F.array_join(F.zip_with(head, r, lambda h, v: F.concat(h, F.lit(": "), v)), "; "))
    return markdown, F.array_join(linear, "\n")
