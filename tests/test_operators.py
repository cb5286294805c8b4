"""Edges of thresholds and invariants on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions import fiscal as fi
from ledgerline.functions import text as tx
from ledgerline.graph import connected_components
from ledgerline.operators import chunking as ch
from ledgerline.operators import news as nw
from ledgerline.operators import records as rc


def test_fiscal_drift_of_seven_days(spark):
    rows = spark.createDataFrame([(dt.date(2021, 10, 7), 9), (dt.date(2021, 10, 8), 9), (dt.date(2021, 9, 30), 9), (None, 9)], "d date, m int")
    assert [r.l for r in rows.select(fi.fiscal_label(F.col("d"), F.col("m")).alias("l")).collect()] == ["FY2021 Q4", "FY2022 Q1", "FY2021 Q4", None]


def test_year_labels(spark):
    rows = spark.createDataFrame([("2024",), ("FY24",), ("fy2024",), ("x",), (None,)], "s string")
    assert [r.y for r in rows.select(fi.year_of_label(F.col("s")).alias("y")).collect()] == [2024, 2024, 2024, None, None]


def test_components_of_stars_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_reprints_at_the_threshold(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "aa bb cc dd ee ff gg hh ii jj kk", day), (2, "aa bb cc dd ee ff gg hh ii", day), (3, "aa bb cc zz yy xx", day), (4, "aa bb cc dd ee ff gg hh ii", day + dt.timedelta(days=4)), (5, "", day)]
    pairs = {(r.src, r.dst) for r in nw.reprint_pairs(spark.createDataFrame(rows, "input_pos long, title string, published timestamp")).collect()}
    assert pairs == {(1, 2)}


def test_paragraphs_reassemble(spark):
    text = "one two\n\nthree\n\nfour five six"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.paragraph for r in ch.merge_paragraphs(docs, "doc_id", "text", 3).orderBy("idx").collect()] == ["one two\n\nthree", "four five six"]


def test_tables_need_two_rows(spark):
    html = "<h2>T</h2><table><tr><td>a</td></tr></table><table><tr><th>h</th></tr><tr><td>v</td></tr></table>"
    docs = spark.createDataFrame([(1, html), (2, None)], "k long, html string")
    assert [(r.k, r.context, r.rows) for r in ch.extract_tables(docs, "k", "html").collect()] == [(1, "T", [["h"], ["v"]])]


def test_upsert_takes_the_batch_on_ties(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 5, "old")], "k long, t long, v string")
    b = spark.createDataFrame([(1, 1, "new"), (2, 4, "new"), (3, 1, "new")], "k long, t long, v string")
    assert {(r.k, r.v) for r in rc.upsert(a, b, ["k"], "t").collect()} == {(1, "new"), (2, "old"), (3, "new")}


def test_amounts(spark):
    row = spark.createDataFrame([("$1.5 billion and $20,000 and $3",)], "s string").select(tx.dollar_amounts(F.col("s")).alias("a"), tx.parse_amount(F.lit("$(1,505)")).alias("b")).first()
    assert (row.a, row.b) == ([1.5e9, 20000.0], 1505.0)


def test_dates_in_file_names_by_company(spark):
    from pyspark.sql import functions as F

    from ledgerline.functions import filings as fg

    rows = [("10-Q_2024-07-26.htm", "", "filer"), ("10-K_2024-03-31.htm", "", "filer"), ("10-Q_2023-09-30.htm", "", "calendar"), ("10-Q_2023-09-30.htm", "", "other"), ("x_2023-13-30.htm", "", "calendar"), ("a.htm", "for the Year Ended\nMarch 31, 2022", "other"), ("a.htm", "year ended June 3 2021 and fiscal year ended 2020", "other"), ("2024-05-01 Q1-2025", None, None)]
    fy, quarter = fg.fiscal_name(F.col("name"), F.col("content"), F.col("company"), ("filer",), ("calendar",))
    got = [tuple(r) for r in spark.createDataFrame(rows, "name string, content string, company string").select(fy, quarter).collect()]
    assert got == [("FY25", "Q1"), ("FY24", ""), ("FY23", "Q3"), ("Unknown", ""), ("FY23", ""), ("FY22", ""), ("FY20", ""), ("FY24", "Q1")]
