"""Registered queries of the library's own operators, each beside its SQL."""

from ledgerline.queries import answers, briefs, filings, finance, records, search, text, topics, wide_records, wide_text
from ledgerline.queries.base import ORACLES, QUERIES, table

__all__ = ["ORACLES", "QUERIES", "answers", "briefs", "filings", "finance", "flagship", "records", "search", "text", "topics", "wide_records", "wide_text"]


def flagship(spark, sf_dir):
    return finance.flagship(lambda name: table(spark, sf_dir, name))
