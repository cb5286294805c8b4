"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from ledgerline.llm import alignment, bpe, collocations, decontaminate, embedding_dedup, license_scan, media, near_dup, rollup, substring_dedup, suffix_dedup, toxicity, url_filter

_MODULES = (alignment, bpe, collocations, decontaminate, embedding_dedup, license_scan, media, near_dup, rollup, substring_dedup, suffix_dedup, toxicity, url_filter)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
