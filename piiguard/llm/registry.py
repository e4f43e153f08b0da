"""The queries of the operators and the SQL that DuckDB can check them by."""

from __future__ import annotations

from piiguard.llm import alignment, centroids, html_extract, near_dedup, nearest, packing, quality_classifier, quality_rules, sharding, token_files, tokens, toxicity, warc

_MODULES = (tokens, quality_rules, warc, quality_classifier, near_dedup, html_extract, nearest, sharding, packing, toxicity, alignment, token_files, centroids)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
