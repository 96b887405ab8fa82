"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "r01_corpus_split"
SUITES = ("text", "scoring", "corpus", "raster", "features", "layout", "matching", "decoding", "confidence", "reports", "neural", "files", "engine", "supporting")


def _suites():
    return [import_module(f"quillspark.plans.{name}").SUITE for name in SUITES]


def queries() -> dict:
    return {k: f for s in _suites() for k, f in s.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for s in _suites() for k, q in s.sql.items()}
