"""Registered queries: each builds its input from the given tables and runs one operator.

Text inputs are made by template number from table columns; the SQL in ``ORACLES``
computes the expected rows from the same columns and never reads the text.
"""

from __future__ import annotations

from stmtlens.catalog import logs, corpus, changes, schema, java, review, access, jobs

_MODULES = (logs, corpus, changes, schema, java, review, access, jobs)


def all_queries() -> dict:
    merged = {}
    for module in _MODULES:
        merged.update(module.QUERIES)
    return merged


def all_oracles() -> dict:
    merged = {}
    for module in _MODULES:
        merged.update(module.ORACLES)
    return merged
