"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from sourceweave.plans import batch, clusters, evaluation, events, exports, ingest, online, streams, study, texts

MODULES = (clusters, texts, evaluation, events, ingest, online, batch, study, streams, exports)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
