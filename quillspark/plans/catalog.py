"""All queries of the engine by name, each with its SQL."""

from __future__ import annotations

from quillspark.plans import answers, collections, decisions, evaluation, evidence, formats, graphs, ingestion, logs, maintenance, provenance, retrieval, texts  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
