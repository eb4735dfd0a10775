"""Named queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import credit, learning, metrics, profiles, reports, retrieval, text, tools, traces  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
