"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from . import registry

queries = registry.queries
oracle_sql = registry.oracle_sql
