"""Queries and their SQL, by the identifiers of the survey."""

from __future__ import annotations

from . import catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict:
    return dict(catalogue.SQL)
