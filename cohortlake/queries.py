"""Registry of the queries over the driver tables and their SQL twins."""

from __future__ import annotations

from cohortlake.plans import REGISTRY


def queries() -> dict:
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
