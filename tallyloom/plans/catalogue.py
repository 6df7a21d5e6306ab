"""All registered queries of the core."""

from __future__ import annotations

from tallyloom.plans import data_quality, records, review, text_index
from tallyloom.plans.registry import Query

MODULES = (records, text_index, review, data_quality)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.registry.sql.items()}
