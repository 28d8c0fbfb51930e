"""The catalogue of queries over the driver tables, with their DuckDB counterparts."""

from __future__ import annotations

from keelson.plans import control, diffs, logs, writes  # noqa: F401  they register their queries
from keelson.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
