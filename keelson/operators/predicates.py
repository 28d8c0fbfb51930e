"""Comparisons of composite keys, spelled out so that scans can push them down.

Spark doesn't push a comparison of structs to Parquet or JDBC; a > x OR (a = x AND b >= y) it does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"<=": "<", ">=": ">", "<": "<", ">": ">"}


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _apply(op: str, a: Column, b: object) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[op]


def compare(keys: Sequence[str | Column], op: str, values: Sequence[object]) -> Column:
    """(k1, k2, ...) op (v1, v2, ...) in the order of rows; values are literals or columns."""
    if not keys or len(keys) != len(values):
        raise ValueError("as many values as keys are needed")
    k, v = _col(keys[0]), values[0]
    if op == "=":
        out = k == v
        return out if len(keys) == 1 else out & compare(keys[1:], op, values[1:])
    if len(keys) == 1:
        return _apply(op, k, v)
    return _apply(_STRICT[op], k, v) | ((k == v) & compare(keys[1:], op, values[1:]))


def in_range(keys: Sequence[str | Column], start: Sequence[object] | None, end: Sequence[object] | None) -> Column:
    """Whether a key is within [start, end); None is unbounded."""
    out = F.lit(True)
    if start is not None:
        out = compare(keys, ">=", start)
    if end is not None:
        below = compare(keys, "<", end)
        out = out & below if start is not None else below
    return out


def overlaps(before: Sequence[str | Column], after: Sequence[str | Column], start: Sequence[object] | None, end: Sequence[object] | None) -> Column:
    """Whether either image of a mutation is within [start, end)."""
    return F.coalesce(in_range(before, start, end), F.lit(False)) | F.coalesce(in_range(after, start, end), F.lit(False))
