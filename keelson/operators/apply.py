"""Writes as plans: what a target becomes by inserts, updates, deletes and diffs of any size, in one join each."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.model import TableSpec
from keelson.operators.diff import diff, diff_within
from keelson.operators.numbering import numbered

Result = TypeVar("Result")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those rows whose key it doesn't have; of rows that repeat a key one, that of least hash. Columns that rows
    lack (ignored ones) are null."""
    new = rows.join(target.select(*keys), list(keys), "left_anti").select(F.struct(*[c for c in target.columns if c in rows.columns]).alias("__row"))
    new = new.groupBy(*[F.col(f"__row.`{k}`").alias(f"__key_{k}") for k in keys]).agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return target.unionByName(new.select("__row.*"), allowMissingColumns=True)


def replace(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows in place of its own of the same key. Columns that rows lack keep the target's value (new: null)."""
    new = rows.withColumn("__new", F.lit(True)).select(*keys, F.struct("__new", *[c for c in rows.columns if c not in keys]).alias("__row"))
    both = target.join(new, list(keys), "full_outer")
    cells = [F.when(F.col("__row").isNotNull(), F.col(f"__row.`{c}`")).otherwise(F.col(c)).alias(c) if c in rows.columns and c not in keys else F.col(c) for c in target.columns]
    return both.select(*cells)


def delete(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target without the keys of rows."""
    return target.join(rows.select(*keys), list(keys), "left_anti")


def apply_diff(target: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with a diff applied. Columns that the diff lacks (ignored ones) keep the target's value."""
    fields = found.schema["row"].dataType.names
    kinds = {f.name: f.dataType for f in target.schema}
    own, change = target.select(F.struct(*target.columns).alias("__own")), found.select(F.col("type").alias("__type"), F.col("row").alias("__row"))
    on = [_as(F.col(f"__own.`{k}`"), kinds[k], found.schema[k].dataType).eqNullSafe(F.col(f"__row.`{k}`")) for k in keys]
    both = own.join(change, on, "full_outer").where(~F.col("__type").eqNullSafe("delete"))
    cells = [F.when(F.col("__row").isNotNull(), F.col(f"__row.`{c}`").cast(kinds[c])).otherwise(F.col(f"__own.`{c}`")).alias(c) if c in fields else F.col(f"__own.`{c}`").alias(c) for c in target.columns]
    return both.select(*cells)


def _as(c: Column, have: T.DataType, wanted: T.DataType) -> Column:
    """A target's key in the source's type, as diff reads it."""
    if have == wanted:
        return c
    return (c.cast("string") if isinstance(have, T.BinaryType) and not isinstance(wanted, T.BinaryType) else c).try_cast(wanted)


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those that they break: no row fails a whole batch."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def write_isolating(rows: DataFrame, write: Callable[[DataFrame], None], order: Sequence[str]) -> DataFrame:
    """Write all rows but those that make a write fail, and return these.

    What fails is halved in the order of its rows until single rows fail by themselves; k bad rows of n take some k log n
    writes. write must leave nothing of a failed batch, as a transaction does. Rows that many things are wrong with are found
    better by quarantine."""
    numbers = numbered(rows, order, "__no")
    bad, todo = [], [(1, numbers.count())]
    while todo:
        first, last = todo.pop()
        if first > last:
            continue
        try:
            write(numbers.where(F.col("__no").between(first, last)).drop("__no"))
        except Exception:
            if first == last:
                bad.append(first)
            else:
                middle = (first + last) // 2
                todo += [(middle + 1, last), (first, middle)]
    return numbers.where(F.col("__no").isin(bad) if bad else F.lit(False)).drop("__no")


def retry(action: Callable[[], Result], attempts: int = 5, least_seconds: float = 0.1, most_seconds: float = 60.0, permanent: tuple[type[Exception], ...] = (AnalysisException,), sleep: Callable[[float], None] = time.sleep) -> Result:
    """What action returns, tried again after a wait that doubles, up to most_seconds. Permanent errors, such as those of the
    schema, aren't tried again."""
    for i in range(attempts):
        try:
            return action()
        except permanent:
            raise
        except Exception:
            if i == attempts - 1:
                raise
            sleep(min(least_seconds * 2**i, most_seconds))
    raise ValueError("no attempt was allowed")


def repair(source: DataFrame, target: DataFrame, spec: TableSpec, write: Callable[[DataFrame], DataFrame] = lambda df: df, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(target, differences that stay) after up to `attempts` rounds of: apply what differs, look at those keys again.

    write stores a new state of the target and returns it as read back."""
    left = diff(source, target, spec)
    for _ in range(attempts):
        if left.isEmpty():
            break
        keys = left.select(*spec.keys)
        target = write(apply_diff(target, left, spec.keys))
        left = diff_within(source, target, spec, keys)
    return target, left


def retry_differing(read: Callable[[], tuple[DataFrame, DataFrame]], spec: TableSpec, retries: int = 0) -> DataFrame:
    """Differences that every one of retries + 1 reads shows: what was only in flight at one read doesn't count."""
    left = diff(*read(), spec)
    for _ in range(retries):
        if left.isEmpty():
            break
        left = diff_within(*read(), spec, left.select(*spec.keys))
    return left
