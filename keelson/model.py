"""What a compared table is: its key, its columns and the filters of either side."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables that this package keeps beside the copied ones; they are ignored unless a configuration says otherwise.
CONTROL_TABLES = "_keelson_.*"


@dataclass(frozen=True)
class TableSpec:
    """A keyed table of a comparison. Filters are SQL conditions."""

    name: str
    keys: tuple[str, ...]
    ignore_columns: tuple[str, ...] = ()
    source_where: str | None = None
    target_where: str | None = None
    source_hint: str | None = None
    target_hint: str | None = None
    chunk_size: int = 5000
    write_batch_size: int = 100

    def columns(self, schema: T.StructType) -> list[str]:
        """The compared columns: all but the ignored ones."""
        return [c for c in schema.names if c not in self.ignore_columns]

    def validate(self, df: DataFrame, unique: bool = False) -> None:
        """Raise where a key column is missing or ignored; with `unique`, also where a key is null or repeated (one pass)."""
        missing = [k for k in self.keys if k not in df.columns or k in self.ignore_columns]
        if not self.keys or missing:
            raise ValueError(f"{self.name}: no key column {', '.join(missing) or 'at all'}")
        if unique:
            bad = df.where(F.greatest(*[F.col(k).isNull() for k in (*self.keys, self.keys[0])])).limit(1)
            twice = df.groupBy(*self.keys).count().where("count > 1").select(*self.keys).limit(1)
            if bad.unionByName(df.join(twice, list(self.keys), "left_semi").limit(1)).head():
                raise ValueError(f"{self.name}: a key is null or not unique")

    def side(self, df: DataFrame, which: str) -> DataFrame:
        """The rows and columns of the source or target that are compared."""
        where, hint = getattr(self, f"{which}_where"), getattr(self, f"{which}_hint")
        rows = df.where(F.expr(where)) if where else df
        rows = rows.hint(hint) if hint else rows
        return rows.select(*self.columns(df.schema))


def chosen_tables(names: Iterable[str], configured: Mapping[str, object] | None = None, allowed: Iterable[str] = (), ignored: Iterable[str] = (), pattern: str | None = CONTROL_TABLES) -> list[str]:
    """The tables to work on: those of the configuration, if it names any, that are allowed and not ignored."""
    allowed, ignored = set(allowed), set(ignored)
    return [
        n
        for n in dict.fromkeys(names)
        if (not configured or n in configured) and (not allowed or n in allowed) and n not in ignored and not (pattern and re.fullmatch(pattern, n))
    ]


def _coerced(f: T.StructField, have: T.DataType) -> Column:
    c = F.col(f.name)
    if isinstance(have, T.BinaryType) and not isinstance(f.dataType, T.BinaryType):
        c = c.cast("string")
    if isinstance(have, T.TimestampType) and isinstance(f.dataType, T.StringType):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return (c if have == f.dataType else c.try_cast(f.dataType)).alias(f.name)


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema in its types. Bytes are read as text; what can't be read becomes null."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in have]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.select(*[_coerced(f, have[f.name]) for f in schema])


def same(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """Whether two cells are equal, null to null and NaN to NaN, without losing anything of either.

    Cells of two types meet in one that holds both: a whole number and a fraction as both, text and a number or time as what
    the text says. Text that says no such thing equals nothing."""
    if kind_a == kind_b:
        return a.eqNullSafe(b)
    if isinstance(kind_a, T.BinaryType):
        return same(a.cast("string"), T.StringType(), b, kind_b)
    if isinstance(kind_b, T.BinaryType):
        return same(a, kind_a, b.cast("string"), T.StringType())
    fraction, whole, exact = (T.DoubleType, T.FloatType), T.IntegralType, (T.IntegralType, T.DecimalType)
    time = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(kind_a, T.BooleanType) and isinstance(kind_b, T.NumericType):
        return same(a.cast("int"), T.IntegerType(), b, kind_b)
    if isinstance(kind_b, T.BooleanType) and isinstance(kind_a, T.NumericType):
        return same(a, kind_a, b.cast("int"), T.IntegerType())
    if isinstance(kind_a, exact) and isinstance(kind_b, exact):
        equal = a == b
    elif isinstance(kind_a, T.NumericType) and isinstance(kind_b, T.NumericType):
        equal = a.cast("double").eqNullSafe(b.cast("double"))
        for x, kind, y in ((a, kind_a, b), (b, kind_b, a)):
            if isinstance(kind, whole):  # a double doesn't tell neighbours beyond 2**53
                equal = equal & (y.try_cast("decimal(38,0)") == x)
    elif isinstance(kind_a, time) and isinstance(kind_b, time):
        equal = a.cast("timestamp") == b.cast("timestamp")
    elif isinstance(kind_b, T.StringType):
        if isinstance(kind_a, exact):
            # the text may have more digits after the point than the number's type
            equal = (b.try_cast("decimal(38,10)") == a) & (b.try_cast("double") == a.cast("double"))
        elif isinstance(kind_a, fraction):
            equal = b.try_cast("double").eqNullSafe(a.cast("double"))
        elif isinstance(kind_a, (*time, T.BooleanType)):
            equal = b.try_cast("timestamp" if isinstance(kind_a, time) else "boolean") == (a.cast("timestamp") if isinstance(kind_a, time) else a)
        else:
            equal = a.cast("string") == b
    elif isinstance(kind_a, T.StringType):
        return same(b, kind_b, a, kind_a)
    else:
        equal = a.cast("string") == b.cast("string")
    return (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & F.coalesce(equal, F.lit(False)))


def readable(df: DataFrame, schema: T.StructType, keys: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """df with a struct `read` of schema's columns in its types beside its own cells, and the names of those columns whose types
    differ. A key that its type can't hold is an error: a row without a key can't be found again."""
    kinds = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in kinds]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    other = [f.name for f in schema if kinds[f.name] != f.dataType]
    out = df.select("*", F.struct(*[_coerced(c, kinds[c.name]) for c in schema]).alias("read"))
    bad = [~same(F.col(f"read.`{k}`"), schema[k].dataType, F.col(k), kinds[k]) for k in keys if k in other]
    if bad:
        wrong = bad[0]
        for x in bad[1:]:
            wrong = wrong | x
        out = out.withColumn("read", F.when(wrong, F.raise_error(F.lit("a key of the target isn't of the source's type"))).otherwise(F.col("read")))
    return out, other


def spec_of(config: Mapping[str, object], name: str, keys: Iterable[str]) -> TableSpec:
    """A spec from one table's section of a configuration file; its `keys` override the given ones."""
    known = {"source_where", "target_where", "source_hint", "target_hint", "chunk_size", "write_batch_size"}
    spec = TableSpec(name, tuple(config.get("keys") or keys), tuple(config.get("ignore_columns") or ()))
    return replace(spec, **{k: v for k, v in config.items() if k in known})
