"""The keyed difference of two tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.model import TableSpec, readable, same
from keelson.operators.checksum import mismatched, row_sum
from keelson.operators.chunking import chunks, locate

#: Numbers of differing chunks that are sent to executors (8 bytes each); more of them meet rows in a shuffle.
SENT = 1 << 20


def diff(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """(keys..., type, row, target): what makes target equal to source.

    type is insert (row of the source), delete (row of the target) or update (row of the source, and the target's, both in the
    source's types). Cells compare as model.same has it: null equals null, NaN equals NaN, and what is lost by reading the
    target's cell as the source's type is a difference. Keys are unique, as primary keys are (TableSpec.validate tells); null
    keys match each other. One full outer join by key."""
    spec.validate(source)
    spec.validate(target)
    s = spec.side(source, "source")
    t, other = readable(spec.side(target, "target"), s.schema, spec.keys)
    kinds = {f.name: f.dataType for f in t.schema}
    keys = list(spec.keys)
    left = s.select(F.struct(*s.columns).alias("row"))
    right = t.select(F.col("read").alias("target"), *([F.struct(*other).alias("raw")] if other else []))
    both = left.join(right, [F.col(f"row.`{k}`").eqNullSafe(F.col(f"target.`{k}`")) for k in keys], "full_outer")
    equal = F.col("row").eqNullSafe(F.col("target"))
    if other:
        cells = [same(F.col(f"row.`{f.name}`"), f.dataType, F.col(f"raw.`{f.name}`" if f.name in other else f"target.`{f.name}`"), kinds[f.name] if f.name in other else f.dataType) for f in s.schema]
        equal = reduce(Column.__and__, cells)
    found = both.where(F.col("row").isNull() | F.col("target").isNull() | ~equal)
    kind = F.when(F.col("target").isNull(), "insert").when(F.col("row").isNull(), "delete").otherwise("update")
    row = F.coalesce("row", "target")
    return found.select(*[row[k].alias(k) for k in keys], kind.alias("type"), row.alias("row"), F.when(F.col("row").isNotNull(), F.col("target")).alias("target"))


def flat(found: DataFrame) -> DataFrame:
    """A diff with a column for each cell: type, the row's columns, and target_ ones."""
    fields = found.schema["row"].dataType.names
    return found.select("type", *[F.col(f"row.`{c}`").alias(c) for c in fields], *[F.col(f"target.`{c}`").alias(f"target_{c}") for c in fields])


def diff_within(source: DataFrame, target: DataFrame, spec: TableSpec, keys: DataFrame) -> DataFrame:
    """The diff of the given keys alone: how found differences are looked at again."""
    keys = keys.select(*spec.keys).distinct()
    return diff(_of_keys(source, keys, spec.keys), _of_keys(target, keys, spec.keys), spec)


def _of_keys(rows: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    named = keys.select(*[F.col(k).alias(f"__key_{k}") for k in names])
    kinds = {f.name: f.dataType for f in rows.schema}
    # bytes are read as text, as in a diff
    own = {k: F.col(k).cast("string") if isinstance(kinds[k], T.BinaryType) and not isinstance(keys.schema[k].dataType, T.BinaryType) else F.col(k) for k in names}
    return rows.join(named, [own[k].try_cast(keys.schema[k].dataType).eqNullSafe(F.col(f"__key_{k}")) if kinds[k] != keys.schema[k].dataType else F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in names], "left_semi")


def diff_via_checksum(source: DataFrame, target: DataFrame, spec: TableSpec, mode: str = "rows") -> DataFrame:
    """The diff of those chunks alone whose checksums differ.

    In mode rows a chunk is a bucket of keys by hash, of about spec.chunk_size rows: its checksum takes no shuffle of rows, only
    sums of each task, and every difference is found. In mode crc32 chunks are ranges of the key, and the checksum is lossy by
    design: cells that swap places within a chunk go unseen."""
    plain = TableSpec(spec.name, spec.keys)
    s = spec.side(source, "source")
    t, other = readable(spec.side(target, "target"), s.schema, spec.keys)
    kinds = {f.name: f.dataType for f in t.schema}
    names = s.columns
    lost = [~same(F.col(f"read.`{c}`"), s.schema[c].dataType, F.col(c), kinds[c]) for c in other]
    # what cells lose by being read in the source's types shows in the sums
    nothing = F.lit(0).cast("long")
    losses = F.when(reduce(Column.__or__, lost), F.xxhash64(*spec.keys, *other)).otherwise(nothing) if other else nothing
    raw = t.select(*[F.col(c).alias(f"__raw_{c}") for c in names], *[F.col(f"read.`{c}`").alias(c) for c in names], losses.alias("__lost"))
    own = s.withColumn("__lost", nothing)
    if mode == "rows":
        buckets = max(1, -(-s.count() // spec.chunk_size))
        a, b = (x.withColumn("chunk_id", F.pmod(F.xxhash64(*spec.keys), F.lit(buckets))) for x in (own, raw))
        bad = mismatched(*(x.select("chunk_id", row_sum(x, [*names, "__lost"], mode).alias("__sum")) for x in (a, b)), None, mode)
        bad = F.broadcast(bad) if buckets <= SENT else bad
        a, b = (x.join(bad, "chunk_id", "left_semi") for x in (a, b))
    else:
        tiles = chunks(s, spec.keys, spec.chunk_size, spec.name)
        cells = [*names, "__lost"] if other else names
        # keys and sums of cells are all that is dealt to chunks
        a, b = (locate(x.select(*spec.keys, row_sum(x, cells, mode).alias("__sum")), tiles, spec.keys) for x in (own, raw))
        bad = mismatched(a, b, None, mode).select("chunk_id")
        keys = a.join(bad, "chunk_id", "left_semi").unionByName(b.join(bad, "chunk_id", "left_semi")).select(*spec.keys).distinct()
        a, b = _of_keys(own, keys, spec.keys), _of_keys(raw, keys, spec.keys)
    return diff(a.select(*names), b.select(*[F.col(f"__raw_{c}").alias(c) for c in names]), plain)


def no_diff(source: DataFrame, spec: TableSpec) -> DataFrame:
    """Every row of the source as an insert: a copy without a comparison."""
    s = spec.side(source, "source")
    return s.select(F.lit("insert").alias("type"), *s.columns)


def key_difference(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of one side only, and which: values are ignored."""
    a, b = source.select(*keys, F.lit(1).alias("a")), target.select(*keys, F.lit(1).alias("b"))
    both = a.join(b, list(keys), "full_outer").where(F.col("a").isNull() | F.col("b").isNull())
    return both.select(*keys, F.when(F.col("b").isNull(), "source").otherwise("target").alias("side"))


def summary(found: DataFrame, by: Sequence[str] = ("table", "type"), totals: bool = False) -> DataFrame:
    """Numbers of differences by table and type; with totals, also by table and of all (null stands for any)."""
    grouped = found.rollup(*by) if totals else found.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("diffs"))
