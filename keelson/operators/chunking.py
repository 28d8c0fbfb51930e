"""Tiling of a key space into chunks of an exact number of rows, and the chunk of any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.numbering import numbered
from keelson.operators.predicates import compare, in_range

#: Most ranges that `locate` deals rows into, and chunks in a range while there are fewer.
RANGES, CHUNKS = 1 << 16, 16


def chunks(df: DataFrame, keys: Sequence[str], size: int, table: str = "") -> DataFrame:
    """(table, chunk_id, seq, start, end, is_first, is_last, size): [start, end) in key order, null bounds unbounded.

    Chunk 0 lies below the least key, the last one above the greatest; between them every `size` keys make a chunk.
    seq counts the full chunks before. An empty table has one chunk. A last key that isn't integral has no successor:
    then the last chunk with rows has no upper bound and is the last."""
    spark, keys = df.sparkSession, list(keys)
    key = F.struct(*keys)
    kind = df.select(key.alias("k")).schema["k"].dataType
    numbers = numbered(df.select(*keys), keys)
    last = numbers.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("k")).first()
    n, most = last["n"], last["k"]
    schema = T.StructType([T.StructField("table", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("start", kind), T.StructField("end", kind), T.StructField("is_first", T.BooleanType()), T.StructField("is_last", T.BooleanType()), T.StructField("size", T.LongType())])
    if not n:
        return spark.createDataFrame([(table, 0, 0, None, None, True, True, 0)], schema)
    integral = isinstance(df.schema[keys[-1]].dataType, T.IntegralType)
    beyond = tuple(most[:-1]) + (most[-1] + 1,) if integral else None
    count = -(-n // size)
    starts = numbers.where((F.col("row_no") - 1) % size == 0).select(F.expr(f"(row_no - 1) div {int(size)}").alias("no"), key.alias("start"))
    ends = starts.select((F.col("no") - 1).alias("no"), F.col("start").alias("end"))
    data = starts.join(ends, "no", "left").select(
        F.lit(table).alias("table"), (F.col("no") + 1).alias("chunk_id"), F.col("no").alias("seq"), "start",
        F.coalesce("end", F.from_json(F.lit(None).cast("string"), kind) if beyond is None else _literal(beyond, kind)).alias("end"),
        F.lit(False).alias("is_first"), (F.lit(not integral) & (F.col("no") == count - 1)).alias("is_last"), F.least(F.lit(size), F.lit(n) - F.col("no") * size).cast("long").alias("size"),
    )
    least = starts.where("no = 0").select(F.lit(table).alias("table"), F.lit(0).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("seq"), _null(kind).alias("start"), F.col("start").alias("end"), F.lit(True).alias("is_first"), F.lit(False).alias("is_last"), F.lit(0).cast("long").alias("size"))
    out = least.unionByName(data)
    if integral:
        out = out.unionByName(spark.createDataFrame([(table, count + 1, n // size, beyond, None, False, True, 0)], schema))
    return out


def _null(kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def _literal(values: Sequence[object], kind: T.StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, kind, strict=True)])


def _bucket(bounds: str, n: int) -> Column:
    """How many of the first n of the ascending array `bounds` are at or below the struct column __at, by halving."""
    steps = ", ".join(str(1 << i) for i in range(max(n, 1).bit_length() - 1, -1, -1))
    return F.expr(f"aggregate(array({steps}), 0, (low, step) -> if(low + step <= {n} AND {bounds}[low + step - 1] <= __at, low + step, low))")


def locate(rows: DataFrame, tiles: DataFrame, keys: Sequence[str], name: str = "chunk_id") -> DataFrame:
    """rows with the id of the chunk that holds their key: a range join without a nested loop. Rows of a null key are of the
    chunk below the least key.

    One in so many of the chunks' starts bounds a range: a range has CHUNKS chunks, or more where RANGES ranges are too few. The
    bounds, at most RANGES, are sent to executors as one sorted array. Rows and starts meet in their range, where the last
    start before a row, in key order, names its chunk. Every range begins with a start, so nothing is carried between ranges."""
    keys = list(keys)
    starts = tiles.where(F.col("start").isNotNull()).select("chunk_id", *[F.col(f"start.{k}").alias(k) for k in keys])
    count = starts.count()
    if not count:
        return rows.withColumn(name, F.lit(0).cast("long"))
    step = max(CHUNKS, -(-count // RANGES))
    kinds = {k: rows.schema[k].dataType for k in keys}
    at = F.struct(*[F.col(k).cast(kinds[k]).alias(k) for k in keys])
    bounds = starts.where(F.col("chunk_id") % step == 1 % step).select(at.alias("__b"))
    n = bounds.count()
    bounds = bounds.agg(F.array_sort(F.collect_list("__b"))).scalar()
    payload = F.struct(*rows.columns)
    marks = starts.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.lit(None).cast(rows.select(payload.alias("p")).schema["p"].dataType).alias("__row"), F.col("chunk_id").alias("__chunk"))
    both = rows.select(*keys, payload.alias("__row"), F.lit(None).cast("long").alias("__chunk")).unionByName(marks)
    order = Window.partitionBy("__range").orderBy(*keys, F.col("__chunk").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("__bounds", bounds).withColumn("__at", F.struct(*keys)).withColumn("__range", _bucket("__bounds", n)).drop("__bounds", "__at")
    found = dealt.withColumn("__of", F.last("__chunk", ignorenulls=True).over(order))
    return found.where(F.col("__row").isNotNull()).select("__row.*", F.coalesce("__of", F.lit(0)).cast("long").alias(name))


def scan(df: DataFrame, keys: Sequence[str], start: Sequence[object] | None, end: Sequence[object] | None, where: str | None = None) -> DataFrame:
    """The rows of one chunk in key order; the bounds reach the scan as simple comparisons."""
    rows = df.where(F.expr(where)) if where else df
    return rows.where(in_range(keys, start, end)).orderBy(*keys)


def page(df: DataFrame, keys: Sequence[str], after: Sequence[object] | None, n: int) -> DataFrame:
    """The next n rows by key after the given one."""
    return (df if after is None else df.where(compare(keys, ">", after))).orderBy(*keys).limit(n)
