"""Checksums of chunks that don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_form(df: DataFrame, column: str) -> Column:
    """The text whose CRC stands for a cell, in full: null as 0, times to the microsecond, fractions to their last digit."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif not isinstance(kind, T.BinaryType):
        c = c.cast("string")
    return F.coalesce(c.cast("binary"), F.lit("0").cast("binary"))


def row_sum(df: DataFrame, columns: Sequence[str], mode: str = "rows") -> Column:
    """A row's part of its chunk's checksum. crc32: XOR of the CRCs of its cells; rows: a hash of the row."""
    if mode == "crc32":
        return reduce(Column.bitwiseXOR, [F.crc32(text_form(df, c)) for c in columns])
    # a null leaves the hash as it is, so its place is hashed too
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def checksums(df: DataFrame, columns: Sequence[str] | None, mode: str = "rows", by: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """(chunk_id, n, checksum), XOR of row_sum, blind in mode crc32 to cells that swap places. Without columns df has the row
    sums as __sum."""
    each = F.col("__sum") if columns is None else row_sum(df, columns, mode)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(each), F.lit(0)).cast("long").alias("checksum"))


def mismatched(a: DataFrame, b: DataFrame, columns: Sequence[str] | None, mode: str = "rows") -> DataFrame:
    """(chunk_id): the chunks whose checksums (mode rows: or counts) differ; a chunk without rows has checksum 0."""
    x = checksums(a, columns, mode).select("chunk_id", F.col("n").alias("n_a"), F.col("checksum").alias("sum_a"))
    y = checksums(b, columns, mode).select("chunk_id", F.col("n").alias("n_b"), F.col("checksum").alias("sum_b"))
    zero = F.lit(0).cast("long")
    differs = F.coalesce("sum_a", zero) != F.coalesce("sum_b", zero)
    if mode == "rows":
        differs = differs | (F.coalesce("n_a", zero) != F.coalesce("n_b", zero))
    return x.join(y, "chunk_id", "full_outer").where(differs).select("chunk_id")
