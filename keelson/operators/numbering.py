"""Exact row numbers in key order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.sources.shared import cut

_ROW_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_no", groups: Sequence[str] = ()) -> DataFrame:
    """df with `name`: 1, 2, ... in the order of `order`, within groups if any are given.

    Rows are range-partitioned and sorted; an id that counts within partitions is fixed by a checkpoint, and the counts of
    partitions (one row for each, and for each group in it) give the offsets. A group of any size spreads over as many
    partitions as it needs."""
    rows = df.repartitionByRange(*[F.col(c) for c in (*groups, *order)]).sortWithinPartitions(*groups, *order)
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", _ROW_BITS))
    sizes = rows.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__least"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    keys = (*groups, "__part")
    offsets = sizes.select(*[F.col(k).alias(f"__of_{k}") for k in keys], (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least") + 1).alias("__offset"))
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return rows.join(offsets, on).withColumn(name, F.col("__at") + F.col("__offset")).drop("__at", "__part", "__offset", *[f"__of_{k}" for k in keys])


def batches(df: DataFrame, size: int, order: Sequence[str], groups: Sequence[str] = (), name: str = "batch_no") -> DataFrame:
    """df with the number, from 0, of the batch of `size` rows of its group; the last batch of a group may be smaller."""
    return numbered(df, order, "__no", groups).withColumn(name, F.expr(f"(__no - 1) div {int(size)}")).drop("__no")


def halves(df: DataFrame, order: Sequence[str], groups: Sequence[str], name: str = "half") -> DataFrame:
    """df with half 0 for the first floor(n / 2) rows of each group and 1 for the rest: how a failing batch is split."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(g).alias(f"__g_{g}") for g in groups], "__n")
    rows = numbered(df, order, "__no", groups).join(sizes, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups])
    return rows.withColumn(name, (F.col("__no") > F.expr("__n div 2")).cast("int")).drop("__no", "__n", *[f"__g_{g}" for g in groups])
