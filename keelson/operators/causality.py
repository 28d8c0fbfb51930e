"""Causally independent sequences of transactions.

Within a batch, transactions that touch a key in common, or a repaired chunk that holds a key of theirs, must keep their
order; the transitive closure of that splits the batch into sequences that can run side by side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touches(keys_of: DataFrame, repairs: DataFrame | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """(batch, txn, item): what joins transactions. keys_of: (batch, txn, table, key), key any orderable value; repairs:
    (batch, txn, table, start, end), [start, end) with null as unbounded. A repair touches the keys inside its chunk that
    others touch, and nothing with another repair."""
    own = keys_of.select("batch", "txn", F.struct("table", "key").alias("item"))
    if repairs is None:
        return own.distinct()
    r = repairs.select(F.col("batch").alias("__b"), F.col("table").alias("__t"), F.col("txn").alias("__txn"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    held = (F.col("__s").isNull() | (F.col("key") >= F.col("__s"))) & (F.col("__e").isNull() | (F.col("key") < F.col("__e")))
    # an equi-join on batch and table; chunks of a batch are as few as its transactions
    inside = keys_of.select("batch", "table", "key").distinct().join(r, (F.col("batch") == F.col("__b")) & (F.col("table") == F.col("__t")) & held)
    lone = repairs.select("batch", "txn", F.struct("table", F.lit(None).cast(keys_of.schema["key"].dataType).alias("key")).alias("item"))
    return own.unionByName(inside.select("batch", F.col("__txn").alias("txn"), F.struct("table", "key").alias("item"))).unionByName(lone).distinct()


def _joined(txn: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each row the least transaction that its own is joined to. txn and item count from 0; item -1 joins nothing."""
    n = int(txn.max()) + 1
    root = np.arange(n)
    while True:
        label = root[txn]
        least = np.full(int(item.max()) + 2, n)
        np.minimum.at(least, item, label)
        label = np.where(item >= 0, np.minimum(label, least[item]), label)
        new = root.copy()
        np.minimum.at(new, txn, label)
        np.minimum.at(new, root[txn], label)
        new = new[new]
        if (new == root).all():
            return root[txn]
        root = new


def sequences(touched: DataFrame) -> DataFrame:
    """(batch, txn, sequence): sequence is the first transaction of those that must keep their order.

    A batch is bounded (100 transactions by default), so one task joins it in one pass; batches are dealt by their number
    and many share a task."""
    kind, number = touched.schema["txn"].dataType.simpleString(), touched.schema["batch"].dataType.simpleString()
    flat = touched.select("batch", "txn", F.col("item.key").isNull().alias("lone"), F.xxhash64("item").alias("item"))

    def run(table: pa.Table) -> pa.Table:
        txn, of = np.unique(table.column("txn").to_numpy(), return_inverse=True)
        _, item = np.unique(table.column("item").to_numpy(), return_inverse=True)
        item = np.where(table.column("lone").to_numpy(), -1, item)
        first = np.zeros(len(txn), txn.dtype)
        first[of] = txn[_joined(of, item)]
        return pa.table({"batch": table.column("batch")[: len(txn)], "txn": txn, "sequence": first})

    return flat.groupBy("batch").applyInArrow(run, f"batch {number}, txn {kind}, sequence {kind}")


def printable_keys(touched: DataFrame, keys: Sequence[str] = ("table", "key")) -> DataFrame:
    """(txn, pk_set): the keys of each transaction as text, in order."""
    each = F.concat_ws(":", *[F.col(f"item.{k}").cast("string") for k in keys])
    return touched.groupBy("txn").agg(F.array_join(F.sort_array(F.collect_set(each)), ",").alias("pk_set"))
