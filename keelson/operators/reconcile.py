"""Consistent snapshots of chunks without stopping writes: a chunk read between two watermarks of the log, with the log's
changes between them folded in, is the chunk as of the high watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.model import TableSpec
from keelson.operators.diff import diff


def windows(watermarks: DataFrame, task: str) -> DataFrame:
    """(table_name, chunk_seq, low, high): transaction ordinals of the last whole watermark pair of each of a task's chunks.

    A high watermark closes the low one right before it; a low one that another follows, or none, is left out. A chunk's
    watermarks are as few as its passes."""
    own = watermarks.where(F.col("task") == task)
    order = Window.partitionBy("table_name", "chunk_seq").orderBy("txn_ordinal", F.col("high"))
    marked = own.withColumn("__before", F.lag(F.struct("low", "txn_ordinal")).over(order))
    pairs = marked.where((F.col("high") == 1) & (F.col("__before.low") == 1))
    last = F.max(F.struct(F.col("txn_ordinal").alias("high"), F.col("__before.txn_ordinal").alias("low")))
    return pairs.groupBy("table_name", "chunk_seq").agg(last.alias("p")).select("table_name", "chunk_seq", "p.low", "p.high")


def watermarks(events: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """The task's watermark rows (txn_ordinal, task, table_name, chunk_seq, low, high) of the watermark table's events, and the
    events of other tasks, which are forwarded.

    events: (txn_ordinal, type, rows). Deletions are dropped, as they only clean up; an event of several rows is an error."""
    one = F.when(F.size("rows") > 1, F.raise_error(F.lit("a watermark event has more than one row"))).otherwise(F.get("rows", F.lit(0)))
    rows = events.where("type <> 'delete'").withColumn("__row", one)
    own = F.col("__row.task") == task
    return rows.where(own).select("txn_ordinal", "__row.*"), rows.where(~F.coalesce(own, F.lit(False))).drop("__row")


def repairs(snapshot: DataFrame, target: DataFrame, open_chunks: DataFrame, spec: TableSpec) -> DataFrame:
    """The diff that makes the target's rows of the open chunks equal to the reconciled ones: (chunk_id, row) of reconcile()
    against the target with its chunk_id."""
    inside = target.join(open_chunks.select("chunk_id"), "chunk_id", "left_semi").drop("chunk_id")
    return diff(snapshot.select("row.*"), inside, spec)


def late(watermarks: DataFrame, known: DataFrame) -> DataFrame:
    """Watermark rows of chunks that nobody waits for: they are dropped, and counted."""
    return watermarks.join(known.select("table_name", "chunk_seq"), ["table_name", "chunk_seq"], "left_anti")


def reconcile(reads: DataFrame, changes: DataFrame, open_chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(chunk_id, row) of every open chunk at its high watermark.

    reads: (chunk_id, keys..., row) as read; changes: (chunk_id, keys..., order with txn_ordinal first, live, row);
    open_chunks: (chunk_id, low, high). A change counts if low < ordinal <= high."""
    inside = changes.join(open_chunks, "chunk_id").where((F.col("order.txn_ordinal") > F.col("low")) & (F.col("order.txn_ordinal") <= F.col("high")))
    kind = changes.schema["order"].dataType
    earliest = F.lit(None).cast(kind)
    both = inside.select("chunk_id", *keys, F.struct(F.lit(1).alias("of"), F.col("order").alias("order")).alias("at"), "live", "row").unionByName(
        reads.select("chunk_id", *keys, F.struct(F.lit(0).alias("of"), earliest.alias("order")).alias("at"), F.lit(True).alias("live"), "row")
    )
    last = both.groupBy("chunk_id", *keys).agg(F.max_by(F.struct("live", "row"), F.col("at")).alias("last"))
    return last.where("last.live").select("chunk_id", "last.row")


def passthrough(changes: DataFrame, open_chunks: DataFrame) -> DataFrame:
    """The changes that no open chunk takes in: they are forwarded as they are."""
    spans = open_chunks.select(F.col("chunk_id").alias("__chunk"), "low", "high")
    inside = (F.col("chunk_id") == F.col("__chunk")) & (F.col("order.txn_ordinal") > F.col("low")) & (F.col("order.txn_ordinal") <= F.col("high"))
    return changes.join(spans, inside, "left_anti")


def admitted(tiles: DataFrame, parallelism: int, name: str = "round") -> DataFrame:
    """Chunks with the round in which they are open: `parallelism` at once, the next ones when all are done."""
    return tiles.withColumn(name, F.expr(f"chunk_id div {int(parallelism)}"))
