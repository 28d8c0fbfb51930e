"""The course of a snapshot: which tables take part, requests, chunks done, and what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.model import CONTROL_TABLES


def replicated(events: DataFrame, tables: Sequence[str], control: Sequence[str] = (), name: str = "table_name") -> DataFrame:
    """The events of configured tables and of the control tables, which a stream must see as well."""
    return events.where(F.col(name).isin(*dict.fromkeys([*tables, *control])))


def without_control(events: DataFrame, pattern: str = CONTROL_TABLES, name: str = "table_name") -> DataFrame:
    """The events that a target gets: control tables are never written to it."""
    return events.where(~F.col(name).rlike(f"^(?:{pattern})$"))


def snapshot_tables(tables: DataFrame, pattern: str = CONTROL_TABLES, ignored: Sequence[str] = (), name: str = "name") -> DataFrame:
    """The tables that a snapshot reads: all but control tables and ignored ones."""
    out = without_control(tables, pattern, name)
    return out.where(~F.col(name).isin(*ignored)) if ignored else out


def tables_left(tables: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """The tables whose snapshot isn't done; the snapshot is complete when there are none."""
    return tables.join(done.select(name), name, "left_anti")


def requests(events: DataFrame, task: str) -> DataFrame:
    """(id, task) of the task's snapshot requests among the request table's events: rows written without a time of start.

    events: (type, row) with row of id, task and started_at. A time of zero counts as none."""
    row = events.where("type <> 'delete'").select("row.*").where(F.col("task") == task)
    none = F.col("started_at").isNull() | (F.unix_micros(F.col("started_at").cast("timestamp")) <= 0)
    return row.where(none).select("id", "task").distinct()


def marked(table: DataFrame, ids: DataFrame, column: str, now: Column) -> DataFrame:
    """The request table with `column` (started_at or completed_at) set to now for the given ids, where it isn't set."""
    own = ids.select("id", F.lit(True).alias("__own")).distinct()
    new = F.when(F.col("__own") & F.col(column).isNull(), now).otherwise(F.col(column))
    return table.join(own, "id", "left").withColumn(column, new.cast(table.schema[column].dataType)).select(table.columns)


def progress(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """(table, chunks, done, state): of each table in a snapshot, waiting, running or done. done: (table, chunk_id), repeats do
    no harm; chunks that a table doesn't have aren't counted."""
    marked_chunks = tiles.select("table", "chunk_id").join(done.select("table", "chunk_id", F.lit(1).alias("__done")).distinct(), ["table", "chunk_id"], "left")
    sums = marked_chunks.groupBy("table").agg(F.count(F.lit(1)).alias("chunks"), F.count("__done").alias("done"))
    state = F.when(F.col("done") == 0, "waiting").when(F.col("done") < F.col("chunks"), "running").otherwise("done")
    return sums.withColumn("state", state)


def to_start(lags: DataFrame, started: DataFrame, most_seconds: int) -> DataFrame:
    """(task) of those whose snapshot may begin by itself: their lag, as of progress.lag_now, is below the threshold and none has
    begun."""
    return lags.where(F.col("lag_us") < most_seconds * 1_000_000).join(started.select("task"), "task", "left_anti").select("task")


def shuffled(tiles: DataFrame, seed: int = 0) -> DataFrame:
    """Tables or chunks in a random order that depends on the seed alone: neighbours don't meet the same server at once."""
    return tiles.orderBy(F.xxhash64(F.lit(seed), *tiles.columns))
