"""Positions, checkpoints, heartbeats, requests and throughput of a running copy, as plans over their tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Lag where no heartbeat was ever seen.
NO_HEARTBEAT_SECONDS = 3600


def start_position(tasks: DataFrame, checkpoints: DataFrame, masters: DataFrame, last_target: DataFrame) -> DataFrame:
    """(task, origin, file, position, gtid): where replication of each task starts.

    A checkpoint comes first, then tasks.starting_gtid, then, if tasks.at_last_source_gtid, the target GTID that the source
    has for the task, then the source's current position. Tables: checkpoints (task, file, position, source_gtid), masters
    (file, position, gtid: one row), last_target (task, target_gtid)."""
    rows = tasks.join(checkpoints.select("task", F.struct("file", "position", F.col("source_gtid").alias("gtid")).alias("c")), "task", "left")
    rows = rows.join(last_target.select("task", "target_gtid"), "task", "left")
    rows = rows.join(F.broadcast(masters.limit(1).select(F.struct("file", "position", "gtid").alias("m"))), F.lit(True), "left")
    at = lambda gtid: F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("position"), gtid.alias("gtid"))
    chosen = (
        F.when(F.col("c").isNotNull(), F.struct(F.lit("checkpoint").alias("origin"), F.col("c").alias("p")))
        .when(F.coalesce("starting_gtid", F.lit("")) != "", F.struct(F.lit("starting_gtid").alias("origin"), at(F.col("starting_gtid")).alias("p")))
        .when(F.col("at_last_source_gtid"), F.struct(F.lit("last_source_gtid").alias("origin"), at(F.col("target_gtid")).alias("p")))
        .otherwise(F.struct(F.lit("current").alias("origin"), F.col("m").alias("p")))
    )
    return rows.select("task", chosen.alias("x")).select("task", "x.origin", "x.p.file", "x.p.position", "x.p.gtid")


def checkpoint_state(commits: DataFrame) -> DataFrame:
    """(task, file, position, source_gtid): the last committed position of each task."""
    last = F.max_by(F.struct("file", "position", "source_gtid"), F.col("txn_ordinal"))
    return commits.groupBy("task").agg(last.alias("p")).select("task", "p.file", "p.position", "p.source_gtid")


def pending_requests(requests: DataFrame) -> DataFrame:
    """Snapshot requests that nobody has started."""
    return requests.where(F.col("started_at").isNull())


def heartbeat_writes(beats: DataFrame) -> DataFrame:
    """(task, time, count): each task's heartbeat row after all beats."""
    return beats.groupBy("task").agg(F.max("time").alias("time"), F.count(F.lit(1)).alias("count"))


def heartbeat_lag(written: DataFrame, applied: DataFrame) -> DataFrame:
    """(task, count, time, lag_us): time from writing a heartbeat until the first that is at least as late was applied.

    written: (task, count, time); applied: (task, count, apply_time). Counters ascend, so the earliest apply time of any
    count at or above is a running minimum from the end: no range join."""
    both = written.select("task", "count", "time", F.lit(None).cast("timestamp").alias("apply_time")).unionByName(applied.select("task", "count", F.lit(None).cast("timestamp").alias("time"), "apply_time"))
    later = Window.partitionBy("task").orderBy(F.desc("count")).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("first", F.min("apply_time").over(later)).where(F.col("time").isNotNull())
    return found.select("task", "count", "time", (F.unix_micros("first") - F.unix_micros("time")).alias("lag_us"))


def lag_now(heartbeats: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """(task, lag_us): time since each task's heartbeat; an hour where it has none."""
    rows = tasks.select("task").join(heartbeats.groupBy("task").agg(F.max("time").alias("time")), "task", "left")
    return rows.select("task", F.coalesce(F.unix_micros(now) - F.unix_micros("time"), F.lit(NO_HEARTBEAT_SECONDS * 1_000_000)).alias("lag_us"))


def lag_gate(lags: DataFrame, most_seconds: int = 60) -> DataFrame:
    """lags with `good`: whether a task is close enough behind for checksums to mean anything."""
    return lags.withColumn("good", F.col("lag_us") < most_seconds * 1_000_000)


def throughput(progress: DataFrame, estimates: DataFrame) -> DataFrame:
    """(table, rows, estimated_rows, rows_per_second, percent_done, seconds_left) from (table, rows, seconds) and (table,
    estimated_rows). More rows than estimated are 100 percent; without an estimate both last columns are null."""
    rows = progress.groupBy("table").agg(F.sum("rows").alias("rows"), F.max("seconds").alias("seconds")).join(estimates, "table", "left")
    speed = F.col("rows") / F.nullif("seconds", F.lit(0))
    over, known = F.col("rows") > F.col("estimated_rows"), F.coalesce(F.col("estimated_rows"), F.lit(0)) > 0
    percent = F.when(known, F.when(over, 100.0).otherwise(100.0 * F.col("rows") / F.col("estimated_rows")))
    left = F.when(known, F.when(over, 0.0).otherwise((F.col("estimated_rows") - F.col("rows")) / speed))
    return rows.select("table", "rows", "estimated_rows", speed.alias("rows_per_second"), percent.alias("percent_done"), left.alias("seconds_left"))


def observed(rows: DataFrame, name: str, column: str = "type", values: Sequence[str] = ("insert", "update", "delete")) -> tuple[DataFrame, Observation]:
    """rows, and what is counted of them as they pass, by the values of a column and in all: no second pass is made for it.

    The counts are there (`.get`) when an action on rows has ended; a stream reports them to its listeners under that name."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(column) == v).alias(v) for v in values]), seen


def exposed(counts: Mapping[str, float], prefix: str, **labels: str) -> str:
    """Counts in the text format that metric servers scrape."""
    of = ",".join(f'{k}="{v}"' for k, v in sorted(labels.items()))
    return "".join(f"{prefix}_{k}{{{of}}} {v}\n" if of else f"{prefix}_{k} {v}\n" for k, v in counts.items())


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(le, n): cumulative counts of values up to each bound; null stands for all."""
    tops = F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double"))
    each = values.groupBy(F.get(tops, sum((F.col(column) > b).cast("int") for b in bounds)).alias("le")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy(F.asc_nulls_last("le")).rowsBetween(Window.unboundedPreceding, 0)  # over as many rows as there are bounds
    return each.withColumn("n", F.sum("n").over(run))
