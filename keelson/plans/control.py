"""Queries: positions, heartbeats, requests, table lists and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import scalars
from keelson.model import chosen_tables
from keelson.operators import lifecycle, progress
from keelson.operators.numbering import numbered
from keelson.plans.registry import query
from keelson.sources import catalog
from keelson.sources.tables import TABLES, table


def _beats(spark: SparkSession, sf: str) -> DataFrame:
    signups = table(spark, sf, "events").where("event_type = 'signup'")
    rows = signups.select(F.concat(F.lit("task"), (F.col("user_id") % 3).cast("string")).alias("task"), "event_id", F.col("ts").cast("timestamp").alias("time"))
    return numbered(rows, ["event_id"], "count", ["task"])


_BEATS = "b AS (SELECT 'task' || user_id % 3 AS task, event_id, ts AS time, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS count FROM events WHERE event_type = 'signup')"


@query(f"WITH {_BEATS} SELECT task, count, CAST(epoch_us(min(time + INTERVAL 1 SECOND * (event_id % 90)) OVER (PARTITION BY task ORDER BY count DESC)) - epoch_us(time) AS BIGINT) AS lag_us FROM b")
def heartbeat_lag(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    applied = b.select("task", "count", F.timestamp_add("SECOND", F.col("event_id") % 90, F.col("time")).alias("apply_time"))
    return progress.heartbeat_lag(b.select("task", "count", "time"), applied).select("task", "count", "lag_us")


@query(f"WITH {_BEATS} SELECT task, max(epoch_us(time)) AS time_us, count(*) AS count FROM b GROUP BY task")
def heartbeat_rows(spark: SparkSession, sf: str) -> DataFrame:
    return progress.heartbeat_writes(_beats(spark, sf)).select("task", F.unix_micros("time").alias("time_us"), "count")


@query(f"WITH {_BEATS}, h AS (SELECT task, max(epoch_us(time)) AS t FROM b GROUP BY task), l AS (SELECT 'task' || n_nationkey % 5 AS task FROM nation GROUP BY ALL), g AS (SELECT l.task, CAST(coalesce(epoch_us(TIMESTAMP '2024-02-01') - h.t, 3600000000) AS BIGINT) AS lag_us FROM l LEFT JOIN h ON l.task = h.task) SELECT *, lag_us < 60000000 AS good FROM g")
def lag_gate(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "nation").select(F.concat(F.lit("task"), (F.col("n_nationkey") % 5).cast("string")).alias("task")).distinct()
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return progress.lag_gate(progress.lag_now(_beats(spark, sf), tasks, now))


def _task(k: str = "n_nationkey") -> F.Column:
    return F.concat(F.lit("task"), F.col(k).cast("string"))


@query("""SELECT 'task' || n AS task, CASE WHEN n % 4 = 0 THEN 'checkpoint' WHEN n % 3 = 0 THEN 'starting_gtid' WHEN n % 3 = 1 THEN 'last_source_gtid' ELSE 'current' END AS origin,
CASE WHEN n % 4 = 0 THEN 'binlog.' || n WHEN n % 3 < 2 THEN '' ELSE 'binlog.999' END AS file, CAST(CASE WHEN n % 4 = 0 THEN n * 100 WHEN n % 3 < 2 THEN 0 ELSE 4 END AS BIGINT) AS position,
CASE WHEN n % 4 = 0 THEN 'source-' || n WHEN n % 3 = 0 THEN 'start-' || n WHEN n % 3 = 1 THEN 'target-' || n ELSE 'current' END AS gtid FROM (SELECT n_nationkey AS n FROM nation)""")
def start_position(spark: SparkSession, sf: str) -> DataFrame:
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    text = k.cast("string")
    tasks = n.select(_task().alias("task"), F.when(k % 3 == 0, F.concat(F.lit("start-"), text)).alias("starting_gtid"), (k % 3 == 1).alias("at_last_source_gtid"))
    checkpoints = n.where(k % 4 == 0).select(_task().alias("task"), F.concat(F.lit("binlog."), text).alias("file"), (k * 100).cast("long").alias("position"), F.concat(F.lit("source-"), text).alias("source_gtid"))
    masters = spark.createDataFrame([("binlog.999", 4, "current")], "file string, position bigint, gtid string")
    last = n.select(_task().alias("task"), F.concat(F.lit("target-"), text).alias("target_gtid"))
    return progress.start_position(tasks, checkpoints, masters, last)


@query("SELECT 'task' || user_id % 3 AS task, 'binlog.' || max(event_id) // 1000 AS file, max(event_id) AS position, CAST(NULL AS VARCHAR) AS source_gtid FROM events GROUP BY user_id % 3")
def checkpoint_state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    commits = e.select(F.concat(F.lit("task"), (F.col("user_id") % 3).cast("string")).alias("task"), F.col("event_id").alias("txn_ordinal"), F.concat(F.lit("binlog."), F.expr("event_id div 1000").cast("string")).alias("file"), F.col("event_id").alias("position"), F.lit(None).cast("string").alias("source_gtid"))
    return progress.checkpoint_state(commits)


@query("SELECT event_id AS id, 'task' || user_id % 3 AS task FROM events WHERE event_type = 'click' AND event_id % 3 <> 0")
def pending_snapshot_requests(spark: SparkSession, sf: str) -> DataFrame:
    clicks = table(spark, sf, "events").where("event_type = 'click'")
    requests = clicks.select(F.col("event_id").alias("id"), F.concat(F.lit("task"), (F.col("user_id") % 3).cast("string")).alias("task"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("started_at"))
    return progress.pending_requests(requests).select("id", "task")


@query("SELECT t AS name FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") v(t) WHERE t NOT IN ('events', 'pages')")
def table_filter(spark: SparkSession, sf: str) -> DataFrame:
    names = [*TABLES, "_keelson_checkpoint", "_keelson_watermark"]
    return spark.createDataFrame([(n,) for n in chosen_tables(names, ignored=["events", "pages"])], "name string")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type")
def replicate_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Only events of known tables are replicated: here each type of event stands for a table."""
    return lifecycle.replicated(table(spark, sf, "events"), ["click"], ["purchase"], "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS name FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def snapshot_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Control tables are never snapshot: here two regions stand for them."""
    return lifecycle.snapshot_tables(table(spark, sf, "region").select(F.col("r_name").alias("name")), "AS.*", ["EUROPE"])


@query("SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def tables_left(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose snapshot isn't done: here nations without a rich supplier."""
    done = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return lifecycle.tables_left(table(spark, sf, "nation"), done, "n_nationkey").select(F.col("n_name").alias("name"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'error')")
def control_tables_not_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of control tables are never written to a target: here two types of event stand for them."""
    return lifecycle.without_control(table(spark, sf, "events"), "click|err.*", "event_type").select("event_id", "event_type")


@query("SELECT event_id AS id, 'task1' AS task FROM events WHERE event_type <> 'error' AND user_id % 3 = 1 AND event_id % 3 <> 0")
def snapshot_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a task in the change log; a time of zero is none, deletions aren't requests."""
    e = table(spark, sf, "events")
    started = F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).when(F.col("event_id") % 3 == 1, F.timestamp_seconds(F.lit(0)))
    row = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("task"), (F.col("user_id") % 3).cast("string")).alias("task"), started.alias("started_at"))
    return lifecycle.requests(e.select(F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("type"), row.alias("row")), "task1")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'before' WHEN event_type = 'click' THEN 'now' END AS started_at FROM events")
def requests_started(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks stand for requests that are started now, unless they were before."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", F.when(F.col("event_id") % 3 == 0, "before").alias("started_at"))
    return lifecycle.marked(e.drop("event_type"), e.where("event_type = 'click'"), "started_at", F.lit("now"))


@query("WITH c AS (SELECT o_orderpriority AS \"table\", o_orderkey AS chunk_id, o_orderpriority < '3' OR (o_orderpriority < '5' AND o_orderkey % 2 = 0) AS done FROM orders) SELECT \"table\", count(*) AS chunks, count(*) FILTER (done) AS done, CASE WHEN count(*) FILTER (done) = 0 THEN 'waiting' WHEN count(*) FILTER (done) < count(*) THEN 'running' ELSE 'done' END AS state FROM c GROUP BY ALL")
def snapshot_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stand for chunks of tables named by priority."""
    tiles = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("table"), F.col("o_orderkey").alias("chunk_id"))
    done = tiles.where("`table` < '3' OR (`table` < '5' AND chunk_id % 2 = 0)")
    return lifecycle.progress(tiles, done.unionByName(done.limit(10)))


@query("SELECT sum(n)::BIGINT AS estimated_rows FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES) + ")")
def estimated_rows_in_all(spark: SparkSession, sf: str) -> DataFrame:
    return estimated_rows(spark, sf).agg(F.sum("estimated_rows").alias("estimated_rows"))


@query("""WITH p AS (SELECT o_orderstatus AS "table", count(*) AS rows, max(o_orderkey % 100 + 1)::DOUBLE AS seconds FROM orders GROUP BY o_orderstatus),
e AS (SELECT o_orderstatus AS "table", CASE o_orderstatus WHEN 'F' THEN 1000000 WHEN 'O' THEN 10 END::BIGINT AS estimated_rows FROM orders GROUP BY o_orderstatus)
SELECT "table", rows, estimated_rows, rows / seconds AS rows_per_second, CASE WHEN estimated_rows > 0 THEN CASE WHEN rows > estimated_rows THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * rows / estimated_rows END END AS percent_done,
CASE WHEN estimated_rows > 0 THEN CASE WHEN rows > estimated_rows THEN 0.0::DOUBLE ELSE (estimated_rows - rows) / (rows / seconds) END END AS seconds_left FROM p JOIN e USING ("table")""")
def throughput_eta(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("table"), F.lit(1).cast("long").alias("rows"), (F.col("o_orderkey") % 100 + 1).cast("double").alias("seconds"))
    estimate = F.when(F.col("table") == "F", 1_000_000).when(F.col("table") == "O", 10).cast("long")
    return progress.throughput(rows, rows.select("table").distinct().withColumn("estimated_rows", estimate))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS estimated_rows FROM {t}" for t in TABLES))
def estimated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """From Parquet's footers: a count reads no column."""
    out = None
    for t in TABLES:
        one = table(spark, sf, t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("estimated_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH b AS (SELECT unnest([10.0, 50.0, 100.0, 300.0]::DOUBLE[]) AS le), a AS (SELECT CASE WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0 WHEN value <= 300 THEN 300.0 END::DOUBLE AS le, count(*) AS n FROM events GROUP BY 1) SELECT le, CAST(sum(n) OVER (ORDER BY le NULLS LAST) AS BIGINT) AS n FROM a")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return progress.histogram(table(spark, sf, "events"), "value", [10, 50, 100, 300])


_FNV = "list_reduce(list_transform(range(1, length(task) + 1), lambda i: CAST(ascii(task[i]) AS BIGINT)), lambda h, b: xor(h * 16777619 % 4294967296, b), CAST(2166136261 AS BIGINT))"


@query(f"SELECT task, {_FNV} AS server_id FROM (SELECT n_name AS task FROM nation)")
def server_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("task"), scalars.server_id(F.col("n_name")).alias("server_id"))


@query("SELECT event_id, CASE WHEN n IN (1022, 1048, 1052, 1062, 1169, 1216, 1217, 1292, 1451, 1452, 1557, 1586, 1761, 1762, 1859) THEN 'constraint' WHEN n = 9007 THEN 'conflict' WHEN n IN (1054, 1146) THEN 'schema' ELSE 'other' END AS class FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 9007 ELSE 1000 + event_id % 900 END AS n FROM events)")
def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.col("event_id") % 10 == 0, 9007).otherwise(1000 + F.col("event_id") % 900)
    return table(spark, sf, "events").select("event_id", scalars.error_class(number).alias("class"))


@query("SELECT p_partkey, CASE WHEN x < 10 THEN printf('%.1f', x) ELSE printf('%.0f', x) END AS said FROM (SELECT p_partkey, p_partkey % 160 / 8.0::DOUBLE + 0.0625 AS x FROM part)")
def numbers_for_people(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_partkey") % 160 / F.lit(8.0) + 0.0625
    return table(spark, sf, "part").select("p_partkey", scalars.humanised(x).alias("said"))


@query("SELECT p_partkey::VARCHAR AS \"table\", coalesce(CAST(round(p_size * 1000 / nullif((p_partkey % 9) * 1.0::DOUBLE, 0)) AS BIGINT), 0) AS estimated_rows FROM part")
def estimated_rows_of_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for tables with lengths of data and of rows."""
    stats = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("table_name"), (F.col("p_size") * 1000).alias("data_length"), (F.col("p_partkey") % 9).alias("avg_row_length"))
    return catalog.estimates(stats)
