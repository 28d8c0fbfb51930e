"""Queries: change logs, watermark reconciliation and causal sequences, as batches and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keelson.model import TableSpec
from keelson.operators import causality, changelog, reconcile
from keelson.operators.diff import flat
from keelson.plans.inputs import LOG_SQL, SEED_SQL, diff_sql, log, seed
from keelson.plans.registry import query
from keelson.sources.shared import fresh_dir, move
from keelson.sources.tables import table
from keelson.streaming.apply import VersionedTable, apply_stream, passthrough_stream, reconcile_stream, state_store

_KEY = ["user_id"]


@query("SELECT event_id, CAST(row_idx AS INTEGER) AS row_idx, CASE WHEN event_type IN ('signup') THEN NULL ELSE (CASE WHEN event_type = 'error' THEN value + row_idx ELSE value + 2 * row_idx END) END AS before, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN value + row_idx ELSE value + 2 * row_idx + 1 END AS after FROM events, range(2) r(row_idx)")
def pair_update_images(spark: SparkSession, sf: str) -> DataFrame:
    """Each event has the images of two rows: pairs of them for updates."""
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "signup", "WRITE_ROWS_EVENTv1").when(F.col("event_type") == "error", "DELETE_ROWS_EVENTv2").otherwise("UPDATE_ROWS_EVENTv0")
    rows = e.select("event_id", changelog.mutation_type(name).alias("type"), "value")
    rows = rows.withColumn("rows", F.transform(F.sequence(F.lit(0), F.when(F.col("type") == "update", 3).otherwise(1)), lambda i: F.col("value") + i))
    return changelog.pair_images(rows).select("event_id", "row_idx", "before", "after")


@query(f"WITH {LOG_SQL} SELECT txn_ordinal, count(*) AS n_mutations, string_agg(kind, ',' ORDER BY mutation_idx) AS types, max(event_id) AS log_pos FROM e GROUP BY txn_ordinal")
def assemble_transactions(spark: SparkSession, sf: str) -> DataFrame:
    found = changelog.transactions(log(spark, sf))
    return found.select("txn_ordinal", "n_mutations", F.array_join(F.col("mutations.type"), ",").alias("types"), "log_pos")


@query(f"WITH {LOG_SQL} SELECT txn_ordinal // 100 AS batch, count(DISTINCT txn_ordinal) AS transactions, count(*) AS mutations FROM e GROUP BY ALL")
def txn_microbatches(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.microbatches(log(spark, sf)).groupBy("batch").agg(F.count_distinct("txn_ordinal").alias("transactions"), F.count(F.lit(1)).alias("mutations"))


@query(f"WITH {LOG_SQL}, f AS (SELECT txn_ordinal, epoch_us(min(ts)) // 7200000000 AS span FROM e GROUP BY 1), p AS (SELECT *, (row_number() OVER (PARTITION BY span ORDER BY txn_ordinal) - 1) // 2 AS part FROM f) SELECT span, part, count(*) AS transactions FROM p GROUP BY ALL")
def txn_microbatches_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """At most two transactions, of two hours."""
    times = table(spark, sf, "events").select(F.col("event_id").alias("log_pos"), F.col("ts").cast("timestamp").alias("time"))
    found = changelog.microbatches_by_time(log(spark, sf).join(times, "log_pos"), 7200, 2)
    return found.groupBy("span", "part").agg(F.count_distinct("txn_ordinal").alias("transactions"))


@query("WITH r AS (SELECT event_id AS a, lead(event_id) OVER (ORDER BY event_id) AS b FROM events WHERE event_id % 500 = 0) SELECT event_id, 'log.' || a // 500 AS file, CASE WHEN event_id = a THEN 4 ELSE event_id * 10 END AS position FROM events LEFT JOIN r ON event_id >= a AND (b IS NULL OR event_id < b)")
def log_positions(spark: SparkSession, sf: str) -> DataFrame:
    """One event in five hundred stands for a rotation."""
    k = F.col("event_id")
    turn = k % 500 == 0
    events = table(spark, sf, "events").select("event_id", F.when(turn, "rotate").otherwise("rows").alias("type"), F.when(turn, F.concat(F.lit("log."), F.expr("event_id div 500").cast("string"))).alias("next_file"), F.when(turn, F.lit(4)).cast("long").alias("next_position"), (k * 10).alias("log_pos"))
    return changelog.positions(events, "event_id").select("event_id", "file", "position")


_LAST = "l AS (SELECT user_id, arg_max(kind, event_id) AS kind, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM e GROUP BY user_id)"
_APPLIED = f"WITH {LOG_SQL}, {SEED_SQL}, {_LAST} SELECT user_id, event_type, value FROM l WHERE kind <> 'delete' UNION ALL SELECT * FROM seed WHERE user_id NOT IN (SELECT user_id FROM l)"


@query(_APPLIED)
def apply_changelog(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.apply_log(seed(spark, sf), log(spark, sf), _KEY)


_MOVED = 100_000_000


@query(f"""WITH {LOG_SQL}, {SEED_SQL}, c AS (
SELECT user_id + CASE WHEN event_type = 'purchase' THEN {_MOVED} ELSE 0 END AS user_id, event_id * 2 + 1 AS pos, kind <> 'delete' AS live, event_type, value FROM e
UNION ALL SELECT user_id, event_id * 2, false, event_type, value FROM e WHERE event_type = 'purchase'),
l AS (SELECT user_id, arg_max(live, pos) AS live, arg_max(event_type, pos) AS event_type, arg_max(value, pos) AS value FROM c GROUP BY user_id)
SELECT user_id, event_type, value FROM l WHERE live UNION ALL SELECT * FROM seed WHERE user_id NOT IN (SELECT user_id FROM l)""")
def apply_changelog_pk_update(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases move their user to another key: the old one goes."""
    events, moves = log(spark, sf), F.col("after.event_type") == "purchase"
    old = F.struct(F.col("after.user_id").alias("user_id"), F.col("after.event_type").alias("event_type"), F.col("after.value").alias("value"))
    new = F.struct((F.col("after.user_id") + _MOVED).alias("user_id"), F.col("after.event_type").alias("event_type"), F.col("after.value").alias("value"))
    events = events.withColumn("before", F.when(moves, old).otherwise(F.col("before"))).withColumn("after", F.when(moves, new).otherwise(F.col("after")))
    return changelog.apply_log(seed(spark, sf), events, _KEY)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = changelog.images(log(spark, sf), _KEY)
    return changes.withColumn("chunk_id", F.expr("user_id div 20"))


def _windows(changes: DataFrame) -> DataFrame:
    return changes.select("chunk_id").distinct().select("chunk_id", (F.col("chunk_id") * 40 + 100).alias("low"), (F.col("chunk_id") * 40 + 130).alias("high"))


def _reads(changes: DataFrame) -> DataFrame:
    """Each chunk as a read in the middle of its window saw it."""
    seen = changes.where(F.col("order.txn_ordinal") <= F.col("chunk_id") * 40 + 115)
    return changelog.net(seen, ["chunk_id", *_KEY]).where("live").select("chunk_id", *_KEY, "row")


_AT_HIGH = "h AS (SELECT user_id // 20 AS chunk_id, user_id, arg_max(kind, event_id) AS kind, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM e WHERE txn_ordinal <= 130 + 40 * (user_id // 20) GROUP BY ALL)"
_RECONCILED = f"WITH {LOG_SQL}, {_AT_HIGH} SELECT chunk_id, user_id, event_type, value FROM h WHERE kind <> 'delete'"


@query(_RECONCILED)
def reconcile_chunks(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf)
    return reconcile.reconcile(_reads(changes), changes, _windows(changes), _KEY).select("chunk_id", "row.*")


@query(f"WITH {LOG_SQL} SELECT user_id, txn_ordinal AS at, kind <> 'delete' AS live FROM e WHERE NOT (txn_ordinal > 100 + 40 * (user_id // 20) AND txn_ordinal <= 130 + 40 * (user_id // 20))")
def stream_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """The changes that no open chunk takes in, as a stream of them."""
    changes = _changes(spark, sf)
    rows = changes.select("chunk_id", F.col("order.txn_ordinal").alias("at"), "user_id", "live")
    out, progress = fresh_dir(spark, "forwarded"), fresh_dir(spark, "progress")
    forwarded = lambda stream: passthrough_stream(stream, _windows(changes)).select("user_id", "at", "live")
    _run_arrivals(spark, rows, "at", lambda stream: forwarded(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append"))
    return spark.read.schema(forwarded(rows).schema).parquet(out)


@query(f"WITH {LOG_SQL} SELECT user_id, txn_ordinal, CAST(mutation_idx AS INTEGER) AS mutation_idx, kind <> 'delete' AS live FROM e WHERE NOT (txn_ordinal > 100 + 40 * (user_id // 20) AND txn_ordinal <= 130 + 40 * (user_id // 20))")
def reconcile_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf)
    return reconcile.passthrough(changes, _windows(changes)).select("user_id", "order.txn_ordinal", "order.mutation_idx", "live")


def _watermarks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "events").select(F.expr("user_id div 20").alias("chunk_seq")).distinct()
    side = F.explode(F.array(F.lit(1), F.lit(0))).alias("low")
    return chunks.select("chunk_seq", side).select(
        F.when(F.col("chunk_seq") % 7 == 6, "other").otherwise("main").alias("task"), F.lit("events").alias("table_name"), "chunk_seq", "low", (1 - F.col("low")).alias("high"), (F.col("chunk_seq") * 40 + 130 - F.col("low") * 30).alias("txn_ordinal")
    )


_MARKS = "m AS (SELECT CASE WHEN chunk_seq % 7 = 6 THEN 'other' ELSE 'main' END AS task, chunk_seq, low, 1 - low AS high, chunk_seq * 40 + 130 - low * 30 AS txn_ordinal FROM (SELECT DISTINCT user_id // 20 AS chunk_seq FROM events), (VALUES (0), (1)) v(low))"


@query(f"WITH {_MARKS} SELECT 'events' AS table_name, chunk_seq, min(txn_ordinal) AS low, max(txn_ordinal) AS high FROM m WHERE task = 'main' GROUP BY chunk_seq")
def watermark_windows(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.windows(_watermarks(spark, sf), "main")


@query(f"WITH {_MARKS} SELECT chunk_seq, min(txn_ordinal) AS low, max(txn_ordinal) AS high FROM m WHERE task = 'main' GROUP BY chunk_seq")
def watermark_windows_of_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk had a pass before, 50 transactions earlier, and a low watermark of one that was never ended: the last pass counts."""
    marks = _watermarks(spark, sf)
    earlier = marks.withColumn("txn_ordinal", F.col("txn_ordinal") - 50)
    broken = marks.where("low = 1").withColumn("txn_ordinal", F.col("txn_ordinal") - 5)
    return reconcile.windows(marks.unionByName(earlier).unionByName(broken), "main").select("chunk_seq", "low", "high")


@query("SELECT event_id AS txn_ordinal, user_id AS chunk_seq, CAST(event_id % 2 AS INTEGER) AS low FROM events WHERE event_type <> 'error' AND user_id % 3 = 0")
def watermark_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the watermark table: deletions say nothing, those of other tasks are forwarded."""
    side = (F.col("event_id") % 2).cast("int")
    row = F.struct(F.concat(F.lit("task"), (F.col("user_id") % 3).cast("string")).alias("task"), F.lit("t").alias("table_name"), F.col("user_id").alias("chunk_seq"), side.alias("low"), (1 - side).alias("high"))
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    events = table(spark, sf, "events").select(F.col("event_id").alias("txn_ordinal"), kind.alias("type"), F.array(row).alias("rows"))
    return reconcile.watermarks(events, "task0")[0].select("txn_ordinal", "chunk_seq", "low")


@query(f"WITH {_MARKS} SELECT chunk_seq, txn_ordinal FROM m WHERE chunk_seq % 3 = 0")
def late_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    marks = _watermarks(spark, sf)
    known = marks.where(F.col("chunk_seq") % 3 != 0).select("table_name", "chunk_seq").distinct()
    return reconcile.late(marks, known).select("chunk_seq", "txn_ordinal")


@query(diff_sql(f"{LOG_SQL}, {_AT_HIGH}, {SEED_SQL}, s AS (SELECT user_id, event_type, value FROM h WHERE kind <> 'delete'), t AS (SELECT * FROM seed WHERE user_id // 20 IN (SELECT DISTINCT user_id // 20 FROM e))", ("user_id",), ("user_id", "event_type", "value")))
def repair_mutations(spark: SparkSession, sf: str) -> DataFrame:
    """What makes the target's chunks equal to the reconciled ones."""
    changes = _changes(spark, sf)
    windows = _windows(changes)
    snapshot = reconcile.reconcile(_reads(changes), changes, windows, _KEY)
    target = seed(spark, sf).withColumn("chunk_id", F.expr("user_id div 20"))
    return flat(reconcile.repairs(snapshot, target, windows, TableSpec("users", ("user_id",))))


@query("SELECT DISTINCT user_id // 20 AS chunk_id, user_id // 20 // 3 AS round FROM events")
def admitted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.admitted(_changes(spark, sf).select("chunk_id").distinct(), 3)


def _keys_of(spark: SparkSession, sf: str) -> DataFrame:
    txn = F.expr("o_orderkey div 2")
    return table(spark, sf, "orders").select(F.expr("(o_orderkey div 2) div 100").alias("batch"), txn.alias("txn"), F.lit("orders").alias("table"), F.col("o_custkey").alias("key"))


_ORDER_KEYS = "k AS (SELECT (o_orderkey // 2) // 100 AS batch, o_orderkey // 2 AS txn, o_custkey AS key FROM orders)"
_CLOSURE = "r AS (SELECT batch, x AS txn, x AS seq FROM p UNION SELECT p.batch, p.y, r.seq FROM r JOIN p ON p.batch = r.batch AND p.x = r.txn) SELECT batch, txn, min(seq) AS sequence FROM r GROUP BY ALL"


@query(f"WITH RECURSIVE {_ORDER_KEYS}, p AS (SELECT DISTINCT a.batch, a.txn AS x, b.txn AS y FROM k a JOIN k b ON a.batch = b.batch AND a.key = b.key), {_CLOSURE}")
def causal_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return causality.sequences(causality.touches(_keys_of(spark, sf)))


_REPAIRS = "c AS (SELECT batch, 1000000000 + batch * 10 + j AS txn, ((batch * 7 + j * 13) % 15) * 100 AS s, ((batch * 7 + j * 13) % 15) * 100 + 40 AS e FROM (SELECT DISTINCT batch FROM k), (VALUES (0), (1)) v(j))"


@query(f"WITH RECURSIVE {_ORDER_KEYS}, {_REPAIRS}, t AS (SELECT batch, txn, key FROM k UNION SELECT c.batch, c.txn, k.key FROM c JOIN k ON k.batch = c.batch AND k.key >= c.s AND k.key < c.e), p AS (SELECT DISTINCT a.batch, a.txn AS x, b.txn AS y FROM t a JOIN t b ON a.batch = b.batch AND a.key = b.key UNION SELECT batch, txn, txn FROM c), {_CLOSURE}")
def causal_with_repairs(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys_of(spark, sf)
    start = (F.col("batch") * 7 + F.col("j") * 13) % 15 * 100
    repairs = keys.select("batch").distinct().select("batch", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    repairs = repairs.select("batch", (F.lit(1_000_000_000) + F.col("batch") * 10 + F.col("j")).alias("txn"), F.lit("orders").alias("table"), start.alias("start"), (start + 40).alias("end"))
    return causality.sequences(causality.touches(keys, repairs))


@query(f"WITH {_ORDER_KEYS} SELECT txn, string_agg('orders:' || key, ',' ORDER BY 'orders:' || key) AS pk_set FROM (SELECT DISTINCT txn, key FROM k) GROUP BY txn")
def pk_set_per_txn(spark: SparkSession, sf: str) -> DataFrame:
    return causality.printable_keys(causality.touches(_keys_of(spark, sf)))


def _run_arrivals(spark: SparkSession, rows: DataFrame, ordinal: str, writer: Callable[[DataFrame], DataStreamWriter], arrivals: int = 6) -> None:
    """Run a stream over a change log's folder while it grows by arrivals, which follow the ordinals.

    All arrivals are written in one pass, by as many tasks as rows has, beside the log; each is renamed into it when the stream is
    done with those before. So an arrival is one micro-batch, however many files it has, and the state stores are opened once."""
    where, beside = fresh_dir(spark, "log"), fresh_dir(spark, "arrivals")
    top = rows.agg(F.max(ordinal)).first()[0] or 0
    rows.withColumn("__arrival", F.expr(f"{ordinal} div {top // arrivals + 1}")).write.partitionBy("__arrival").parquet(beside)
    arrived = lambda i: move(spark, f"{beside}/__arrival={i}", f"{where}/{i}")
    if not arrived(0):
        rows.limit(0).write.parquet(f"{where}/0")
    running = writer(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(where)).start()
    try:
        running.processAllAvailable()
        for i in range(1, arrivals):
            if arrived(i):
                running.processAllAvailable()
    finally:
        running.stop()


@query(_APPLIED)
def stream_apply(spark: SparkSession, sf: str) -> DataFrame:
    events = log(spark, sf)
    state = VersionedTable(spark, fresh_dir(spark, "state"), _KEY, buckets=4)
    state.start(seed(spark, sf))
    progress = fresh_dir(spark, "progress")
    _run_arrivals(spark, events, "txn_ordinal", lambda stream: apply_stream(stream, state, _KEY, progress))
    return state.latest()


@query(_RECONCILED)
def stream_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Watermarks, chunk reads and changes in one log of six arrivals, so that windows straddle micro-batches."""
    changes = _changes(spark, sf)
    windows, late = _windows(changes), F.lit(1 << 40)
    text = F.to_json("row")
    none = F.lit(None).cast("string")
    # chunks whose window lies beyond the log's end stay open: a last high watermark closes them
    rows = (
        changes.select("chunk_id", F.col("order.txn_ordinal").alias("at"), F.col("order.mutation_idx").cast("long").alias("part"), F.lit("change").alias("kind"), F.col("user_id").cast("string").alias("key"), "live", text.alias("row"))
        .unionByName(_reads(changes).select("chunk_id", (F.col("chunk_id") * 40 + 115).alias("at"), F.lit(-1).cast("long").alias("part"), F.lit("read").alias("kind"), F.col("user_id").cast("string").alias("key"), F.lit(True).alias("live"), text.alias("row")))
        .unionByName(windows.select("chunk_id", F.col("low").alias("at"), late.alias("part"), F.lit("low").alias("kind"), none.alias("key"), F.lit(None).cast("boolean").alias("live"), none.alias("row")))
        .unionByName(windows.select("chunk_id", F.col("high").alias("at"), late.alias("part"), F.lit("high").alias("kind"), none.alias("key"), F.lit(None).cast("boolean").alias("live"), none.alias("row")))
    )
    out, progress = fresh_dir(spark, "chunks"), fresh_dir(spark, "progress")
    with state_store(spark):
        _run_arrivals(spark, rows, "at", lambda stream: reconcile_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append"))
    found = spark.read.schema("chunk_id long, key string, row string").parquet(out)
    return found.select("chunk_id", F.from_json("row", "user_id long, event_type string, value double").alias("r")).select("chunk_id", "r.*")
