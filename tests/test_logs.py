from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keelson.operators import causality, changelog, lifecycle, progress, reconcile

EVENT = "txn_ordinal long, mutation_idx int, row_idx int, type string, before struct<id: long, v: string>, after struct<id: long, v: string>"


def _events(spark, text):
    """`+1:A` insert, `-1` delete, `1>2:B` update, in transactions of their own."""
    out = []
    for i, x in enumerate(text.split()):
        if x[0] == "+":
            k, v = x[1:].split(":")
            out.append((i, 0, 0, "insert", None, (int(k), v)))
        elif x[0] == "-":
            out.append((i, 0, 0, "delete", (int(x[1:]), None), None))
        else:
            a, b = x.split(">")
            k, v = b.split(":")
            out.append((i, 0, 0, "update", (int(a), None), (int(k), v)))
    return spark.createDataFrame(out, EVENT)


@pytest.mark.parametrize("log,wanted", [("", ["9:Z"]), ("+1:A", ["1:A", "9:Z"]), ("+1:A -1", ["9:Z"]), ("+1:A 1>1:B", ["1:B", "9:Z"]), ("+1:A 1>2:B", ["2:B", "9:Z"]), ("+1:A 1>2:B +1:C", ["1:C", "2:B", "9:Z"]), ("9>9:Y -9", []), ("5>5:N", ["5:N", "9:Z"])])
def test_apply(spark, log, wanted):
    target = spark.createDataFrame([(9, "Z")], "id long, v string")
    events = _events(spark, log)
    said = lambda df: sorted(f"{r['id']}:{r['v']}" for r in df.collect())
    once = changelog.apply_log(target, events, ["id"])
    assert said(once) == wanted
    assert said(changelog.apply_log(once, events, ["id"])) == wanted
    first, rest = events.where("txn_ordinal < 1"), events.where("txn_ordinal >= 1")
    assert said(changelog.apply_log(changelog.apply_log(target, first, ["id"]), rest, ["id"])) == wanted


def test_row_images_pair_up(spark):
    rows = spark.createDataFrame([(1, "update", [1, 2, 3, 4]), (2, "insert", [5]), (3, "delete", [6]), (4, "insert", [])], "id long, type string, rows array<int>")
    got = sorted((r["id"], r["row_idx"], r["before"], r["after"]) for r in changelog.pair_images(rows).collect() if r["id"] == 1)
    assert got == [(1, 0, 1, 2), (1, 1, 3, 4)]
    assert changelog.pair_images(rows).count() == 4
    assert spark.range(1).select(changelog.mutation_type(F.lit("UPDATE_ROWS_EVENTv1"))).first()[0] == "update"
    assert spark.range(1).select(changelog.mutation_type(F.lit("QUERY_EVENT"))).first()[0] is None


RECONCILE = [
    ("5", "-11", "5"), ("5", "-5", ""), ("5", "+6:n", "5 6n"), ("6", "+5:n", "5n 6"), ("5 7", "+6:n", "5 6n 7"), ("5 7", "+6:n +7:n", "5 6n 7n"), ("6 7", "6>6:n 11>11:n", "6n 7"),
]


@pytest.mark.parametrize("snapshot,log,wanted", RECONCILE)
def test_reconcile_a_chunk_of_5_to_11(spark, snapshot, log, wanted):
    changes = changelog.images(_events(spark, log), ["id"]).withColumn("chunk_id", F.when((F.col("id") >= 5) & (F.col("id") < 11), 1).otherwise(2).cast("long"))
    windows = spark.createDataFrame([(1, -1, 100)], "chunk_id long, low long, high long")
    reads = spark.createDataFrame([(1, int(x), (int(x), "")) for x in snapshot.split()], "chunk_id long, id long, row struct<id: long, v: string>")
    got = reconcile.reconcile(reads, changes, windows, ["id"]).select("row.*").collect()
    assert " ".join(f"{k}{v}" for k, v in sorted(got)) == wanted
    outside = {r["id"] for r in reconcile.passthrough(changes, windows).collect()}
    assert outside == ({11} if "11" in log else set())


def test_watermarks(spark):
    marks = spark.createDataFrame([(1, "a", "t", 0, 1, 0), (5, "a", "t", 0, 0, 1), (2, "a", "t", 1, 1, 0), (3, "b", "t", 2, 1, 0)], "txn_ordinal long, task string, table_name string, chunk_seq long, low int, high int")
    assert [tuple(r) for r in reconcile.windows(marks, "a").collect()] == [("t", 0, 1, 5)]
    known = spark.createDataFrame([("t", 0), ("t", 1)], "table_name string, chunk_seq long")
    assert [r["chunk_seq"] for r in reconcile.late(marks, known).collect()] == [2]


def test_watermark_passes_and_events(spark):
    kind = "txn_ordinal long, task string, table_name string, chunk_seq long, low int, high int"
    marks = spark.createDataFrame([(1, "a", "t", 0, 1, 0), (2, "a", "t", 0, 0, 1), (5, "a", "t", 0, 1, 0), (7, "a", "t", 0, 1, 0), (9, "a", "t", 0, 0, 1), (11, "a", "t", 0, 1, 0), (3, "a", "t", 1, 0, 1)], kind)
    assert [tuple(r) for r in reconcile.windows(marks, "a").collect()] == [("t", 0, 7, 9)]
    row = "struct<task: string, table_name: string, chunk_seq: long, low: int, high: int>"
    events = spark.createDataFrame([(1, "insert", [("a", "t", 0, 1, 0)]), (2, "delete", [("a", "t", 0, 1, 0)]), (3, "insert", [("b", "t", 0, 1, 0)])], f"txn_ordinal long, type string, rows array<{row}>")
    own, other = reconcile.watermarks(events, "a")
    assert [r["txn_ordinal"] for r in own.collect()] == [1] and [r["txn_ordinal"] for r in other.collect()] == [3]
    with pytest.raises(Exception, match="more than one row"):
        reconcile.watermarks(events.withColumn("rows", F.array_repeat(F.get("rows", F.lit(0)), 2)), "a")[0].collect()


def test_snapshot_lifecycle(spark):
    tables = spark.createDataFrame([("a",), ("b",), ("_keelson_watermark",)], "name string")
    assert [r[0] for r in lifecycle.snapshot_tables(tables, ignored=["b"]).collect()] == ["a"]
    tiles = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "table string, chunk_id long")
    done = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("z", 9)], "table string, chunk_id long")
    assert {tuple(r) for r in lifecycle.progress(tiles, done).collect()} == {("a", 2, 1, "running"), ("b", 1, 1, "done"), ("c", 1, 0, "waiting")}
    asked = spark.createDataFrame([(1, None), (2, "x")], "id long, completed_at string")
    got = lifecycle.marked(asked, spark.range(1, 3), "completed_at", F.lit("now"))
    assert dict(got.collect()) == {1: "now", 2: "x"}
    lags = spark.createDataFrame([("a", 5_000_000), ("b", 70_000_000), ("c", 0)], "task string, lag_us long")
    assert [r[0] for r in lifecycle.to_start(lags, spark.createDataFrame([("c",)], "task string"), 60).collect()] == ["a"]
    order = [r[0] for r in lifecycle.shuffled(spark.range(50).toDF("id"), 3).collect()]
    assert sorted(order) == list(range(50)) != order and order == [r[0] for r in lifecycle.shuffled(spark.range(50).toDF("id"), 3).collect()]
    events = spark.createDataFrame([("a", 1), ("_keelson_watermark", 2), ("z", 3)], "table_name string, n long")
    assert [r["n"] for r in lifecycle.replicated(events, ["a"], ["_keelson_watermark"]).orderBy("n").collect()] == [1, 2]
    assert [r["n"] for r in lifecycle.without_control(events).orderBy("n").collect()] == [1, 3]


CAUSAL = [
    ("T1", [[0]]), ("T1 T1", [[0, 1]]), ("T1 T2", [[0], [1]]), ("R0-10 T2", [[0, 1]]), ("R0-10 T11", [[0], [1]]), ("R0-10 R10-20", [[0], [1]]),
    ("R0-10 T5,15 R10-20", [[0, 1, 2]]), ("T1 T1 T2 T1,2", [[0, 1, 2, 3]]), ("R- T3", [[0, 1]]), ("T1 T2 T3 T2,3", [[0], [1, 2, 3]]),
]


@pytest.mark.parametrize("text,wanted", CAUSAL)
def test_causal_sequences(spark, text, wanted):
    keys, repairs = [], []
    for i, x in enumerate(text.split()):
        if x[0] == "T":
            keys += [(0, i, "t", int(k)) for k in x[1:].split(",")]
        else:
            a, b = x[1:].split("-")
            repairs.append((0, i, "t", int(a) if a else None, int(b) if b else None))
    k = spark.createDataFrame(keys, "batch long, txn long, table string, key long")
    r = spark.createDataFrame(repairs, "batch long, txn long, table string, start long, end long")
    got: dict[int, list[int]] = {}
    for row in sorted(causality.sequences(causality.touches(k, r)).collect(), key=lambda x: x["txn"]):
        got.setdefault(row["sequence"], []).append(row["txn"])
    assert list(got.values()) == wanted


def test_causal_tables_and_composite_keys_are_apart(spark):
    k = spark.createDataFrame([(0, 0, "a", (11, 0)), (0, 1, "b", (11, 0)), (0, 2, "a", (5, 1)), (1, 3, "a", (5, 1))], "batch long, txn long, table string, key struct<x: long, y: long>")
    r = spark.createDataFrame([(0, 4, "a", (0, 0), (10, 0)), (0, 5, "a", (10, 0), (20, 0))], "batch long, txn long, table string, start struct<x: long, y: long>, end struct<x: long, y: long>")
    got = {x["txn"]: x["sequence"] for x in causality.sequences(causality.touches(k, r)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2, 5: 0}
    assert {x["txn"]: x["pk_set"] for x in causality.printable_keys(causality.touches(k)).collect()}[3].startswith("a:")


def test_counts_as_rows_pass(spark):
    rows, seen = progress.observed(spark.createDataFrame([("insert",), ("insert",), ("delete",), ("other",)], "type string"), "writes")
    assert rows.count() == 4 and seen.get == {"rows": 4, "insert": 2, "update": 0, "delete": 1}
    assert progress.exposed({"rows": 4}, "keelson", table="t") == 'keelson_rows{table="t"} 4\n' and progress.exposed({"x": 1}, "k") == "k_x 1\n"


def test_heartbeats(spark):
    w = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("a", 3, 20)], "task string, count long, s long").selectExpr("task", "count", "timestamp_seconds(s) as time")
    a = spark.createDataFrame([("a", 1, 5), ("a", 3, 21)], "task string, count long, s long").selectExpr("task", "count", "timestamp_seconds(s) as apply_time")
    assert [r["lag_us"] for r in progress.heartbeat_lag(w, a).orderBy("count").collect()] == [5_000_000, 11_000_000, 1_000_000]
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    lags = progress.lag_gate(progress.lag_now(w, tasks, F.timestamp_seconds(F.lit(50)))).orderBy("task").collect()
    assert [(r["lag_us"], r["good"]) for r in lags] == [(30_000_000, True), (3_600_000_000, False)]
