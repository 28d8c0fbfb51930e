from __future__ import annotations

import json
import logging

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from keelson import commands
from keelson.functions import scalars
from keelson.model import TableSpec
from keelson.plans.inputs import CUSTOMER, ORDERS
from keelson.sources import catalog, jdbc
from keelson.streaming.apply import VersionedTable, apply_batch, supervise

DIR = "/root/testdata/sf0.001"


def test_clone_then_checksum(spark, tmp_path, capsys):
    target, out = str(tmp_path / "target"), str(tmp_path / "out")
    for p in (ORDERS, CUSTOMER):
        p.target(spark, DIR).write.parquet(f"{target}/{p.name}.parquet")
    specs = [TableSpec("orders", ("o_orderkey",)), TableSpec("customer", ("c_custkey",))]
    before = {(r["table"], r["type"]) for r in commands.checksum(spark, DIR, target, specs).collect()}
    assert {t for t, _ in before} == {"orders", "customer"}
    assert commands.checksum(spark, DIR, target, specs, repair_to=str(tmp_path / "fixed")).isEmpty()
    assert not commands.clone(spark, DIR, out, specs, target).isEmpty()
    assert commands.checksum(spark, DIR, out, specs).isEmpty()
    only_new = str(tmp_path / "new")
    commands.clone(spark, DIR, only_new, specs, target, no_diff=True)
    assert {r["type"] for r in commands.checksum(spark, DIR, only_new, specs).collect()} == {"update", "delete"}
    config = tmp_path / "c.toml"
    config.write_text('[tables.customer]\nkeys = ["c_custkey"]\nignore_columns = ["c_acctbal", "c_mktsegment"]\n')
    assert commands.main(["checksum", "--source", DIR, "--target", target, "--config", str(config)]) == 1
    assert "update" not in {json.loads(x)["type"] for x in capsys.readouterr().out.splitlines()}
    assert commands.ping(spark).count() == 1


def test_no_diff_clone_with_ignored_columns(spark, tmp_path):
    """New rows have nulls in ignored columns, and the rows that were there stay whole."""
    target, out = str(tmp_path / "target"), str(tmp_path / "out")
    CUSTOMER.target(spark, DIR).write.parquet(f"{target}/customer.parquet")
    spec = TableSpec("customer", ("c_custkey",), ignore_columns=("c_acctbal",))
    commands.clone(spark, DIR, out, [spec], target, no_diff=True)
    got, before = spark.read.parquet(f"{out}/customer.parquet"), CUSTOMER.target(spark, DIR)
    new = got.join(before, "c_custkey", "left_anti")
    assert got.join(before, before.columns).count() == before.count() and got.columns == before.columns
    assert new.count() > 0 and new.where("c_acctbal IS NOT NULL").isEmpty() and new.where("c_name IS NULL").isEmpty()


def test_keys_and_tables_are_found(spark, tmp_path, capsys):
    assert "lineitem" in catalog.folder_tables(spark, DIR)
    assert catalog.find_key(spark.read.parquet(f"{DIR}/orders.parquet")) == ("o_orderkey",)
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, None)], "a long, b long, c string")
    assert catalog.find_key(rows) == ("a", "b")
    with pytest.raises(ValueError):
        catalog.find_key(rows.unionByName(rows))
    target = str(tmp_path / "t")
    CUSTOMER.target(spark, DIR).write.parquet(f"{target}/customer.parquet")
    assert commands.main(["checksum", "--source", DIR, "--target", target, "--table", "customer"]) == 1
    assert {json.loads(x)["type"] for x in capsys.readouterr().out.splitlines()} == {"insert", "update", "delete"}


def test_information_schema(spark):
    columns = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("a", "k", 1)], "table_name string, column_name string, ordinal_position int")
    keys = spark.createDataFrame([("b", "y", 1), ("b", "x", 2), ("a", "k", 1)], "table_name string, column_name string, ordinal_position int")
    assert [(s.name, s.keys) for s in catalog.specs(columns, keys)] == [("a", ("k",)), ("b", ("y", "x"))]
    with pytest.raises(ValueError, match="b"):
        catalog.specs(columns, keys.where("table_name = 'a'"))
    assert "'it''s'" in catalog.subquery("keys", "it's")
    stats = spark.createDataFrame([("a", 50, 9), ("b", None, 0), ("c", 45, 10)], "table_name string, data_length long, avg_row_length long")
    assert [tuple(r) for r in catalog.estimates(stats).orderBy("table").collect()] == [("a", 6), ("b", 0), ("c", 5)]


def test_small_functions(spark):
    one = spark.createDataFrame([("task", 1062, 9.96), ("", 9007, 9.5), ("é", 1146, 1234.6), (None, 7, 10.0)], "t string, n int, x double")
    got = one.select(scalars.server_id(F.col("t")), scalars.error_class(F.col("n")), scalars.humanised(F.col("x"))).collect()

    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = h * 16777619 % 2**32 ^ b
        return h

    assert [r[0] for r in got] == [fnv("task"), fnv(""), fnv("é"), None]
    assert [r[1] for r in got] == ["constraint", "conflict", "schema", "other"] and [r[2] for r in got] == ["10.0", "9.5", "1235", "10"]
    assert scalars.quoted(["a", "b`c"]) == "`a`, `b``c`"


def test_clusters_secrets_and_tls():
    config = {"c": {"reader": {"host": "r", "type": "TIDB", "database": "d"}, "writer": {"host": "w", "port": 1234, "database": "d", "trust_certificate_key_store_url": "file:/t"}}}
    r, w = jdbc.Database.of_cluster(config, reader=True), jdbc.Database.of_cluster(config, database="e")
    assert "r:4000/d" in r.options()["url"] and "w:1234/e" in w.options()["url"] and "trustCertificateKeyStoreUrl=file%3A%2Ft" in w.options()["url"]
    with pytest.raises(ValueError):
        jdbc.Database.of_cluster({})
    now, given = [0.0], iter(["one", "two"])
    secret = jdbc.Secret(lambda: next(given), 10, lambda: now[0])
    assert [secret(), secret()] == ["one", "one"]
    now[0] = 11.0
    assert jdbc.Database("h", password=secret).options()["password"] == "two"


def test_dry_runs_write_nothing(spark, tmp_path, caplog):
    target = str(tmp_path / "t")
    CUSTOMER.target(spark, DIR).write.parquet(f"{target}/customer.parquet")
    out = tmp_path / "out"
    found = commands.clone(spark, DIR, str(out), [TableSpec("customer", ("c_custkey",))], target, dry_run=True)
    assert {r["type"] for r in found.collect()} == {"insert", "update", "delete"} and not out.exists()
    line = json.loads(commands.JsonLines().format(logging.LogRecord("keelson", logging.INFO, "f", 1, "copied %s", ("t",), None)))
    assert line["message"] == "copied t" and line["timestamp"].endswith("Z") and line["level"] == "info"


EVENT = "txn_ordinal long, mutation_idx int, row_idx int, type string, before struct<id: long, v: string>, after struct<id: long, v: string>"


def _log(spark, where, events):
    rows = [(i, 0, 0, kind, (k, None) if kind == "delete" else None, None if kind == "delete" else (k, v)) for i, kind, k, v in events]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(where)


def test_replicate_goes_on_where_it_ended(spark, tmp_path, capsys):
    log, out, spec = str(tmp_path / "log"), str(tmp_path / "out"), TableSpec("t", ("id",))
    said = lambda df: sorted(f"{r['id']}:{r['v']}" for r in df.collect())
    _log(spark, log, [(0, "insert", 1, "A"), (1, "insert", 2, "B")])
    assert said(commands.replicate(spark, log, out, spec, buckets=3)) == ["1:A", "2:B"]
    _log(spark, log, [(2, "update", 1, "C"), (3, "delete", 2, None), (4, "insert", 5, "E")])
    assert commands.main(["replicate", "--source", log, "--out", out, "--table", "t=id"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"table": "t", "rows": 2}
    # a stream whose checkpoint is lost reads the whole log again: transactions that the state has are left out
    table = VersionedTable(spark, f"{out}/t/state", ["id"], 99)
    assert table.buckets == 3
    with pytest.raises(ValueError, match="keys"):
        VersionedTable(spark, f"{out}/t/state", ["v"])
    last = table.versions()[-1]
    apply_batch(table, ["id"])(spark.read.parquet(log), last + 1)
    assert said(table.latest()) == ["1:C", "5:E"] and table.position(last + 1) == 4


def test_versions_are_written_once_and_expire(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"), ["id"], buckets=4)
    table.start(spark.range(40).selectExpr("id", "'seed' as v"))
    run = apply_batch(table, ["id"])
    batches = [spark.createDataFrame([(i, 0, 0, "update", (i, "x"), (i, f"b{i}")), (i, 1, 0, "delete", (i + 20, "x"), None)], EVENT) for i in range(6)]
    for i, batch in enumerate(batches):
        run(batch, i)
        if i == 3:
            before = sorted(map(tuple, table.latest().collect()))
            run(batch, i)  # a batch that is run again
            assert sorted(map(tuple, table.latest().collect())) == before
    want = {k: f"b{k}" if k < 6 else "seed" for k in range(40) if not 20 <= k < 26}
    assert dict(table.latest().collect()) == want
    assert table.versions() == [4, 5] and table.position(5) == 5
    used = {(v, b) for k in (4, 5) for b, v in table.manifest(k)["of"].items()}
    there = {(int(d.parent.name[2:]), d.name[7:]) for d in (tmp_path / "v").glob("v=*/bucket=*")}
    assert used <= there and all(v in (4, 5) or (v, b) in used for v, b in there)
    # a bucket that a batch doesn't touch isn't rewritten
    assert len({v for v in table.manifest(5)["of"].values()}) > 1
    assert [r[0] for r in table.read(5, [0]).select(table.bucket()).distinct().collect()] == [0]


def test_a_failing_stream_is_started_again(spark, tmp_path):
    log, fails, waits, wrote = str(tmp_path / "log"), [True, True, False, False], [], []
    _log(spark, log, [(0, "insert", 1, "A")])

    def batch(df, i):
        if fails.pop(0):
            raise ValueError("lost")
        wrote.append(df.count())

    stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    start = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start
    supervise(start, sleep=waits.append)
    assert wrote == [1] and waits == [0.1, 0.2]
    fails[:] = [True] * 5
    _log(spark, log, [(1, "insert", 2, "B")])
    with pytest.raises(StreamingQueryException):
        supervise(start, restarts=2, sleep=waits.append)
