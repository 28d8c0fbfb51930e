"""Change logs as streams: applied by micro-batch, and chunks reconciled between watermarks as they pass."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keelson.operators.changelog import apply_net, images, net

#: Setting and value that reconcile_stream needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class VersionedTable:
    """A table as buckets of keys in Parquet, with a version for each micro-batch.

    A batch rewrites the buckets that it touches; a version is a manifest (one line of JSON) of where each bucket's rows lie and
    up to which transaction they are applied, renamed into place when all of it is written: position and rows are committed
    together. Writing a batch twice gives the same version, and transactions that a version has are left out of later ones,
    so that a log read again from an older position is applied once. Buckets that none of the last `keep` versions has are
    deleted. A bucket should fit a task: choose as many buckets as the table has GB, or more; their number stays as the first
    version has it."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), list(keys), buckets, max(keep, 2)
        self._jvm = spark._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if there := self.versions():
            # a table that is there keeps its buckets
            found = self.manifest(there[-1])
            if self.keys and self.keys != found["keys"]:
                raise ValueError(f"the table's keys are {', '.join(found['keys'])}")
            self.keys, self.buckets = found["keys"], found["buckets"]

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def start(self, rows: DataFrame) -> None:
        self._write(rows, -1, {}, range(self.buckets), -1)

    def versions(self) -> list[int]:
        return sorted(int(x[9:-5]) for x in self._names() if x.startswith("manifest-") and x.endswith(".json"))

    def manifest(self, version: int) -> dict:
        stream = self._files.open(self._at(f"manifest-{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        found = self.manifest(version)
        wanted = found["of"] if buckets is None else {str(b): found["of"][str(b)] for b in buckets if str(b) in found["of"]}
        schema = T.StructType.fromJson(found["schema"])
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in wanted.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def latest(self) -> DataFrame:
        return self.read(self.versions()[-1])

    def position(self, version: int) -> int:
        return self.manifest(version)["position"]

    def write(self, change: Callable[[DataFrame], DataFrame], touched: Sequence[int], version: int, position: int = -1) -> None:
        """The version after the one before it, whose touched buckets become change(their rows)."""
        before = self.manifest(version - 1)
        self._write(change(self.read(version - 1, touched)), version, before["of"], touched, max(position, before["position"]))

    def _write(self, rows: DataFrame, version: int, of: dict, touched: Sequence[int], position: int) -> None:
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        written = {int(x[7:]) for x in self._names(f"v={version}") if x.startswith("bucket=")}
        now = {b: v for b, v in of.items() if int(b) not in set(touched)} | {str(b): version for b in sorted(written)}
        line = json.dumps({"position": position, "keys": self.keys, "buckets": self.buckets, "schema": rows.schema.jsonValue(), "of": now})
        temporary, final = self._at(f"manifest-{version}.json.tmp"), self._at(f"manifest-{version}.json")
        out = self._files.create(temporary, True)
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()
        self._files.delete(final, False)
        if not self._files.rename(temporary, final):
            raise OSError(f"version {version} can't be committed")
        self._expire()

    def _expire(self) -> None:
        all_versions = self.versions()
        kept = all_versions[-self.keep :]
        used = {(str(v), b) for k in kept for b, v in self.manifest(k)["of"].items()}
        for v in (x[2:] for x in self._names() if x.startswith("v=")):
            if int(v) in kept:
                continue
            own = [x for x in self._names(f"v={v}") if x.startswith("bucket=")]
            gone = [x for x in own if (v, x[7:]) not in used]
            for x in gone:
                self._files.delete(self._at(f"v={v}", x), True)
            if len(gone) == len(own):
                self._files.delete(self._at(f"v={v}"), True)
        for v in all_versions[: -self.keep]:
            self._files.delete(self._at(f"manifest-{v}.json"), False)


def apply_batch(table: VersionedTable, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Of each micro-batch only the last change of a key is joined to the buckets that it touches, so the
    order of transactions inside it, and their causality, are kept without running them one by one."""

    def run(batch: DataFrame, batch_id: int) -> None:
        done = table.position(batch_id - 1)
        last = net(images(batch.where(F.col("txn_ordinal") > done), keys), keys).withColumn("__bucket", table.bucket()).persist()
        try:
            # as many numbers as there are buckets, at most
            touched = [r[0] for r in last.select("__bucket").distinct().collect()]
            top = batch.agg(F.max("txn_ordinal")).first()[0]
            table.write(lambda rows: apply_net(rows, last.drop("__bucket"), keys), touched, batch_id, done if top is None else top)
        finally:
            last.unpersist()

    return run


def apply_stream(events: DataFrame, table: VersionedTable, keys: Sequence[str], checkpoint: str) -> DataStreamWriter:
    """A writer that applies a stream of events (as of images()) to the table; it resumes from the checkpoint."""
    return events.writeStream.foreachBatch(apply_batch(table, keys)).option("checkpointLocation", checkpoint)


def supervise(start: Callable[[], StreamingQuery], restarts: int = 10, least_seconds: float = 0.1, most_seconds: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Run a query until it ends by itself, starting it again from its checkpoint when it fails.

    The wait before a restart doubles, up to most_seconds; a run that got any batch done resets it. After `restarts` failures
    without progress between them the last one is raised."""
    failures, wait = 0, least_seconds
    while True:
        running = start()
        try:
            running.awaitTermination()
            return running
        except StreamingQueryException:
            if any(p["numInputRows"] for p in running.recentProgress):
                failures, wait = 0, least_seconds
            failures += 1
            if failures > restarts:
                raise
            sleep(wait)
            wait = min(wait * 2, most_seconds)


class _Chunk(StatefulProcessor):
    """One chunk's rows, kept from its read until the high watermark passes; a pair may straddle micro-batches.

    Input columns: at (ordinal), part (order within it), kind (low, high, read or change), key, live, row (JSON text)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "key string", "at long, part long, live boolean, row string")
        self.open = handle.getValueState("open", "low long, held boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """The state is asked once for whether the chunk is open, then by key for what stays open over micro-batches alone: each call is a
        message to the JVM, so none is made for a row."""
        inputs, held = pd.concat(list(rows)), self.open.exists()
        kinds = inputs["kind"]
        if not held and not (kinds == "low").any():
            return
        inputs = inputs.sort_values(["at", "part"], kind="stable", ignore_index=True)
        # stored: whether the state may have rows; low: that of this micro-batch's last low watermark, if it is open still
        is_open, stored, low, now, out, begin = held, held, None, {}, [], 0
        for i in [*inputs.index[inputs["kind"].isin(["low", "high"])], len(inputs)]:
            if is_open:
                self._fold(now, inputs.iloc[begin:i])
            begin = i + 1
            if i == len(inputs):
                break
            if inputs["kind"].iat[i] == "low":
                is_open, low = True, int(inputs["at"].iat[i])
            elif is_open:
                if stored:
                    for (k,), old in self.rows.iterator():
                        if k not in now or not self._later(old, now[k]):
                            now[k] = tuple(old)
                    self.rows.clear()
                out += [(key[0], k, row) for k, (_, _, live, row) in now.items() if live]
                is_open, stored, low, now = False, False, None, {}
        if is_open:
            for k, new in now.items():
                if not stored or not self.rows.containsKey((k,)) or self._later(self.rows.getValue((k,)), new):
                    self.rows.updateValue((k,), new)
            if low is not None:
                self.open.update((low, True))
        elif held:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["chunk_id", "key", "row"]).astype({"chunk_id": "int64"})

    @staticmethod
    def _later(old: tuple, new: tuple) -> bool:
        return (old[0], old[1]) < (new[0], new[1])

    def _fold(self, now: dict[str, tuple], inputs: pd.DataFrame) -> None:
        """The last change of each key into now; of equal places the first counts."""
        for at, part, kind, k, live, row in zip(*(inputs[c] for c in ("at", "part", "kind", "key", "live", "row"))):
            # a read counts as of before all changes, wherever it stands between the watermarks
            new = (-1, 0, bool(live), row) if kind == "read" else (int(at), int(part), bool(live), row)
            if k not in now or self._later(now[k], new):
                now[k] = new

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with RocksDB as its state store, and as it was afterwards."""
    name, wanted = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def reconcile_stream(events: DataFrame) -> DataFrame:
    """(chunk_id, key, row) of each chunk when its high watermark passes. events: chunk_id and the columns of _Chunk; changes
    are routed to their chunk before (see locate). Chunks without an open window keep no state. The session's state store must
    be RocksDB's when the query starts (STATE_STORE); see state_store."""
    out = T.StructType().add("chunk_id", "long").add("key", "string").add("row", "string")
    return events.groupBy("chunk_id").transformWithStateInPandas(_Chunk(), outputStructType=out, outputMode="Append", timeMode="None")


def passthrough_stream(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """Changes of a stream that no open chunk takes in; windows: (chunk_id, low, high), a static table."""
    spans = windows.select(F.col("chunk_id").alias("__chunk"), "low", "high")
    inside = (F.col("chunk_id") == F.col("__chunk")) & (F.col("at") > F.col("low")) & (F.col("at") <= F.col("high"))
    return changes.join(spans, inside, "left_outer").where(F.col("__chunk").isNull()).drop("__chunk", "low", "high")
