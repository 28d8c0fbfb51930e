"""The four commands over folders of Parquet tables, and their command line: clone, checksum, replicate and ping."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.model import TableSpec, chosen_tables, spec_of
from keelson.operators.apply import apply_diff, insert_ignore, repair
from keelson.operators.diff import diff, diff_via_checksum, summary
from keelson.sources.catalog import find_key, folder_tables
from keelson.sources.jdbc import load_config
from keelson.streaming.apply import VersionedTable, apply_stream, supervise


_LOG = logging.getLogger("keelson")


class JsonLines(logging.Formatter):
    """Log records as lines of JSON with times in UTC."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        line = {"timestamp": at, "level": record.levelname.lower(), "message": record.getMessage()}
        return json.dumps(line | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


def _read(spark: SparkSession, top: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{top.rstrip('/')}/{name}.parquet")


def _empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)


def clone(spark: SparkSession, source: str, out: str, specs: Iterable[TableSpec], target: str | None = None, no_diff: bool = False, dry_run: bool = False) -> DataFrame:
    """Write to `out` what each table of `target` (none: empty, the schema copied) becomes so that it equals the source.

    no_diff only adds keys that the target lacks; a dry run writes nothing. Returns (table, type, diffs) of what was done."""
    done = []
    for spec in specs:
        s = _read(spark, source, spec.name)
        t = _read(spark, target, spec.name) if target else _empty_like(spark, s)
        found = diff(s, t, spec)
        if no_diff:
            found = found.where("type = 'insert'")
            new = insert_ignore(t, spec.side(s, "source"), spec.keys)
        else:
            new = apply_diff(t, found, spec.keys)
        if not dry_run:
            new.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{spec.name}.parquet")
            _LOG.info("wrote %s", spec.name)
        done.append(found.select(F.lit(spec.name).alias("table"), "type"))
    return summary(_union(done))


def checksum(spark: SparkSession, source: str, target: str, specs: Iterable[TableSpec], use_crc32: bool = False, repair_to: str | None = None, attempts: int = 3) -> DataFrame:
    """(table, type, diffs): the differences, after repairing to `repair_to` if given only those that stay."""
    found = []
    for spec in specs:
        s, t = _read(spark, source, spec.name), _read(spark, target, spec.name)
        if repair_to is not None:
            where = f"{repair_to.rstrip('/')}/{spec.name}.parquet"
            rounds = iter(range(attempts))

            def write(df: DataFrame, where: str = where, rounds=rounds) -> DataFrame:
                path = f"{where}/round={next(rounds)}"
                df.write.mode("overwrite").parquet(path)
                return spark.read.parquet(path)

            _, left = repair(s, t, spec, write, attempts)
        else:
            left = diff_via_checksum(s, t, spec, "crc32") if use_crc32 else diff(s, t, spec)
        found.append(left.select(F.lit(spec.name).alias("table"), "type"))
    return summary(_union(found))


def replicate(spark: SparkSession, log: str, out: str, spec: TableSpec, target: str | None = None, buckets: int = 64, restarts: int = 10) -> DataFrame:
    """The table after the change log in folder `log`, which is read as a stream by Parquet files of changelog.images' events.

    State, its versions and the stream's checkpoint lie below `out`; a call goes on where the last one ended, each transaction
    applied once, and applies what the folder has by then. `target` (none: empty) is what it starts from."""
    schema = spark.read.parquet(log).schema
    table = VersionedTable(spark, f"{out.rstrip('/')}/{spec.name}/state", spec.keys, buckets)
    if not table.versions():
        kind = next(schema[x].dataType for x in ("after", "before") if x in schema.names)
        table.start(_read(spark, target, spec.name) if target else spark.createDataFrame([], kind))
    events = spark.readStream.schema(schema).parquet(log)
    writer = apply_stream(events, table, spec.keys, f"{out.rstrip('/')}/{spec.name}/checkpoint").trigger(availableNow=True)
    supervise(writer.start, restarts)
    return table.latest()


def ping(spark: SparkSession) -> DataFrame:
    """One row with the time, if Spark answers."""
    return spark.range(1).select(F.current_timestamp().alias("now"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def main(args: list[str] | None = None) -> int:
    """Exit 1 if a checksum finds differences."""
    p = argparse.ArgumentParser(prog="keelson")
    p.add_argument("command", choices=["clone", "checksum", "replicate", "ping"])
    p.add_argument("--source", default="")
    p.add_argument("--target")
    p.add_argument("--out")
    p.add_argument("--config", help="TOML with a section [tables.NAME] for each table")
    p.add_argument("--table", action="append", default=[], help="NAME=key,key, or NAME: its key is looked for; none: all tables of the source")
    p.add_argument("--no-diff", action="store_true")
    p.add_argument("--use-crc32", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--repair-to")
    a = p.parse_args(args)
    lines = logging.StreamHandler()
    lines.setFormatter(JsonLines())
    _LOG.addHandler(lines)
    _LOG.setLevel(logging.INFO)
    spark = SparkSession.builder.appName("keelson").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "ping":
        print(ping(spark).first()["now"])
        return 0
    config = load_config(a.config) if a.config else {}
    keys = {n: k.split(",") if k else () for n, _, k in (t.partition("=") for t in a.table)}
    if a.command == "replicate":
        for n, k in keys.items():
            rows = replicate(spark, a.source, a.out, spec_of(config.get(n, {}), n, k), a.target)
            print(json.dumps({"table": n, "rows": rows.count()}))
        return 0
    keys = keys or ({} if config else dict.fromkeys(folder_tables(spark, a.source), ()))
    named = {n: config.get(n, {}).get("keys") or k for n, k in (keys | {n: keys.get(n, ()) for n in config}).items()}
    keys = {n: k or find_key(_read(spark, a.source, n)) for n, k in named.items()}
    specs = [spec_of(config.get(n, {}), n, keys.get(n, ())) for n in chosen_tables([*keys, *config], config)]
    if a.command == "clone":
        rows = clone(spark, a.source, a.out, specs, a.target, a.no_diff, a.dry_run).collect()
    else:
        rows = checksum(spark, a.source, a.target, specs, a.use_crc32, a.repair_to).collect()
    for r in rows:
        print(json.dumps(r.asDict()))
    return int(a.command == "checksum" and bool(rows))


if __name__ == "__main__":
    sys.exit(main())
