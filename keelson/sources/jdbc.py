"""JDBC sources and sinks of MySQL-protocol databases: options, targets of sharded databases, and chunked reads.

No driver comes with PySpark; where none is installed, only what builds options and predicates can run."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

_TARGET = re.compile(r"(?P<keyspace>[^:/@]*)(?:[:/](?P<shard>[^@]*))?(?:@(?P<tablet>[a-zA-Z]+))?")


@dataclass(frozen=True)
class Target:
    """keyspace[/shard][@tablet type]; the separator before the shard is / or :."""

    keyspace: str
    shard: str = ""
    tablet: str = ""

    @classmethod
    def parse(cls, text: str) -> Target:
        found = _TARGET.fullmatch(text)
        if not found:
            raise ValueError(f"not a target: {text}")
        return cls(found["keyspace"], found["shard"] or "", (found["tablet"] or "").lower())

    @property
    def sharded(self) -> bool:
        """Whether the shard is a part of the key range."""
        return self.shard not in ("", "-", "0")

    def __str__(self) -> str:
        return self.keyspace + (f"/{self.shard}" if self.shard else "") + (f"@{self.tablet}" if self.tablet else "")


class Secret:
    """A password that is loaded again when it is older than `seconds` (0: never): one that rotates."""

    def __init__(self, load: Callable[[], str], seconds: float = 0, clock: Callable[[], float] = time.monotonic) -> None:
        self._load, self._seconds, self._clock, self._held = load, seconds, clock, None

    def __call__(self) -> str:
        if self._held is None or (self._seconds and self._clock() - self._held[0] > self._seconds):
            self._held = (self._clock(), self._load())
        return self._held[1]


#: Names of key stores in a cluster's configuration, and the connector's.
_STORES = {
    "trust_certificate_key_store_url": "trustCertificateKeyStoreUrl",
    "trust_certificate_key_store_password": "trustCertificateKeyStorePassword",
    "client_certificate_key_store_url": "clientCertificateKeyStoreUrl",
    "client_certificate_key_store_password": "clientCertificateKeyStorePassword",
}


@dataclass(frozen=True)
class Database:
    """Where a database is. streaming asks for rows as they come instead of whole results; stores are key stores by the names of a
    cluster's configuration."""

    host: str
    user: str = ""
    password: str | Callable[[], str] = ""
    database: str = ""
    kind: str = "mysql"
    streaming: bool = False
    tls: bool = False
    stores: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of_cluster(cls, clusters: Mapping[str, Mapping], reader: bool = False, database: str = "") -> Database:
        """The reader or writer of a configuration's first cluster; a database that is given overrides its own."""
        for cluster in clusters.values():
            c = cluster["reader" if reader else "writer"]
            stores = {k: c[k] for k in _STORES if c.get(k)}
            host = f"{c['host']}:{c['port']}" if c.get("port") else c["host"]
            return cls(host, c.get("username", ""), c.get("password", ""), database or c.get("database", ""), c.get("type", "mysql").lower(), tls=bool(stores), stores=stores)
        raise ValueError("the configuration names no cluster")

    def options(self, table: str | None = None, write_batch: int = 100) -> dict[str, str]:
        host = self.host if ":" in self.host else f"{self.host}:{4000 if self.kind == 'tidb' else 3306}"
        url = f"jdbc:mysql://{host}/{self.database}?connectionTimeZone=UTC" + ("&sslMode=VERIFY_IDENTITY" if self.tls else "")
        url += "".join(f"&{_STORES[k]}={quote(v, safe='')}" for k, v in self.stores.items())
        out = {"url": url, "user": self.user, "password": self.password() if callable(self.password) else self.password, "batchsize": str(write_batch)}
        if self.kind == "vitess" and self.streaming:
            out["sessionInitStatement"] = "set workload = 'olap'"
        if self.streaming:
            out["fetchsize"] = str(-(2**31)) if self.kind == "mysql" else "10000"
        return out | ({"dbtable": table} if table else {})


def _sql(value: object) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'" if isinstance(value, str) else str(value)


def chunk_predicate(keys: Sequence[str], start: Sequence[object] | None, end: Sequence[object] | None, where: str | None = None) -> str:
    """The SQL of one chunk's range in the form that a composite index serves."""

    def compare(op: str, values: Sequence[object], at: int = 0) -> str:
        name = f"`{keys[at]}`"
        if at == len(keys) - 1:
            return f"{name} {op} {_sql(values[at])}"
        return f"({name} {op[0]} {_sql(values[at])} OR ({name} = {_sql(values[at])} AND {compare(op, values, at + 1)}))"

    parts = [f"({where})"] if where else []
    parts += [compare(">=", start)] if start is not None else []
    parts += [compare("<", end)] if end is not None else []
    return " AND ".join(parts) or "1 = 1"


def read(spark: SparkSession, database: Database, table: str, predicates: Sequence[str] = ()) -> DataFrame:
    """A table, with a partition for each predicate (as of chunk_predicate) if there are any."""
    options = database.options()
    url = options.pop("url")
    return spark.read.jdbc(url, table, predicates=list(predicates) or ["1 = 1"], properties=options)


def write(df: DataFrame, database: Database, table: str, statement_rows: int = 100, mode: str = "append") -> None:
    """Insert rows, statement_rows to a statement."""
    df.write.format("jdbc").options(**database.options(table, statement_rows)).mode(mode).save()


def load_config(path: str) -> Mapping[str, object]:
    """A configuration file's sections by table."""
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f).get("tables", {})
