"""Pairs of tables and change logs, derived from the driver tables by arithmetic on keys: the same in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.model import TableSpec
from keelson.sources.tables import table

MOVED = 1_000_000_000


@dataclass(frozen=True)
class Pair:
    """A source table and how its target differs: rows missing, a number and a text changed, rows added."""

    name: str
    key: str
    number: str
    text: str
    columns: tuple[str, ...]

    @property
    def spec(self) -> TableSpec:
        return TableSpec(self.name, (self.key,))

    def source(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.name).select(*self.columns)

    def target(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        s, k = self.source(spark, sf_dir), F.col(self.key)
        changed = s.where(k % 97 != 0).withColumn(self.number, F.when(k % 53 == 0, F.col(self.number) + 1).otherwise(F.col(self.number)))
        changed = changed.withColumn(self.text, F.when(k % 71 == 0, F.lit("X")).otherwise(F.col(self.text)))
        return changed.unionByName(s.where(k % 89 == 0).withColumn(self.key, k + MOVED))

    def both(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        return self.source(spark, sf_dir), self.target(spark, sf_dir)

    @property
    def sql(self) -> str:
        """The common table expressions s and t."""
        k = self.key
        cell = {self.number: f"CASE WHEN {k} % 53 = 0 THEN {self.number} + 1 ELSE {self.number} END", self.text: f"CASE WHEN {k} % 71 = 0 THEN 'X' ELSE {self.text} END"}
        changed = ", ".join(f"{cell[c]} AS {c}" if c in cell else c for c in self.columns)
        added = ", ".join(f"{c} + {MOVED} AS {c}" if c == k else c for c in self.columns)
        return f"s AS (SELECT {', '.join(self.columns)} FROM {self.name}), t AS (SELECT {changed} FROM {self.name} WHERE {k} % 97 <> 0 UNION ALL SELECT {added} FROM {self.name} WHERE {k} % 89 = 0)"


ORDERS = Pair("orders", "o_orderkey", "o_totalprice", "o_orderstatus", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
CUSTOMER = Pair("customer", "c_custkey", "c_acctbal", "c_mktsegment", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
PART = Pair("part", "p_partkey", "p_retailprice", "p_brand", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
DOCUMENTS = Pair("documents", "doc_id", "n_chars", "text", ("doc_id", "text", "lang", "source", "n_chars"))

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LINES = TableSpec("lineitem", ("l_orderkey", "l_linenumber"))


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem with one row for each key, and its target."""
    rest = [c for c in _LINE if c not in LINES.keys]
    once = Window.partitionBy(*LINES.keys).orderBy(*rest)
    s = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(once)).where("n = 1").select(*_LINE)
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    t = s.where(k % 97 != 0).withColumn("l_quantity", F.when(k % 53 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).withColumn("l_returnflag", F.when(k % 71 == 0, F.lit("X")).otherwise(F.col("l_returnflag")))
    return s, t.unionByName(s.where(k % 89 == 0).withColumn("l_orderkey", F.col("l_orderkey") + MOVED))


LINES_SQL = f"""s AS (SELECT {', '.join(_LINE)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c for c in _LINE if c not in LINES.keys)}) AS n FROM lineitem) WHERE n = 1),
t AS (SELECT {', '.join({'l_quantity': 'CASE WHEN (l_orderkey * 8 + l_linenumber) % 53 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity', 'l_returnflag': "CASE WHEN (l_orderkey * 8 + l_linenumber) % 71 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag"}.get(c, c) for c in _LINE)} FROM s WHERE (l_orderkey * 8 + l_linenumber) % 97 <> 0
UNION ALL SELECT {', '.join(f'l_orderkey + {MOVED} AS l_orderkey' if c == 'l_orderkey' else c for c in _LINE)} FROM s WHERE (l_orderkey * 8 + l_linenumber) % 89 = 0)"""
LINES_COLUMNS = _LINE


def diff_sql(ctes: str, keys: tuple[str, ...], columns: tuple[str, ...], s: str = "s", t: str = "t") -> str:
    """The diff of two common table expressions, as keelson.operators.diff.flat has it."""
    k = keys[0]
    row = ", ".join(f"CASE WHEN s.{k} IS NULL THEN t.{c} ELSE s.{c} END AS {c}" for c in columns)
    target = ", ".join(f"CASE WHEN s.{k} IS NOT NULL THEN t.{c} END AS target_{c}" for c in columns)
    unequal = " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in columns)
    return f"WITH {ctes} SELECT CASE WHEN t.{k} IS NULL THEN 'insert' WHEN s.{k} IS NULL THEN 'delete' ELSE 'update' END AS type, {row}, {target} FROM {s} s FULL JOIN {t} t ON {' AND '.join(f's.{x} = t.{x}' for x in keys)} WHERE s.{k} IS NULL OR t.{k} IS NULL OR {unequal}"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: three to a transaction, keyed by user; signups insert, errors delete, others update."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    image = F.struct("user_id", "event_type", "value")
    return e.select(
        F.expr("event_id div 3").alias("txn_ordinal"), (F.col("event_id") % 3).cast("int").alias("mutation_idx"), F.lit(0).alias("row_idx"), kind.alias("type"),
        F.when(kind == "delete", image).alias("before"), F.when(kind != "delete", image).alias("after"), F.col("event_id").alias("log_pos"),
    )


#: The log's rows: e, with kind.
LOG_SQL = "e AS (SELECT *, event_id // 3 AS txn_ordinal, event_id % 3 AS mutation_idx, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind FROM events)"


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that the log is applied to: a row for each customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("seed").alias("event_type"), F.col("c_acctbal").alias("value"))


SEED_SQL = "seed AS (SELECT c_custkey AS user_id, 'seed' AS event_type, c_acctbal AS value FROM customer)"
