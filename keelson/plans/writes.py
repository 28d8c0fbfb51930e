"""Queries: batches, writes and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import apply
from keelson.operators.diff import diff, flat
from keelson.operators.numbering import batches, halves
from keelson.plans.inputs import CUSTOMER, ORDERS, diff_sql
from keelson.plans.registry import query
from keelson.sources.shared import fresh_dir
from keelson.sources.tables import table

_KEYS = ["o_orderkey"]
_DIFF = diff_sql(ORDERS.sql, ("o_orderkey",), ORDERS.columns)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*ORDERS.both(spark, sf), ORDERS.spec)).select("type", "o_orderkey")


@query(f"SELECT type, o_orderkey, (row_number() OVER (PARTITION BY type ORDER BY o_orderkey) - 1) // 100 AS batch_no FROM ({_DIFF})")
def batches_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return batches(_typed(spark, sf), 100, ["o_orderkey"], ["type"])


@query(f"SELECT type, batch_no, (n - 1) // 30 AS statement, count(*) AS n_rows FROM (SELECT type, batch_no, row_number() OVER (PARTITION BY type, batch_no ORDER BY o_orderkey) AS n FROM (SELECT type, o_orderkey, (row_number() OVER (PARTITION BY type ORDER BY o_orderkey) - 1) // 100 AS batch_no FROM ({_DIFF}))) GROUP BY ALL")
def statement_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = batches(_typed(spark, sf), 100, ["o_orderkey"], ["type"])
    return batches(rows, 30, ["o_orderkey"], ["type", "batch_no"], "statement").groupBy("type", "batch_no", "statement").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT type, o_orderkey, CAST(n > total // 2 AS INTEGER) AS half FROM (SELECT type, o_orderkey, row_number() OVER (PARTITION BY type ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY type) AS total FROM ({_DIFF}))")
def split_batch(spark: SparkSession, sf: str) -> DataFrame:
    return halves(_typed(spark, sf), ["o_orderkey"], ["type"])


@query(f"WITH {ORDERS.sql} SELECT * FROM t UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return apply.insert_ignore(target, source, _KEYS)


@query(f"WITH {ORDERS.sql} SELECT * FROM s")
def apply_diff(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return apply.apply_diff(target, diff(source, target, ORDERS.spec), _KEYS)


@query(f"SELECT * FROM ({_DIFF}) WHERE false")
def apply_then_rediff(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return flat(diff(source, apply.apply_diff(target, diff(source, target, ORDERS.spec), _KEYS), ORDERS.spec))


@query(f"WITH {CUSTOMER.sql} SELECT 'repaired' AS state, count(*) AS n_rows, 0 AS diffs FROM s")
def repair_table(spark: SparkSession, sf: str) -> DataFrame:
    where = fresh_dir(spark, "repair")
    done: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        done.append(f"{where}/{len(done)}")
        df.write.parquet(done[-1])
        return spark.read.parquet(done[-1])

    target, left = apply.repair(*CUSTOMER.both(spark, sf), CUSTOMER.spec, write)
    n = left.agg(F.count(F.lit(1)).cast("int").alias("diffs"))
    return target.agg(F.lit("repaired").alias("state"), F.count(F.lit(1)).alias("n_rows")).join(n, F.lit(True))


@query(f"WITH {ORDERS.sql} SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s WHERE o_orderstatus = 'F')")
def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return apply.delete(target, source.where("o_orderstatus = 'F'"), _KEYS)


@query(f"WITH {ORDERS.sql} SELECT * FROM s WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s WHERE o_orderstatus = 'F')")
def replace_by_key(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return apply.replace(target, source.where("o_orderstatus = 'F'"), _KEYS)


@query(f"WITH {ORDERS.sql} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN t.o_custkey ELSE s.o_custkey END AS o_custkey, CASE WHEN s.o_orderkey IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus, t.o_totalprice, CASE WHEN s.o_orderkey IS NULL THEN t.o_orderdate ELSE s.o_orderdate END AS o_orderdate, t.o_orderpriority FROM t FULL JOIN s ON s.o_orderkey = t.o_orderkey")
def replace_keeps_ignored(spark: SparkSession, sf: str) -> DataFrame:
    """Ignored columns keep the target's values; new rows have nulls there."""
    source, target = ORDERS.both(spark, sf)
    return apply.replace(target, source.drop("o_totalprice", "o_orderpriority"), _KEYS)


@query("SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT c_mktsegment <> 'BUILDING' THEN 'segment' END) AS broken FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"}
    _, bad = apply.quarantine(table(spark, sf, "customer"), rules)
    return bad.select("c_custkey", F.array_join("broken", ",").alias("broken"))


@query(_DIFF)
def diff_after_retries(spark: SparkSession, sf: str) -> DataFrame:
    return flat(apply.retry_differing(lambda: ORDERS.both(spark, sf), ORDERS.spec, retries=1))
