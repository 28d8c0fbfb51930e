"""What the corpus operators share: tables, the shared folder, checkpoints and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset a temporary folder takes its place in local mode, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keelson-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Setting of the bytes of a batch that goes to a Python worker, Spark's own value, and the one for texts and vectors.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python workers have at most 4 MB (or one row), unless the session has a value of its own.

    Spark's 64 MB are held several times over, in the executor and in the worker, by each task. Plans are made after an operator
    has returned, so this stays set for the session; no result depends on it."""
    name, default, wanted = BATCH
    if spark.conf.get(name, f"{default}b").rstrip("b") == str(default):
        spark.conf.set(name, str(wanted))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table_cut(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and reread: smaller than a checkpoint for wide rows."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column's decimal text, modulo m; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def numbered(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, name: str, few: bool = False) -> DataFrame:
    """df with `name`, the row's gapless number from 0 within its group, in the order of bucket and then `order`.

    bucket must ascend with `order`. A group of any size is spread over its buckets: the counts of buckets give
    each bucket's first number, and rows are numbered within buckets only, so no task holds a whole group. few says that
    groups and buckets are few (2**18 in all): then the starts are broadcast, and rows aren't shuffled to meet them."""
    rows = df.withColumn("__bucket", bucket)
    keys = [*groups, "__bucket"]
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *[F.col(k).alias(f"__start_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    starts = F.broadcast(starts) if few else starts
    on = [F.col(k).eqNullSafe(F.col(f"__start_{k}")) for k in keys]
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.join(starts, on)
        .withColumn(name, F.col("__start") + within - 1)
        .drop("__bucket", "__start", *[f"__start_{k}" for k in keys])
    )


def hash_bucket(key: str, bits: int = 12) -> Column:
    """The top bits of a signed 64-bit hash column: ascends with it."""
    return F.shiftright(F.col(key), 64 - bits)


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column, some `most` bytes of neighbours at once, each with the number of its first: so a batch of
    long texts isn't held as Python objects as a whole."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, strings(column.slice(a, b - a))


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about `most`; a larger one stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
