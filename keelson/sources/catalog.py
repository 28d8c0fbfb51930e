"""What tables there are, their keys and about how many rows they have: of folders of Parquet files, and of databases by their
information schema."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.scalars import estimate
from keelson.model import TableSpec

#: Subqueries for JDBC's `dbtable`; {schema} is the database's name.
INFORMATION_SCHEMA = {
    "tables": "(SELECT table_name, data_length, avg_row_length FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE') t",
    "columns": "(SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_schema = '{schema}') t",
    "keys": "(SELECT table_name, column_name, ordinal_position FROM information_schema.key_column_usage WHERE table_schema = '{schema}' AND constraint_name = 'PRIMARY') t",
}


def subquery(which: str, schema: str) -> str:
    return INFORMATION_SCHEMA[which].format(schema=schema.replace("\\", "\\\\").replace("'", "''"))


def folder_tables(spark: SparkSession, top: str) -> list[str]:
    """Names of the Parquet tables in a folder, sorted."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (f.getPath().getName() for f in files)
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def find_key(df: DataFrame, most: int = 3) -> tuple[str, ...]:
    """The shortest run of first columns, at most `most`, that has no nulls and that no two rows share.

    Parquet names no keys. Each try is one pass over the columns tried, with map-side sums."""
    for n in range(1, min(most, len(df.columns)) + 1):
        names = df.columns[:n]
        null = F.greatest(*[F.col(c).isNull() for c in names], F.lit(False))
        bad = df.where(null).select(F.lit(1).alias("x")).limit(1).unionByName(df.groupBy(*names).count().where("count > 1").select(F.lit(1).alias("x")).limit(1))
        if bad.isEmpty():
            return tuple(names)
    raise ValueError(f"no key in the first {most} columns: {', '.join(df.columns[:most])}")


def specs(columns: DataFrame, keys: DataFrame) -> list[TableSpec]:
    """A spec for each table of an information schema, as the subqueries have it; tables without a primary key are an error."""
    of: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in keys.select("table_name", "ordinal_position", "column_name").collect():  # a line for each key column of a schema
        of[r[0]].append((r[1], r[2]))
    names = [r[0] for r in columns.select("table_name").distinct().orderBy("table_name").collect()]
    without = [n for n in names if n not in of]
    if without:
        raise ValueError(f"no primary key: {', '.join(without)}")
    return [TableSpec(n, tuple(c for _, c in sorted(of[n]))) for n in names]


def estimates(tables: DataFrame) -> DataFrame:
    """(table, estimated_rows) from the database's statistics."""
    return tables.select(F.col("table_name").alias("table"), estimate(F.col("data_length"), F.col("avg_row_length")).alias("estimated_rows"))
