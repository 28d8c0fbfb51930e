"""Readers of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name below sf_dir, read through Spark alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
