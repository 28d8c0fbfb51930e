"""A corpus pipeline of five stages, each over all documents that the one before kept.

toxicity -> quality -> near-duplicates -> mixing -> tokens. Every function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next one's docs. All but the last return the columns of
documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, mixing, quality, registry, simhash, toxicity
from keelson.llm.common import crc_mod, fresh_dir, table


def _held(docs: DataFrame) -> DataFrame:
    """The text, and the whole row beside it: the columns that a classifier adds can't clash with those of documents."""
    return docs.select(F.struct("*").alias("__row"), "text")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't call toxic."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    model = toxicity.train(docs, labels)
    return toxicity.classify(_held(docs), model).where("predicted = 0").select("__row.*")


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    weights = quality.train(docs, labels)
    return quality.classify(_held(docs), weights).where("predicted = 1").select("__row.*")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources by their target weights."""
    return mixing.mixed(docs, registry.MIX, block_rows=registry.BLOCK_ROWS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, the digest of what they decode to, and the document's position in the mix,
    as the files of the stage before have it."""
    return bpe.digests(mixing.placed(docs), public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN, carried=["position"])


STAGES = [
    ("toxicity", registry.prepared(toxic_out)),
    ("quality", registry.prepared(quality_in)),
    ("near-duplicates", registry.prepared(near_duplicates_out)),
    ("mixing", registry.prepared(mixed)),
    ("tokens", registry.prepared(tokens)),
]

#: SQL can't express the models of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's result written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        where = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return STAGES[-1][1](spark, docs, sf_dir)
