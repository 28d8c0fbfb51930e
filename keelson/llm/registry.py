"""Queries of the corpus operators, by the contracts of their results."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, forest, html, mixing, oracles, quality, sharding, simhash, topk, toxicity, warc
from keelson.llm.common import bounded_batches, crc_mod, fresh_dir, table

#: The tokenizer's vocabulary file; its place is a parameter.
RANKS = "byte_bpe_50k.tiktoken"
#: Target weights of the mix; other sources weigh 1.
MIX = {"src0": 4, "src1": 3, "src2": 2}
BLOCK_ROWS = 16


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    scored = quality.classify(docs, quality.train(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    scored = toxicity.classify(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), where)
    return warc.read(spark, where, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX, block_rows=BLOCK_ROWS)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def ready(spark: SparkSession) -> None:
    """The session with batches for workers bounded, and with this package on the workers' path, as it is on the driver's: where
    they see the same folder, that suffices whatever the working folder; elsewhere the package comes by spark.submit.pyFiles."""
    bounded_batches(spark)
    root, environment = str(Path(__file__).parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def prepared(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, called with a session that is made ready before."""

    @functools.wraps(f)
    def run(spark: SparkSession, *rest) -> DataFrame:
        ready(spark)
        return f(spark, *rest)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_html_extraction, op3_toxicity, op4_warc, op5_byte_bpe, op6_source_mixing, op7_exact_top_k, op8_simhash, op9_sharding, op10_hash_prefix_forest, pipeline)
    return {f.__name__: prepared(f) for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
