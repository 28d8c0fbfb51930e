"""Sharding by vector bin packing: groups of equal texts, measured in bytes, tokens and rows, go to shards one after the
other in descending size, each to the shard whose residual capacity has the highest dot product with the group.

The placing is sequential, so what it runs over has a proven bound: a group that makes up less than 1/CELLS of the
table in every measure is joined with others into one of CELLS cells by its hash, so there are at most 4 CELLS items.
A group larger than a whole shard is cut by the numbers of its rows into pieces of about an eighth of a shard, alike to one
row, whatever the rows repeat; there are at most 3 x shards such groups. All other groups stay together. Tokens are runs of
characters other than ASCII white space.

Defined cases: null texts have no bytes and form one group with empty ones; rows of null key are placed like others;
repeated rows are one group; an empty table has no shards; other columns are carried by name and never read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import hash_bucket, numbered, table_cut

CELLS = 1 << 14
#: A group of at least one row in so many is hot.
HOT = 1 << 8
_MEASURES = ("size", "tokens", "rows")
#: Weights of the measures in the dot product: the law is that bytes are near equal.
WEIGHTS = (4.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (a row of measures), placed in descending order of size."""
    total = items.sum(0)
    part = items / np.maximum(total / shards, 1) * np.sqrt(WEIGHTS)
    left = np.ones((shards, items.shape[1])) * np.sqrt(WEIGHTS)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -part.sum(1))):
        out[i] = s = int(np.argmax(left @ part[i]))
        left[s] -= part[i]
    return out


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): size in UTF-8 bytes plus 1, slot gapless from 0 within a shard."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.md5(whole.cast("binary")).alias("__group"),
        F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
    )
    sums = [F.sum(m).alias(m) for m in _MEASURES]
    groups = rows.groupBy("__group").agg(*sums)
    total = rows.agg(*sums).first()
    if total["rows"] is None:
        return rows.select(F.col("__key").alias(key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cell = F.conv(F.substring("__group", 1, 8), 16, 10).cast("long") % CELLS
    big = F.greatest(*[(F.col(m) * CELLS >= F.lit(total[m])).cast("int") for m in _MEASURES]) == 1
    item = F.when(big, F.col("__group")).otherwise(F.concat(F.lit("cell "), cell.cast("string")))
    items = groups.groupBy(item.alias("item")).agg(*sums).toPandas().sort_values("item", kind="stable")
    large = np.max([items[m].to_numpy() * shards / total[m] for m in _MEASURES], axis=0)
    own = ~items.item.str.startswith("cell ")
    huge = items.item[(large > 1) & own].tolist()
    # rows of hot groups get numbers, which tell repeated rows apart; there are at most HOT + 3 x shards such groups
    hot = items.item[((large > 1) | (items["rows"].to_numpy() * HOT >= total["rows"])) & own].tolist()
    rows = rows.withColumns({"__piece": F.lit(None).cast("string"), "__no": F.lit(0).cast("long")})
    if hot:
        many = table_cut(rows.where(F.col("__group").isin(hot)).drop("__piece", "__no").withColumn("__part", F.spark_partition_id()), "hot")
        many = numbered(many, ["__group"], [F.xxhash64("__key"), F.col("__key")], F.col("__part"), "__no").drop("__part")
        cuts = {x: int(np.ceil(8 * s)) for x, s in zip(items.item, large) if x in set(huge)}
        pieces = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if huge else F.lit(None).cast("map<string,int>")
        many = many.withColumn("__piece", F.when(F.col("__group").isin(huge), F.col("__no") % pieces[F.col("__group")]).cast("string"))
        rows = rows.where(~F.col("__group").isin(hot)).unionByName(many)
    if huge:
        parts = rows.where(F.col("__piece").isNotNull()).groupBy(F.concat_ws(" ", "__group", "__piece").alias("item")).agg(*sums).toPandas()
        items = pd.concat([items[~items.item.isin(huge)], parts]).sort_values("item", kind="stable")
    items["shard"] = place(items[list(_MEASURES)].to_numpy(np.float64), shards)
    chosen = spark.createDataFrame(items[["item", "shard"]].astype({"shard": "int32"}))
    alone = F.broadcast(chosen.where(~F.col("item").startswith("cell ")).select(F.col("item").alias("__own"), F.col("shard").alias("__a")))
    shared = F.broadcast(chosen.where(F.col("item").startswith("cell ")).select(F.substring("item", 6, 9).cast("long").alias("__cell"), F.col("shard").alias("__b")))
    placed = rows.join(alone, F.concat_ws(" ", "__group", "__piece") == F.col("__own"), "left").join(shared, cell == F.col("__cell"), "left")
    placed = placed.select("__key", "size", "text_crc32", F.coalesce("__a", "__b").alias("shard"), F.xxhash64("__key", "text_crc32", "__no").alias("__h"))
    return numbered(placed, ["shard"], [F.col("__h"), F.col("__key")], hash_bucket("__h"), "slot").select(F.col("__key").alias(key), "size", "text_crc32", "shard", "slot")
