from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions.shardhash import in_shard, shard_hash, shard_hash_array

KNOWN = {1: "166b40b44aba4bd6", 2: "06e7ea22ce92708f", 3: "4eb190c9a2fa169c"}


def test_known_hashes():
    assert [f"{int(x):016x}" for x in shard_hash_array(np.array(list(KNOWN), np.uint64))] == list(KNOWN.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_is_its_own_inverse(keys):
    x = np.array(keys, np.uint64)
    assert (shard_hash_array(shard_hash_array(x)) == x).all()


def test_in_spark(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    got = rows.select(F.lower(F.lpad(F.hex(shard_hash(F.col("k"))), 16, "0")).alias("h")).collect()
    assert [r["h"] for r in got] == [KNOWN[1], KNOWN[2], None]
    keys = spark.range(300)
    low, high = keys.where(in_shard(F.col("id"), "-80")).count(), keys.where(in_shard(F.col("id"), "80-")).count()
    assert low + high == 300 and 100 < low < 200
    assert keys.where(in_shard(F.col("id"), "40-80")).count() + keys.where(in_shard(F.col("id"), "-40")).count() == low
