from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keelson.operators.chunking import chunks, locate, page, scan
from keelson.operators.numbering import batches, halves, numbered

CASES = {
    "empty": (10, [], [(None, None)]),
    "one row": (10, [(1,)], [(None, (1,)), ((1,), (2,)), ((2,), None)]),
    "size 1": (1, [(1,), (2,), (3,)], [(None, (1,)), ((1,), (2,)), ((2,), (3,)), ((3,), (4,)), ((4,), None)]),
    "partial last": (2, [(1,), (2,), (3,)], [(None, (1,)), ((1,), (3,)), ((3,), (4,)), ((4,), None)]),
    "95 rows": (20, [(i,) for i in range(1, 96)], [(None, (1,)), ((1,), (21,)), ((21,), (41,)), ((41,), (61,)), ((61,), (81,)), ((81,), (96,)), ((96,), None)]),
    "composite one": (10, [(1, 1)], [(None, (1, 1)), ((1, 1), (1, 2)), ((1, 2), None)]),
    "page inside parent": (3, [(1, 1), (1, 2), (2, 3), (2, 4), (2, 5)], [(None, (1, 1)), ((1, 1), (2, 4)), ((2, 4), (2, 6)), ((2, 6), None)]),
    "other id order": (3, [(1, 3), (1, 4), (1, 5), (2, 1), (2, 2)], [(None, (1, 3)), ((1, 3), (2, 1)), ((2, 1), (2, 3)), ((2, 3), None)]),
    "composite 95": (10, [(i // 3, i) for i in range(1, 96)], [(None, (0, 1))] + [(a, b) for a, b in zip(*(lambda s: (s, s[1:] + [(31, 96)]))([(0, 1), (3, 11), (7, 21), (10, 31), (13, 41), (17, 51), (20, 61), (23, 71), (27, 81), (30, 91)]))] + [((31, 96), None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_bounds(spark, name):
    size, rows, wanted = CASES[name]
    keys = ["id"] if not rows or len(rows[0]) == 1 else ["customer_id", "id"]
    df = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in keys))
    got = chunks(df, keys, size, "t").orderBy("chunk_id").collect()
    assert [(r["start"] and tuple(r["start"]), r["end"] and tuple(r["end"])) for r in got] == wanted
    assert [r["chunk_id"] for r in got] == list(range(len(wanted)))
    assert got[0]["is_first"] and got[-1]["is_last"] and sum(r["is_first"] for r in got) == sum(r["is_last"] for r in got) == 1
    assert sum(r["size"] for r in got) == len(rows) and all(r["size"] == size for r in got[1:-2])


def test_text_keys_have_no_successor(spark):
    got = chunks(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), ["k"], 2).orderBy("chunk_id").collect()
    assert [(r["start"] and r["start"][0], r["end"] and r["end"][0], r["is_last"]) for r in got] == [(None, "a", False), ("a", "c", False), ("c", None, True)]


def test_every_key_is_in_its_own_chunk(spark):
    rows = spark.createDataFrame([(i // 7, i) for i in range(500)], "a long, b long")
    tiles = chunks(rows, ["a", "b"], 9, "t")
    found = locate(rows.unionByName(spark.createDataFrame([(-5, 0), (999, 0)], "a long, b long")), tiles, ["a", "b"])
    sizes = {r["chunk_id"]: r["count"] for r in found.groupBy("chunk_id").count().collect()}
    wanted = {r["chunk_id"]: r["size"] for r in tiles.collect() if r["size"]}
    last = max(wanted) + 1
    assert sizes == wanted | {0: 1, last: 1}
    assert locate(rows, chunks(rows.where("false"), ["a", "b"], 9), ["a", "b"]).select("chunk_id").distinct().collect()[0][0] == 0


def test_scan_and_page(spark):
    rows = spark.createDataFrame([(i,) for i in range(20)], "id long")
    assert [r[0] for r in scan(rows, ["id"], (5,), (8,), "id <> 6").collect()] == [5, 7]
    assert [r[0] for r in page(rows, ["id"], (17,), 5).collect()] == [18, 19]
    assert [r[0] for r in page(rows, ["id"], None, 2).collect()] == [0, 1]


def test_numbers_are_gapless_by_group_whatever_the_skew(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).alias("g"), "id").repartition(7)
    got = numbered(rows, ["id"], "n", ["g"]).toPandas().sort_values(["g", "id"])
    assert all(list(x.n) == list(range(1, len(x) + 1)) for _, x in got.groupby("g"))
    null = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "g string, id long")
    assert sorted(numbered(null, ["id"], "n", ["g"]).select("id", "n").collect()) == [(1, 1), (1, 1), (2, 2)]


@pytest.mark.parametrize("n", [1, 5, 8])
def test_batches_and_halves(spark, n):
    rows = spark.range(n).withColumn("g", F.lit(1))
    assert [r[0] for r in batches(rows, 4, ["id"], ["g"]).orderBy("id").select("batch_no").collect()] == [i // 4 for i in range(n)]
    assert [r[0] for r in halves(rows, ["id"], ["g"]).orderBy("id").select("half").collect()] == [int(i >= n // 2) for i in range(n)]
