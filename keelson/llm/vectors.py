"""A stated query set against all vectors of a table: queries go out in blocks of bounded size, one pass for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import table_cut

#: Most components of the queries that are broadcast at once: 32 MB of doubles.
QUERY_CELLS = 1 << 22
#: Most components of the vectors that a task works on at once.
BLOCK_CELLS = 1 << 22


def valid(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(key, vector as doubles) of the rows that have a key and a vector of finite components; zero: zero ones too."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("key").isNotNull() & F.col("vector").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.where(finite & (F.size("vector") > 0))
    return rows if zero else rows.where(F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of `width` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


Search = Callable[[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def sample(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """Vectors, some `size` of n, of the keys of smallest hash: a matrix, in the order of hash and key.

    Of keys that many rows share no more than twice as many rows are taken."""
    part = min(1.0, size / max(n, 1))
    some = rows.where(F.shiftrightunsigned(F.xxhash64("key"), 11) <= int(part * (1 << 53))).limit(2 * size).coalesce(1)
    got = some.select(F.xxhash64("key").alias("h"), "key", "vector").toArrow().sort_by([("h", "ascending"), ("key", "ascending")]).combine_chunks()
    return matrix(got.column("vector").combine_chunks(), len(got.column("vector")[0]) if len(got) else 0)


def search(rows: DataFrame, is_query: Column, k: int, make: Callable[[DataFrame, int, int], Search], score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what the search finds, ties to the smaller vec_id.

    rows: (key, vector); a query meets the vectors of its own width, as others have no inner product with it. make(the rows of
    a width, their number, the width) gives a search: (query keys, query matrix, blocks of (keys, matrix) of one partition) to
    (query, key, score) arrays. Of the rows that share a key all are candidates, and one is a query.

    Queries go out in passes of at most QUERY_CELLS components, one after the other: the driver holds one pass's queries, and
    each pass's result is written to the shared folder before the next begins."""
    spark = rows.sparkSession
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q")).where("q > 0").orderBy("width").collect()
    passes = [(w["width"], w["n"], i, n) for w in widths for n in [max(1, -(-w["q"] * w["width"] * 5 // (4 * QUERY_CELLS)))] for i in range(n)]
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found, run, at = [], None, None
    for width, n, i, of in passes:
        own = rows.where(F.size("vector") == width)
        if at != width:
            run, at = make(own, n, width), width
        got = own.where(is_query & (F.pmod(F.xxhash64("key"), F.lit(of)) == i)).toArrow().sort_by("key").combine_chunks()
        keys = got.column("key").to_numpy()
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        queries = spark.sparkContext.broadcast((keys[first], matrix(got.column("vector").combine_chunks(), width)[first]))
        task = _task(queries, run, width)
        best = own.mapInArrow(task, f"query_id long, vec_id long, score {score_type}").withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if len(passes) > 1:
            best = table_cut(best, "nearest")
            queries.destroy()
        found.append(best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score " + score_type)
    return reduce(DataFrame.unionByName, found)


def _task(queries: Broadcast, run: Search, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                held.append((batch.column("key").to_numpy(), matrix(batch.column("vector"), width)))
                if sum(len(x) for x, _ in held) * width >= BLOCK_CELLS:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held = []
            if held:
                yield tuple(map(np.concatenate, zip(*held)))

        for query, key, score in run(*queries.value, blocks()):
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(key, pa.int64()), pa.array(score)], names=["query_id", "vec_id", "score"])

    return task


class Best:
    """The k best (score, key) of each query so far, ties to the smaller key."""

    def __init__(self, queries: int, k: int, kind: type) -> None:
        self.k, self.query, self.key, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, key, score = (np.concatenate([a, b]) for a, b in ((self.query, query), (self.key, key), (self.score, score)))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        kept, last = rank < self.k, rank == self.k - 1
        self.query, self.key, self.score = query[kept], key[kept], score[kept]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
