"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest, Bawa et al. 2005), for the inner product.

A tree is a sorted array of long hash strings: BITS signs of random projections of each vector, extended by one
coordinate that makes all lengths equal, so that angles rank as inner products do. A query descends every tree to the
string that shares its longest prefix, next to its own place in the array, by binary search. From the longest of these all
trees ascend together, one bit at a time, and take in the vectors that share the shorter prefix, until enough distinct
candidates are found; these are scored exactly. Every partition indexes all its rows in blocks, each with its own trees
over the same projections.

How many candidates are enough is a share of the block, the least of SHARES with which a forest over a bounded sample (at most
2 SAMPLE vectors, and TRIED of them as queries) finds at least AIM of the k nearest; near neighbours of a whole block are
nearer than those of a sample, and so are found at least as often. Vectors without any clusters have hardly nearer
neighbours than others and take a large share of them; clustered vectors a small one. Only candidates are scored.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and rows without a key take no part; a
query meets vectors of its own width; of rows that share a key all are candidates and one is a query; a query's own key
is never its result; equal scores go to the smaller key; other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.vectors import Best, Search, sample, search, valid

TREES, BITS = 96, 32
#: Candidates that are always asked for.
LEAST = 200
SHARES = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1.0)
SAMPLE, TRIED, AIM = 4096, 256, 0.95
_QUERIES = 512


class Forest:
    """Sorted hash strings of one block, for each tree."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, longest: float) -> None:
        n = len(vectors)
        extra = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self.hashes, self.order = np.empty((len(planes), n), np.uint32), np.empty((len(planes), n), np.int32)
        for t, plane in enumerate(planes):
            hashed = strings(np.column_stack([vectors, extra]), plane)
            self.order[t] = np.argsort(hashed, kind="stable")
            self.hashes[t] = hashed[self.order[t]]

    def descend(self, hashed: np.ndarray) -> np.ndarray:
        """For each query the length of the longest prefix that it shares with any string of any tree. hashed: by tree and query."""
        longest = np.zeros(hashed.shape[1], np.int64)
        for tree, own in zip(self.hashes, hashed):
            at = np.searchsorted(tree, own)
            # the strings on either side of a query's place share its longest prefix
            differ = np.minimum(own ^ tree[np.minimum(at, len(tree) - 1)], own ^ tree[np.maximum(at - 1, 0)])
            longest = np.maximum(longest, BITS - np.frexp(differ.astype(np.float64))[1])
        return longest

    def ranges(self, hashed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query: where the strings that share the query's first `depth` bits begin and end."""
        mask = np.uint32(0xFFFFFFFF << (BITS - depth) & 0xFFFFFFFF)
        low = np.stack([np.searchsorted(s, h & mask) for s, h in zip(self.hashes, hashed)])
        high = np.stack([np.searchsorted(s, h | ~mask, "right") for s, h in zip(self.hashes, hashed)])
        return low, high

    def candidates(self, hashed: np.ndarray, enough: int) -> np.ndarray:
        """A row of marks for each query. hashed: by tree and query."""
        marks = np.zeros((hashed.shape[1], self.hashes.shape[1]), bool)
        at = self.descend(hashed)
        todo, depth = np.arange(len(at)), int(at.max(initial=0))
        while len(todo):
            low, high = self.ranges(hashed[:, todo], depth)
            # too few even if all were distinct, or nothing is that near: ascend at once
            ready = np.flatnonzero(((high - low).sum(0) >= enough) & (at[todo] >= depth)) if depth else np.arange(len(todo))
            done = np.zeros(len(todo), bool)
            for i in ready:
                mark = marks[todo[i]]
                for t in range(len(low)):
                    mark[self.order[t, low[t, i] : high[t, i]]] = True
                done[i] = not depth or np.count_nonzero(mark) >= enough
            todo, depth = todo[~done], depth - 1
        return marks


def strings(vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The signs of the projections as one number, the first one its highest bit."""
    return ((vectors @ plane) > 0) @ (np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32))


def projections(width: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TREES, width + 1, BITS))


def _hashed(queries: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.stack([strings(np.column_stack([queries, np.zeros(len(queries))]), p) for p in planes]).astype(np.uint32)


def fitted_share(vectors: np.ndarray, k: int, planes: np.ndarray) -> float:
    """The least of SHARES that finds AIM of the k nearest among the vectors, the first TRIED of them being the queries."""
    if len(vectors) <= max(k, LEAST):
        return 1.0
    forest = Forest(vectors, planes, float(np.sqrt((vectors**2).sum(1).max())))
    queries = vectors[:TRIED]
    scores = queries @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    hashed = _hashed(queries, planes)
    for share in SHARES:
        # without LEAST: in a whole block it hardly counts
        marks = forest.candidates(hashed, max(k, int(share * len(vectors))))
        if np.take_along_axis(marks, nearest, 1).mean() >= AIM:
            return share
    return 1.0


def searcher(k: int, planes: np.ndarray, share: float) -> Search:

    def run(query_keys: np.ndarray, queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        best = Best(len(queries), k, np.float64)
        hashed = _hashed(queries, planes)
        for keys, vectors in blocks:
            forest = Forest(vectors, planes, float(np.sqrt((vectors**2).sum(1).max())))
            enough = min(len(keys), max(LEAST, int(share * len(keys))))
            for i in range(0, len(queries), _QUERIES):
                part = slice(i, i + _QUERIES)
                marks, of, at, gained = forest.candidates(hashed[:, part], enough), [], [], []
                marks &= query_keys[part, None] != keys[None, :]
                for q, mark in enumerate(marks, i):
                    found = np.flatnonzero(mark)
                    scores = vectors[found] @ queries[q]
                    if len(scores) > k:
                        # those that tie with the k-th stay: the smaller key is better
                        kept = np.flatnonzero(scores >= max(np.partition(scores, len(scores) - k)[len(scores) - k], best.least[q]))
                        found, scores = found[kept], scores[kept]
                    of.append(np.full(len(found), q)), at.append(found), gained.append(scores)
                best.add(np.concatenate(of), keys[np.concatenate(at)], np.concatenate(gained))
        yield query_keys[best.query], best.key, best.score

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that is_query (a condition on `key`, the long) holds of. share: the part of a
    block that is asked for as candidates, by default fitted."""
    rows = valid(vectors, key, vector, zero=False)

    def make(own: DataFrame, n: int, width: int) -> Search:
        planes = projections(width)
        return searcher(k, planes, fitted_share(sample(own, n, SAMPLE).reshape(-1, width), k, planes) if share is None else share)

    return search(rows, is_query, k, make, "double")
