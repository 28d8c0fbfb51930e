"""Exact top-k by integer inner product, over vectors in descending order of length.

Components are turned into whole numbers, floor(SCALE x). A bounded head of the longest vectors gives every query a
first bound from below of its k-th score. Then each block of vectors, longest first, is pruned by Cauchy-Schwarz: a
query is done with the block when its length times the longest remaining one can't reach its bound; of what remains,
coordinates rotated by an SVD give partial sums over the leading ones, and the lengths of the residuals bound the rest.
Only pairs that may reach the bound are scored, exactly, in whole numbers. The head is at most HEAD of the longest vectors by
an approximate quantile, and the rotation is fitted on a bounded sample (SAMPLE keys of smallest hash); any head and any
orthogonal rotation give the same results.

Defined cases: vectors that are null, empty or hold null or non-finite components and rows without a key take no part; a
vector meets those of its own width; vectors of zero take part; of rows that share a key all are candidates and one is a
query; a query's own key is never its result; equal scores go to the smaller key; other columns are never read.
Components may be of any size: where scores could pass 2**53 they are made in exact (slower) integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.vectors import Best, Search, matrix, sample, search, valid

SCALE = 256.0
HEAD, SAMPLE, LEADING = 1024, 4096, 16
_ROWS, _QUERIES = 1024, 2048


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole numbers, exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(int(p) * int(q) for p, q in zip(x, y)) for x, y in zip(a, b)], np.float64 if not len(a) else object)


def searcher(k: int, head: tuple[np.ndarray, np.ndarray], rotation: np.ndarray) -> Search:
    """The search of one partition's blocks; head: keys and whole vectors of the longest, rotation: orthogonal."""

    def run(query_keys: np.ndarray, queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        queries = whole(queries)
        turned = queries @ rotation
        length = np.sqrt((queries**2).sum(1))
        rest = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
        best = Best(len(queries), k, np.int64)
        for i in range(0, len(queries), _QUERIES):
            part = slice(i, i + _QUERIES)
            scores = queries[part] @ head[1].T
            scores[query_keys[part, None] == head[0][None, :]] = -np.inf
            if scores.shape[1] >= k:
                # products in doubles may be off where they pass 2**53: the slack below covers it
                best.least[part] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        for keys, vectors in blocks:
            vectors = whole(vectors)
            size = np.sqrt((vectors**2).sum(1))
            order = np.argsort(-size, kind="stable")
            keys, vectors, size = keys[order], vectors[order], size[order]
            turned_rows = vectors @ rotation
            rest_rows = np.sqrt((turned_rows[:, LEADING:] ** 2).sum(1))
            for j in range(0, len(keys), _ROWS):
                rows = slice(j, j + _ROWS)
                slack = 0.5 + 1e-9 * length * size[j]
                going = np.flatnonzero(length * size[j] + slack >= best.least)
                if not len(going):
                    break
                for i in range(0, len(going), _QUERIES):
                    q = going[i : i + _QUERIES]
                    most = turned[q, :LEADING] @ turned_rows[rows, :LEADING].T + rest[q, None] * rest_rows[None, rows]
                    a, b = np.nonzero((most >= (best.least[q] - slack[q])[:, None]) & (query_keys[q, None] != keys[None, rows]))
                    a, b = q[a], b + j
                    for s in range(0, len(a), 1 << 16):
                        x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                        score = _products(queries[x], vectors[y])
                        kept = score >= best.least[x] - slack[x] if score.dtype == object else score >= best.least[x]
                        best.add(x[kept], keys[y[kept]], score[kept].astype(np.int64))
        yield query_keys[best.query], best.key, best.score.astype(np.int64)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that is_query (a condition on `key`, the long) holds of."""
    rows = valid(vectors, key, vector, zero=True)
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)

    def make(fitting: DataFrame, n: int, width: int) -> Search:
        long = fitting.agg(F.percentile_approx(squared, max(0.0, 1 - HEAD / n))).first()[0]
        head = fitting.where(squared >= long).limit(HEAD).coalesce(1).toArrow().combine_chunks()
        points = whole(sample(fitting, n, SAMPLE).reshape(-1, width))
        rotation = np.linalg.eigh(points.T @ points / max(np.abs(points).max(initial=1.0) ** 2, 1.0))[1][:, ::-1].copy()
        return searcher(k, (head.column("key").to_numpy(), whole(matrix(head.column("vector").combine_chunks(), width))), rotation)

    return search(rows, is_query, k, make, "long")
