"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text becomes a sparse vector of hashed n-grams of its words and of their shapes (letter case, digits, punctuation,
repetition), each valued by its share of the text's n-grams. The model is one weight for each of 2**BITS buckets,
fitted by per-coordinate FTRL-proximal steps with L1 and L2 terms; a score is the logistic of a sparse dot product.

Defined cases: null and empty texts have no n-grams and score as the bias alone; rows whose label is null aren't
learnt from; with no labelled rows every score is 0.5; repeated rows are learnt from and scored as often as they
stand; very long texts are scored whole, a slice of words at a time; other columns are carried by their names and
never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import sigmoid, strings
from keelson.llm.tokens import Words, mix, words

BITS = 18
SCALE = 16.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def grams(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a slice's words and shapes, and the number of the text of each."""
    doc, word, shape = words.doc, words.word, words.shape
    one, two, three = doc, doc[1:], doc[2:]
    in_two, in_three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    parts = [
        (one, word),
        (two[in_two], (word[1:] * _MIX + word[:-1])[in_two]),
        (one, shape * _MIX2 + np.uint64(5)),
        (two[in_two], ((shape[1:] * _MIX2 + shape[:-1]) * _MIX2 + np.uint64(7))[in_two]),
        (three[in_three], (((shape[2:] * _MIX2 + shape[1:-1]) * _MIX + shape[:-2]) * _MIX2 + np.uint64(11))[in_three]),
        (two[in_two], (word[1:] == word[:-1])[in_two].astype(np.uint64) + np.uint64(77)),
        (three[in_three], (word[2:] == word[:-2])[in_three].astype(np.uint64) + np.uint64(99)),
    ]
    return (mix(np.concatenate([g for _, g in parts])) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate([d for d, _ in parts])


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their values."""
    parts = [grams(x)[0] for x in words([text])]
    idx, n = np.unique(np.concatenate([np.zeros(0, np.int32), *parts]), return_counts=True)
    return idx.astype(np.int32), (n * (SCALE / max(n.sum(), 1))).astype(np.float32)


class Ftrl:
    """FTRL-proximal logistic regression over sparse vectors (McMahan et al. 2013); the last weight is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 0.1, l1: float = 0.02, l2: float = 0.05) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, idx: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, idx: np.ndarray, value: np.ndarray, label: int) -> None:
        idx, value = np.append(idx, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(idx)
        g = (float(sigmoid(np.array(w @ value))) - label) * value
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6) -> np.ndarray:
        order = np.random.default_rng(7)
        for _ in range(epochs if rows else 0):
            for i in order.permutation(len(rows)):
                self.step(*rows[i])
        return self.weights(slice(None)).astype(np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The model's probability of label 1 for each text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for part in words(texts):
        idx, doc = grams(part)
        total += np.bincount(doc, weights[idx], len(texts))
        n += np.bincount(doc, minlength=len(texts))
    return sigmoid(float(weights[-1]) + SCALE * total / np.maximum(n, 1))


def bounded_sample(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most `most` labelled rows, the ones of smallest key hash: the same rows however the table is partitioned."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    return rows.withColumn("__h", F.xxhash64("__key")).orderBy("__h", "__key", "__label").limit(most)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 6000) -> np.ndarray:
    """Weights fitted on at most `most` labelled rows (a bound, so sample and model fit in the driver).

    Executors turn texts into sparse vectors; the driver makes the FTRL steps in the order of the keys' hashes. Of sampled keys
    that many rows share, at most 2 most rows are learnt from."""
    sample = F.broadcast(bounded_sample(labels, key, label, most))
    rows = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).join(sample, F.col("__doc") == F.col("__key"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(x) for x in strings(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__h"), batch.column("__label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["h", "label", "idx", "value"],
            )

    got = rows.mapInArrow(vectors, "h long, label int, idx binary, value binary").limit(2 * most).toPandas().sort_values(["h", "label", "idx"], kind="stable")
    return Ftrl().fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for y, i, v in zip(got.label, got.idx, got.value)])


def score_column(weights: np.ndarray):
    """A pandas UDF from text to the score, NaN-free."""
    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores([x or "" for x in text], weights))

    return score


def classify(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with columns score and predicted (1 where the score is at least the threshold)."""
    return docs.withColumn("score", score_column(weights)(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
