"""The hash that deals keys to shards: DES with an all-zero key over the big-endian key.

The key is weak: all round keys are zero, so the function is its own inverse. Vectorised over numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the DES standard (FIPS 46-3): the S-boxes and the permutation P. IP and E follow from rules below.
_S = [
    "14 4 13 1 2 15 11 8 3 10 6 12 5 9 0 7 0 15 7 4 14 2 13 1 10 6 12 11 9 5 3 8 4 1 14 8 13 6 2 11 15 12 9 7 3 10 5 0 15 12 8 2 4 9 1 7 5 11 3 14 10 0 6 13",
    "15 1 8 14 6 11 3 4 9 7 2 13 12 0 5 10 3 13 4 7 15 2 8 14 12 0 1 10 6 9 11 5 0 14 7 11 10 4 13 1 5 8 12 6 9 3 2 15 13 8 10 1 3 15 4 2 11 6 7 12 0 5 14 9",
    "10 0 9 14 6 3 15 5 1 13 12 7 11 4 2 8 13 7 0 9 3 4 6 10 2 8 5 14 12 11 15 1 13 6 4 9 8 15 3 0 11 1 2 12 5 10 14 7 1 10 13 0 6 9 8 7 4 15 14 3 11 5 2 12",
    "7 13 14 3 0 6 9 10 1 2 8 5 11 12 4 15 13 8 11 5 6 15 0 3 4 7 2 12 1 10 14 9 10 6 9 0 12 11 7 13 15 1 3 14 5 2 8 4 3 15 0 6 10 1 13 8 9 4 5 11 12 7 2 14",
    "2 12 4 1 7 10 11 6 8 5 3 15 13 0 14 9 14 11 2 12 4 7 13 1 5 0 15 10 3 9 8 6 4 2 1 11 10 13 7 8 15 9 12 5 6 3 0 14 11 8 12 7 1 14 2 13 6 15 0 9 10 4 5 3",
    "12 1 10 15 9 2 6 8 0 13 3 4 14 7 5 11 10 15 4 2 7 12 9 5 6 1 13 14 0 11 3 8 9 14 15 5 2 8 12 3 7 0 4 10 1 13 11 6 4 3 2 12 9 5 15 10 11 14 1 7 6 0 8 13",
    "4 11 2 14 15 0 8 13 3 12 9 7 5 10 6 1 13 0 11 7 4 9 1 10 14 3 5 12 2 15 8 6 1 4 11 13 12 3 7 14 10 15 6 8 0 5 9 2 6 11 13 8 1 4 10 7 9 5 0 15 14 2 3 12",
    "13 2 8 4 6 15 11 1 10 9 3 14 5 0 12 7 1 15 13 8 10 3 7 4 12 5 6 11 0 14 9 2 7 11 4 1 9 12 14 2 0 6 10 13 15 3 5 8 2 1 14 7 4 10 8 13 15 12 9 0 3 5 6 11",
]
_P = "16 7 20 21 29 12 28 17 1 15 23 26 5 18 31 10 2 8 24 14 32 27 3 9 19 13 30 6 22 11 4 25"

_U = np.uint64


def _permute(x: np.ndarray, order: list[int], width: int) -> np.ndarray:
    """Bits of x (1 is the highest of `width`) in a new order."""
    out = np.zeros_like(x)
    for i, bit in enumerate(order):
        out |= ((x >> _U(width - bit)) & _U(1)) << _U(len(order) - 1 - i)
    return out


_IP = [64 - 8 * (i % 8) - (6, 4, 2, 0, 7, 5, 3, 1)[i // 8] for i in range(64)]
_FP = [_IP.index(i + 1) + 1 for i in range(64)]


def _boxes() -> list[np.ndarray]:
    """For each box: from its six input bits to the permuted 32 bits of the round function."""
    out, order = [], [int(x) for x in _P.split()]
    for box, line in enumerate(_S):
        values = [int(x) for x in line.split()]
        six = np.arange(64)
        row, column = (six >> 5 << 1) | (six & 1), (six >> 1) & 15
        four = np.array(values, np.uint64)[row * 16 + column]
        out.append(_permute(four << _U(28 - 4 * box), order, 32))
    return out


_BOXES = _boxes()


def shard_hash_array(keys: np.ndarray) -> np.ndarray:
    """The hash of each unsigned 64-bit key."""
    x = _permute(keys.astype(np.uint64), _IP, 64)
    left, right = x >> _U(32), x & _U(0xFFFFFFFF)
    for _ in range(16):
        # box i reads bits 4i-1 to 4i+4 of the right half, going round
        round_right = (right << _U(1)) | (right >> _U(31)) | ((right & _U(1)) << _U(33))
        f = np.zeros_like(right)
        for box in range(8):
            f ^= _BOXES[box][((round_right >> _U(28 - 4 * box)) & _U(63)).astype(np.int64)]
        left, right = right, left ^ f
    return _permute(right << _U(32) | left, _FP, 64)


@F.pandas_udf(T.LongType())
def _hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for keys in batches:
        found = shard_hash_array(keys.fillna(0).to_numpy(np.int64).view(np.uint64)).view(np.int64)
        yield pd.Series(found).astype("Int64").mask(keys.isna().to_numpy())


def shard_hash(key: Column) -> Column:
    """The hash as a signed long with the same bits; null for null. Its own inverse."""
    return _hash(key.cast("long"))


def in_shard(key: Column, shard: str) -> Column:
    """Whether a key belongs to a shard such as `-80`, `40-80` or `80-`: the range of the hash's first bytes."""
    low, _, high = shard.partition("-")
    top = F.shiftrightunsigned(shard_hash(key), 32)
    bound = lambda text: int(text.ljust(8, "0")[:8], 16)
    out = F.lit(True)
    if low:
        out = out & (top >= bound(low))
    if high:
        out = out & (top < bound(high))
    return out & key.isNotNull()
