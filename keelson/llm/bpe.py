"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by the tokenizer's pattern; each match is encoded by itself. The distinct matches of a batch are dealt
into matrices by length, one row of token ids each, padded with -1. In every round each row merges its leftmost pair of
minimum rank: ranks of neighbours come from an open-addressing hash table of pairs, argmin picks the leftmost minimum,
the row closes up, and only the two pairs beside the merge are looked up anew. Rows without a pair to merge leave the
matrix. Matches too long for a matrix merge by a heap, to the same ids.

Defined cases: null and empty texts have no ids and decode to no bytes; every text encodes (all 256 bytes are tokens)
and decodes to its own UTF-8 bytes; an id outside the vocabulary fails; repeated rows encode alike; texts of any length
are whole; other columns are carried by name and never read."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import slices, text_slices
from keelson.llm.tokens import powers

_NONE = np.int32(2**31 - 1)
#: Matches of more bytes merge by a heap.
LONGEST = 512
#: Matches whose ids a worker keeps for later batches.
KEPT = 500_000
#: Characters of texts that are encoded together.
GROUP = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The token ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class PairTable:
    """Hash table from a pair of ids to the rank of its merge, with linear probing, all in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(8, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, self.probes = self._slot(key), 1
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = key[free]  # of several, the last one stays
            done = todo[self.keys[at[todo]] == key[todo]]
            self.ranks[at[done]] = rank[done]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; _NONE for those that don't merge and those with padding."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(key.shape, _NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, key = out.ravel(), key.ravel()[todo]
        at = self._slot(key)
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key
            flat[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            todo, key, at = todo[more], key[more], (at[more] + 1) & self.mask
        return flat.reshape(left.shape)


#: The pattern whose matches `pieces` finds without a regular expression.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _OTHER, _SPACE, _END = range(5)
_BETWEEN = 0x110000
_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """The class of every code point, and of the mark between texts."""
    if "class" not in _tables:
        table = np.full(_BETWEEN + 1, _OTHER, np.uint8)
        points = "".join(map(chr, range(_BETWEEN)))
        for kind, name in ((_LETTER, "L"), (_NUMBER, "N"), (_SPACE, "White_Space")):
            for match in regex.finditer(rf"\p{{{name}}}+", points):
                table[match.start() : match.end()] = kind
        table[_BETWEEN] = _END
        _tables["class"] = table
    return _tables["class"]


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matches of PLAIN in the texts: code points with a mark after each text, starts and ends of the matches in
    them, and the number of matches of each text."""
    parts = []
    for text in texts:
        parts += [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.array([_BETWEEN], np.uint32)]
    points = np.concatenate([*parts, np.array([_BETWEEN] * 3, np.uint32)])
    kind = _classes()[points]
    at = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    run, stop = at[:-1], at[1:]
    of = kind[run]
    first = np.zeros(len(points), bool)
    first[run] = True
    # the last space of a run goes to the word that follows, and the rest of the run is one match
    before = np.concatenate([of[1:] < _SPACE, [False]]) & (of == _SPACE)
    last = stop[before] - 1
    first[last] = True
    first[last[points[last] == 32] + 1] = False
    quote = run[(of == _OTHER) & (stop - run == 1) & (points[run] == 39)]
    quote = quote[first[quote] & (kind[quote + 1] == _LETTER)]
    one, two = points[quote + 1], points[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, n in ((quote[short], 2), (quote[long], 3)):
        first[found + 1] = False
        inside = found[kind[found + n] == _LETTER] + n
        first[inside] = True
    start = np.flatnonzero(first | (kind == _END))
    end = np.append(start[1:], len(points))
    kept = kind[start] != _END
    marks = np.flatnonzero(kind == _END)[: len(texts)]
    start, end = start[kept], end[kept]
    upto = np.searchsorted(start, marks)
    return points, start, end, np.diff(upto, prepend=0)


class Bpe:
    """Encoder and decoder of a vocabulary of byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.split = ranks, pattern, regex.compile(pattern).findall
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array([x[i] for x in triples], np.int32) for i in range(3)))
        self.merge = {(a, b): r for a, b, r in triples}
        size = max(ranks.values()) + 1
        self.length, self.known = np.zeros(size, np.int64), np.zeros(size, bool)
        by_rank: list[bytes] = [b""] * size
        for t, r in ranks.items():
            by_rank[r], self.length[r], self.known[r] = t, len(t), True
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.cache: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop the matches kept: a number for each hash, and by number where its ids begin in the pool and how many."""
        self.seen: dict[int, int] = {}
        self.pool, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.start[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merge.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.merge.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := self.merge.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return tuple(x for x in ids if x >= 0)

    def _matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.start[data], np.int32(-1))
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [()] * len(pieces)
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
            going = best != _NONE
            if not going.all():
                for i, row in zip(rows[~going].tolist(), ids[~going].tolist(), strict=True):
                    out[i] = tuple(x for x in row if x >= 0)
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
            if not len(rows):
                return out
            line, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            closed = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            closed[line, at] = best
            ids = closed
            if ranks.shape[1] == 1:
                ranks = ranks[:, :0]
                continue
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            left = np.maximum(at - 1, 0)
            ranks[line, left] = np.where(at > 0, self.pairs.get(ids[line, left], ids[line, left + 1]), ranks[line, left])
            right = np.minimum(at, ranks.shape[1] - 1)
            here = at < ranks.shape[1]
            ranks[line[here], right[here]] = self.pairs.get(ids[line, right], ids[line, right + 1])[here]

    def _learn(self, pieces: list[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > LONGEST:
                self.cache[piece] = self._long(raw)
            else:
                n = len(raw)
                width = n if n <= 16 else -(-n // 8) * 8 if n <= 64 else -(-n // 64) * 64
                by_width.setdefault(width, []).append((piece, raw))
        for width, group in by_width.items():
            step = max(1, 2_000_000 // (width * 8))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.cache.update(zip((x for x, _ in part), self._matrix([x for _, x in part], width), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Unseen matches of a group of texts are merged together, in full matrices."""
        out = []
        for start, stop in slices([len(x) for x in texts], GROUP):
            out += self._group(texts[start:stop]) if self.pattern == PLAIN else self._by_pattern(texts[start:stop])
        return out

    def _by_pattern(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(x) for x in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        if len(self.cache) + len(new) > KEPT:
            self.cache.clear()
            new = set(chain.from_iterable(split))
        self._learn(list(new))
        return [np.fromiter(chain.from_iterable(map(self.cache.__getitem__, x)), np.int32) for x in split]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        points, start, end, counts = pieces(texts)
        up, down = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint32(1)).astype(np.uint64) * up[:-1], out=total[1:])
        hashes, where, code = np.unique((total[end] - total[start]) * down[start], return_index=True, return_inverse=True)
        # matches of one hash are compared with its first one, code point by code point
        size, first = end - start, start[where][code]
        same = size == size[where][code]
        ends = np.cumsum(size)
        offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        if not same.all() or not (points[np.repeat(start, size) + offset] == points[np.repeat(first, size) + offset]).all():
            return self._by_pattern(texts)
        keys = (hashes + size[where].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).tolist()
        codes = np.fromiter((self.seen.get(x, -1) for x in keys), np.int64, len(keys))
        new = np.flatnonzero(codes < 0)
        if len(self.seen) + len(new) > KEPT:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            a, b = start[where[new]].tolist(), end[where[new]].tolist()
            names = [points[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(a, b, strict=True)]
            self.cache.clear()
            self._learn(names)
            found = [self.cache[name] for name in names]
            self.cache.clear()
            length = np.fromiter(map(len, found), np.int64, len(found))
            codes[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.seen.update(zip((keys[i] for i in new.tolist()), codes[new].tolist(), strict=True))
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(length) - length])
            self.size = np.concatenate([self.size, length])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.int32, int(length.sum()))])
        of = codes[code]
        n = self.size[of]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[of] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.append(0, ends)[np.cumsum(counts)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not of the vocabulary")
        out, step = [], 1 << 18
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            n = self.length[part]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.offset[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_built: dict[tuple, Bpe] = {}


def built(ranks: dict[bytes, int], pattern: str, name: str) -> Bpe:
    """The codec of a vocabulary, made once in each worker."""
    if (name, pattern) not in _built:
        _built.clear()
        _built[name, pattern] = Bpe(ranks, pattern)
    return _built[name, pattern]


def _shipped(df: DataFrame, path: str):
    """The vocabulary as a broadcast (its size is the file's), and a digest that names it."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(ranks), name


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids, an array<int>, empty for null texts."""
    sent, name = _shipped(docs, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(built(sent.value, pattern, name).encode([x or "" for x in texts]))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column of the bytes that its ids stand for, none for null."""
    sent, name = _shipped(docs, path)

    @F.pandas_udf(T.BinaryType())
    def raw(column: pd.Series) -> pd.Series:
        codec = built(sent.value, pattern, name)
        return pd.Series([codec.decode(np.asarray(x if x is not None else [], np.int32)) for x in column])

    return docs.withColumn(out, raw(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the decoded bytes, and the
    carried columns.

    Ids and decoded bytes of a row are made and digested side by side, so they don't leave the worker."""
    sent, name = _shipped(docs, path)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = built(sent.value, pattern, name)
        decimal = np.array([str(i) for i in range(len(codec.known))], object)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for _, texts in text_slices(batch.column("__text"), GROUP):
                for ids in codec.encode(texts):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(decimal[ids]).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), *[batch.column(f"__carried_{i}") for i in range(len(carried))]], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", *carried])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *[F.col(c).alias(f"__carried_{i}") for i, c in enumerate(carried)])
    return rows.mapInArrow(run, ", ".join([kinds[0], "n_tokens long, ids_sha256 string, decoded_sha256 string", *kinds[1:]]))
