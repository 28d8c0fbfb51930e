"""Words of many texts at once, as hashes: one numpy pass over the UTF-8 bytes, with no vocabulary to keep.

A word is a run of ASCII letters, digits, underscores and bytes of other characters; runs of the remaining printable
ASCII are words of their own; bytes up to 0x20 separate. A-Z hash as a-z."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: UTF-8 bytes that are worked on at once. Longer texts are cut at white space; n-grams don't span such a cut.
SLICE = 1 << 20
_P = 0x9E3779B97F4A7C55
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES == 95) | (_BYTES >= 128)
_CLASS = np.where(_BYTES <= 32, 0, np.where(_WORD, 1, 2)).astype(np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)
_UPPER = ((_BYTES >= 65) & (_BYTES <= 90)).astype(np.uint8)
_DIGIT = ((_BYTES >= 48) & (_BYTES <= 57)).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """The words of a slice: the number of its text, the hash of the lower-cased word, and a code of its shape."""

    doc: np.ndarray
    word: np.ndarray
    shape: np.ndarray


def _words(data: bytes, first: np.ndarray, docs: np.ndarray) -> Words:
    raw = np.frombuffer(data, np.uint8)
    up, down = powers(len(raw) + 1)
    kind = _CLASS[raw]
    change = np.empty(len(raw) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * up[:-1], out=total[1:])
    word = mix((total[end] - total[start]) * down[start])
    # upper-case Latin letters of two bytes: 0xC3 0x80-0x9E
    upper = _UPPER[raw]
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    uppers = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(upper, out=uppers[1:], dtype=np.int32)
    n_upper, length = uppers[end] - uppers[start], end - start
    head = raw[start]
    titled = upper[start].astype(bool) | (upper[np.minimum(start + 1, len(raw) - 1)].astype(bool) & (head == 0xC3))
    form = np.where(_DIGIT[head] == 1, 3, np.where((n_upper >= 2), 2, np.where(titled, 1, 0))) * 8 + np.minimum(length // 4, 4)
    shape = np.where(kind[start] == 2, word | np.uint64(64), form.astype(np.uint64))
    doc = docs[np.searchsorted(first, start, "right") - 1]
    return Words(doc, word, shape)


def words(texts: list[str]) -> Iterator[Words]:
    """The words of the texts, in slices of about SLICE bytes."""
    data, first, docs, size = [], [], [], 0

    def flush() -> Words:
        return _words(b"".join(data), np.array(first, np.int64), np.array(docs, np.int64))

    for i, text in enumerate(texts):
        whole = text.encode("utf-8", "surrogatepass")
        start = 0
        while start < len(whole):
            stop = min(len(whole), start + SLICE)
            if stop < len(whole):
                cut = max(whole.rfind(b" ", start, stop), whole.rfind(b"\n", start, stop))
                stop = cut + 1 if cut > start else stop
            if data and size + stop - start > SLICE:
                yield flush()
                data, first, docs, size = [], [], [], 0
            first.append(size)
            docs.append(i)
            data += [whole[start:stop], b"\n"]
            size += stop - start + 1
            start = stop
    if data:
        yield flush()
