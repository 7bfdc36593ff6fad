"""Words of many texts at once, on the bytes of an Arrow batch.

Both word classes of the contracts are runs of ASCII characters out of a set, or of anything beyond
ASCII, so on UTF-8 they are runs of bytes and no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTE = np.arange(256)
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)  # of lower-cased bytes
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers of it can be divided out modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 1 << 21


class Texts:
    """``data``: bytes of all texts; text i is data[offsets[i]:offsets[i + 1]]; null is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def words(self, kind: np.ndarray) -> Words:
        return Words(self, kind)


class Words:
    """``starts`` and ``ends`` in the bytes of each word; words of text i are first[i] to first[i + 1]."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        self.texts = texts
        inside, edge = kind[texts.data], np.zeros(len(texts.data) + 1, bool)
        edge[texts.offsets] = True
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.texts.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def bytes_of(self, at: int) -> bytes:
        return self.texts.data[self.starts[at] : self.ends[at]].tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over all (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes: differences of one running polynomial."""
    if not len(starts):
        return np.empty(0, np.uint64)
    powers = np.full(len(data), BASE)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    powers[:] = _INVERSE
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mixed((total[ends] - total[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words, at its first word; text bounds are the caller's."""
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= BASE
        total += h[k : k + n]
    return mixed(total)


def slices(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Texts]]:
    """A text column in runs of whole rows of about SLICE_BYTES: (first row, row after the last, texts)."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        own = data[at[lo] : at[hi]]
        yield lo, hi, Texts(LOWER[own] if lower else own, at[lo : hi + 1] - at[lo])
        lo = hi


def per_text_sum(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's words."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
