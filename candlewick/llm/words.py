"""Vectorised word helpers used inside Arrow tasks.

A word is a maximal run of characters other than space and the control
characters 0x09-0x0D.  Those separators are ASCII, so words can be found on
the UTF-8 bytes of an Arrow string array without decoding it.  Hashes are 64
bit polynomials over random byte values, finished with a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U64 = np.uint64
_BYTE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
#: odd, 3 modulo 4, so that 1 - P has one factor of two only
_P = 0x9E3779B97F4A7C17
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    size, top = 1, base & _MASK
    while size < n:
        step = min(size, n - size)
        out[size:size + step] = out[:step] * _U64(top)
        size, top = size + step, top * top & _MASK
    return out


class _Powers:
    """Powers of P and of its inverse, grown on demand, kept per worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_P, n), _powers(pow(_P, -1, 1 << 64), n)
        return self.up, self.down


_POWERS = _Powers()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + n + 1] if n else np.zeros(1, np.int64)
    data = array.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    starts: np.ndarray  # byte offsets of each word
    ends: np.ndarray
    row: np.ndarray  # row of each word
    counts: np.ndarray  # words per row
    first: np.ndarray  # index of each row's first word, one entry more than rows


def split(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """The words of each row; ``between`` flags the bytes that are of no word."""
    rows = len(offsets) - 1
    inside = ~between[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edge = offsets[1:-1]
        before[edge[edge < len(data)]] = False
        after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(row, minlength=rows)[:rows] if rows else np.zeros(0, np.int64)
    return Words(starts, ends, row, counts, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def word_hashes(data: np.ndarray, words: Words, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word; ``lower`` folds A-Z."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(data) + 1)  # an empty line may start behind the last byte
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:len(data)], out=total[1:])
    return mix64((total[words.ends] - total[words.starts]) * down[words.starts])


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (positions that have k
    words after them in the array; the caller drops those that cross rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, hashes, 1
    bits = k
    while bits:
        if bits & 1:
            piece = part[done:done + n]
            out = piece.copy() if out is None else out + piece * _U64(pow(_Q, done, 1 << 64))
            done += width
        bits >>= 1
        if bits:
            part = part[:-width] + part[width:] * _U64(pow(_Q, width, 1 << 64))
            width *= 2
    return mix64(out)


def inside_rows(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each position on are of one row."""
    n = len(words.row) - k + 1
    return words.row[:n] == words.row[k - 1:] if n > 0 else np.zeros(0, bool)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences (byte planes, zstandard)."""
    import zstandard

    steps = np.diff(values, prepend=_U64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(body: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Small numbers (below 2**32) as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_counts(body: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()
