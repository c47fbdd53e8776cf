"""Vectorised word segmentation and rolling hashes over Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and bytes above 127; case is folded for
ASCII and for the Latin-1 letters.  Everything works on whole batches of UTF-8 bytes in numpy, so a
text costs a few tens of nanoseconds a byte and is never cut.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: A piece has fewer rows than 2 ** ROW_BITS.
ROW_BITS = 16

_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters in UTF-8."""
    low = _LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    tail = low[at]
    low[at] = tail + np.where((tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97), 0x20, 0).astype(np.uint8)
    return low


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the rows lo..hi of a column: byte ranges, hashes, row of each, and each row's first word."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def grams(self, k: int, base: int = _GRAM) -> np.ndarray:
        """Hash of the k words from each word on; those that leave their row are meaningless."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64)
        out = np.empty(n - k + 1, np.uint64)
        power, inverse = _powers(base, min(n, CHUNK_BYTES + k) + 1)
        for i in range(0, n - k + 1, CHUNK_BYTES):  # in blocks, for rows of any length
            part = self.hash[i : i + CHUNK_BYTES + k - 1]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            m = len(part) - k + 1
            out[i : i + m] = (total[k:] - total[:m]) * inverse[:m]
        return mix(out)

    def anchors(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Content-chosen words and the hash of the k words from them on: the least hash of every `window` consecutive
        k-grams of a row, the leftmost of equals.  Any two equal runs of k + window - 1 words have a common anchor."""
        grams = self.grams(k)
        if len(grams) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = np.uint64((1 << int(len(grams)).bit_length()) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span < window:
            step = min(span, window - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        inside = self.row[: len(least)] == self.row[k + window - 2 :]
        chosen = np.zeros(len(grams), bool)
        chosen[(least[inside] & low).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        return at, grams[at]


def segment(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The column's words, in pieces of whole rows of about chunk_bytes bytes; a longer row is a piece of its own."""
    buf, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1), lo + (1 << ROW_BITS) - 1)
        yield _segment(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)
        lo = hi


def _segment(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, buf, offsets, none, none, np.zeros(0, np.uint64), none, np.zeros(hi - lo + 1, np.int64))
    inside = _WORD[buf]
    begins, ends = inside.copy(), inside.copy()
    before = inside[:-1].copy()
    after = inside[1:].copy()
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge - 1] = False
    after[edge - 1] = False
    begins[1:] &= ~before
    ends[:-1] &= ~after
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # in blocks of whole words, for rows of any length
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, "right")))
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        size = int(e[-1])
        power, inverse = _powers(_BASE, size + 1)
        value = fold_case(buf[start[i] : end[j - 1]]).astype(np.uint64)
        value += np.uint64(1)
        value *= power[:size]
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        hashes[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    hashes = mix(hashes)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(lo, hi, buf, offsets, start, end, hashes, row, first)
