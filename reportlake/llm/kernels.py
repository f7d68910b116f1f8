"""Vectorised text kernels over Arrow string columns.

All of them work on a block of concatenated texts: ``buf`` holds the UTF-8
bytes, ``offs`` the start of each text and the end of the last.  Hashes are
polynomials modulo 2**64 with an odd base, so the hash of any slice comes from
two prefix sums and one multiplication, and are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; one longer text is a block of its own.
BLOCK_BYTES = 3 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
#: For a second fingerprint of the same words.
OTHER_BASE = 0xC2B2AE3D27D4EB4F | 1


class _Cache(dict):
    """Travels empty: each worker fills its own."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()

#: ASCII white space: space and 0x09 to 0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Letters, digits and every byte of a multi-byte character.
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def _power_pair(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.empty(size, dtype=U)
            out[0] = 1
            m = 1
            while m < size:
                k = min(m, size - m)
                out[m : m + k] = out[:k] * U(pow(b, m, 1 << 64))
                m += k
            pair.append(out)
        have = _powers[base] = (pair[0], pair[1])
        if n > 4 * BLOCK_BYTES:
            del _powers[base]
    return have


class Prefix:
    """Prefix sums from which the hash of any slice of ``values`` follows."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        up, self._down = _power_pair(base, n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        terms = values.astype(U)
        terms += U(1)
        terms *= up[:n]
        np.cumsum(terms, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end]
        h -= self.sums[start]
        h *= self._down[start]
        return h

    def every(self, k: int) -> np.ndarray:
        """Unmixed hashes of all slices of length ``k``."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, dtype=U)
        h = self.sums[k:] - self.sums[: n - k + 1]
        h *= self._down[: n - k + 1]
        return h


def word_prefix(hashes: np.ndarray, base: int = _WORD_BASE) -> Prefix:
    return Prefix(hashes, base)


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take at most ``most`` bytes together, one row at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def text_blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES):
    """``(first row, end row, bytes, offsets)`` for each block of a batch."""
    buf, offs = text_of(batch.column(batch.schema.get_field_index(text)))
    for i, j in blocks(offs, most):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


class Words:
    """The words of a block: byte ranges, the document of each, words before each document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, kind: str = "space"):
        inside = _IS_ALNUM[buf] if kind == "alnum" else ~_IS_SPACE[buf]
        n = len(buf)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def hashes(self, buf: np.ndarray, lower: bool = False) -> np.ndarray:
        p = Prefix(_LOWER[buf] if lower else buf)
        return mix(p.raw(self.start, self.end))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    m, span = a, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    return m


def groups_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal keys, and the run's number for each key."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
