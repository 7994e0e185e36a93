"""Words of many texts at once: boundaries and 64-bit hashes as flat arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the odd base of the polynomial hash with its inverse modulo 2**64.
BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
#: Letters and digits of ASCII, and every byte of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all its bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


@dataclass
class Words:
    """Texts `first` .. `first + n - 1` of a batch: bytes, each text's bounds, each word's bounds, text (from 0) and hash."""

    first: int
    n: int
    raw: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    sums: np.ndarray

    def hashed(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first `longest` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        _, down = _powers(len(self.raw))
        return mix((self.sums[end] - self.sums[self.start]) * down[self.start] + (end - self.start).astype(U))


def words(texts: pa.Array, lower: bool = True, limit: int = 1 << 20) -> Iterator[Words]:
    """The words of a string array, null texts as empty ones, in portions of about `limit` bytes of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        raw, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        yield _words(i, j - i, raw, at)
        i = j


def _words(first: int, n: int, raw: np.ndarray, at: np.ndarray) -> Words:
    inside = WORD[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1]  # a word ends where its text does
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, _ = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=sums[1:])
    return Words(first, n, raw, at, start, end, np.searchsorted(at, start, "right") - 1, sums)


def shingles(w: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `size` words within a text."""
    h = w.hashed() if hashes is None else hashes
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(n, U)
    for k in range(size):
        out = out * U(0x9E3779B97F4A7C15) + h[k : k + n]
    whole = w.text[:n] == w.text[size - 1 :]
    return mix(out[whole]), w.text[:n][whole]


class Lookup:
    """Positions of hashes in a sorted array of keys, most misses settled by one look into a bit table."""

    def __init__(self, keys: np.ndarray, bits: int = 18) -> None:
        self.keys, self.shift = keys, U(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in keys) of the hashes that are keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        same = self.keys[at] == hashes[near]
        return near[same], at[same]
