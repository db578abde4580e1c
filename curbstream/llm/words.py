"""Words, shingles and rolling hashes over Arrow string columns, in numpy on whole slices of documents.

A word is ``[^\\x20\\x09-\\x0D]+``. Slices hold about a megabyte of text, so memory stays bounded however large a batch
is; a longer document is a slice by itself. Hashes are polynomials modulo 2^64 with a random value per byte, mixed.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_CACHE: dict[tuple[int, str], np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse; kept up to one slice."""
    size = max(n, SLICE + 1)
    out = []
    for kind, b in (("p", base), ("i", _inverse(base))):
        p = _CACHE.get((int(base), kind))
        if p is None or len(p) < n:
            p = powers(b, size)
            if size <= SLICE + 1:
                _CACHE[(int(base), kind)] = p
        out.append(p[:n])
    return out[0], out[1]


def byte_values(seed: int, lower: bool, space: np.ndarray) -> np.ndarray:
    """A random 64-bit value per byte; bytes between words are 0, and A-Z count as a-z if ``lower``."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * _STEP + np.uint64(seed))
    if lower:
        v[65:91] = v[97:123]
    v[space] = 0
    return v


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """The words of some documents: byte span and document of each, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each document's first word; one entry more than documents
    space: np.ndarray  # which bytes stand between words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, inv = _powers(_BASE, len(self.data))
        v = byte_values(seed, lower, self.space)[self.data]
        v *= p
        return mix(np.add.reduceat(v, self.start) * inv[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``k`` consecutive words of one document, and the index of their first word."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if k <= 8:
            g = np.zeros(n, np.uint64)
            for i, c in enumerate(powers(_STEP, k)):
                g += h[i : i + n] * c
        else:
            p, inv = _powers(_STEP, len(h))
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p, dtype=np.uint64)])
            g = (s[k:] - s[:-k]) * inv[:n]
        last = np.repeat(self.first[1:], self.counts)[:n]
        at = np.flatnonzero(np.arange(n) + k <= last)
        return mix(g[at]), at

    def docs(self, at: np.ndarray) -> np.ndarray:
        """The document of each word index."""
        return np.searchsorted(self.first, at, "right") - 1


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return off, np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split(off: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of the documents whose byte offsets are ``off``; ``space`` tells which bytes stand between words."""
    base, b = off[0], data[off[0] : off[-1]]
    rel = off - base
    inside = ~space[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[rel] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1])) if len(b) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1 if len(b) else np.zeros(0, np.int64)
    return Words(b, start, end, np.searchsorted(start, rel, "left"), space)


def word_slices(col: pa.Array, limit: int = SLICE, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    off, data = texts(col)
    for lo, hi in slices(off, limit):
        yield lo, hi, split(off[lo : hi + 1], data, space)


def shingles(w: Words, k: int, lower: bool = True, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles and the document of each; shorter documents are one shingle, empty ones none."""
    h = w.hashes(seed, lower)
    g, at = w.windows(h, k)
    docs, n = w.docs(at), w.counts
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        few = np.array([int(mix(np.bitwise_xor.reduce(mix(h[w.first[d] : w.first[d + 1]] + np.arange(1, n[d] + 1, dtype=np.uint64) * _STEP), keepdims=True) + np.uint64(n[d]))[0]) for d in short], np.uint64)
        g, docs = np.concatenate([g, few]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        g, docs = g[order], docs[order]
    return g, docs


class Bloom:
    """A set of 64-bit values with no false negatives, of a fixed size in bytes: it may be broadcast whatever the data."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def empty(log2_bits: int) -> "Bloom":
        return Bloom(np.zeros(1 << (log2_bits - 3), np.uint8))

    def _places(self, values: np.ndarray) -> Iterator[np.ndarray]:
        x = mix(values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.uint64))
        y = mix(x + _BASE)
        for i in range(4):
            yield (x + np.uint64(i) * (y | np.uint64(1))) & self.mask

    def add(self, values: np.ndarray) -> None:
        for at in self._places(values):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for at in self._places(values):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out
