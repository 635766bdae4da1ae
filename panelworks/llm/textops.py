"""Vectorised text work inside tasks: words, shingles and their hashes over Arrow blocks.

Spark cuts the table into partitions and Arrow batches; here a batch is cut into blocks of bounded
bytes, and every step is a numpy pass over a block's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + U((seed * _BASE + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(_MIX1)
    x = (x ^ (x >> U(27))) * U(_MIX2)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), U(base), U)
        got[0] = 1
        got = _POWERS[base] = np.cumprod(got, dtype=U)
    return got[:n]


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each values[start:end], the same for equal slices wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(_BASE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(U) * U(_MIX2))


@dataclass
class Block:
    """Some documents of a batch. ``first``/``last``: positions in the batch; ``data``: their bytes; ``bounds``: where each
    document's bytes begin, and the end; ``starts``/``ends``: the words' bytes; ``of``: document of each word;
    ``edges``: where each document's words begin, and the end."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    edges: np.ndarray

    def word_hashes(self) -> np.ndarray:
        return slice_hashes(self.data.astype(U) + U(1), self.starts, self.ends)


def raw_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of runs of documents of about ``block_bytes``; a longer document is a block of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def blocks(texts: pa.Array, lower: bool = False, block_bytes: int = BLOCK_BYTES, apart: np.ndarray = _IS_SPACE) -> Iterator[Block]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of whole texts; null is empty; ``lower`` turns A-Z to a-z. ``apart``: the bytes between words, where others."""
    for first, last, data, bounds in raw_blocks(texts, block_bytes):
        if lower:
            data = _LOWER[data]
        word = ~apart[data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        begins, closes = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1] | cut[1:n]
            closes[:-1] &= ~word[1:] | cut[1:n]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        edges = np.searchsorted(starts, bounds)
        yield Block(first, last, data, bounds, starts, ends, np.repeat(np.arange(last - first), np.diff(edges)), edges)


def windows(hashes: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all windows of ``width`` consecutive words inside one document."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U)
    ends = np.repeat(edges[1:], np.diff(edges))
    places = np.flatnonzero(np.arange(n) + width <= ends)
    return places, slice_hashes(hashes, places, places + width)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return x.astype(U, copy=False).view(np.int64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
