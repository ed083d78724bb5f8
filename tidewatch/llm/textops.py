"""Word hashes and shingle sets of Arrow text columns, a block of documents at a time in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Words and
shingles stand as 64-bit hashes: two different shingles of a pair of documents are taken for one
with a probability below 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _BASE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))
    return _POWERS


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null is an empty text."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): document d has the words bounds[d] to bounds[d + 1]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < n]
    head[edges] = inside[edges]
    starts = np.flatnonzero(head)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    words = np.cumsum(head) - 1
    where = np.flatnonzero(inside)
    place = where - starts[words[where]]
    lengths = np.bincount(words[where], minlength=len(starts))
    values = _CODES[data[where]] * _powers(int(lengths.max()))[place]
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    sums = np.add.reduceat(values, firsts)
    return mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document.

    With fewer words than the width the whole sequence is the one shingle; without words there is none.
    """
    full = max(0, len(words) - width + 1)
    grams = words[:full]
    for k in range(1, width):
        grams = mix(grams * _BASE + words[k : full + k])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = mix(np.asarray([short]) * _BASE + w)[0]
            yield np.asarray([short], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
