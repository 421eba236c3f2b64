"""Word shingles of Arrow text columns, hashed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BLOCK_BYTES = 500_000
_WEIGHTS = np.random.default_rng(20240501).integers(1, 2**63, 4096, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_CODES = np.random.default_rng(20240502).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE_CODES = np.random.default_rng(20240503).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, row offsets) of runs of rows of about 500 KB, one row at least."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK_BYTES, "right")) - 1)
        cut = raw[offsets[first] : offsets[last]]
        yield first, _LOWER[cut], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of every row's first word and the end)."""
    rows = len(offsets) - 1
    inside = ~_SPACE[raw]
    # A word starts where a row starts or white space precedes it.
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] = inside[edges]
    begin = np.flatnonzero(starts)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    nth = np.cumsum(starts) - 1
    at = np.flatnonzero(inside)
    place = at - begin[nth[at]]
    codes = _BYTE_CODES[raw[at]] * _WEIGHTS[place % 4096] + place.astype(np.uint64)
    first = np.flatnonzero(starts[at])
    sums = np.add.reduceat(mix(codes), first)
    return mix(sums), np.searchsorted(begin, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles; of fewer words, one for the whole sequence."""
    if len(words) >= size:
        grams = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            grams += mix(words[i : len(words) - size + 1 + i] + _PLACE_CODES[i]) * _PLACE_CODES[i + 1]
        grams = mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            codes = _PLACE_CODES[1 : b - a + 1]
            yield mix(np.array([np.sum(mix(words[a:b] + codes) * codes, dtype=np.uint64) + _U(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles."""
    for _, raw, offsets in blocks(texts):
        words, bounds = word_hashes(raw, offsets)
        yield from shingle_sets(words, bounds, size)
