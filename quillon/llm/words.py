"""Hashes of words and of word shingles, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS_PER_SHINGLE = 5
#: Texts are taken together up to so many bytes; a longer one stands alone.
CHUNK = 1 << 19

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = _rng.integers(0, 1 << 64, 1 << 13, dtype=np.uint64) | np.uint64(1)
_STEPS = _rng.integers(0, 1 << 64, WORDS_PER_SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACE] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, hashes) of runs of rows: words [bounds[i], bounds[i + 1]) are those of row first + i.

    Words are what stands between the bytes \\x20 and \\x09 to \\x0d, A-Z taken as a-z. A word's hash is a sum of products
    of a number for each byte and one for its place, with the length, mixed. Nulls have no words.
    """
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        at = offsets[row : end + 1] - offsets[row]
        part = data[offsets[row] : offsets[end]]
        if not len(part):
            yield row, np.zeros(end - row + 1, np.int64), np.zeros(0, np.uint64)
            row = end
            continue
        space = _SPACE[part]
        begins = np.empty(len(part), dtype=bool)
        begins[0] = True
        begins[1:] = space[:-1]
        begins[at[:-1][at[:-1] < len(part)]] = True
        starts = np.flatnonzero(begins & ~space)
        if len(starts):
            spread = np.zeros(len(part), np.int64)
            spread[starts] = np.diff(np.r_[0, starts])
            place = np.arange(len(part)) - np.cumsum(spread)
            place[: starts[0]] = 0
            value = _BYTE[part] * (_PLACE[place & 8191] + (place >> 13).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
            length = np.add.reduceat((~space).astype(np.uint64), starts)
            h = mixed(np.add.reduceat(value, starts) + length * np.uint64(0xD1B54A32D192ED03))
        else:
            h = np.zeros(0, np.uint64)
        yield row, np.searchsorted(starts, at), h
        row = end


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles: of all words in one if there are fewer than a shingle has."""
    k = WORDS_PER_SHINGLE
    for _, bounds, h in word_hashes(texts):
        n = len(h) - k + 1
        if n > 0:
            total = h[:n] * _STEPS[0]
            for j in range(1, k):
                total += h[j : j + n] * _STEPS[j]
            windows = mixed(total)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            elif b > a:
                yield mixed((h[a:b] * _STEPS[: b - a]).sum(keepdims=True) + _STEPS[k:] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
