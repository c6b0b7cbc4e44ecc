"""Vectorised hashing of the words and word shingles of Arrow text columns.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, so all work
is done on UTF-8 bytes. Word hashes come from a polynomial prefix sum modulo
2**64 that is divided by the power of the word's start; a finaliser mixes them.
Texts are handled in chunks of about ``CHUNK`` bytes, so memory follows the
longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_LOW += 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on uint64, with a salt for independent hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
        have = _powers[str(base)] = out
    return have[:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about CHUNK bytes; longer rows are alone."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _WS, prefixes: tuple[int, ...] = ()):
    """Word hashes of some texts in order, and per text the index of its first word (one more at the end).

    ``gaps`` says which bytes separate words. With ``prefixes`` the hashes of
    the words' first so many bytes follow, one array each (shorter words whole).
    """
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *(np.zeros(0, np.uint64) for _ in prefixes))
    inside = ~gaps[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LOW[data] * _pow(_BASE, n), out=sums[1:])
        scale = _pow(_INV, n)[starts]
        words = mix((sums[ends] - sums[starts]) * scale)
        heads = [mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * scale, k) for k in prefixes]
    return (words, np.searchsorted(starts, offsets), *heads)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles.

    A text with fewer words than ``size`` has its whole sequence as one
    shingle; one without words, or null, has none.
    """
    weights = [np.uint64(pow(_BASE, k + 3, 1 << 64)) for k in range(size)]
    with np.errstate(over="ignore"):
        for _, data, offsets in chunks(column):
            words, at = hash_words(data, offsets)
            if len(words) >= size:
                joined = sum(words[k : len(words) - size + 1 + k] * weights[k] for k in range(size))
                joined = mix(joined, size)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a >= size:
                    yield np.unique(joined[a : b - size + 1])
                elif b > a:
                    yield mix(sum(words[a + k : a + k + 1] * weights[k] for k in range(b - a)), 100 + b - a)
                else:
                    yield np.zeros(0, np.uint64)
