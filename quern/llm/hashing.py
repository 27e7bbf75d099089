"""Vectorised words: 64-bit hashes of all words of a batch of texts.

A word is a run of bytes outside space and 0x09-0x0D, which in UTF-8 never occur inside
another character.  A word's hash is the sum of one pseudo-random number for each of its
(position, byte) pairs, mixed with its length, so that no Python object is made for a word
and no pair of words collides by its structure, as polynomials modulo 2**64 let them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 17  # bytes of text hashed at once; bounds the scratch arrays
#: Positions whose numbers are looked up; those beyond are computed.
POSITIONS = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _entries(position: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(mix(position.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(20240229)) + byte.astype(U64) * U64(0xD6E8FEB86659FD93))


_TABLE = _entries(np.repeat(np.arange(POSITIONS), 256), np.tile(np.arange(256), POSITIONS))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its values; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Byte ranges of at most about SLICE bytes that cut no word; a longer word stays whole."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        if end < n:
            k = np.searchsorted(offsets, end, "right") - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                last = np.flatnonzero(_SPACE[data[at:end]])
                if len(last):
                    end = at + int(last[-1]) + 1
                else:
                    stop = int(offsets[k + 1]) if k + 1 < len(offsets) else n
                    step = end
                    while step < stop:
                        more = np.flatnonzero(_SPACE[data[step : step + SLICE]])
                        if len(more):
                            step += int(more[0]) + 1
                            break
                        step += SLICE
                    end = min(stop, step)
        yield at, end
        at = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the index of each text's first word (one more entry than
    texts), and the words' lengths in bytes."""
    data, offsets = buffers(texts)
    hashes, starts_all, lengths = [], [], []
    for a, b in _slices(data, offsets):
        part = data[a:b]
        space = _SPACE[part]
        word = ~space
        edge = np.zeros(b - a + 1, bool)
        inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        edge[inside] = True
        gap = space[:-1] | space[1:] | edge[1:-1]
        first, last = word.copy(), word.copy()
        first[1:] &= gap
        last[:-1] &= gap
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        n, h, seen = ends - starts, np.zeros(len(starts), U64), 0
        longest = int(n.max())
        for c in range(0, b - a, SLICE):  # a word may be longer
            at = np.flatnonzero(word[c : c + SLICE])
            if not len(at):
                continue
            byte = part[at + c] if c else part[at]
            if lower:
                byte = _FOLD[byte]
            if b - a <= SLICE:
                position, new = at - np.repeat(starts, n), np.cumsum(n) - n
                k = None
            else:
                k = (np.cumsum(first[c : c + SLICE])[at] + (seen - 1)).astype(np.int64)
                position, new = at + c - starts[k], np.flatnonzero(np.diff(k, prepend=-1))
            far = np.flatnonzero(position >= POSITIONS) if longest > POSITIONS else ()
            if len(far):
                value = _TABLE[np.minimum(position, POSITIONS - 1) << 8 | byte]
                value[far] = _entries(position[far], byte[far])
            else:
                value = _TABLE[position << 8 | byte]
            if k is None:
                h = np.add.reduceat(value, new)
            else:
                h[k[new]] += np.add.reduceat(value, new)
                seen = int(k[-1]) + 1
        hashes.append(mix(h + n.astype(U64) * U64(0xA0761D6478BD642F)))
        starts_all.append(starts + a)
        lengths.append(n)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offsets), np.concatenate(lengths)


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside a text, and each window's text."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        key = key * U64(0xD1342543DE82EF95) + h[i : len(h) - n + 1 + i]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = doc[: len(key)] == doc[n - 1 :]
    return mix(key[same]), doc[: len(key)][same]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, by the index of each text's first value."""
    run = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
