"""Hashes of words and of word shingles for many texts at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import flat_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LIMIT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    """A random number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for base in (int(_BASE), inverse):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(1 << max(16, int(n).bit_length()))


def slices(texts: pa.Array, most: int = _LIMIT):
    """(lo, hi) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    if not len(texts):
        return
    size = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
    upto = np.cumsum(size)
    cut = np.flatnonzero(np.diff((upto - 1) // most)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(texts)])


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, A-Z in lower case, one text after the other, and where each text begins in them."""
    offsets, data = flat_bytes(own)
    raw = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # A gap behind each text, so that no word crosses into the next.
    n = len(raw) + len(own)
    buffer = np.full(n, 0x20, dtype=np.uint8)
    starts = offsets[:-1] + np.arange(len(own))
    buffer[np.arange(len(raw)) + np.repeat(np.arange(len(own)), np.diff(offsets))] = raw
    buffer = LOWER[buffer]
    inside = ~SPACE[buffer]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers_for(n)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte_codes()[buffer] * power[:n], dtype=np.uint64)))
    return mix((prefix[end] - prefix[begin]) * inverse[begin]), np.searchsorted(begin, np.append(starts, n))


def shingle_sets(texts: pa.Array, words: int):
    """For each text the sorted distinct hashes of its shingles of so many words.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    coef = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
    for lo, hi in slices(texts):
        word, first = word_hashes(texts.slice(lo, hi - lo))
        grams = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
        for k in range(words):
            grams += word[k : k + len(grams)] * coef[k]
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                part = word[a:b]
                yield mix((part * coef[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield part0


part0 = np.zeros(0, dtype=np.uint64)
