"""Words of a column of texts as numpy arrays: hashes over UTF-8 bytes, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that are hashed at once, or a single text: each takes some forty bytes of memory for the time.
HASHED_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on one another."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their borders); nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None and len(borders) else np.zeros(0, np.uint8)
    return raw, borders - borders[0] if len(borders) else np.zeros(1, np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of every word with A-Z lower-cased, first word of each text, its number of words).

    A word is a maximal run of bytes other than 32 and 9 to 13. Its hash is a polynomial over a random value per byte, modulo 2**64,
    from differences of prefix sums, then mixed.
    """
    parts = [_word_hashes(part) for _, part in pieces(texts, HASHED_BYTES)]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    return hashes, np.cumsum(count) - count, count


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, borders = byte_view(texts)
    n = len(raw)
    if not n:
        zero = np.zeros(len(texts), np.int64)
        return np.zeros(0, np.uint64), zero, zero
    raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    begins = np.zeros(n + 1, bool)
    begins[borders] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    powers = np.empty(n + 1, np.uint64)
    powers[0], powers[1:] = 1, _INVERSE
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[raw] * powers[:-1], out=sums[1:])
    # shift every word to the same power: multiply by BASE**start, the inverse of INVERSE**start
    back = np.empty(n + 1, np.uint64)
    back[0], back[1:] = 1, _BASE
    np.cumprod(back, out=back)
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, borders)
    return hashes, first[:-1], np.diff(first)


def pieces(texts: pa.Array, most: int = 4 << 20):
    """Slices of a column of at most `most` bytes each, or of a single text."""
    borders = byte_view(texts)[1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(borders, borders[start] + most, "right")) - 1)
        yield start, texts.slice(start, stop - start)
        start = stop
