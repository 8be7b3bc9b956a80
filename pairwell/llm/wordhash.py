"""Words of whole texts as 64-bit hashes, for a batch of texts at a time.

A word's hash is a polynomial of its bytes modulo 2**64, taken from one running sum over the batch
(the odd base has an inverse, so any word's part can be cut out and shifted), and then mixed. Equal
words have equal hashes everywhere; unequal ones collide as random 64-bit numbers would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
#: Bytes of words: all but ASCII white space; or ASCII letters, digits and all beyond ASCII.
SOLID = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 21), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _cut(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The running sum over all bytes, the powers to shift by, starts and ends of words, and where texts start; None without bytes."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo, hi = int(at[0]), int(at[-1])
    if lo == hi:
        return None
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    at = at - lo
    inside = word_bytes[data]
    joined = inside.copy()  # whether the word goes on from the byte before
    joined[1:] &= inside[:-1]
    joined[at[:-1][at[:-1] < len(data)]] = False
    joined[0] = False
    starts = np.flatnonzero(inside & ~joined)
    goes_on = np.empty_like(joined)
    goes_on[:-1] = joined[1:]
    goes_on[-1] = False
    ends = np.flatnonzero(inside & ~goes_on) + 1
    up, down = _grown(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:])
    return total, down, starts, ends, at


def _hashed(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased), and where each text's words start (n + 1)."""
    cut = _cut(texts, word_bytes)
    if cut is None:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    total, down, starts, ends, at = cut
    return _hashed(total, down, starts, ends), np.searchsorted(starts, at)


def words_and_tails(texts: pa.Array, word_bytes: np.ndarray, tail: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words(), with the hashes of the words' last `tail` bytes in the middle."""
    cut = _cut(texts, word_bytes)
    if cut is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    total, down, starts, ends, at = cut
    return _hashed(total, down, starts, ends), _hashed(total, down, np.maximum(starts, ends - tail), ends), np.searchsorted(starts, at)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, by the first word's place, across texts; the last k - 1 are missing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about `most` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
