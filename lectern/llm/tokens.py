"""Vectorised words and 64-bit word and shingle hashes of Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered on request. A word's hash is a
polynomial over the ring of 64-bit integers with random byte values, followed by a mixing step, so the hash of two
different words is equal with a chance of about 2**-64; a shingle's hash combines its words' hashes in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _VALUE[_LOWER]

#: Bytes that are hashed at once; longer texts go through in blocks cut at white space.
BLOCK = 1 << 20
#: Hashes that are mixed at once: few enough to stay in a core's cache.
MIXED = 1 << 14
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    out = np.empty(len(x), np.uint64)
    shifted = np.empty(min(MIXED, len(x)), np.uint64)
    for i in range(0, len(x), MIXED):
        of, to = x[i : i + MIXED], out[i : i + MIXED]
        by = shifted[: len(to)]
        np.bitwise_xor(of, np.right_shift(of, np.uint64(30), out=by), out=to)
        np.multiply(to, np.uint64(0xBF58476D1CE4E5B9), out=to)
        np.bitwise_xor(to, np.right_shift(to, np.uint64(27), out=by), out=to)
        np.multiply(to, np.uint64(0x94D049BB133111EB), out=to)
        np.bitwise_xor(to, np.right_shift(to, np.uint64(31), out=by), out=to)
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = (data - np.uint8(0x09) > 0x0D - 0x09) & (data != 0x20)  # bytes below 0x09 turn into great ones
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    both = cuts[word[cuts - 1] & word[cuts]]  # one row ends with a word, the next begins with one
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    return at[0::2], at[1::2]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of each word."""
    value, out, i = _LOWER_VALUE if lower else _VALUE, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        b = ends[j - 1]
        up, down = _power("up", _BASE, b - a + 1), _power("down", _BASE_INVERSE, b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value[data[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word's index of each row (one more than rows)."""
    data, offsets = raw(column)
    starts, ends = spans(data, offsets)
    return hash_words(data, starts, ends, lower), np.searchsorted(starts, offsets)


def shingles(words_: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; of fewer words, the whole run as one; of none, none."""
    n = len(words_)
    if n == 0:
        return words_
    if n < size:
        return mix(np.array([(words_ * _SHINGLE[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
    total = words_[: n - size + 1] * _SHINGLE[0]
    for k in range(1, size):
        total = total + words_[k : n - size + 1 + k] * _SHINGLE[k]
    return mix(total)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text each; a row stays whole."""
    text = batch.column(column)
    _, offsets = raw(text)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
