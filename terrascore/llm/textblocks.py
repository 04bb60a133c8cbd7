"""Vectorised tokens, hashes and n-grams over blocks of texts, for use inside Spark tasks.

A block is one ``uint8`` array that holds the UTF-8 bytes of some whole texts one after the other, with
``offsets``: text *i* is ``data[offsets[i]:offsets[i + 1]]``. Nulls are empty texts. Blocks hold about
``BLOCK_BYTES`` bytes, so the numpy arrays made of them stay small; a longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: One random 64-bit value for each byte value, so that polynomial hashes don't depend on byte order patterns.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}

#: The white space of the word definition, 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64, kept between calls."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = max(2**17, 1 << (n - 1).bit_length())  # a worker that sees small blocks alone keeps few
        out = np.full(size, _INV if inverse else _BASE, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 16 * BLOCK_BYTES:
            return out[:n]
        have = _POWERS[inverse] = out
    return have[:n]


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, data, offsets) for slices of a string column of about ``most`` bytes each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] the polynomial hash of the first i bytes; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal bytes give equal hashes at every place."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block, A-Z lower-cased: hashes, byte places, and the words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        solid = ~_SPACE[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:n]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text's place in the block for each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (runs over text ends included; the caller masks them)."""
    m = len(hashes) - n + 1
    out = hashes[: max(m, 0)].copy()
    for k in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + m])
    return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of a block, and bounds of each text's. A text of fewer words has one, all its words."""
    counts = words.counts
    total = int(words.bounds[-1])
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(bounds[-1]), np.uint64)
    full = combine(words.hash, n)
    text = words.text_of()
    same = np.flatnonzero(text[: len(full)] == text[n - 1 :][: len(full)]) if total >= n else np.empty(0, np.int64)
    is_short = (counts < n) & (counts > 0)
    where = np.ones(len(out), bool)
    where[bounds[:-1][is_short]] = False
    out[where] = full[same]
    for i in np.flatnonzero(is_short):
        run = words.hash[words.bounds[i] : words.bounds[i + 1]]
        out[bounds[i]] = mix(combine(run, len(run)) + _U(len(run)))[0]
    return out, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = np.concatenate(parts) if parts else values[:0]
    return out, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def reduce_texts(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduce over each text's values; ``empty`` for a text without any."""
    n = len(bounds) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full], axis=0)
    return out
