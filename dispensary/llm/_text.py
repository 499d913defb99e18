"""Vectorised word splitting and hashing over Arrow string columns, for use inside Spark tasks.

Texts are handled as UTF-8 bytes.  A word is a maximal run of "word bytes"; because every word class
used here contains either all or none of the bytes above 0x7F, cutting bytes and cutting characters agree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 4 << 20

#: Bytes of text that are hashed at a time; a longer word is a piece of its own.
PIECE = 1 << 18

#: Bytes of the longest word whose hash is a polynomial modulo 2 ** 64; there are pairs of long words for which every such polynomial agrees.
POLYNOMIAL = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space x20, x09-x0D separates; everything else is part of a word.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False

#: After lower-casing A-Z: digits, a-z and every non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(seed: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        base = pow(_BASE[seed], -1, 1 << 64) if inverse else _BASE[seed]
        have = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE + 1:
            _powers[seed, inverse] = have
    return have[:n]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES):
    """Runs of documents (first, past last) of up to `size` bytes, at least one document each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of several documents: byte ranges, and per document the range of word numbers."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, piece by piece: what is held besides follows the piece, not the text.

        It is a polynomial for short words and half of a BLAKE2b digest for others; seeds 0 and 1 are 128 bits together."""
        out, first = np.zeros(len(self.starts), np.uint64), 0
        while first < len(out):
            base = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, base + PIECE, side="right")))
            data, starts, ends = self.data[base : self.ends[last - 1]], self.starts[first:last] - base, self.ends[first:last] - base
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[seed][data] * _power(seed, False, len(data)), out=total[1:])
            out[first:last] = mix((total[ends] - total[starts]) * _power(seed, True, len(data) + 1)[starts])
            first = last
        for i in np.flatnonzero(self.ends - self.starts > POLYNOMIAL).tolist():
            digest = hashlib.blake2b(self.word(i), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * seed : 8 * seed + 8], "little")
        return out

    def left(self) -> np.ndarray:
        """For each word, how many words of its document begin at it or later."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.starts))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def equal_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Which of the words i of a are the words j of b, byte by byte."""
    length = a.ends[i] - a.starts[i]
    out = length == b.ends[j] - b.starts[j]
    at = np.flatnonzero(out)
    length = length[at]
    owner = np.repeat(np.arange(len(at)), length)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    differs = a.data[a.starts[i[at]][owner] + inside] != b.data[b.starts[j[at]][owner] + inside]
    out[at[owner[differs]]] = False
    return out


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Split documents into words of the byte class `kind`, lower-casing A-Z first if asked."""
    if lower:
        data = LOWER[data]
    inside = kind[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` words (the last width - 1 entries are not runs)."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n < width:
        return out
    base, m = np.uint64(0xD6E8FEB86659FD93), n - width + 1
    acc = hashes[:m].copy()
    for j in range(1, width):
        acc *= base
        acc += hashes[j : m + j]
    out[:m] = mix(acc)
    return out
