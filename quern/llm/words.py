"""Words, shingles and sets of whole texts in numpy, a batch of texts at a time.

A word is a longest run without the six ASCII spaces, A-Z lower-cased. Hashes
are of 64 bits: bytes go through a random table, a word is a polynomial in an
odd base modulo 2**64, and a mixer breaks up what structure is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = mix64(np.arange(256, dtype=_U) + _U(0x1234567))
    upper = np.arange(65, 91)
    codes[upper] = codes[upper + 32]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return codes, space


_CODES, _SPACE = _tables()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_PIECE = 1 << 18


def word_hashes(data: bytes, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and last byte (exclusive) of each word of UTF-8 bytes.

    ``space`` marks the bytes that part words.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none
    inside = ~space[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_CODES[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _powers(_INVERSE, len(raw))[begin]
    return mix64(hashes + (end - begin).astype(_U)), begin, end


class Batch:
    """Word hashes of several texts: ``words`` one after another, ``at`` their bounds."""

    def __init__(self, texts: list[str | None], space: np.ndarray = _SPACE):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data]) if data else np.zeros(0, np.int64)
        # Hashing takes some fifty bytes a byte for a while, so a run of texts at a time.
        found, first, size = [], 0, 0
        for k, d in enumerate(data):
            size += len(d) + 1
            if size >= _PIECE or k == len(data) - 1:
                words, begin, end = word_hashes(b"\n".join(data[first : k + 1]), space)
                at = int(ends[k]) - size
                found.append((words, begin + at, end + at))
                first, size = k + 1, 0
        none = np.zeros(0, np.int64)
        parts = zip(*found, strict=True) if found else ([np.zeros(0, _U)], [none], [none])
        self.words, self.begin, self.end = (np.concatenate(p) for p in parts)
        self.at = np.concatenate(([0], np.searchsorted(self.begin, ends))).astype(np.int64)
        self.offset = np.concatenate(([0], ends[:-1])).astype(np.int64) if data else none

    def shingles(self, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words, text by text, and their bounds.

        A text of fewer words gives its whole sequence as one if ``whole``.
        """
        count = np.diff(self.at)
        grams = np.where(count >= n, count - n + 1, (count > 0) if whole else 0)
        bounds = np.concatenate(([0], np.cumsum(grams))).astype(np.int64)
        # The start of each shingle among the words.
        start = np.arange(bounds[-1]) + np.repeat(self.at[:-1] - bounds[:-1], grams)
        out = np.zeros(len(start), _U)
        short = np.repeat(count < n, grams)
        long_start = start[~short]
        total = np.zeros(len(long_start), _U)
        for k in range(n):
            total = mix64((total + _U(2 * k + 1)) * _U(_BASE) ^ self.words[long_start + k])
        out[~short] = total
        if whole:
            for i in np.flatnonzero((count > 0) & (count < n)):
                words = self.words[self.at[i] : self.at[i + 1]].tobytes()
                out[bounds[i]] = int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little")
        return out, bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending, and their bounds."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def pieces(rows: Iterator[tuple[object, str | None]], chars: int = _PIECE) -> Iterator[tuple[list, list]]:
    """Lists of keys and texts of about ``chars`` characters; a longer text is alone."""
    keys, texts, size = [], [], 0
    for key, text in rows:
        keys.append(key)
        texts.append(text)
        size += len(text or "")
        if size >= chars:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
