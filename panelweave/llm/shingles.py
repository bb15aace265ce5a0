"""Word hashes and shingle sets in numpy, for Python workers."""

from __future__ import annotations

import numpy as np

from panelweave.llm.common import TOKEN_BYTES, worker_state

SEGMENT = 1 << 16  # also the length of the power tables, whatever the text
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8, so powers of it differ in all but few low bits


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and powers of the base and of its inverse."""
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inverse = pow(_BASE, -1, 1 << 64)
    powers = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(SEGMENT, b, np.uint64)))) for b in (_BASE, inverse)]
    return letters, *powers


def _hash_segment(bytes_: np.ndarray) -> np.ndarray:
    letters, up, down = worker_state("word hash tables", SEGMENT, _tables)
    inside = np.zeros(len(bytes_) + 2, np.int8)
    inside[1:-1] = bytes_ != 32
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(bytes_) + 1, np.uint64)
    np.cumsum(letters[bytes_] * up[: len(bytes_)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _hash_long_word(bytes_: np.ndarray) -> np.ndarray:
    """One hash from those of its pieces of SEGMENT bytes, in order."""
    out = np.zeros(1, np.uint64)
    for start in range(0, len(bytes_), SEGMENT):
        out = mixed(out * np.uint64(_BASE) + _hash_segment(bytes_[start : start + SEGMENT]))
    return out


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the blank-delimited words with A-Z lowered, in order.

    A word's hash is a polynomial in its bytes; prefix sums give those of all
    words at once.  Texts go segment by segment, cut at blanks, and words that
    are longer than a segment piece by piece from their first byte, so that
    equal words have equal hashes wherever they stand.
    """
    plain = text.translate(TOKEN_BYTES) if text else b""
    all_bytes = np.frombuffer(plain, np.uint8)
    parts, start = [np.empty(0, np.uint64)], 0
    while start < len(plain):
        ahead = plain[start : start + SEGMENT]
        blanks = len(ahead) - len(ahead.lstrip(b" "))
        if blanks:  # a segment begins at a word
            start += blanks
            continue
        stop = min(start + SEGMENT, len(plain))
        if stop < len(plain) and plain[stop] != 32:
            stop = plain.rfind(b" ", start, stop)
        if stop < 0:
            stop = plain.find(b" ", start + SEGMENT)
            stop = len(plain) if stop < 0 else stop
            parts.append(_hash_long_word(all_bytes[start:stop]))
        else:
            parts.append(_hash_segment(all_bytes[start:stop]))
        start = stop
    return np.concatenate(parts)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the words from each position on; fewer words than ``width`` are one shingle."""
    n = len(words)
    if n == 0:
        return words
    width_here = min(width, n)
    out = np.full(n - width_here + 1, np.uint64(width_here), np.uint64)
    for j in range(width_here):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : n - width_here + 1 + j]
        out ^= out >> np.uint64(32)
    return mixed(out)
