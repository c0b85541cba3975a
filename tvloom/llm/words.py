"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of digits, ASCII letters (lower-cased) and characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text worked on at once; a longer text is still taken whole.
CHUNK_BYTES = 250_000

U = np.uint64
_BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("A") : ord("Z") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            powers = np.full(size, base, U)
            powers[0] = 1
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * STEP
    return x ^ (x >> U(29))


class Words:
    """The words of several texts: bytes, hashes, and the range of word positions of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = _LOWER[data]
        n = len(data)
        word = np.zeros(n + 1, bool)
        word[:n] = _IS_WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:]
        ends[:-1] &= ~word[1:] | edge[1:]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum((self.low.astype(U) + U(1)) * up[:n], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.begin]) * down[self.begin])
        self.first = np.searchsorted(self.begin, offsets)
        self.bytes = self.low.tobytes()

    def left(self) -> np.ndarray:
        """For each word, the words from it to the end of its text."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.begin))

    def window(self, at: int, size: int) -> bytes:
        """The words at..at+size-1, joined by spaces."""
        return b" ".join([self.bytes[self.begin[i] : self.end[i]] for i in range(at, at + size)])


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of neighbouring texts of CHUNK_BYTES together, or one longer text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
