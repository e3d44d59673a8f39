"""Words, word hashes and shingles of whole Arrow batches in numpy, a bounded number of bytes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a block of its own.
BLOCK = 2_000_000
#: Words of more bytes are hashed one by one.
FAR = 256
SPACES = b" \t\n\x0b\x0c\r"
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def separators(chars: bytes = SPACES) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Block:
    """Some consecutive texts: ``data`` (their bytes), ``offsets`` (of texts), ``starts`` and ``ends`` of words, ``first`` (each text's first word, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, seps: np.ndarray):
        self.data, self.offsets, self.row, self.rows = data, offsets, row, len(offsets) - 1
        word = ~seps[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)  # a text begins here
        edge[offsets] = True
        begins, ends = word.copy(), word.copy()
        if n > 1:
            begins[1:] &= ~word[:-1] | edge[1:n]
            ends[:-1] &= ~word[1:] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight bytes at a time, each mixed with what came before."""
        lens = self.ends - self.starts
        out = mix(lens.astype(np.uint64) * _BASE)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        k, live = 0, np.arange(len(out))
        while len(live) and k < FAR:
            left = lens[live] - k
            part = eights[self.starts[live] + k] & _MASK[np.minimum(left, 8)]
            out[live] = mix(out[live] ^ (part * _Q))
            live, k = live[left > 8], k + 8
        for i in live:  # words of more than FAR bytes
            out[i] = np.frombuffer(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
        return out

    def words(self, i: int) -> tuple[int, int]:
        """Text i's words as a range of word numbers."""
        return int(self.first[i]), int(self.first[i + 1])


def blocks(texts: pa.Array, seps: np.ndarray, fold: np.ndarray | None = None) -> Iterator[Block]:
    """The texts of an Arrow string array in blocks; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1))
        part = data[offsets[at] : offsets[end]]
        yield Block(fold[part] if fold is not None else part, offsets[at : end + 1] - offsets[at], at, seps)
        at = end


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n numbers; runs over the ends of texts are included."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    q, m = powers(n, _Q), len(h) - n + 1
    out = h[:m] * q[0]
    for j in range(1, n):
        out += h[j : j + m] * q[j]
    return mix(out)


def shingle_sets(block: Block, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``size`` words as sorted hashes; fewer words give their whole sequence as one."""
    h = block.hashes()
    g = grams(h, size)
    for i in range(block.rows):
        a, b = block.words(i)
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield grams(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)
