"""A compressed FM-index over sequences of words: wavelet matrix of packed bits, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


#: Bits that a level of the wavelet matrix tells apart.
DIGIT = 4
RADIX = 1 << DIGIT
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Digits:
    """Digits of ``RADIX`` values as a packed bit vector for each value, and where its next one goes, every 64 bits, when all are sorted by value."""

    def __init__(self, digits: np.ndarray):
        self.stride = len(digits) // 64 + 1
        marks = np.zeros((RADIX, self.stride * 64), dtype=bool)
        marks[digits, np.arange(len(digits))] = True
        self.words = np.packbits(marks, axis=1, bitorder="little").view(np.uint64).ravel()
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def follow(self, digit: np.ndarray, i: np.ndarray) -> np.ndarray:
        """All lesser digits and those of this value among the first i."""
        at = (i >> 6) + digit * self.stride
        return self.before[at] + np.bitwise_count(self.words[at] & _LOW[i & 63])


class FMIndex:
    """Over sequences of symbols from 1; each is followed by a 0. Answers patterns of up to ``depth`` symbols.

    Each place of the text has a ``rank``; of every group of places that share ``depth`` symbols the index keeps the
    least. The text itself and its suffix array are not kept. ``least_by_place`` (for each place, the least rank of its
    group) can be deleted once the text's own places need no more answers.
    """

    def __init__(self, text: np.ndarray, depth: int, rank: np.ndarray):
        self.depth, self.size = depth, len(text)
        sa = self._sorted(text, depth)
        bwt = text[sa - 1]
        top = int(text.max(initial=0))
        self.shifts = range((max(1, top.bit_length()) - 1) // DIGIT * DIGIT, -1, -DIGIT)
        self.levels: list[Digits] = []
        now = bwt.astype(np.int64)
        for shift in self.shifts:
            digits = (now >> shift & RADIX - 1).astype(np.uint8)
            self.levels.append(Digits(digits))
            now = now[np.argsort(digits, kind="stable")]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        symbols = np.arange(top + 1)
        self.base = self._descend(symbols, np.zeros(top + 1, dtype=np.int64))
        self.lcp = self._lcp(text, sa)
        self._heads: dict[int, np.ndarray] = {}
        heads = self.heads(depth)
        self.least = np.minimum.reduceat(rank[sa], heads)
        self.least_by_place = np.empty(len(text), dtype=rank.dtype)
        self.least_by_place[sa] = np.repeat(self.least, np.diff(np.append(heads, len(sa))))

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> np.ndarray:
        """Places in the order of their next ``depth`` symbols, by prefixes of doubling length."""
        n = len(text)
        order, h = text.astype(np.int64), 1
        while h < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - h, 0)] = order[h:] + 1
            _, order = np.unique(order * (n + 2 + int(order.max(initial=0))) + after, return_inverse=True)
            h *= 2
        return np.argsort(order, kind="stable")

    def _lcp(self, text: np.ndarray, sa: np.ndarray) -> np.ndarray:
        """Of each sorted place with the one before it, up to ``depth``."""
        n = len(sa)
        padded = np.concatenate([text, np.full(self.depth, -1, dtype=text.dtype)])
        out = np.zeros(n, dtype=np.uint8)
        same = np.ones(max(n - 1, 0), dtype=bool)
        for k in range(self.depth):
            same &= padded[sa[1:] + k] == padded[sa[:-1] + k]
            if not same.any():
                break
            out[1:] += same
        return out

    def heads(self, length: int) -> np.ndarray:
        """Where groups of places that share their first ``length`` symbols begin."""
        if length not in self._heads:
            self._heads[length] = np.flatnonzero(self.lcp < length).astype(np.int32)
        return self._heads[length]

    def least_rank(self, rows: np.ndarray) -> np.ndarray:
        """The least rank among the places that share ``depth`` symbols with these rows of the index."""
        return self.least[np.searchsorted(self.heads(self.depth), rows, "right") - 1]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes when the wavelet matrix is followed down by the symbol's digits."""
        for level, shift in zip(self.levels, self.shifts, strict=True):
            i = level.follow(symbol >> shift & RADIX - 1, i)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + pattern."""
        known = symbol < len(self.base)
        s = np.where(known, symbol, 0)
        shift = self.counts[s] - self.base[s]
        both = self._descend(np.concatenate([s, s]), np.concatenate([lo, hi]))
        lo, hi = both[: len(s)] + shift, both[len(s) :] + shift
        return lo, np.where(known, hi, lo)

    def matching_statistics(self, flat: np.ndarray, sizes: np.ndarray, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the queries (one after another in ``flat``, with their ``sizes``): the length, up to ``most``, of its longest match in the index, and the first row of that match's interval.

        Queries go side by side from right to left. A match at ``most`` is widened to its first ``most`` - 1 symbols
        before the next symbol is put in front; a match that cannot be extended loses its last symbols until its
        interval is a wider one, and so on until it can. As ends of matches only move left, a query whose match ends
        before its first ``least`` symbols do has no more matches of that length: it is given up, with lengths of 0.
        """
        ends = np.cumsum(sizes)
        found, rows = np.zeros(len(flat), dtype=np.int16), np.zeros(len(flat), dtype=np.int64)
        n = self.size
        lo, hi, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), n, np.int64), np.zeros(len(sizes), np.int64)
        edges = np.append(self.lcp, 0).astype(np.int64)
        live = np.arange(len(sizes))
        for step in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > step]
            if not len(live):
                break
            full = live[size[live] == most]
            self._shrink(full, np.full(len(full), most - 1), lo, hi, size)
            left = live
            while len(left):
                symbol = flat[ends[left] - 1 - step]
                a, b = self.extend(symbol, lo[left], hi[left])
                ok = b > a
                lo[left[ok]], hi[left[ok]] = a[ok], b[ok]
                size[left[ok]] += 1
                left = left[~ok]
                left = left[size[left] > 0]
                self._shrink(left, np.minimum(np.maximum(edges[lo[left]], edges[hi[left]]), size[left] - 1), lo, hi, size)
                left = left[size[left] + sizes[left] - step >= least]
            live = live[size[live] + sizes[live] - step > least]
            at = ends[live] - 1 - step
            found[at], rows[at] = size[live], lo[live]
        return found, rows

    def _shrink(self, lanes: np.ndarray, to: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> None:
        """Cut the lanes' matches to their first ``to`` symbols."""
        size[lanes] = to
        for length in np.flatnonzero(np.bincount(to)):
            own = lanes[to == length]
            if length == 0:
                lo[own], hi[own] = 0, self.size
            else:
                heads = self.heads(int(length))
                at = np.searchsorted(heads, lo[own], "right")
                lo[own] = heads[at - 1]
                hi[own] = np.where(at < len(heads), heads[np.minimum(at, len(heads) - 1)], self.size)
