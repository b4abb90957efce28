"""A compressed full-text index over word ids, and matching statistics through it."""

from __future__ import annotations

import numpy as np

DEPTH_STEPS = (1, 2, 4, 8, 16, 32)
#: Suffixes are ordered by their first 64 words; matches are followed up to one less at most.
SORTED_DEPTH = 64


class Bits:
    """A bit vector packed into words, with counts of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])
        self.total = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of symbols in a sequence of ``n`` ids below ``sigma``, one bit vector per id bit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[int, int, Bits]] = []  # (bit, zeros, ones' vector)
        values = values.copy()
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            vector = Bits(ones.astype(np.uint8))
            self.levels.append((bit, len(values) - vector.total, vector))
            values = np.concatenate([values[ones == 0], values[ones == 1]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, zeros, vector in self.levels:
            ones = vector.rank(at)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position."""
        return self._down(symbols, at) - self.base[symbols]


def _nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one in direction ``step`` with a smaller value.

    Both ends must hold values below all others; theirs is the end itself.
    """
    n = len(values)
    at = np.clip(np.arange(n) + step, 0, n - 1)
    open_ = np.flatnonzero((values[at] >= values) & (values > values[0 if step < 0 else -1]))
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[values[at[open_]] >= values[open_]]
    return at


class FMIndex:
    """Backward search over texts of word ids (1 and up), each closed by a 0.

    Kept are the wavelet matrix of the Burrows-Wheeler transform, symbol counts, and the
    common-prefix lengths of neighbouring suffixes up to ``depth`` with their nearest smaller
    values, through which a match loses words at its end.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        if not 0 < depth < SORTED_DEPTH:
            raise ValueError(f"depth must lie between 1 and {SORTED_DEPTH - 1}")
        n = self.n = len(ids)
        self.depth, self.sigma = depth, int(ids.max()) + 1 if n else 1
        rank = np.zeros(n + SORTED_DEPTH, dtype=np.int64)
        rank[:n] = ids + 1
        ranks = []
        order = np.argsort(rank[:n], kind="stable")
        for k in DEPTH_STEPS:
            ranks.append(rank.astype(np.int32))
            pair = rank[:n] * (n + self.sigma + 2) + rank[k : n + k]
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            dense = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) + 1 if n else np.zeros(0, dtype=np.int64)
            rank = np.zeros(n + SORTED_DEPTH, dtype=np.int64)
            rank[order] = dense
        self.order = order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.sigma))])[:-1].astype(np.int64)
        self.bwt = WaveletMatrix(ids[order - 1].astype(np.int64), self.sigma)
        common = np.zeros(max(0, n - 1), dtype=np.int64)
        a, b = order[:-1], order[1:]
        for k, level in zip(reversed(DEPTH_STEPS), reversed(ranks), strict=True):
            common += np.where(level[a + common] == level[b + common], k, 0)
        self.lcp = np.concatenate([[-1], np.minimum(common, depth), [-1]])
        self.smaller_before = _nearest_smaller(self.lcp, -1)
        self.smaller_after = _nearest_smaller(self.lcp, 1)

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The enclosing intervals of suffixes with a shorter common prefix, and its length."""
        left, right = self.lcp[lo], self.lcp[hi]
        length = np.maximum(left, right)
        up_lo = np.where(left == length, self.smaller_before[lo], lo)
        up_hi = np.where(right == length, self.smaller_after[hi], hi)
        whole = length < 0
        return np.where(whole, 0, up_lo), np.where(whole, self.n, up_hi), np.maximum(length, 0)

    def matching_statistics(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every word of the given runs of ``ids``: how many words from it on, up to
        ``depth``, occur in the index, and the first row of the suffixes that begin so.

        Runs are read backwards, all side by side. A word is put before the match; where no
        suffix fits, the match loses words at its end, interval by enclosing interval. An id
        of -1 stands for a word that the index does not have.
        """
        known = np.zeros(len(ids), dtype=np.int64)
        rows = np.zeros(len(ids), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        lo, hi, size = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            at = starts[:live] + lengths[:live] - 1 - step
            word = ids[at]
            lo_, hi_, size_ = lo[:live], hi[:live], size[:live]
            full = np.flatnonzero((size_ == self.depth) & (np.maximum(self.lcp[lo_], self.lcp[hi_]) == self.depth - 1))
            if len(full):
                lo_[full], hi_[full], _ = self._parent(lo_[full], hi_[full])
            size_[size_ == self.depth] = self.depth - 1
            absent = (word < 0) | (word >= self.sigma)
            lo_[absent], hi_[absent], size_[absent] = 0, self.n, 0
            todo = np.flatnonzero(~absent)
            while len(todo):
                symbol = word[todo]
                both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo_[todo], hi_[todo]]))
                base = self.first[symbol]
                new_lo, new_hi = base + both[: len(todo)], base + both[len(todo) :]
                hit = new_hi > new_lo
                done = todo[hit]
                lo_[done], hi_[done] = new_lo[hit], new_hi[hit]
                size_[done] += 1
                todo = todo[~hit]
                rest = todo[size_[todo] > 0]  # a word that follows nothing does not occur at all
                todo = rest
                if len(rest):
                    lo_[rest], hi_[rest], size_[rest] = self._parent(lo_[rest], hi_[rest])
            known[at], rows[at] = size_, lo_
        return known, rows
