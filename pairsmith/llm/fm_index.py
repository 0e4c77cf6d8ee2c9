"""A numpy FM-index over a sequence of word symbols.

Symbol 0 separates runs; it takes part in no pattern, and separators order by
their place, so a suffix is compared up to the end of its run only.  All
queries work on arrays: many patterns, or many rows, at once.
"""

from __future__ import annotations

import numpy as np

#: Text positions whose place is kept: every one divisible by this, and run starts.
SAMPLE = 8


class BitRank:
    """A bit vector with the count of ones before any position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, pos: np.ndarray) -> np.ndarray:
        w = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, pos: np.ndarray) -> np.ndarray:
        return (self.words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over integers below 2**levels, one bit vector a level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol`` before each of the positions."""
        at = [np.zeros_like(positions[0]), *positions]
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            for k, p in enumerate(at):
                r = self.bits[i].ones(p)
                at[k] = np.where(one, self.zeros[i] + r, p - r)
        return [p - at[0] for p in at[1:]]

    def access(self, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), np.int64)
        for i in range(self.levels):
            one = self.bits[i].get(pos).astype(bool)
            r = self.bits[i].ones(pos)
            pos = np.where(one, self.zeros[i] + r, pos - r)
            out = out * 2 + one
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; equal run ends order by place."""
    n = len(seq)
    sep = np.flatnonzero(seq == 0)
    left = np.append(sep, n)[np.searchsorted(sep, np.arange(n))] - np.arange(n)  # symbols up to the separator
    longest = int(left.max(initial=0))
    width = max(1, int(seq.max(initial=0)).bit_length())
    depth = max(1, min(62 // width, longest))
    key = np.zeros(n, np.int64)
    for d in range(depth):  # the first `depth` symbols in one word, blanks after the separator
        moved = np.zeros(n, np.int64)
        moved[:n - d] = seq[d:]
        key = (key << width) | np.where(left > d, moved, 0)
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        step = np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if depth >= longest or int(step.sum()) == n:
            return order
        after = np.zeros(n, np.int64)
        after[:max(0, n - depth)] = rank[depth:]
        key = rank * (n + 2) + np.where(left > depth, after, 0)
        depth *= 2


class FMIndex:
    """Count and locate patterns of symbols >= 1 in ``seq`` (int array whose
    last symbol is 0)."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        order = suffix_order(seq)
        levels = max(1, int(seq.max(initial=0)).bit_length())
        bwt = seq[order - 1]  # the first suffix takes the last symbol, a separator
        self.n = n
        self.wavelet = WaveletMatrix(bwt, levels)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=1 << levels))))
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = BitRank(kept.astype(np.uint8))
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each right-aligned pattern, by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        known = (patterns < len(self.first) - 1).all(axis=1)
        hi[~known] = 0
        for back in range(1, width + 1):
            live = np.flatnonzero((hi > lo) & (lengths >= back))
            if not len(live):
                break
            c = patterns[live, width - back]
            before = self.wavelet.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + before[0], self.first[c] + before[1]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: step back to a kept one."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            kept = self.sampled.get(rows).astype(bool)
            out[todo[kept]] = self.places[self.sampled.ones(rows[kept])] + steps
            todo, rows = todo[~kept], rows[~kept]
            if len(todo):
                c = self.wavelet.access(rows)
                rows = self.first[c] + self.wavelet.rank(c, rows)[0]
            steps += 1
        return out
