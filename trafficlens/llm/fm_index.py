"""FM-index over integer symbols, with numpy: suffix array, wavelet matrix, sampled suffix positions.

Searches take whole sets of phrases at once: one vectorised backward step
extends every phrase by a symbol.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes (prefix doubling; a suffix that ends is smaller)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    open_ = np.arange(n)  # places in ``order`` whose group is not yet a single suffix
    step = 1
    # ranks are the first place of a suffix's group in the order, so that groups can be refined one by one
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    while True:
        single = first & np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        pos = order[open_]
        nxt = pos + step
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        group = rank[pos]
        by = np.argsort(group * np.int64(n + 1) + key, kind="stable")
        pos, key, group = pos[by], key[by], group[by]
        order[open_] = pos
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        first[open_] = new
        rank[pos] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        step *= 2


class Bits:
    """A bit vector with constant-time rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix: rank and access of symbols below ``2**levels``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(levels - 1, -1, -1):
            bit = (symbols >> b) & 1
            zeros = bit == 0
            self.levels.append((b, Bits(bit.astype(np.uint8)), int(zeros.sum())))
            symbols = np.concatenate([symbols[zeros], symbols[~zeros]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` among the first ``i`` symbols (arrays of one shape)."""
        lo = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            a, z = bits.rank1(lo), bits.rank1(i)
            lo = np.where(one, zeros + a, lo - a)
            i = np.where(one, zeros + z, i - z)
        return i - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its occurrences before ``i``."""
        lo, symbol = np.zeros_like(i), np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = bits.get(i)
            a, z = bits.rank1(lo), bits.rank1(i)
            lo = np.where(one, zeros + a, lo - a)
            i = np.where(one, zeros + z, i - z)
            symbol |= one.astype(np.int64) << b
        return symbol, i - lo


class FMIndex:
    """Index of ``text`` (symbols 0 .. sigma-1)."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate([np.asarray(text, np.int64) + 1, [0]])  # 0 ends the text and is smallest
        n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        self.wavelet = Wavelet(last, int(sigma).bit_length())
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled.astype(np.uint8))
        self.positions = order[sampled].astype(np.int64)
        self.n = n

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: for each row of ``phrases`` (all of one length) its rows [lo, hi) of the suffix order."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64) + 1
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[c] + both[:len(live)]
            hi[live] = self.first[c] + both[len(live):]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: step to the position before until one is sampled."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.sampled.get(here)
            done = live[hit]
            out[done] = self.positions[self.sampled.rank1(at[done])] + steps[done]
            live = live[~hit]
            symbol, before = self.wavelet.access_rank(at[live])
            at[live] = self.first[symbol] + before
            steps[live] += 1
        return out
