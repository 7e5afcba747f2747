"""A compressed FM-index over a sequence of symbols.

The Burrows-Wheeler transform is kept as a wavelet matrix: one packed bit
vector with rank counts per symbol bit, so a rank costs one step per bit. All
searches run in lock-step over many patterns ("lanes") with array operations.

Symbols are 1 .. sigma - 1; 0 is the separator between sequences. Every
separator sorts by its position below all symbols, so no match crosses one and
all suffixes are distinct.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class BitVector:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.zeros = n - int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[BitVector] = []
        order = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (order >> b) & 1 == 1
            self.levels.append(BitVector(bit))
            order = np.concatenate([order[~bit], order[bit]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            one = (c >> (self.bits - 1 - k)) & 1 == 1
            r = level.rank(i)
            i = np.where(one, level.zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c among the first i symbols."""
        return self._descend(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its rank before i)."""
        c = np.zeros(len(i), dtype=np.int64)
        for k, level in enumerate(self.levels):
            r = level.rank(i)
            one = level.rank(i + 1) > r
            c = (c << 1) | one
            i = np.where(one, level.zeros + r, i - r)
        return c, i - self.begin[c]


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by prefix doubling, and the ranks of prefixes of 1, 2, 4, ... symbols."""
    n = len(symbols)
    separators = symbols == 0
    rank = symbols.astype(np.int64) + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    levels, h = [rank], 1
    while True:
        key = rank * np.int64(n + int(rank.max(initial=0)) + 2)
        key[: n - h] += rank[h:] + 1
        sa = np.argsort(key)
        ordered = key[sa]
        new = np.ones(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        nxt = np.empty(n, dtype=np.int64)
        nxt[sa] = np.cumsum(new) - 1
        rank = nxt
        h *= 2
        if new.all() or h >= n:
            return sa, levels
        levels.append(rank)


class FMIndex:
    """The index of one shard.

    sample: every so many text positions keep their suffix position for ``locate``.
    cap: prepare matching statistics up to this length.
    values: a value of every text position; ``least`` then has the least value
    of each class of rows that agree in ``cap`` symbols.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16, cap: int = 0, values: np.ndarray | None = None):
        self.n, self.sigma, self.step = len(symbols), sigma, sample
        sa, ranks = suffix_order(symbols)
        bwt = symbols[sa - 1]  # the symbol before position 0 is the last one, a separator
        self.bwt = WaveletMatrix(bwt, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        marked = (sa % sample == 0) | (bwt == 0)
        self.marked, self.samples = BitVector(marked), sa[marked]
        if cap:
            self._cap(sa, ranks, cap)
        if values is not None:
            self.least = np.minimum.reduceat(values[sa], self.class_start[:-1])

    def _cap(self, sa: np.ndarray, ranks: list[np.ndarray], cap: int) -> None:
        """Longest common prefixes of neighbours in suffix order, up to ``cap``, for matching statistics."""
        n, a, b = self.n, sa[:-1].copy(), sa[1:].copy()
        lcp = np.zeros(n - 1, dtype=np.int64)
        for k in range(min(len(ranks), int(cap).bit_length()) - 1, -1, -1):
            for _ in range(2 if k == len(ranks) - 1 or 2 << k > cap else 1):
                fits = (a < n) & (b < n)
                same = np.zeros(n - 1, dtype=bool)
                same[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
                step = same.astype(np.int64) << k
                lcp += step
                a += step
                b += step
        self.cap = cap
        self.lcp = np.zeros(n + 1, dtype=np.int64)  # of rows i - 1 and i
        self.lcp[1:n] = np.minimum(lcp, cap)
        self.class_of = np.cumsum(self.lcp[:n] < cap) - 1  # rows that agree in cap symbols
        self.class_start = np.append(np.flatnonzero(self.lcp[:n] < cap), n)
        self.range_least = [self.lcp]
        while (1 << len(self.range_least)) <= n + 1:
            x, h = self.range_least[-1], 1 << (len(self.range_least) - 1)
            self.range_least.append(np.minimum(x[:-h], x[h:]))

    def backward(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of cP, given the rows [lo, hi) of P."""
        return self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern; patterns are right-aligned rows of one matrix."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        for t in range(width):
            live = np.flatnonzero((t < lens) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - 1 - t]
            known = c > 0
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live], hi[live] = self.backward(c, lo[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        at, steps, todo = rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            r = self.marked.rank(at)
            hit = self.marked.rank(at + 1) > r
            out[todo[hit]] = self.samples[r[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c, before = self.bwt.access(at)
                at = self.before[c] + before
            steps += 1
        return out

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest enclosing rows of a shorter match, and its length."""
        length = np.maximum(self.lcp[lo], self.lcp[hi])
        left, right = lo.copy(), hi.copy()
        for k in range(len(self.range_least) - 1, -1, -1):
            h, x = 1 << k, self.range_least[k]
            # rows left - h + 1 .. left all agree with their neighbours above
            ok = left - h >= 0
            ok[ok] = x[left[ok] - h + 1] >= length[ok]
            left[ok] -= h
            ok = right + h <= self.n
            ok[ok] = x[right[ok]] >= length[ok]
            right[ok] += h
        return left, right, length

    def matching_statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of each range: the length (up to cap) of the longest match in the index that starts there, and a row with it.

        Ranges are read from their ends on, all in step. A symbol that cannot
        extend a match shortens it to the parent interval; a match over cap is
        cut to the rows that agree in cap symbols.
        """
        total = int((ends - starts).sum())
        base = np.cumsum(ends - starts) - (ends - starts)
        size, row = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
        m = len(starts)
        lo, hi, length = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        order = np.argsort(-(ends - starts), kind="stable")
        spans = (ends - starts)[order]
        for t in range(int(spans[0]) if m else 0):
            live = order[: int(np.searchsorted(-spans, -t, side="left"))]
            c = symbols[ends[live] - 1 - t]
            a, b, k = lo[live], hi[live], length[live]
            todo = np.arange(len(live))
            while len(todo):
                x, y = self.backward(c[todo], a[todo], b[todo])
                found = (x < y) & (c[todo] > 0)
                a[todo[found]], b[todo[found]] = x[found], y[found]
                k[todo[found]] += 1
                todo = todo[~found]
                gone = (k[todo] == 0) | (c[todo] == 0)
                k[todo[gone]], a[todo[gone]], b[todo[gone]] = 0, 0, self.n
                todo = todo[~gone]
                if len(todo):
                    a[todo], b[todo], k[todo] = self._parent(a[todo], b[todo])
            over = k >= self.cap
            cls = self.class_of[a[over]]
            a[over], b[over], k[over] = self.class_start[cls], self.class_start[cls + 1], self.cap
            lo[live], hi[live], length[live] = a, b, k
            at = base[live] + (ends[live] - starts[live]) - 1 - t
            size[at], row[at] = k, a
        return size, row
