"""A compressed FM-index over sequences of small integers, in numpy, answering many searches at once.

The text is a run of symbols >= 1 cut by the separator 0; every separator sorts as a symbol of its own,
so suffixes are compared within their sequence. The index holds the Burrows-Wheeler transform as a
wavelet matrix (a levelwise wavelet tree: one bit vector with rank counts for each bit of a symbol) and
every `STEP`-th suffix position; others are found by walking back.
"""

from __future__ import annotations

import numpy as np

STEP = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling in which only suffixes that are still tied are sorted again."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = text == 0
    first = text.astype(np.int64) + int(ends.sum())
    first[ends] = np.arange(int(ends.sum()))
    wide = int(first.max()) + 2
    padded = np.concatenate([first + 1, np.zeros(2, np.int64)])
    key = padded[:n] * wide + padded[1 : n + 1] if wide < 1 << 31 else padded[:n]
    key[ends] = first[ends] * wide if wide < 1 << 31 else first[ends]
    depth = 2 if wide < 1 << 31 else 1
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # the first place of a suffix's group of ties, plus 1; 0 beyond the end

    def place(order: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give each of the sorted suffixes its group's rank; return those still tied."""
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.arange(len(order))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[order] = base + start + 1
        alone = new.copy()
        alone[:-1] &= new[1:]
        return order[~alone]

    tied = place(order, key[order], np.zeros(n, np.int64))
    while len(tied):
        old = rank[tied]
        key = old * (n + 2) + rank[np.minimum(tied + depth, n)]
        by = np.argsort(key, kind="stable")
        tied, key, old = tied[by], key[by], old[by]
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        start = np.maximum.accumulate(np.where(group, np.arange(len(tied)), 0))
        tied = place(tied, key, old - 1 - start)
        depth *= 2
    out = np.zeros(n, np.int64)
    out[rank[:n] - 1] = np.arange(n)
    return out


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32 if len(bits) < 1 << 31 else np.int64)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones lie before i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    def __init__(self, text: np.ndarray, locate: bool = True) -> None:
        self.n = len(text)
        self.sigma = int(text.max()) + 1 if self.n else 1
        self.order = suffix_array(text)
        bwt = text[self.order - 1] if self.n else text
        counts = np.bincount(text, minlength=self.sigma)
        self.less = np.concatenate([[0], np.cumsum(counts)])  # how many symbols are smaller
        self.depth = max(1, (self.sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            ones = (bwt >> level & 1).astype(bool)
            bits = Bits(ones)
            self.levels.append((bits, self.n - bits.ones))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.start = self._walk(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        if locate:
            self.marked = Bits(self.order % STEP == 0)
            self.samples = self.order[self.order % STEP == 0]

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i places of the transform."""
        return self._walk(symbol, i) - self.start[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of backward search: the suffixes that begin with `symbol` and go on as those in [low, high)."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.less[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns, one in each row; a symbol < 1 or unknown matches nothing."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        high[((patterns < 1) | (patterns >= self.sigma)).any(1)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            low[live], high[live] = self.extend(patterns[live, k], low[live], high[live])
        return low, np.maximum(low, high)

    def symbol_at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform's symbol at i, and its place one step back (LF)."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.start[symbol] + self.less[symbol]

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of suffixes that no separator begins, from the sampled ones.

        A walk stops at its sequence's first symbol too: there the preceding symbol is a separator, and
        separators are ranked by their position, which names the sequence.
        """
        out, steps = np.full(len(i), -1, np.int64), np.zeros(len(i), np.int64)
        at, todo = i.copy(), np.arange(len(i))
        while len(todo):
            hit = self.marked.get(at[todo])
            done = todo[hit]
            out[done] = self.samples[self.marked.rank(at[done])] + steps[done]
            todo = todo[~hit]
            if not len(todo):
                break
            symbol, back = self.symbol_at(at[todo])
            at[todo] = back
            steps[todo] += 1
            edge = symbol == 0
            if edge.any():
                raise ValueError("sequence starts must be sampled")
        return out


def joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences cut by separators, each starting at a multiple of STEP (so that it is sampled); their starts."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    room = (sizes // STEP + 1) * STEP
    starts = np.concatenate([[0], np.cumsum(room)])
    text = np.zeros(int(starts[-1]), np.int64)
    if len(sequences):
        text[np.arange(int(sizes.sum())) + np.repeat(starts[:-1] - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(sequences)
    return text, starts[:-1]


def prefix_groups(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order: whether each starts a new group of equal prefixes of `length` (separators differ from all)."""
    n = len(order)
    new = np.ones(n, bool)
    live = np.arange(1, n)
    for k in range(length):
        a, b = order[live] + k, order[live - 1] + k
        fine = (a < n) & (b < n)
        live = live[fine]
        x, y = text[a[fine]], text[b[fine]]
        live = live[(x == y) & (x > 0)]
        if not len(live):
            return new
    new[live] = False
    return new
