"""A compressed FM-index: the Burrows-Wheeler transform of a sequence of integers in a wavelet matrix of packed bits, and one
in ``STEP`` entries of its suffix array. The suffix array itself is gone once the index is built.

Backward search takes many patterns at once, each round one symbol further to the left; rows are located by walking to the
left, all at once, until each meets a kept entry.
"""

from __future__ import annotations

import numpy as np

#: Every place that is a multiple of this keeps its entry of the suffix array.
STEP = 8


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), dtype="<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64))).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, sequence: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.bits: list[Bits] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
        order, at = np.unique(sequence, return_index=True)
        self.begin = np.zeros(int(largest) + 1, dtype=np.int32)
        self.begin[order] = at  # where each symbol's run starts in the last order

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each stands before its place."""
        symbol = np.zeros_like(at)
        for bits in self.bits:
            one = bits.get(at)
            ones = bits.ones(at)
            symbol = symbol << 1 | one
            at = np.where(one, bits.zeros + ones, at - ones)
        return symbol, at - self.begin[symbol]

    def rank(self, symbol: np.ndarray, at: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands among the first `at`, and the first `upto`, of the sequence."""
        both = np.concatenate((at, upto))
        symbols = np.concatenate((symbol, symbol))
        for k, bits in enumerate(self.bits):
            one = (symbols >> (self.levels - 1 - k) & 1).astype(bool)
            ones = bits.ones(both)
            both = np.where(one, bits.zeros + ones, both - ones)
        both -= self.begin[symbols]
        return both[: len(at)], both[len(at) :]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix ends at the end of the sequence."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        code = rank << 32
        code[: n - width] |= rank[width:]
        order = np.argsort(code)
        code = code[order]
        fresh = np.concatenate(([True], code[1:] != code[:-1]))
        rank[order] = np.cumsum(fresh)
        if fresh.all() or width >= n:
            return order
        width *= 2


class FmIndex:
    """Of a sequence of symbols from 0 on. Rows are numbered as in the suffix array."""

    def __init__(self, sequence: np.ndarray, step: int = STEP):
        order = suffix_array(sequence)
        largest = int(sequence.max()) + 1
        # 0 is the end mark, before all other symbols; its suffix comes first
        shifted = sequence.astype(np.int64) + 1
        last = np.concatenate((shifted[-1:], np.where(order > 0, shifted[order - 1], 0)))
        self.matrix = WaveletMatrix(last, largest)
        self.below = np.concatenate(([0, 1], 1 + np.cumsum(np.bincount(sequence, minlength=largest))))
        self.size = len(sequence)
        kept = order % step == 0
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start."""
        out = np.zeros(len(rows), dtype=np.int64)
        live, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            here = self.kept.get(at)
            out[live[here]] = self.places[self.kept.ones(at[here])] + walked
            live, at = live[~here], at[~here]
            symbol, before = self.matrix.access(at + 1)  # the row of the end mark's suffix comes first
            at, walked = self.below[symbol] + before - 1, walked + 1
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of suffixes that start with a pattern, to those that start with symbol and the pattern."""
        shifted = symbol + 1
        a, b = self.matrix.rank(shifted, low, high)
        base = self.below[shifted]
        return base + a, base + b

    def rows(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.below[symbol + 1], self.below[symbol + 2]

    def matching(self, patterns: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed patterns, up to given lengths: for each place in ends, how many symbols before it occur in a row
        at least twice in the index, and the rows of those that reach the length asked for."""
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.flatnonzero(lengths > 0)
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), self.size + 1, dtype=np.int64)
        step = 0
        while len(live):
            symbol = patterns[ends[live] - 1 - step]
            a, b = self.rows(symbol) if step == 0 else self.extend(symbol, low[live], high[live])
            more = b - a > 1
            live = live[more]
            low[live], high[live] = a[more], b[more]
            step += 1
            length[live] = step
            live = live[lengths[live] > step]
        reached = length == lengths
        return length, np.where(reached, low - 1, 0), np.where(reached, high - 1, 0)
