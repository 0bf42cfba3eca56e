"""A compressed full-text index over a sequence of integers, searched for many texts at a time.

The Burrows-Wheeler transform of the text is kept in a wavelet matrix: one bit
vector per bit of the alphabet, packed into 64-bit words with a running count
per word. Backward search asks only for ranks in it. Suffixes are sorted by
their first ``depth`` symbols, which is enough for matches below that length.

Texts are sequences of symbols from 1 up; 0 ends each indexed text and never
matches. Symbols that are not in the index are given as -1 and match nothing.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(values)
        padded = (n + 64) // 64 * 64
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            full = np.zeros(padded, np.uint8)
            full[:n] = bit
            words = np.packbits(full, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
                               .astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask).astype(np.int64)

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for level in range(self.bits):
            one = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            ones = [self._ones(level, x) for x in (start, low, high)]
            start, low, high = (np.where(one, self.zeros[level] + o, x - o)
                                for o, x in zip(ones, (start, low, high)))
        return low - start, high - start


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, longest: int):
        """``text`` has a 0 after each of its parts; matches are followed up to ``longest`` symbols."""
        self.longest, self.size = longest, len(text)
        # Ranks, rows and places fit into 32 bits: a shard has far fewer symbols.
        ranks, depth = [text.astype(np.int32)], 1
        while depth <= longest:
            rank = ranks[-1]
            following = np.zeros(len(rank), np.int64)
            following[:-depth] = rank[depth:] if depth < len(rank) else 0
            joint = rank.astype(np.int64) * (int(following.max(initial=0)) + 1) + following
            del following
            order = np.argsort(joint, kind="stable")
            joint = joint[order]
            new = np.zeros(len(order), np.int32)
            np.cumsum(joint[1:] != joint[:-1], out=new[1:], dtype=np.int32)
            rank = np.empty(len(order), np.int32)
            rank[order] = new
            del joint, order, new
            ranks.append(rank)
            depth *= 2
        self.suffixes = np.argsort(ranks[-1], kind="stable").astype(np.int32)
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        # Common prefix of each suffix with the one before it, from the ranks at powers of two.
        above, here = self.suffixes[:-1], self.suffixes[1:]
        common = np.zeros(max(0, self.size - 1), np.int32)
        for power in range(len(ranks) - 1, -1, -1):
            rank = np.append(ranks.pop(), np.int32(-1))
            a, b = np.minimum(above + common, self.size), np.minimum(here + common, self.size)
            common += np.where((rank[a] == rank[b]) & (a < self.size) & (b < self.size), np.int32(1 << power), np.int32(0))
        self.common = np.concatenate(([0], np.minimum(common, longest))).astype(np.int16)
        self._classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def classes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(class of each row, start of each class and the end) where a class shares ``depth`` symbols."""
        if depth not in self._classes:
            if len(self._classes) > 8:
                self._classes.pop(next(iter(self._classes)))
            new = self.common < depth
            new[:1] = True
            self._classes[depth] = (np.cumsum(new) - 1).astype(np.int32), np.append(np.flatnonzero(new), self.size).astype(np.int32)
        return self._classes[depth]

    def _shorten(self, low: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols that rows ``low`` stand for."""
        start, end = np.zeros_like(low), np.full_like(low, self.size)
        for d in np.unique(depth[depth > 0]):
            at = np.flatnonzero(depth == d)
            of, edges = self.classes(int(d))
            start[at], end[at] = edges[of[low[at]]], edges[of[low[at]] + 1]
        return start, end

    def matching_statistics(self, texts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the length of the longest match from there (at most ``longest``) and a row that has it.

        ``texts`` holds the texts one after the other, ``starts`` where each
        begins and the last ends. All texts are read from their ends, in step.
        """
        length = np.zeros(len(texts), np.int16)
        row = np.zeros(len(texts), np.int64)
        order = np.argsort(-(starts[1:] - starts[:-1]), kind="stable")
        ends, sizes = starts[1:][order], (starts[1:] - starts[:-1])[order]
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), self.size, np.int64)
        depth = np.zeros(len(order), np.int64)
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # texts with more than ``step`` symbols
            at = ends[:live] - 1 - step
            symbol = texts[at].astype(np.int64)
            lo, hi, d = low[:live], high[:live], depth[:live]
            full = d >= self.longest
            if full.any():
                d[full] = self.longest - 1
                lo[full], hi[full] = self._shorten(lo[full], d[full])
            todo = np.flatnonzero(symbol > 0)
            unknown = symbol <= 0
            lo[unknown], hi[unknown], d[unknown] = 0, self.size, 0
            while len(todo):
                c = symbol[todo]
                before, after = self.wavelet.ranks(c, lo[todo], hi[todo])
                found = before < after
                hit = todo[found]
                lo[hit] = self.first[c[found]] + before[found]
                hi[hit] = self.first[c[found]] + after[found]
                d[hit] += 1
                todo = todo[~found]
                stuck = d[todo] == 0
                todo = todo[~stuck]
                if len(todo):
                    # The parent interval: the longest shorter prefix that more rows share.
                    below = np.where(hi[todo] < self.size, self.common[np.minimum(hi[todo], self.size - 1)], 0)
                    d[todo] = np.minimum(np.maximum(self.common[lo[todo]], below), d[todo] - 1)
                    lo[todo], hi[todo] = self._shorten(lo[todo], d[todo])
            length[at], row[at] = d, lo
        return length, row
