"""FM-index over word sequences: wavelet matrix, backward search, matching statistics up to a depth.

The index serves matches of at most ``depth`` words, so suffixes are only sorted by that
many words.  Queries advance in lanes: all of them take one step to the left at a time,
so that a step is a few numpy calls whatever the number of lanes.

What is kept is compressed: bit planes with a count for every 64 bits, one bit a suffix for
where runs of equal suffixes begin, and the owners of runs as numbers of the narrowest type.
"""

from __future__ import annotations

import numpy as np

from .textops import U64


def _rank(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1] if len(first) else first


def prefix_ranks(symbols: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first ``depth - 1`` and ``depth`` symbols (zeros behind the end)."""
    n, have, size = len(symbols), symbols.astype(np.int64), 1

    def moved(r: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if by < n:
            out[: n - by] = r[by:] + 1
        return out

    while size * 2 < depth:
        have = _rank(have, moved(have, size))
        size *= 2
    out = {}
    for d in (depth - 1, depth):
        out[d] = _rank(have, moved(have, d - size)) if d > size else have
    return out


class Bits:
    """Packed bits with a running count for every word of 64: rank and select."""

    def __init__(self, ones: np.ndarray):
        padded = np.zeros((len(ones) // 64 + 1) * 64, np.uint8)
        padded[: len(ones)] = ones
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the bit that has k set bits before it, by halving its word."""
        word = np.searchsorted(self.before, k, "right") - 1
        rest, x, at = k - self.before[word], self.words[word], word.astype(np.int64) << 6
        for width in (32, 16, 8, 4, 2, 1):
            low = x & U64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            go = rest >= count
            rest, at, x = np.where(go, rest - count, rest), np.where(go, at + width, at), np.where(go, x >> U64(width), low)
        return at


class Runs:
    """Runs of equal neighbours in a sorted array, one bit each."""

    def __init__(self, values: np.ndarray):
        new = np.ones(len(values) + 1, bool)  # a bit behind the end closes the last run
        new[1:-1] = values[1:] != values[:-1]
        self.bits = Bits(new)

    def number(self, at: np.ndarray) -> np.ndarray:
        return self.bits.rank(at + 1) - 1

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the run at each place."""
        k = self.number(at)
        return self.bits.select(k), self.bits.select(k + 1)


class WaveletMatrix:
    """Rank queries on a sequence of small integers, one packed bit plane for each binary digit."""

    def __init__(self, values: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.n = len(values)
        self.bits, self.zeros = [], []
        v = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            one = (v >> level) & 1
            self.bits.append(Bits(one))
            self.zeros.append(self.n - int(one.sum()))
            flag = one.astype(bool)
            v = np.concatenate([v[~flag], v[flag]])
        symbols = np.arange(alphabet)
        self.base = self._descend(symbols, np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(at)
            one = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(one == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at``."""
        return self._descend(symbol, at) - self.base[symbol]


class FMIndex:
    """Index of word sequences (arrays of 64-bit word hashes), each owned by a document."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        words = np.concatenate(sequences) if len(sequences) else np.zeros(0, U64)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        # A separator (symbol 0) stands behind every sequence.
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(int(self.first[-1]), np.int64)
        spot = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        text[spot] = codes + 1
        ranks = prefix_ranks(text, depth)
        order = np.argsort(ranks[depth], kind="stable")
        bwt = text[order - 1]
        alphabet = len(self.vocabulary) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.tree = WaveletMatrix(bwt, alphabet)
        self.shorter, self.whole = Runs(ranks[depth - 1][order]), Runs(ranks[depth][order])
        self.owners, code = np.unique(np.asarray(owners, dtype=np.int64), return_inverse=True)
        of = np.repeat(code, sizes + 1)[order] if len(text) else np.zeros(0, np.int64)
        starts = self.whole.bits.select(np.arange(self.whole.number(np.array([len(text) - 1]))[0] + 1)) if len(text) else of
        self.least_owner = (np.minimum.reduceat(of, starts) if len(text) else of).astype(np.min_scalar_type(max(len(self.owners) - 1, 0)))

    @property
    def nbytes(self) -> int:
        """Bytes of what answers queries: bit planes, run marks, owners, vocabulary."""
        bits = [*self.tree.bits, self.shorter.bits, self.whole.bits]
        arrays = [x for b in bits for x in (b.words, b.before)] + [self.least_owner, self.owners, self.vocabulary, self.smaller, self.tree.base]
        return sum(x.nbytes for x in arrays)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; words that the index lacks have the symbol 0."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def matching_statistics(self, query: np.ndarray, lane: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """For every position of a query (symbols; 0 parts its pieces): how many words from
        there on occur in the index, ``depth`` at most, and the smallest document that
        owns an occurrence of all ``depth`` (a huge number where the match is shorter).

        Backward search: a lane holds the suffix interval of its current match.  A step to
        the left narrows it by two ranks for each end; where nothing is left the match
        starts anew.  A match of full depth is cut by one word on the right first, which
        widens the interval to the run of suffixes that agree in one word less.
        """
        n, depth = len(query), self.depth
        length, owner = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        if n == 0 or len(self.smaller) == 0 or self.tree.n == 0:
            return length, owner
        begin = np.arange(0, n, lane)
        # Lanes overlap by depth - 1 words, so that each knows the match to its right.
        at = np.minimum(begin + lane + depth - 2, n - 1)
        low, high, size = np.zeros(len(begin), np.int64), np.full(len(begin), self.tree.n), np.zeros(len(begin), np.int64)
        live = np.arange(len(begin))
        while len(live):
            c = query[at[live]]
            lo, hi, s = low[live], high[live], size[live]
            full = s == depth
            lo_full = lo[full]
            lo[full], hi[full] = self.shorter.around(lo_full)
            s[full] = depth - 1
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.concatenate([self.smaller[c], self.smaller[c]])
            lo, hi = both[: len(c)], both[len(c) :]
            s = s + 1
            lost = np.flatnonzero((lo >= hi) & (c > 0))
            if len(lost):  # shorter matches: cut words on the right until one extends to the left
                lo, hi, s = self._shrink(query, at[live], lost, lo, hi, s)
            barrier = c == 0
            lo[barrier], hi[barrier], s[barrier] = 0, self.tree.n, 0
            low[live], high[live], size[live] = lo, hi, s
            place = at[live]
            own = place < begin[live] + lane
            length[place[own]] = s[own]
            whole = own & (s == depth)
            owner[place[whole]] = self.owners[self.least_owner[self.whole.number(lo[whole])]]
            at[live] -= 1
            live = live[at[live] >= begin[live]]
        return length, owner

    def _shrink(self, query, place, lost, lo, hi, s):
        """Longest match from the place on, by searching ever shorter strings for the lanes that lost theirs."""
        for k in lost.tolist():
            want = int(s[k]) - 1
            while want > 0:
                a, b = 0, self.tree.n
                for p in range(place[k] + want - 1, place[k] - 1, -1):
                    c = query[p : p + 1]
                    a, b = (int(x) for x in self.tree.rank(np.repeat(c, 2), np.array([a, b])) + self.smaller[int(c[0])])
                    if a >= b:
                        break
                if a < b:
                    break
                want -= 1
            if want == 0:
                a, b = 0, self.tree.n
            lo[k], hi[k], s[k] = a, b, want
        return lo, hi, s
