"""Lexical scores of a stream of chunks against a block of questions, with early stop.

The chunks of an Arrow batch are cut into blocks of ``ROWS``.  Of every term asked for a block
has its postings and the greatest part of a score that the term has in it; the weighted sum of
these maxima bounds what a question can score in the block.  A question meets the blocks by
falling bounds, one, then two, four and so on, and only those whose bound reaches its k-th best score so far.
A block that a question meets is scored by the postings of that question's terms alone, so no
matrix of chunks and terms is ever made.

What a task keeps is the k best chunks of each question of the block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a block.
ROWS = 64
#: Postings scored in one go.
POSTINGS = 1 << 20
#: Scores are compared at this many units of one.
UNITS = 1e6


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Questions:
    """(query_id, term, weight) rows by question and by term."""

    def __init__(self, rows: list[tuple[int, str, float]]):
        self.ids = sorted({r[0] for r in rows})
        self.terms = sorted({r[1] for r in rows})
        place, spot = {q: i for i, q in enumerate(self.ids)}, {t: i for i, t in enumerate(self.terms)}
        question, term = (np.array(c, np.int64) for c in ([place[r[0]] for r in rows], [spot[r[1]] for r in rows]))
        weight = np.array([r[2] for r in rows], np.float64)
        self.by_question = self._sorted(question, term, weight, len(self.ids))
        self.by_term = self._sorted(term, question, weight, len(self.terms))

    @staticmethod
    def _sorted(key: np.ndarray, other: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of every key's run, and what the runs hold."""
        order = np.lexsort((other, key))
        return np.searchsorted(key[order], np.arange(n + 1)), other[order], weight[order]


class Best:
    """The k best (score, item) of every question; ties by the smaller item."""

    def __init__(self, n: int, k: int):
        self.rank = np.full((n, k), -np.inf)
        self.item, self.score = np.zeros((n, k), np.int64), np.zeros((n, k))
        self.k = k

    @property
    def bar(self) -> np.ndarray:
        """What a score must reach, in units, to be among the best."""
        return self.rank[:, -1]

    def offer(self, question: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        rank = np.floor(score * UNITS + 0.5)
        able = rank >= self.bar[question]
        question, item, score, rank = question[able], item[able], score[able], rank[able]
        if not len(question):
            return
        names = np.unique(question)
        question = np.concatenate([question, np.repeat(names, self.k)])
        item, score, rank = (np.concatenate([new, held[names].ravel()]) for new, held in ((item, self.item), (score, self.score), (rank, self.rank)))
        order = np.lexsort((item, -rank, question))
        first = np.searchsorted(question[order], names)
        chosen = order[first[:, None] + np.arange(self.k)]
        self.item[names], self.score[names], self.rank[names] = item[chosen], score[chosen], rank[chosen]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, item, score) of all that is held."""
        question, place = np.nonzero(self.rank > -np.inf)
        return question, self.item[question, place], self.score[question, place]


class Search:
    """Offers the chunks of batch after batch to the best of every question.

    ``part`` tells what a term adds that stands so often in a chunk of so many times the mean length.
    """

    def __init__(self, questions: Questions, part: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int):
        self.q, self.part, self.best = questions, part, Best(len(questions.ids), k)
        #: Postings scored, and postings that share a term with a question.
        self.scored = self.matching = 0

    def batch(self, ids: np.ndarray, lists: pa.ListArray, mean: np.ndarray | float) -> None:
        """``mean``: the mean length of the chunks that a row is compared with."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(self.q.terms, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row, terms = np.repeat(np.arange(len(sizes)), sizes)[named >= 0], len(self.q.terms)
        # Sorted by block, term and row.
        key, count = np.unique((row // ROWS * terms + named[named >= 0]) * ROWS + row % ROWS, return_counts=True)
        if not len(key):
            return
        self.row = key // ROWS // terms * ROWS + key % ROWS
        self.value = self.part(count, (sizes / mean)[self.row])
        self.first = np.flatnonzero(np.diff(key // ROWS, prepend=-1))
        self.group = key[self.first] // ROWS
        self.ids, self.size = ids, np.diff(np.append(self.first, len(key)))
        top = np.maximum.reduceat(self.value, self.first)
        bound = self._bounds(top, -(-len(sizes) // ROWS))
        block, question = np.nonzero(bound > -np.inf)
        value = bound[block, question]
        # Of every question the blocks with the greatest bounds come first.
        order = np.lexsort((block, -value, question))
        block, question, value = block[order], question[order], value[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        # One block of each question, then two, four and so on: what they hold lifts the bar for the rest.
        done = 0
        while (now := (place >= done) & (place < 2 * done + 1)).any():
            self._score(block[now], question[now], value[now])
            done = 2 * done + 1

    def _bounds(self, top: np.ndarray, blocks: int) -> np.ndarray:
        """What each question can score at most in each block; minus infinity where they share no term."""
        starts, question, weight = self.q.by_term
        bound, met = np.zeros(blocks * len(self.q.ids)), np.zeros(blocks * len(self.q.ids), bool)
        block, term = np.divmod(self.group, len(self.q.terms))
        size = starts[term + 1] - starts[term]
        self.matching += int((size * self.size).sum())
        for some in np.split(np.arange(len(term)), np.searchsorted(np.cumsum(size), np.arange(POSTINGS, int(size.sum()), POSTINGS))):
            at = spread(starts[term[some]], size[some])
            spot = np.repeat(block[some], size[some]) * len(self.q.ids) + question[at]
            bound += np.bincount(spot, np.maximum(weight[at], 0) * np.repeat(top[some], size[some]), minlength=len(bound))
            met[spot] = True
        return np.where(met, bound, -np.inf).reshape(blocks, len(self.q.ids))

    def _score(self, block: np.ndarray, question: np.ndarray, bound: np.ndarray) -> None:
        starts, term, weight = self.q.by_question
        for a in range(0, len(block), POSTINGS // ROWS):
            b, q = block[a : a + POSTINGS // ROWS], question[a : a + POSTINGS // ROWS]
            able = np.floor(bound[a : a + POSTINGS // ROWS] * (1 + 1e-9) * UNITS + 1) >= self.best.bar[q]
            b, q = b[able], q[able]
            count = starts[q + 1] - starts[q]
            at = spread(starts[q], count)
            wanted = np.repeat(b, count) * len(self.q.terms) + term[at]
            place = np.minimum(np.searchsorted(self.group, wanted), len(self.group) - 1)
            held = np.flatnonzero(self.group[place] == wanted)
            pair, place, w = np.repeat(np.arange(len(b)), count)[held], place[held], weight[at][held]
            size = self.size[place]
            ends = np.cumsum(np.bincount(pair, size, minlength=len(b))).astype(np.int64)
            cuts = np.unique(np.searchsorted(ends, np.arange(POSTINGS, int(size.sum()), POSTINGS)))
            for low, high in zip([0, *cuts], [*cuts, len(b)], strict=True):
                i, j = np.searchsorted(pair, [low, high])
                p = spread(self.first[place[i:j]], size[i:j])
                self.scored += len(p)
                slot = np.repeat(pair[i:j] - low, size[i:j]) * ROWS + self.row[p] % ROWS
                total = np.bincount(slot, np.repeat(w[i:j], size[i:j]) * self.value[p], minlength=(high - low) * ROWS)
                seen = np.flatnonzero(np.bincount(slot, minlength=len(total)))
                self.best.offer(q[low:high][seen // ROWS], self.ids[b[low:high][seen // ROWS] * ROWS + seen % ROWS], total[seen])
