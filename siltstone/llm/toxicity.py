"""Toxicity: a counterfactual-regularised sparse linear classifier.

Features of a text are the words it contains and their first 4, 5 and 6 bytes (letters
only, A-Z lower-cased), hashed into ``DIMENSIONS`` cells, present or absent.  A logistic
regression with an L1 penalty is fitted to a bounded labelled sample.  Every mention of
an identity group in a labelled sentence is written again with each of the other terms of
its kind, and the squared difference of the two logits is part of the loss: a neutral
mention of a group must not move the score.  The swaps of one text weigh one together.
Fixed neutral frames carry the same penalty, so the constraint holds for terms the sample
lacks.  Features and swaps are made on the executors; the driver gets numbers of cells.
The logit is then scaled on the part of the sample that the weights were not fitted to.

Defined results: null and empty texts have the score of the bias; null ids are scored and
never held out; repeated rows are scored one by one, and of repeated labelled rows one text
is learnt from; without usable labels of both classes every score is the share of positive
labels (0 without labels); an empty table gives an empty result; columns of ``docs`` beside
id and text, whatever their names, are ignored when scoring and kept by ``without_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidied
from .labelled import HELD_OUT_FOLD, labelled_sample, with_verdict
from .textops import NOT_LETTER, U64, Words, blocks, flat, mix

DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6)
#: At most so many documents of each class are learnt from.
PER_CLASS = 2500
THRESHOLD = 0.7
#: With fewer positive labels, both parts of the sample serve weights and scale in turn.
FEW_POSITIVES = 500
#: Interchangeable names of groups, by kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("disabled", "deaf", "blind"), ("old", "young"),
)
_FRAMES = ("i met a {} person today", "my neighbour is {}", "the {} community opened a school", "we are proud to be {}")
_SWAPS = {t: [o for o in kind if o != t] for kind in IDENTITY_TERMS for t in kind}


def feature_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every feature occurrence; a row may have a cell more than once."""
    buf, offsets = flat(column)
    rows, cells = [], []
    for i, j in blocks(offsets):
        w = Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True, space=NOT_LETTER)
        row = np.repeat(np.arange(i, j), w.counts)
        rows.append(row)
        cells.append((w.hash >> U64(20)) % U64(DIMENSIONS))
        for n in PREFIXES:
            long = w.end - w.start > n
            start = w.start[long]
            rows.append(row[long])
            cells.append((mix(w.span_hash(start, start + n) + U64(n)) >> U64(20)) % U64(DIMENSIONS))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64)


def distinct_pairs(row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * DIMENSIONS + cell)
    return key // DIMENSIONS, key % DIMENSIONS


#: The cells that only the sentence as written has, and those that only the swapped one has.
Swap = tuple[tuple[int, ...], tuple[int, ...]]
_NOT_WORD = re.compile("[^a-z\u0080-\U0010ffff]+")
_A_TO_Z = {c: c + 32 for c in range(65, 91)}


def word_cells(words: list[str]) -> dict[str, tuple[int, ...]]:
    """The cells of each word."""
    row, cell = distinct_pairs(*feature_pairs(pa.array(words, pa.large_string())))
    parts = np.split(cell, np.searchsorted(row, np.arange(1, len(words)))) if len(words) else []
    return {w: tuple(c.tolist()) for w, c in zip(words, parts, strict=True)}


def swaps_of(texts: list[str]) -> list[dict[Swap, float]]:
    """For each text, how every mention of a group changes the cells of its sentence when another term of its kind stands there.

    Equal changes are one entry; the weights of a text add up to one.
    """
    named: list[list[list[str]]] = []
    for text in texts:
        sentences = [_NOT_WORD.split(s.translate(_A_TO_Z)) for s in re.split("[.\n]", text)]
        named.append([w for w in sentences if not _SWAPS.keys().isdisjoint(w)])
    cells = word_cells(sorted({w for sentences in named for words in sentences for w in words if w} | _SWAPS.keys()))
    out = []
    for sentences in named:
        found: Counter[Swap] = Counter()
        for words in sentences:
            held = Counter(c for w in words if w for c in cells[w])
            for word in words:
                for other in _SWAPS.get(word, ()):
                    mine, new = Counter(cells[word]), cells[other]
                    lost = tuple(sorted(c for c in mine if held[c] == mine[c] and c not in new))
                    found[lost, tuple(sorted(c for c in new if not held[c]))] += 1
        total = sum(found.values())
        out.append({swap: n / total for swap, n in found.items()})
    return out


def frame_swaps() -> list[dict[Swap, float]]:
    return swaps_of([f.format(t) for kind in IDENTITY_TERMS for t in kind for f in _FRAMES])


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        row, cell = feature_pairs(column)
        used = self.weights[cell] != 0
        row, cell = distinct_pairs(row[used], cell[used])
        return out + np.bincount(row, self.weights[cell], minlength=len(column))

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -30, 30)))


def fit(row: np.ndarray, cell: np.ndarray, y: np.ndarray, calibrate: np.ndarray, swaps: Iterable[dict[Swap, float]], l1: float = 2e-3, swap_penalty: float = 1.0, steps: int = 300, min_docs: int = 3) -> ToxicityModel:
    """Proximal gradient descent with momentum on (row, cell) features; ``calibrate`` marks rows that only scale the logit."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(np.zeros(DIMENSIONS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    often = np.bincount(cell, minlength=DIMENSIONS) >= min(min_docs, max(1, len(y) // 20))
    whole: Counter[Swap] = Counter()
    for some in (*swaps, *frame_swaps()):
        whole.update(some)
    changes = [s for s in whole if s[0] or s[1]]
    share = np.array([whole[s] for s in changes]) / sum(whole.values())
    prow = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes])
    pcell = np.array([c for a, b in changes for c in a + b], dtype=np.int64)
    sign = np.array([v for a, b in changes for v in [1.0] * len(a) + [-1.0] * len(b)])
    names = np.flatnonzero(often)
    place = np.full(DIMENSIONS, -1)
    place[names] = np.arange(len(names))
    keep = place[cell] >= 0
    row, col = row[keep], place[cell[keep]]
    pkeep = place[pcell] >= 0
    prow, pcol, sign = prow[pkeep], place[pcell[pkeep]], sign[pkeep]
    n_swaps, d = len(changes), len(names)

    def solve(rows: np.ndarray) -> tuple[np.ndarray, float]:
        index = np.full(len(y), -1)
        index[rows] = np.arange(len(rows))
        mine = index[row] >= 0
        r, c, t = index[row[mine]], col[mine], y[rows].astype(float)
        weight = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, len(t) - t.sum()))
        w, b, w_old, b_old, momentum = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
        step = 1 / (0.25 * _norm(r, c, len(t), d, weight) + 2 * swap_penalty * _norm(prow, pcol, n_swaps, d, share, sign) + 0.25)
        for _ in range(steps):
            m = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            vw, vb = w + (momentum - 1) / m * (w - w_old), b + (momentum - 1) / m * (b - b_old)
            w_old, b_old, momentum = w, b, m
            z = np.bincount(r, vw[c], minlength=len(t)) + vb
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t)
            gap = share * np.bincount(prow, sign * vw[pcol], minlength=n_swaps)
            grad = np.bincount(c, g[r], minlength=d) + np.bincount(pcol, 2 * swap_penalty * gap[prow] * sign, minlength=d)
            w = vw - step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            b = vb - step * g.sum()
        return w, b

    def logits_of(rows: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
        index = np.full(len(y), -1)
        index[rows] = np.arange(len(rows))
        mine = index[row] >= 0
        return np.bincount(index[row[mine]], w[col[mine]], minlength=len(rows)) + b

    fitted, rest = np.flatnonzero(~calibrate), np.flatnonzero(calibrate)
    if min(len(set(y[fitted])), len(set(y[rest]))) < 2:
        fitted = rest = np.arange(len(y))
    w, b = solve(fitted)
    z, t = logits_of(rest, w, b), y[rest]
    if fitted is not rest and y.sum() < FEW_POSITIVES:  # every label is dear: each half scales the other's logits, all set the weights
        z, t = np.concatenate([z, logits_of(fitted, *solve(rest))]), np.concatenate([t, y[fitted]])
        w, b = solve(np.arange(len(y)))
    a, c0 = _platt(z, t.astype(float))
    full = np.zeros(DIMENSIONS, np.float32)
    full[names] = a * w
    return ToxicityModel(full, float(a * b + c0))


def _norm(r, c, n, d, weight, sign=None) -> float:
    """Largest eigenvalue of X'WX by power iteration (with some room)."""
    v = np.ones(d) / np.sqrt(max(1, d))
    top = 1.0
    s = np.ones(len(r)) if sign is None else sign
    for _ in range(15):
        z = weight * np.bincount(r, s * v[c], minlength=n)
        u = np.bincount(c, s * z[r], minlength=d)
        top = float(np.linalg.norm(u))
        if top == 0:
            return 0.0
        v = u / top
    return 1.1 * top


def _platt(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed, class-balanced targets, by Newton steps."""
    n1, n0 = t.sum(), len(t) - t.sum()
    goal = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(t == 1, 0.5 / n1, 0.5 / n0) * len(t)
    x = np.stack([z, np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - goal)) + 1e-3 * (theta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        move = np.linalg.solve(hess, grad)
        theta = theta - move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def _encode(texts: list[str]) -> tuple[list[np.ndarray], list[list[tuple[tuple[int, ...], tuple[int, ...], float]]]]:
    """Cells and swaps of each text."""
    cells = []
    for t in texts:
        cells.append(np.unique(feature_pairs(pa.array([t], pa.large_string()))[1]).astype(np.int32))
    return cells, [[(a, b, w) for (a, b), w in sorted(s.items())] for s in swaps_of(texts)]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fits on a bounded sample, whose features are made on the executors; fold 0 sets the weights, fold 2 the scale."""
    sample = labelled_sample(docs, labels, "toxic", per_class)
    swap = pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32())), ("weight", pa.float64())])

    def encode(batches):
        for b in batches:
            if b.num_rows:
                cells, swaps = _encode(b.column("text").to_pylist())
                swaps = [[dict(zip(("lost", "gained", "weight"), s, strict=True)) for s in some] for some in swaps]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(swaps, pa.list_(swap))], ["doc_id", "y", "fold", "cells", "swaps"])

    kind = dict(sample.dtypes)["doc_id"]
    coded = sample.mapInArrow(tidied(encode), f"doc_id {kind}, y int, fold int, cells binary, swaps array<struct<lost: array<int>, gained: array<int>, weight: double>>")
    rows = sorted(coded.collect(), key=lambda r: r.doc_id)
    assert all(r.fold != HELD_OUT_FOLD for r in rows)
    cells = [np.frombuffer(r.cells, np.int32).astype(np.int64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
    swaps = [{(tuple(s.lost), tuple(s.gained)): s.weight for s in r.swaps} for r in rows]
    return fit(row, np.concatenate([np.zeros(0, np.int64), *cells]), np.array([r.y for r in rows], dtype=int), np.array([r.fold == 2 for r in rows], dtype=bool), swaps)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    return with_verdict(docs, "", lambda column: shared.value.scores(column), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(shared.value.scores(b.column("text")) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
