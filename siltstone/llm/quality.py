"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  A passage is encoded from
its byte-class shares, repetition and vocabulary spread and a small hashed bag of words,
by one learned layer.  Gated attention (tanh branch times sigmoid branch) weighs the
passages; the weighted mean representation is scored by a logistic output.  All weights
are learned together from document labels by Adam with hand-written gradients.

Defined results: a null, empty or blank text is one passage without words (all features
zero); very long texts have as many passages as they need; repeated rows are scored one
by one; without usable labels of both classes the score is the share of positive labels
(0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .labelled import HELD_OUT_FOLD, fold_of, labelled_sample, with_verdict
from .textops import U64, Words, blocks, flat

PASSAGE_WORDS = 48
#: At most so many documents of each class are learnt from.
PER_CLASS = 1500
THRESHOLD = 0.5
BAG = 32
ENCODED, GATED = 24, 12
_CLASSES = 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"#$%&*@^~_=+<>[]{}\\/")] = 3
_CLASS[list(b"!?")] = 4
_CLASS[list(b".,;:'\"()-")] = 5
_CLASS[list(b"|")] = 6
_CLASS[128:] = 7
FEATURES = _CLASSES - 1 + 10 + BAG


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32) and the number of passages of every row (1 at least)."""
    buf, offsets = flat(column)
    feats, counts = [], []
    for i, j in blocks(offsets):
        f, c = _encode_block(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        feats.append(f)
        counts.append(c)
    if not counts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate(feats), np.concatenate(counts)


def _encode_block(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = Words(buf, offsets)
    n_words = w.counts
    bags = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(bags)])
    total = int(base[-1])
    out = np.zeros((total, FEATURES), np.float32)
    m = len(w.start)
    if not m:
        return out, bags
    row = np.repeat(np.arange(len(n_words)), n_words)
    passage = base[row] + (np.arange(m) - w.first[row]) // PASSAGE_WORDS
    n = np.bincount(passage, minlength=total).astype(np.float32)
    full = np.flatnonzero(n)
    head = np.concatenate([[0], np.cumsum(n[full].astype(np.int64))[:-1]])
    tail = np.concatenate([head[1:], [m]]) - 1
    begin, end = w.start[head], w.end[tail]
    size = (end - begin).astype(np.float32)
    kind = _CLASS[buf]
    for c in range(1, _CLASSES):
        sums = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int32)])
        out[full, c - 1] = (sums[end] - sums[begin]) / size
    k = _CLASSES - 1
    share = lambda flag: np.bincount(passage, flag, minlength=total)[full] / n[full]
    length = (w.end - w.start).astype(np.float32)
    first, last = kind[w.start], kind[w.end - 1]
    second = kind[np.minimum(w.start + 1, w.end - 1)]
    same = np.zeros(m)
    near = np.zeros(m)
    for lag in (1, 2, 3, 4, 5, 6):
        hit = (w.hash[lag:] == w.hash[:-lag]) & (passage[lag:] == passage[:-lag])
        near[lag:] = np.maximum(near[lag:], hit)
        if lag == 1:
            same[1:] = hit
    bucket = (w.hash >> U64(40)) % U64(BAG)
    bag = np.bincount(passage * BAG + bucket.astype(np.int64), minlength=total * BAG).reshape(total, BAG)
    fine = np.zeros((total, 128), bool)
    fine[passage, ((w.hash >> U64(30)) % U64(128)).astype(np.int64)] = True
    cols = (share(same), share(near), share(first == 1), share((first == 1) & (second == 1)), share((last == 3) | (last == 4)), share(last == 5),
            share(length) / 10, share(length <= 3), fine[full].sum(1) / np.minimum(n[full], 128), np.log1p(n[full]) / 4)
    for c, v in enumerate(cols):
        out[full, k + c] = v
    out[full, k + len(cols) :] = bag[full] / np.sqrt(np.maximum(1, (bag[full] ** 2).sum(1, keepdims=True)))
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    shift: float = 0.0

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        attention = e / np.repeat(_sum_by(e, starts), counts)
        z = _sum_by(attention[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "attention": attention, "z": z, "logit": z @ p["c"] + p["d"], "starts": starts}

    def scores(self, column: pa.Array) -> np.ndarray:
        x, counts = passages(column)
        if len(counts) == 0:
            return np.zeros(0)
        if not self.p:
            return np.full(len(counts), self.shift)
        return _sigmoid(self.forward((x - self.mean) / self.scale, counts)["logit"] + self.shift).astype(np.float64)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, prior: tuple[float, float] = (1.0, 1.0), steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> QualityModel:
    """``prior``: how often labels 0 and 1 occur; the logit is shifted from the sample's shares to these."""
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": draw(x.shape[1], ENCODED), "b": np.zeros(ENCODED, np.float32), "V": draw(ENCODED, GATED), "U": draw(ENCODED, GATED), "a": draw(GATED), "c": draw(ENCODED), "d": np.zeros((), np.float32)}
    model = QualityModel(mean, scale, p)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1):
        f = model.forward(x, counts)
        g = weight * (_sigmoid(f["logit"]) - y)
        grad = {"c": f["z"].T @ g, "d": g.sum()}
        dz = np.repeat(g[:, None] * p["c"], counts, axis=0)
        att = f["attention"]
        da = (dz * f["h"]).sum(1)
        de = att * (da - np.repeat(_sum_by(att * da, f["starts"]), counts))
        grad["a"] = (f["v"] * f["u"]).T @ de
        dvu = de[:, None] * p["a"]
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        grad["V"], grad["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (att[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = x.T @ dh, dh.sum(0)
        now = rate * min(1.0, 2 - 2 * t / (steps + 1))
        for k in p:
            q = grad[k] + decay * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * q
            m2[k] = 0.999 * m2[k] + 0.001 * q * q
            p[k] = (p[k] - now * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.shift = float(np.log(max(prior[1], 1) / max(prior[0], 1)))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """The sample's passages are encoded on the executors; 2 * per_class bags reach the driver."""
    sample = labelled_sample(docs, labels, "quality", per_class).select("doc_id", "y", "text")
    kind = dict(sample.dtypes)["doc_id"]

    def encode(batches):
        for b in batches:
            if b.num_rows:
                x, counts = passages(b.column("text"))
                ends = np.cumsum(counts)
                bags = pa.array([x[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), bags], ["doc_id", "y", "bag"])

    rows = sorted(sample.mapInArrow(tidied(encode), f"doc_id {kind}, y int, bag binary").collect(), key=lambda r: (r.doc_id, r.bag))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).dropna().filter(fold_of(F.col("doc_id")) != HELD_OUT_FOLD)
    prior = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    x = np.concatenate([np.frombuffer(r.bag, np.float32) for r in rows]).reshape(-1, FEATURES) if rows else np.zeros((0, FEATURES), np.float32)
    counts = np.array([len(r.bag) // (4 * FEATURES) for r in rows], dtype=np.int64)
    return fit(x, counts, np.array([r.y for r in rows], dtype=np.float32), (prior.get(0, 0), prior.get(1, 0)))


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    return with_verdict(docs, "", lambda column: shared.value.scores(column), threshold)
