"""Lexical and hashed search of all chunks of whole texts, several chunkings at once.

A batch of texts is tokenised once; the tokens of a chunk are a range of its text's tokens,
plus what is left of a token that a bound of the chunk cuts, which is tokenised by itself.
So no chunk is made as a text, and five chunkings cost one reading.  Two maps over the texts
do the work, and Spark adds up and ranks what they give:

* ``counted`` gives how many chunks hold a term.  The chunks of a chunking follow each other,
  so a token is the first of its kind in those that begin after the one before it and not
  before the token itself; these are differences of running counts, without a row for a chunk.
* ``search`` gives each task's k best chunks of every question.  A tile of chunks is scored
  against all questions of a block: the ``HEAVY`` terms that most questions ask for, and the
  hashed cells, as products of matrices, the others posting by posting.  The products are in
  single precision; what can be among the k best by that is scored in double precision.

Tokens, chunks and scores are those of ``functions.text.tokens``, ``chunking.all_chunks`` and
``retrieval.bm25_by_part`` and ``hashed_by_part``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import CHUNK_IDS, chunk_bounds
from .lexical import UNITS, Best, spread
from .retrieval import K1, query_blocks, saturation, weights_of

#: Chunks that are scored in one go, and terms that are columns of a matrix.
TILE, HEAVY = 2048, 256
#: Pairs of a chunk and a question whose scores are made exact in one go.
PAIRS = 1 << 12
#: Rough scores in single precision, how far they can be off, and the exact ones of pairs (rows, columns).
Scores = tuple[np.ndarray, np.ndarray | float, Callable[[np.ndarray, np.ndarray], np.ndarray]]
#: Different pieces of text that a task remembers.
PIECES = 1 << 19
#: Letters, digits and the marks that may stand within a number.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[48:58], _KIND[[44, 46]] = 1, 2, 3
_GROUPED = re.compile(r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))")
_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")


def words(text: str) -> list[str]:
    """``functions.text.tokens`` of one text."""
    return _TOKEN.findall(_GROUPED.sub("", text.lower()))


class Terms(dict):
    """Number of the term that a piece of text (in bytes) is; -1 if it has none, below that if it has several."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.several: list[list[int]] = []
        self._number: dict[str, int] = {}

    def number(self, term: str) -> int:
        n = self._number.setdefault(term, len(self.names))
        if n == len(self.names):
            self.names.append(term)
        return n

    def __missing__(self, piece: bytes) -> int:
        if piece.isalpha() or piece.isdigit():  # one term, as it stands
            n = self[piece] = self.number(piece.decode("ascii"))
            return n
        found = [self.number(t) for t in words(piece.decode("latin-1"))]
        if len(found) > 1:
            self.several.append(found)
        n = self[piece] = found[0] if len(found) == 1 else -1 - len(self.several) if found else -1
        return n

    def single(self, ids: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        """The numbers of terms alone, several ones one after the other, and what belongs to each."""
        able = ids != -1
        ids, others = ids[able], tuple(o[able] for o in others)
        many = np.flatnonzero(ids < -1)
        if not len(many):
            return ids, *others
        lists = [self.several[-2 - i] for i in ids[many].tolist()]
        times = np.ones(len(ids), np.int64)
        times[many] = [len(x) for x in lists]
        out, first = np.repeat(ids, times), np.cumsum(times) - times
        for at, x in zip(first[many].tolist(), lists, strict=True):
            out[at : at + len(x)] = x
        return out, *(np.repeat(o, times) for o in others)


class Batch:
    """The tokens of a batch of texts, one text after the other: their terms, and where they begin and end."""

    def __init__(self, texts: list[str], terms: Terms):
        self.texts, self.terms = texts, terms
        # The one letter whose lower case is two would shift what follows it: such texts are tokenised chunk by chunk.
        low = [t.lower() for t in texts]
        self.shifted = {i for i, (t, u) in enumerate(zip(texts, low, strict=True)) if len(t) != len(u)}
        low = [" " * len(texts[i]) if i in self.shifted else t for i, t in enumerate(low)]
        self.base = np.cumsum([0, *(len(t) + 1 for t in low)])
        # A byte for a character: what is no ASCII is between tokens anyhow.
        self.whole = "\n".join([*low, ""]).encode("latin-1", "replace")
        data = np.frombuffer(self.whole, np.uint8)
        kind = _KIND[data]
        marks = np.flatnonzero(kind == 3)
        kind[marks] = np.where((marks > 0) & (kind[marks - 1] == 2) & (kind[np.minimum(marks + 1, len(kind) - 1)] == 2), 2, 0)
        turn = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        start, end = np.concatenate([[0], turn]), np.append(turn, len(kind))
        token = kind[start[start < len(kind)]] > 0
        start, end = start[: len(token)][token], end[: len(token)][token]
        # Each different piece of the batch is looked up once.
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[kind > 0])]).dictionary_encode()
        known = np.fromiter(map(terms.__getitem__, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
        self.id, self.start, self.end = terms.single(known[pieces.indices.to_numpy()], start, end)

    def chunks(self, name: str) -> Chunks:
        return Chunks(self, chunk_bounds(name, self.texts))


class Chunks:
    """Chunks of a batch: text, place in it, range of tokens, and (row, term) of cut tokens."""

    def __init__(self, batch: Batch, rows: np.ndarray):
        self.doc, self.place, a, z = rows
        inside = a, z
        start, end, n = batch.start, batch.end, len(batch.id)
        a, z = a + batch.base[self.doc], z + batch.base[self.doc]
        self.lo, hi = np.searchsorted(start, a), np.searchsorted(end, z, "right")
        # What a bound cuts: from the beginning to the token's end, from the token's start to the end, or both.
        if n:
            before, after = np.maximum(self.lo - 1, 0), np.minimum(hi, n - 1)
            front = (self.lo > 0) & (end[before] > a)
            back = (hi < n) & (start[after] < z) & ~(front & (start[after] == start[before]))
            f, b = np.flatnonzero(front), np.flatnonzero(back)
            row = np.concatenate([f, b])
            left, right = np.concatenate([a[f], start[after[b]]]), np.concatenate([np.minimum(end[before[f]], z[f]), z[b]])
        else:
            row = left = right = np.zeros(0, np.int64)
        cut = [batch.whole[s:e] for s, e in zip(left.tolist(), right.tolist(), strict=True)]
        if batch.shifted:
            odd = [r for r, d in enumerate(self.doc.tolist()) if d in batch.shifted]
            pairs = [(r, w) for r in odd for w in words(batch.texts[self.doc[r]][inside[0][r] : inside[1][r]])]
            row, cut = np.concatenate([row, np.array([r for r, _ in pairs], np.int64)]), cut + [w.encode() for _, w in pairs]
        ids = np.fromiter(map(batch.terms.__getitem__, cut), np.int64, len(cut))
        self.extra, self.extra_row = batch.terms.single(ids, row)
        self.hi = np.maximum(hi, self.lo)
        self.length = self.hi - self.lo + np.bincount(self.extra_row, minlength=len(self.doc))

    def holders(self, batch: Batch, order: np.ndarray, before: np.ndarray, terms: int) -> np.ndarray:
        """How many of the chunks hold each term; ``order`` sorts the tokens by term, ``before`` is the one before of the same term."""
        n = len(batch.id)
        begun, over = (np.cumsum(np.bincount(x, minlength=n + 1))[:n] for x in (self.lo, self.hi))
        first = begun - np.maximum(np.where(before >= 0, begun[before], 0), over) if n else begun
        out = np.bincount(batch.id, first, minlength=terms)
        if len(self.extra):
            row, term = np.divmod(np.unique(self.extra_row * terms + self.extra), terms)
            key = batch.id[order] * (n + 1) + order
            at = np.searchsorted(key, term * (n + 1) + self.lo[row])
            held = np.append(key, np.iinfo(np.int64).max)[at] < term * (n + 1) + self.hi[row]
            out += np.bincount(term[~held], minlength=terms)
        return out.astype(np.int64)

    def postings(self, batch: Batch, of: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, what ``of`` gives for the term) of all tokens of the chunks from ``low`` to ``high`` for which it gives any."""
        size = self.hi[low:high] - self.lo[low:high]
        row = np.concatenate([np.repeat(np.arange(high - low), size), self.extra_row[(some := (self.extra_row >= low) & (self.extra_row < high))] - low])
        value = of[np.concatenate([batch.id[spread(self.lo[low:high], size)], self.extra[some]])]
        able = value >= 0
        return (row, value) if able.all() else (row[able], value[able])


def _batches(batches: Iterator[pa.RecordBatch], made) -> Iterator[tuple[np.ndarray, Batch]]:
    """(doc_ids, texts' tokens); ``made`` gives the terms, new ones where the old became too many."""
    for b in batches:
        if b.num_rows:
            yield b.column("doc_id").to_numpy(zero_copy_only=False), Batch([t or "" for t in b.column("text").to_pylist()], made())


def texts_of(docs: DataFrame) -> DataFrame:
    """What the maps read; bounds the Arrow batches."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def counted(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, term, df) of the chunks of each chunking, and a term ``#n`` of each chunk that has n tokens; part is the place in ``names``."""

    columns = [f"df{part}" for part in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total, sizes = Terms(), np.zeros((len(names), 0), np.int64), [np.zeros(0, np.int64)] * len(names)

        def rows() -> Iterator[pa.RecordBatch]:
            # A row has the counts of all parts: most terms are in several.
            lengths = np.zeros((len(names), max(map(len, sizes))), np.int64)
            for line, found in zip(lengths, sizes, strict=True):
                line[: len(found)] = found
            held = np.flatnonzero(lengths.any(axis=0))
            for term, df in ((terms.names, total), ([f"#{n}" for n in held], lengths[:, held])):
                yield pa.RecordBatch.from_arrays([pa.array(term[: df.shape[1]], pa.string()), *map(pa.array, df)], ["term", *columns])

        for _, batch in _batches(batches, lambda: terms):
            order = np.argsort(batch.id, kind="stable")
            before = np.full(len(order), -1)
            same = batch.id[order[1:]] == batch.id[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            for part, name in enumerate(names):
                chunks = batch.chunks(name)
                n = len(terms.names)
                if total.shape[1] < n:
                    total = np.pad(total, ((0, 0), (0, n - total.shape[1])))
                total[part] += chunks.holders(batch, order, before, n) if n else 0
                lengths = np.bincount(chunks.length)
                most = max(len(lengths), len(sizes[part]))
                sizes[part] = np.pad(sizes[part], (0, most - len(sizes[part]))) + np.pad(lengths, (0, most - len(lengths)))
            if len(terms) > PIECES:
                yield from rows()
                terms, total, sizes = Terms(), np.zeros((len(names), 0), np.int64), [np.zeros(0, np.int64)] * len(names)
        yield from rows()

    found = texts_of(docs).mapInArrow(run, ", ".join(["term string", *(f"{c} long" for c in columns)]))
    summed = found.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))
    return summed.select("term", F.posexplode(F.array(*columns)).alias("part", "df")).filter("df > 0").select("part", "term", "df")


class Held:
    """The k best of every question; what may be among them is gathered before it is ranked."""

    def __init__(self, n: int, k: int):
        self.best, self.most, self.n, self.new = Best(n, k), n * k, 0, []
        self.low = np.full(n, -np.inf)

    def tile(self, values: np.ndarray, slack: np.ndarray | float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, met: np.ndarray | None) -> None:
        """Scores of chunks (rows) and questions, off by ``slack`` at most; ``exact`` gives those of pairs.  ``met``: which count, else those above 0."""
        low, k, kind = self.low, self.best.k, np.finfo(values.dtype)
        if met is not None and not met.all():
            values = np.where(met, values, -np.inf)
        if len(values) > k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(values, len(values) - k, axis=0)[len(values) - k] - slack - 2 / UNITS)
        bar = np.nextafter(np.maximum(low - slack, kind.min).astype(values.dtype), kind.min)
        bar = np.maximum(bar, kind.tiny if met is None else kind.min)
        row, question = np.divmod(np.flatnonzero((values >= bar).ravel()), values.shape[1])
        for at in range(0, len(row), PAIRS):
            r, q = row[at : at + PAIRS], question[at : at + PAIRS]
            score = exact(r, q)
            able = score >= low[q]
            self.new.append((q[able], ids[r[able]], score[able]))
            self.n += int(able.sum())
        if self.n > self.most:
            self.rank()

    def rank(self) -> None:
        if self.new:
            self.best.offer(*map(np.concatenate, zip(*self.new, strict=True)))
            self.low, self.new, self.n = (self.best.bar - 1) / UNITS, [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.rank()
        return self.best.rows()


class Asked:
    """A block of questions: their ids, weights of their terms by part, and hashed vectors by size."""

    def __init__(self, asked: dict[int, Sequence[str]], weights: dict[int, tuple[list[tuple[int, str, float]], float]], sizes: Sequence[int]):
        self.ids = sorted(asked)
        place = {q: i for i, q in enumerate(self.ids)}
        often: dict[str, int] = {}
        for found in asked.values():
            for t in set(found or ()):
                often[t] = often.get(t, 0) + 1
        #: Terms by number, those that most questions have first; of the others the (question, weight) pairs, one term after the other.
        self.terms = {t: i for i, t in enumerate(sorted(often, key=lambda t: (-often[t], t)))}
        self.parts = {}
        for part, (rows, mean) in weights.items():
            term, question = (np.array(x, np.int64) for x in ([self.terms[t] for _, t, _ in rows], [place[q] for q, _, _ in rows]))
            weight = np.array([w for _, _, w in rows], np.float64)
            heavy = np.zeros((min(HEAVY, len(self.terms)), len(self.ids)))
            top = term < len(heavy)
            heavy[term[top], question[top]] = weight[top]
            asks = np.zeros(heavy.shape)
            asks[term[top], question[top]] = 1
            order = np.flatnonzero(~top)[np.argsort(term[~top], kind="stable")]
            first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
            # A score is at most the sum of the weights times what a saturated term counts.
            slack = self._slack(len(heavy)) * (K1 + 1) * np.bincount(question, np.abs(weight), minlength=len(self.ids))
            self.parts[part] = (heavy, slack, asks, first, question[order], weight[order], max(mean, 1e-300), bool((weight <= 0).any()))
        self.sizes = {n: self._unit(np.array([np.bincount([cell(t, n) for t in asked[q] or ()], minlength=n) for q in self.ids], np.float64).reshape(-1, n)).T for n in sizes}

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)

    @staticmethod
    def _slack(n: int) -> float:
        """How far a sum of n products in single precision can be off, as a share of the sum of their sizes; with room for what is made of it."""
        return (2 * n + 64) * 2.0**-24

    def lexical(self, part: int, row: np.ndarray, term: np.ndarray, length: np.ndarray) -> tuple[Scores, np.ndarray | None]:
        """Scores of all chunks of a tile, and which pairs share a term (where scores above 0 do not tell)."""
        heavy, slack, asks, first, question, weight, mean, mixed = self.parts[part]
        n, columns = len(length), len(self.ids)
        top = term < len(heavy)
        count = np.bincount(row[top] * len(heavy) + term[top], minlength=n * len(heavy))
        at = np.flatnonzero(count > 0)
        matrix = np.zeros((n, len(heavy)))
        matrix.ravel()[at] = saturation(count[at], length[at // len(heavy)] / mean, 1.0)
        key, count = np.unique(row[~top] * len(self.terms) + term[~top], return_counts=True)
        row, term = np.divmod(key, len(self.terms))
        size = first[term + 1] - first[term]
        pair = spread(first[term], size)
        spot = np.repeat(row, size) * columns + question[pair]
        value = saturation(count, length[row] / mean, 1.0)
        light = np.bincount(spot, weight[pair] * np.repeat(value, size), minlength=n * columns).reshape(n, columns)
        out = matrix.astype(np.float32) @ heavy.astype(np.float32)
        out += light
        scores = out, slack, lambda r, q: np.einsum("ij,ij->i", matrix[r], heavy.T[q]) + light[r, q]
        if not mixed:
            return scores, None
        return scores, ((matrix > 0).astype(float) @ asks + np.bincount(spot, minlength=n * columns).reshape(n, columns)) > 0

    def hashed(self, row: np.ndarray, cells: np.ndarray, n: int) -> Iterator[tuple[int, Scores]]:
        """Scores of all chunks of a tile for each size."""
        top = max(self.sizes)
        counts = np.bincount(row * top + cells, minlength=n * top).reshape(n, top).astype(np.float32)
        for size, asked in self.sizes.items():
            held = counts.reshape(n, top // size, size).sum(axis=1)
            rough = held / np.sqrt(np.maximum(np.einsum("ij,ij->i", held, held), 1))[:, None]
            yield size, (rough @ asked.astype(np.float32), self._slack(size), lambda r, q, held=held, asked=asked: np.einsum("ij,ij->i", self._unit(held[r].astype(np.float64)), asked.T[q]))


def cell(term: str, cells: int) -> int:
    """``functions.text.md5_int``, by the number of cells."""
    return int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big") % cells


def search(docs: DataFrame, queries: DataFrame, names: Sequence[str], k: int, sizes: Sequence[int] = (), lexical: bool = True) -> DataFrame:
    """(part, cells, query_id, chunk_id, score) of at least the k best chunks of every question (query_id, qt), for each chunking.

    ``cells`` is 0 for lexical scores, else a size of hashed vectors (each a divisor of the greatest).
    """
    if any(max(sizes) % n for n in sizes):
        raise ValueError("sizes must divide the greatest")
    spark, out = docs.sparkSession, None
    blocks = query_blocks(queries)
    frequencies = counted(docs, names) if lexical else None
    if frequencies is not None and len(blocks) > 1:
        frequencies.persist()
    for block in blocks:
        asked = {r.query_id: r.qt for r in block.select("query_id", "qt").collect()}
        weights = weights_of(frequencies, asked, "part") if lexical else {}
        shared = spark.sparkContext.broadcast(Asked(asked, weights, sizes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            if not asked.ids:
                return
            held: dict[tuple[int, int], Held] = {}
            terms, wanted, cells = Terms(), np.zeros(0, np.int64), np.zeros(0, np.int64)

            def some() -> Terms:
                nonlocal terms, wanted, cells
                if len(terms) > PIECES:
                    terms, wanted, cells = Terms(), np.zeros(0, np.int64), np.zeros(0, np.int64)
                return terms

            for docs_of, batch in _batches(batches, some):
                for part, name in enumerate(names):
                    chunks = batch.chunks(name)
                    new = terms.names[len(wanted) :]
                    wanted = np.concatenate([wanted, np.array([asked.terms.get(t, -1) for t in new], np.int64)])
                    if sizes:
                        cells = np.concatenate([cells, np.array([cell(t, max(sizes)) for t in new], np.int64)])
                    ids = docs_of[chunks.doc] * CHUNK_IDS + chunks.place
                    for a in range(0, len(ids), TILE):
                        z = min(a + TILE, len(ids))
                        if part in asked.parts:
                            best = held.setdefault((part, 0), Held(len(asked.ids), k))
                            scores, met = asked.lexical(part, *chunks.postings(batch, wanted, a, z), chunks.length[a:z])
                            best.tile(*scores, ids[a:z], met)
                        if sizes:
                            for size, scores in asked.hashed(*chunks.postings(batch, cells, a, z), z - a):
                                held.setdefault((part, size), Held(len(asked.ids), k)).tile(*scores, ids[a:z], None)
            for (part, size), best in held.items():
                question, item, score = best.rows()
                fixed = [np.full(len(question), x, np.int32) for x in (part, size)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(np.array(asked.ids, np.int64)[question]), pa.array(item), pa.array(score)], ["part", "cells", "query_id", "chunk_id", "score"])

        found = texts_of(docs).mapInArrow(run, "part int, cells int, query_id long, chunk_id long, score double").withColumn("score", F.round("score", 6))
        out = found if out is None else out.unionByName(found)
    if frequencies is not None and len(blocks) > 1:
        frequencies.unpersist()  # the weights are here by now
    return out
