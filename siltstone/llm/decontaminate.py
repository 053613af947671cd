"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits, A-Z lower-cased.  A seed is the hash of the tokens
under the ones of a fixed mask; the zeros are ignored, so a substituted token there does
not hide a copy.  The seeds of the benchmark items are joined with those of every
document; each hit fixes a diagonal (document position less item position), along which
the two token sequences are compared.  The best-scoring stretch (one for a match, minus
three for a mismatch) is a leak if it has ``MIN_MATCH`` matching tokens, or four fifths of
a shorter item's.  Items of fewer than ``MIN_ITEM`` tokens are found where they stand whole.

Places of one seed at equal distances, as monotonous and periodic texts have them, are one run
(first place, step, number); two runs of one step that meet give a range of diagonals instead
of all pairs of their places.  Runs meet in slices of at most ``SLICE`` pairs, and ranges are
compared in slices of ``SLICE`` diagonals, of which only the best stretch of a row and item is kept.

The benchmark is joined in blocks of at most ``BLOCK_BYTES`` of text, each broadcast, so
its size bounds neither memory nor correctness: every block meets every document.

Defined results: null and empty texts have no tokens and no leaks, null items none either;
very long texts are compared whole, in those slices;
of several copies of an item in one document the longest is reported, then the first;
repeated rows are reported each, and rows with a null id with that id; empty tables give
an empty result; columns beside ids and texts, whatever their names, are ignored (and kept
by ``without_leaks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_or_many, only, tidied
from .textops import NOT_LETTER, U64, Words, blocks, flat, mix

#: The masks, six tokens of spans of nine to twelve.
MASKS = ("111010011", "1101001011", "11001010101", "101100100011")
#: Masks that only items of so few tokens are looked for by: what the masks above miss of these.  They leave
#: out every set of substitutions that still makes a leak (ends trimmed, as a copy may begin or end a document).
SHORT_MASKS = {**{n: ("1" * n,) for n in range(1, 8)}, 8: ("1111111", "11101111"), **dict.fromkeys((9, 10), ("11111111", "111011111", "111101111")), 11: ("1" * 11,)}
MIN_ITEM = 8
#: Diagonals that are compared in one go.
SLICE = 1 << 19
MIN_MATCH = 13
ITEM_SHARE = 0.8
MISMATCH = 3
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
NOT_TOKEN = NOT_LETTER.copy()
NOT_TOKEN[48:58] = False


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Seed of every position that has the mask's span of tokens behind it."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        acc = np.full(n, len(mask) * 64 + mask.count("1"), dtype=U64)
        for j, on in enumerate(mask):
            if on == "1":
                acc *= U64(0xD6E8FEB86659FD93)
                acc += hashes[j : j + n]
    return mix(acc)


def progressions(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry, step and number of runs of equally distant places; entries are sorted by group (equal numbers) and place."""
    n = len(place)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = np.ones(n, bool)
    other[1:] = group[1:] != group[:-1]
    step = np.diff(place, prepend=place[0])
    new = other.copy()
    new[2:] |= (step[2:] != step[1:-1]) & ~other[1:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    return first, np.where(size > 1, step[np.minimum(first + 1, n - 1)], 1), size


class SeedIndex:
    """Seeds of a block of benchmark items with where they stand, and the items' tokens."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, dtype=np.int64)
        buf, offsets = flat(pa.array(texts, pa.large_string()))
        w = Words(buf, offsets, lower=True, space=NOT_TOKEN)
        self.hash, self.first = w.hash, w.first
        self.sizes = w.counts
        short = sorted({int(n) for n in self.sizes} & set(SHORT_MASKS))
        self.masks = [*MASKS, *dict.fromkeys(m for n in short for m in SHORT_MASKS[n])]
        keys, items, places = [], [], []
        item_of = np.repeat(np.arange(len(ids)), self.sizes)
        for m in self.masks:
            s = seeds(self.hash, m)
            if not len(s):
                continue
            at = np.flatnonzero(item_of[: len(s)] == item_of[len(m) - 1 :])
            size = self.sizes[item_of[at]]
            at = at[(size >= MIN_ITEM) if m in MASKS else np.isin(size, [n for n in short if m in SHORT_MASKS[n]])]
            keys.append(s[at])
            items.append(item_of[at])
            places.append(at - self.first[item_of[at]])
        key, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, items, places))
        order = np.lexsort((place, item, key))
        key, item, place = key[order].astype(U64), item[order], place[order]
        # Equally distant places of a seed in an item are one entry.
        other = np.ones(len(key), bool)
        other[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        first, self.step, self.run = progressions(np.cumsum(other), place)
        self.key, self.item, self.place = key[first], item[first], place[first]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.key >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def probe(self, found: np.ndarray, row: np.ndarray, span: int) -> Iterator[np.ndarray]:
        """Columns (row, item, first diagonal, step, number of diagonals) of the runs of equal seeds that meet an entry, some ``SLICE`` at a time.

        ``row`` tells the row of every token, ``span`` how many tokens a seed needs.
        """
        inside = row[: len(found)] == row[span - 1 :][: len(found)]
        at = np.flatnonzero(inside & self.maybe[(found >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        at = at[np.lexsort((at, found[at], row[at]))]
        other = np.ones(len(at), bool)
        other[1:] = (found[at[1:]] != found[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
        first, step, size = progressions(np.cumsum(other), at)
        at = at[first]
        low = np.searchsorted(self.key, found[at], "left")
        n = np.searchsorted(self.key, found[at], "right") - low
        at, low, n, step, size = (x[n > 0] for x in (at, low, n, step, size))
        done = 0
        while done < len(n):
            past = done + max(1, int(np.searchsorted(np.cumsum(n[done:]), SLICE, "right")))
            for start in range(0, int(n[done]) if past == done + 1 else 1, SLICE):  # one run alone may meet very many entries
                some = slice(done, past)
                count = np.minimum(n[some] - start, SLICE) if past == done + 1 else n[some]
                ends = np.cumsum(count)
                entry = np.arange(int(ends[-1])) + np.repeat(low[some] + start - (ends - count), count)
                yield self._meet(row, np.repeat(at[some], count), np.repeat(step[some], count), np.repeat(size[some], count), entry)
            done = past

    def _meet(self, row: np.ndarray, at: np.ndarray, step: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The diagonals of runs and entries; where both have steps and these differ, the shorter one is taken place by place."""
        odd = (size > 1) & (self.run[entry] > 1) & (step != self.step[entry])
        place, run, own = self.place[entry].copy(), self.run[entry].copy(), self.step[entry].copy()
        if odd.any():
            few = np.where(odd, np.minimum(size, run), 1)
            ends = np.cumsum(few)
            k = np.arange(int(ends[-1])) - np.repeat(ends - few, few)
            odd, entry, at, step, size, place, run, own = (np.repeat(x, few) for x in (odd, entry, at, step, size, place, run, own))
            ours = odd & (size <= run)
            theirs = odd & ~ours
            at, size = np.where(ours, at + k * step, at), np.where(ours, 1, size)
            place, run = np.where(theirs, place + k * own, place), np.where(theirs, 1, run)
        both = np.where(size > 1, step, own)
        return np.stack([row[at], self.item[entry], at - place - (run - 1) * own, both, size + run - 1])


def _slices(ranges: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct (row, item, diagonal) of the ranges, some ``SLICE`` before repeats go at a time; a long range is cut."""
    row, item, begin, step, n = ranges
    while len(n):
        past = int(np.searchsorted(np.cumsum(n), SLICE, "right"))
        take, last = (past, None) if past else (1, SLICE)
        size = n[:take] if last is None else np.array([last])
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        diagonal = np.repeat(begin[:take], size) + place * np.repeat(step[:take], size)
        yield np.unique(np.stack([np.repeat(row[:take], size), np.repeat(item[:take], size), diagonal]), axis=1) if len(diagonal) < 4096 else _distinct(np.repeat(row[:take], size), np.repeat(item[:take], size), diagonal)
        if last is None:
            row, item, begin, step, n = row[take:], item[take:], begin[take:], step[take:], n[take:]
        else:
            begin, n = begin.copy(), n.copy()
            begin[0] += last * step[0]
            n[0] -= last


def _distinct(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    low, items = int(diagonal.min()), int(item.max()) + 1
    width = int(diagonal.max()) - low + 1
    key = np.unique((row * items + item) * width + (diagonal - low))
    return np.stack([key // width // items, key // width % items, key % width + low])


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Ranges of several masks together, at most ``SLICE`` and one part at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += p.shape[1]
        if n >= SLICE:
            yield np.concatenate(held, axis=1)
            held, n = [], 0
    if n:
        yield np.concatenate(held, axis=1)


def leaks_of(index: SeedIndex, buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Leaks of a run of documents: row, item, matched tokens, length and place of the stretch."""
    w = Words(buf, offsets, lower=True, space=NOT_TOKEN)
    row_of = np.repeat(np.arange(len(offsets) - 1), w.counts)
    names = ("row", "item", "matched", "span", "doc_word", "item_word")
    best = np.zeros((6, 0), np.int64)
    parts = (part for m in index.masks if len(s := seeds(w.hash, m)) for part in index.probe(s, row_of, len(m)))
    for ranges in _gathered(parts):
        # Sorted, so that the diagonals of one row and item mostly fall into one slice and repeats go before they are compared.
        for hits in _slices(ranges[:, np.lexsort((ranges[2], ranges[1], ranges[0]))]):
            best = _best(index, np.concatenate([best, *_stretches(index, w, hits)], axis=1))
    return dict(zip(names, best, strict=True))


def _stretches(index: SeedIndex, w: Words, hits: np.ndarray) -> Iterator[np.ndarray]:
    """The best stretch of every hit that is a leak; comparisons of about equal item length share a matrix."""
    size = index.sizes[hits[1]]
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i + max(1, min(len(order) - i, (1 << 20) // max(1, int(size[order[min(len(order) - 1, i + 4096)]]))))
        found = _compare(index, w, hits[:, order[i:j]])
        need = np.minimum(MIN_MATCH, np.ceil(ITEM_SHARE * index.sizes[found[1]]))
        yield found[:, found[2] >= need]
        i = j


def _best(index: SeedIndex, found: np.ndarray) -> np.ndarray:
    """Of several stretches of a row and an item the longest, then the first."""
    row, item, matched, _, doc_word, item_word = found
    found = found[:, np.lexsort((item_word, doc_word, -matched, index.ids[item], row))]
    first = np.ones(found.shape[1], bool)
    first[1:] = (found[0, 1:] != found[0, :-1]) | (index.ids[found[1, 1:]] != index.ids[found[1, :-1]])
    return found[:, first]


def _compare(index: SeedIndex, w: Words, hits: np.ndarray) -> np.ndarray:
    row, item, diagonal = hits
    size = index.sizes[item]
    wide = np.arange(int(size.max()))
    place = diagonal[:, None] + wide
    inside = (wide < size[:, None]) & (place >= w.first[row][:, None]) & (place < w.first[row + 1][:, None])
    ours = index.hash[np.minimum(index.first[item][:, None] + wide, len(index.hash) - 1)]
    theirs = w.hash[np.clip(place, 0, len(w.hash) - 1)]
    same = inside & (ours == theirs)
    gain = np.where(same, 1, np.where(inside, -MISMATCH, -(1 << 20)))
    total = np.concatenate([np.zeros((len(row), 1), np.int64), np.cumsum(gain, axis=1)], axis=1)
    lowest = np.minimum.accumulate(total, axis=1)
    end = (total - lowest).argmax(axis=1)
    floor = lowest[np.arange(len(row)), end]
    begin = (total == floor[:, None]).argmax(axis=1)
    hit = np.concatenate([np.zeros((len(row), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    at = np.arange(len(row))
    return np.stack([row, item, hit[at, end] - hit[at, begin], end - begin, diagonal + begin - w.first[row], begin])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Yields a seed index for every block of the benchmark."""
    items = only(benchmark, "item_id", "text").dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // block_bytes)
    for b in range(n):
        rows = sorted(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect())
        if rows:
            yield SeedIndex([r.item_id for r in rows], [r.text for r in rows])


SCHEMA = "item_id long, matched_tokens int, span_tokens int, coverage double, doc_word int, item_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and benchmark item that it leaks.

    ``matched_tokens`` of a stretch of ``span_tokens`` match; ``coverage`` is the share of
    the item's tokens; ``doc_word`` and ``item_word`` are where the stretch begins.
    """
    spark, texts = docs.sparkSession, only(docs, "doc_id", "text")
    kind = dict(texts.dtypes)["doc_id"]
    out = spark.createDataFrame([], f"doc_id {kind}, {SCHEMA}")
    for index in benchmark_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            known = shared.value
            for b in batches:
                buf, offsets = flat(b.column("text"))
                for i, j in blocks(offsets):
                    x = leaks_of(known, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if len(x["row"]):
                        cols = [b.column("doc_id").take(pa.array(x["row"] + i)), pa.array(known.ids[x["item"]]), *[pa.array(x[c].astype(np.int32)) for c in ("matched", "span")],
                                pa.array(x["matched"] / known.sizes[x["item"]]), *[pa.array(x[c].astype(np.int32)) for c in ("doc_word", "item_word")]]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "matched_tokens", "span_tokens", "coverage", "doc_word", "item_word"])

        out = out.unionByName(texts.mapInArrow(tidied(run), f"doc_id {kind}, {SCHEMA}"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_item: int = MIN_ITEM) -> DataFrame:
    """The documents that leak no benchmark item of ``min_item`` tokens or more, all their columns (a leaking row with a null id takes all such rows along).

    A shorter item standing whole in a document is reported by ``find_leaks``, but says
    too little to remove the document.
    """
    leaks = find_leaks(docs, benchmark).filter(F.round(F.col("matched_tokens") / F.col("coverage")) >= min_item)
    found = Scratch(docs.sparkSession, "leaks").settle(leaks.select("doc_id").distinct(), "found")
    leaking = few_or_many(found.withColumnRenamed("doc_id", "_leaking"))
    return docs.join(leaking, F.col("doc_id").eqNullSafe(F.col("_leaking")), "left_anti").select(docs.columns)
