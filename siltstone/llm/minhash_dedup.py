"""Near duplicates by MinHash: banded candidates, odd sketches, exact confirmation, components.

1. Every text becomes its set of word shingles (64-bit hashes).  ``SAMPLES`` MinHash
   values are taken of it; ``BANDS`` bands of them give bucket keys, and all of them are
   folded into an odd sketch, a bitmap whose bits are the parities of the hashed samples.
2. Texts with equal sets are one node (the smallest id) from here on.
3. Rounds of stars: the leader of a bucket is the node that meets most others over all
   its buckets (the text that copies were made from meets more than the copies do).
   Nodes are compared with the leaders of their buckets; the links confirmed on the full
   sets give components, and buckets that still hold several are led anew from among the
   nodes outside the largest.  A bucket of n copies costs n comparisons a round.
4. Last round: the pairs of one bucket that are still in different components and whose
   sizes fall in the same or neighbouring classes (of ratio ``percent``, so no pair is
   lost); sizes are keys of the join, and Spark splits what is still skewed.  Those whose sizes, odd sketches and set parities allow the wanted similarity are
   confirmed on the full sets too.  The population count of two sets' XORed parities is
   never more than the sets' difference, so that bound loses nothing; links between
   components are lost only by the bands (a pair at the threshold 0.85 shares no bucket
   with probability (1 - 0.85**4)**32, about 1e-10) and by the odd sketch of the samples
   (some 4.5 standard deviations).

Defined results: a text without words (null, empty, blank) has no shingles, is linked
with nothing and is its own component; with fewer words than a shingle has, the whole
sequence is the one shingle; equal ids are one node; a null id is not linked and has a
null component; repeated rows are all returned; columns of the input beside id and text,
whatever their names, are ignored (and kept by ``without_copies``); an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, few_or_many, only, tidied
from .graph import connected_components
from .textops import U64, Words, blocks, flat, grams, mix

SHINGLE = 5
SAMPLES, BANDS = 128, 32
SKETCH_BITS = 512
#: Most differing sketch bits of a pair that may reach 0.85 (mean 36 there, deviation about 7).
SKETCH_SLACK = 70
#: Bits of the parities of the whole set.
PARITY_BITS = 1024
#: Rounds of stars before the remaining pairs.
STARS = 2
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Yields the sorted distinct shingle hashes of every row."""
    buf, offsets = flat(column)
    for i, j in blocks(offsets):
        w = Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        g = grams(w.hash, k)
        first = w.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                yield grams(w.hash[a:b], b - a)
            else:
                yield w.hash[:0]


def signature(values: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima of the set under as many hash functions."""
    h = (values >> U64(32)).astype(np.uint32)
    best = None
    for i in range(0, len(h), 2048):
        low = (_A[:, None] * h[None, i : i + 2048] + _B[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, ``SKETCH_BITS`` bits as int64 words, of rows of MinHash samples."""
    n = len(samples)
    spot = mix(samples.astype(U64) * U64(SAMPLES) + np.arange(SAMPLES, dtype=U64)) % U64(SKETCH_BITS)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + spot.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def estimate(differing: int) -> float:
    """Similarity that so many differing sketch bits stand for."""
    inside = 1 - 2 * differing / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(inside)) if inside > 0 else 0.0


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = SAMPLES // BANDS
    part = samples.reshape(len(samples), BANDS, rows).astype(U64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(BANDS, dtype=U64), part.shape[:2]).copy()
        for r in range(rows):
            acc = mix(acc * U64(0x9E3779B97F4A7C15) + part[:, :, r])
    return acc.view(np.int64)


WORDS, PARITIES = SKETCH_BITS // 64, PARITY_BITS // 64
BITS = [f"s{i}" for i in range(WORDS)] + [f"p{i}" for i in range(PARITIES)]
SKETCHED = "doc_id long, n long, f1 long, f2 long, bands array<long>, " + ", ".join(f"{b} long" for b in BITS)


def parity(values: np.ndarray) -> np.ndarray:
    """How many elements of a set fall on each bit, modulo 2, as bytes."""
    return np.packbits((np.bincount(((values >> U64(11)) % U64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8))


def sketch_table(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint, band keys and odd sketch of every row."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, f1, f2, samples = [], [], [], np.zeros((b.num_rows, SAMPLES), np.uint32)
        parities = np.zeros((b.num_rows, PARITY_BITS // 8), np.uint8)
        for k, s in enumerate(shingle_sets(b.column("text"))):
            sizes.append(len(s))
            f1.append(s.sum(dtype=U64) if len(s) else U64(0))
            f2.append(np.bitwise_xor.reduce(mix(s)) if len(s) else U64(0))
            if len(s):
                samples[k], parities[k] = signature(s), parity(s)
        keys, sketch = band_keys(samples), np.concatenate([odd_sketches(samples), parities.view(np.int64)], axis=1)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        cols = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(f1, U64).view(np.int64)), pa.array(np.array(f2, U64).view(np.int64)), bands]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(BITS))]], [c.split()[0] for c in SKETCHED.split(", ")])

    return arrow_map(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), one, SKETCHED)


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, values) with the full shingle set of every row."""

    def run(batches):
        for b in batches:
            ids, sets, held = [], [], 0
            for doc_id, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text")), strict=True):
                ids.append(doc_id)
                sets.append(s.view(np.int64))
                held += len(s)
                if held > 1 << 20:
                    yield _set_batch(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield _set_batch(ids, sets)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, values array<long>")


def _set_batch(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], ["doc_id", "values"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("values").alias("us"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("values").alias("vs"))
    shared = F.size(F.array_intersect("us", "vs")).cast("long")
    joined = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", F.size("us").alias("nu"), F.size("vs").alias("nv"), shared.alias("shared"))
    return joined.filter(F.col("shared") * 100 >= (F.col("nu") + F.col("nv") - F.col("shared")) * percent).select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    ``percent``: similarity from which two texts are linked (the bands are laid out for 80 and more).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    slack = SKETCH_SLACK if percent >= 85 else SKETCH_SLACK + 3 * (85 - percent)
    rows = scratch.settle(sketch_table(docs), "sketches")
    known = rows.filter("doc_id IS NOT NULL AND n > 0")
    key = ["f1", "f2", "n"]
    nodes = known.groupBy(*key).agg(F.min("doc_id").alias("node"))

    # Bucket rows of buckets that hold two nodes or more.
    held = known.join(nodes, key).filter("doc_id = node").dropDuplicates(["node"])
    spread = held.select("node", F.explode("bands").alias("bucket"))
    crowd = spread.groupBy("bucket").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    crowded = scratch.settle(spread.join(crowd, "bucket"), "buckets")
    degree = scratch.settle(crowded.groupBy("node").agg(F.sum("crowd").alias("degree")), "busy")

    # Sketches and full sets of all nodes that may be compared.
    ids = few_or_many(degree.select(F.col("node").alias("doc_id")))
    texts = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(ids, "doc_id", "left_semi")
    sets = scratch.settle(set_table(texts), "sets")
    facts = scratch.settle(held.select("node", "n", *BITS).join(degree, "node"), "facts")

    rows_left = crowded.select("bucket", "node").join(degree, "node").withColumn("root", F.col("node"))
    links = tried = None
    for _ in range(STARS):
        lead = rows_left.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("other"))).alias("top")).select("bucket", (-F.col("top.other")).alias("leader"))
        asked = rows_left.join(lead, "bucket").filter("node <> leader").select(F.greatest("node", "leader").alias("v"), F.least("node", "leader").alias("u")).distinct()
        if tried is not None:
            asked = asked.join(tried, ["u", "v"], "left_anti")
        asked = scratch.settle(_plausible(asked, facts, percent, slack), "asked")
        found = scratch.settle(confirmed(asked, sets, percent), "links")
        tried = asked if tried is None else tried.unionByName(asked)
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        roots = scratch.settle(connected_components(links, scratch), "roots")
        rows_left = scratch.settle(_mixed(crowded, roots, degree), "mixed")

    # What the stars left apart.
    main = rows_left.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("main"))
    size_class = F.floor(F.log("n") / (np.log(100 / percent) * 1.0001)).cast("int")
    placed = rows_left.join(facts.drop("degree"), "node").withColumn("sizes", size_class)
    x = placed.join(main, "bucket").filter("root <> main").withColumn("sizes", F.explode(F.array(*[F.col("sizes") + k for k in (-1, 0, 1)])))
    x, y = x.alias("x"), placed.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.sizes") == F.col("y.sizes")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("x.main")) | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, apart & _fits("x.", "y.", percent, slack)).select(F.greatest("x.node", "y.node").alias("v"), F.least("x.node", "y.node").alias("u")).distinct()
    last = scratch.settle(pairs.join(tried, ["u", "v"], "left_anti"), "last")
    more = scratch.settle(confirmed(last, sets, percent), "more")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), scratch)

    named = nodes.join(roots.select("node", "root"), "node", "left").select(*key, F.coalesce("root", "node").alias("root"))
    linked = rows.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(crowded: DataFrame, roots: DataFrame, degree: DataFrame) -> DataFrame:
    """Rows (bucket, node, degree, root) of the buckets whose nodes are of several components."""
    placed = crowded.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("bucket")
    return placed.join(mixed, "bucket").join(degree, "node").select("bucket", "node", "degree", "root")


def _fits(a: str, b: str, percent: int, slack: int) -> Column:
    """Whether sizes, odd sketches and set parities of two rows allow the similarity."""
    c = lambda side, name: F.col(f"{side}{name}")
    unlike = lambda names: sum((F.bit_count(c(a, n).bitwiseXOR(c(b, n))) for n in names), F.lit(0))
    sizes = F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent
    # 100 * shared >= percent * union leaves a difference of (100 - percent) / (100 + percent) of both sizes at most.
    most = (c(a, "n") + c(b, "n")) * (100 - percent)
    return sizes & (unlike(BITS[:WORDS]) <= slack) & (unlike(BITS[WORDS:]) * (100 + percent) <= most)


def _plausible(pairs: DataFrame, facts: DataFrame, percent: int, slack: int) -> DataFrame:
    a = facts.select(F.col("node").alias("u"), *[F.col(c).alias(f"a_{c}") for c in ["n", *BITS]])
    b = facts.select(F.col("node").alias("v"), *[F.col(c).alias(f"b_{c}") for c in ["n", *BITS]])
    return pairs.join(a, "u").join(b, "v").filter(_fits("a_", "b_", percent, slack)).select("u", "v")


def without_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each component (that with the smallest id), all columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "copies")
    gone = scratch.settle(near_duplicates(docs, percent).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(few_or_many(gone), "doc_id", "left_anti").select(docs.columns)
