"""Centroid clustering in exact integers, with distances screened by block norms.

Components are floor(256 * x).  What is stored of a vector, once, beside its integers: a code
of one byte a component (the component shifted right by a number of bits that all vectors
share), its squared norm, and for each block of eight components the norm of what the code
leaves out, rounded up.  By Cauchy-Schwarz, block by block,

    <x, c> <= <code, c> + sum over blocks |x - code| |c|,

so that |x|^2 + |c|^2 - 2 times the right side bounds the squared distance from below.  A
batch of codes meets all centroids in one matrix product; the centroid with the least bound
gets its exact distance, and then only those whose bound does not exceed it.  Bounds are
floats with slack for rounding, distances are 64-bit integers.

A round is one pass over the stored vectors: every task adds up its vectors by cluster, and
only sums and counts of the centroids (at most ``CENTROIDS`` times components a task) are
shuffled; the driver gets ``CENTROIDS`` centroids.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component are left out; a repeated row is a vector of its own, as is a row whose id is
repeated or null (a null id is written as nothing where ids are hashed; equal hashes are
ordered by components); fewer vectors than centroids make fewer centroids; an empty centroid
stays where it is; no vectors give no rows; a component beyond 2^27 after scaling stops the
job, as distances would no longer fit a long; columns beside id and vector are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, tidied

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
BLOCK = 8
#: Components reach this far at most; 64 squared differences then fit a long.
REACH = 1 << 27
#: Pairs of a vector and a centroid that get an exact distance at once.
PAIRS = 1 << 15


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and v (array of long, floor(256 * x)) of the vectors that are whole."""
    x = F.col("embedding")
    whole = (F.size(x) == components) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * 256.0))
    bounded = F.transform(scaled, lambda e: F.when(F.abs(e) <= REACH, e).otherwise(F.raise_error(F.lit(f"a component is beyond {REACH} after scaling"))))
    return only(vectors, "vec_id", "embedding").filter(F.coalesce(whole, F.lit(False))).select("vec_id", bounded.alias("v"))


def _integers(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def block_norms(x: np.ndarray) -> np.ndarray:
    """Norm of each block of components, rounded up to a float32."""
    norms = np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], BLOCK), axis=1))
    return np.nextafter(norms.astype(np.float32), np.float32(np.inf))


def compress(x: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of one byte, squared norms, and block norms of what the codes leave out."""
    codes = (x >> shift).astype(np.int8)
    return codes, (x * x).sum(1), block_norms(x - expand(codes, shift))


def expand(codes: np.ndarray, shift: int) -> np.ndarray:
    """The middle of the values that a code stands for."""
    return (codes.astype(np.int64) << shift) + ((1 << shift) >> 1)


def nearest(x: np.ndarray, codes: np.ndarray, squares: np.ndarray, left: np.ndarray, shift: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid (ties: the smaller number), and how many exact distances were taken."""
    own = (centroids * centroids).sum(1)
    reach = expand(codes, shift).astype(np.float64) @ centroids.T.astype(np.float64) + left.astype(np.float64) @ block_norms(centroids).T.astype(np.float64)
    total = squares[:, None].astype(np.float64) + own[None, :]
    below = total - 2 * reach - (1e-12 * total + 1)
    rows = np.arange(len(x))
    first = below.argmin(1)
    best = exact(x, rows, centroids, first)
    cluster = first.copy()
    row, other = np.nonzero(below <= best[:, None])
    new = other != first[row]
    row, other = row[new], other[new]
    if len(row):
        distance = exact(x, row, centroids, other)
        order = np.lexsort((other, distance, row))
        row, other, distance = row[order], other[order], distance[order]
        lead = np.flatnonzero(np.diff(row, prepend=-1))
        row, other, distance = row[lead], other[lead], distance[lead]
        closer = (distance < best[row]) | ((distance == best[row]) & (other < cluster[row]))
        cluster[row[closer]], best[row[closer]] = other[closer], distance[closer]
    return cluster, best, len(x) + int(new.sum())


def exact(x: np.ndarray, rows: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), PAIRS):
        gap = x[rows[i : i + PAIRS]] - centroids[which[i : i + PAIRS]]
        out[i : i + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


def first_centroids(vectors: DataFrame, centroids: int) -> np.ndarray:
    """The vectors with the least hashes of their ids: ``centroids`` rows at most."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select("v", key.alias("h")).orderBy("h", "v").limit(centroids).collect()], dtype=np.int64)


def _read(b: pa.RecordBatch, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.int8).reshape(-1, components)
    left = np.frombuffer(b"".join(b.column("left").to_pylist()), np.float32).reshape(len(codes), -1)
    return _integers(b.column("v"), components), codes, b.column("square").to_numpy(), left


def _stored(vectors: DataFrame, shift: int, components: int) -> DataFrame:
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes, squares, left = compress(_integers(b.column("v"), components), shift)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(squares), pa.array([n.tobytes() for n in left], pa.binary())], ["vec_id", "v", "codes", "square", "left"])

    return vectors.mapInArrow(tidied(run), f"vec_id {kind}, v array<long>, codes binary, square long, left binary")


def _sums(stored: DataFrame, shift: int, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sum of every centroid's vectors."""
    k, components = centroids.shape
    shared = stored.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        total, count = np.zeros((k, components), object), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                x, codes, squares, left = _read(b, components)
                cluster, _, _ = nearest(x, codes, squares, left, shift, shared.value)
                order = np.argsort(cluster, kind="stable")
                names, start = np.unique(cluster[order], return_index=True)
                total[names] += np.add.reduceat(x[order], start, axis=0)
                count += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(count)
        if len(held):
            # A task's sums fit a long unless it reads some 2^36 vectors of the greatest reach, which then is an error.
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = stored.select("v", "codes", "square", "left").mapInArrow(tidied(run), "cluster long, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():  # centroids times components rows at most
        out.setdefault(r.cluster, (r.n, [0] * components))[1][r["at"]] = int(r.s)
    shared.destroy()
    return out


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kmeans")
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    whole = whole_vectors(vectors, components)
    c = first_centroids(whole, centroids)
    if not len(c):
        return spark.createDataFrame([], schema)
    farthest = whole.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    shift = max(0, int(farthest).bit_length() - 7)
    stored = scratch.settle(_stored(whole, shift, components), "vectors")
    for _ in range(rounds):
        for cluster, (n, total) in _sums(stored, shift, c).items():
            c[cluster] = [s // n for s in total]
    shared = spark.sparkContext.broadcast(c)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                cluster, distance, _ = nearest(*_read(b, components), shift, shared.value)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = scratch.settle(stored.mapInArrow(tidied(assign), f"vec_id {kind}, cluster int, distance long"), "assigned")
    scratch.drop(stored)
    within = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = {k: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for k, row in enumerate(c.tolist())}
    facts = spark.createDataFrame([(k, s, sum(within.values()), digests[k]) for k, s in within.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
