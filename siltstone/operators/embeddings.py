"""Vectors learned from the corpus: a truncated singular value decomposition of its weighted term counts.

Every chunk is a sparse row of ``CELLS`` cells (hashed terms), weighted by the logarithm of
the count and the inverse frequency of the cell, with norm 1.  The right singular vectors of
the largest singular values are found by randomised subspace iteration: a pass over the
chunks multiplies a batch A of rows to its share of A'(AQ), the shares of all tasks are added
up in a tree, and the sum is made orthogonal again.  A text's vector is its row times the
singular vectors, each divided by its singular value, so that frequent topics do not drown
the rest; shorter vectors are the beginnings of longer ones.

Bounds: what is sent to all tasks and comes back to the driver is a matrix of ``CELLS`` rows
and the greatest size plus ``OVERSAMPLED`` columns of 4 bytes (36 MB), whatever the corpus.
A task adds one such matrix; ``FAN`` of them meet in a task of the tree.

Defined results: a null or empty text has the vector 0, which is similar to nothing; terms
that the corpus lacks weigh as much as the rarest; ranks beyond that of the corpus give
shorter vectors; an empty corpus gives vectors of length 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settled
from .chunk_search import TILE, Held
from .retrieval import query_blocks

CELLS = 1 << 15
SIZES = (64, 128, 256)
OVERSAMPLED = 16
PASSES = 3
#: Shares of a sum that meet in one task of the tree, and rows of a share that travel together.
FAN = 64
ROWS = 512
#: Products of a cell and a weight taken at once.
STEP = 1 << 14
#: Chunks whose products are added up together, and rows of a cell that are worth a product of their own.
GATHERED, OFTEN = 1 << 15, 6
#: What is put before a question (never before a passage), by vector size.
QUESTION_PREFIX = {64: "", 128: "", 256: ""}


def cells_of(tokens: Column, cells: int = CELLS) -> Column:
    """Cells of a text's terms, as often as they occur."""
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(cells)).cast("int"))


def sparse(lists: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, cell, weight) of lists of cells, rows ascending, each row of norm 1; and the number of rows."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(idf) + lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    row, cell = key // len(idf), key % len(idf)
    weight = (1 + np.log(count)) * idf[cell]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(sizes)))
    return row, cell, weight / norm[row], len(sizes)


def rows_times(row: np.ndarray, cell: np.ndarray, weight: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """The product of sparse rows and a matrix: a small product for each row."""
    out, weight = np.zeros((n, matrix.shape[1]), np.float32), weight.astype(np.float32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    for r, a, z in zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
        for low in range(a, z, STEP):  # a row of very many cells goes in parts
            high = min(low + STEP, z)
            out[r] += weight[low:high] @ matrix[cell[low:high]]
    return out


def add_back(row: np.ndarray, cell: np.ndarray, weight: np.ndarray, product: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed sparse rows times their product to ``total``: cells of ``OFTEN`` rows one by one, all others together."""
    order = np.argsort(cell, kind="stable")
    row, cell, weight = row[order], cell[order], weight[order].astype(np.float32)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    size = np.diff(np.append(first, len(cell)))
    often = size >= OFTEN
    for c, a, n in zip(cell[first[often]].tolist(), first[often].tolist(), size[often].tolist(), strict=True):
        for low in range(a, a + n, STEP):
            high = min(low + STEP, a + n)
            total[c] += weight[low:high] @ product[row[low:high]]
    rest = np.flatnonzero(~np.repeat(often, size))
    for a in range(0, len(rest), STEP):
        some = rest[a : a + STEP]
        begin = np.flatnonzero(np.diff(cell[some], prepend=-1))
        total[cell[some][begin]] += np.add.reduceat(product[row[some]] * weight[some, None], begin, axis=0)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass
class Model:
    """Inverse frequencies of the cells, and for each cell its part of a vector."""

    idf: np.ndarray
    parts: np.ndarray
    values: np.ndarray

    def vectors(self, lists: pa.ListArray, size: int) -> np.ndarray:
        """Unit vectors (0 for texts without terms) of lists of cells."""
        row, cell, weight, n = sparse(lists, self.idf)
        v = rows_times(row, cell, weight, n, self.parts[:, :size])
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def inverse_frequencies(listed: DataFrame, cells: int) -> np.ndarray:
    """Of every cell, by the number of rows that hold it; a row for each cell reaches the driver."""
    n = listed.count()
    counts = {r.cell: r.n for r in listed.select(F.explode(F.array_distinct("cells")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    df = np.array([counts.get(c, 1) for c in range(cells)], np.float64)
    return np.log1p(n / df) if n else np.ones(cells)


def _summed(shares: DataFrame, columns: int) -> DataFrame:
    """Adds up the parts of each (task, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["task", "block", "part"])

        for b in batches:
            for task, block, part in zip(b.column("task").to_pylist(), b.column("block").to_pylist(), b.column("part"), strict=True):
                values = np.frombuffer(part.as_buffer(), np.float32).reshape(-1, columns)
                if key == (task, block):
                    total += values
                    continue
                if key is not None:
                    yield row()
                key, total = (task, block), values.astype(np.float64)
        if key is not None:
            yield row()

    return shares.repartition("task", "block").sortWithinPartitions("task", "block").mapInArrow(run, SHARES)


SHARES = "task long, block int, part binary"
#: Whether shuffled files go when a job has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled within the block is deleted after its job: passes do not pile up on disk."""
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)


def gram_product(listed: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(AQ) of the weighted rows A of all chunks: one pass, shares of tasks added up in a tree."""
    spark, (cells, columns) = listed.sparkSession, q.shape
    shared = spark.sparkContext.broadcast((idf, np.ascontiguousarray(q, np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        total, some = np.zeros((cells, columns), np.float32), False
        for b in gathered(batches, GATHERED):
            row, cell, weight, n = sparse(b.column("cells").combine_chunks(), idf)
            if len(row):
                some = True
                add_back(row, cell, weight, rows_times(row, cell, weight, n, q), total)
        if some:
            task = TaskContext.get().partitionId()
            for i in range(0, cells, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([i // ROWS], pa.int32()), pa.array([total[i : i + ROWS].tobytes()], pa.binary())], ["task", "block", "part"])

    out = np.zeros((cells, columns))
    with cleaned(spark):
        # No more shares than cores: each is a matrix.
        listed = listed.coalesce(spark.sparkContext.defaultParallelism)
        shares, tasks = listed.mapInArrow(run, SHARES), listed.rdd.getNumPartitions()
        while tasks > 1:
            tasks = -(-tasks // FAN)
            shares = _summed(shares.withColumn("task", F.col("task") % tasks), columns)
        for r in shares.select("block", "part").collect():  # cells / ROWS rows: one matrix, in one job
            out[r.block * ROWS : (r.block + 1) * ROWS] = np.frombuffer(r.part, np.float32).reshape(-1, columns)
    shared.destroy()
    return out


def orthogonal(a: np.ndarray, rows: int = 1 << 12) -> np.ndarray:
    """The orthogonal factor of a tall matrix, in its place: blocks of rows first, then what they leave."""
    blocks = [slice(i, i + rows) for i in range(0, len(a), rows)]
    parts, left = [], []
    for block in blocks:
        q, r = np.linalg.qr(a[block])
        left.append(r)
        if q.shape[1] == a.shape[1]:
            a[block] = q
            parts.append(None)
        else:  # fewer rows than columns
            parts.append(q)
    turn, at = np.linalg.qr(np.concatenate(left))[0], 0
    for block, q, r in zip(blocks, parts, left, strict=True):
        a[block] = (a[block] if q is None else q) @ turn[at : at + len(r)]
        at += len(r)
    return a


def learn(texts: DataFrame, tokens: Column, size: int = max(SIZES), cells: int = CELLS, passes: int = PASSES, seed: int = 1) -> Model:
    """The vectors of all texts' cells, the greatest singular values first.

    The cells are written once, to the folder that executors share, and dropped after the last pass.
    """
    with settled(texts.select(cells_of(tokens, cells).alias("cells")), "cells") as listed:
        return learn_cells(listed, size, cells, passes, seed)


def learn_cells(listed: DataFrame, size: int = max(SIZES), cells: int = CELLS, passes: int = PASSES, seed: int = 1) -> Model:
    """``learn`` from written lists of cells."""
    idf = inverse_frequencies(listed, cells)
    columns = min(size + OVERSAMPLED, cells)
    q = orthogonal(np.random.default_rng(seed).standard_normal((cells, columns)))
    for _ in range(passes):
        product = gram_product(listed, idf, q)
        del q  # the driver holds no more matrices than it must
        q = orthogonal(product)
        del product
    values, turned = np.linalg.eigh(q.T @ gram_product(listed, idf, q))
    best = np.argsort(-values)[:size]
    best = best[values[best] > 1e-9 * max(values.max(initial=0), 1e-300)]
    spectrum = np.sqrt(values[best])
    return Model(idf, np.ascontiguousarray((q @ turned[:, best]) / spectrum, np.float32), spectrum)


def with_prefix(question: Column, prefix: str) -> Column:
    """The text of a question as it is embedded."""
    return F.concat(F.lit(prefix), question) if prefix else question


def search(model: Model, chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k: int, size: int) -> DataFrame:
    """(query_id, chunk_id, score) of at least the k best chunks of every question by cosine of learned vectors; only positive ones count."""
    listed = chunks.select("chunk_id", cells_of(tokens, len(model.idf)).alias("cells"))
    return search_sizes(model, listed, queries, {size: query_tokens}, k).drop("size")


def search_sizes(model: Model, listed: DataFrame, queries: DataFrame, query_tokens: dict[int, Column], k: int) -> DataFrame:
    """(size, query_id, chunk_id, score): ``search`` of lists of cells (chunk_id, cells) by vectors of several sizes in one pass.

    A chunk's row times the longest vectors gives the shorter ones too; a task keeps the k best of all it reads.
    """
    cells, top = len(model.idf), max(query_tokens)
    spark, out = listed.sparkSession, None
    learned = spark.sparkContext.broadcast((model.idf, np.ascontiguousarray(model.parts[:, :top])))
    for block in query_blocks(queries):
        rows = sorted((r.query_id, r.lists) for r in block.select("query_id", F.array(*[cells_of(t, cells) for t in query_tokens.values()]).alias("lists")).collect())
        asked = {size: model.vectors(pa.array([r[1][i] for r in rows], pa.list_(pa.int32())), size) for i, size in enumerate(query_tokens)}
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (idf, parts), (ids, asked) = learned.value, shared.value
            held = {size: Held(len(ids), k) for size in asked}
            for b in batches if len(ids) else ():
                if not b.num_rows:
                    continue
                row, cell, weight, n = sparse(b.column("cells"), idf)
                v, names = rows_times(row, cell, weight, n, parts), b.column("chunk_id").to_numpy(zero_copy_only=False)
                for a in range(0, n, TILE):
                    some = v[a : a + TILE]
                    for size, q in asked.items():
                        short = some[:, :size]
                        unit = short / np.maximum(np.linalg.norm(short, axis=1, keepdims=True), 1e-12)
                        score = unit.astype(np.float64) @ q.T  # exact as it is: cosines can be negative, so that a rough one may lose its sign
                        held[size].tile(score, 0, lambda r, c, score=score: score[r, c], names[a : a + TILE], None)
            for size, best in held.items():
                question, item, score = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(question), size, np.int32)), pa.array(ids[question]), pa.array(item), pa.array(score)], ["size", "query_id", "chunk_id", "score"])

        found = listed.select(F.col("chunk_id").cast("long").alias("chunk_id"), "cells").mapInArrow(run, "size int, query_id long, chunk_id long, score double").withColumn("score", F.round("score", 6))
        out = found if out is None else out.unionByName(found)
    return out
