"""Ranked retrieval as joins: lexical, dense, fused and re-ranked lists with fixed tie rules."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lexical import UNITS, Best, Questions, Search

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
#: Questions that meet all chunks in one pass; more of them are several passes.
QUERY_BLOCK = 2000
#: Pairs of a chunk and a question that are scored in one go.
PAIRS = 1 << 20


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> list[DataFrame]:
    """The questions in parts of some ``block`` each, dealt by a hash of their ids."""
    n = -(-queries.count() // block)
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def top_k(scored: DataFrame, k: int, item: str, by: Sequence[str] = ("query_id",), score: str = "score") -> DataFrame:
    """The k best of each query, best first, ties by the item; the rank filter becomes a limit within groups."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def term_weights(chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column) -> tuple[list[tuple[int, str, float]], float]:
    """(query_id, term, weight) of a block of questions' terms that some chunk holds, and the chunks' mean length."""
    found = weights_by_part(chunks.withColumn("_part", F.lit(0)), queries, tokens, query_tokens, "_part")
    return found.get(0, ([], 1.0))


def weights_by_part(chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, part: str) -> dict[int, tuple[list[tuple[int, str, float]], float]]:
    """For every part of the chunks (an integer column; a few parts), (query_id, term, weight) of the terms asked for, and the mean length.

    One pass over the chunks: distinct terms are counted with partial aggregates, and so
    is one more term of every chunk that tells its length.  What comes back is a row for
    each term asked for and each length, and for all other terms how many have a frequency.
    The inverse document frequency of terms that most chunks have would be negative; it
    is a quarter of the vocabulary's mean instead.  Repeated terms of a question count
    each time.
    """
    asked = {r.query_id: r.t for r in queries.select("query_id", query_tokens.alias("t")).collect()}
    # The lambda over an array of one binds the tokens, which are then made once.
    marked = F.element_at(F.transform(F.array(tokens), lambda t: F.array_append(F.array_distinct(t), F.concat(F.lit("#"), F.size(t).cast("string")))), 1)
    return weights_of(chunks.select(part, F.explode(marked).alias("term")).groupBy(part, "term").agg(F.count("*").alias("df")), asked, part)


def weights_of(counted: DataFrame, asked: dict[int, Sequence[str]], part: str) -> dict[int, tuple[list[tuple[int, str, float]], float]]:
    """``weights_by_part`` from (part, term, df), where the chunks of n tokens are those of a term ``#n``, and the questions' terms."""
    asked = {q: Counter(t or ()) for q, t in asked.items()}
    wanted = counted.sparkSession.createDataFrame([(t,) for t in sorted({"", *(t for c in asked.values() for t in c)})], "named string")
    known = counted.join(F.broadcast(wanted), F.col("term") == F.col("named"), "left").withColumn("named", F.when(F.col("term").startswith("#"), F.col("term")).otherwise(F.col("named")))
    found: dict[int, list] = {}
    for r in known.groupBy(part, "named", "df").agg(F.count("*").alias("terms")).collect():
        found.setdefault(r[part], []).append(r)
    out = {}
    for name, rows in found.items():
        sizes = [(int(r.named[1:]), r.df) for r in rows if r.named is not None and r.named.startswith("#")]
        n, total = sum(m for _, m in sizes), sum(size * m for size, m in sizes)
        rest = [r for r in rows if r.named is None or not r.named.startswith("#")]
        idf = lambda df, n=n: math.log(n - df + 0.5) - math.log(df + 0.5)
        mean = sum(r.terms * idf(r.df) for r in rest) / max(sum(r.terms for r in rest), 1)
        weight = {r.named: idf(r.df) if idf(r.df) >= 0 else EPSILON * mean for r in rest if r.named is not None}
        out[name] = [(q, term, times * weight[term]) for q, c in asked.items() for term, times in c.items() if term in weight], total / n
    return out


def saturation(tf, dl, avgdl):
    """What a term that stands tf times in dl words counts, for columns as for arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_pairs(part_of: DataFrame, chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term, for a part of the chunks with the weights of all."""
    out = None
    for block in query_blocks(queries):
        rows, avgdl = term_weights(chunks, block, tokens, query_tokens)
        weights = chunks.sparkSession.createDataFrame(rows, "query_id long, term string, weight double")
        found = _pairs(part_of, weights, avgdl, tokens)
        out = found if out is None else out.unionByName(found)
    return out


def _pairs(chunks: DataFrame, weights: DataFrame, avgdl: float, tokens: Column) -> DataFrame:
    t = chunks.select("chunk_id", tokens.alias("t")).select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    post = t.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    part = F.col("weight") * saturation(F.col("tf"), F.col("dl"), avgdl)
    return post.join(F.broadcast(weights), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25(chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of at least the k best chunks of every question that share a term with it."""
    return bm25_by_part(chunks.withColumn("_part", F.lit(0)), queries, tokens, query_tokens, k, "_part").drop("_part")


def bm25_by_part(chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k: int, part: str) -> DataFrame:
    """(part, query_id, chunk_id, score): ``bm25`` of the questions against each part of the chunks by itself, in one pass over all.

    The weights of a block of questions are sent to all tasks.  A task keeps the k best of
    the chunks it reads, scoring only what can still be among them; nothing but these is
    shuffled.  Chunk ids are numbers, parts a few integers: a question is one of its own in
    every part, and terms of different parts never meet.
    """
    spark, out = chunks.sparkSession, None
    listed = chunks.select(F.col(part).cast("int").alias("part"), "chunk_id", F.transform(tokens, lambda t: F.concat_ws("|", F.col(part).cast("string"), t)).alias("t"))
    for block in query_blocks(queries):
        found = weights_by_part(chunks, block, tokens, query_tokens, part)
        rows = [((q, p), f"{p}|{term}", weight) for p, (weights, _) in found.items() for q, term, weight in weights]
        shared = spark.sparkContext.broadcast((Questions(rows), {p: mean for p, (_, mean) in found.items()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            questions, means = shared.value
            if not questions.ids:
                return
            search = Search(questions, lambda tf, longer: saturation(tf, longer, 1.0), k)
            for b in batches:
                if b.num_rows:
                    mean = np.array([means.get(p, 1.0) for p in b.column("part").to_pylist()])
                    search.batch(b.column("chunk_id").to_numpy(zero_copy_only=False), b.column("t"), np.maximum(mean, 1e-300))
            question, item, score = search.best.rows()
            query, name = np.array(questions.ids, np.int64)[question].reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), pa.array(query), pa.array(item), pa.array(score)], ["part", "query_id", "chunk_id", "score"])

        best = listed.mapInArrow(run, "part int, query_id long, chunk_id long, score double").select(F.col("part").alias(part), "query_id", "chunk_id", F.round("score", 6).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


def best_pairs(values: np.ndarray, counts: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of every column among those that count, ties by id."""
    whole = np.where(counts, np.floor(values * 1e6 + 0.5), -np.inf)
    if len(whole) > k:  # what falls behind the k-th cannot be among the best
        bar = np.partition(whole, len(whole) - k, axis=0)[len(whole) - k]
        row, query = np.nonzero((whole >= bar) & counts)
    else:
        row, query = np.nonzero(counts)
    order = np.lexsort((ids[row], -whole[row, query], query))
    row, query = row[order], query[order]
    start = np.searchsorted(query, np.arange(values.shape[1]))
    best = np.arange(len(query)) - start[query] < k
    return row[best], query[best]


def with_zero_scores(best: DataFrame, chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """Adds the chunks without a shared term that a top k may need, with the score 0.

    They tie and are taken by id, so of each query only the first 2k ids can be among
    them: at most k - 1 of those are scored when fewer than k chunks are.
    """
    first = chunks.select("chunk_id", tokens.alias("_ct")).orderBy("chunk_id").limit(2 * k)
    pairs = queries.select("query_id", query_tokens.alias("_qt")).crossJoin(F.broadcast(first)).filter(~F.arrays_overlap("_qt", "_ct"))
    return best.unionByName(pairs.select("query_id", "chunk_id", F.lit(0.0).alias("score")))


def hashed_search(chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, bucket: Callable[[Column], Column], k: int, size: int = 64) -> DataFrame:
    """(query_id, chunk_id, score) of at least the k best chunks by inner products of unit vectors of hashed token counts."""
    return hashed_by_part(chunks.withColumn("_part", F.lit(0)), queries, tokens, query_tokens, bucket, k, (size,), "_part").drop("_part", "cells")


def hashed_by_part(chunks: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, bucket: Callable[[Column], Column], k: int, sizes: tuple[int, ...], part: str) -> DataFrame:
    """(part, cells, query_id, chunk_id, score): hashed vectors of several sizes (each a divisor of the greatest), each part of the chunks by itself, in one pass.

    The vectors stand in for an embedding model.  Cells are made by built-in functions;
    a batch of chunks becomes a matrix that the questions' vectors (a block of them, sent
    to all tasks) are multiplied with; a task gives the k best of all it has read.
    """
    top, out = max(sizes), None
    if any(top % n for n in sizes):
        raise ValueError("sizes must divide the greatest")
    cells_of = lambda t: F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda x: F.pmod(bucket(x), F.lit(top)).cast("int"))
    listed = chunks.select(F.col(part).cast("int").alias("part"), "chunk_id", cells_of(tokens).alias("cells"))

    def vectors(lists: pa.ListArray, size: int) -> np.ndarray:
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % size
        v = np.bincount(np.repeat(np.arange(len(count)), count) * size + cells, minlength=len(count) * size).reshape(len(count), size).astype(np.float64)
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)

    for block in query_blocks(queries):
        rows = sorted((r.query_id, list(r.cells)) for r in block.select("query_id", cells_of(query_tokens).alias("cells")).collect())
        lists = pa.array([r[1] for r in rows], pa.list_(pa.int32()))
        shared = chunks.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), {n: vectors(lists, n) for n in sizes}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, of = shared.value
            held: dict[tuple[int, int], Best] = {}
            step = max(1, PAIRS // max(len(asked), 1))
            for b in batches:
                parts, ids = b.column("part").to_numpy(), b.column("chunk_id").to_numpy(zero_copy_only=False)
                for name in np.unique(parts) if len(asked) else ():
                    place = np.flatnonzero(parts == name)
                    lists = b.column("cells").take(pa.array(place))
                    for n in sizes:
                        best = held.setdefault((name, n), Best(len(asked), k))
                        v = vectors(lists, n)
                        for a in range(0, len(v), step):
                            values, some = v[a : a + step] @ of[n].T, ids[place[a : a + step]]
                            row, query = best_pairs(values, (values > 0) & (values * UNITS + 1 >= best.bar), some, k)
                            best.offer(query, some[row], values[row, query])
            for (name, n), best in held.items():
                query, item, score = best.rows()
                fixed = [np.full(len(query), x, np.int32) for x in (name, n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(asked[query]), pa.array(item), pa.array(score)], ["part", "cells", "query_id", "chunk_id", "score"])

        found = listed.mapInArrow(run, "part int, cells int, query_id long, chunk_id long, score double").select(F.col("part").alias(part), "cells", "query_id", "chunk_id", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact inner products of a stated set of query vectors (query_id, q), in blocks, with all vectors (item_id, v)."""
    out = None
    for block in query_blocks(queries):
        found = vectors.crossJoin(F.broadcast(block)).select("query_id", "item_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


#: Query vectors sent to all tasks at once, and the rows and queries of a tile: by products of matrices, by sums.
VECTOR_BLOCK = 1 << 14
PRODUCT_TILE, SUM_TILE = (512, 2048), (16, 2048)
#: Components beyond this are not for products in single precision.
LARGE = 1e15


def summed(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all columns of q, components added one after the other in double precision."""
    out, part = np.zeros((len(v), q.shape[1])), np.empty((len(v), q.shape[1]))
    for column, values in zip(v.T, q, strict=True):
        np.multiply(column[:, None], values, out=part)
        out += part
    return out


def _plain(vector: Column, size: int) -> Column:
    """Whether a vector has so many components, all of them numbers of ordinary size."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < LARGE)), F.lit(False))


def _vector_search(vectors: DataFrame, queries: DataFrame, k: int, products: bool) -> DataFrame:
    """(query_id, item_id, score) of at least the k best of every query; all pairs are scored, a task keeps the k best of what it reads.

    With ``products`` a tile of pairs is a product of matrices in single precision; what may
    reach the k-th best by the bound of its error is summed again as ``summed`` does it.
    Vectors that have missing, unequally many or enormous components, and null ids, take
    ``dense``.
    """
    spark, out = vectors.sparkSession, None
    if {dict(vectors.dtypes)["item_id"], dict(queries.dtypes)["query_id"]} - {"tinyint", "smallint", "int", "bigint"}:
        return dense(queries, vectors)
    # A vector costs as much as there are queries: few splits are dealt out.
    if vectors.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        vectors = vectors.repartition(spark.sparkContext.defaultParallelism)
    first = queries.select(F.size("q").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    size = first.n if first else 0
    plain, able = _plain(F.col("v"), size) & F.col("item_id").isNotNull(), _plain(F.col("q"), size) & F.col("query_id").isNotNull()
    rows_at, queries_at = PRODUCT_TILE if products else SUM_TILE
    for block in query_blocks(queries.filter(able), VECTOR_BLOCK):
        rows = sorted((r.query_id, r.q) for r in block.select("query_id", "q").collect())
        asked = np.array([r[0] for r in rows], np.int64)
        shared = spark.sparkContext.broadcast((asked, np.ascontiguousarray(np.array([r[1] for r in rows], np.float64).reshape(len(rows), size).T)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, q = shared.value
            best = Best(len(asked), k)
            tiles = [slice(c, min(c + queries_at, len(asked))) for c in range(0, len(asked), queries_at)]
            coarse = [np.ascontiguousarray(q[:, t], np.float32) for t in tiles]
            fine = [np.ascontiguousarray(q[:, t]) for t in tiles]
            # A sum of n products in single precision is wrong by less than this share of both lengths.
            doubt = (size + 4) * 2.0**-23 * np.sqrt((q * q).sum(axis=0)) if products else np.zeros(len(asked))
            for b in batches:
                if not b.num_rows or not len(asked):
                    continue
                ids = b.column("item_id").to_numpy().astype(np.int64)
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, size)
                small, length = v.astype(np.float32), np.sqrt((v * v).sum(axis=1))
                for a in range(0, len(v), rows_at):
                    some = slice(a, min(a + rows_at, len(v)))
                    for at, rough, exact in zip(tiles, coarse, fine, strict=True):
                        values = small[some] @ rough if products else summed(v[some], exact)
                        bar = (best.bar[at] - 1) / UNITS
                        slack = doubt[at] * length[some].max()
                        if len(values) > k and np.isneginf(bar).any():
                            bar = np.maximum(bar, np.partition(values, len(values) - k, axis=0)[len(values) - k] - slack - 2 / UNITS)
                        row, query = np.nonzero(values >= bar - slack)
                        if products:
                            score = np.zeros(len(row))
                            for x, y in zip(v[some].T, exact, strict=True):
                                score += x[row] * y[query]
                        else:
                            score = values[row, query]
                        best.offer(query + at.start, ids[some][row], score)
            query, item, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(asked[query]), pa.array(item), pa.array(score)], ["query_id", "item_id", "score"])

        found = vectors.filter(plain).select("item_id", "v").mapInArrow(run, "query_id long, item_id long, score double").withColumn("score", F.round("score", 6))
        out = found if out is None else out.unionByName(found)
    odd = dense(queries.filter(able), vectors.filter(~plain)).unionByName(dense(queries.filter(~able), vectors))
    return out.unionByName(odd)


def matrix_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``dense``, reduced to at least the k best of every query, by products of matrices."""
    return _vector_search(vectors, queries, k, True)


def sum_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``dense``, reduced to at least the k best of every query, each pair summed component by component."""
    return _vector_search(vectors, queries, k, False)


def fuse(lists: list[DataFrame], k: int, item: str = "chunk_id", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over the lists, ties by id."""
    both = lists[0].select(*by, item, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(*by, item, "rank"))
    scored = both.groupBy(*by, item).agg(F.round(F.sum(1 / (F.lit(RRF) + F.col("rank"))), 9).alias("score"))
    return top_k(scored, k, item, by)


def relevant(overlap: Column, chunk_size: Column, gold_size: Column, share: float = 0.5) -> Column:
    """An overlap that is at least a share of the chunk or of the gold span; never without overlap."""
    return (overlap > 0) & ((overlap >= chunk_size * share) | (overlap >= gold_size * share))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def union_length(intervals: DataFrame, by: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Length of the union of intervals by group: gaps and islands over a running maximum of the ends."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    island = new.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_i").agg((F.max(end) - F.min(start)).alias("_n")).groupBy(*by).agg(F.sum("_n").alias("covered"))
