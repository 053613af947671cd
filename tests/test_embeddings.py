"""Learned vectors: equal to a dense decomposition, better than hashed ones, defined for odd texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import embeddings as V
from siltstone.plans import PLANS
from siltstone.plans import retrieval_queries as Q


def dense(lists, idf):
    a = np.zeros((len(lists), len(idf)))
    for i, cells in enumerate(lists):
        for c in set(cells):
            a[i, c] = (1 + np.log(cells.count(c))) * idf[c]
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(9)]
    rows = []
    for i in range(400):
        words = list(rng.choice(topics[i % 9], 14)) + list(rng.choice(topics[rng.integers(9)], 3))
        rows.append((i, " ".join(w.replace("t", "tx").replace("0", "o").replace("1", "l") for w in words)))
    return spark.createDataFrame(rows + [(900, None), (901, "")], "chunk_id long, text string").repartition(5)


def test_equals_a_dense_decomposition(texts):
    model = V.learn(texts, T.tokens(F.col("text")), size=6, cells=256, passes=12)
    lists = [r.c for r in texts.select(V.cells_of(T.tokens(F.col("text")), 256).alias("c")).collect()]
    a = dense(lists, model.idf)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-4)
    mine = model.vectors(pa.array(lists, pa.list_(pa.int32())), 6)
    theirs = u[:, :6] / np.maximum(np.linalg.norm(u[:, :6], axis=1, keepdims=True), 1e-12)
    whole = np.linalg.norm(a, axis=1) > 0
    assert np.allclose((mine @ mine.T)[whole][:, whole], (theirs @ theirs.T)[whole][:, whole], atol=2e-3)
    assert (mine[~whole] == 0).all()


def test_products_of_sparse_rows(monkeypatch):
    monkeypatch.setattr(V, "STEP", 7)
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 20, n).tolist() for n in (5, 0, 30, 1, 12, 3)]
    idf, q = rng.random(20) + 0.5, rng.standard_normal((20, 4)).astype(np.float32)
    row, cell, weight, n = V.sparse(pa.array(lists, pa.list_(pa.int32())), idf)
    a = dense(lists, idf)
    product = V.rows_times(row, cell, weight, n, q)
    assert np.allclose(product, a @ q, atol=1e-5)
    total = np.zeros((20, 4), np.float32)
    V.add_back(row, cell, weight, product, total)
    assert np.allclose(total, a.T @ (a @ q), atol=1e-5)


def test_the_tree_adds_up_all_shares(texts, monkeypatch):
    monkeypatch.setattr(V, "FAN", 2)
    listed = texts.select(V.cells_of(T.tokens(F.col("text")), 1024).alias("cells"))
    idf = V.inverse_frequencies(listed, 1024)
    q = np.random.default_rng(0).standard_normal((1024, 3))
    a = dense([r.cells for r in listed.collect()], idf)
    assert np.allclose(V.gram_product(listed, idf, q), a.T @ (a @ q), atol=1e-3)


def test_an_empty_corpus_and_few_texts(spark, texts):
    none = V.learn(texts.filter("false"), T.tokens(F.col("text")), size=4, cells=64)
    assert none.vectors(pa.array([[1, 2]], pa.list_(pa.int32())), 4).shape == (1, 0)
    few = V.learn(texts.filter("chunk_id < 3"), T.tokens(F.col("text")), size=8, cells=64)
    assert 1 <= few.parts.shape[1] <= 3


def test_prefix_is_the_question_s(spark):
    asked = spark.createDataFrame([("a b",)], "q string")
    assert asked.select(T.tokens(V.with_prefix(F.col("q"), "find this ")).alias("t")).first().t == ["find", "this", "a", "b"]
    assert asked.select(T.tokens(V.with_prefix(F.col("q"), "")).alias("t")).first().t == ["a", "b"]


def test_search_equals_all_cosines(texts):
    tokens = T.tokens(F.col("text"))
    model = V.learn(texts, tokens, size=6, cells=256)
    asked = texts.filter("chunk_id < 20 OR chunk_id >= 900").select(F.col("chunk_id").alias("query_id"), "text")
    got = V.search(model, texts, asked, tokens, tokens, 4, 6)
    best = {}
    for r in got.collect():
        best.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    rows = texts.select("chunk_id", V.cells_of(tokens, 256).alias("c")).collect()
    v = model.vectors(pa.array([r.c for r in rows], pa.list_(pa.int32())), 6).astype(float)
    for q in range(20):
        mine = v[[r.chunk_id for r in rows].index(q)]
        want = sorted((-round(float(x @ mine), 6), r.chunk_id) for r, x in zip(rows, v, strict=True) if x @ mine > 0)[:4]
        assert [c for _, c in want][0] == sorted(best[q])[0][1] and np.allclose([s for s, _ in want], [s for s, _ in sorted(best[q])[:4]], atol=2e-5)
    assert 900 not in best and 901 not in best


def test_learned_vectors_find_more_than_hashed_ones(spark, small):
    recall = {r.vectors: r.recall_at_5 for r in PLANS["embedding_recall"](spark, small.replace("0.001", "0.01")).collect()}
    assert recall["learned 64"] > recall["hashed 64"] and recall["learned 256"] > recall["hashed 256"] > 0
    assert recall["learned 64"] < recall["learned 128"] < recall["learned 256"]


def test_a_task_keeps_the_best_of_all_its_batches(spark, texts):
    """All sizes in one pass give what each gives alone, and no more rows than k for a question and task."""
    tokens, batch = T.tokens(F.col("text")), "spark.sql.execution.arrow.maxRecordsPerBatch"
    model = V.learn(texts, tokens, size=6, cells=256)
    asked = texts.filter("chunk_id < 20 OR chunk_id >= 900").select(F.col("chunk_id").alias("query_id"), "text")
    before = spark.conf.get(batch)
    spark.conf.set(batch, "20")
    try:
        alone = {size: V.search(model, texts, asked, tokens, tokens, 4, size).collect() for size in (3, 6)}
        listed = texts.select("chunk_id", V.cells_of(tokens, 256).alias("cells"))
        both = V.search_sizes(model, listed, asked, {3: tokens, 6: tokens}, 4).collect()
    finally:
        spark.conf.set(batch, before)
    for size, rows in alone.items():
        assert len(rows) <= 5 * 20 * 4
        assert {(r.query_id, r.chunk_id): round(r.score, 4) for r in rows} == {(r.query_id, r.chunk_id): round(r.score, 4) for r in both if r["size"] == size}


@pytest.mark.parametrize(("often", "rows"), [(1, 1), (3, 60), (1000, 1 << 15)])
def test_shares_of_batches_put_together(texts, monkeypatch, often, rows):
    monkeypatch.setattr(V, "OFTEN", often)
    monkeypatch.setattr(V, "GATHERED", rows)
    listed = texts.select(V.cells_of(T.tokens(F.col("text")), 1024).alias("cells"))
    idf = V.inverse_frequencies(listed, 1024)
    q = np.random.default_rng(0).standard_normal((1024, 3))
    a = dense([r.cells for r in listed.collect()], idf)
    assert np.allclose(V.gram_product(listed, idf, q), a.T @ (a @ q), atol=1e-3)


@pytest.mark.parametrize(("shape", "rows"), [((100, 7), 30), ((100, 7), 4), ((8, 8), 5), ((50, 3), 1000)])
def test_orthogonal_in_place(shape, rows):
    a = np.random.default_rng(1).standard_normal(shape)
    q = V.orthogonal(a.copy(), rows)
    assert q.shape == shape and np.allclose(q.T @ q, np.eye(shape[1])) and np.allclose(q @ (q.T @ a), a)


def test_recall_equals_that_of_all_cosines(spark, small, monkeypatch):
    """`embedding_recall` ranks as all cosines of its model do, with tiles that end within a batch."""
    learnt, learn = [], V.learn_cells
    monkeypatch.setattr(V, "learn_cells", lambda *a, **k: learnt.append(learn(*a, **k)) or learnt[0])
    monkeypatch.setattr(V, "TILE", 7)
    got = {r.vectors: (r.n_questions, r.recall_at_5) for r in PLANS["embedding_recall"](spark, small).collect()}
    golds, chunks = Q.gold(spark, small), Q.chunks(spark, small)
    names, docs = {}, {}
    for r in golds.select("query_id", "doc_id").collect():
        docs.setdefault(r.query_id, set()).add(r.doc_id)
    for r in Q.relevant_of(chunks.drop("text"), golds).collect():
        names.setdefault((r.query_id, r.chunk_id), set()).add(r.doc_id)
    for size in V.SIZES:
        ids, best = all_cosines(learnt[0], chunks, Q.queries(spark, small), size, 5)
        found = {q: set().union(*(names.get((q, c), set()) for _, c in best[q])) for q in ids}
        want = np.mean([len(found.get(q, set())) / len(d) for q, d in docs.items()])
        assert got[f"learned {size}"] == (len(docs), pytest.approx(want, abs=1e-6))


def all_cosines(model, chunks, asked, size, k):
    """The k best (-score, chunk) above 0 of every question, from the matrix of all pairs."""
    cells = lambda df, key, text: sorted((r[0], r[1]) for r in df.select(key, V.cells_of(T.tokens(F.col(text)), len(model.idf))).collect())
    held, want = cells(chunks, "chunk_id", "text"), cells(asked, "query_id", "gold_text")
    v, q = (model.vectors(pa.array([c for _, c in rows], pa.list_(pa.int32())), size).astype(float) for rows in (held, want))
    scores = np.round(q @ v.T, 6)
    return [i for i, _ in want], {i: sorted((-s, c) for s, (c, _) in zip(row.tolist(), held, strict=True) if s > 0)[:k] for (i, _), row in zip(want, scores, strict=True)}


def test_ranked_lists_are_those_of_all_cosines(spark, small, monkeypatch):
    """`learned_embedding_topk` gives every question its ten best chunks above 0, ties by the chunk; a question without terms gets none."""
    chunks = Q.chunks(spark, small)
    model = V.learn(chunks, T.tokens(F.col("text")), size=16, cells=512)
    monkeypatch.setattr(V, "learn", lambda *a, **k: model)
    monkeypatch.setattr(V, "TILE", 7)
    asked = Q.queries(spark, small).unionByName(spark.createDataFrame([(-1, "", [])], "query_id long, gold_text string, qt array<string>"))
    monkeypatch.setattr(Q, "queries", lambda *a: asked)
    got = {}
    for r in sorted(PLANS["learned_embedding_topk"](spark, small).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.chunk_id))
    ids, best = all_cosines(model, chunks, asked, 128, 10)
    assert len(ids) > 1 and set(got) == {q for q in ids if best[q]} and -1 not in got
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, len(best[q]) + 1))
        assert np.allclose([s for _, s, _ in rows], [s for s, _ in best[q]], atol=2e-5)
        assert [(s, c) for _, s, c in rows] == sorted((s, c) for _, s, c in rows)
        sure = {c for s, c in best[q] if s < best[q][-1][0] - 4e-5}
        assert sure <= {c for _, _, c in rows}
