"""Lexical search with early stop: equal to scores of all pairs, and fewer postings scored than there are."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical as L
from siltstone.operators import retrieval as R
from siltstone.operators.retrieval import saturation


def slow(chunks, questions, k):
    best = {}
    for q in {r[0] for r in questions}:
        scored = []
        for i, t in chunks:
            terms = [(w, x) for (j, x, w) in questions if j == q and x in t]
            if terms:
                s = sum(w * saturation(t.count(x), len(t), 7.0) for w, x in terms)
                scored.append((-np.floor(s * 1e6 + 0.5), i))
        best[q] = [i for _, i in sorted(scored)[:k]]
    return best


def run(chunks, questions, k, batch):
    asked = L.Questions(questions)
    search = L.Search(asked, lambda tf, longer: saturation(tf, longer, 1.0), k)
    for i in range(0, len(chunks), batch):
        some = chunks[i : i + batch]
        search.batch(np.array([c for c, _ in some]), pa.array([t for _, t in some], pa.list_(pa.string())), 7.0)
    question, item, score = search.best.rows()
    out = {q: [] for q in asked.ids}
    for q, i, s in zip(question, item, score, strict=True):
        out[asked.ids[q]].append((-np.floor(s * 1e6 + 0.5), i))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}, search


@pytest.mark.parametrize("rows, postings", [(64, 1 << 20), (3, 5)])
def test_equals_scores_of_all_pairs(monkeypatch, rows, postings):
    monkeypatch.setattr(L, "ROWS", rows)
    monkeypatch.setattr(L, "POSTINGS", max(postings, rows))
    rng = random.Random(rows)
    for _ in range(20):
        chunks = [(rng.randrange(1000) * 1000 + i, [rng.choice("aaabbcdefghij") for _ in range(rng.randrange(0, 15))]) for i in range(rng.randrange(0, 150))]
        questions = [(q, x, rng.choice([0.0, 0.3, 1.0, 2.5, -0.4])) for q in range(5) for x in rng.sample("abcdefghijz", rng.randrange(1, 6))]
        k = rng.choice([1, 3, 9])
        assert run(chunks, questions, k, rng.choice([7, 40, 500]))[0] == slow(chunks, questions, k)


def test_what_cannot_be_among_the_best_is_not_scored():
    """A frequent term of little weight beside a rare one: only the blocks with the rare term are scored once k are found."""
    rng = random.Random(1)
    chunks = [(i, ["the"] * rng.randrange(1, 4) + (["rare"] if i % 997 == 0 else []) + [f"x{i}"]) for i in range(40_000)]
    questions = [(q, "the", 0.01) for q in range(20)] + [(q, "rare", 9.0) for q in range(20)]
    found, search = run(chunks, questions, 3, 8000)
    assert found == slow(chunks[:1] + [c for c in chunks if "rare" in c[1]][1:], questions, 3)
    assert search.scored < search.matching / 20


def test_no_terms_and_no_chunks():
    assert run([], [(1, "a", 1.0)], 3, 5)[0] == {1: []}
    assert run([(1, []), (2, None)], [(1, "a", 1.0)], 3, 5)[0] == {1: []}


@pytest.mark.parametrize("search", [R.matrix_search, R.sum_search])
def test_vector_search_equals_all_pairs(spark, monkeypatch, search):
    """Ties, equal vectors, blocks and tiles smaller than the sets, and vectors that products cannot take; a plan that makes no row for a pair."""
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(R, "PRODUCT_TILE", (16, 3))
    monkeypatch.setattr(R, "SUM_TILE", (5, 4))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(1000 + i, [0.5, -0.25, 0.0, 1.0, 0.0, 0.0]) for i in range(30)]
    rows += [(2000, [1e20] * 6), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0]), (2003, None)]
    v = spark.createDataFrame(rows, "item_id long, v array<float>").repartition(3)
    q = v.filter("item_id % 12 = 0 OR item_id = 2000").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    order = lambda df: sorted((r.query_id, r.rank, r.item_id, r.score) for r in df.collect())
    found = search(v, q, 4)
    assert order(R.top_k(found, 4, "item_id")) == order(R.top_k(R.dense(q, v), 4, "item_id"))
    clean = [(i, x) for i, x in rows if i < 2000]
    few = search(spark.createDataFrame(clean, "item_id long, v array<float>"), q.filter("query_id < 2000"), 4)
    blocks = 2 * -(-q.count() // 7)
    assert few.count() <= 4 * q.count() * max(4, spark.sparkContext.defaultParallelism) * blocks < len(clean) * q.count() * blocks
