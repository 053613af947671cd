"""Search by ranges of tokens: the same rows as making every chunk as a text and searching those."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunk_search as X
from siltstone.operators import chunking as C
from siltstone.operators import retrieval as R
from siltstone.plans import PLANS, SQL
from siltstone.plans import retrieval_queries as Q

ODD = [None, "", " ", "...", "x", "1", "1,234,567.89,1", "ſtraße KELVIN İstanbul 漢字", "9" * 700, "ab1" * 300, "1.2.3,456" * 150, "12,345" * 200, ".5,,1..2," * 120, "İ" + "word 1,234.5 " * 90, "a" * 1500, "| x | 1 |\n" * 200]


@pytest.fixture(scope="module")
def corpus(spark):
    letters = random.Random(8)
    word = lambda: letters.choice(["the", "of", f"w{letters.randrange(40)}", f"{letters.randrange(5000):,}", f"{letters.random():.3f}", "Kß", "z9z", "1.5.2", "漢"])
    texts = ODD + [letters.choice([" ", "", "\n", ", "]).join(word() for _ in range(letters.randrange(400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts, 1)) + [(None, "the of")], "doc_id long, text string").repartition(3)
    asked = [(i, " ".join(word() for _ in range(25))) for i in range(30)] + [(90, None), (91, ""), (92, "the"), (93, "nowhere")]
    questions = spark.createDataFrame(asked, "query_id long, text string").select("query_id", T.tokens(F.col("text")).alias("qt"))
    names = list(C.CHUNKERS)
    part = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("chunking")).cast("int") - 1
    chunks = C.all_chunks(docs).select(part.alias("part"), "chunk_id", T.tokens(F.col("text")).alias("t")).cache()
    return docs, questions, names, chunks


def test_chunks_that_hold_a_term(corpus, monkeypatch):
    docs, _, names, chunks = corpus
    want = {}
    for r in chunks.collect():
        for t in {*r.t, f"#{len(r.t)}"}:
            want[r.part, t] = want.get((r.part, t), 0) + 1
    for most in (X.PIECES, 50):  # what a task remembers is emptied now and then
        monkeypatch.setattr(X, "PIECES", most)
        assert {(r.part, r.term): r.df for r in X.counted(docs, names).collect()} == want


@pytest.mark.parametrize(("k", "tile", "heavy"), [(5, 2048, 256), (100, 7, 3), (3, 50, 0)])
def test_the_same_best_chunks(corpus, monkeypatch, k, tile, heavy):
    monkeypatch.setattr(X, "TILE", tile)
    monkeypatch.setattr(X, "HEAVY", heavy)
    docs, q, names, chunks = corpus
    by = ["part", "cells", "query_id"]
    rows = lambda found: {(r.part, r.cells, r.query_id, r["rank"]): (r.chunk_id, round(r.score, 5)) for r in R.top_k(found, k, "chunk_id", by).collect()}
    t, asked = F.col("t"), F.col("qt")
    old = R.bm25_by_part(chunks, q, t, asked, k, "part").withColumn("cells", F.lit(0))
    want = rows(old.unionByName(R.hashed_by_part(chunks, q, t, asked, T.md5_int, k, (8, 32), "part")))
    got = rows(X.search(docs, q, names, k, (8, 32)))
    assert got.keys() == want.keys() and len(got) > 100
    assert {key for key in got if abs(got[key][1] - want[key][1]) > 2e-5} == set()
    assert sum(got[key][0] != want[key][0] for key in got) == 0


@pytest.mark.parametrize("name", ["factor_decomposition", "retrieval_winner"])
def test_chunks_are_rows_only_where_they_are_shown(spark, tmp_path, monkeypatch, name):
    """Of 400 documents the grid makes chunks of those in the lists of two questions alone, and gives what its SQL gives."""
    import duckdb

    letters = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    texts = ["\n".join(" ".join(letters.choices(words, k=12)) + "." for _ in range(12)) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, texts[i * 70][30:190]) for i in (1, 2)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    made, whole = [], C.all_chunks
    monkeypatch.setattr(Q.C, "all_chunks", lambda docs, *names: made.append(docs.select("doc_id").distinct().count()) or whole(docs, *names))
    got, cursor = PLANS[name](spark, str(tmp_path)), con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    tidy = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert tidy(tuple(r[c] for c in columns) for r in got.collect()) == tidy(cursor.fetchall())
    assert made and max(made) < 400


def test_bounds_of_many_texts():
    texts = ["x" * n for n in (0, 1, 32, 33, 64, 65, 224, 255, 256, 257, 288, 448, 449, 512, 513, 576, 577, 960, 5000)] + ODD[2:]
    for name, bounds in C.CHUNKERS.items():
        assert C.chunk_bounds(name, texts).T.tolist() == [[d, k, a, z] for d, t in enumerate(texts) for k, (a, z) in enumerate(bounds(t))]


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """A folder with texts, some of which hold items, whole or only their beginning."""
    folder, letters = tmp_path_factory.mktemp("told"), random.Random(12)
    texts = [" ".join(letters.choices(["né", "ab", "漢字", "x", "aaaa"], k=90)) for _ in range(120)] + ["aaaa " * 80, "", None]
    items = [texts[7][20:90], texts[7][20:60], texts[9][:40] + "#", texts[3][11:12], texts[50][-5:], "aaaa " * 9, "", None, "nowhere"]
    spark.createDataFrame(list(enumerate(texts)) + [(None, texts[7])], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = [(i // 2, d, t.find(x), t.find(x) + len(x)) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t]
    return str(folder), sorted(want)


def test_evidence_is_found_where_texts_are_read(spark, told):
    found = Q.gold(spark, told[0])
    assert sorted(map(tuple, found.select("query_id", "doc_id", "gold_start", "gold_end").collect())) == told[1]
    assert len(told[1]) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # the texts would be shuffled for it


@pytest.mark.parametrize("slice_", [1 << 20, 50])
def test_keys_are_found_by_their_heads(monkeypatch, slice_):
    import numpy as np

    from siltstone.operators import containment as K

    monkeypatch.setattr(K, "SLICE", slice_)
    letters = random.Random(4)
    for alphabet in ("ab ", "a", "abcdefgh éß漢"):
        texts = [("".join(letters.choices(alphabet, k=letters.randrange(300)))).encode() for _ in range(20)]
        keys = [(i, t[(a := letters.randrange(len(t) + 1)) : a + letters.choice([1, 7, 8, 9, 30, 50])]) for i, t in enumerate(texts)]
        got = K.Keys(keys).within(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert got == {(r, i) for r, t in enumerate(texts) for i, k in keys if k and k[: K.KEY_BYTES] in t}


def test_the_winner_is_taken_from_a_written_grid(spark, told):
    """Its ranking and its bootstrap each read the grid, so that the texts were read and cut again for them."""
    assert not [f for f in PLANS["retrieval_winner"](spark, told[0]).inputFiles() if "documents" in f or "benchmark" in f]


@pytest.mark.parametrize("signed", [False, True])
def test_rough_scores_lose_none_of_the_best(signed):
    import numpy as np

    made, k, n = np.random.default_rng(6), 5, 7
    scores = np.round(made.random((400, n)) - 0.5 * signed, 3)  # many ties
    met = made.random((400, n)) < 0.6 if signed else scores > 0
    best, slack = X.Held(n, k), 0.02
    for a in range(0, 400, 90):
        rows = scores[a : a + 90]
        rough = np.maximum(rows + made.uniform(-slack, slack, rows.shape), -1.0 if signed else 1e-6).astype(np.float32)
        best.tile(rough, slack * 1.001, lambda r, q, rows=rows: rows[r, q], np.arange(a, a + len(rows)), met[a : a + 90] if signed else None)
    got = sorted(zip(*(x.tolist() for x in best.rows()), strict=True))
    want = [(q, i, scores[i, q]) for q in range(n) for i in sorted(np.flatnonzero(met[:, q]), key=lambda i, q=q: (-scores[i, q], i))[:k]]
    assert got == sorted(want)
