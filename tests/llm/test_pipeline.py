"""The stages one after the other on a small corpus whose fate is known."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_run(spark, tmp_path):
    import random

    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item, shared = prose(30), prose(60)
    rows = {i: prose(60) for i in range(200)}
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    for i in range(0, 200, 4):
        rows[i] += " vilescum"
    rows[1] = prose(30) + " " + item
    rows[3] = rows[2]
    rows[5], rows[6] = prose(30) + " " + shared, prose(30) + " " + shared
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(200) if i % 4} - {1, 3}
    assert all(r.lossless for r in got.values())
    assert got[6].n_tokens < got[5].n_tokens * 0.5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "substring dedup", "decontamination", "sentencepiece"]


def test_stage_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_near_copies_from_eighty_percent(spark, frame):
    """Texts of 100 words: k changed words far apart leave (96 - 5k) of (96 + 5k) shingles."""
    words = [f"w{i:03d}" for i in range(300)]

    def changed(first, *places):
        return " ".join("other" + str(i) if i in places else w for i, w in enumerate(words[first : first + 100]))

    rows = [(1, changed(0)), (2, changed(0, 50)), (3, changed(100)), (4, changed(100, 30, 60)), (5, changed(200)), (6, changed(200, 1, 50))]
    similar = lambda shared, size: shared / (2 * size - shared)
    assert similar(91, 96) > 0.85 and similar(86, 96) < 0.815 and 0.8 < similar(86, 96) and 0.8 < similar(89, 96) < 0.87
    docs = frame(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3, 5}
    below = frame([(1, changed(0)), (2, changed(0, 20, 50, 80))])
    assert corpus_pipeline.drop_near_copies(spark, below, "").count() == 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark for the stages: two hostile words, one item."""
    where = tmp_path_factory.mktemp("stages")
    labels = [(i, 1, i % 2) for i in range(100, 200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20)), "x"), (2, None, "x"), (3, "yes", "x")], "item_id long, text string, doc_id string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def odd_documents(frame, odd_texts):
    """Odd rows and 200 labelled texts, with a column for every name that the operators use."""
    labelled = [(i, f"plain words number {i} of a longer text" + " vilescum" * (i % 2)) for i in range(100, 200)]
    return frame([*odd_texts, *labelled, (300, "before " + " ".join(f"item{i}" for i in range(20)) + " behind yes"), (None, " ".join(f"item{i}" for i in range(20)))])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, frame, odd_texts, folder, name, stage):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names, an empty table."""
    docs = odd_documents(frame, odd_texts).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    before = docs.collect()
    rows = stage(spark, docs, folder).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "toxicity":
        assert not any(r.text and "vilescum" in r.text for r in rows) and {3, 4, 5} <= set(ids) and ids[6] == 2 and ids[None] == 2
    elif name == "near-dedup":
        assert {1, 3, 4, 5, 10} <= set(ids) and 2 not in ids and ids[6] == 2 and ids[None] == 2
    elif name == "substring dedup":
        assert len(rows) == len(before) and {r.text for r in rows if r.doc_id == 2} == {""} and {r.text for r in rows if r.doc_id == 3} == {None}
        assert {r.text for r in rows if r.doc_id == 8} == {"x" * 30000} and {r.n_chars for r in rows if r.doc_id == 2} == {0} and {r.text for r in rows if r.doc_id == 5} == {" \n\t "}
    elif name == "decontamination":
        assert 300 not in ids and ids[None] == 0 and {1, 3, 4, 5, 8} <= set(ids) and ids[6] == 2
    else:
        assert len(rows) == len(before) and all(r.lossless for r in rows) and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    if name != "sentencepiece":
        assert stage(spark, docs, folder).columns == docs.columns and all(r.lang is None and r.split == "x" and r.held_out == "x" for r in rows)
    assert stage(spark, frame([]), folder).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_one_row_a_partition(spark, frame, odd_texts, folder, tmp_path, name, stage):
    """Rows without words alone in their partitions, and labelled ones among them, give what they give beside others."""
    import shutil

    shutil.copytree(folder, tmp_path / "in")
    wordless = [(i, t) for i, t in zip(range(400, 410), [None, "", " \n ", "12, 34!", "--"] * 2, strict=True)]
    spark.createDataFrame([(i, 1, i % 2) for i, _ in wordless], "doc_id long, quality int, toxic int").write.mode("append").parquet(f"{tmp_path}/in/labels.parquet")
    rows = [*odd_texts, *wordless, (401, ""), (120, "plain words number 120 of a longer text"), (121, "plain words number 121 of a longer text vilescum")]
    docs = frame(rows)
    key = lambda r: tuple((r[c] is None, str(r[c])) for c in sorted(r.asDict()))
    together, alone = (sorted(stage(spark, d, str(tmp_path / "in")).collect(), key=key) for d in (docs.coalesce(1), docs.repartitionByRange(len(rows), "doc_id", "text")))
    assert together == alone


def test_run_on_an_empty_table(spark, frame, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "in")
    frame([]).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "in")).count() == 0


def brute_run(docs, kept_by_score, items, percent):
    """The pipeline without its operators: rows (id, text) that score low enough, then near copies, repeated windows and leaks by definition."""
    import re

    words = lambda t: re.findall("[^\\x20\\x09-\\x0D]+", t or "")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [(i, t) for i, t in docs if i in kept_by_score]

    def shingles(t):
        w = words(low(t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = sorted((i, t) for i, t in rows if find(i) == i)
    seen, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    token = lambda t: re.findall("[a-z0-9]+", low(t or ""))
    leaks = {i for i, t in out for q in items if len(token(q)) >= 8 and " ".join(token(q)) in " ".join(token(t))}
    return {i: t for i, t in out if i not in leaks}


def test_run_equals_brute_force(spark, frame, tmp_path):
    """All stages on random texts with copies, near copies, shared passages and leaks; scores are the operator's own, tested elsewhere."""
    import hashlib
    import random

    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    item, shared = prose(25), [prose(40) for _ in range(3)]
    texts = []
    for i in range(150):
        w = prose(rng.randrange(20, 120))
        if i % 5 == 1 and texts:
            w = list(rng.choice(texts))
            if i % 2:
                w[rng.randrange(len(w))] = "changed"
        if i % 7 == 2:
            w += rng.choice(shared)
        if i % 11 == 3:
            w += item
        texts.append(w)
    docs = [(i, rng.choice([" ", "\n"]).join(w) + " vilescum" * (i % 4 == 0)) for i, w in enumerate(texts)]
    frame(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    want = brute_run(docs, kept, [" ".join(item)], corpus_pipeline.NEAR_PERCENT)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and 20 < len(want) < len(kept) < 150
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items())
