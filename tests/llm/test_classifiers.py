"""Held-out accuracy, counterfactual stability and odd rows of the classifiers and the licence scan."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import licences as L
from siltstone.llm import queries as Q
from siltstone.llm import quality, toxicity
from siltstone.llm.labelled import labelled_sample


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def judged(spark):
    """Texts with a hostile word or with shouting, and labels that say so."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        words = [f"word{rng.integers(300)}" for _ in range(rng.integers(5, 80))]
        toxic, junk = bool(rng.random() < 0.3), bool(rng.random() < 0.3)
        if toxic:
            words[rng.integers(len(words))] = ["scumbag", "nastyfool"][rng.integers(2)]
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if junk else text, "en", "s", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module, at", [(quality, 0), (toxicity, 1)])
def test_held_out_accuracy(judged, module, at):
    docs, labels, truth = judged
    got = module.score_documents(docs, labels).collect()
    assert len(got) == 900 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][at] for r in out]) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(frame, judged, odd_texts, module):
    _, labels, _ = judged
    got = module.score_documents(frame(odd_texts), labels).collect()
    assert len(got) == len(odd_texts) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert module.score_documents(frame([]), labels).count() == 0
    empty = module.score_documents(frame(odd_texts), labels.filter("false")).collect()
    assert len({r.score for r in empty}) == 1


WORDLESS = [None, "", " \n\t ", "12, 34!", "…" * 3]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_texts_without_words(spark, frame, judged, module):
    """Alone in their batches, and as labelled rows that are learnt from."""
    docs, labels, _ = judged
    odd = [i for i in range(1000, 1100) if not held(i)][: 2 * len(WORDLESS)]
    texts = list(zip(odd, WORDLESS * 2, strict=True))
    told = labels.unionByName(spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(odd)], "doc_id long, quality int, toxic int"))
    alone = frame(texts).repartition(len(texts), "doc_id").unionByName(frame([(1, "plain word1 and word2")]))
    got = {r.doc_id: r for r in module.score_documents(docs.select("doc_id", "text").unionByName(alone.select("doc_id", "text")), told).collect()}
    assert all(0 <= got[i].score <= 1 for i in odd) and len(got) == 900 + len(odd)
    assert len({got[i].score for i in odd[:3]}) == 1
    only_odd = module.score_documents(alone, told.join(alone.select("doc_id"), "doc_id")).collect()
    assert len(only_odd) == len(texts) + 1 and all(0 <= r.score <= 1 for r in only_odd)


def test_word_hashes_of_runs_without_words():
    from siltstone.llm.textops import Words

    for raw in (b"", b"   ", b"\n\t"):
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert len(w.hash) == 0 and len(w.span_hash(w.start, w.end)) == 0


def test_labels_of_the_held_out_fold_are_not_read(judged):
    docs, labels, _ = judged
    sample = labelled_sample(docs, labels, "toxic", 10_000)
    assert sample.count() == sum(not held(i) for i in range(900))
    assert not any(held(r.doc_id) for r in sample.select("doc_id").collect())


def test_toxic_rows_go(judged):
    docs, labels, truth = judged
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert np.mean([(i in ids) != bool(t) for i, (_, t) in truth.items()]) > 0.95


def test_counterfactual_penalty():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(400):
        bad = rng.random() < 0.5
        group = "women" if rng.random() < (0.9 if bad else 0.1) else "men"
        texts.append(" ".join([f"w{rng.integers(50)}" for _ in range(6)] + [group] + (["vilename"] if bad and rng.random() < 0.7 else [])))
        y.append(int(bad))
    row, cell = toxicity.distinct_pairs(*toxicity.feature_pairs(pa.array(texts)))
    swaps, none = toxicity.swaps_of(texts), np.zeros(400, bool)
    assert all(abs(sum(s.values()) - 1) < 1e-9 for s in swaps)
    free = toxicity.fit(row, cell, np.array(y), none, swaps, swap_penalty=1e-9)
    tied = toxicity.fit(row, cell, np.array(y), none, swaps, swap_penalty=20.0)
    gap = lambda m: abs(float(np.diff(m.logits(pa.array(["a talk with women", "a talk with men"])))[0]))
    assert gap(tied) < 0.25 * gap(free)


def test_every_mention_is_swapped_with_every_other_term():
    """Against sentences written out: the cells that differ, for all mentions of a long text."""
    kind = next(k for k in toxicity.IDENTITY_TERMS if "hindu" in k)
    text = "An old man. " + " ".join(f"w{i}" for i in range(50)) + ".\n" + ". ".join(f"the {t} of x{i}" + f", a {t}" * (i % 2) for i, t in enumerate(kind * 3 + kind[1:]))
    cells_of = lambda t: set(toxicity.distinct_pairs(*toxicity.feature_pairs(pa.array([t])))[1].tolist())
    want = set()
    for sentence in text.replace("\n", ".").split("."):
        words = sentence.lower().replace(",", " ").split()
        for i, w in enumerate(words):
            for k in toxicity.IDENTITY_TERMS:
                for other in k if w in k else ():
                    if other != w:
                        a, b = cells_of(" ".join(words)), cells_of(" ".join([*words[:i], other, *words[i + 1 :]]))
                        want.add((tuple(sorted(a - b)), tuple(sorted(b - a))))
    assert set(toxicity.swaps_of([text])[0]) == want and len(want) > len(kind) * (len(kind) - 1) // 2


def test_repeated_ids_do_not_add_to_the_sample(spark):
    docs = spark.createDataFrame([(7 if i < 500 else i, f"text {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "toxic", 10)
    rows = sample.collect()
    assert len(rows) == 20 and len({r.doc_id for r in rows}) == 20


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_equal_one_by_one(spark, small, module):
    """The query's scores against a scorer of one text at a time, written without batches."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = module.train(docs, labels)
    got = {r.doc_id: r.score for r in module.score_documents(docs, labels).collect()}
    for r in docs.collect()[::7]:
        one = slow_toxicity(model, r.text or "") if module is toxicity else slow_quality(model, r.text or "")
        assert abs(got[r.doc_id] - one) < 1e-4


def slow_toxicity(model, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = set("".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")) - {""}
    cells = {c for w in words for c in toxicity.word_cells([w])[w]}
    z = model.bias + sum(float(model.weights[c]) for c in cells)
    return 1 / (1 + np.exp(-z))


def slow_quality(model, text):
    x, counts = quality.passages(pa.array([text]))
    x = (x - model.mean) / model.scale
    total = np.zeros(len(model.p["c"]))
    gates = []
    for passage in x:
        h = np.tanh(passage @ model.p["W"] + model.p["b"])
        gates.append((float((np.tanh(h @ model.p["V"]) / (1 + np.exp(-h @ model.p["U"]))) @ model.p["a"]), h))
    top = max(e for e, _ in gates)
    share = [np.exp(e - top) for e, _ in gates]
    for a, (_, h) in zip(share, gates, strict=True):
        total += a / sum(share) * h
    return 1 / (1 + np.exp(-(float(total @ model.p["c"]) + float(model.p["d"]) + model.shift)))


#: Least held-out precision and recall at the query's threshold, least area under the curve, on the supplied labels.
@pytest.mark.parametrize("op, label, precision, recall, area", [(Q.op5_quality, "quality", 0.97, 0.97, 0.99), (Q.op7_toxicity, "toxic", 0.7, 0.8, 0.95)])
def test_held_out_labels(spark, medium, op, label, precision, recall, area):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, truth[r.doc_id]) for r in op(spark, medium).collect() if r.held_out and r.doc_id in truth]
    hit, said, are = sum(p * t for _, p, t in rows), sum(p for _, p, _ in rows), sum(t for _, _, t in rows)
    score, y = np.array([s for s, _, _ in rows]), np.array([t for _, _, t in rows], bool)
    auc = np.mean([(s > score[~y]).mean() + (s == score[~y]).mean() / 2 for s in score[y]])
    print(label, "precision", hit / said, "recall", hit / are, "area", auc)
    assert hit / said >= precision and hit / are >= recall and auc >= area


def test_quality_gradients_learn_one_bad_passage():
    good = [" ".join(f"w{i % 37}" for i in range(150)) for _ in range(40)]
    bad = [g[:300] + " " + " ".join("JUNK!!" for _ in range(60)) for g in good]
    x, counts = quality.passages(pa.array(good + bad))
    m = quality.fit(x, counts, np.array([1] * 40 + [0] * 40, np.float32))
    s = m.scores(pa.array([good[0], bad[0]]))
    assert s[0] > 0.5 > s[1]
    a = m.forward((x - m.mean) / m.scale, counts)["attention"]
    assert np.allclose(np.add.reduceat(a, np.concatenate([[0], np.cumsum(counts)[:-1]])), 1, atol=1e-5)


@pytest.mark.parametrize("op", [Q.op5_quality, Q.op7_toxicity])
def test_queries_return_every_document(spark, small, op):
    df = op(spark, small)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()


@pytest.fixture(scope="module")
def model():
    return L.fit([])


@pytest.mark.parametrize("family", L.FAMILIES)
def test_notices_are_recognised(model, family):
    for notice in L.NOTICES[family]:
        p = model.probabilities(L.grams_of(notice))
        assert L.FAMILIES[int(p[:-1].argmax())] == family and p[:-1].max() >= model.threshold


def brute(text, model):
    found = []
    for line in (text or "").split("\n"):
        g = L.grams_of(line)
        known = g & set(model.weights)
        if not known:
            continue
        p = model.probabilities(g)
        if p.argmax() == L.NONE:
            continue
        family = L.FAMILIES[int(p.argmax())]
        overlap = max(len(g & L.grams_of(n)) / len(g | L.grams_of(n)) for n in L.NOTICES[family])
        found.append(family if p.max() >= model.threshold and overlap >= L.CONFIRM else "unknown")
    return len(found), ",".join(sorted(set(found)))


def test_native_scan_equals_brute_force(frame, odd_texts):
    texts = odd_texts + [(20, "words\nReleased under the MIT License.\nmore"), (21, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (22, "Licensed under the Frobnicate License 7"), (23, "the reserved seats\nAll rights reserved."), (24, "x " * 5000 + "This work is licensed under the GNU General Public License, version 3.")]
    docs = frame(texts)
    m = L.train(L.paragraphs(L.marked_lines(docs)))
    got = L.scan_licences(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n_notices, r.families) for r in got], key=key) == sorted([(i, *brute(t, m)) for i, t in texts], key=key)
    families = {r.doc_id: r.families for r in got}
    assert families[20] == "mit" and families[21] == "apache,cc-by-nc"
    assert L.scan_licences(frame([])).count() == 0


def test_no_python_in_the_licence_plan(frame):
    plan = L.scan_licences(frame([(1, "Released under the MIT License.")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_negatives_of_the_licence_fit_are_whole_lines(frame, monkeypatch):
    """The marker stands behind 2,000 characters of its line."""
    line, seen = "word " * 600 + "and a permission slip for the school trip", []
    monkeypatch.setattr(L, "fit", seen.extend)
    L.train(L.paragraphs(L.marked_lines(frame([(1, "first\n" + line + "\nlast")]))))
    assert seen == [line] and L.grams_of(seen[0])


#: Phrasings that the notices do not hold, by family; and lines that are no notices.
PHRASINGS = [("mit", "MIT licensed, see the file."), ("mit", "Distributed under the terms of the MIT License"), ("mit", "License: MIT"), ("apache", "Available under the Apache License, Version 2.0 or later"), ("apache", "This software uses the Apache-2.0 license."), ("gpl", "You may copy it under the GNU General Public License version 3"), ("gpl", "Released under the GNU GPL, version 3"),
             ("lgpl", "Distributed under the GNU Lesser General Public License, version 2.1"), ("agpl", "Available under the GNU Affero General Public License"), ("bsd", "Distributed under the 3-Clause BSD License"), ("mpl", "Subject to the Mozilla Public License 2.0"), ("cc-by", "Shared under CC BY 4.0"), ("cc-by", "Available under the Creative Commons Attribution License"),
             ("cc-by-nc", "Shared under CC BY-NC 4.0"), ("public-domain", "This text is in the public domain."), ("proprietary", "Copyright 2021 Someone. All rights reserved.")]
OTHERS = ["The driver showed a licence and was let through.", "Permission to enter was not given.", "He reserved a table at the common room.", "The copyright debate went on for hours.", "An apache helicopter landed nearby.", "The old gnu stood by the river."]


def test_recall_on_other_phrasings(model):
    """What a fit on the notices alone makes of wordings it was not given; the share is in the README."""
    named = known = 0
    for family, line in PHRASINGS:
        p = model.probabilities(L.grams_of(line))
        named += p.argmax() != L.NONE
        known += p.argmax() == L.FAMILIES.index(family) and p.max() >= model.threshold
    wrong = sum(model.probabilities(L.grams_of(t)).argmax() != L.NONE and model.probabilities(L.grams_of(t))[:-1].max() >= model.threshold for t in OTHERS)
    print("threshold", model.threshold, "found", named, "named", known, "of", len(PHRASINGS), "false", wrong, "of", len(OTHERS))
    assert named >= 14 and known >= 14 and wrong == 0


def test_rows_keep_their_families_on_any_partitioning(frame):
    texts = [(i, ["no marker", "Released under the MIT License.", "Licensed under CC BY 4.0.", None, ""][i % 5]) for i in range(400)]
    got = {r.doc_id: r.family for r in L.scan_licences(frame(texts).repartition(7)).collect()}
    assert got == {i: [None, "mit", "cc-by", None, None][i % 5] for i, _ in texts}
