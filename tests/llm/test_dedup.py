"""Near duplicates and repeated passages against brute force on small corpora."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from siltstone.llm import minhash_dedup as M
from siltstone.llm import queries as Q
from siltstone.llm import substring_dedup as S
from siltstone.llm.fm_index import FMIndex, Runs, WaveletMatrix
from siltstone.llm.textops import Words, flat, grams

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(pairs, percent=85):
    sets = {i: shingles(t) for i, t in pairs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def families(seed, n=12):
    """Texts in families of copies with few changed words, some far, some near the threshold, and chains."""
    rng, out = random.Random(seed), []
    for f in range(n):
        base = [f"f{f}w{rng.randrange(90)}" for _ in range(rng.choice([8, 30, 120, 300]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(frame, seed):
    pairs = families(seed)
    want, sizes = components(pairs)
    got = M.near_duplicates(frame(pairs)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(frame, odd_texts):
    got = M.near_duplicates(frame(odd_texts)).collect()
    assert len(got) == len(odd_texts)
    by_id = {r.doc_id: r for r in got}
    want, sizes = components(odd_texts)
    assert all(by_id[i].component_id == c and by_id[i].n_shingles == sizes[i] for i, c in want.items())
    assert by_id[None].component_id is None and by_id[None].kept
    assert [by_id[i].n_shingles for i in (3, 4, 5)] == [0, 0, 0]
    assert M.near_duplicates(frame([])).count() == 0


def test_copies_leave_one(frame):
    pairs = families(3)
    want, _ = components(pairs)
    kept = {r.doc_id for r in M.without_copies(frame(pairs)).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_sketches_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:950], rng.integers(0, 1 << 63, 50).astype(np.uint64)])
    s = M.odd_sketches(np.stack([M.signature(a), M.signature(b)]))
    unlike = int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum())
    assert unlike <= M.SKETCH_SLACK and abs(M.estimate(unlike) - 950 / 1050) < 0.12
    p = int(np.bitwise_count(M.parity(a) ^ M.parity(b)).sum())
    assert p <= 100


def test_equal_to_sql(spark, small, same_rows):
    same_rows(Q.op8_minhash_dedup(spark, small), Q.OP8_SQL)
    same_rows(Q.op9_substring_dedup(spark, small), Q.OP9_SQL)


def repeats(pairs, n=13):
    words = [(i, WORD.findall((t or "").encode())) for i, t in pairs]
    first = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [[f"p{k}x{rng.randrange(50)}" for _ in range(rng.choice([12, 13, 14, 40, 90]))] for k in range(8)]
    out = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [f"q{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))]
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot, size, load", [(S.HOT, S.INDEX_WORDS, S.SHARD_ANCHORS), (3, 50, S.SHARD_ANCHORS), (1000, 50, 5), (6, 50, 5)])
def test_repeats_equal_brute_force(frame, monkeypatch, hot, size, load):
    """Anchors searched by shard, by hash range, and shards of a document in several parts."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "INDEX_WORDS", size)
    monkeypatch.setattr(S, "SHARD_ANCHORS", load)
    pairs = passages(4)
    got = S.remove_repeats(frame(pairs)).collect()
    assert sorted(map(tuple, got)) == sorted(repeats(pairs))


def test_rows_of_any_plan_are_told_apart(spark, frame, tmp_path):
    """Two scans of one file united, rows multiplied by a join, filtered and partitioned rows."""
    pairs = passages(7)
    frame(pairs).coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    twice = d.join(spark.createDataFrame([(1,), (2,)], "k int"))
    key = lambda r: tuple(str(v) for v in r)
    for df, want in ((d, pairs), (d.filter("doc_id >= 4").unionByName(d.filter("doc_id < 4")), pairs), (twice, pairs * 2), (d.filter("doc_id % 3 > 0"), [p for p in pairs if p[0] % 3])):
        assert sorted(map(tuple, S.remove_repeats(df).collect()), key=key) == sorted(repeats(want), key=key)
        texts = {i: n for i, _, n, _ in repeats(want)}
        rewritten = S.rewrite_documents(df).collect()
        assert len(rewritten) == len(want) and all(len(WORD.findall(r.text.encode())) == len(WORD.findall(dict(pairs)[r.doc_id].encode())) - texts[r.doc_id] for r in rewritten)


def test_repeats_odd_rows(frame, odd_texts):
    key = lambda r: tuple(str(v) for v in r)
    got = [tuple(r) for r in S.remove_repeats(frame(odd_texts)).collect()]
    assert sorted(got, key=key) == sorted(repeats(odd_texts), key=key)
    assert S.remove_repeats(frame([])).count() == 0


def test_rewritten_documents(frame):
    base = " ".join(f"w{i}" for i in range(40))
    docs = frame([(1, base), (2, "mine  own\nwords"), (3, "before " + base + " behind")])
    got = {r.doc_id: (r.text, r.n_chars, r.split) for r in S.rewrite_documents(docs).collect()}
    assert got == {1: (base, len(base), "x"), 2: ("mine  own\nwords", 15, "x"), 3: ("before behind", 13, "x")}


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 37, 500)
    t = WaveletMatrix(v, 37)
    for c, i in zip(rng.integers(0, 37, 200), rng.integers(0, 501, 200), strict=True):
        assert t.rank(np.array([c]), np.array([i]))[0] == (v[:i] == c).sum()


def test_runs_and_compression():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 65, 1000):
        v = np.sort(rng.integers(0, max(1, n // 3), n))
        r = Runs(v)
        begin, end = r.around(np.arange(n))
        for i in range(n):
            same = np.flatnonzero(v == v[i])
            assert (begin[i], end[i]) == (same[0], same[-1] + 1)
        assert (r.number(np.arange(n)) == np.unique(v, return_inverse=True)[1]).all()
    words = rng.integers(0, 5000, 60_000).astype(np.uint64)
    index = FMIndex(list(words.reshape(600, 100)), np.arange(600), 13)
    # A plain suffix array with ranges and owners would take 32 bytes a word.
    assert index.nbytes / len(words) < 8


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(20):
        seqs = [rng.integers(1, 5, rng.integers(1, 60)).astype(np.uint64) for _ in range(6)]
        owners, depth = rng.integers(0, 50, 6), int(rng.integers(3, 8))
        ix = FMIndex(seqs, owners, depth)
        query = np.concatenate([np.append(ix.symbols(rng.integers(1, 6, 80).astype(np.uint64)), 0), np.append(ix.symbols(seqs[0]), 0)])
        length, owner = ix.matching_statistics(query, lane=16)
        texts = [ix.symbols(s) for s in seqs]
        for p in range(len(query)):
            best, least = 0, np.iinfo(np.int64).max
            for size in range(1, depth + 1):
                part = query[p : p + size]
                if len(part) < size or (part == 0).any():
                    break
                hits = [o for s, o in zip(texts, owners, strict=True) if any((s[i : i + size] == part).all() for i in range(len(s) - size + 1))]
                if not hits:
                    break
                best, least = size, min(hits)
            assert length[p] == best and (best < depth or owner[p] == least)


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b  a", None, "", "ab a\tb", "x" * 100000]
    buf, off = flat(pa.array(texts))
    w = Words(buf, off)
    assert w.counts.tolist() == [3, 0, 0, 3, 1]
    h = w.hash
    assert h[0] == h[2] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4
    assert len(grams(h, 3)) == len(h) - 2
