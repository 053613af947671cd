"""Resampling: weights are Poisson numbers, states add up to plain sums, intervals cover, permutations equal deals of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import agreement as A
from siltstone.operators import resampling as S


def test_weights_are_poisson_numbers():
    w = S.weights(np.arange(2000), S.seeds(3, 1000))
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.003
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15
    assert not (S.weights(np.arange(50), S.seeds(4, 1000)) == w[:50]).all()


def test_mixing_is_a_bijection():
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(65_537)
    assert len(np.unique(S.mixed(x))) == len(x) and S.mixed(x).max() < 1 << 32


@pytest.mark.parametrize("groups, parts", [(256, 1), (1, 6)])
def test_sums_equal_weighted_sums(spark, monkeypatch, groups, parts):
    monkeypatch.setattr(S, "GROUPS", groups)
    monkeypatch.setattr(S, "CELLS", 300)
    rows = [(f"q{i}", [None, "a", "b"][i % 3], i % 2, float(i), 1.0 if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, g string, h int, total double, weight double").repartition(parts)
    got = {(r.g, r.h, r.b): (r.total, r.weight) for r in S.resample_sums(df, "k", ["g", "h"], 9, 50).collect()}
    import hashlib

    w = S.weights(np.array([int(hashlib.md5(k.encode()).hexdigest()[:8], 16) for k, *_ in rows]), S.seeds(9, 50))
    for g in (None, "a", "b"):
        for h in (0, 1):
            mine = [i for i, r in enumerate(rows) if r[1] == g and r[2] == h]
            for b in (0, 17, 49):
                want = sum(w[i, b] * rows[i][3] for i in mine), sum(w[i, b] * (rows[i][4] or 0) for i in mine)
                assert got[g, h, b] == pytest.approx(want)
    assert S.resample_sums(df.filter("false"), "k", [], 9, 50).count() == 0
    assert S.resample_sums(df, "k", [], 9, 50).count() == 50


def test_intervals_cover_the_mean(spark):
    """About 95 of 100 intervals of samples with a known mean hold it."""
    rng = np.random.default_rng(7)
    rows = [(f"{g}-{i}", g, float(x), 1.0) for g in range(200) for i, x in enumerate(rng.exponential(2.0, 120))]
    df = spark.createDataFrame(rows, "k string, g int, total double, weight double")
    got = S.percentile_interval(S.resample_means(df, "k", ["g"], 5, 800), ["g"]).collect()
    held = sum(r.lo <= 2.0 <= r.hi for r in got)
    assert len(got) == 200 and 178 <= held <= 198


def test_kappas_of_resampled_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i // 3), "xyz"[rng.integers(3)], None if i % 17 == 0 else "xyz"[rng.integers(3)]) for i in range(240)]
    rows = [(q, a, a if b and rng.random() < 0.5 else b) for q, a, b in rows]
    df = spark.createDataFrame(rows, "q int, a string, b string").repartition(4)
    got = {r.b: r["mean"] for r in S.resample_kappas(df, "a", "b", "q", [], 2, 20).collect()}
    import hashlib

    w = S.weights(np.array([int(hashlib.md5(str(q).encode()).hexdigest()[:8], 16) for q in range(80)]), S.seeds(2, 20))
    for b in range(20):
        cells = np.zeros((3, 3))
        for q, x, y in rows:
            if x and y:
                cells["xyz".index(x), "xyz".index(y)] += w[q, b]
        n = cells.sum()
        pe = (cells.sum(0) * cells.sum(1)).sum() / n**2
        assert got[b] == pytest.approx((np.trace(cells) / n - pe) / (1 - pe))
    whole = A.cohen_kappa(df, "a", "b").first().kappa
    draws = sorted(r["mean"] for r in S.resample_kappas(df, "a", "b", "q", [], 2, 400).collect())
    assert draws[10] < whole < draws[390]
    one = spark.createDataFrame([(1, "x", "x")], "q int, a string, b string")
    assert all(r["mean"] is None for r in S.resample_kappas(one, "a", "b", "q", [], 2, 10).collect())


@pytest.mark.parametrize("n, first, second", [(30, 12, 9), (30, 25, 20), (7, 0, 3), (7, 7, 3), (1, 1, 0), (2, 1, 1), (5000, 2400, 100)])
def test_counts_are_hypergeometric(n, first, second):
    drawn = (np.arange(200_000) + 0.5) / 200_000
    got = S.hypergeometric(n, first, second, drawn)
    for k in range(max(0, first + second - n), min(first, second) + 1):
        want = math.comb(first, k) * math.comb(n - first, second - k) / math.comb(n, second) if n < 4000 else None
        if want is not None:
            assert abs((got == k).mean() - want) < 1e-4
    assert abs(got.mean() - first * second / n) < 0.01


def test_permutations_equal_deals_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], bool(rng.random() < 0.3 + 0.3 * (i % 2)), bool(rng.random() < 0.6)) for i in range(80)] + [("a", None, True)]
    df = spark.createDataFrame(rows, "s string, x boolean, y boolean").repartition(3)
    got = np.array([r.v for r in S.permuted_agreement(df, F.col("x"), F.col("y"), ["s"], 4, 4000).collect()])
    dealt = []
    x = {s: np.array([r[1] for r in rows if r[0] == s and r[1] is not None]) for s in "ab"}
    y = {s: np.array([r[2] for r in rows if r[0] == s and r[1] is not None]) for s in "ab"}
    for _ in range(4000):
        dealt.append(sum((x[s] == rng.permutation(y[s])).sum() for s in "ab") / 80)
    dealt = np.array(dealt)
    assert abs(got.mean() - dealt.mean()) < 0.005 and abs(got.std() - dealt.std()) < 0.004
    assert all(abs((got <= v).mean() - (dealt <= v).mean()) < 0.04 for v in np.unique(dealt))


def test_baseline_deals_every_row_anew(spark):
    """Every permutation is a row for each row, and has each stratum's values as often as they were."""
    rows = spark.createDataFrame([("a" if i % 3 else "b", f"t{i}", int(i % 4 == 0)) for i in range(30)], "prompt string, trace_id string, y int")
    dealt = S.permuted(rows, "y", ["prompt"], "trace_id", 5, 20).groupBy("b", "prompt").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    want = {r.prompt: (r.n, r.s) for r in rows.groupBy("prompt").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    assert len(dealt) == 40 and all((r.n, r.s) == want[r.prompt] for r in dealt)
