"""Centroid clustering: equal to brute force in plain integers, bounds that hold, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from siltstone.llm import kmeans as K
from siltstone.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string, codes string, square string"


def brute(rows, centroids, rounds, components):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in order[:centroids]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        now = assign()
        for k in range(len(c)):
            mine = [v for (_, v), (_, at) in zip(kept, now, strict=True) if at == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    now = assign()
    inertia = sum(d for d, _ in now)
    within = {k: sum(d for d, at in now if at == k) for k in range(len(c))}
    return [(i, k, d, within[k], inertia, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, now, strict=True)]


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


def check(spark, rows, centroids=5, rounds=3, components=16, parts=3):
    df = spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(parts)
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in K.cluster_vectors(df, centroids, rounds, components).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, centroids, rounds, components), key=key)
    return got


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(16) * scale + (i % 4)).astype(np.float32).tolist()) for i in range(300)]
    check(spark, rows)


def test_odd_rows_and_ties(spark):
    one, two = [0.5] * 16, [-0.5] * 16
    rows = [(1, one), (1, one), (2, one), (3, two), (None, two), (4, None), (5, []), (6, [None] + one[1:]), (7, [float("nan")] + one[1:]), (8, [float("inf")] + one[1:]), (9, one + one), (10, [0.0] * 16)]
    assert len(check(spark, rows)) == 6
    assert len(check(spark, rows, centroids=40)) == 6
    assert check(spark, []) == [] and check(spark, [(4, None), (5, [])]) == []


def test_a_hot_vector_in_many_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [0.25] * 16) for i in range(200)] + [(1000 + i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(100)]
    check(spark, rows, parts=7)


def test_too_far_components_stop_the_job(spark):
    with pytest.raises(Exception, match="beyond"):
        K.cluster_vectors(spark.createDataFrame([(1, [1e9] * 16)], "vec_id long, embedding array<double>"), 2, 1, 16).collect()


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (40, 64))
    x = centres[rng.integers(40, size=2000)] + rng.integers(-60, 60, (2000, 64))
    for shift in (0, 3, 6):
        codes, squares, left = K.compress(np.clip(x, -127 << shift, 127 << shift), shift)
        y = np.clip(x, -127 << shift, 127 << shift)
        cluster, best, taken = K.nearest(y, codes, squares, left, shift, centres)
        whole = ((y[:, None, :] - centres[None]) ** 2).sum(2)
        assert (best == whole.min(1)).all() and (cluster == whole.argmin(1)).all()
        assert taken < whole.size / (10 if shift < 6 else 2)


def test_query_equals_sql(spark, small, same_rows):
    same_rows(Q.op13_centroid_clustering(spark, small), Q.OP13_SQL)
