import numpy as np
import pytest

from tagweave.operators import features, lowrank


def matrix(spark, a):
    return spark.createDataFrame([(f"c{i:03}", f"f{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "concept string, feat string, value double").repartition(3)


def sample(n=60, m=45, seed=1):
    r = np.random.default_rng(seed)
    return (r.random((n, m)) * (r.random((n, m)) < 0.3)).round(3) + np.outer(r.random(n), r.random(m) < 0.2)


def test_factors_come_near_the_best_of_their_rank(spark):
    a = sample()
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    exact = np.linalg.svd(unit, compute_uv=False)
    u, s = lowrank.factors(matrix(spark, a), 8)
    assert s == pytest.approx(exact[:8], rel=1e-3)
    got = {r.k: np.array(r.y) for r in u.collect()}
    y = np.array([got[f"c{i:03}"] for i in range(len(a))])
    assert np.abs(y.T @ y - np.eye(8)).max() < 1e-9
    miss = np.linalg.norm(unit - y @ (y.T @ unit), 2)
    assert exact[8] - 1e-9 <= miss <= 1.02 * exact[8]


def test_similarity_is_that_of_the_whole_decomposition(spark):
    a = sample(30, 12, 2)  # rank and what a block has beyond it span all: exact
    want = {(r.c1, r.c2): r.sim for r in features.svd_similarity(matrix(spark, a), 5).collect()}
    got = {(r.c1, r.c2): r.sim for r in lowrank.svd_similarity(matrix(spark, a), 5).collect()}
    assert {k for k in want if want[k] > 1e-9} == {k for k in got if got[k] > 1e-9}
    assert all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items() if v > 1e-9)


def test_blocks_of_pairs_and_small_matrices(spark, monkeypatch):
    r = np.random.default_rng(3)
    y = r.standard_normal((50, 3))
    monkeypatch.setattr(lowrank, "BLOCK", 7)
    df = spark.createDataFrame([(i, [float(v) for v in y[i]]) for i in range(50)], "k long, y array<double>")
    got = {(x.c1, x.c2): x.sim for x in lowrank.similarities(df).collect()}
    s = y @ y.T
    assert got == {(i, j): pytest.approx(s[i, j]) for i in range(50) for j in range(i + 1, 50) if s[i, j] > 1e-12}
    one = matrix(spark, np.array([[2.0, 0.0], [3.0, 0.0], [0.0, 0.0]]))
    assert [(x.c1, x.c2, round(x.sim, 9)) for x in lowrank.svd_similarity(one, 4).collect()] == [("c000", "c001", round(0.5 * np.sqrt(2), 9))]
    assert lowrank.svd_similarity(matrix(spark, np.zeros((2, 2))), 4).collect() == []
