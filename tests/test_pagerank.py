import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import graph, pagerank
from tagweave.operators.learn import edges


def frame(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int, w double")


@pytest.mark.parametrize("dangling", [False, True])
def test_push_follows_the_mass(spark, dangling):
    r = np.random.default_rng(4)
    rows = [(int(a), int(b), float(x)) for a, b, x in zip(r.integers(0, 40, 150), r.integers(0, 40, 150), r.random(150) + 0.1)]
    rows += [(i, (i + 1) % 40, 1.0) for i in range(40)]
    if dangling:
        rows = [x for x in rows if x[0] not in (3, 7, 20)] + [(3, 4, 0.0)]
    e = frame(spark, rows).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    restarts = spark.createDataFrame([(0,), (3,), (11,), (999,)], "restart int")
    exact = {(x.restart, x.node): x.p for x in graph.ppr_exact(e, restarts).collect()}
    for threshold in (1e-2, 1e-6):
        placed, left = pagerank.push(e, restarts, threshold=threshold)
        got, rest = {(x.restart, x.node): x.p for x in placed.collect()}, {x.restart: x.left for x in left.collect()}
        assert set(rest) == {0, 3, 11}
        for (s, n), p in exact.items():
            assert -1e-12 <= p - got.get((s, n), 0.0) <= rest[s] + 1e-12
        for s in rest:
            assert sum(p for (a, _), p in got.items() if a == s) + rest[s] == pytest.approx(1)
    assert max(rest.values()) < 1e-4


def test_push_touches_what_it_reaches(spark):
    e = frame(spark, [(i, i + 1, 1.0) for i in range(500)] + [(500, 0, 1.0)])
    placed, _ = pagerank.push(e, spark.createDataFrame([(0,)], "restart int"), threshold=1e-3)
    assert placed.count() <= 12


def graphs(n_graphs=2, n=7):
    r = np.random.default_rng(9)
    out = {}
    for k in range(n_graphs):
        g = r.random((n, n)) * (r.random((n, n)) < 0.6)
        np.fill_diagonal(g, 0)
        g[k + 1] = 0  # goes everywhere alike
        o = edges.stochastic(r.random((n, n)) * (r.random((n, n)) < 0.7))
        out[f"g{k}"] = (g, o)
    return out


def test_gradient_by_joins_is_that_of_the_inverse(spark):
    every = graphs()
    e = spark.createDataFrame([(k, i, j, float(g[i, j])) for k, (g, _) in every.items() for i in range(7) for j in range(7) if g[i, j] or (i + j) % 5 == 0], "graph string, src int, dst int, w double")
    o = spark.createDataFrame([(k, i, j, float(v[i, j])) for k, (_, v) in every.items() for i in range(7) for j in range(7) if v[i, j]], "graph string, restart int, node int, o double")
    value, slopes = pagerank.loss_and_gradient(e, o, 0.5, 0.1, tol=1e-9)
    values = {x.graph: x.value for x in value.collect()}
    for k, (g, ob) in every.items():
        f, grad = edges.objective(g, ob, 0.5, 0.1)
        assert values[k] == pytest.approx(f, abs=1e-9)
        for x in slopes.where(F.col("graph") == k).collect():
            assert x.slope == pytest.approx(grad[x.src, x.dst], abs=1e-8)


def test_three_nodes_by_hand(spark):
    """A ring of three: p of restart 0 is (1, a, a a) (1 - a) / (1 - a^3)."""
    e = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 2, 0, 1.0)], "graph string, src int, dst int, w double")
    p = {(x.restart, x.node): x.x for x in pagerank.all_restarts(e, 0.5).collect()}
    assert [p[0, i] for i in range(3)] == [pytest.approx(x / 1.75) for x in (1.0, 0.5, 0.25)]


def test_wide_graphs_are_learned_whole(spark):
    r = np.random.default_rng(2)
    rows = [(g, a, b, float(r.random())) for g in ("x", "y") for a in "abcdef" for b in "abcdef" if a < b] + [("z", "a", "b", 1.0)]
    known = spark.createDataFrame([("a", "b", 0.6), ("c", "d", 0.3)], "w1 string, w2 string, weight double")
    pairs = spark.createDataFrame(rows, "wnid string, w1 string, w2 string, w double")
    dense = {(x.wnid, x.w1, x.w2): x for x in edges.fit_edges(pairs, known).collect()}
    wide = {(x.wnid, x.w1, x.w2): x for x in edges.fit_edges(pairs, known, dense_words=3, max_iter=2, tol=1e-4).collect()}
    assert set(dense) == set(wide) and len(wide) == 31
    for k, x in wide.items():
        assert x.start == pytest.approx(dense[k].start, abs=1e-3) and x.end <= x.start + 1e-9
        assert (0.6 if k[1:] == ("a", "b") else 0.3 if k[1:] == ("c", "d") else 0.0) - 1e-9 <= x.weight <= 1 + 1e-9
    assert all(wide[g, "a", "b"].end < wide[g, "a", "b"].start for g in "xy")
