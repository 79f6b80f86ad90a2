import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import features, neighbours


def frames(spark, x, q):
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(10_000, None)], "b_id long, vec array<double>").repartition(5)
    return base, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)] + [(77_777, None)], "q_id long, vec array<double>")


def rows(df):
    return sorted((r.q_id, r.place, r.b_id, round(r.dist, 6)) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "even", "copies"])
def test_pruned_rows_are_those_of_all_pairs(spark, monkeypatch, kind):
    r = np.random.default_rng(8)
    x = {"clusters": r.normal(0, 0.05, (900, 6)) + r.normal(0, 3, (15, 6))[r.integers(0, 15, 900)], "even": r.random((300, 6)), "copies": np.repeat(r.random((20, 4)), 20, axis=0).round(1)}[kind]
    q = np.concatenate([x[::30] + 0.01, r.normal(0, 3, (5, x.shape[1]))])
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 7)
    base, asked = frames(spark, x, q)
    got, pairs = neighbours.nearest_pruned(asked, base, 5, n_pivots=15)
    want = features.nearest(asked.where("vec is not null"), base.where("vec is not null"), 5)
    assert rows(got) == rows(want)
    if kind == "clusters":
        assert pairs < 0.25 * len(x) * len(q), pairs


def test_fewer_rows_than_asked_and_none(spark):
    base, asked = frames(spark, np.array([[0.0, 1.0], [0.0, 2.0]]), np.array([[0.0, 0.0]]))
    got, _ = neighbours.nearest_pruned(asked, base, 5)
    assert rows(got) == [(0, 1, 0, 1.0), (0, 2, 1, 4.0)]
    got, pairs = neighbours.nearest_pruned(asked, base.where("vec is null"), 5)
    assert got.collect() == [] and pairs == 0


def test_ties_fall_by_id(spark):
    base = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50, 0, -1)] + [(99, [1.0, 2.5])], "b_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0, 9.0])], "q_id long, vec array<double>")
    got, _ = neighbours.nearest_pruned(q, base, 4)
    assert [x.b_id for x in sorted(got.collect(), key=lambda x: (x.q_id, x.place))] == [1, 2, 3, 4, 1, 2, 3, 4, 99, 1, 2, 3]


def test_pair_distances_are_made_in_blocks(spark):
    """In tasks of bounded pairs, not row by row behind a join; nulls and odd lengths as there, and all bits the same."""
    r = np.random.default_rng(3)
    v = [x.tolist() for x in r.normal(0, 1, (700, 5)).astype(np.float32)]
    v[3], v[4], v[140], v[141], v[640] = None, [1.0, None, 2.0, 0.0, 0.0], [1.0, 2.0], [], [0.5, 2.0]
    every = spark.createDataFrame(list(enumerate(v)), "a_id long, vec array<float>")
    a, b = every.where("a_id < 150"), every.select(F.col("a_id").cast("string").alias("b_id"), "vec").where("a_id % 7 <> 0")
    got = features.pair_distances(a, b, task_pairs=50_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and got.rdd.getNumPartitions() == -(-150 * 600 // 50_000)
    key = lambda t: (t[0], t[1])
    want = sorted(map(tuple, features.pair_distances(a, b, most=10).collect()), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want and len(want) == 90_000
    assert {t[2] is None for t in want if t[0] == 3 or t[1] in ("4", "640")} == {True, False}
    assert features.pair_distances(a, b.limit(0)).count() == features.pair_distances(a.limit(0), b).count() == 0
