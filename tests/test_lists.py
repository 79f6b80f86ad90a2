import random

import pytest

from tagweave.operators import evaluate as ev
from tagweave.operators import features


def trapezoids(labels):
    """Area through the first rank, the hits and the last one, segment by segment."""
    n, m = len(labels), sum(labels)
    if not m or m == n:
        return None
    points, tp = [], 0
    for k, y in enumerate(labels, 1):
        tp += y
        if y or k in (1, n):
            points.append(((k - tp) / (n - m), tp / m))
    return sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))


def test_areas_are_sums_over_hits(spark):
    r = random.Random(4)
    lists = {f"l{i}": [int(r.random() < p) for _ in range(r.randint(1, 40))] for i, p in enumerate([0.1, 0.3, 0.5, 0.9] * 10)}
    lists |= {"hot": [int(r.random() < 0.2) for _ in range(4000)], None: [1, 0, 1], "none": [0, 0, 0], "all": [1, 1], "last": [0, 0, 1], "first": [1, 0, 0]}
    rows = [(g, f"i{k:05}", float(-k // 3), y) for g, ys in lists.items() for k, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "g string, id string, score double, y int").repartition(7)
    got = {x.g: x for x in ev.rank_metrics(df, "score", "y", "id", ["g"]).collect()}
    assert set(got) == set(lists)
    for g, ys in lists.items():
        want = trapezoids(ys)
        assert got[g].n == len(ys) and got[g].npos == sum(ys)
        assert got[g].auc is None if want is None else got[g].auc == pytest.approx(want), g
    one = ev.rank_metrics(df.where("g = 'hot'"), "score", "y", "id").first()
    assert one.auc == pytest.approx(trapezoids(lists["hot"])) and one.ap == pytest.approx(got["hot"].ap)


def test_a_list_of_most_rows_is_split(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, 'b', 'a') g", "id", "-id score", "cast(id % 7 = 0 as int) y")
    r = ev.ranked(df, "score", "y", "id", ["g"])
    a = r.where("g = 'a'").orderBy("k").collect()
    assert [x.k for x in a] == list(range(1, 18_001)) and [x.id for x in a[:3]] == [1, 2, 3]
    assert a[-1].tp == a[0].npos == sum(x.y for x in a)


def test_predictions_of_odd_rows(spark):
    import numpy as np

    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [0.0, 1.0])], "img_id string, vec array<double>")
    got = features.predict(df, np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]]), ["x", "y", "z"], cells=3).collect()
    assert sorted(map(tuple, got)) == [("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 4.0), ("c", "x", 0.0), ("c", "y", 1.0), ("c", "z", 1.0)]


def test_normal_draws(spark):
    import numpy as np

    from tagweave.operators import sampling

    mean, cov = [1.0, -2.0, 0.5], np.array([[2.0, 0.5, 0.1], [0.5, 1.0, -0.3], [0.1, -0.3, 0.7]])
    df = spark.range(20_000)
    x = np.array([list(r)[1:] for r in sampling.gaussian_rows(df, "id", mean, cov, 3).collect()])
    assert np.cov(x.T) == pytest.approx(cov, abs=0.06) and x.mean(0) == pytest.approx(mean, abs=0.04)
    again = sampling.gaussian_rows(df.repartition(7), "id", mean, cov, 3).orderBy("id").limit(3).collect()
    assert [list(r)[1:] for r in again] == [pytest.approx(v) for v in x[:3].tolist()]
    other = sampling.gaussian_rows(df, "id", mean, cov, 4).first()
    assert list(other)[1:] != pytest.approx(x[0].tolist())
