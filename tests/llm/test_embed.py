import numpy as np
import pytest

from tagweave.llm import embed_dedup as ed


def slow(rows, t=0.98):
    def unit(v):
        if v is None or any(c is None for c in v):
            return None
        x = np.array(v, float)
        top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0
        return x / top / np.linalg.norm(x / top) if top else None

    u = [unit(v) for _, v, _ in rows]
    link = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= t:
                link[i].add(j)
                link[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in link[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def vectors(n=400, dim=16, seed=0, spread=0.03):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((30, dim))
    rows = []
    for i in range(n):
        v = centres[int(30 * r.random() ** 3)] + spread * r.standard_normal(dim) * r.integers(0, 8)
        rows.append((i, v.astype(np.float32).tolist(), int(r.integers(0, 3))))
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(20)]  # copies
    rows += [(n + 30, [2 * x for x in rows[5][1]], rows[5][2]), (n + 31, None, 1), (n + 32, [0.0] * dim, 1), (n + 33, [float("nan")] * dim, 1)]
    rows += [(n + 34, [1.0, None], 1), (n + 35, rows[6][1], None), (n + 36, [], 0), (n + 37, [1.0, 0.0], 1), (n + 38, [1.0, 0.01], 1), (n + 39, [float("inf")] * dim, 0)]
    return rows


@pytest.mark.parametrize("block", [2000, 30])
def test_matches_brute_force(spark, monkeypatch, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, unit string, cell string").repartition(4)
    got = ed.near_vectors(df, block_rows=block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == slow(rows)


def test_cells_lose_no_link():
    """With centroids, each linked pair meets in the home cell of both."""
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 12))
    x = np.concatenate([x, x + 0.02 * r.standard_normal(x.shape), x + 0.05 * r.standard_normal(x.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = ed.spherical_kmeans(x, 9)
    row, cell, home = ed.visits(x, c, np.sqrt(2 - 2 * 0.98))
    at = [set(cell[row == i].tolist()) for i in range(len(x))]
    own = {int(i): int(k) for i, k, h in zip(row, cell, home) if h}
    i, j = np.nonzero((x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool))
    assert len(i) > 300
    assert all(own[b] in at[a] for a, b in zip(i.tolist(), j.tolist()))


def test_divided_labels(spark):
    """Two levels of cells in each label, small labels too; no link is lost."""
    rows = vectors(2600, 16, 3, 0.02)[:2600] + [(9000 + i, v, 7) for i, v, _ in vectors(150, 16, 5, 0.02)[:150]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    units = ed.unit_vectors(df.selectExpr("vec_id as row_id", "vec_id", "cast(embedding as array<double>) as vector", "cast(label as string) as label"))
    reps = units.where("key is not null").selectExpr("part", "row_id as rep", "1L as n", "unit")
    cells = ed.divided(reps, 0.98, cell_rows=60, shared_bytes=2000).collect()
    assert max(r.cell.count("/") for r in cells) > 1 and len({r.cell for r in cells}) > 20
    home = [r.rep for r in cells if r.home]
    assert sorted(home) == sorted(r[0] for r in rows)
    assert sorted([tuple(r) for r in ed.near_vectors(df, cell_rows=60).collect()], key=str) == slow(rows)


def test_null_and_repeated_ids(spark):
    """Rows without an id link others; different vectors with one id stay apart."""
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [(4, at(0), 1), (None, at(9), 1), (2, at(18), 1), (7, at(100), 1), (7, at(150), 1), (8, at(105), 1), (9, at(155), 1), (7, at(103), 1), (None, at(250), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted([tuple(r) for r in ed.near_vectors(df).collect()], key=str)
    assert got == slow(rows)
    assert (4, 1, 2, False) in got and (None, 2, 2, False) in got and (None, 0, None, True) in got


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [2e200, 1e198], 1), (3, [1e-200, 0.0], 1), (4, [0.0, 5e-324], 1), (5, [1.7e308, 1.7e308], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted([tuple(r) for r in ed.near_vectors(df).collect()], key=str) == slow(rows)


def test_compared_pairs_follow_the_rows():
    """Pairs within cells for each row stay about the same when there are eight times as many clustered rows."""
    def pairs(n):
        r = np.random.default_rng(6)
        x = np.repeat(r.standard_normal((n // 10, 32)), 10, 0) + 0.02 * r.standard_normal((n // 10 * 10, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        todo, total = [(x, np.ones(len(x), bool))], 0
        while todo:
            v, home = todo.pop()
            c = ed.centroids_of(v, len(v), 0.2) if len(v) > 300 else None
            if c is None:
                total += int(home.sum()) * len(v)
                continue
            row, cell, own = ed.visits(v, c, 0.2)
            todo += [(v[row[cell == k]], own[cell == k] & home[row[cell == k]]) for k in range(len(c))]
        return total / n

    assert pairs(16_000) < 3 * pairs(2000)


def test_no_centroids_at_all(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_vectors(df).collect() == []
