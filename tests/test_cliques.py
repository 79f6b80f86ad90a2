import itertools
import random

import pytest

from tagweave.operators import graph


def plain(edges, pairs):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for u, v in {tuple(sorted(p)) for p in pairs}:
        if v not in near.get(u, ()):
            continue
        common = sorted(near[u] & near[v])
        for n in range(len(common), 0, -1):
            found = [c for c in itertools.combinations(common, n) if all(y in near[x] for x, y in itertools.combinations(c, 2))]
            if found:
                out[u, v] = ",".join(sorted([u, v, *min(found)]))
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cliques_are_those_of_all_subsets(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(16)]
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if r.random() < 0.5]
    pairs = [(b, a) for a, b in itertools.combinations(names, 2)]
    t = spark.createDataFrame([("R", a, b) for a, b in edges], "rel string, w1 string, w2 string")
    got = {(x.w1, x.w2): x.members for x in graph.cliques(t, spark.createDataFrame(pairs, "w1 string, w2 string")).collect()}
    assert got == plain(edges, pairs)


def test_nodes_have_few_later_neighbours(spark):
    """A star of stars: hubs have many neighbours, but hardly any that peel off later."""
    rows = [("R", "hub1", "hub2")] + [("R", h, f"leaf{i}") for h in ("hub1", "hub2") for i in range(2_000)]
    t = spark.createDataFrame(rows, "rel string, a string, b string")
    both = t.union(t.select("rel", "b", "a"))
    when = {x.a: x.round for x in graph.peeling_order(both).collect()}
    assert len(when) == 2_002 and when["leaf7"] < when["hub1"]


def test_a_pair_of_hubs_ends(spark):
    """Ten thousand common neighbours, linked in a ring: no group of their squares."""
    n = 10_000
    rows = [("R", "a", "b")] + [("R", h, f"x{i:05}") for h in "ab" for i in range(n)] + [("R", f"x{i:05}", f"x{(i + 1) % n:05}") for i in range(n)]
    t = spark.createDataFrame(rows, "rel string, w1 string, w2 string")
    (got,) = graph.cliques(t, spark.createDataFrame([("b", "a")], "w1 string, w2 string")).collect()
    assert (got.size if not callable(got.size) else got["size"]) == 4 and got.members == "a,b,x00000,x00001"
