"""Results and work that only larger tables show: nothing outside a hierarchy, repeated words, many rows a task."""

import threading

import numpy as np
import pytest
import pytest
from pyspark.sql import functions as F

from tagweave.operators import hierarchy, stats
from tagweave.operators.learn import svm
from tagweave.plans import QUERIES, SQL
from tagweave.plans.registry import Tables
from tagweave.session import parts_for
from tests.harness import both


def test_share_of_a_group_whose_tags_are_all_inside_is_null(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2)], "wnid string, tag string, cnt long")
    got = stats.outside_share(counts, spark.createDataFrame([("x",)], "word string"))
    assert {tuple(r) for r in got.collect()} == {("a", 0.25, "y"), ("b", None, "")}


def test_records_join_each_word_once(spark):
    """4000 leaves near a concept of 200,000 repeated words: 800 million rows unless words are made distinct first."""
    leaf = F.concat(F.lit("s"), "id")
    nodes = spark.createDataFrame([("r",), ("a",)], "wnid string")
    edges = spark.createDataFrame([("r", "a")], "parent string, child string").union(spark.range(4000).select(F.lit("a"), leaf))
    words = spark.range(200_000).select(F.lit("a").alias("wnid"), F.concat(F.lit("w"), F.col("id") % 5).alias("word"))
    counts = spark.createDataFrame([("a", "w1", 2), ("a", "x", 1), ("s7", "w2", 1), ("s7", "y", 1), ("r", "w3", 1)], "wnid string, tag string, cnt long")
    late = threading.Timer(40, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = hierarchy.concept_records(nodes, edges, hierarchy.closure(edges), words, counts).collect()
    finally:
        late.cancel()
    assert sorted(map(tuple, got)) == [("a", 1, 1, 4000, "", 2, 1), ("r", 0, 0, 4001, "a", 1, 0)]


def test_parts_follow_the_rows(spark):
    assert parts_for(spark, 1000) is None
    assert parts_for(spark, 36_000_000) == 240 and parts_for(spark, 216_000_000) == 1440


def test_tags_and_counts_are_dealt_to_parts(spark, sf, monkeypatch):
    """As for large tables, with neither parts nor customers small enough to be broadcast."""
    monkeypatch.setattr("tagweave.plans.registry.small", lambda df: df)
    monkeypatch.setattr(Tables, "parts", 30)
    t = Tables(spark, sf)
    assert t.doc_tags.rdd.getNumPartitions() == t.img_tags.rdd.getNumPartitions() == t.raw.select("doc_id", "raw_tag").distinct().rdd.getNumPartitions() == 30
    got, want = both(spark, sf, lambda s, d: Tables(s, d).counts, SQL["a04_users_of_tags"])
    assert got == want


@pytest.mark.parametrize("task", svm.TASKS)
def test_more_support_rows_than_one_place_holds(spark, task):
    """Blocks of weights reach the optimum that the whole problem in memory has."""
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (240, 3))
    y = (r.random(240) < 0.4).astype(float) if "classify" in task else np.sin(x.sum(1))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(240)], "id long, vec array<double>, label double")
    settings = dict(nu=0.35, gamma=0.4, target=None if task == "one_class" else "label")
    got = svm.optimum(df, task, max_support=20, **settings)
    assert got["rows"] == 240 and got["residual"] <= 1e-4 and got["balance"] < 1e-6
    state, _ = svm.decompose(df, task, block=120, **settings)
    whole = svm.KernelMachine(1.0, "rbf", 0.4, task, nu=0.35).fit(x, y)
    f = np.array([v.f for v in state.orderBy("id").collect()])
    want = whole.machine.decide(x) * whole.machine.scale
    assert f - f.mean() == pytest.approx(want - want.mean(), abs=2e-2)


@pytest.mark.parametrize("task", svm.TASKS)
def test_most_rows_support_and_some_are_near_copies(task):
    """Far more weights than a block holds, between their bounds and tied by near copies: the optimum is that of the whole problem in memory."""
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (300, 16))
    x[200:] = x[:100] + r.normal(0, 0.02, (100, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = (np.arange(300) * 7 % 10 < 5).astype(float) if "classify" in task else np.arange(300) * 7 % 10 / 10
    p, k = svm.problem(task, y, nu=0.3), svm.kernel(x, x, "rbf", 1.0)
    steps = svm.descend(p, x, "rbf", 1.0, [np.array([i, 200 + i]) for i in range(100)], np.ones(300), block=20)
    w = next(steps)
    with pytest.raises(StopIteration) as end:
        while True:
            w = steps.send(k @ w)
    a, slope, products = end.value.value
    assert svm._gap(p, a, slope) <= 1e-4 and svm._balance(p, a, task, 300, int((y > 0).sum()), 0.3, 1.0) < 1e-6 and products < 5000
    f = np.bincount(p.row, p.sign * a, 300) @ k
    b, _ = svm.solve(p, k, 1e-5)
    assert np.abs(f - np.bincount(p.row, p.sign * b, 300) @ k).max() < 5e-3


ON_COUNTS = [
    "a09_percentages", "a18_tag_vectors", "l06_features_added", "l06_features_side_by_side", "n06_entropy", "j04_concepts_with_counts",
    "j06_index_pairs", "e08_overlap_of_top_tags", "w09_top_k_in_group", "o02_top_tags_of_concepts", "n03_informativeness", "l10_weights_of_a_concept",
]


@pytest.fixture
def many_shuffle_partitions(spark):
    """More than the parts; adaptive execution joins them to one a core."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_whatever_the_shuffle_partitions(spark, many_shuffle_partitions):
    assert parts_for(spark, 1000) is None
    assert parts_for(spark, 3_600_000) == 24


@pytest.mark.parametrize("name", ON_COUNTS)
def test_queries_on_counts_are_dealt_to_parts(spark, sf, monkeypatch, many_shuffle_partitions, name):
    monkeypatch.setattr("tagweave.plans.registry.parts_for", lambda s, rows: parts_for(s, rows, 200))
    dealt = f", {-(-Tables(spark, sf).lineitem.count() // 200)}), REPARTITION_BY_NUM"
    plans = []

    def query(s, d):
        plans.append(QUERIES[name](s, d))
        return plans[0]

    got, want = both(spark, sf, query, SQL[name])
    assert got == want
    assert dealt in plans[0]._jdf.queryExecution().executedPlan().toString()
