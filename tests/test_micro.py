"""Hand-computed cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave import functions as fn
from tagweave.operators import cooc, evaluate, features, graph, hierarchy, normalize, sampling, stats
from tagweave.operators.learn import bilinear, edges, levels, svm
from tagweave.operators.learn.minimize import gaussian_sample, minimize_box, paired_t, settled


def test_norm_tags_readmits_extra_words(spark):
    d = spark.createDataFrame([("cats", "cat", 0), ("the", "the", 1)], "string string, word string, is_stopword int")
    extra = spark.createDataFrame([("the",), ("nyc",)], "word string")
    tags = spark.createDataFrame([("cats",), ("the",), ("nyc",), ("zzz",), ("Cats",)], "raw_tag string")
    got = [r.tag for r in normalize.norm_tags(tags, d, extra).collect()]
    assert sorted(got) == ["cat", "nyc", "the"]


def test_bigrams(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "a"), (2, "a"), (3, None)], "doc_id int, tag string")
    want = {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    for most in (None, 2, 0):
        assert {tuple(r) for r in cooc.bigrams(d, max_tags=most).collect()} == want


def test_merge_equals_whole(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("tag"))
    whole = cooc.unigrams(d)
    shards = [cooc.unigrams(d.where(F.col("doc_id") % 3 == k)) for k in range(3)]
    merged = cooc.merge_counts(*shards, keys=["tag"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_mutual_information(spark):
    d = spark.createDataFrame([(4, 2, 2, 2), (4, 2, 2, 1), (4, 2, 2, 0), (4, 4, 4, 4)], "n int, x int, y int, xy int")
    got = [r[0] for r in d.select(fn.binary_mi("n", "x", "y", "xy")).collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0, 0.0])


def test_mutual_information_is_symmetric_and_not_negative(spark):
    r = np.random.default_rng(0)
    rows = []
    for _ in range(200):
        n = int(r.integers(2, 60))
        a, b = r.integers(0, 2, n), r.integers(0, 2, n)
        rows.append((n, int(a.sum()), int(b.sum()), int((a & b).sum())))
    d = spark.createDataFrame(rows, "n int, x int, y int, xy int")
    for p, q in d.select(fn.binary_mi("n", "x", "y", "xy"), fn.binary_mi("n", "y", "x", "xy")).collect():
        assert p >= -1e-12 and p == pytest.approx(q)


def test_strict_cap_with_ties(spark):
    d = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 3)], "tag string, freq int")
    assert [r.tag for r in normalize.strict_cap(d, 3).collect()] == ["a"]
    assert normalize.strict_cap(d, 9).count() == 4


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", "y", 9), ("p", "q", 3)], "w1 string, w2 string, f int")
    b = spark.createDataFrame([("x", "y", 0.9), ("k", "l", 0.1)], "w1 string, w2 string, s double")
    got = {r.w1: r for r in stats.rank_fusion(a, b, ["w1", "w2"], "f", "s").collect()}
    assert (got["x"].r, got["x"].novelty) == (1.0, 0.5)
    assert got["p"].r == -1 and got["p"].ib == -1


def test_rank_percent(spark):
    d = spark.createDataFrame([("a", 30, 0.1), ("b", 20, 0.3), ("c", 10, 0.2)], "tag string, cnt int, s double")
    got = {r.tag: r for r in stats.rank_percent(d, "tag", "cnt", "s").collect()}
    assert [got[k].cnt_prc for k in "abc"] == pytest.approx([1, 2 / 3, 1 / 3])
    assert [got[k].infm_prc for k in "abc"] == pytest.approx([1 / 3, 1, 2 / 3])


def test_numbered_is_gapless(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = stats.numbered(d, "v").collect()
    assert all(r.v == r.pos and r.n == 1000 for r in got)


def test_rank_metrics_by_hand(spark):
    d = spark.createDataFrame([(1, 4.0, 1), (2, 3.0, 0), (3, 2.0, 1), (4, 1.0, 0)], "id int, s double, y int")
    for by in (None, ["g"]):
        m = evaluate.rank_metrics(d.withColumn("g", F.lit(1)), "s", "y", "id", by, depth=2).first()
        assert m.ap == pytest.approx(5 / 6) and m.p_at_d == 0.5 and m.epr == 0.5
        assert m.f1 == pytest.approx(0.8) and m.auc == pytest.approx(0.875)
        assert (m.prior, m.npos, m.n) == (0.5, 2, 4)


def test_rank_metrics_without_hits(spark):
    d = spark.createDataFrame([(1, 4.0, 0), (2, 3.0, 0)], "id int, s double, y int")
    m = evaluate.rank_metrics(d, "s", "y", "id").first()
    assert m.ap is None and m.npos == 0


def test_labels_must_not_overlap(spark):
    with pytest.raises(ValueError):
        evaluate.clean_labels(spark.range(1), "id", [1], [1])


def test_dispersion(spark):
    c = spark.createDataFrame([("n1", "t", 2), ("n2", "t", 1), ("n3", "t", 1), ("n1", "u", 5)], "wnid string, tag string, cnt int")
    s = spark.createDataFrame([("n1", "n2", 0.5), ("n1", "n3", 0.25), ("n2", "n3", 1.0)], "wn1 string, wn2 string, sim double")
    got = {r.tag: r for r in stats.dispersion(c, s).collect()}
    assert got["t"].dispersion == pytest.approx(0.5) and got["u"].dispersion == 0.0 and got["t"].n_groups == 3


def test_detector_pooling(spark):
    d = spark.createDataFrame([(1, "a", i, c) for i, c in enumerate((0.9, 0.6, 0.3, 0.1))] + [(1, "b", i, c) for i, c in enumerate((0.4, 0.2))], "img_id int, obj string, det_no int, conf double")
    got = {r.obj: r.pooled for r in features.pool_detections(d).collect()}
    assert got == {"a": pytest.approx(0.6), "b": 0.4}


def test_pagerank_by_hand(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src int, dst int, w double")
    r = spark.createDataFrame([(1,)], "restart int")
    want = {1: pytest.approx(2 / 3, abs=1e-6), 2: pytest.approx(1 / 3, abs=1e-6)}
    assert {x.node: x.p for x in graph.ppr_exact(e, r).collect()} == want
    assert {x.node: x.p for x in graph.ppr(e, r, max_iter=40, tol=1e-9).collect()} == want


def test_pagerank_of_dangling_rows_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 1.0), (4, 1, 1.0), (3, 4, 0.0)], "src int, dst int, w double")
    r = spark.createDataFrame([(1,), (3,)], "restart int")
    a = {(x.restart, x.node): x.p for x in graph.ppr(e, r, max_iter=40).collect()}
    b = {(x.restart, x.node): x.p for x in graph.ppr_exact(e, r).collect()}
    for k in (1, 3):
        assert sum(v for (s, _), v in a.items() if s == k) == pytest.approx(1)
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in b)


def test_row_normalize_keeps_empty_rows(spark):
    e = spark.createDataFrame([(1, 2, 0.0), (2, 1, 3.0), (2, 3, 1.0)], "src int, dst int, w double")
    got = {(r.src, r.dst): r.p for r in normalize.row_normalize(e).collect()}
    assert got == {(1, 2): 0.0, (2, 1): 0.75, (2, 3): 0.25}


def test_cliques_find_the_largest(spark):
    k5 = [(a, b) for a in "abcde" for b in "abcde" if a < b]
    rows = [("r", a, b) for a, b in k5] + [("r", "a", "x"), ("r", "b", "x"), ("r", "x", "y"), ("q", "a", "b"), ("q", "b", "c"), ("q", "a", "c")]
    t = spark.createDataFrame(rows, "rel string, w1 string, w2 string")
    got = {(r.rel, r.w1, r.w2): r.members for r in graph.cliques(t, t.select("w1", "w2")).collect()}
    assert got["r", "a", "b"] == "a,b,c,d,e" and got["q", "a", "b"] == "a,b,c" and got["r", "a", "x"] == "a,b,x"
    assert ("r", "x", "y") not in got


def test_closure_raises_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(ValueError):
        hierarchy.closure(e, 5)


def test_lemma_list_and_blocks(spark, tmp_path):
    from tagweave import sources as src

    (tmp_path / "l.txt").write_text("run\n    ran -> [run], running\ncat, feline\n    cats\n")
    got = {r.string: (r.word, r.is_base) for r in src.lemma_list(src.numbered_lines(spark, f"file://{tmp_path}/l.txt")).collect()}
    assert got == {"run": ("run", 1), "ran": ("run", 0), "running": ("run", 0), "cat": ("cat", 1), "cats": ("cat", 0)}
    (tmp_path / "g.txt").write_text("#1,s,IsA,a,3\n1\ta\tb\n1\tb\tc\n1\tc\ta\n----\n#2,s,IsA,b,2\n1\ta\tb\n----\n#3,c,X,a,3\n1\ta\tzz\n1\ta\tb\n1\tb\ta\n")
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    edges_, skipped = src.graph_blocks(src.numbered_lines(spark, f"file://{tmp_path}/g.txt"), words)
    assert {r.graph_id for r in edges_.collect()} == {"1"} and skipped.first()[0] == 1


def test_synset_words_reject_double_keys(spark):
    from tagweave import sources as src

    w = spark.createDataFrame([("n1\tdog, hound",), ("n1\tcat",)], "value string")
    with pytest.raises(ValueError):
        src.synset_words(w, w)


def test_photo_reader(spark, tmp_path):
    from tagweave import sources as src

    d = tmp_path / "00" / "01"
    d.mkdir(parents=True)
    (d / "1.json").write_text('{"stat": "ok", "photo": {"id": "1", "owner": {"nsid": "u"}, "tags": {"tag": [{"_content": "cat"}, {"_content": "dog"}]}}}')
    (d / "2.json").write_text('{"stat": "fail"}')
    (d / "3.json").write_text("{oops")
    raw = src.raw_photos(spark, f"file://{tmp_path}").cache()
    assert [(r.img_id, r.user_id, r.tags) for r in src.photos_of(raw).collect()] == [("1", "u", ["cat", "dog"])]
    assert tuple(src.photo_counters(raw).first()) == (3, 1, 1, 0)
    raw.unpersist()


# ---- learning ----
def bands(n=25):
    """The bounded test problem with a known least value of 0."""
    def f(x):
        v = 0.25 * (x[0] - 1) ** 2 + ((x[1:] - x[:-1] ** 2) ** 2).sum()
        g = np.zeros(n)
        t = x[1:] - x[:-1] ** 2
        g[1:] += 2 * t
        g[:-1] += -4 * x[:-1] * t
        g[0] += 0.5 * (x[0] - 1)
        return 4 * v, 4 * g
    lo, hi = np.full(n, -100.0), np.full(n, 100.0)
    lo[::2] = 1.0
    return f, np.full(n, 3.0), lo, hi


def test_box_minimum_reaches_the_golden_value():
    f, x, lo, hi = bands()
    got = minimize_box(f, x, lo, hi, m=5, factr=1e7, pgtol=1e-5)
    assert got.f <= 1e-8 and (got.x >= lo).all() and (got.x <= hi).all()
    assert all(b <= a + 1e-12 for a, b in zip(got.history, got.history[1:]))


def test_box_minimum_on_bounds():
    r = np.random.default_rng(0)
    a = r.standard_normal((30, 12))
    b = r.standard_normal(30)
    got = minimize_box(lambda x: (0.5 * ((a @ x - b) ** 2).sum(), a.T @ (a @ x - b)), np.zeros(12), 0.0, None, factr=10, pgtol=1e-9, max_iter=500)
    g = a.T @ (a @ got.x - b)
    assert (got.x >= 0).all() and (g >= -1e-6).all() and np.abs(g * got.x).max() < 1e-6
    with pytest.raises(ValueError):
        minimize_box(lambda x: (0.0, x), np.zeros(2), 1.0, 0.0)


def test_edge_objective_gradient():
    r = np.random.default_rng(1)
    g = r.random((6, 6)) * (r.random((6, 6)) < 0.7)
    np.fill_diagonal(g, 0)
    g[2] = 0
    obs = edges.stochastic(r.random((6, 6)))
    f, grad = edges.objective(g, obs, 0.5, 0.1)
    for i, j in zip(*np.nonzero(g)):
        e = np.zeros_like(g)
        e[i, j] = 1e-6
        num = (edges.objective(g + e, obs, 0.5, 0.1)[0] - edges.objective(g - e, obs, 0.5, 0.1)[0]) / 2e-6
        assert num == pytest.approx(grad[i, j], rel=1e-4, abs=1e-7)


def test_edge_fit_lowers_the_objective_and_keeps_bounds(spark):
    r = np.random.default_rng(2)
    rows = [("g", a, b, float(r.random())) for a in "abcdef" for b in "abcdef" if a < b]
    known = spark.createDataFrame([("a", "b", 0.6)], "w1 string, w2 string, weight double")
    got = edges.fit_edges(spark.createDataFrame(rows, "wnid string, w1 string, w2 string, w double"), known).collect()
    assert got[0].end < got[0].start
    w = {(x.w1, x.w2): x.weight for x in got}
    assert all(-1e-12 <= v <= 1 for v in w.values()) and w["a", "b"] >= 0.6 - 1e-9


@pytest.mark.parametrize("loss", ["l2", "hinge"])
def test_bilinear_learns(spark, loss):
    r = np.random.default_rng(3)
    u, v = r.standard_normal((2, 3)), r.standard_normal((2, 3))
    x, y = r.standard_normal((40, 3)), r.standard_normal((6, 3))
    truth = (x @ u.T) @ (v @ y.T)
    xs = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "img_id int, vec array<double>")
    ys = spark.createDataFrame([(str(j), b.tolist()) for j, b in enumerate(y)], "tag string, vec array<double>")
    rs = spark.createDataFrame([(i, str(j), float(np.sign(truth[i, j])) if loss == "hinge" else float(truth[i, j])) for i in range(40) for j in range(6)], "img_id int, tag string, r double")
    m = bilinear.fit_bilinear(rs, xs, ys, k=2, alpha=1e-3, loss=loss, max_iter=8, inner=15)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(m.history, m.history[1:]))
    got = {(p.img_id, p.tag): p.score for p in bilinear.predict_bilinear(m, xs, ys).collect()}
    hit = np.mean([np.sign(got[i, str(j)]) == np.sign(truth[i, j]) for i in range(40) for j in range(6)])
    assert hit > (0.97 if loss == "l2" else 0.9)


def test_level_mixture_rises():
    member = np.array([[1, 0], [1, 1], [0, 1], [0, 1]], float)
    p, history = levels.em_levels(np.array([10.0, 5, 1, 1]), member)
    assert p.sum() == pytest.approx(1) and p[0] > p[1]
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))


@pytest.mark.parametrize("kind", ["linear", "rbf", "poly"])
def test_kernel_machine_separates(kind):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.5, (40, 2)), r.normal(2.5, 0.5, (40, 2))])
    y = np.repeat([0, 1], 40)
    m = svm.KernelMachine(1.0, kind, 0.5).fit(x, y)
    assert ((m.decide(x) > 0) == y).mean() > 0.95


def test_kernel_regression_and_one_class():
    r = np.random.default_rng(5)
    x = r.uniform(-2, 2, (60, 1))
    m = svm.KernelMachine(10.0, "rbf", 1.0, "regress", 0.05).fit(x, np.sin(x[:, 0]))
    assert np.abs(m.decide(x) - np.sin(x[:, 0])).mean() < 0.1
    o = svm.KernelMachine(0.1, "rbf", 1.0, "one_class").fit(r.normal(0, 0.3, (60, 2)))
    assert o.decide(np.array([[0.0, 0.0]]))[0] > o.decide(np.array([[5.0, 5.0]]))[0]


def test_samples_and_small_helpers(spark):
    d = spark.range(200).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    s = sampling.sample_pos_neg(d, "y", "id", 2, 30, 50)
    assert s.where("y = 1").count() == 30 and s.where("y = 0").count() == 50
    f = sampling.stratified_folds(d, "y", "id", 4)
    assert {r["count"] for r in f.groupBy("y", "fold").count().collect()} == {10, 40}
    assert settled(1.0, 1.0) == (True, False) and settled(0.5, 1.0)[1]
    g = gaussian_sample([1.0, 2.0], [[2.0, 0.5], [0.5, 1.0]], 20000)
    assert np.cov(g.T) == pytest.approx(np.array([[2.0, 0.5], [0.5, 1.0]]), abs=0.1)
    assert paired_t([1, 2, 3], [0, 1, 1]) == pytest.approx(4.0)
    assert math.isclose(paired_t([1, 1], [1, 1]), 0)


def test_linear_renormalisers(spark):
    r = spark.createDataFrame([(0.0,), (2.0,)], "x double").select(fn.logistic_renorm("x"), fn.log10_renorm("x"), fn.smooth_hinge("x"), fn.smooth_hinge("x")).collect()
    assert r[0][0] == 0 and r[1][0] == pytest.approx(0.5 * math.tanh(1)) and r[1][1] == pytest.approx(math.log10(3))


@pytest.mark.parametrize("name", ["l01_bilinear_squared_loss", "l02_bilinear_hinge_loss"])
def test_registered_bilinear_models_are_whole(spark, sf, monkeypatch, name):
    """Every component is fitted, with the default rounds; scores are the plain product."""
    from tagweave.plans import QUERIES

    fit, seen = bilinear.fit_bilinear, []

    def spy(*args, **named):
        assert not {"max_iter", "inner"} & set(named)
        seen.append(fit(*args, **(named | {"max_iter": 1, "inner": 2})))  # the shape is what counts here
        return seen[-1]

    monkeypatch.setattr(bilinear, "fit_bilinear", spy)
    got = {(r.img_id, r.tag): r.score for r in QUERIES[name](spark, sf).collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label is not null").collect()}
    assert seen[0].u.shape[1] == 64 and len(got) >= len(x)
    assert all(abs(s - (x[i] @ seen[0].matrix)[int(tag)]) < 1e-3 for (i, tag), s in got.items())


def test_registered_grid_is_whole(spark, sf):
    from tagweave.plans import QUERIES

    rows = QUERIES["l07_kernel_grid_search"](spark, sf).select("kind", "c", "gamma").collect()
    assert sorted(map(tuple, rows)) == sorted([("rbf", c, g) for c in (0.1, 1.0, 10.0) for g in (0.5, 1.0, 2.0)] + [("linear", c, 1.0) for c in (0.1, 1.0, 10.0)])


def test_registered_sparse_vectors_are_whole(spark, sf, monkeypatch):
    from tagweave.plans import QUERIES
    from tagweave.sources import sinks

    write, sizes = sinks.write_sparse_vectors, []
    monkeypatch.setattr(sinks, "write_sparse_vectors", lambda df, path: (sizes.extend(len(r.vec) for r in df.collect()), write(df, path)))
    assert QUERIES["s18_sparse_vectors"](spark, sf).collect() and set(sizes) == {64}


def test_wide_documents_are_paired_in_parts(spark):
    """A document above the bound gives the same pairs, and a very wide one is counted."""
    import random
    from collections import Counter
    from itertools import combinations

    r = random.Random(1)
    docs = {d: r.sample([f"t{i:02d}" for i in range(40)], r.choice([0, 1, 3, 17, 40])) for d in range(30)}
    df = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts] + [(1, None)], "doc_id long, tag string")
    want = Counter(p for ts in docs.values() for p in combinations(sorted(ts), 2))
    for most in (1, 7, 1000):
        assert {(x.w1, x.w2): x.freq for x in cooc.bigrams(df, max_tags=most).collect()} == dict(want)
    n = 1500
    wide = spark.range(n).selectExpr("1 AS doc_id", "concat('w', id) AS tag")
    assert cooc.bigrams(wide).count() == n * (n - 1) // 2


def test_kendall_against_all_pairs(spark):
    import random

    from tagweave.operators import stats

    r = random.Random(2)
    for size, values in ((1, 3), (60, 4), (80, 1000)):
        rows = [(float(r.randrange(values)), float(r.randrange(values))) for _ in range(size)]
        got = stats.regression_metrics(spark.createDataFrame(rows + [(None, 1.0)], "t double, s double"), "t", "s").first().kendall
        sign = lambda x: (x > 0) - (x < 0)
        pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
        num = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
        x, y = sum(a[0] != b[0] for a, b in pairs), sum(a[1] != b[1] for a, b in pairs)
        assert (got is None and not x * y) or got == pytest.approx(num / (x * y) ** 0.5)


def test_places_within_groups(spark):
    from tagweave.operators.stats import numbered_in

    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i, i % 4) for i in range(400)]
    got = numbered_in(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], "i").collect()
    sums = numbered_in(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], "i", name="s", value="v").collect()
    for g in {x[0] for x in rows}:
        own = sorted(x for x in rows if x[0] == g)if g else sorted((x for x in rows if x[0] is None), key=lambda x: x[1])
        assert sorted((x.i, x.pos, x.n) for x in got if x.g == g) == [(x[1], k, len(own)) for k, x in enumerate(own)]
        assert sorted((x.i, x.s, x.n) for x in sums if x.g == g) == [(x[1], sum(y[2] for y in own[:k]), sum(y[2] for y in own)) for k, x in enumerate(own)]


def test_nearest_settles_ties_by_id(spark):
    """Fifty equal vectors: the smallest ids win, in any partitioning and block."""
    from tagweave.operators import features

    base = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50, 0, -1)] + [(99, [1.0, 2.5])], "b_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0, 9.0])], "q_id long, vec array<double>")
    for parts, wave, block in ((1, 10, 7), (9, 1, 2048)):
        got = features.nearest(q, base.repartition(parts), 4, wave=wave, block=block).collect()
        assert [x.b_id for x in sorted(got, key=lambda x: (x.q_id, x.place))] == [1, 2, 3, 4, 1, 2, 3, 4, 99, 1, 2, 3]


def test_jobs_are_packed_in_chunks(spark):
    import random

    from tagweave.sources import pack_jobs

    r = random.Random(3)
    rows = [(f"d{i:03d}", r.choice([1, 5, 40, 90, 300])) for i in range(200)]
    df = spark.createDataFrame(rows, "dir string, n long").repartition(5)
    want, job, total = [], 0, 0
    for d, n in rows:
        if total and total + n > 100:
            job, total = job + 1, 0
        total += n
        want.append((d, n, job))
    for chunk in (60, 1000):
        assert sorted(tuple(x) for x in pack_jobs(df, 100, chunk=chunk).collect()) == want


def test_counts_above_five_digits_are_written_whole(spark, tmp_path):
    from tagweave.__main__ import main

    rows = [("    7\tcat\tdog",), ("1234567\tcat\tcow",), ("99999999999\tant\tbee",)]
    spark.createDataFrame(rows, "value string").write.text(f"file://{tmp_path}/in")
    main(["reduce", f"file://{tmp_path}/in,file://{tmp_path}/in", f"file://{tmp_path}/out"], spark)
    got = sorted(x.value for x in spark.read.text(f"file://{tmp_path}/out").collect())
    assert got == sorted(["   14\tcat\tdog", "2469134\tcat\tcow", "199999999998\tant\tbee"])


def test_a_cluster_needs_a_shared_folder():
    from tagweave.session import shared_folder

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        shared_folder(Fake)


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    import datetime as dt

    from tagweave import streaming

    at = dt.datetime(2024, 1, 1, 12)
    path = f"file://{tmp_path}/in"
    for minutes in (0, 300, 301, 1):  # the last file is five hours late
        spark.createDataFrame([(at + dt.timedelta(minutes=minutes), "a")], "ts timestamp, k string").coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(path)
    got = streaming.run_available(streaming.streaming_windows(stream, "ts", "k", "1 hour"), ["start", "k"], f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert sorted(x.n for x in got.collect()) == [1, 2]


def test_path_similarity_of_asked_pairs(spark):
    below = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("a", "b", 1), ("r", "c", 1)], "top string, node string, depth int")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("lone",)], "wnid string")
    every = {(x.wn1, x.wn2): x.sim for x in hierarchy.path_similarity(below, nodes).collect()}
    assert every == {("a", "b"): 0.5, ("a", "c"): 1 / 3, ("b", "c"): 0.25}
    asked = spark.createDataFrame([("a", "c"), ("a", "lone"), ("a", "c")], "wn1 string, wn2 string")
    assert {(x.wn1, x.wn2): x.sim for x in hierarchy.path_similarity(below, nodes, pairs=asked).collect()} == {("a", "c"): 1 / 3}
