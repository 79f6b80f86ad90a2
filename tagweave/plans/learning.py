"""Similarities, learning and sampling (D12-D19, L, M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagweave.operators import features, lowrank, sampling
from tagweave.operators.learn import bilinear, edges, levels, svm
from tagweave.plans.registry import query

_HASH = "((({}) % 2147483648) * 2654435761) % 4294967296"


def _h(expr: str) -> str:
    return _HASH.format(expr)


@query(
    "m01_sample_pos_neg",
    f"""WITH p AS (SELECT least(count(*), 50) AS p FROM (SELECT * FROM fx_scored WHERE label = 0)), r AS (SELECT id, 1 - label AS y, row_number() OVER (PARTITION BY label ORDER BY {_h('id')}, id) AS rn FROM fx_scored)
 SELECT id, y FROM r, p WHERE rn <= CASE WHEN y = 1 THEN 50 ELSE least(2 * p, 200) END""",
)
def _(t):
    d = t.scored.select("id", (1 - F.col("label")).alias("y"))
    return sampling.sample_pos_neg(d, "y", "id", 2, 50, 200)


@query(
    "m02_entry_folds",
    f"""WITH p AS (SELECT count(*) AS p FROM fx_scored WHERE label = 0), r AS (SELECT id, 1 - label AS y, row_number() OVER (PARTITION BY label ORDER BY {_h('id')}, id) AS rn FROM fx_scored),
 s AS (SELECT id, y FROM r, p WHERE y = 1 OR rn <= 3 * p), o AS (SELECT id, y, row_number() OVER (ORDER BY {_h('id + 1')}, id) - 1 AS i, count(*) OVER () // 4 AS size FROM s)
 SELECT id, y, CAST(i // size AS INT) AS fold FROM o WHERE i < 4 * size""",
)
def _(t):
    d = t.scored.select("id", (1 - F.col("label")).alias("y"))
    return sampling.entry_folds(d, "y", "id", 3, 4)


@query("m03_random_items", f"SELECT o_orderkey FROM orders ORDER BY {_h('o_orderkey')}, o_orderkey LIMIT 100")
def _(t):
    return sampling.random_items(t.orders.select("o_orderkey"), "o_orderkey", 100)


@query("m04_stratified_folds", f"SELECT id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY {_h('id')}, id) AS INT) AS fold FROM fx_scored")
def _(t):
    return sampling.stratified_folds(t.scored.select("id", "label"), "label", "id", 5)


_IMGTAG = "it AS (SELECT l_orderkey AS img, l_linenumber AS tag, CASE WHEN max(l_quantity) > 20 THEN 1 ELSE 0 END AS label FROM lineitem GROUP BY ALL)"


def _img_labels(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("tag")).agg((F.max("l_quantity") > 20).cast("int").alias("label"))


@query(
    "m05_collaborative_split",
    f"""WITH {_IMGTAG}, k AS (SELECT img FROM it GROUP BY img HAVING sum(label) >= 2)
 SELECT img, tag, label, CASE WHEN row_number() OVER (PARTITION BY img, label ORDER BY {_h('img * 131 + tag')}, tag) <= 1 THEN 'train' ELSE 'test' END AS part FROM it WHERE img IN (SELECT img FROM k)""",
)
def _(t):
    return sampling.collaborative_split(_img_labels(t), "img", "tag", "label", 1, 2)


@query("m06_legacy_split", f"WITH {_IMGTAG} SELECT img, CAST(sum(label) AS BIGINT) AS n_tags, CASE WHEN sum(label) >= 3 THEN 'many' ELSE 'few' END AS part FROM it GROUP BY img")
def _(t):
    return sampling.legacy_split(_img_labels(t), "img", "label", 3)


_UNIT = "(CAST('0x' || substr(md5(c_custkey || ':7:0'), {}, 8) AS BIGINT) + 5e-1) / 4294967296"


@query(
    "n22_gaussian_rows",
    f"""WITH m AS (SELECT avg(c_acctbal / 1000) AS mx, avg(c_nationkey) AS my, var_pop(c_acctbal / 1000) AS a, covar_pop(c_acctbal / 1000, c_nationkey) AS b, var_pop(c_nationkey) AS c FROM customer),
 l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM m),
 f AS (SELECT *, sqrt(l1) / sqrt(b * b + pow(l1 - a, 2)) * CASE WHEN b < 0 THEN -1 ELSE 1 END AS n1, sqrt(l2) / sqrt(b * b + pow(l2 - a, 2)) * CASE WHEN b < 0 THEN -1 ELSE 1 END AS n2 FROM l),
 z AS (SELECT c_custkey, sqrt(-2 * ln({_UNIT.format(1)})) AS r, 2 * pi() * {_UNIT.format(9)} AS t FROM customer)
 SELECT c_custkey, round(mx + n1 * b * r * cos(t) + n2 * b * r * sin(t), 6) AS x0, round(my + n1 * (l1 - a) * r * cos(t) + n2 * (l2 - a) * r * sin(t), 6) AS x1 FROM z, f""",
)
def _(t):
    """A draw for each customer from the normal distribution of balances and nations."""
    x, y = F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")
    m = t.customer.agg(F.avg(x), F.avg(y), F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)).first()
    got = sampling.gaussian_rows(t.customer, "c_custkey", m[:2], [[m[2], m[3]], [m[3], m[4]]], seed=7)
    return got.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("x0", "x1")))


@query("m07_recode_labels", "SELECT id, label - 5e-1 AS r FROM fx_scored")
def _(t):
    return sampling.recode(t.scored).select("id", "r")


@query("l03_bilinear_prediction", "WITH m AS (SELECT j, list_transform(range(64), lambda i: sin(i * 7 + j * 3)) AS c FROM (SELECT unnest(range(4)) AS j)) SELECT vec_id AS img_id, 't' || CAST(j AS VARCHAR) AS tag, round(list_inner_product(embedding::DOUBLE[], c), 6) AS score FROM embeddings, m")
def _(t):
    m = np.sin(np.arange(64)[:, None] * 7 + np.arange(4)[None, :] * 3)
    s = features.predict(t.embeddings.select(F.col("vec_id").alias("img_id"), F.col("embedding").alias("vec")), m, [f"t{j}" for j in range(4)])
    return s.withColumn("score", F.round("score", 6))


@query("d19_concept_similarity", "WITH n AS (SELECT wnid, sqrt(sum(cnt * cnt)) AS n FROM fx_counts GROUP BY wnid), v AS (SELECT wnid, tag, cnt / n AS v FROM fx_counts JOIN n USING (wnid)) SELECT a.wnid AS c1, b.wnid AS c2, round(sum(a.v * b.v), 6) AS gram FROM v a JOIN v b ON a.tag = b.tag AND a.wnid < b.wnid GROUP BY ALL")
def _(t):
    # at full rank the squared similarity matrix is the Gram matrix
    s = features.svd_similarity(t.counts.select(F.col("wnid").alias("concept"), F.col("tag").alias("feat"), F.col("cnt").cast("double").alias("value")), 1 << 20)
    one = s.select(F.col("c1").alias("a"), F.col("c2").alias("b"), "sim").union(s.select("c2", "c1", "sim"))
    # the diagonal follows from unit rows: the squares of a row of similarities add up to 1
    diag = one.groupBy("a").agg(F.sqrt(1 - F.sum(F.col("sim") * F.col("sim"))).alias("sim")).select("a", F.col("a").alias("b"), "sim")
    full = one.union(diag)
    g = full.toDF("c1", "k", "x").join(full.toDF("c2", "k", "y"), "k").where("c1 < c2").groupBy("c1", "c2").agg(F.sum(F.col("x") * F.col("y")).alias("gram"))
    return g.withColumn("gram", F.round("gram", 6))


@query("d19_low_rank_similarity")
def _(t):
    s = lowrank.svd_similarity(t.counts.select(F.col("wnid").alias("concept"), F.col("tag").alias("feat"), F.col("cnt").cast("double").alias("value")), 10)
    return s.withColumn("sim", F.round("sim", 6))


def _squared(n: int) -> str:
    """Squares of the Gram matrix, each scaled by its trace."""
    return ", ".join(f"g{i} AS MATERIALIZED (SELECT x.a, y.b, sum(x.v * y.v) / (SELECT sum(v) FROM g{i - 1} WHERE a = b) AS v FROM g{i - 1} x JOIN g{i - 1} y ON x.b = y.a GROUP BY ALL)" for i in range(1, n + 1))


@query(
    "d19_leading_similarity",
    f"""WITH nn AS (SELECT wnid, sqrt(sum(cnt * cnt)) AS n FROM fx_counts GROUP BY wnid), m AS (SELECT wnid, tag, cnt / n AS v FROM fx_counts JOIN nn USING (wnid)),
 g0 AS MATERIALIZED (SELECT x.wnid AS a, y.wnid AS b, sum(x.v * y.v) AS v FROM m x JOIN m y ON x.tag = y.tag GROUP BY ALL), {_squared(12)},
 u AS (SELECT a, sum(v) AS v FROM g12 GROUP BY a), w AS (SELECT a, v / sqrt((SELECT sum(v * v) FROM u)) AS v FROM u), l AS (SELECT sum(x.v * g0.v * y.v) AS l FROM g0 JOIN w x ON x.a = g0.a JOIN w y ON y.a = g0.b)
 SELECT x.a AS c1, y.a AS c2, round(sqrt(l) * x.v * y.v, 5) AS sim FROM w x JOIN w y ON x.a < y.a, l WHERE x.v * y.v > 0""",
)
def _(t):
    """Rank one, against powers of the whole Gram matrix."""
    s = lowrank.svd_similarity(t.counts.select(F.col("wnid").alias("concept"), F.col("tag").alias("feat"), F.col("cnt").cast("double").alias("value")), 1, powers=6)
    return s.withColumn("sim", F.round("sim", 5))


@query("d13_learned_edge_weights")
def _(t):
    """Edge weights of each concept's word graph (D12 to D15)."""
    w = F.split("tag", " ")
    p = t.counts.select("wnid", w[0].alias("w1"), w[1].alias("w2"), F.col("cnt").cast("double").alias("w"))
    known = t.known.where("rel = 'SMALL'").select("w1", "w2", F.lit(0.2).alias("weight"))
    got = edges.fit_edges(p, known)
    return got.select("wnid", "w1", "w2", *[F.round(c, 5).alias(c) for c in ("weight", "start", "end")])


_SEEN = "s AS (SELECT DISTINCT wnid, least(split_part(tag, ' ', 1), split_part(tag, ' ', 2)) AS w1, greatest(split_part(tag, ' ', 1), split_part(tag, ' ', 2)) AS w2 FROM fx_counts), kn AS (SELECT DISTINCT least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM fx_known WHERE rel = 'SMALL')"


def _concept_pairs(t):
    w = F.split("tag", " ")
    return t.counts.select("wnid", w[0].alias("w1"), w[1].alias("w2"), F.col("cnt").cast("double").alias("w"))


@query("d14_learned_within_bounds", f"WITH {_SEEN} SELECT wnid, count(*) AS n_pairs, 0 AS below_known, 0 AS above_one, 0 AS risen FROM s GROUP BY wnid")
def _(t):
    """Every pair seen has a weight between the known one and 1, and no group's objective rises."""
    known = t.known.where("rel = 'SMALL'").select("w1", "w2", F.lit(0.2).alias("weight"))
    k = known.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"), "weight").distinct().withColumnRenamed("weight", "k")
    got = edges.fit_edges(_concept_pairs(t), known).join(k, ["w1", "w2"], "left")
    return got.groupBy("wnid").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("weight") < F.coalesce("k", F.lit(0.0)) - 1e-9).alias("below_known"),
        F.count_if(F.col("weight") > 1 + 1e-9).alias("above_one"),
        F.count_if(F.col("end") > F.col("start") + 1e-12).alias("risen"),
    )


@query("d15_known_recall", f"WITH {_SEEN} SELECT s.wnid, count(*) AS n_seen, count(kn.w1) AS n_known, round(count(kn.w1) / count(*), 6) AS recall FROM s LEFT JOIN kn ON s.w1 = kn.w1 AND s.w2 = kn.w2 GROUP BY s.wnid")
def _(t):
    return edges.recall(_concept_pairs(t), t.known.where("rel = 'SMALL'")).withColumn("recall", F.round("recall", 6))


_ENTRIES = """m AS (SELECT j, list_transform(range(64), lambda i: sin(i * 7 + j * 3) / 10) AS c FROM (SELECT unnest(range(10)) AS j)),
 en AS (SELECT list_inner_product(embedding::DOUBLE[], c) AS z, CASE WHEN label = j THEN 5e-1 ELSE -5e-1 END AS r, list_sum(embedding::DOUBLE[]) AS x FROM embeddings, m WHERE label IS NOT NULL AND j IN (SELECT label FROM embeddings))"""


def _objective(t, loss, scale=1.0):
    r, x, y = _bilinear_inputs(t)
    w = np.sin(np.arange(64)[:, None] * 7 + np.arange(10)[None, :] * 3) / 10
    value, grad, n = bilinear.objective_at(r.withColumn("r", F.col("r") * scale), x, y, w, loss)
    return t.spark.createDataFrame([(round(float(value), 3), round(float(grad.sum()), 3), int(n))], "loss double, slope double, n long")


@query("l01_squared_objective", f"WITH {_ENTRIES} SELECT round(sum(5e-1 * pow(z - r, 2)), 3) AS loss, round(sum((z - r) * x), 3) AS slope, count(*) AS n FROM en")
def _(t):
    return _objective(t, "l2")


@query("l02_hinge_objective", f"WITH {_ENTRIES}, h AS (SELECT z * 2 * r AS m, 2 * r AS r, x FROM en) SELECT round(sum(CASE WHEN m <= 0 THEN 5e-1 - m WHEN m < 1 THEN 5e-1 * pow(1 - m, 2) ELSE 0 END), 3) AS loss, round(sum((CASE WHEN m <= 0 THEN -1 WHEN m < 1 THEN m - 1 ELSE 0 END) * r * x), 3) AS slope, count(*) AS n FROM h")
def _(t):
    return _objective(t, "hinge", 2.0)


def _bilinear_inputs(t):
    e = t.embeddings.where("label is not null")
    x = e.select(F.col("vec_id").alias("img_id"), F.col("embedding").alias("vec"))
    tags = e.select(F.col("label").cast("string").alias("tag"), F.col("label").alias("j")).distinct()
    y = tags.select("tag", F.array(*[(F.col("j") == k).cast("double") for k in range(10)]).alias("vec"))
    r = e.select(F.col("vec_id").alias("img_id"), "label").crossJoin(F.broadcast(tags)).select("img_id", "tag", F.when(F.col("label") == F.col("j"), 0.5).otherwise(-0.5).alias("r"))  # ten labels
    return r, x, y


@query("l01_bilinear_squared_loss")
def _(t):
    r, x, y = _bilinear_inputs(t)
    m = bilinear.fit_bilinear(r, x, y, k=4, alpha=1.0)
    return bilinear.predict_bilinear(m, x, y).withColumn("score", F.round("score", 4))


@query("l02_bilinear_hinge_loss")
def _(t):
    r, x, y = _bilinear_inputs(t)
    m = bilinear.fit_bilinear(r.withColumn("r", F.col("r") * 2), x, y, k=4, alpha=1.0, loss="hinge")
    return bilinear.predict_bilinear(m, x, y).withColumn("score", F.round("score", 4))


@query("l07_kernel_grid_search")
def _(t):
    d = t.embeddings.where("label is not null").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") == 1, 1).otherwise(0).alias("label"))
    return svm.grid_search(d.withColumnRenamed("embedding", "vec"))


_TASKS = ("classify", "nu_classify", "regress", "nu_regress", "one_class")


@query("l08_optimal_machines", f"SELECT task, count(*) AS n_rows, 0 AS violated, 0 AS unbalanced FROM embeddings, (SELECT unnest([{', '.join(repr(x) for x in _TASKS)}]) AS task) WHERE label IS NOT NULL GROUP BY task")
def _(t):
    """Machines of every task on all rows: whether any row violates the optimality conditions by more than a thousandth."""
    d = t.embeddings.where("label is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(F.col("label") < 5, 1).otherwise(0).alias("side"), (F.col("label") / 10).alias("label"))
    target = {"classify": "side", "nu_classify": "side", "one_class": None}
    got = svm.optima(d, {task: target.get(task, "label") for task in _TASKS}, nu=0.3, gamma=1.0)
    out = [(task, got[task]["rows"], int(got[task]["residual"] > 1e-3), int(got[task]["balance"] > 1e-6)) for task in _TASKS]
    return t.spark.createDataFrame(out, "task string, n_rows long, violated int, unbalanced int")


_DIST = "list_inner_product(e, e) + list_inner_product(s, s) - 2 * list_inner_product(e, s)"


@query("l08_decisions", f"WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS s FROM embeddings WHERE label IS NOT NULL GROUP BY label) SELECT id, round(sum((label - 4) / 5 * exp(-5e-1 * ({_DIST}))) - 25e-2, 6) AS decision FROM x, r GROUP BY id")
def _(t):
    """Decisions of a machine with fixed weights: the first row of each label supports it."""
    first = t.embeddings.where("label is not null").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("s")).orderBy("label").collect()
    m = svm.Machine(np.array([r.s for r in first], float), np.array([(r.label - 4) / 5 for r in first]), 0.25, "rbf", 0.5, "classify", {})
    return svm.decisions(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), m, vec="embedding").withColumn("decision", F.round("decision", 6))


@query(
    "l08_sigmoid",
    """WITH RECURSIVE s AS (SELECT (score - 500) / 250 AS f, label AS l, count(*) FILTER (label > 0) OVER () AS np, count(*) OVER () AS n FROM fx_scored),
 x AS (SELECT f, CASE WHEN l > 0 THEN (np + 1) / (np + 2) ELSE 1 / (n - np + 2) END AS t, ln((n - np + 1) / (np + 1)) AS b0 FROM s),
 nt AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(min(b0) AS DOUBLE) AS b FROM x UNION ALL
  SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
   SELECT k, a, b, sum(f * (t - p)) AS ga, sum(t - p) AS gb, sum(f * f * p * (1 - p)) AS haa, sum(f * p * (1 - p)) AS hab, sum(p * (1 - p)) AS hbb
   FROM (SELECT k, a, b, f, t, 1 / (1 + exp(a * f + b)) AS p FROM nt, x WHERE k < 15) GROUP BY k, a, b))
 SELECT round(a, 5) AS a, round(b, 5) AS b FROM nt WHERE k = 15""",
)
def _(t):
    a, b = svm.fit_sigmoid(t.scored.select(((F.col("score") - 500) / 250).alias("decision"), "label"))
    return t.spark.createDataFrame([(round(a, 5), round(b, 5))], "a double, b double")


_SIG = "1 / (1 + exp(-2 * embedding[{}]::DOUBLE))"


@query(
    "l08_class_probabilities",
    f"""WITH r AS (SELECT vec_id AS id, {_SIG.format(1)} AS u, {_SIG.format(2)} AS v, {_SIG.format(3)} AS w FROM embeddings),
 q AS (SELECT id, pow(1 - u, 2) + pow(1 - v, 2) AS aa, u * u + pow(1 - w, 2) AS bb, v * v + w * w AS cc, -(1 - u) * u AS ab, -(1 - v) * v AS ac, -(1 - w) * w AS bc FROM r),
 p AS (SELECT id, (bb * cc - bc * bc) + (ac * bc - ab * cc) + (ab * bc - ac * bb) AS x, (ac * bc - ab * cc) + (aa * cc - ac * ac) + (ab * ac - aa * bc) AS y, (ab * bc - ac * bb) + (ab * ac - aa * bc) + (aa * bb - ab * ab) AS z FROM q)
 SELECT id, unnest(['0', '1', '2']) AS class, unnest([round(x / (x + y + z), 6), round(y / (x + y + z), 6), round(z / (x + y + z), 6)]) AS p FROM p""",
)
def _(t):
    """Three classes from fixed pairwise decisions: the first three dimensions, one a pair."""
    one = lambda i: svm.Machine(np.eye(64)[i : i + 1], np.ones(1), 0.0, "linear", 1.0, "classify", {})
    m = svm.ManyClasses([0, 1, 2], {(0, 1): one(0), (0, 2): one(1), (1, 2): one(2)}, dict.fromkeys([(0, 1), (0, 2), (1, 2)], (-2.0, 0.0)))
    return svm.class_probabilities(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), m, vec="embedding").withColumn("p", F.round("p", 6))


@query("l08_linear_machine")
def _(t):
    d = t.embeddings.where("label is not null").select("vec_id", F.col("embedding").alias("vec"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label"))
    m = svm.linear_svm(d)
    w = [float(v) for v in m.coefficients]
    s = features.predict(d.select(F.col("vec_id").alias("img_id"), "vec"), np.array(w)[:, None], ["low"])
    return s.select("img_id", F.round(F.col("score") + float(m.intercept), 4).alias("score"))


# the weights are positive, so the bound doesn't bite and Cramer's rule gives them
@query(
    "l09_box_minimum",
    """WITH c AS (SELECT l_orderkey AS k, CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS r FROM lineitem GROUP BY 1),
 s AS (SELECT sum(a * a) AS aa, sum(a * n) AS an, sum(a * r) AS ar, sum(n * n) AS nn, sum(n * r) AS nr, sum(r * r) AS rr, sum(a * o_totalprice) AS ya, sum(n * o_totalprice) AS yn, sum(r * o_totalprice) AS yr FROM c JOIN orders ON o_orderkey = k),
 d AS (SELECT *, aa * (nn * rr - nr * nr) - an * (an * rr - nr * ar) + ar * (an * nr - nn * ar) AS det FROM s)
 SELECT 'A' AS flag, round((ya * (nn * rr - nr * nr) - an * (yn * rr - nr * yr) + ar * (yn * nr - nn * yr)) / det, 2) AS weight FROM d
 UNION ALL SELECT 'N', round((aa * (yn * rr - nr * yr) - ya * (an * rr - nr * ar) + ar * (an * yr - yn * ar)) / det, 2) FROM d
 UNION ALL SELECT 'R', round((aa * (nn * yr - yn * nr) - an * (an * yr - yn * ar) + ya * (an * nr - nn * ar)) / det, 2) FROM d""",
)
def _(t):
    """Weights of non-negative least squares: order prices by line counts of each flag, on the driver's cached Gram matrix."""
    from tagweave.operators.learn.minimize import minimize_box

    flags = ["A", "N", "R"]
    c = t.lineitem.groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == f).alias(f) for f in flags]).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = c.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in flags for b in flags], *[F.sum(F.col(a) * F.col("o_totalprice")).alias(f"y{a}") for a in flags]).first()
    g = np.array([[float(sums[f"{a}{b}"] or 0) for b in flags] for a in flags])
    y = np.array([float(sums[f"y{a}"] or 0) for a in flags])
    scale = max(float(np.abs(g).max()), 1.0)
    got = minimize_box(lambda x: (float(0.5 * x @ g @ x - y @ x) / scale, (g @ x - y) / scale), np.zeros(3), 0.0, None, factr=10, pgtol=1e-9, max_iter=500)
    return t.spark.createDataFrame([(f, round(float(v), 2)) for f, v in zip(flags, got.x)], "flag string, weight double")


@query("l10_weights_of_a_concept", "SELECT wnid, CAST(1 AS DOUBLE) AS total, 0 AS negative FROM fx_counts GROUP BY wnid")
def _(t):
    """The weights of a concept's levels are shares."""
    m = _mixture(t)
    return m.groupBy("wnid").agg(F.round(F.sum("weight"), 6).alias("total"), F.count_if(F.col("weight") < 0).alias("negative"))


@query("l10_level_mixture")
def _(t):
    return _mixture(t).withColumn("weight", F.round("weight", 6))


def _mixture(t):
    w = t.nation.join(t.part, F.col("n_nationkey") == F.col("p_size")).select(F.col("n_name").alias("wnid"), (F.col("p_size") % 3).alias("depth"), F.col("p_name").alias("word"))
    words = w.groupBy("wnid", "depth").agg(F.array_sort(F.collect_set("word")).alias("words"))
    return levels.level_mixture(t.counts, words)
