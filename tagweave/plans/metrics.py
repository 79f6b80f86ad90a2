"""Pair statistics, scores and ranking metrics (N, W06-W08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import evaluate as ev
from tagweave.operators import hierarchy, stats
from tagweave.plans.registry import query
from tagweave.plans.relations import _SIMS, _sims

_MI = """nn AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS n FROM fx_doc_tags),
 c AS (SELECT p.w1, p.w2, p.freq, a.freq AS x, b.freq AS y, n FROM fx_pairs p JOIN fx_uni a ON p.w1 = a.tag JOIN fx_uni b ON p.w2 = b.tag, nn),
 cells AS (SELECT w1, w2, freq, x, y, n, unnest([freq / n, (x - freq) / n, (y - freq) / n, (n + freq - x - y) / n]) AS p, unnest([x / n, x / n, (n - x) / n, (n - x) / n]) AS px, unnest([y / n, (n - y) / n, y / n, (n - y) / n]) AS py FROM c),
 mi AS (SELECT w1, w2, any_value(freq) AS freq, any_value(x) AS x, any_value(y) AS y, any_value(n) AS n, coalesce(sum(p * log2(p / (px * py))) FILTER (p > 0 AND px > 0 AND py > 0), 0) AS mi FROM cells GROUP BY w1, w2)"""


@query("n01_pair_mutual_information", f"WITH {_MI} SELECT w1, w2, freq, x, y, round(mi, 6) AS mi FROM mi")
def _(t):
    return stats.pair_mi(t.pairs, t.uni, t.n_users).select("w1", "w2", "freq", "x", "y", F.round("mi", 6).alias("mi"))


@query(
    "n02_pair_table",
    f"""WITH {_MI}, h AS (SELECT DISTINCT p_name AS word FROM part WHERE p_size < 4),
 rel AS (SELECT w1, w2, string_agg(rel, ',' ORDER BY rel) AS rels FROM (SELECT DISTINCT least(a, b) AS w1, greatest(a, b) AS w2, rel FROM (SELECT p_name AS a, 'old ring' AS b, p_type AS rel FROM part WHERE p_size < 3)) GROUP BY ALL)
 SELECT mi.w1, mi.w2, round(freq / n, 6) AS share, round(mi, 6) AS mi, CASE (mi.w1 IN (SELECT word FROM h))::INT + (mi.w2 IN (SELECT word FROM h))::INT WHEN 2 THEN 'HH' WHEN 1 THEN 'HO' ELSE 'OO' END AS kind, coalesce(rels, 'None') AS rels
 FROM mi LEFT JOIN rel ON mi.w1 = rel.w1 AND mi.w2 = rel.w2 WHERE freq >= 3""",
)
def _(t):
    h = t.part.where("p_size < 4").select(F.col("p_name").alias("word"))
    rel = t.part.where("p_size < 3").select(F.col("p_name").alias("w1"), F.lit("old ring").alias("w2"), F.col("p_type").alias("rel"))
    d = stats.pair_table(stats.pair_mi(t.pairs, t.uni, t.n_users), h, rel)
    return d.withColumn("share", F.round("share", 6)).withColumn("mi", F.round("mi", 6))


_KL = """pw AS (SELECT wnid, n_images / sum(n_images) OVER () AS pw FROM fx_sizes), tg AS (SELECT DISTINCT tag FROM fx_counts),
 g AS (SELECT tag, pw.wnid, pw, greatest(coalesce(cnt, 0), 5e-1) AS c FROM tg CROSS JOIN pw LEFT JOIN fx_counts f USING (tag, wnid)),
 v AS (SELECT tag, pw, c / sum(c) OVER (PARTITION BY tag) AS pv FROM g),
 kl AS (SELECT tag, sum(pw * log2(pw / pv)) AS vscore FROM v GROUP BY tag)"""


@query("n03_informativeness", f"WITH {_KL} SELECT tag, round(vscore, 6) AS vscore FROM kl")
def _(t):
    return stats.informativeness(t.counts, t.sizes).withColumn("vscore", F.round("vscore", 6))


_FEW = "few AS (SELECT wnid, tag || ':' || CAST(user_id % 40 AS VARCHAR) AS tag, count(DISTINCT img_id) AS cnt FROM fx_img_tags GROUP BY ALL)"


@query("n03_informativeness_sparse", _KL.replace("fx_counts", "few").join([f"WITH {_FEW}, ", " SELECT tag, round(vscore, 6) AS vscore FROM kl"]))
def _(t):
    """Tags by part of the users: most concepts lack most of them."""
    few = t.img_tags.groupBy("wnid", F.concat_ws(":", "tag", (F.col("user_id") % 40).cast("string")).alias("tag")).agg(F.count_distinct("img_id").alias("cnt"))
    return stats.informativeness(few, t.sizes).withColumn("vscore", F.round("vscore", 6))


_CLOS = """cl AS (SELECT DISTINCT * FROM (SELECT parent AS top, child AS node, 1 AS depth FROM fx_edges
 UNION ALL SELECT a.parent, b.child, 2 FROM fx_edges a JOIN fx_edges b ON a.child = b.parent
 UNION ALL SELECT a.parent, c.child, 3 FROM fx_edges a JOIN fx_edges b ON a.child = b.parent JOIN fx_edges c ON b.child = c.parent))"""
_SIM = f"""{_CLOS}, up AS (SELECT node AS wnid, top AS anc, depth FROM cl WHERE node IN (SELECT n_name FROM nation) UNION ALL SELECT n_name, n_name, 0 FROM nation),
 ps AS (SELECT a.wnid AS wn1, b.wnid AS wn2, CAST(1 AS DOUBLE) / (1 + min(a.depth + b.depth)) AS sim FROM up a JOIN up b ON a.anc = b.anc AND a.wnid < b.wnid GROUP BY ALL)"""


def _path_sims(t, pairs=None):
    return hierarchy.path_similarity(hierarchy.closure(t.edges), t.nation.select(F.col("n_name").alias("wnid")), pairs=pairs)


@query("n05_path_similarity", f"WITH {_SIM} SELECT wn1, wn2, round(sim, 6) AS sim FROM ps")
def _(t):
    return _path_sims(t).withColumn("sim", F.round("sim", 6))


@query(
    "n04_dispersion",
    f"""WITH {_SIM}, n AS (SELECT tag, count(*) AS n_groups FROM fx_counts GROUP BY tag), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY cnt DESC, wnid) AS rn FROM fx_counts) WHERE rn <= 8),
 d AS (SELECT a.tag, sum(a.cnt * b.cnt * coalesce(sim, 0)) / sum(a.cnt * b.cnt) AS d FROM r a JOIN r b ON a.tag = b.tag AND a.wnid < b.wnid LEFT JOIN ps ON a.wnid = wn1 AND b.wnid = wn2 GROUP BY a.tag)
 SELECT n.tag, n_groups, round(coalesce(d, 0), 6) AS dispersion FROM n LEFT JOIN d USING (tag)""",
)
def _(t):
    return stats.dispersion(t.counts, _path_sims(t, stats.largest_pairs(t.counts, 8)), 8).withColumn("dispersion", F.round("dispersion", 6))


_RANK = """r AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS k, sum(label) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER () AS n, sum(label) OVER () AS npos FROM fx_scored)"""


@query("w06_precision_recall_curve", f"WITH {_RANK} SELECT k, round(tp / k, 6) AS pr, round(tp / npos, 6) AS re, round((k - tp) / (n - npos), 6) AS fp, round((tp + (n - npos) - (k - tp)) / n, 6) AS accuracy FROM r")
def _(t):
    c = ev.pr_curve(t.scored, "score", "label", "id")
    return c.select("k", *[F.round(x, 6).alias(x) for x in ("pr", "re", "fp", "accuracy")])


@query("w07_recall_increments", f"WITH {_RANK} SELECT k, id FROM r WHERE label = 1")
def _(t):
    return ev.ranked(t.scored, "score", "label", "id").where("label = 1").select("k", "id")


_METRICS = f"""{_RANK}, pts AS (SELECT k, (k - tp) / (n - npos) AS fp, tp / npos AS re FROM r WHERE label = 1 OR k = 1 OR k = n),
 lg AS (SELECT fp, re, lag(fp) OVER (ORDER BY k) AS fp0, lag(re) OVER (ORDER BY k) AS re0 FROM pts),
 au AS (SELECT sum((fp - fp0) * (re + re0) / 2) AS auc FROM lg)"""


@query("w08_trapezoid_auc", f"WITH {_METRICS} SELECT round(auc, 6) AS auc FROM au")
def _(t):
    return ev.rank_metrics(t.scored, "score", "label", "id").select(F.round("auc", 6).alias("auc"))


@query(
    "n07_rank_metrics",
    f"""WITH {_METRICS} SELECT round(sum(tp / k) FILTER (label = 1) / any_value(npos), 6) AS ap, round(max(tp / k) FILTER (k = least(100, n)), 6) AS p_at_d, round(max(tp / k) FILTER (k = npos), 6) AS epr,
 round(any_value(npos) / any_value(n), 6) AS prior, round(max(2 * (tp / k) * (tp / npos) / (tp / k + tp / npos)) FILTER (tp > 0), 6) AS f1, CAST(any_value(npos) AS BIGINT) AS npos, any_value(n) AS n,
 max(score) FILTER (tp / npos >= 5e-1) AS score_thresh, round((SELECT auc FROM au), 6) AS auc FROM r""",
)
def _(t):
    m = ev.rank_metrics(t.scored, "score", "label", "id")
    return m.select(*[F.round(c, 6).alias(c) for c in ("ap", "p_at_d", "epr", "prior", "f1")], "npos", "n", "score_thresh", F.round("auc", 6).alias("auc"))


@query("n07_ap_to_depth", f"WITH {_RANK} SELECT round(sum(tp / k) FILTER (label = 1 AND k <= 50) / any_value(npos), 6) AS ap FROM r")
def _(t):
    return ev.rank_metrics(t.scored, "score", "label", "id", ap_depth=50).select(F.round("ap", 6).alias("ap"))


@query("n07_ap_in_range", f"WITH {_RANK} SELECT round(sum(tp / k) FILTER (label = 1 AND k >= 1e-1 * n AND k <= 6e-1 * n) / count(*) FILTER (label = 1 AND k >= 1e-1 * n AND k <= 6e-1 * n), 6) AS ap FROM r")
def _(t):
    return ev.rank_metrics(t.scored, "score", "label", "id", ap_range=(0.1, 0.6)).select(F.round("ap", 6).alias("ap"))


@query("n08_precision_at_depths", f"WITH {_RANK} SELECT k AS d, round(tp / k, 6) AS p FROM r WHERE k IN (1, 5, 10, 50, 100)")
def _(t):
    return ev.pr_curve(t.scored, "score", "label", "id").where(F.col("k").isin(1, 5, 10, 50, 100)).select(F.col("k").alias("d"), F.round("pr", 6).alias("p"))


@query("n10_best_f1", f"WITH {_RANK} SELECT round(max(2 * (tp / k) * (tp / npos) / (tp / k + tp / npos)) FILTER (tp > 0), 6) AS f1 FROM r")
def _(t):
    return ev.rank_metrics(t.scored, "score", "label", "id").select(F.round("f1", 6).alias("f1"))


@query("n11_accuracy_curve", f"WITH {_RANK} SELECT k, round((tp + (n - npos) - (k - tp)) / n, 6) AS accuracy FROM r")
def _(t):
    return ev.pr_curve(t.scored, "score", "label", "id").select("k", F.round("accuracy", 6).alias("accuracy"))


@query(
    "n21_convergence",
    """WITH h AS (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) * 12 + CAST(extract(month FROM o_orderdate) AS BIGINT) AS step, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
 l AS (SELECT step, CAST(v AS DOUBLE) AS a, CAST(lag(v) OVER (ORDER BY step) AS DOUBLE) AS b FROM h)
 SELECT step, abs(a - b) / ((abs(a) + abs(b)) / 2) < 1e-1 AS converged, a - b < -1e-3 AS decreased FROM l WHERE b IS NOT NULL""",
)
def _(t):
    step = (F.year("o_orderdate").cast("long") * 12 + F.month("o_orderdate")).alias("step")
    return stats.convergence(t.orders.groupBy(step).agg(F.sum("o_totalprice").alias("v")), "step", "v", 0.1)


@query("n12_score_threshold", f"WITH {_RANK} SELECT max(score) FILTER (tp / npos >= 8e-1) AS score_thresh FROM r")
def _(t):
    return ev.rank_metrics(t.scored, "score", "label", "id", recall=0.8).select("score_thresh")


@query("n13_sampled_curve", f"WITH {_RANK} SELECT k, round(tp / k, 6) AS pr, round(tp / npos, 6) AS re FROM r WHERE k % greatest(1, CAST(ceil(n / 20) AS BIGINT)) = 0 OR k = 1 OR k = n")
def _(t):
    c = ev.pr_curve(t.scored, "score", "label", "id", ranks=20)
    return c.select("k", F.round("pr", 6).alias("pr"), F.round("re", 6).alias("re"))


@query("n14_label_values", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(t):
    return ev.clean_labels(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label")), "label", ["F"], ["O"])


@query(
    "n15_regression_metrics",
    """WITH g AS (SELECT l_quantity AS t, CAST(l_linenumber AS DOUBLE) AS s, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT corr(l_quantity, l_linenumber) AS pearson, -avg(pow(l_quantity - l_linenumber, 2)) AS neg_mse, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
 num AS (SELECT sum(sign((a.t - b.t) * (a.s - b.s)) * a.n * b.n) AS num FROM g a JOIN g b ON a.t < b.t),
 tt AS (SELECT sum(k * (k - 1) / 2) AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY l_quantity)), ts AS (SELECT sum(k * (k - 1) / 2) AS x FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY l_linenumber))
 SELECT round(pearson, 6) AS pearson, round(neg_mse, 4) AS neg_mse, round(num / sqrt((n * (n - 1) / 2 - tt.x) * (n * (n - 1) / 2 - ts.x)), 6) AS kendall FROM f, num, tt, ts""",
)
def _(t):
    d = t.lineitem.select(F.col("l_quantity").alias("truth"), F.col("l_linenumber").cast("double").alias("guess"))
    m = stats.regression_metrics(d, "truth", "guess")
    return m.select(F.round("pearson", 6).alias("pearson"), F.round("neg_mse", 4).alias("neg_mse"), F.round("kendall", 6).alias("kendall"))


_CAND = f"""{_SIMS}, kn AS (SELECT DISTINCT least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM fx_known WHERE rel = 'SMALL'), tg AS (SELECT DISTINCT least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM fx_all WHERE rel IN ('LARGE', 'PROMO')),
 cd AS (SELECT s.w1, s.w2, s.score, CASE WHEN tg.w1 IS NULL THEN 0 ELSE 1 END AS label FROM sims s LEFT JOIN tg ON s.w1 = tg.w1 AND s.w2 = tg.w2 WHERE (s.w1, s.w2) NOT IN (SELECT w1, w2 FROM kn))"""


def _candidates(t):
    return t.scores, t.all_triples.where("rel in ('LARGE', 'PROMO')"), t.known.where("rel = 'SMALL'")


@query(
    "n16_relations_micro",
    f"""WITH {_CAND}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, w1 || '|' || w2) AS k, sum(label) OVER (ORDER BY score DESC, w1 || '|' || w2 ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER () AS n, sum(label) OVER () AS npos FROM cd),
 pts AS (SELECT k, (k - tp) / (n - npos) AS fp, tp / npos AS re FROM r WHERE label = 1 OR k = 1 OR k = n), lg AS (SELECT fp, re, lag(fp) OVER (ORDER BY k) AS fp0, lag(re) OVER (ORDER BY k) AS re0 FROM pts),
 p AS (SELECT count(*) AS positives FROM tg WHERE (w1, w2) NOT IN (SELECT w1, w2 FROM kn)), c AS (SELECT count(*) AS cnz FROM (SELECT w1 FROM cd UNION SELECT w2 FROM cd))
 SELECT round(sum(tp / k) FILTER (label = 1) / any_value(npos), 6) AS ap, round((SELECT sum((fp - fp0) * (re + re0) / 2) FROM lg), 6) AS auc, round(max(2 * (tp / k) * (tp / npos) / (tp / k + tp / npos)) FILTER (tp > 0), 6) AS f1,
 CAST(any_value(npos) AS BIGINT) AS npos, any_value(n) AS n, round(any_value(npos) / any_value(positives), 6) AS max_recall, round(2 * any_value(npos) / (any_value(cnz) * (any_value(cnz) - 1)), 6) AS r_prior FROM r, p, c""",
)
def _(t):
    m = ev.relation_micro(*_candidates(t))
    return m.select(*[F.round(c, 6).alias(c) for c in ("ap", "auc", "f1")], "npos", "n", *[F.round(c, 6).alias(c) for c in ("max_recall", "r_prior")])


@query(
    "n17_relations_macro",
    f"""WITH {_CAND}, b AS (SELECT w1 AS concept, w2 AS other, score, label FROM cd UNION ALL SELECT w2, w1, score, label FROM cd),
 r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY score DESC, other) AS k, sum(label) OVER (PARTITION BY concept ORDER BY score DESC, other ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER (PARTITION BY concept) AS n, sum(label) OVER (PARTITION BY concept) AS npos FROM b)
 SELECT concept, round(sum(tp / k) FILTER (label = 1) / nullif(any_value(npos), 0), 6) AS ap, round(max(2 * (tp / k) * (tp / npos) / (tp / k + tp / npos)) FILTER (tp > 0), 6) AS f1, round(max(tp / k) FILTER (k = least(5, n)), 6) AS p_at_d, round(any_value(npos) / any_value(n), 6) AS prior, CAST(any_value(npos) AS BIGINT) AS npos, any_value(n) AS n FROM r GROUP BY concept""",
)
def _(t):
    m = ev.relation_macro(*_candidates(t))
    return m.select("concept", *[F.round(c, 6).alias(c) for c in ("ap", "f1", "p_at_d", "prior")], "npos", "n")


@query("n18_mse_by_part", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS part, round(avg(pow(c_acctbal / 1000 - c_nationkey / 5, 2)), 6) AS mse FROM customer GROUP BY ALL")
def _(t):
    part = F.when(F.col("c_custkey") % 4 == 0, "test").otherwise("train").alias("part")
    return t.customer.groupBy(part).agg(F.round(F.avg((F.col("c_acctbal") / 1000 - F.col("c_nationkey") / 5) ** 2), 6).alias("mse"))


_BY = "r AS (SELECT o_orderpriority AS concept, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS tp, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority) AS npos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"


def _order_lists(t):
    return t.orders.select(F.col("o_orderpriority").alias("concept"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query("n19_ap_by_concept", f"WITH {_BY} SELECT concept, round(sum(tp / k) FILTER (label = 1) / any_value(npos), 6) AS ap, round(any_value(npos) / any_value(n), 6) AS prior FROM r GROUP BY concept")
def _(t):
    m = ev.rank_metrics(_order_lists(t), "score", "label", "id", ["concept"])
    return m.select("concept", F.round("ap", 6).alias("ap"), F.round("prior", 6).alias("prior"))


@query("n20_precision_at_five", f"WITH {_BY} SELECT concept, round(sum(label) FILTER (k <= 5) / 5, 6) AS p_at_k, round(any_value(npos) / any_value(n), 6) AS prior FROM r GROUP BY concept")
def _(t):
    m = ev.precision_at_k(_order_lists(t), "score", "label", "id", 5, ["concept"])
    return m.select("concept", F.round("p_at_k", 6).alias("p_at_k"), F.round("prior", 6).alias("prior"))


@query(
    "n09_auc_by_concept",
    f"""WITH {_BY}, pts AS (SELECT concept, k, (k - tp) / (n - npos) AS fp, tp / npos AS re FROM r WHERE label = 1 OR k = 1 OR k = n),
 lg AS (SELECT concept, fp, re, lag(fp) OVER (PARTITION BY concept ORDER BY k) AS fp0, lag(re) OVER (PARTITION BY concept ORDER BY k) AS re0 FROM pts)
 SELECT concept, round(sum((fp - fp0) * (re + re0) / 2), 6) AS auc FROM lg GROUP BY concept""",
)
def _(t):
    return ev.rank_metrics(_order_lists(t), "score", "label", "id", ["concept"]).select("concept", F.round("auc", 6).alias("auc"))


@query("n25_paired_t", "SELECT o_orderpriority AS config, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM (SELECT o_orderpriority, o_totalprice / 1000 - o_custkey AS d FROM orders) GROUP BY ALL")
def _(t):
    d = t.orders.select(F.col("o_orderpriority").alias("config"), (F.col("o_totalprice") / 1000).alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return stats.paired_t(d, "a", "b", ["config"]).withColumn("t", F.round("t", 6))
