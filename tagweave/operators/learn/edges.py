"""Edge weights learned from co-occurrence through personalised PageRank, one concept graph at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.learn.minimize import minimize_box
from tagweave.operators.pagerank import loss_and_gradient
from tagweave.session import drop_stage, stage_table


def all_restarts(w: np.ndarray, alpha: float) -> np.ndarray:
    """Rows: stationary distributions for each restart of row-stochastic ``w``."""
    return (1 - alpha) * np.linalg.inv(np.eye(len(w)) - alpha * w)


def stochastic(g: np.ndarray) -> np.ndarray:
    s = g.sum(1, keepdims=True)
    return np.where(s > 0, g / np.where(s > 0, s, 1), 1 / len(g))


def objective(g: np.ndarray, observed: np.ndarray, alpha: float, ridge: float) -> tuple[float, np.ndarray]:
    """Half the ridge on g plus half the squared misfit of every restart's row to its observation, the restart itself left out.

    The gradient goes through the inverse, dP = alpha P dW (I - alpha W)^-1, and through the normalisation of rows.
    """
    n = len(g)
    s = g.sum(1)
    w = stochastic(g)
    inv = np.linalg.inv(np.eye(n) - alpha * w)
    p = (1 - alpha) * inv
    miss = (p - observed) * (1 - np.eye(n))
    value = 0.5 * ridge * (g**2).sum() + 0.5 * (miss**2).sum()
    dw = alpha * p.T @ miss @ inv.T
    live = s > 0
    dg = np.zeros_like(g)
    dg[live] = (dw[live] - (dw[live] * w[live]).sum(1, keepdims=True)) / s[live, None]
    return value, dg + ridge * g


def fit_matrix(init: np.ndarray, known: np.ndarray, observed: np.ndarray, alpha: float = 0.5, ridge: float = 1e-3, max_iter: int = 100):
    """Weights of the non-zero places of ``init``, between the known weights and 1."""
    at = np.nonzero(init)

    def fun(x):
        g = np.zeros_like(init)
        g[at] = x
        f, grad = objective(g, observed, alpha, ridge)
        return f, grad[at]

    got = minimize_box(fun, init[at], known[at], 1.0, max_iter=max_iter)
    g = np.zeros_like(init)
    g[at] = got.x
    return g, got


def pagerank_losses(p: DataFrame, observed: DataFrame) -> DataFrame:
    """(restart, loss): half the squared misfit of each restart's row (restart, node, p) to what was observed (restart, node, o), itself left out."""
    j = p.where("restart <> node").join(observed, ["restart", "node"], "left")
    return j.groupBy("restart").agg((0.5 * F.sum((F.col("p") - F.coalesce("o", F.lit(0.0))) ** 2)).alias("loss"))


def objective_of(edges: DataFrame, observed: DataFrame, alpha: float = 0.5, ridge: float = 1e-3, group: str = "wnid") -> DataFrame:
    """(group, value, slope): the objective at given weights (group, src, dst, w) and its gradient's norm; one concept's graph in a task."""
    kind, nodes = dict(edges.dtypes)[group], dict(edges.dtypes)["src"]
    none = F.lit(None).cast("double")
    rows = edges.select(group, "src", "dst", F.col("w").cast("double").alias("w"), none.alias("o")).union(
        observed.select(group, F.col("restart").cast(nodes), F.col("node").cast(nodes), none, F.col("o").cast("double"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf.src) | set(pdf.dst))
        at = {x: i for i, x in enumerate(ids)}
        g, o = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(ids)))
        for m, c in ((g, "w"), (o, "o")):
            part = pdf[pdf[c].notna()]
            m[[at[x] for x in part.src], [at[x] for x in part.dst]] = part[c]
        value, slope = objective(g, o, alpha, ridge)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "value": [value], "slope": [float(np.linalg.norm(slope))]})

    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, value double, slope double")


def recall(pairs: DataFrame, known: DataFrame, group: str = "wnid") -> DataFrame:
    """(group, n_seen, n_known, recall): how many of the pairs seen together are known ones."""
    low, high = F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")
    k = known.select(low, high).distinct().withColumn("k", F.lit(1))
    j = pairs.select(group, low, high).distinct().join(k, ["w1", "w2"], "left")
    g = j.groupBy(group).agg(F.count(F.lit(1)).alias("n_seen"), F.count("k").alias("n_known"))
    return g.withColumn("recall", F.col("n_known") / F.col("n_seen"))


def fit_edges(pairs: DataFrame, known: DataFrame, alpha: float = 0.5, ridge: float = 1e-3, dense_words: int = 1200, noise: float = 0.05, group: str = "wnid", max_iter: int = 60, tol: float = 1e-12) -> DataFrame:
    """(group, w1, w2, weight, start, end): learned weights of each group's graph, made symmetric, and the objective before and after.

    ``pairs`` has (group, w1, w2, w): co-occurrence; ``known`` has (w1, w2,
    weight) with weights up to 1. Candidates are the pairs seen together; those
    known start at their weight, others at a small one, and every candidate's
    weight is learned. Graphs of up to ``dense_words`` words are fitted in one
    task each, by a dense inverse; wider ones all together by ``descend``, with
    the same objective and gradient as joins.
    """
    seen = pairs.select(group, "w1", "w2", "w")
    k = known.groupBy(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.least(F.max("weight"), F.lit(1.0)).alias("k"))
    rows = seen.groupBy(group, F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.max("w").alias("w")).join(k, ["w1", "w2"], "left")
    jitter = noise * (0.5 + 0.5 * F.crc32(F.concat_ws("|", "w1", "w2")) / 2.0**32)
    rows = stage_table(rows.select(group, "w1", "w2", F.col("w").cast("double").alias("w"), F.coalesce("k", F.lit(0.0)).alias("k"), F.greatest(F.coalesce("k", F.lit(0.0)), jitter).alias("first")), "candidates")
    words = rows.select(group, F.col("w1").alias("word")).union(rows.select(group, "w2")).groupBy(group).agg(F.count_distinct("word").alias("n"))
    wide = words.where(F.col("n") > dense_words).select(group)
    kind = dict(pairs.dtypes)[group]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w1", "w2"])
        words = sorted(set(pdf.w1) | set(pdf.w2))
        at = {x: i for i, x in enumerate(words)}
        i, j = pdf.w1.map(at).to_numpy(int), pdf.w2.map(at).to_numpy(int)
        n = len(words)
        b, known_, init = (np.zeros((n, n)) for _ in range(3))
        for m, c in ((b, "w"), (known_, "k"), (init, "first")):
            m[i, j] = m[j, i] = pdf[c]
        g, got = fit_matrix(init, known_, stochastic(b), alpha, ridge, max_iter)
        g = (g + g.T) / 2
        return pd.DataFrame({group: pdf[group], "w1": pdf.w1, "w2": pdf.w2, "weight": g[i, j], "start": got.history[0], "end": got.f})

    out = rows.join(wide, group, "left_anti").groupBy(group).applyInPandas(fit, f"{group} {kind}, w1 string, w2 string, weight double, start double, end double")
    if not wide.take(1):
        return out
    large = rows.join(wide, group, "left_semi").select(F.col(group).alias("graph"), "w1", "w2", "w", "k", "first")
    both = large.union(large.where("w1 <> w2").select("graph", F.col("w2").alias("w1"), F.col("w1").alias("w2"), "w", "k", "first")).toDF("graph", "src", "dst", "w", "k", "first")
    total = both.groupBy("graph", "src").agg(F.sum("w").alias("s"))
    observed = both.join(total, ["graph", "src"]).select("graph", F.col("src").alias("restart"), F.col("dst").alias("node"), (F.col("w") / F.col("s")).alias("o"))
    weights, ends = descend(both.select("graph", "src", "dst", F.col("first").alias("w"), F.col("k").alias("low"), F.lit(1.0).alias("high")), stage_table(observed, "observed"), alpha, ridge, max_iter, tol=tol)
    even = weights.groupBy("graph", F.least("src", "dst").alias("w1"), F.greatest("src", "dst").alias("w2")).agg(F.avg("w").alias("weight"))
    return out.union(even.join(ends, "graph").select(F.col("graph").alias(group), "w1", "w2", "weight", "start", "end"))


def descend(edges: DataFrame, observed: DataFrame, alpha: float = 0.5, ridge: float = 1e-3, max_iter: int = 60, pgtol: float = 1e-5, factr: float = 1e7, tol: float = 1e-12, memory: int = 5) -> tuple[DataFrame, DataFrame]:
    """((graph, src, dst, w), (graph, start, end)): weights within (low, high) that lower the objective of each graph.

    Spectral projected gradient steps: down the slope and back into the bounds,
    by a length from the last two slopes; shortened until the objective is below
    the highest of the last few by a share of the slope. Weights and slopes stay
    in tables; the driver has a few numbers a graph.
    """
    spark = edges.sparkSession
    bounds = stage_table(edges.select("graph", "src", "dst", "low", "high"), "bounds")
    inside = lambda c: F.greatest(F.least(c, F.col("high")), F.col("low"))
    keys = ["graph", "src", "dst"]
    start = stage_table(edges.select(*keys, inside(F.col("w")).alias("w")), "weights")
    value, slopes = loss_and_gradient(start, observed, alpha, ridge, tol)
    now = stage_table(slopes.join(bounds, keys), "now")  # graph, src, dst, w, slope, low, high
    first = {r["graph"]: r["value"] for r in value.collect()}
    past = {g: [v] for g, v in first.items()}
    length = {r["graph"]: 1.0 / max(r["s"], 1e-12) for r in now.groupBy("graph").agg(F.max(F.abs(inside(F.col("w") - F.col("slope")) - F.col("w"))).alias("s")).collect()}
    live = set(first)
    kind = dict(edges.dtypes)["graph"]

    def numbers(**columns):
        return F.broadcast(spark.createDataFrame([(g, *(float(c[g]) for c in columns.values())) for g in sorted(live, key=str)], f"graph {kind}, " + ", ".join(f"{c} double" for c in columns)))  # a row a graph

    for _ in range(max_iter):
        moved = now.groupBy("graph").agg(F.max(F.abs(inside(F.col("w") - F.col("slope")) - F.col("w"))).alias("m")).collect()
        live -= {r["graph"] for r in moved if r["m"] <= pgtol}
        if not live:
            break
        step = stage_table(now.join(numbers(length=length), "graph").withColumn("d", inside(F.col("w") - F.col("length") * F.col("slope")) - F.col("w")).drop("length"), "step")
        fall = {r["graph"]: r["f"] for r in step.groupBy("graph").agg(F.sum(F.col("slope") * F.col("d")).alias("f")).collect()}
        share, todo, tried = dict.fromkeys(live, 1.0), set(live), []
        for _ in range(20):
            some = spark.createDataFrame([(g, share[g]) for g in sorted(todo, key=str)], f"graph {kind}, share double")
            new = stage_table(step.join(F.broadcast(some), "graph").select(*keys, inside(F.col("w") + F.col("share") * F.col("d")).alias("w")), "weights")
            value, slopes = loss_and_gradient(new, observed, alpha, ridge, tol)
            got = {r["graph"]: r["value"] for r in value.collect()}
            good = {g for g in todo if got[g] <= max(past[g][-memory:]) + 1e-4 * share[g] * fall[g]}
            if good:
                tried.append(stage_table(slopes.where(F.col("graph").isin(list(good))), "tried"))
            todo -= good
            for g in good:
                past[g].append(got[g])
            if not todo:
                break
            for g in todo:
                share[g] /= 2
        if not tried:
            break
        moved_to = tried[0]
        for t in tried[1:]:
            moved_to = moved_to.union(t)
        j = step.join(moved_to.withColumnsRenamed({"w": "w2", "slope": "slope2"}), keys)
        ds, dy = F.col("w2") - F.col("w"), F.col("slope2") - F.col("slope")
        for r in j.groupBy("graph").agg(F.sum(ds * ds).alias("ss"), F.sum(ds * dy).alias("sy")).collect():
            length[r["graph"]] = min(1e10, max(1e-10, r["ss"] / r["sy"])) if r["sy"] > 0 else 1e10
        done = now.join(moved_to.select("graph").distinct(), "graph", "left_anti")
        later = stage_table(j.select(*keys, F.col("w2").alias("w"), F.col("slope2").alias("slope"), "low", "high").union(done.select(*keys, "w", "slope", "low", "high")), "now")
        live -= todo
        live -= {g for g in live if abs(past[g][-2] - past[g][-1]) / max(abs(past[g][-2]), abs(past[g][-1]), 1.0) <= factr * np.finfo(float).eps}
        for t in (now, step, *tried):
            drop_stage(t)
        now = later
        if not live:
            break
    ends = spark.createDataFrame([(g, first[g], past[g][-1]) for g in first], f"graph {kind}, start double, end double")
    return now.select(*keys, "w"), ends
