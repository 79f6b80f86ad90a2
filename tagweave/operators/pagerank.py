"""Personalised PageRank by sparse pushes, and gradients of its losses by the adjoint iteration.

Both keep what they compute as rows (group, restart, node) and work by joins
with the edges; no node set is held in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.graph import transition
from tagweave.session import drop_stage, stage_table

#: Rounds that one job computes before its rows are written.
ROUNDS = 5


def push(edges: DataFrame, restarts: DataFrame, alpha: float = 0.5, threshold: float = 1e-6, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """((restart, node, p), (restart, left)): PageRank whose rows follow the mass, and how much mass isn't placed yet.

    A restart begins with a residual of 1 at itself. In each round every
    residual of at least ``threshold`` is pushed: 1 - alpha of it stays as p,
    alpha goes on along the edges. Residuals below stay, and their sum
    ``left`` bounds the error of the restart's row: each p is too small by
    ``left`` at most, and all of them together by exactly that.

    Nodes without outgoing weight go everywhere alike. That mass isn't spread
    node by node: it is a multiple, one number a restart, of a distribution
    shared by all restarts (that of a restart everywhere), of which entries
    below ``threshold`` once multiplied are left out, and counted in ``left``.
    Restarts that no edge names have no row.
    """
    w = stage_table(transition(edges).withColumnRenamed("p", "t"), "transition")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    dangling = stage_table(nodes.join(w.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), "dangling")
    own = restarts.select("restart").distinct().join(nodes.withColumnRenamed("node", "restart"), "restart", "left_semi")
    start = own.select("restart", F.col("restart").alias("node"), F.lit(1.0).alias("r"))
    got = _pushed(start, w, alpha, threshold, max_rounds)
    placed = got.where("p > 0").select("restart", "node", "p")
    left = got.groupBy("restart").agg(F.sum("r").alias("left"))
    if dangling.take(1):
        n = nodes.count()
        # the shared distribution: one more restart, which begins at every node alike
        begin = nodes.select(F.lit(0).alias("restart"), "node", F.lit(1.0 / n).alias("r"))
        alike = stage_table(_pushed(begin, w, alpha, min(threshold, threshold / n), max_rounds).select("node", "p"), "alike")
        back = alike.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("s")).first()["s"]
        odds = alpha / (1 - alpha)
        lost = placed.join(dangling, "node", "left_semi").groupBy("restart").agg((F.sum("p") * odds / (1 - odds * back)).alias("m"))
        lost = stage_table(lost, "lost")
        heavy = alike.where(F.col("p") >= threshold)  # at most 1 / threshold nodes
        more = lost.join(heavy, F.col("m") * F.col("p") >= threshold).select("restart", "node", (F.col("m") * F.col("p")).alias("p"))
        placed = placed.union(more).groupBy("restart", "node").agg(F.sum("p").alias("p"))
    placed = stage_table(placed, "placed")
    total = placed.groupBy("restart").agg((1 - F.sum("p")).alias("left"))
    return placed, left.select("restart").join(total, "restart", "left").select("restart", F.greatest(F.coalesce("left", F.lit(1.0)), F.lit(0.0)).alias("left"))


def _pushed(start: DataFrame, w: DataFrame, alpha: float, threshold: float, max_rounds: int) -> DataFrame:
    """(restart, node, p, r) once no residual reaches ``threshold``; ``start`` has (restart, node, r)."""
    state = stage_table(start.select("restart", "node", F.lit(0.0).alias("p"), "r"), "push")
    for _ in range(max_rounds):
        if not state.where(F.col("r") >= threshold).take(1):
            return state
        live = F.col("r") >= threshold
        kept = state.select("restart", "node", (F.col("p") + F.when(live, (1 - alpha) * F.col("r")).otherwise(0.0)).alias("p"), F.when(live, 0.0).otherwise(F.col("r")).alias("r"))
        flow = state.where(live).join(w, F.col("node") == F.col("src")).select("restart", F.col("dst").alias("node"), F.lit(0.0).alias("p"), (alpha * F.col("r") * F.col("t")).alias("r"))
        new = stage_table(kept.union(flow).groupBy("restart", "node").agg(F.sum("p").alias("p"), F.sum("r").alias("r")), "push")
        drop_stage(state)
        state = new
    raise RuntimeError(f"residuals above {threshold} after {max_rounds} rounds")


# ---- losses and gradients, many graphs at a time ----
KEYS = ["graph", "restart", "node"]


def stochastic_arrows(edges: DataFrame) -> DataFrame:
    """(graph, src, dst, t): rows of (graph, src, dst, w) divided by their sums; a node whose row has no weight goes to all of its graph alike."""
    total = edges.groupBy("graph", "src").agg(F.sum("w").alias("_t")).where("_t > 0")
    nodes = graph_nodes(edges)
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"))
    idle = nodes.join(total.select("graph", F.col("src").alias("node")), ["graph", "node"], "left_anti").withColumnRenamed("node", "src")
    alike = idle.join(n, "graph").join(nodes.withColumnRenamed("node", "dst"), "graph").select("graph", "src", "dst", (1 / F.col("_n")).alias("t"))
    return edges.where("w <> 0").join(total, ["graph", "src"]).select("graph", "src", "dst", (F.col("w") / F.col("_t")).alias("t")).union(alike)


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.col("src").alias("node")).union(edges.select("graph", "dst")).distinct()


def fixed_point(base: DataFrame, arrows: DataFrame, alpha: float, tol: float = 1e-12) -> DataFrame:
    """(graph, restart, node, x) with x = base + alpha * x carried along ``arrows`` (graph, src, dst, t).

    Terms of the series are added until alpha to their number is below ``tol``;
    ``ROUNDS`` of them, a join and a grouped sum each, make one job. Rows are
    those that something arrives at.
    """
    terms = max(1, math.ceil(math.log(tol) / math.log(alpha))) if 0 < alpha < 1 else 0
    x, written = base.select(*KEYS, "x"), None
    for k in range(terms):
        flow = x.join(arrows.withColumnRenamed("src", "node"), ["graph", "node"]).select("graph", "restart", F.col("dst").alias("node"), (alpha * F.col("x") * F.col("t")).alias("x"))
        x = base.select(*KEYS, "x").union(flow).groupBy(*KEYS).agg(F.sum("x").alias("x"))
        if k % ROUNDS == ROUNDS - 1 or k == terms - 1:
            x = stage_table(x, "series")
            if written is not None:
                drop_stage(written)
            written = x
    return x


def all_restarts(edges: DataFrame, alpha: float = 0.5, tol: float = 1e-12) -> DataFrame:
    """(graph, restart, node, x): PageRank of every node of each graph as restart."""
    base = graph_nodes(edges).select("graph", F.col("node").alias("restart"), "node", F.lit(1 - alpha).alias("x"))
    return fixed_point(base, stage_table(stochastic_arrows(edges), "arrows"), alpha, tol)


def loss_and_gradient(edges: DataFrame, observed: DataFrame, alpha: float = 0.5, ridge: float = 1e-3, tol: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """((graph, value), (graph, src, dst, w, slope)): the objective of each graph and its derivative by the weight of each edge.

    The objective is half the ridge on the weights plus half the squared misfit
    of every restart's PageRank to ``observed`` (graph, restart, node, o), the
    restart itself left out; pairs that weren't observed count as 0.

    With the misfit m of a restart, the adjoint solves l = m + alpha W l: the
    same series along turned arrows. Moving weight onto W(i, j) changes the loss
    by alpha p(i) l(j), summed over restarts for the edges alone; rows divided
    by their sums give (that - its mean over the row by W) / sum. An edge of
    weight 0 has a slope as well; where a whole row has none, only the ridge's.
    """
    arrows = stage_table(stochastic_arrows(edges), "arrows")
    base = graph_nodes(edges).select("graph", F.col("node").alias("restart"), "node", F.lit(1 - alpha).alias("x"))
    p = fixed_point(base, arrows, alpha, tol)
    both = p.select(*KEYS, "x", F.lit(0.0).alias("o")).union(observed.select(*KEYS, F.lit(0.0), F.col("o").cast("double")))
    m = both.where("restart <> node").groupBy(*KEYS).agg((F.sum("x") - F.sum("o")).alias("x"))
    m = stage_table(m.where("x <> 0"), "misfit")
    turned = arrows.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), "t")
    adjoint = fixed_point(m, turned, alpha, tol)
    own = edges.groupBy("graph", "src", "dst").agg(F.sum("w").alias("w"))
    to_p, to_l = p.toDF("graph", "restart", "src", "p"), adjoint.toDF("graph", "restart", "dst", "l")
    by_edge = own.join(to_p, ["graph", "src"]).join(to_l, ["graph", "restart", "dst"]).groupBy("graph", "src", "dst").agg((alpha * F.sum(F.col("p") * F.col("l"))).alias("d"))
    rows = own.join(by_edge, ["graph", "src", "dst"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    sums = rows.groupBy("graph", "src").agg(F.sum("w").alias("s"), F.sum(F.col("d") * F.col("w")).alias("dw"))
    chain = F.when(F.col("s") > 0, (F.col("d") - F.col("dw") / F.col("s")) / F.col("s")).otherwise(0.0)
    slopes = stage_table(rows.join(sums, ["graph", "src"]).select("graph", "src", "dst", "w", (chain + ridge * F.col("w")).alias("slope")), "slopes")
    halves = slopes.select("graph", (0.5 * ridge * F.col("w") * F.col("w")).alias("v")).union(m.select("graph", 0.5 * F.col("x") * F.col("x")))
    value = stage_table(halves.groupBy("graph").agg(F.sum("v").alias("value")), "value")
    for done in (p, m, adjoint, arrows):
        drop_stage(done)
    return value, slopes
