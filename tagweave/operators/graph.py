"""Triples, subgraphs and personalised PageRank."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.session import drop_stage, stage_table


def from_features(features: DataFrame, min_edges: int = 500) -> tuple[DataFrame, DataFrame]:
    """(edges, relation sizes) of signed features (concept, feature, value).

    Features read ``right|rel|other`` or ``left|rel|other``. Negative values
    and left ones are dropped; an edge leads from the object to the subject.
    Relations below ``min_edges`` edges are left out of the edges returned, not
    of the sizes.
    """
    p = F.split("feature", r"\|")
    e = features.where((F.col("value") >= 0) & (p[0] == "right")).select(p[1].alias("rel"), p[2].alias("src"), F.col("concept").alias("dst"), F.col("value").alias("weight"))
    sizes = e.groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"))
    return e.join(sizes.where(F.col("n_edges") >= min_edges), "rel", "left_semi"), sizes


def filter_triples(triples: DataFrame, relations: list[str], pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Triples of the listed relations (any case) whose unordered pair of words is among ``pairs``, place names left out."""
    known = pairs.select(F.least("w1", "w2").alias("_a"), F.greatest("w1", "w2").alias("_b")).distinct()
    t = triples.where(F.lower("rel").isin([r.lower() for r in relations])).withColumn("_a", F.least("w1", "w2")).withColumn("_b", F.greatest("w1", "w2"))
    if places is not None:
        for side in ("w1", "w2"):
            t = t.join(places.select(F.col("word").alias(side)).distinct(), side, "left_anti")
    return t.join(known, ["_a", "_b"], "left_semi").select(*triples.columns)


def filter_counters(triples: DataFrame, relations: list[str], pairs: DataFrame) -> DataFrame:
    """(scanned, in_relation, in_vocab)."""
    rel = F.lower("rel").isin([r.lower() for r in relations])
    flat = triples.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(rel).alias("in_relation"))
    return flat.crossJoin(F.broadcast(filter_triples(triples, relations, pairs).agg(F.count(F.lit(1)).alias("in_vocab"))))


def collapse(triples: DataFrame, symmetric: bool = False) -> DataFrame:
    """(src, dst, weight): weights added over relations, over both directions if asked."""
    e = triples.select(F.col("w1").alias("src"), F.col("w2").alias("dst"), "weight")
    if symmetric:
        e = e.union(e.select("dst", "src", "weight"))
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def restrict(edges: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    k = words.select(word).distinct()
    return edges.join(k.withColumnRenamed(word, "src"), "src", "left_semi").join(k.withColumnRenamed(word, "dst"), "dst", "left_semi").select(*edges.columns)


def graph_counts(triples: DataFrame) -> DataFrame:
    """(rel, n_edges, n_src, n_dst)."""
    return triples.groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("w1").alias("n_src"), F.count_distinct("w2").alias("n_dst"))


def edge_recall(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """(n_ref, n_hit, recall): pairs of the reference that the edges have."""
    r, e = (d.select("src", "dst").distinct() for d in (reference, edges))
    hit = r.join(e.withColumn("_h", F.lit(1)), ["src", "dst"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_ref"), F.count("_h").alias("n_hit")).withColumn("recall", F.col("n_hit") / F.col("n_ref"))


def stars(triples: DataFrame, pairs: DataFrame, policy: DataFrame) -> DataFrame:
    """(graph_id, rel, root, dir, size, leaf): stars around the ranked pairs' words.

    ``pairs`` has w1, w2 and a total rank; ``policy`` has rel and dir, ``out`` or
    ``in``. A pair joined by an edge w1 -> w2 (else w2 -> w1) has its start as
    root, if that has more than one neighbour in the policy's direction. Roots
    are taken once for each relation and direction, and equal sets of nodes
    once in all, the best rank first.
    """
    t = triples.select("rel", "w1", "w2").distinct()
    a = pairs.select("rank", "w1", "w2")
    both = a.select("rank", F.lit(0).alias("turned"), "w1", "w2").union(a.select("rank", F.lit(1), "w2", "w1"))
    root = both.join(t, ["w1", "w2"]).join(policy.where(F.col("dir").isin("out", "in")), "rel").select("rank", "turned", "rel", "dir", F.col("w1").alias("root"))
    sides = t.select("rel", F.lit("out").alias("dir"), F.col("w1").alias("root"), F.col("w2").alias("leaf")).union(
        t.select("rel", F.lit("in"), F.col("w2"), F.col("w1"))
    )
    leaves = sides.groupBy("rel", "dir", "root").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")).where(F.size("leaves") > 1)
    found = root.join(leaves, ["rel", "dir", "root"])
    order = [F.col("rank"), F.col("turned"), F.col("rel"), F.col("dir"), F.col("root")]
    one = found.withColumn("_n", F.row_number().over(Window.partitionBy("rel", "dir", "root").orderBy(*order))).where("_n = 1")
    nodes = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array("root"), "leaves"))), "|")
    one = one.withColumn("_set", nodes).withColumn("_n", F.row_number().over(Window.partitionBy("_set").orderBy(*order))).where("_n = 1")
    ident = F.concat_ws(":", F.lit("s"), "rel", "dir", "root")
    return one.select(ident.alias("graph_id"), "rel", "root", "dir", (F.size("leaves") + 1).cast("long").alias("size"), F.explode("leaves").alias("leaf"))


def peeling_order(edges: DataFrame, share: float = 2.2) -> DataFrame:
    """(rel, a, round): when each node of undirected edges (rel, a, b), given both ways, is peeled off.

    In each round all nodes go whose degree is at most ``share`` times half the
    mean of what is left of their relation. That is a share of the nodes, so
    rounds are few, and a node has at most about ``share`` times the graph's
    degeneracy of neighbours that go with it or later.
    """
    left, out, r = stage_table(edges.select("rel", "a", "b"), "left"), None, 0
    while left.take(1):
        degree = left.groupBy("rel", "a").agg(F.count(F.lit(1)).alias("d"))
        mean = degree.groupBy("rel").agg((F.avg("d") * share / 2).alias("m"))
        gone = stage_table(degree.join(mean, "rel").where("d <= m").select("rel", "a", F.lit(r).alias("round")), "peeled")
        out = gone if out is None else out.union(gone)
        own = gone.select("rel", "a")
        new = stage_table(left.join(own, ["rel", "a"], "left_anti").join(own.withColumnRenamed("a", "b"), ["rel", "b"], "left_anti").select("rel", "a", "b"), "left")
        # nodes that lose their last neighbour go with the next round
        alone = left.select("rel", "a").distinct().join(own, ["rel", "a"], "left_anti").join(new.select("rel", "a").distinct(), ["rel", "a"], "left_anti")
        out = out.union(stage_table(alone.select("rel", "a", F.lit(r + 1).alias("round")), "peeled"))
        drop_stage(left)
        left, r = new, r + 1
    drop_stage(left)
    return out if out is not None else edges.select("rel", "a", F.lit(0).alias("round")).limit(0)


def cliques(triples: DataFrame, pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """(rel, w1, w2, size, members): the largest clique with both words of each pair, edges taken without direction.

    A clique with w1 and w2 lies in their common neighbourhood. Nodes are put in
    the order in which the graph peels, and every clique is looked for at its
    first node, among the neighbours of that which come later: so the
    neighbourhood of a pair of hubs is one small group for each of its nodes,
    about the graph's degeneracy wide, instead of one of squared size. Groups
    are searched with pivoting. The first in order wins among equals.
    """
    e = triples.select("rel", F.col("w1").alias("a"), F.col("w2").alias("b"))
    e = stage_table(e.union(e.select("rel", "b", "a")).where("a <> b").distinct(), "edges")
    order = stage_table(peeling_order(e).select("rel", F.col("a").alias("n"), F.struct("round", "a").alias("o")), "order")
    turned = e.join(order.toDF("rel", "a", "oa"), ["rel", "a"]).join(order.toDF("rel", "b", "ob"), ["rel", "b"]).where("oa < ob")
    turned = stage_table(turned.select("rel", "a", "b"), "turned")
    seeds = pairs.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).distinct().join(e.toDF("rel", "w1", "w2"), ["w1", "w2"])
    n1, n2 = e.toDF("rel", "w1", "c"), e.toDF("rel", "w2", "c")
    common = stage_table(seeds.join(n1, ["rel", "w1"]).join(n2, ["rel", "w2", "c"]).select("rel", "w1", "w2", "c"), "common")
    pair = ["rel", "w1", "w2"]
    later = common.join(turned.toDF("rel", "c", "d"), ["rel", "c"]).join(common.withColumnRenamed("c", "d"), [*pair, "d"], "left_semi").select(*pair, "c", "d")
    inner = later.join(turned.toDF("rel", "d", "f"), ["rel", "d"]).join(later.withColumnRenamed("d", "f"), [*pair, "c", "f"], "left_semi")
    none = F.lit(None).cast("string")
    rows = common.select(*pair, "c", none.alias("d"), none.alias("f")).unionByName(later.select(*pair, "c", "d", none.alias("f"))).unionByName(inner.select(*pair, "c", "d", "f"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set] = {d: set() for d in pdf.d if isinstance(d, str)}
        for d, f in zip(pdf.d, pdf.f):
            if isinstance(f, str):
                near[d].add(f)
                near[f].add(d)
        r = pdf.iloc[0]
        top: list[str] = []
        stack = [([], set(near), set())]
        while stack:
            have, cand, done = stack.pop()
            if not cand and not done:
                if len(have) > len(top) or len(have) == len(top) and sorted([r.c, *have]) < sorted([r.c, *top]):
                    top = have
                continue
            if len(have) + len(cand) < len(top):
                continue
            pivot = max(sorted(cand | done), key=lambda n: len(near[n] & cand))
            for n in sorted(cand - near[pivot]):
                stack.append(([*have, n], cand & near[n], done & near[n]))
                cand, done = cand - {n}, done | {n}
        inside = sorted([r.c, *top])
        return pd.DataFrame([[r.rel, r.w1, r.w2, len(inside), inside]], columns=[*pair, "size", "inside"])

    got = rows.groupBy(*pair, "c").applyInPandas(best, "rel string, w1 string, w2 string, size long, inside array<string>")
    first = got.groupBy(*pair).agg(F.min(F.struct((-F.col("size")).alias("n"), "inside")).alias("t"))
    members = F.array_sort(F.concat(F.array("w1", "w2"), "t.inside"))
    out = first.select(*pair, (2 - F.col("t.n")).alias("size"), F.array_join(members, ",").alias("members"))
    return out.where(F.col("size") >= min_size)


def triangles(triples: DataFrame) -> DataFrame:
    """(rel, a, b, c), a < b < c: cliques of three, by joins alone."""
    e = triples.select("rel", F.least("w1", "w2").alias("a"), F.greatest("w1", "w2").alias("b")).where("a < b").distinct()
    ab, bc, ac = e, e.toDF("rel", "b", "c"), e.toDF("rel", "a", "c")
    return ab.join(bc, ["rel", "b"]).join(ac, ["rel", "a", "c"], "left_semi").select("rel", "a", "b", "c")


def expand_to_words(subgraphs: DataFrame, term_words: DataFrame) -> DataFrame:
    """(graph_id, src, dst, weight): subgraph edges (graph_id, src, dst) between terms spread over their words, with multiplicities."""
    w = term_words.select("term", F.explode("words").alias("word"))
    s, d = w.toDF("src", "ws"), w.toDF("dst", "wd")
    return subgraphs.join(s, "src").join(d, "dst").groupBy("graph_id", F.col("ws").alias("src"), F.col("wd").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def star_edges(star_rows: DataFrame) -> DataFrame:
    """(graph_id, src, dst) of stars: root and leaf in both directions, and each with itself."""
    a = star_rows.select("graph_id", F.col("root").alias("src"), F.col("leaf").alias("dst"))
    loops = star_rows.select("graph_id", "root", "root").union(star_rows.select("graph_id", "leaf", "leaf")).distinct()
    return a.union(a.select("graph_id", "dst", "src")).union(loops.toDF("graph_id", "src", "dst"))


# ---- personalised PageRank ----
def transition(edges: DataFrame) -> DataFrame:
    """(src, dst, p): rows of weights divided by their sum; rows without weight are left out (they go everywhere alike)."""
    total = edges.groupBy("src").agg(F.sum("w").alias("_t")).where("_t > 0")
    return edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("p"))


def ppr(edges: DataFrame, restarts: DataFrame, alpha: float = 0.5, max_iter: int = 5, tol: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(restart, node, p): power iterations p <- alpha W'p + (1 - alpha) v from the uniform start.

    ``alpha`` is the chance to follow an edge. Nodes without outgoing weight go
    to all nodes alike; their mass is one number a restart. Each iteration is
    one join and one aggregation, written before the next. Stops after
    ``max_iter`` iterations, or when the change's norm divided by the number of
    nodes is at most ``tol`` for every restart.
    """
    if nodes is None:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    nodes = stage_table(nodes.select("node").distinct(), "nodes")
    w = stage_table(transition(edges).withColumnRenamed("p", "t"), "transition")
    n = nodes.count()
    dangling = nodes.join(w.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    has_dangling = bool(dangling.take(1))
    grid = restarts.select("restart").distinct().crossJoin(nodes)  # the result has a row for each: dense by definition
    p = grid.select("restart", "node", F.lit(1.0 / n).alias("p"))
    for _ in range(max_iter):
        flow = p.join(w, F.col("node") == F.col("src")).select("restart", F.col("dst").alias("node"), (F.col("p") * F.col("t") * alpha).alias("q"))
        jump = restarts.select("restart").distinct().select("restart", F.col("restart").alias("node"), F.lit(1 - alpha).alias("q"))
        got = flow.union(jump).groupBy("restart", "node").agg(F.sum("q").alias("q"))
        new = grid.join(got, ["restart", "node"], "left").select("restart", "node", F.coalesce("q", F.lit(0.0)).alias("q"))
        if has_dangling:
            lost = p.join(dangling, "node", "left_semi").groupBy("restart").agg((F.sum("p") * alpha / n).alias("_d"))
            new = new.join(lost, "restart", "left").select("restart", "node", (F.col("q") + F.coalesce("_d", F.lit(0.0))).alias("q"))
        new = stage_table(new.select("restart", "node", F.col("q").alias("p")), "ppr")
        if tol is not None:
            d = new.join(p.withColumnRenamed("p", "_old"), ["restart", "node"]).groupBy("restart").agg((F.sqrt(F.sum((F.col("p") - F.col("_old")) ** 2)) / n).alias("d"))
            if not d.where(F.col("d") > tol).take(1):
                return new
        drop_stage(p)
        p = new
    return p


def ppr_exact(edges: DataFrame, restarts: DataFrame, alpha: float = 0.5, max_nodes: int = 2000) -> DataFrame:
    """(restart, node, p): the fixed point, by one linear system shared by restarts, solved where the restarts are.

    For graphs of at most ``max_nodes`` nodes (checked before anything is
    gathered); rows without weight go everywhere alike. ``pagerank.push`` has no
    such bound.
    """
    ids = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().limit(max_nodes + 1).toPandas().node.tolist()
    if len(ids) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes; use ppr")
    ids = sorted(ids)
    at = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for s, d, x in edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).toPandas().itertuples(index=False):
        m[at[s], at[d]] = x
    row = m.sum(1, keepdims=True)
    m = np.where(row > 0, m / np.where(row > 0, row, 1), 1 / len(ids))
    inverse = edges.sparkSession.sparkContext.broadcast(((1 - alpha) * np.linalg.inv(np.eye(len(ids)) - alpha * m), ids))
    kind = dict(edges.dtypes)["src"]

    def solve(batches):
        p, names = inverse.value
        where = {x: i for i, x in enumerate(names)}
        for pdf in batches:
            for r in pdf.restart:
                if r in where:
                    yield pd.DataFrame({"restart": r, "node": names, "p": p[where[r]]})

    return restarts.select("restart").distinct().mapInPandas(solve, f"restart {kind}, node {kind}, p double")


def renormalized_ppr(edges: DataFrame, alpha: float = 0.5, renorm: str = "logistic", row_normalize: bool = True, max_iter: int = 50, tol: float | None = 1.19e-7) -> DataFrame:
    """(restart, node, p) for every node as restart, on weights saturated by ``logistic``, ``log10`` or not at all (``none``)."""
    from tagweave import functions as fn

    w = {"logistic": fn.logistic_renorm, "log10": fn.log10_renorm, "none": F.col}[renorm]("w")
    e = edges.select("src", "dst", w.alias("w"))
    restarts = edges.select(F.col("src").alias("restart")).union(edges.select("dst")).distinct()
    if row_normalize:
        return ppr(e, restarts, alpha, max_iter, tol)
    return _eigen_ppr(e, restarts, alpha)


def _eigen_ppr(edges: DataFrame, restarts: DataFrame, alpha: float, max_nodes: int = 2000) -> DataFrame:
    """Dominant left eigenvector of alpha W + (1 - alpha) 1 v' for weights that needn't sum to 1, normalised to sum 1."""
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    pdf = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).toPandas()  # at most the square of max_nodes
    ids = sorted(set(pdf.src) | set(pdf.dst))
    at = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    m[[at[x] for x in pdf.src], [at[x] for x in pdf.dst]] = pdf.w
    shared, kind = edges.sparkSession.sparkContext.broadcast((m, ids)), dict(edges.dtypes)["src"]

    def solve(batches):
        w, names = shared.value
        where = {x: i for i, x in enumerate(names)}
        for rows in batches:
            for r in rows.restart:
                p = np.full(len(names), 1 / len(names))
                for _ in range(500):
                    new = alpha * (w.T @ p)
                    new[where[r]] += (1 - alpha) * p.sum()
                    new /= new.sum() or 1
                    if np.abs(new - p).max() < 1e-12:
                        break
                    p = new
                yield pd.DataFrame({"restart": r, "node": names, "p": p})

    return restarts.mapInPandas(solve, f"restart {kind}, node {kind}, p double")


def node_pairs(n: int) -> list[tuple[int, int]]:
    """All pairs of positions below n, the larger first."""
    return [(j, i) for i, j in combinations(range(n), 2)]
