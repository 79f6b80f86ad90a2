"""Concept hierarchies: closure by depth, words by depth, records of one concept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import stage_table


def restrict_nodes(edges: DataFrame, nodes: DataFrame, node: str = "wnid") -> DataFrame:
    """Edges whose ends are both known."""
    k = nodes.select(node).distinct()
    return edges.join(k.withColumnRenamed(node, "parent"), "parent", "left_semi").join(k.withColumnRenamed(node, "child"), "child", "left_semi").select("parent", "child")


def isolated(nodes: DataFrame, edges: DataFrame, node: str = "wnid") -> DataFrame:
    ends = edges.select(F.col("parent").alias(node)).union(edges.select("child"))
    return nodes.select(node).distinct().join(ends.distinct(), node, "left_anti")


def closure(edges: DataFrame, max_depth: int = 64, per_path: bool = False) -> DataFrame:
    """(top, node, depth): what lies below each node, at each depth it is reached at, once, or once for each path.

    One join a level, each level written before the next: plans stay short and
    the loop ends with the deepest level.
    """
    step = edges.select("parent", "child")
    step = step if per_path else step.distinct()
    level = stage_table(step.select(F.col("parent").alias("top"), F.col("child").alias("node"), F.lit(1).alias("depth")), "level")
    out = level
    for depth in range(2, max_depth + 1):
        new = level.join(step, level["node"] == step["parent"]).select("top", F.col("child").alias("node"), F.lit(depth).alias("depth"))
        level = stage_table(new if per_path else new.distinct(), "level")
        if not level.take(1):
            return out
        out = out.union(level)
    raise ValueError(f"deeper than {max_depth} levels, or a cycle")


def words_by_depth(below: DataFrame, words: DataFrame) -> DataFrame:
    """(wnid, depth, words): normalised words of descendants at depths 1, 2, ... and of ancestors at -1, -2, ...; sets, sorted."""
    w = words.select("wnid", "word")
    down = below.join(w, F.col("node") == F.col("wnid")).select(F.col("top").alias("wnid"), "depth", "word")
    up = below.join(w, F.col("top") == F.col("wnid")).select(F.col("node").alias("wnid"), (-F.col("depth")).alias("depth"), "word")
    return down.union(up).groupBy("wnid", "depth").agg(F.array_sort(F.collect_set("word")).alias("words"))


def concept_records(nodes: DataFrame, edges: DataFrame, below: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """(wnid, depth, n_ancestors, n_descendants, children, n_tags, n_other): one row for each known concept.

    Depth is the longest way from above. ``n_other`` counts tags that are no
    word of the concept, its ancestors or its descendants. Repeated words count
    once, and only concepts that have tags meet the words of those near them.
    """
    n = nodes.select("wnid").distinct()
    up = below.groupBy(F.col("node").alias("wnid")).agg(F.max("depth").alias("depth"), F.count_distinct("top").alias("n_ancestors"))
    down = below.groupBy(F.col("top").alias("wnid")).agg(F.count_distinct("node").alias("n_descendants"))
    kids = edges.join(n.withColumnRenamed("wnid", "child"), "child", "left_semi").groupBy(F.col("parent").alias("wnid")).agg(
        F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children")
    )
    near = below.select(F.col("top").alias("wnid"), "node").union(below.select("node", "top")).union(n.select("wnid", "wnid")).distinct()
    near = near.join(counts.select("wnid").distinct(), "wnid", "left_semi")
    own = near.join(words.select(F.col("wnid").alias("node"), F.col("word").alias("tag")).distinct(), "node").select("wnid", "tag").distinct()
    tags = counts.groupBy("wnid").agg(F.count(F.lit(1)).alias("n_tags"))
    other = counts.join(own, ["wnid", "tag"], "left_anti").groupBy("wnid").agg(F.count(F.lit(1)).alias("n_other"))
    out = n
    for part in (up, down, kids, tags, other):
        out = out.join(part, "wnid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("wnid", zero("depth"), zero("n_ancestors"), zero("n_descendants"), F.coalesce("children", F.lit("")).alias("children"), zero("n_tags"), zero("n_other"))


def map_by_words(concepts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(wnid, cand): the first candidate that all of a concept's words point to; null where there is none."""
    size = concepts.groupBy("wnid").agg(F.count_distinct("word").alias("n"))
    hit = concepts.select("wnid", "word").distinct().join(candidates.select("word", "cand").distinct(), "word")
    full = hit.groupBy("wnid", "cand").agg(F.count(F.lit(1)).alias("k")).join(size, "wnid").where("k = n")
    return size.select("wnid").join(full.groupBy("wnid").agg(F.min("cand").alias("cand")), "wnid", "left")


def depth_range(tag_nodes: DataFrame, depths: DataFrame, tag: str = "tag", kind: str = "pos") -> DataFrame:
    """(tag, kind, min_depth, max_depth)."""
    return tag_nodes.join(depths, "wnid").groupBy(tag, kind).agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def name_query(nodes: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Nodes whose name up to the first dot is the query in lower case."""
    return nodes.where(F.lower(F.split(name, r"\.")[0]) == query.lower())


def path_similarity(below: DataFrame, nodes: DataFrame, node: str = "wnid", pairs: DataFrame | None = None) -> DataFrame:
    """(wn1, wn2, sim), wn1 < wn2: 1 / (1 + shortest way over a common ancestor); pairs without one have no row.

    With ``pairs`` (wn1, wn2) only those are looked at; else all nodes below
    each ancestor are paired, which for the root is every two.
    """
    n = nodes.select(node).distinct()
    up = below.select(F.col("node").alias(node), F.col("top").alias("anc"), "depth").union(n.select(node, F.col(node).alias("anc"), F.lit(0).alias("depth")))
    up = up.join(n, node, "left_semi").groupBy(node, "anc").agg(F.min("depth").alias("depth"))
    a, b = up.toDF("wn1", "anc", "d1"), up.toDF("wn2", "anc", "d2")
    met = a.join(b, "anc") if pairs is None else pairs.select("wn1", "wn2").distinct().join(a, "wn1").join(b, ["wn2", "anc"])
    return met.where("wn1 < wn2").groupBy("wn1", "wn2").agg((1 / (1 + F.min(F.col("d1") + F.col("d2")))).alias("sim"))
