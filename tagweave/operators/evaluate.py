"""Ranking metrics: precision, recall, AP, AUC, F1 and their relatives, pooled or by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.stats import numbered
from tagweave.session import stage_table


def clean_labels(df: DataFrame, label: str, positive: list, negative: list) -> DataFrame:
    """Labels 1 and 0 by lists of values; rows with other values are left out. The lists must not overlap."""
    if set(positive) & set(negative):
        raise ValueError("a value can't be positive and negative")
    y = F.when(F.col(label).isin(positive), 1).when(F.col(label).isin(negative), 0)
    return df.withColumn(label, y).where(F.col(label).isNotNull())


def ranked(df: DataFrame, score: str, label: str, ident: str, by: list[str] | None = None) -> DataFrame:
    """Rows with rank ``k`` from 1, hits so far ``tp``, and the list's ``n`` and ``npos``; ties fall by ``ident``."""
    if by:
        # lists are dealt by range, so one that holds most rows is split; a range knows how many rows and hits of a list come before
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = df.select(*by, ident, score, label).repartitionByRange(parts, *by, F.desc(score), ident).withColumn("_p", F.spark_partition_id())
        rows = stage_table(rows, "ranges")
        every = Window.partitionBy(*by)  # a row for each list and range
        before = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_h"))
        sizes = sizes.select(
            F.col("_p").alias("_q"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
            F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_hits"), F.sum("_n").over(every).alias("n"), F.sum("_h").over(every).cast("long").alias("npos"),
        )
        same = F.col("_p") == F.col("_q")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        own = Window.partitionBy("_p", *by).orderBy(F.desc(score), ident)
        rows = rows.withColumn("_i", F.row_number().over(own)).withColumn("_s", F.sum(label).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.join(sizes, same).select(
            *by, ident, score, label, (F.col("_rows") + F.col("_i")).cast("long").alias("k"), (F.col("_hits") + F.col("_s")).cast("long").alias("tp"), "n", "npos"
        )
    # one list: places by ranges, and hits so far from the hits before each block of places
    r = numbered(df.select(ident, score, label), F.desc(score), ident, name="k").withColumn("k", F.col("k") + 1)
    block = F.floor(F.col("k") / 4096)
    r = r.withColumn("_b", block)
    sums = r.groupBy("_b").agg(F.sum(label).alias("_h"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # a row for 4096 places
    sums = sums.select("_b", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_before"), F.sum("_h").over(Window.partitionBy()).alias("npos"))
    own = F.sum(label).over(Window.partitionBy("_b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_own", own).join(sums, "_b").select(
        ident, score, label, "k", (F.col("_before") + F.col("_own")).cast("long").alias("tp"), "n", F.col("npos").cast("long").alias("npos")
    )


def pr_curve(df: DataFrame, score: str, label: str, ident: str, by: list[str] | None = None, ranks: int | None = None) -> DataFrame:
    """(k, pr, re, fp, accuracy): precision, recall, false-positive rate and accuracy at each rank, or at about ``ranks`` even ones."""
    r = ranked(df, score, label, ident, by)
    if ranks:
        step = F.greatest(F.lit(1), F.ceil(F.col("n") / ranks))
        r = r.where((F.col("k") % step == 0) | (F.col("k") == 1) | (F.col("k") == F.col("n")))
    k, tp, n, npos = (F.col(c) for c in ("k", "tp", "n", "npos"))
    return r.select(
        *(by or []), "k", (tp / k).alias("pr"), (tp / F.nullif(npos, F.lit(0))).alias("re"),
        ((k - tp) / F.nullif(n - npos, F.lit(0))).alias("fp"), ((tp + (n - npos) - (k - tp)) / n).alias("accuracy"),
    )


def rank_metrics(
    df: DataFrame,
    score: str,
    label: str,
    ident: str,
    by: list[str] | None = None,
    depth: int = 100,
    ap_depth: int | None = None,
    ap_range: tuple[float, float] | None = None,
    recall: float = 0.5,
) -> DataFrame:
    """One row for each list: ap, p_at_d, epr, prior, auc, f1, npos, n, score_thresh.

    AP is the mean precision at hits; with ``ap_depth`` only hits down to that
    rank add to it (all hits still divide it); with ``ap_range`` only those in
    that part of the ranks, and they alone divide it. AUC is the area under
    (fp, recall) by trapezoids through the first rank, the hits and the last
    rank. F1 is the best over ranks. ``score_thresh`` is the score where recall
    first reaches ``recall``. Lists without a hit have null ap, auc and epr.
    """
    by = by or []
    r = ranked(df, score, label, ident, by)
    k, tp, n, npos, hit = F.col("k"), F.col("tp"), F.col("n"), F.col("npos"), F.col(label) == 1
    pr, re = tp / k, tp / F.nullif(npos, F.lit(0))
    within = hit
    if ap_depth is not None:
        within = within & (k <= ap_depth)
    if ap_range is not None:
        within = within & (k >= ap_range[0] * n) & (k <= ap_range[1] * n)
    divide = F.count_if(within) if ap_range is not None else F.max(npos)
    # trapezoids through the hits add up to sums over the hits alone: with fp of the first, the last and all of them
    fp = F.when(hit, (k - tp) / F.nullif(n - npos, F.lit(0)))
    m, miss = F.max(npos), F.max(n) - F.max(npos)
    low, high, first = F.min(fp), F.max(fp), F.min(F.when(hit, k))
    between = ((2 * m + 1) * high - low - 2 * F.sum(fp)) / (2 * m)
    start = F.when(first > 1, (low - 1 / F.nullif(miss, F.lit(0))) / (2 * m)).otherwise(0.0)
    auc = F.when(m > 0, between + start + 1 - high)
    main = r.groupBy(*by).agg(
        (F.sum(F.when(within, pr).otherwise(0.0)) / F.nullif(divide, F.lit(0))).alias("ap"),
        F.max(F.when(k == F.least(F.lit(depth), n), pr)).alias("p_at_d"),
        F.max(F.when(k == npos, pr)).alias("epr"),
        (F.max(npos) / F.max(n)).alias("prior"),
        F.max(F.when(pr + re > 1e-12, 2 * pr * re / (pr + re))).alias("f1"),
        F.max(npos).alias("npos"),
        F.max(n).alias("n"),
        F.max(F.when(re >= recall, F.col(score))).alias("score_thresh"),
        auc.alias("auc"),
    )
    return main


def precision_at_k(df: DataFrame, score: str, label: str, ident: str, k: int, by: list[str]) -> DataFrame:
    """(by, p_at_k, prior) of each list."""
    r = ranked(df, score, label, ident, by)
    return r.groupBy(*by).agg(
        (F.sum(F.when(F.col("k") <= k, F.col(label)).otherwise(0)) / F.least(F.lit(k), F.max("n"))).alias("p_at_k"),
        (F.max("npos") / F.max("n")).alias("prior"),
    )


def relation_candidates(scores: DataFrame, target: DataFrame, known: DataFrame) -> DataFrame:
    """(w1, w2, score, label): scored pairs w1 < w2 that aren't known, label 1 if the target has them in either order."""
    pair = lambda d: d.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).where("w1 < w2").distinct()
    s = scores.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"), "score").where("w1 < w2")
    s = s.groupBy("w1", "w2").agg(F.max("score").alias("score")).join(pair(known), ["w1", "w2"], "left_anti")
    return s.join(pair(target).withColumn("_y", F.lit(1)), ["w1", "w2"], "left").select("w1", "w2", "score", F.coalesce("_y", F.lit(0)).alias("label"))


def relation_micro(scores: DataFrame, target: DataFrame, known: DataFrame) -> DataFrame:
    """One row: metrics over all candidate pairs, covered positives, their share of all positives, and their density among covered concepts."""
    c = relation_candidates(scores, target, known)
    m = rank_metrics(c.withColumn("id", F.concat_ws("|", "w1", "w2")), "score", "label", "id")
    pair = lambda d: d.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).where("w1 < w2").distinct()
    positives = pair(target).join(pair(known), ["w1", "w2"], "left_anti").agg(F.count(F.lit(1)).alias("positives"))
    words = c.select("w1").union(c.select("w2")).distinct().agg(F.count(F.lit(1)).alias("cnz"))
    j = m.crossJoin(F.broadcast(positives)).crossJoin(F.broadcast(words))
    return j.select(
        "ap", "auc", "f1", "npos", "n", (F.col("npos") / F.nullif("positives", F.lit(0))).alias("max_recall"),
        (2 * F.col("npos") / (F.col("cnz") * (F.col("cnz") - 1))).alias("r_prior"),
    )


def relation_macro(scores: DataFrame, target: DataFrame, known: DataFrame, depth: int = 5) -> DataFrame:
    """(concept, ap, f1, p_at_d, prior, npos, n) of each concept's other ends."""
    c = relation_candidates(scores, target, known)
    both = c.select(F.col("w1").alias("concept"), F.col("w2").alias("other"), "score", "label").union(c.select("w2", "w1", "score", "label"))
    return rank_metrics(both, "score", "label", "other", ["concept"], depth=depth).select("concept", "ap", "f1", "p_at_d", "prior", "npos", "n")
