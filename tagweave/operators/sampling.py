"""Samples and splits ordered by an arithmetic hash, so that they are the same on every engine and at every partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(ident, seed: int = 0) -> Column:
    """A place for whole-number ids: (id + seed) * 2654435761 modulo 2**32."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.pmod(F.pmod(c.cast("long") + seed, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))


def sample_pos_neg(df: DataFrame, label: str, ident: str, ratio: int = 8, max_pos: int = 10_000, max_neg: int = 20_000, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Positives up to ``max_pos``; negatives up to ``ratio`` for each of them and ``max_neg``."""
    by = by or []
    from tagweave.operators.stats import numbered_in

    r = numbered_in(df, [*by, label], spread(ident, seed), ident, name="_r")
    pos = df.where(F.col(label) == 1).groupBy(*by).agg(F.least(F.count(F.lit(1)), F.lit(max_pos)).alias("_p"))
    j = r.join(pos, by, "left") if by else r.crossJoin(F.broadcast(pos))
    most = F.when(F.col(label) == 1, F.lit(max_pos)).otherwise(F.least(ratio * F.coalesce("_p", F.lit(0)), F.lit(max_neg)))
    return j.where(F.col("_r") < most).select(*df.columns)


def entry_folds(df: DataFrame, label: str, ident: str, ratio: int, folds: int, seed: int = 0) -> DataFrame:
    """All ones and ``ratio`` zeros for each, dealt to disjoint folds of equal size; what is left over is dropped."""
    s = sample_pos_neg(df, label, ident, ratio, 1 << 31, 1 << 31, seed=seed)
    from tagweave.operators.stats import numbered

    r = numbered(s, spread(ident, seed + 1), ident, name="_i")
    size = F.floor(F.col("n") / folds)
    return r.where(F.col("_i") < size * folds).withColumn("fold", F.floor(F.col("_i") / size).cast("int")).drop("_i", "n")


def random_items(df: DataFrame, ident: str, m: int, seed: int = 0) -> DataFrame:
    return df.orderBy(spread(ident, seed), ident).limit(m)


def stratified_folds(df: DataFrame, label: str, ident: str, folds: int, seed: int = 0) -> DataFrame:
    """Each label's rows dealt evenly to exclusive folds 1 to ``folds``."""
    from tagweave.operators.stats import numbered_in

    r = numbered_in(df, [label], spread(ident, seed), ident, name="_r")
    size, over, at = F.floor(F.col("n") / folds), F.col("n") % folds, F.col("_r")
    # the first folds take one row more where the label's rows don't divide evenly
    fold = F.when(at < (size + 1) * over, F.floor(at / (size + 1))).otherwise(over + F.floor((at - (size + 1) * over) / F.greatest(size, F.lit(1))))
    return r.withColumn("fold", (fold + 1).cast("int")).select(*df.columns, "fold")


def collaborative_split(df: DataFrame, img: str, tag_id: str, label: str, n: int, min_tags: int = 1, seed: int = 0) -> DataFrame:
    """Images with ``min_tags`` positive tags: ``n`` positive and ``n`` negative tags each for training, the rest for the test."""
    many = df.groupBy(img).agg(F.sum((F.col(label) == 1).cast("int")).alias("_n")).where(F.col("_n") >= min_tags).select(img)
    w = Window.partitionBy(img, label).orderBy(spread(F.col(img) * 131 + F.col(tag_id), seed), tag_id)
    return df.join(many, img, "left_semi").withColumn("part", F.when(F.row_number().over(w) <= n, "train").otherwise("test"))


def legacy_split(df: DataFrame, img: str, label: str, min_tags: int = 5) -> DataFrame:
    """(img, n_tags, part): images with at least ``min_tags`` positive tags and those with fewer."""
    g = df.groupBy(img).agg(F.sum((F.col(label) == 1).cast("long")).alias("n_tags"))
    return g.withColumn("part", F.when(F.col("n_tags") >= min_tags, "many").otherwise("few"))


def recode(df: DataFrame, label: str = "label") -> DataFrame:
    """0 and 1 become -0.5 and 0.5; unknown entries have no row."""
    return df.withColumn("r", F.col(label) - F.lit(0.5))


def standard_normals(ident: str, n: int, seed: int = 0) -> list[Column]:
    """``n`` columns of independent standard normal numbers that depend on a row's identifier and the seed alone.

    Pairs of uniform numbers, 32 bits each of a digest of the identifier, turned
    into normal ones by their angle and radius; rows come out alike in any
    partitioning and when they are computed again.
    """
    out = []
    for k in range(0, n, 2):
        digest = F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed)), F.lit(str(k))))
        u, v = ((F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 2.0**32 for at in (1, 9))
        radius, angle = F.sqrt(-2 * F.log(u)), 2 * np.pi * v
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out[:n]


def gaussian_rows(df: DataFrame, ident: str, mean, cov, seed: int = 0) -> DataFrame:
    """(ident, x0, x1, ...): a draw from a normal distribution for each row, by the singular values of its covariance.

    Columns of the factor point so that their first part isn't negative.
    """
    u, s, _ = np.linalg.svd(np.asarray(cov, float))
    u = u * np.where(u[0] < 0, -1.0, 1.0)
    factor = u * np.sqrt(s)
    z = standard_normals(ident, len(s), seed)
    x = [sum((F.lit(float(w)) * c for w, c in zip(row, z)), F.lit(float(m))).alias(f"x{i}") for i, (m, row) in enumerate(zip(mean, factor))]
    return df.select(ident, *x)
