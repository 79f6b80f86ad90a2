"""Mixtures of hierarchy levels: how much of a concept's tags each level explains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def em_levels(counts: np.ndarray, member: np.ndarray, max_iter: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """Level weights and word shares of a mixture, tags (n) by levels (k), by EM; the log-likelihood never falls."""
    w = member.sum(0) > 0
    p = w / w.sum()
    q = np.where(member.sum(0) > 0, member / np.maximum(member.sum(0), 1), 0)
    history: list[float] = []
    for _ in range(max_iter):
        joint = q * p
        total = joint.sum(1)
        live = total > 0
        history.append(float((counts[live] * np.log(total[live])).sum()))
        r = np.where(live[:, None], joint / np.where(live, total, 1)[:, None], 0) * counts[:, None]
        mass = r.sum(0)
        p = mass / mass.sum()
        q = np.where(mass > 0, r / np.where(mass > 0, mass, 1), q)
        if len(history) > 1 and history[-1] - history[-2] <= tol * abs(history[-2]):
            break
    return p, history


def level_mixture(counts: DataFrame, words: DataFrame, group: str = "wnid") -> DataFrame:
    """(group, depth, weight): share of a concept's tag counts explained by the words of each depth.

    ``counts`` has (group, tag, cnt), ``words`` (group, depth, words). Tags that
    no level has form the level ``other`` (null depth). Levels without a tag,
    and those whose tags equal a nearer level's, are left out.
    """
    lv = words.select(group, "depth", F.explode("words").alias("tag"))
    rows = counts.join(lv, [group, "tag"], "left").select(group, "tag", "cnt", "depth")
    kind = dict(counts.dtypes)[group]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tags = sorted(pdf.tag.unique())
        at = {t: i for i, t in enumerate(tags)}
        n = np.zeros(len(tags))
        n[[at[t] for t in pdf.tag]] = pdf.cnt
        levels, cols, seen = [], [], set()
        for d in sorted(pdf.depth.dropna().unique(), key=lambda d: (abs(d), d)):
            own = frozenset(pdf.tag[pdf.depth == d])
            if own in seen:
                continue
            seen.add(own)
            levels.append(int(d))
            cols.append([t in own for t in tags])
        rest = [not any(c[i] for c in cols) for i in range(len(tags))]
        if any(rest):
            levels.append(None)
            cols.append(rest)
        p, _ = em_levels(n, np.array(cols, float).T)
        out = pd.DataFrame({group: pdf[group].iloc[0], "depth": pd.array(levels, "Int64"), "weight": p})
        return out

    return rows.groupBy(group).applyInPandas(fit, f"{group} {kind}, depth long, weight double")
