"""Bilinear tag models: r ~ x' U' V y on observed entries, with squared or smooth hinge loss.

U and V are small and live on the driver. Observed entries, joined with both
features, stay distributed: each evaluation is one pass in which partitions add
up the loss and the gradient of U'V, a p x q matrix, and a grouped sum by place
adds up the partitions, so the driver gets each place once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.learn.minimize import minimize_box
from tagweave.session import stage_table


@dataclass
class Bilinear:
    u: np.ndarray
    v: np.ndarray
    history: list[float] = field(default_factory=list)

    @property
    def matrix(self) -> np.ndarray:
        return self.u.T @ self.v


def hinge(z):
    return np.where(z <= 0, 0.5 - z, np.where(z < 1, 0.5 * (1 - z) ** 2, 0.0)), np.where(z <= 0, -1.0, np.where(z < 1, z - 1, 0.0))


def _pass(entries: DataFrame, w: np.ndarray, loss: str) -> tuple[float, np.ndarray, int]:
    shared = entries.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        total, grad, n = 0.0, np.zeros_like(shared.value), 0
        for pdf in batches:
            x, y, r = np.stack(pdf.x), np.stack(pdf.y), pdf.r.to_numpy(float)
            z = ((x @ shared.value) * y).sum(1)
            if loss == "hinge":
                value, slope = hinge(z * r)
                slope = slope * r
            else:
                value, slope = 0.5 * (z - r) ** 2, z - r
            total, n = total + value.sum(), n + len(r)
            grad += (x * slope[:, None]).T @ y
        yield pd.DataFrame({"at": np.arange(-2, grad.size), "v": np.concatenate([[n, total], grad.ravel()])})

    sums = entries.select("x", "y", "r").mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # p * q + 2 rows
    shared.unpersist()
    got = np.zeros(w.size + 2)
    for r in sums:
        got[r["at"] + 2] = r["v"]
    return got[1], got[2:].reshape(w.shape), int(got[0])


def _mean_size(entries: DataFrame, w: np.ndarray) -> float:
    """The mean absolute prediction."""
    shared = entries.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"z": np.abs(((np.stack(pdf.x) @ shared.value) * np.stack(pdf.y)).sum(1))})

    return entries.select("x", "y").mapInPandas(run, "z double").agg(F.avg("z")).first()[0] or 0.0


def objective_at(r: DataFrame, x: DataFrame, y: DataFrame, w: np.ndarray, loss: str = "l2") -> tuple[float, np.ndarray, int]:
    """(loss, gradient, entries) of the model matrix ``w`` on r (img_id, tag, r), x (img_id, vec) and y (tag, vec); no penalty."""
    xs = x.select("img_id", F.col("vec").cast("array<double>").alias("x"))
    ys = y.select("tag", F.col("vec").cast("array<double>").alias("y"))
    return _pass(r.select("img_id", "tag", "r").join(xs, "img_id").join(ys, "tag").select("x", "y", "r"), w, loss)


def fit_bilinear(r: DataFrame, x: DataFrame, y: DataFrame, k: int = 5, alpha: float = 1.0, loss: str = "l2", max_iter: int = 10, inner: int = 10, tol: float = 1e-5, seed: int = 0) -> Bilinear:
    """Fit on r (img_id, tag, r), x (img_id, vec) and y (tag, vec): alternately U and V, each by a few quasi-Newton steps.

    The objective is the loss plus alpha / 2 (|U|^2 + |V|^2).
    """
    xs = x.select("img_id", F.col("vec").cast("array<double>").alias("x"))
    ys = y.select("tag", F.col("vec").cast("array<double>").alias("y"))
    entries = stage_table(r.select("img_id", "tag", "r").join(xs, "img_id").join(ys, "tag").select("x", "y", "r"), "entries")
    first = entries.select(F.size("x").alias("p"), F.size("y").alias("q")).first()
    g = np.random.default_rng(seed)
    u, v = g.standard_normal((k, first.p)) * 0.1, g.standard_normal((k, first.q)) * 0.1
    # scale the start to the size of the targets
    mean_r = entries.agg(F.avg(F.abs("r"))).first()[0]
    mean_p = _mean_size(entries, u.T @ v)
    scale = np.sqrt(mean_r / mean_p) if mean_p else 1.0
    u, v = u * scale, v * scale
    history = []

    def objective(uu, vv):
        value, grad, _ = _pass(entries, uu.T @ vv, loss)
        return value + 0.5 * alpha * ((uu**2).sum() + (vv**2).sum()), grad

    for _ in range(max_iter):
        def of_u(flat):
            uu = flat.reshape(u.shape)
            f, grad = objective(uu, v)
            return f, (v @ grad.T + alpha * uu).ravel()

        got = minimize_box(of_u, u.ravel(), max_iter=inner)
        u = got.x.reshape(u.shape)

        def of_v(flat):
            vv = flat.reshape(v.shape)
            f, grad = objective(u, vv)
            return f, (u @ grad + alpha * vv).ravel()

        got = minimize_box(of_v, v.ravel(), max_iter=inner)
        v = got.x.reshape(v.shape)
        history.append(got.f)
        if len(history) > 1 and abs(history[-2] - history[-1]) <= tol * max(1.0, abs(history[-1])):
            break
    return Bilinear(u, v, history)


def predict_bilinear(model: Bilinear, x: DataFrame, y: DataFrame) -> DataFrame:
    """(img_id, tag, score) of all images and tags; tags are few and sent to all (checked)."""
    from tagweave.operators.features import predict

    tags = y.select("tag", "vec").limit(20_001).toPandas()
    if len(tags) > 20_000:
        raise ValueError("more than 20000 tags: predict them in parts")
    return predict(x, model.matrix @ np.stack(tags.vec.map(lambda t: np.asarray(t, float))).T, tags.tag.tolist())
