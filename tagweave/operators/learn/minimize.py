"""Minimisation within bounds: limited-memory quasi-Newton steps on the free variables, projected line search."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Minimum:
    x: np.ndarray
    f: float
    iterations: int
    evaluations: int
    status: str
    history: list[float] = field(default_factory=list)


def minimize_box(fun, x0, lower=None, upper=None, m: int = 5, factr: float = 1e7, pgtol: float = 1e-5, max_iter: int = 100, max_evals: int = 5000, watch=None) -> Minimum:
    """Least value of ``fun`` (value and gradient) with lower <= x <= upper.

    Stops if the projected gradient is at most ``pgtol``, if the relative
    decrease is at most ``factr`` times the machine precision, or at a limit.
    ``watch(x, f)`` is called after each iteration.
    """
    x = np.array(x0, float)
    lo = np.full_like(x, -np.inf) if lower is None else np.broadcast_to(np.asarray(lower, float), x.shape)
    hi = np.full_like(x, np.inf) if upper is None else np.broadcast_to(np.asarray(upper, float), x.shape)
    if (lo > hi).any():
        raise ValueError("a lower bound is above its upper bound")
    x = np.clip(x, lo, hi)
    f, g = fun(x)
    g = np.asarray(g, float)
    evals, pairs, history = 1, [], [float(f)]
    for it in range(1, max_iter + 1):
        moved = np.clip(x - g, lo, hi) - x
        if np.abs(moved).max(initial=0) <= pgtol:
            return Minimum(x, float(f), it - 1, evals, "gradient", history)
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        # two-loop recursion among the free variables
        q, back = np.where(free, g, 0), []
        for s, y in reversed(pairs):
            sf, yf = np.where(free, s, 0), np.where(free, y, 0)
            sy = sf @ yf
            if sy <= 1e-10 * (yf @ yf):
                continue
            a = sf @ q / sy
            q = q - a * yf
            back.append((sf, yf, sy, a))
        if back:
            sf, yf, sy, _ = back[0]
            q = q * (sy / (yf @ yf))
        else:
            q = q / max(1.0, np.abs(q).sum())
        for sf, yf, sy, a in reversed(back):
            q = q + (a - yf @ q / sy) * sf
        d = -np.where(free, q, 0)
        if d @ g >= 0:
            d, pairs = -np.where(free, g, 0), []
        step, best, low, high = 1.0, None, 0.0, np.inf
        while evals < max_evals:
            new = np.clip(x + step * d, lo, hi)
            fn, gn = fun(new)
            gn = np.asarray(gn, float)
            evals += 1
            ok = np.isfinite(fn) and fn <= f + 1e-4 * (g @ (new - x))
            if ok:
                best = (new, fn, gn)
                # a steep slope left asks for a longer step, as long as no bound cuts it
                if gn @ d < 0.9 * (g @ d) and np.array_equal(new, x + step * d) and low < 64:
                    low, step = step, (step + high) / 2 if np.isfinite(high) else 2 * step
                    if step - low < 1e-3 * step:
                        break
                    continue
                break
            high = step
            if best is not None:
                break
            step = (low + high) / 2 if np.isfinite(fn) else high / 10
            if step < 1e-20:
                break
        if best is None:
            if pairs:
                pairs = []
                continue
            return Minimum(x, float(f), it, evals, "line search", history)
        new, fn, gn = best
        s, y = new - x, gn - g
        if s @ y > 2.2e-16 * (y @ y):
            pairs = [*pairs, (s, y)][-m:]
        decrease = (f - fn) / max(abs(f), abs(fn), 1.0)
        x, f, g = new, fn, gn
        history.append(float(f))
        if watch is not None:
            watch(x, f)
        if decrease <= factr * np.finfo(float).eps:
            return Minimum(x, float(f), it, evals, "decrease", history)
        if evals >= max_evals:
            return Minimum(x, float(f), it, evals, "evaluations", history)
    return Minimum(x, float(f), max_iter, evals, "iterations", history)


def settled(new: float, old: float, threshold: float = 1e-4) -> tuple[bool, bool]:
    """(converged, decreased) of a rising objective."""
    decreased = new - old < -1e-3
    return abs(new - old) / ((abs(new) + abs(old) + np.finfo(float).eps) / 2) < threshold, decreased


def gaussian_sample(mean, cov, n: int, seed: int = 0) -> np.ndarray:
    """``n`` rows of a normal distribution, by the singular values of its covariance."""
    u, s, _ = np.linalg.svd(np.asarray(cov, float))
    return np.asarray(mean, float) + np.random.default_rng(seed).standard_normal((n, len(s))) @ (u * np.sqrt(s)).T


def paired_t(a, b) -> float:
    """The t statistic of paired differences."""
    d = np.asarray(a, float) - np.asarray(b, float)
    s = d.std(ddof=1)
    return float(d.mean() / (s / np.sqrt(len(d)))) if s > 0 else 0.0
