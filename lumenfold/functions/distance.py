"""Distances, as Column expressions over arrays and as numpy functions over blocks of points.

Both add the components up in order, so that they give the same bits. NUMBERS has the five metrics of the command
line; those that are squared sums there are returned as square roots, which is what the later steps use.

Weights count a component so many times (in minkowski, within the power). seuclidean takes 1 / variance as weights and
mahalanobis the inverse covariance matrix, by rows. Metrics of truth values take 0 for false and all else for true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of metrics; those of truth values; other names of the same metrics; numbers of the command line.
PLAIN = ("manhattan", "euclidean", "chebyshev", "minkowski", "dso", "sqeuclidean", "cosine", "canberra", "braycurtis", "correlation", "hamming", "haversine", "nan_euclidean", "seuclidean", "mahalanobis")
TRUTH = ("dice", "jaccard", "matching", "rogerstanimoto", "russellrao", "sokalsneath", "yule")
ALIASES = {"l1": "manhattan", "cityblock": "manhattan", "l2": "euclidean", "wminkowski": "minkowski"}
NUMBERS = {1: "manhattan", 2: "euclidean", 3: "chebyshev", 4: "minkowski", 5: "dso"}
METRICS = PLAIN + TRUTH
Metric = str | int | Callable[[np.ndarray, np.ndarray], np.ndarray]
Weights = Sequence[float] | Sequence[Sequence[float]] | None


def metric_name(metric: Metric) -> Metric:
    """A metric's name, by name or number; a callable (block, block) -> matrix is passed on."""
    metric = NUMBERS.get(metric, metric) if isinstance(metric, int) else metric
    if callable(metric):
        return metric
    metric = ALIASES.get(metric, metric)
    if metric not in METRICS:
        raise ValueError(f"metric: {metric!r}; one of {', '.join((*METRICS, *ALIASES))}, 1 to 5, or a callable")
    return metric


def _checked(metric: Metric, p: float, weights: Weights) -> None:
    if p <= 0:
        raise ValueError(f"p: {p}; more than 0")
    if metric in ("seuclidean", "mahalanobis") and weights is None:
        raise ValueError(f"weights: {metric} needs them")
    if weights is not None and metric != "mahalanobis" and any(w < 0 for w in weights):
        raise ValueError("weights: none may be negative")


def _truth_share(metric: str, tt: Any, tf: Any, ft: Any, ff: Any) -> tuple[Any, Any]:
    """Numerator and denominator of a metric of truth values, from the weights of the four kinds of components."""
    odd = tf + ft
    return {
        "dice": lambda: (odd, tt * 2 + odd),
        "jaccard": lambda: (odd, tt + odd),
        "matching": lambda: (odd, tt + odd + ff),
        "rogerstanimoto": lambda: (odd * 2, tt + ff + odd * 2),
        "russellrao": lambda: (odd + ff, tt + odd + ff),
        "sokalsneath": lambda: (odd * 2, tt + odd * 2),
        "yule": lambda: (tf * ft * 2, tt * ff + tf * ft),
    }[metric]()


def distance(a: Column, b: Column, metric: Metric = "euclidean", p: float = 2.0, weights: Weights = None) -> Column:
    """Distance of two arrays of double; null where a is 0 in a component (dso), or where a norm or all that a share is
    taken of is 0 (cosine, correlation, braycurtis). Metrics of truth values are 0 there."""
    metric = metric_name(metric)
    _checked(metric, p, weights)
    if callable(metric):
        raise TypeError("a callable metric works on blocks of points only")
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    gap = F.zip_with(a, b, lambda x, y: x - y)
    if metric == "mahalanobis":
        rows = [total(F.zip_with(F.array(*(F.lit(float(x)) for x in row)), gap, lambda x, t: x * t)) for row in weights]
        return F.sqrt(total(F.zip_with(gap, F.array(*rows), lambda x, t: x * t)))
    w = F.array(*(F.lit(float(x)) for x in weights)) if weights is not None else None
    weighted = lambda terms: F.zip_with(w, terms, lambda x, t: x * t) if w is not None else terms
    count = lambda when: total(weighted(F.zip_with(a, b, lambda x, y: when(x, y).cast("double"))))
    if metric == "manhattan":
        return total(weighted(F.transform(gap, lambda d: F.abs(d))))
    if metric in ("euclidean", "sqeuclidean", "seuclidean"):
        s = total(weighted(F.transform(gap, lambda d: d * d)))
        return s if metric == "sqeuclidean" else F.sqrt(s)
    if metric == "nan_euclidean":
        there = lambda x, y: x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        s = total(weighted(F.zip_with(a, b, lambda x, y: F.when(there(x, y), (x - y) * (x - y)).otherwise(F.lit(0.0)))))
        return F.sqrt(F.try_divide(s * count(lambda x, y: F.lit(True)), count(there)))
    if metric == "chebyshev":
        return F.array_max(weighted(F.transform(gap, lambda d: F.abs(d))))
    if metric == "minkowski":
        return F.pow(total(F.transform(weighted(F.transform(gap, lambda d: F.abs(d))), lambda d: F.pow(d, F.lit(float(p))))), F.lit(1.0 / p))
    if metric == "dso":
        shares = F.zip_with(gap, a, lambda d, x: F.try_divide(d, x))
        return F.sqrt(total(weighted(F.transform(shares, lambda d: d * d))))
    if metric == "canberra":
        return total(weighted(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0)))))
    if metric == "braycurtis":
        return F.try_divide(total(weighted(F.transform(gap, lambda d: F.abs(d)))), total(weighted(F.zip_with(a, b, lambda x, y: F.abs(x + y)))))
    if metric == "hamming":
        return F.try_divide(count(lambda x, y: x != y), count(lambda x, y: F.lit(True)))
    if metric == "haversine":  # latitude and longitude in radians
        s = F.pow(F.sin((b[0] - a[0]) / 2), 2) + F.cos(a[0]) * F.cos(b[0]) * F.pow(F.sin((b[1] - a[1]) / 2), 2)
        return F.lit(2.0) * F.asin(F.sqrt(s))
    if metric in TRUTH:
        yes = lambda x: x != 0
        cells = [count(lambda x, y, i=i, j=j: (yes(x) == F.lit(i)) & (yes(y) == F.lit(j))) for i in (True, False) for j in (True, False)]
        return F.coalesce(F.try_divide(*_truth_share(metric, *cells)), F.lit(0.0))
    if metric == "correlation":
        mean = lambda x: F.try_divide(total(weighted(x)), count(lambda s, t: F.lit(True)))
        a, b = (F.zip_with(x, F.array_repeat(mean(x), F.size(x)), lambda s, t: s - t) for x in (a, b))
    dot = lambda x, y: total(weighted(F.zip_with(x, y, lambda s, t: s * t)))
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def block_distance(a: np.ndarray, b: np.ndarray, metric: Metric = "euclidean", p: float = 2.0, weights: Weights = None) -> np.ndarray:
    """Matrix of distances of two blocks of points; NaN where `distance` is null."""
    metric = metric_name(metric)
    _checked(metric, p, weights)
    if callable(metric):
        return metric(a, b)
    if metric == "mahalanobis":
        m = np.asarray(weights, dtype=float)
        gap = a[:, None, :] - b[None, :, :]
        return np.sqrt(np.maximum(0, np.einsum("ijk,kl,ijl->ij", gap, m, gap)))
    w = np.ones(a.shape[1]) if weights is None else np.asarray(weights, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric in ("cosine", "correlation"):
            if metric == "correlation":
                a, b = (x - (w * x).sum(axis=1, keepdims=True) / w.sum() for x in (a, b))
            norm = lambda x: np.sqrt((w * x * x).sum(axis=1))
            return 1 - (a * w) @ b.T / np.outer(norm(a), norm(b))
        if metric in TRUTH:
            x, y = (a != 0).astype(float), (b != 0).astype(float)
            cells = [(s * w) @ t.T for s in (x, 1 - x) for t in (y, 1 - y)]
            top, base = _truth_share(metric, *cells)
            return np.divide(top, base, out=np.zeros_like(top), where=base > 0)
    if metric == "haversine":
        s = np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2
        return 2.0 * np.arcsin(np.sqrt(s))
    out = np.zeros((len(a), len(b)))
    below = np.zeros_like(out) if metric in ("braycurtis", "nan_euclidean") else None
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        d = x - y
        if metric in ("manhattan", "braycurtis"):
            out += w[k] * np.abs(d)
            if below is not None:
                below += w[k] * np.abs(x + y)
        elif metric in ("euclidean", "sqeuclidean", "seuclidean"):
            out += w[k] * (d * d)
        elif metric == "nan_euclidean":
            there = ~np.isnan(d)
            out += np.where(there, w[k] * (d * d), 0.0)
            below += w[k] * there
        elif metric == "chebyshev":
            np.maximum(out, w[k] * np.abs(d), out=out)
        elif metric == "minkowski":
            out += (w[k] * np.abs(d)) ** p
        elif metric == "hamming":
            out += w[k] * (d != 0)
        elif metric == "dso":
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(x == 0, np.nan, d / x)
            out += w[k] * (share * share)
        elif metric == "canberra":
            size = np.abs(x) + np.abs(y)
            out += w[k] * np.divide(np.abs(d), size, out=np.zeros_like(size), where=size > 0)
    if metric in ("euclidean", "dso", "seuclidean"):
        return np.sqrt(out)
    if metric == "nan_euclidean":
        return np.sqrt(np.divide(out * w.sum(), below, out=np.full_like(out, np.nan), where=below > 0))
    if metric == "minkowski":
        return out ** (1.0 / p)
    if metric == "hamming":
        return out / w.sum()
    if below is not None:
        return np.divide(out, below, out=np.full_like(out, np.nan), where=below > 0)
    return out


#: Metrics that grow with each component's gap: a box's nearest corner bounds the distance of all points in it.
BOUNDED = ("manhattan", "euclidean", "chebyshev", "minkowski", "dso", "sqeuclidean", "seuclidean", "hamming")
#: Of these, those that obey the triangle inequality: a ball around a centre bounds the distance, too.
TRIANGLE = ("manhattan", "euclidean", "chebyshev", "minkowski", "seuclidean")
_SLACK = 1e-9  # sums in another order than the distance itself


def _size(gap: np.ndarray, metric: Metric, p: float, w: np.ndarray) -> np.ndarray:
    """What gaps in each component (the last axis) add up to."""
    if metric == "manhattan":
        return (w * gap).sum(axis=-1)
    if metric == "chebyshev":
        return (w * gap).max(axis=-1)
    if metric == "minkowski":
        return ((w * gap) ** p).sum(axis=-1) ** (1.0 / p)
    if metric == "hamming":
        return (w * (gap > 0)).sum(axis=-1) / w.sum()
    s = (w * gap * gap).sum(axis=-1)
    return s if metric == "sqeuclidean" else np.sqrt(s)


def _ones(weights: Weights, dim: int) -> np.ndarray:
    return np.ones(dim) if weights is None else np.asarray(weights, dtype=float)


def box_bound(a: np.ndarray, low: np.ndarray, high: np.ndarray, metric: Metric, p: float = 2.0, weights: Weights = None) -> np.ndarray:
    """For each point and box, a distance that no point of the box undercuts."""
    metric = metric_name(metric)
    if metric not in BOUNDED:
        return np.full((len(a), len(low)), -np.inf)
    out, w = np.empty((len(a), len(low))), _ones(weights, a.shape[1])
    for j in range(len(low)):
        gap = np.abs(a - np.clip(a, low[j], high[j]))
        if metric == "dso":
            gap = np.divide(gap, np.abs(a), out=np.full_like(gap, np.inf), where=a != 0)
        out[:, j] = _size(gap, metric, p, w)
    return out * (1 - _SLACK)


def ball_bound(a: np.ndarray, centre: np.ndarray, radius: np.ndarray, metric: Metric, p: float = 2.0, weights: Weights = None) -> np.ndarray:
    """For each point and ball, a distance that no point of the ball undercuts."""
    metric = metric_name(metric)
    if metric not in TRIANGLE or metric == "minkowski" and p < 1:
        return np.full((len(a), len(centre)), -np.inf)
    d = block_distance(a, centre, metric, p, weights)
    return d - radius - _SLACK * (d + radius)


def boxes_bound(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, metric: Metric, p: float = 2.0, weights: Weights = None) -> np.ndarray:
    """For one box and each of several, a distance that no two of their points undercut."""
    metric = metric_name(metric)
    if metric not in BOUNDED:
        return np.full(len(lows), -np.inf)
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    if metric == "dso":
        far = np.maximum(np.abs(low), np.abs(high))
        gap = np.divide(gap, far, out=np.full_like(gap, np.inf), where=far > 0)
    return _size(gap, metric, p, _ones(weights, lows.shape[1])) * (1 - _SLACK)
