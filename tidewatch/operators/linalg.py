"""Moment sums as aggregates, and least squares from them on the driver.

With k features the sums n, s_i, s_ij of complete rows (a missing feature or target drops the row) are
statistics of a training window that add up over any partition of its rows. Fits themselves come from
``factors``, which keep their precision at any level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An eigenvalue below this share of the largest, or a variance below this share of the raw second moment, counts as zero.
TINY, NOISE = 1e-10, 1e-13


def moment_names(k: int) -> list[str]:
    """n, then s_i and s_ij over the features 0..k-1 and the target k."""
    return ["n", *[f"s_{i}" for i in range(k + 1)], *[f"s_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]]


def moments(xs: Sequence[str], y: str) -> list[Column]:
    """Aggregates of the complete rows, named as in ``moment_names``."""
    cols = [F.col(c) for c in (*xs, y)]
    complete = F.lit(True)
    for c in cols:
        complete = complete & c.isNotNull()
    k = len(xs)
    out = [F.count_if(complete).alias("n")]
    out += [F.sum(F.when(complete, cols[i])).alias(f"s_{i}") for i in range(k + 1)]
    out += [F.sum(F.when(complete, cols[i] * cols[j])).alias(f"s_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    return out


def least_norm(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Intercept and coefficients by least squares on standardised features, of least norm if they are collinear.

    None without complete rows or if a feature does not vary.
    """
    ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
    mu, sd = np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=0), np.nanstd(np.where(np.isfinite(x), x, np.nan), axis=0)
    if not ok.any() or not (sd > 0).all():
        return None
    z = (x[ok] - mu) / sd
    b = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), y[ok], rcond=None)[0]
    return np.concatenate([[b[0] - (b[1:] * mu / sd).sum()], b[1:] / sd])


def least_norm_of_moments(sums: dict[str, float], k: int, constant: bool = True) -> np.ndarray | None:
    """Intercept and k coefficients of least squares, of least norm where features are collinear or do not vary.

    sums: values by ``moment_names``. Without ``constant`` the intercept is 0. None without complete rows.
    """
    n = sums["n"]
    if not n:
        return None
    raw = np.array([[sums[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    mean = np.array([sums[f"s_{i}"] for i in range(k + 1)], float) / n * constant
    centred = raw - n * np.outer(mean, mean)
    own = np.diag(centred)[:k]
    scale = np.sqrt(np.where(own > NOISE * np.diag(raw)[:k], own, np.inf))  # a feature that does not vary has no part
    values, vectors = np.linalg.eigh(centred[:k, :k] / np.outer(scale, scale))
    good = values > TINY * max(1.0, k)
    beta = (vectors[:, good] / values[good]) @ (vectors[:, good].T @ (centred[:k, k] / scale)) / scale
    out = np.concatenate([[mean[k] - beta @ mean[:k]], beta])
    if not good.all():  # directions in which the fit does not change, the intercept with them: what lies in them goes
        free = vectors[:, ~good] / np.where(np.isfinite(scale), scale, 1.0)[:, None]
        flat = np.vstack([-(mean[:k] @ free), free])
        q = np.linalg.qr(flat / np.linalg.norm(flat, axis=0))[0]
        out -= q @ (q.T @ out)
    return out
