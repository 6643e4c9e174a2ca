"""Local quadratic regression (loess) of a series, with a confidence band.

Definition (``surface = "direct"``): for every point x0 of a series of n
points, h is the distance to the floor(span * n)-th nearest x, weights are
tricube ``(1 - (|x - x0| / h)^3)^3`` inside h, and the fit is the intercept of
the weighted least-squares quadratic in u = (x - x0) / h (Cramer's rule on
the 3 x 3 normal equations).  Short and tied series: h is widened until three
distinct x carry weight; two distinct x give a line, one gives the mean.  The band uses the exact smoother matrix L:
``se = s * sqrt(rowSums(L^2))``, ``s^2 = RSS / d1``, t quantile with
``d1^2 / d2`` degrees of freedom, d1 = tr((I-L)'(I-L)), d2 = tr(((I-L)'(I-L))^2).

Execution: the input series are *aggregates* (one row per week or month), so
each series is bounded by its calendar, not by the raw data.  Series are
grouped by key and fitted with ``applyInPandas`` - one vectorised numpy task
per series, many series in parallel; the fit is chunked over x0 so memory
stays O(chunk x n) when no band is requested.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256


def _bandwidth(x, x0, q, need):
    """Distance to the q-th nearest point; where fewer than ``need`` distinct x
    lie inside it, the next larger distance (twice the reach if there is none)."""
    h = np.partition(np.abs(x[None, :] - x0[:, None]), q - 1, axis=1)[:, q - 1]
    near = np.sort(np.abs(np.unique(x)[None, :] - x0[:, None]), axis=1)
    reach = near[:, need - 1]
    wider = np.where(near > reach[:, None], near, np.inf).min(axis=1)
    wider = np.where(np.isfinite(wider), wider, 2 * reach)
    h = np.where(h > reach, h, wider)
    return np.where(h > 0, h, 1.0)


def _moments(x, x0, q, need):
    d = x[None, :] - x0[:, None]
    u = d / _bandwidth(x, x0, q, need)[:, None]
    r = np.abs(u)
    w = np.where(r < 1, (1 - r ** 3) ** 3, 0.0)
    s = [np.sum(w * u ** k, axis=1) for k in range(5)]
    return u, w, s


def _fit_chunk(x, y, x0, q):
    need = min(3, len(np.unique(x)))
    u, w, (s0, s1, s2, s3, s4) = _moments(x, x0, q, need)
    t0, t1, t2 = (np.sum(w * u ** k * y[None, :], axis=1) for k in range(3))
    if need == 3:
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
        c0, c1, c2 = s2 * s4 - s3 * s3, -(s1 * s4 - s3 * s2), s1 * s3 - s2 * s2
    elif need == 2:  # a line
        det, c0, c1, c2 = s0 * s2 - s1 * s1, s2, -s1, np.zeros_like(s0)
    else:  # the mean
        det, c0, c1, c2 = s0, np.ones_like(s0), np.zeros_like(s0), np.zeros_like(s0)
    fit = (t0 * c0 + t1 * c1 + t2 * c2) / det
    rows = w * (c0[:, None] + c1[:, None] * u + c2[:, None] * u * u) / det[:, None]
    return fit, rows


def loess_fit(x: np.ndarray, y: np.ndarray, span: float = 0.75, level: float | None = None) -> pd.DataFrame:
    """Fit (and optionally the band) of one series, in numpy."""
    n = len(x)
    q = min(max(int(math.floor(n * span)), 1), n)
    fits = np.empty(n)
    smoother = np.empty((n, n)) if level else None
    for start in range(0, n, CHUNK):
        fit, rows = _fit_chunk(x, y, x[start:start + CHUNK], q)
        fits[start:start + CHUNK] = fit
        if level:
            smoother[start:start + CHUNK] = rows
    out = pd.DataFrame({"x": x, "y": y, "fit": fits})
    if level:
        resid = np.eye(n) - smoother
        a = resid.T @ resid
        d1, d2 = np.trace(a), np.trace(a @ a)
        s = math.sqrt(float(np.sum((y - fits) ** 2)) / d1) if d1 > 0 else float("nan")
        se = s * np.sqrt(np.sum(smoother ** 2, axis=1))
        df = d1 * d1 / d2 if d2 > 0 else float("nan")
        t = t_quantile(0.5 + level / 2, df)
        out["se"], out["lower"], out["upper"] = se, fits - t * se, fits + t * se
    return out


def loess(df: DataFrame, x: str, y: str, key: str | None = None, span: float = 0.75,
          level: float | None = None) -> DataFrame:
    """L22 (and L23 with ``level``): loess of ``y`` on ``x`` per ``key``."""
    k = F.col(key).cast("string") if key else F.lit("all")
    series = df.select(k.alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cols = "key string, x double, y double, fit double"
    if level:
        cols += ", se double, lower double, upper double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="mergesort")
        out = loess_fit(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), span, level)
        out.insert(0, "key", pdf["key"].iloc[0])
        return out

    return series.groupBy("key").applyInPandas(run, cols)


# --- Student t quantile (no scipy in the image) -------------------------------

def _betacf(a, b, x):
    tiny, qab, qap, qam = 1e-300, a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def _betainc(a, b, x):
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    p = 0.5 * _betainc(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - p if t > 0 else p


def t_quantile(p: float, df: float) -> float:
    """Inverse of the Student t distribution function (bisection)."""
    if not (df > 0) or math.isnan(df):
        return float("nan")
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p and lo > -1e300:
        lo *= 2
    while t_cdf(hi, df) < p and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
