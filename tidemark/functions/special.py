"""Functions that Spark lacks, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: its series below a + 1, its continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    log_gamma = np.vectorize(math.lgamma, otypes=[float])(a)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        scale = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - log_gamma)
        term = total = 1 / a
        for k in range(1, 400):
            term = term * x / (a + k)
            total = total + term
        low = scale * total
        b = x + 1 - a
        c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for k in range(1, 400):
            an = -k * (k - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        high = 1 - scale * h
    return np.where(x <= 0, 0.0, np.where(x < a + 1, low, high))


def gamma_quantile(shape: np.ndarray, scale: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of gamma distributions, by bisection to full precision; NaN where the shape is not positive."""
    shape = np.asarray(shape, float)
    ok = np.isfinite(shape) & (shape > 0) & np.isfinite(scale) & (np.asarray(scale) > 0)
    a = np.where(ok, shape, 1.0)
    lo, hi = np.zeros_like(a), a + 20 * np.sqrt(a) + 50
    for _ in range(200):
        mid = (lo + hi) / 2
        below = gamma_cdf(a, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.where(ok, (lo + hi) / 2 * np.where(ok, scale, 1.0), np.nan)


@F.pandas_udf(T.DoubleType())
def gamma_ppf(q: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    out = np.full(len(q), np.nan)
    for value in q.dropna().unique():
        rows = (q == value).to_numpy()
        out[rows] = gamma_quantile(shape[rows].to_numpy(float), scale[rows].to_numpy(float), float(value))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def rbf_kernel(a: pd.Series, b: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(np.exp(-((np.asarray(x) - np.asarray(y)) ** 2).sum() / (2 * s * s))) for x, y, s in zip(a, b, sigma)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sig_truncated(xs: pd.Series, ts: pd.Series) -> pd.Series:
    """Levels 0 to 2 of the strict iterated sums of the path (t, x), as 1, t, x, tt, tx, xt, xx."""
    out = []
    for x, t in zip(xs, ts):
        p = np.stack([np.asarray(t, float), np.asarray(x, float)], 1)
        d = np.diff(p, axis=0)
        before = np.cumsum(d, axis=0) - d
        out.append([1.0, *(d.sum(0)), *(before.T @ d).reshape(-1)])
    return pd.Series(out)


@F.udtf(returnType=T.StructType([T.StructField(n, T.IntegerType()) for n in ("seg", "start_i", "end_i", "label")]))
class Segments:
    """SQL table function over an array of labels: its runs."""

    def eval(self, labels: list[int]):
        seg, start = 0, 0
        for k in range(1, len(labels or []) + 1):
            if k == len(labels) or labels[k] != labels[start]:
                yield seg, start + 1, k, labels[start]
                seg, start = seg + 1, k


def register(spark: SparkSession) -> None:
    """Make gamma_ppf, rbf, sig_truncated and segments callable from SQL."""
    spark.udf.register("gamma_ppf", gamma_ppf)
    spark.udf.register("rbf", rbf_kernel)
    spark.udf.register("sig_truncated", sig_truncated)
    spark.udtf.register("segments", Segments)
