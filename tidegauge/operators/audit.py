"""Offline audit: robust seasonal-trend decomposition of each table's latencies, and drift of the trend.

The decomposition is by Cleveland et al. (1990): inner rounds of loess over each weekday's subseries, a low-pass filter and loess of the trend, outer
rounds of robustness weights. It needs a table's whole history at once, as the published method does; a group is one table's runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.windows import by_table, carried_forward, whole_table


def loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local linear fits at places `at` of a series on 0..n-1, with tricube weights over the `span` nearest points."""
    n = len(y)
    x = np.arange(n, dtype=float)
    far = np.abs(x[None, :] - at[:, None])
    reach = np.partition(far, min(span, n) - 1, axis=1)[:, min(span, n) - 1]
    reach = reach + max(0, (span - n) // 2)
    h = np.maximum(reach, 1e-12)[:, None]
    w = np.where(far <= 0.001 * h, 1.0, np.clip(1 - (far / h) ** 3, 0, None) ** 3) * (far <= 0.999 * h) * weights[None, :]
    total = w.sum(1)
    dead = total <= 0
    w = w / np.where(dead, 1.0, total)[:, None]
    mean = (w * x).sum(1)
    spread = (w * (x[None, :] - mean[:, None]) ** 2).sum(1)
    tilt = np.where(np.sqrt(spread) > 0.001 * max(n - 1, 1), (at - mean) / np.where(spread > 0, spread, 1.0), 0.0)
    fit = (w * (1 + tilt[:, None] * (x[None, :] - mean[:, None]))) @ y
    return np.where(dead, y[np.clip(at.round().astype(int), 0, n - 1)], fit)


def stl(y: np.ndarray, period: int = 7, seasonal: int = 7, trend: int = 15, low: int = 9, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual)."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("a series needs two periods at least")
    weights, t, s = np.ones(n), np.zeros(n), np.zeros(n)
    mean = lambda x, k: np.convolve(x, np.ones(k) / k, "valid")
    for _ in range(outer + 1):
        for _ in range(inner):
            wide = np.zeros(n + 2 * period)
            for d in range(period):
                sub, w = (y - t)[d::period], weights[d::period]
                wide[d :: period][: len(sub) + 2] = loess(sub, seasonal, w, np.arange(-1, len(sub) + 1, dtype=float))
            slow = loess(mean(mean(mean(wide, period), period), 3), low, np.ones(n), np.arange(n, dtype=float))
            s = wide[period : period + n] - slow
            t = loess(y - s, trend, weights, np.arange(n, dtype=float))
        r = np.abs(y - t - s)
        scale = 6 * np.median(r)
        weights = np.where(r <= 0.001 * scale, 1.0, np.where(r >= 0.999 * scale, 0.0, (1 - (r / max(scale, 1e-300)) ** 2) ** 2))
    return t, s, y - t - s


def _decompose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("day_idx", ignore_index=True)
    y = pdf.pop("__lat").to_numpy(float)
    try:
        parts = stl(y)
    except ValueError:
        parts = (y, np.zeros(len(y)), y - y.mean())
    return pdf.assign(**dict(zip(("stl_trend", "stl_seasonal", "stl_residual"), parts, strict=True)))


def decompose(df: DataFrame) -> DataFrame:
    """df with stl_trend, stl_seasonal, stl_residual; a table with fewer than 14 runs has its latencies as trend."""
    slim = df.select("table_name", "day_idx", carried_forward("latency_minutes").alias("__lat"))
    schema = T.StructType([f for f in slim.schema if f.name != "__lat"] + [T.StructField(c, T.DoubleType()) for c in ("stl_trend", "stl_seasonal", "stl_residual")])
    return df.join(slim.groupBy("table_name").applyInPandas(_decompose, schema), ["table_name", "day_idx"])


def trend_drift(df: DataFrame, ref_len: int = 45, z_threshold: float = 5.0, min_run: int = 3, strict: bool = True) -> DataFrame:
    """table_name, drift_detected, first_alert_day, peak_trend_z: is the trend `min_run` times in a row above its reference, and from which day on.

    Level is the trend's mean over the first ref_len rows, scale the residual's deviation there. Raises for missing columns and for a table
    shorter than ref_len + min_run; unless strict, such a table's row has nulls. Works on any trend and residual columns of these names.
    """
    missing = {"table_name", "day_idx", "stl_trend", "stl_residual"} - set(df.columns)
    if missing:
        raise KeyError(f"columns are missing: {sorted(missing)}")
    rn = F.row_number().over(by_table())
    df = df.select("table_name", "day_idx", "stl_trend", "stl_residual", rn.alias("__rn"))
    ref = F.col("__rn") <= ref_len
    sd = F.stddev_samp(F.when(ref, F.col("stl_residual"))).over(whole_table())
    level = F.avg(F.when(ref, F.col("stl_trend"))).over(whole_table())
    n = F.count(F.lit(1)).over(whole_table())
    brief = F.raise_error(F.lit("a series is shorter than the reference window and a run")) if strict else F.lit(1)
    short = F.when(n < ref_len + min_run, brief).otherwise(F.lit(0))
    df = df.withColumns({"__z": (F.col("stl_trend") - level) / F.when(sd > 0, sd).otherwise(1e-9), "__short": short.cast("int")})
    ahead = F.sum((F.col("__z") > z_threshold).cast("int")).over(by_table().rowsBetween(Window.currentRow, min_run - 1))
    out = df.withColumn("__hit", (ahead >= min_run) & (F.col("__short") == 0)).groupBy("table_name")
    first, known = F.min(F.when(F.col("__hit"), F.col("day_idx"))), F.max("__short") == 0
    return out.agg(F.when(known, first.isNotNull()).alias("drift_detected"), first.alias("first_alert_day"), F.when(known, F.round(F.max("__z"), 2)).alias("peak_trend_z"))
