"""Gaussian-process fit per pixel with iterative removal of outliers.

The kernel adds a linear trend, a yearly cycle and, on unstable ground, short-range noise and a
locally linear term whose size follows the residuals of a weighted line. A fit predicts the series
on a grid; observations far from the prediction, by thresholds that tighten, go, and the fit is
repeated. One group is one numpy problem of some hundred points; groups travel as Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import cut
from .regression import dealt, line, robust_line

#: Z-scores beyond which points go, by iteration.
LIMITS = (20.0, 12.0, 9.0, 6.0, 4.0)
SPLIT_YEAR = 10.0


def default_kernel(a: np.ndarray, b: np.ndarray, base: float, nonlinear: float, period: float, unstable: bool) -> np.ndarray:
    return _Distances(a, b, unstable).kernel(a, b, base, nonlinear, period)


class _Distances:
    """What the default kernel takes from distances alone: the rounds of a fit share it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, unstable: bool):
        d = a[:, None] - b[None, :]
        self.unstable, self.square, self.yearly = unstable, d * d, 30 * np.exp(-2 * np.sin(np.pi * d) ** 2)
        if unstable:
            self.short = sum(share * np.exp(-self.square / (2 * scale**2)) for share, scale in ((0.6, 0.75), (0.3, 1.5), (0.1, 3.0)))

    def of(self, columns: np.ndarray, rows: np.ndarray | None = None) -> _Distances:
        out = object.__new__(_Distances)
        out.unstable = self.unstable
        for name in ("square", "yearly", *(("short",) if self.unstable else ())):
            part = getattr(self, name)[:, columns]
            setattr(out, name, part if rows is None else part[rows])
        return out

    def kernel(self, a: np.ndarray, b: np.ndarray, base: float, nonlinear: float, period: float) -> np.ndarray:
        product = a[:, None] * b[None, :]
        k = product + self.yearly
        if self.unstable:
            k = k + base * self.short
            if nonlinear:
                k = k + product * nonlinear * (1 + self.square / (20 * period**2)) ** -10
        return k


def _parameters(t: np.ndarray, y: np.ndarray, v: np.ndarray, final: bool, first: bool) -> tuple[float, float, float]:
    slope, intercept = line(t, y, 1 / v)
    res = y - slope * t - intercept
    scaled, plain = (np.sqrt(np.mean(res**2 / v)), np.sqrt(np.mean(res**2))) if np.isfinite(slope) else (1.0, np.sqrt(50.0))
    if final:
        if scaled == 0:
            return 50.0, float(np.mean(v)), 100.0
        return 50.0, float(np.mean(v) + (plain / scaled) ** 2), float(min(100.0, 100.0 / scaled**2))
    if first:
        return 100.0, 0.0, 20.0
    early, late = y[t < SPLIT_YEAR], y[t >= SPLIT_YEAR]
    base = 50.0
    if len(early) >= 5 and len(late) >= 5:
        gap, spread = abs(early.mean() - late.mean()), np.hypot(early.std(), late.std())
        if gap > spread:
            base += (gap - spread) ** 2 / 2
    return base, 0.0, 20.0


def _predict(kernel, t, y, v, grid):
    """Mean and deviation on ``grid`` from observations with variances ``v``; ``kernel(t, grid)``: covariances among t, of grid and t, variances on grid."""
    gram, cross, own = kernel(t, grid)
    gram = gram + np.diag(v)
    jitter = 0.0
    for _ in range(6):
        try:
            low = np.linalg.cholesky(gram + jitter * np.eye(len(y)))
            break
        except np.linalg.LinAlgError:
            jitter = max(jitter * 100, 1e-10 * np.trace(gram) / len(y))
    half = np.linalg.solve(low, np.column_stack([cross.T, y]))
    mean = half[:, :-1].T @ half[:, -1]
    return mean, np.sqrt(np.maximum(own - np.sum(half[:, :-1] ** 2, axis=0), 0))


def fit_series(t: np.ndarray, z: np.ndarray, err: np.ndarray, grid: np.ndarray, unstable: bool = True, robust_trend: bool = False, kernel=None, refit_trend: bool = False):
    """(mean, sigma) on ``grid`` (years) and which observations are kept; NaN where fewer than two are left.

    ``robust_trend`` takes a robust line out before the fit, that of the first round or, with ``refit_trend``, of each.
    ``kernel(a, b)`` replaces the default. ``grid`` must cover the observations.
    """
    keep = np.isfinite(t) & np.isfinite(z) & np.isfinite(err)
    nothing = np.full(len(grid), np.nan)
    if keep.sum() < 2:
        return nothing, nothing, np.zeros(len(t), bool)
    v = err**2
    removed, final, rounds = 1, False, 0
    mean = sigma = nothing
    trend = None
    places = np.flatnonzero(keep)
    if kernel is None:
        among, across = _Distances(t[places], t[places], unstable), _Distances(grid, t[places], unstable)
    left = len(t) + 8  # rounds past the fourth that go on remove a point, unless a score is the limit itself
    while (removed or not final) and keep.sum() >= 2 and left:
        good = keep.copy()
        parameters = _parameters(t[good], z[good], v[good], final, rounds == 0)
        shift = t[good].mean()
        if robust_trend:
            if trend is None or refit_trend:
                trend = robust_line(t[good], z[good], np.ones(good.sum()))[:2]
            slope, intercept = trend
            if not np.isfinite(slope):
                return nothing, nothing, keep
            base_obs, base_grid = slope * t + intercept, slope * grid + intercept
        else:
            base_obs, base_grid = np.full(len(t), z[good].mean()), np.full(len(grid), z[good].mean())
        at = np.flatnonzero(good[places])

        def covariances(a, b, at=at, p=parameters):
            if kernel is not None:
                return kernel(a, a), kernel(b, a), np.diag(kernel(b, b))
            own = b * b + 30 + (p[0] + b * b * p[1] if unstable else 0)
            return among.of(at, at).kernel(a, a, *p), across.of(at).kernel(b, a, *p), own

        mean, sigma = _predict(covariances, t[good] - shift, z[good] - base_obs[good], v[good], grid - shift)
        score = np.abs(z - base_obs - np.interp(t, grid, mean)) / np.maximum(np.interp(t, grid, sigma), 1e-12)
        mean = mean + base_grid
        score[~keep] = 0
        removed = int(np.sum(score >= 4))
        keep &= score <= LIMITS[min(rounds, 4)]
        rounds, left = rounds + 1, left - 1
        if final:
            removed = 0
        elif removed == 0 and rounds > 1:
            removed, final, rounds = 1, True, 4
    if keep.sum() < 2:
        return nothing, nothing, keep
    return mean, sigma, keep


def _fits(df: DataFrame, keys: list[str], grid: list[float], t: str, z: str, err: str, unstable: str | None, robust_trend: bool, kernel, refit_trend: bool) -> DataFrame:
    """A row per group: keys, z and z_ci on the grid, the times of its observations and whether each is kept."""
    types = dict(df.dtypes)
    at = np.asarray(grid, float)
    cols = [*keys, t, z, err, *([unstable] if unstable else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([t, z])
        flag = bool(pdf[unstable].iloc[0]) if unstable else True
        times = pdf[t].to_numpy(float)
        mean, sigma, keep = fit_series(times, pdf[z].to_numpy(float), pdf[err].to_numpy(float), at, flag, robust_trend, kernel, refit_trend)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "z": [mean], "z_ci": [sigma], "times": [times], "kept": [keep]})

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", z array<double>, z_ci array<double>, times array<double>, kept array<boolean>"
    return dealt(df.select(*cols), keys).groupBy(*keys).applyInPandas(run, schema)


def _series(fits: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    at = F.array(*[F.lit(float(x)) for x in grid])
    n = F.size(F.filter("kept", lambda x: x)).cast("long").alias("n_kept")
    return fits.select(*keys, F.explode(F.arrays_zip(at.alias("t"), "z", "z_ci")).alias("s"), n).select(*keys, "s.t", "s.z", "s.z_ci", "n_kept")


def fit_gp(df: DataFrame, keys: list[str], grid: list[float], t: str = "t", z: str = "z", err: str = "err", unstable: str | None = None, robust_trend: bool = False, kernel=None, refit_trend: bool = False) -> DataFrame:
    """keys, t, z, z_ci on ``grid`` (in the unit of ``t``, years) and n_kept for every group."""
    return _series(_fits(df, keys, grid, t, z, err, unstable, robust_trend, kernel, refit_trend), keys, grid)


def fit_gp_kept(df: DataFrame, keys: list[str], grid: list[float], t: str = "t", z: str = "z", err: str = "err", unstable: str | None = None, robust_trend: bool = False, kernel=None, refit_trend: bool = False) -> tuple[DataFrame, DataFrame]:
    """(series as of :func:`fit_gp`, (keys, t, kept) of every observation), both from one fit."""
    fits = cut(_fits(df, keys, grid, t, z, err, unstable, robust_trend, kernel, refit_trend))
    kept = fits.select(*keys, F.explode(F.arrays_zip(F.col("times").alias("t"), "kept")).alias("s")).select(*keys, "s.t", "s.kept")
    return _series(fits, keys, grid), kept
