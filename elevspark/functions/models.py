"""Variogram models, covariance kernels, effective sample sizes and standard errors as column expressions.

The integrals behind effective sample sizes have closed forms; only the rings of a rectangle are summed,
for a batch of rows at a time in one Arrow function. Quotients without a value are null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MODELS = ("Sph", "Exp", "Gau", "Exc")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def variogram(h, crange, model: str = "Sph", psill=1.0, nugget=0.0, kappa: float = 0.5) -> Column:
    """Semivariance at lag ``h``: spherical, exponential, Gaussian or exponential-class."""
    h, a, c, n = map(_col, (h, crange, psill, nugget))
    r = h / a
    shape = {
        "Sph": lambda: F.when(h < a, 1.5 * r - 0.5 * F.pow(r, F.lit(3.0))).otherwise(F.lit(1.0)),
        "Exp": lambda: 1 - F.exp(-r),
        "Gau": lambda: 1 - F.exp(-r * r),
        "Exc": lambda: 1 - F.exp(-F.pow(r, F.lit(kappa))),
    }[model]()
    return n + c * shape


def covariance(h, crange, model: str = "Sph", psill=1.0, nugget=0.0, kappa: float = 0.5) -> Column:
    """Total sill less the semivariance (the nugget is in the sill only)."""
    return _col(nugget) + _col(psill) - variogram(h, crange, model, psill, 0.0, kappa)


def kernel(x, x0, crange, model: str = "Exc", kappa: float = 0.5) -> Column:
    """Correlation of two positions: 1 at distance 0."""
    r = F.abs(_col(x) - _col(x0)) / _col(crange)
    if model == "Exc":
        return F.exp(-F.pow(r, F.lit(kappa)))
    if model == "Exp":
        return F.exp(-r)
    if model == "Gau":
        return F.exp(-r * r)
    return F.when(r > 1, F.lit(0.0)).otherwise(1 - 1.5 * r + 0.5 * F.pow(r, F.lit(3.0)))


def covariance_integral(upper, crange, model: str, psill) -> Column:
    """The integral of h C(h) from 0 to ``upper``."""
    h, a, c = map(_col, (upper, crange, psill))
    if model == "Sph":
        m = F.least(h, a)
        return c * (m * m / 2 - F.pow(m, F.lit(3.0)) / (2 * a) + F.pow(m, F.lit(5.0)) / (10 * F.pow(a, F.lit(3.0))))
    if model == "Exp":
        return c * (a * a - a * (a + h) * F.exp(-h / a))
    if model == "Gau":
        return c * a * a / 2 * (1 - F.exp(-(h / a) * (h / a)))
    if model == "Exc":  # exponent 1/2: the incomplete gamma function of order 4
        s = F.sqrt(h / a)
        return 2 * c * a * a * (6 - F.exp(-s) * (((s + 3) * s + 6) * s + 6))
    raise ValueError(f"no closed form for {model}")


def _total(upper, models) -> Column:
    return sum((covariance_integral(upper, a, m, c) for a, m, c in models[1:]), covariance_integral(upper, *(models[0][0], models[0][1], models[0][2])))


def _sills(models) -> Column:
    return sum((_col(c) for _, _, c in models[1:]), _col(models[0][2]))


def neff_circ(area, models) -> Column:
    """Effective samples in a disk of ``area``; ``models``: (range, model, partial sill) each."""
    area = _col(area)
    return F.try_divide(_sills(models) * area, 2 * math.pi * _total(F.sqrt(area / math.pi), models))


def _integrals(h: np.ndarray, a: np.ndarray, c: np.ndarray, model: str) -> np.ndarray:
    """:func:`covariance_integral` of arrays."""
    if model == "Sph":
        m = np.minimum(h, a)
        q = m * m
        return c * (q / 2 - q * m / (2 * a) + q * q * m / (10 * a**3))
    if model == "Exp":
        return c * (a * a - a * (a + h) * np.exp(-h / a))
    if model == "Gau":
        return c * a * a / 2 * (1 - np.exp(-((h / a) ** 2)))
    if model == "Exc":
        s = np.sqrt(h / a)
        return 2 * c * a * a * (6 - np.exp(-s) * (((s + 3) * s + 6) * s + 6))
    raise ValueError(f"no closed form for {model}")


def neff_rect(area, width, models, pieces: int = 99) -> Column:
    """Effective samples in a rectangle: a disk of its smaller side, then rings cut by the long edges."""
    names = [m for _, m, _ in models]
    if unknown := set(names) - set(MODELS):
        raise ValueError(f"no closed form for {unknown}")

    @F.arrow_udf("double")
    def found(rows: pa.Array) -> pa.Array:
        v = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1).T[:, :, None]
        with np.errstate(all="ignore"):
            size, ranges, sills = v[0], v[2::2], v[3::2]
            w = np.minimum(v[1], size / v[1])
            step = (size / w - w / 2) / pieces
            edges = w / 2 + step * np.arange(pieces + 1)
            total = sum(_integrals(edges, a, c, m) for a, c, m in zip(ranges, sills, names, strict=True))
            rings = np.diff(total, axis=1) * (2 / np.pi) * np.arctan(w / (2 * (edges[:, :-1] + step / 2)))
            out = (sills.sum(0) * size)[:, 0] / (2 * np.pi * (total[:, 0] + rings.sum(1)))
        return pa.array(out, pa.float64(), mask=~np.isfinite(out))

    return found(F.array(*[_col(x).cast("double") for x in (area, width, *[y for a, _, c in models for y in (a, c)])]))


def std_err(std, neff) -> Column:
    return _col(std) * F.sqrt(F.try_divide(F.lit(1.0), _col(neff)))


def std_err_finite(std, population, sample) -> Column:
    """Standard error where ``sample`` of ``population`` effective samples are seen."""
    n, k = _col(population), _col(sample)
    return _col(std) * F.sqrt(F.try_divide(n - k, n * n))


def linear_err(delta, max_acceleration) -> Column:
    """Largest error of a linear interpolation over ``delta`` under a bound on the second derivative."""
    return _col(delta) * _col(delta) / 8 * _col(max_acceleration)


def gauss_weights(n: int = 11, sigma: float = 1.0) -> list[float]:
    """Values of the normal density at the whole numbers around 0."""
    return [math.exp(-(x**2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi)) for x in range(-(n // 2), n // 2 + 1)]


def nearest_index(values: Column, at) -> Column:
    """Index of the element of an array nearest to ``at`` (the first of equals; null elements never are)."""
    gaps = F.transform(values, lambda x, i: F.struct(F.coalesce(F.abs(x - _col(at)), F.lit(float("inf"))).alias("d"), i.alias("i")))
    return F.array_min(gaps)["i"]
