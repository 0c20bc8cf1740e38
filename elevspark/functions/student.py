"""Student-t quantiles without scipy: a table for small degrees of freedom, an expansion beyond."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE = 200


@functools.cache
def quantile(p: float, df: int) -> float:
    """Bisection on the distribution function; t = sqrt(df) tan(theta) makes its density cos^(df - 1)."""
    if p < 0.5:
        return -quantile(1 - p, df)
    x, w = np.polynomial.legendre.leggauss(200)
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def beyond(theta: float) -> float:
        mid = theta / 2
        return 0.5 + norm * mid * float(np.sum(w * np.cos(mid + mid * x) ** (df - 1)))

    lo, hi = 0.0, math.pi / 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beyond(mid) < p else (lo, mid)
    return math.sqrt(df) * math.tan((lo + hi) / 2)


@functools.cache
def table(conf: float) -> tuple[float, ...]:
    """Two-sided quantiles for 1..TABLE degrees of freedom."""
    return tuple(quantile(0.5 + conf / 2, df) for df in range(1, TABLE + 1))


def _terms(conf: float) -> list[float]:
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    return [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]


def t_two_sided(df: Column, conf: float) -> Column:
    """The quantile for a column of degrees of freedom; null where there are none."""
    a, b, c, d = _terms(conf)
    v = df.cast("double")
    far = a + b / v + c / (v * v) + d / (v * v * v)
    near = F.get(F.array(*[F.lit(x) for x in table(conf)]), (df - 1).cast("int"))
    return F.when(df <= 0, F.lit(None).cast("double")).when(df <= TABLE, near).otherwise(far)


def t_sql(df: str, conf: float) -> str:
    """The same as a DuckDB expression."""
    a, b, c, d = _terms(conf)
    known = ", ".join(repr(x) for x in table(conf))
    return f"(CASE WHEN {df} <= 0 THEN NULL WHEN {df} <= {TABLE} THEN ([{known}]::DOUBLE[])[CAST({df} AS BIGINT)] ELSE {a!r} + {b!r} / ({df}) + {c!r} / ({df} * {df}::DOUBLE) + {d!r} / ({df} * {df}::DOUBLE * {df}) END)"
