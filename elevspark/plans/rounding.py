"""Rounded results: both engines sum in their own order, so only digits that do not depend on it are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits``, counts to bigint; minus zero becomes zero."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + 0.0
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    """The same rounding as a DuckDB expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
