"""Dates: decimal years, day offsets, dates in file names, with the year lengths of each use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a year, as each operator takes them.
YEAR_FILTER, YEAR_RATE, YEAR_CAMPAIGN = 365.24, 365.2524, 365.2422
#: Prefixes of scene names whose third or second part is the date.
THIRD_PART = ("SETSM", "SDMI", "SPOT5", "Map", "IDEM", "S0", "USGS", "CDEM", "TDM1")


def year_fraction(ts: Column) -> Column:
    """Year and elapsed share of it."""
    start = F.make_timestamp_ntz(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.make_timestamp_ntz(F.year(ts) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.year(ts) + F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz")) / F.timestamp_diff("MICROSECOND", start, end)


def days_since(ts: Column, origin: str) -> Column:
    """Days from ``origin`` as a double."""
    return F.timestamp_diff("MICROSECOND", F.lit(origin).cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(8.64e10)


def scene_date(name: Column) -> Column:
    """The acquisition time in a scene's file name; null where the prefix is not known."""
    part = F.split(name, "_")
    first = F.get(part, F.lit(0))
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return (
        F.when(first == "AST", F.try_to_timestamp(F.substring(F.get(part, F.lit(2)), 4, 14), F.lit("MMddyyyyHHmmss")).cast("timestamp_ntz"))
        .when(first.isin(*THIRD_PART), day(F.get(part, F.lit(2))))
        .when(first == "aerodem", day(F.get(part, F.lit(1))))
    )
