"""Joins in time: nearest, bracketing and as-of, by windows over the union of both sides (one shuffle, no product)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` (keys, t, ...) with the right row just before and just after it.

    Adds prev_t, next_t and for each of ``values`` prev_<v> and next_<v>; rows at the same time are both
    before and after. Right rows that tie in time count as one (the largest values).
    """
    extra = [c for c in left.columns if c not in (*keys, t)]
    r = right.groupBy(*keys, t).agg(F.max(F.struct(F.col(t), *values)).alias("_r")).select(*keys, t, "_r", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("_side"))
    both = left.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(1)).unionByName(r)
    order = Window.partitionBy(*keys).orderBy(t)
    before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("_p", F.last("_r", ignorenulls=True).over(before)).withColumn("_n", F.first("_r", ignorenulls=True).over(after)).where("_side = 1")
    out = [F.col(f"_{s[0]}")[t].alias(f"{s}_t") for s in ("prev", "next")] + [F.col(f"_{s[0]}")[v].alias(f"{s}_{v}") for s in ("prev", "next") for v in values]
    return both.select(*keys, t, *extra, *out)


def pick_nearest(t: Column, before: Column, after: Column) -> Column:
    """Whether the row before is the nearest (ties go to it)."""
    return after.isNull() | (before.isNotNull() & (t - before <= after - t))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the nearest right row: near_t, near_<v>, and lag, its distance."""
    j = asof(left, right, keys, t, values)
    first = pick_nearest(F.col(t), F.col("prev_t"), F.col("next_t"))
    near = F.when(first, F.col("prev_t")).otherwise(F.col("next_t"))
    keep = [c for c in left.columns]
    return j.select(*keep, near.alias("near_t"), *[F.when(first, F.col(f"prev_{v}")).otherwise(F.col(f"next_{v}")).alias(f"near_{v}") for v in values], F.abs(F.col(t) - near).alias("lag"))


def interpolate(left: DataFrame, cube: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the values of ``cube`` interpolated linearly in time; null outside its range."""
    j = asof(left, cube, keys, t, values)
    span = F.col("next_t") - F.col("prev_t")
    w = F.when(span > 0, (F.col(t) - F.col("prev_t")) / span).otherwise(0.0)
    whole = F.col("prev_t").isNotNull() & F.col("next_t").isNotNull()
    return j.select(*left.columns, *[F.when(whole, F.col(f"prev_{v}") * (1 - w) + F.col(f"next_{v}") * w).alias(v) for v in values])


def value_at_nearest(cube: DataFrame, keys: list[str], t: str, at: float, values: list[str]) -> DataFrame:
    """keys, t and values of the step of each series that is nearest to ``at`` (the earlier of two)."""
    near = F.struct(F.abs(F.col(t) - at).alias("d"), F.col(t).alias("t"), *values)
    g = cube.groupBy(*keys).agg(F.min(near).alias("_m"))
    return g.select(*keys, F.col("_m.t").alias(t), *[F.col(f"_m.{v}").alias(v) for v in values])


def full_change(cube: DataFrame, keys: list[str], t: str = "t", z: str = "z", ci: str = "z_ci", limit: float = 500.0) -> DataFrame:
    """keys, dh, err over the whole period; null where the error passes ``limit``."""
    g = cube.groupBy(*keys).agg(*[f(F.col(c), F.col(t)).alias(n) for n, f, c in (("_z0", F.min_by, z), ("_z1", F.max_by, z), ("_c0", F.min_by, ci), ("_c1", F.max_by, ci))])
    err = F.sqrt(F.col("_c0") * F.col("_c0") + F.col("_c1") * F.col("_c1"))
    return g.select(*keys, F.when(err <= limit, F.col("_z1") - F.col("_z0")).alias("dh"), F.when(err <= limit, err).alias("err"))


def change_from_first(cube: DataFrame, keys: list[str], t: str = "t", z: str = "z", ci: str = "z_ci") -> DataFrame:
    """The cube with dh and err_dh since each series' first step."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(z).over(w)
    return cube.select("*", (F.col(z) - first).alias("dh"), F.sqrt(F.col(ci) * F.col(ci) + F.first(ci).over(w) * F.first(ci).over(w)).alias("err_dh"))


def successive_change(cube: DataFrame, keys: list[str], t: str = "t", z: str = "z") -> DataFrame:
    """The cube with dh since the step before; the first step has none."""
    return cube.withColumn("dh", F.col(z) - F.lag(z).over(Window.partitionBy(*keys).orderBy(t)))


def lag_to_closest(kept: DataFrame, dates: DataFrame, grid: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """keys, t, stack_t, lag for every pixel with two kept observations or more and every date of ``grid``.

    Two steps: a grid date goes to the nearest date of the stack (``dates``), and that to the pixel's
    nearest kept observation; the lag is measured from the grid date.
    """
    pairs = nearest(grid.withColumn("_one", F.lit(1)), dates.withColumn("_one", F.lit(1)).withColumn("_v", F.lit(0)), ["_one"], t, ["_v"])
    steps = pairs.select(F.col(t).alias("grid_t"), F.col("near_t").alias(t))
    enough = kept.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 2").select(*keys)
    wanted = enough.crossJoin(F.broadcast(steps))  # every pixel is asked for every grid date: the result, not a detour
    near = nearest(wanted, kept.withColumn("_v", F.lit(0)), keys, t, ["_v"])
    return near.select(*keys, F.col("grid_t").alias("t"), F.col(t).alias("stack_t"), F.abs(F.col("near_t") - F.col("grid_t")).alias("lag"))


def snap_to_campaign(points: DataFrame, campaigns: DataFrame, day: str, slack: float = 10.0) -> DataFrame:
    """Points within ``slack`` days of a campaign (name, first_day, last_day) with its name and middle day.

    Campaigns are dealt into the days they cover, so points meet them by an equi-join.
    """
    c = campaigns.select("name", ((F.col("first_day") + F.col("last_day")) / 2).alias("mid_day"), (F.col("first_day") - slack).alias("_a"), (F.col("last_day") + slack).alias("_b"))
    c = c.withColumn("_day", F.explode(F.sequence(F.floor("_a"), F.floor("_b"))))
    out = points.withColumn("_day", F.floor(F.col(day))).join(c, "_day").where(F.col(day).between(F.col("_a"), F.col("_b")))
    return out.drop("_day", "_a", "_b")
