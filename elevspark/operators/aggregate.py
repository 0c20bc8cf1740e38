"""From feature series to regions, periods, tiles and the globe, with propagated uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.models import kernel
from ..sources.staging import cut
from .timejoin import nearest

#: Density of volume to mass and its uncertainty, area error, regions that are made of others.
DENSITY, DENSITY_ERROR, AREA_ERROR = 0.85, 0.06, 0.01
COMBINED = {20: (1, 2), 21: (13, 14, 15)}
CORR_RANGES = (150, 2000, 5000, 20000, 50000, 200000)


def complete_inventory(series: DataFrame, base: DataFrame, t: str = "time") -> DataFrame:
    """Every feature of ``base`` at every date: those without a series have null changes.

    Nominal features (nom = 2) lose their change, disconnected ones (cl = 2) their area.
    """
    dates = series.select(t).distinct()
    omitted = base.join(series.select("rgiid").distinct(), "rgiid", "left_anti").select("rgiid").crossJoin(F.broadcast(dates))  # a row per missing feature and date: the result
    both = series.unionByName(omitted, allowMissingColumns=True).join(base, "rgiid")
    return both.withColumn("dh", F.when(F.col("nom") != 2, F.col("dh"))).withColumn("area", F.when(F.col("cl") != 2, F.col("area")))


def with_combined_regions(df: DataFrame, reg: str = "reg") -> DataFrame:
    """The rows, and again those of regions that are part of a combined one under its number."""
    extra = F.array_compact(F.array(F.col(reg).cast("int"), *[F.when(F.col(reg).isin(*parts), F.lit(whole)) for whole, parts in COMBINED.items()]))
    return df.withColumn(reg, F.explode(extra))


def no_data_area(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area_nodata: areas of the features that lack a value on any date."""
    valid = F.col("dh").isNotNull() & F.col("area").isNotNull() & F.col("err_dh").isNotNull()
    f = df.groupBy(*keys, "rgiid").agg(F.max(F.when(~valid, 1).otherwise(0)).alias("gap"), F.max("area").alias("a"))
    return f.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("gap") == 1, F.col("a"))), F.lit(0.0)).alias("area_nodata"))


def regional_sum(df: DataFrame, keys: list[str], t: str = "time", errors: DataFrame | None = None) -> DataFrame:
    """Volume and mass change of each group and date, scaled up for features without data.

    ``errors``: keys, t, err_dh from :func:`double_covariance`; without it the error columns are null.
    """
    valid = df.where("dh IS NOT NULL AND area IS NOT NULL AND err_dh IS NOT NULL")
    weighted = [F.sum(F.col(c) * F.col("area")).alias(n) for c, n in (("dh", "dvol"), ("perc_err_cont", "_cont"), ("perc_area_meas", "_meas"), ("perc_area_res", "_res"), ("valid_obs", "_obs"), ("valid_obs_py", "_py"))]
    g = valid.groupBy(*keys, t).agg(*weighted, F.sum("area").alias("_a")).join(no_data_area(df, keys), keys)
    total = F.col("_a") + F.col("area_nodata")
    g = g.select(
        *keys, t, (F.col("dvol") * total / F.col("_a")).alias("dvol"), total.alias("area"), (F.col("_cont") / F.col("_a")).alias("perc_err_cont"), (F.col("_obs") / F.col("_a")).alias("valid_obs"),
        (F.col("_py") / F.col("_a")).alias("valid_obs_py"), (F.col("_meas") / total).alias("perc_area_meas"), (F.col("_res") / total).alias("perc_area_res"), "area_nodata",
    ).withColumn("dh", F.col("dvol") / F.col("area"))
    g = g.join(errors, [*keys, t], "left") if errors is not None else g.withColumn("err_dh", F.lit(None).cast("double"))
    return with_mass(g)


def _square(c: Column) -> Column:
    return c * c


def with_mass(df: DataFrame) -> DataFrame:
    """Adds err_dvol, dm and err_dm from dvol, dh, err_dh, area and perc_err_cont."""
    df = df.withColumn("err_dvol", F.sqrt(_square(F.col("err_dh") * F.col("area")) + _square(F.col("dh") * F.col("perc_err_cont") / 100 * F.col("area"))))
    return df.withColumn("dm", F.col("dvol") * DENSITY / 1e9).withColumn("err_dm", F.sqrt(_square(F.col("err_dvol") * DENSITY / 1e9) + _square(F.col("dvol") * DENSITY_ERROR / 1e9)))


def double_covariance(df: DataFrame, keys: list[str], errors: dict[float, str], lat: str = "lat", lon: str = "lon", area: str = "area", order: str = "rgiid") -> DataFrame:
    """keys, err_dh: error of the area-weighted mean of features whose errors correlate over the ranges of ``errors``.

    Beyond the longest range nothing correlates, so features only meet within it: they are dealt into
    cells of that height (and, near the poles, all longitudes), and join with the cells around.
    """
    reach = max(errors)
    rows = df.select(*keys, F.col(lat).alias("_la"), F.col(lon).alias("_lo"), F.col(area).alias("_a"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"_e{i}") for i, c in enumerate(errors.values())])
    high = reach / 110000.0  # degrees of latitude; a degree is at least 110 km
    band = F.floor(F.col("_la") / high)
    rows = rows.withColumn("_b", band)
    near = rows.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))

    def placed(x: DataFrame) -> DataFrame:  # as many cells across as keep one wider than the reach in the narrowest place around
        b = F.col("_b")
        e = F.least(F.greatest(F.abs((b - 1) * high), F.abs((b + 2) * high)), F.lit(89.9))
        n = F.greatest(F.floor(360 * F.cos(F.radians(e)) / high), F.lit(1))
        return x.withColumn("_n", n).withColumn("_c", F.pmod(F.floor((F.col("_lo") + 180) / 360 * n), n))

    a = placed(rows)
    b = placed(near).withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_c") + i, F.col("_n")) for i in (-1, 0, 1)]))))
    b = b.select(*keys, "_b", "_c", *[F.col(c).alias(c + "2") for c in ("_la", "_lo", "_a", *[f"_e{i}" for i in range(len(errors))])])
    pairs = a.join(b, [*keys, "_b", "_c"]).withColumn("_d", haversine(F.col("_la"), F.col("_lo"), F.col("_la2"), F.col("_lo2"))).where(F.col("_d") <= reach)
    term = sum((kernel(F.col("_d"), F.lit(0.0), r, "Sph") * F.col(f"_e{i}") * F.col(f"_e{i}2") for i, r in enumerate(errors)), F.lit(0.0))
    var = pairs.groupBy(*keys).agg(F.sum(term * F.col("_a") * F.col("_a2")).alias("_v"))
    return var.join(rows.groupBy(*keys).agg(F.sum("_a").alias("_t")), keys).select(*keys, (F.sqrt("_v") / F.col("_t")).alias("err_dh"))


def annual_dates(df: DataFrame, keys: list[str], t: str = "time", first: int = 2000, years: int = 21) -> DataFrame:
    """keys, year, t: for each 1 January the nearest date of the group's series (t in decimal years)."""
    wanted = df.select(*keys).distinct().withColumn(t, F.explode(F.array(*[F.lit(float(first + i)) for i in range(years)])))
    near = nearest(wanted, df.select(*keys, t).distinct().withColumn("_v", F.lit(0)), keys, t, ["_v"])
    return near.select(*keys, F.col(t).cast("int").alias("year"), F.col("near_t").alias(t))


def multi_annual(df: DataFrame, lengths: tuple[int, ...] = (1, 2, 4, 5, 10, 20), first: int = 2000, years: int = 20) -> DataFrame:
    """(start, end) of the successive periods of each length that fit into ``years``."""
    rows = [(first + k * i, first + k * (i + 1)) for k in lengths for i in range(years // k)]
    return df.sparkSession.createDataFrame(rows, "start int, end int")


def period_rates(df: DataFrame, periods: DataFrame, keys: list[str], t: str = "time", areas: DataFrame | None = None) -> DataFrame:
    """Rates of each group over each period (start, end; decimal years), between the dates nearest to its ends.

    ``areas``: keys, year, tarea (square metres); without it the area is the group's own. Observations are
    those from the first date up to the last.
    """
    df = cut(df)  # some hundred rows a group, read six times below
    ends = periods.select(F.col("start").cast("double").alias(t)).union(periods.select(F.col("end").cast("double"))).distinct()
    wanted = df.select(*keys).distinct().crossJoin(F.broadcast(ends))  # a row per group and end of a period: the result's size
    state = nearest(wanted, df.select(*keys, F.col(t).cast("double").alias(t), "dvol", "err_dh"), keys, t, ["dvol", "err_dh"])
    one = state.select(*keys, F.col(t).alias("_start"), F.col("near_t").alias("t0"), F.col("near_dvol").alias("v0"), F.col("near_err_dh").alias("e0"))
    two = state.select(*keys, F.col(t).alias("_end"), F.col("near_t").alias("t1"), F.col("near_dvol").alias("v1"), F.col("near_err_dh").alias("e1"))
    fixed = df.groupBy(*keys).agg(*[F.min_by(c, t).alias(c) for c in ("area", "perc_err_cont", "perc_area_meas", "perc_area_res", "area_nodata")])
    p = F.broadcast(periods.withColumn("_start", F.col("start").cast("double")).withColumn("_end", F.col("end").cast("double")))  # some tens of periods, given by the caller
    out = one.join(p, "_start").join(two, [*keys, "_end"]).join(fixed, keys)
    obs = df.select(*keys, F.col(t).alias("_t"), "valid_obs", "valid_obs_py")
    seen = out.select(*keys, "start", "end", "t0", "t1").join(obs, keys).where((F.col("_t") >= F.col("t0")) & (F.col("_t") < F.col("t1")))
    seen = seen.groupBy(*keys, "start", "end").agg(F.sum("valid_obs").alias("valid_obs"), F.sum("valid_obs_py").alias("valid_obs_py"))
    out = out.join(seen, [*keys, "start", "end"], "left").fillna(0.0, ["valid_obs", "valid_obs_py"])
    if areas is not None:
        for end, name in (("start", "_ta0"), ("end", "_ta1")):
            out = out.join(areas.select(*keys, F.col("year").alias(end), F.col("tarea").alias(name)), [*keys, end])
        tarea = (F.col("_ta0") + F.col("_ta1")) / 2
    else:
        tarea = F.col("area")
    years = F.col("end") - F.col("start")
    out = out.withColumn("tarea", tarea).withColumn("_dv", F.col("v1") - F.col("v0")).withColumn("_ed", F.sqrt(_square(F.col("e1")) + _square(F.col("e0"))))
    out = out.withColumn("_ev", F.sqrt(_square(F.col("_ed") * F.col("area")) + _square(F.col("_dv") / F.col("area") * F.col("perc_err_cont") / 100 * F.col("area"))))
    out = out.withColumn("dvoldt", F.col("_dv") / years).withColumn("err_dvoldt", F.col("_ev") / years)
    out = out.withColumn("dhdt", F.col("_dv") / F.col("tarea") / years).withColumn("err_dhdt", F.sqrt(_square(F.col("_ev") / F.col("tarea")) + _square(AREA_ERROR * F.col("_dv") / F.col("tarea"))) / years)
    out = out.withColumn("dmdt", F.col("_dv") * DENSITY / 1e9 / years).withColumn("err_dmdt", F.sqrt(_square(F.col("_ev") * DENSITY / 1e9) + _square(F.col("_dv") * DENSITY_ERROR / 1e9)) / years)
    out = out.withColumn("dmdtda", F.col("dmdt") * 1e9 / F.col("tarea")).withColumn("err_dmdtda", F.sqrt(_square(F.col("err_dmdt") * 1e9 / F.col("tarea")) + _square(AREA_ERROR * F.col("dmdtda"))))
    names = ["tarea", "dhdt", "err_dhdt", "dvoldt", "err_dvoldt", "dmdt", "err_dmdt", "dmdtda", "err_dmdtda", "valid_obs", "valid_obs_py", "perc_area_meas", "perc_area_res", "area_nodata", "area"]
    return out.select(*keys, "start", "end", *names)


def global_sum(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals of independent regions: sums, and roots of sums of squares for their errors.

    Percentages are divided by the sum of the measured or resolved shares (see the README); area_share_*
    are weighted by area.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    root = lambda c: F.sqrt(F.coalesce(F.sum(_square(F.col(c))), F.lit(0.0)))
    g = df.groupBy(*(keys or [])).agg(
        total("area").alias("area"), total("area_nodata").alias("area_nodata"), total("tarea").alias("tarea"), total("dmdt").alias("dmdt"), root("err_dmdt").alias("err_dmdt"), total("dvoldt").alias("dvoldt"),
        root("err_dvoldt").alias("err_dvoldt"), (root("tarea") * AREA_ERROR).alias("_et"), total("perc_area_res").alias("_r"), total("perc_area_meas").alias("_m"),
        *[total(F.col(c) * F.col("area")).alias(f"_{c}") for c in ("perc_area_res", "perc_area_meas", "valid_obs", "valid_obs_py")],
    )
    ratio = lambda c, e: F.sqrt(_square(F.col(e) / F.col("tarea")) + _square(F.col("_et") * F.col(c) / _square(F.col("tarea"))))
    g = g.withColumn("dhdt", F.try_divide("dvoldt", "tarea")).withColumn("err_dhdt", ratio("dvoldt", "err_dvoldt"))
    g = g.withColumn("dmdtda", F.try_divide(F.col("dmdt") * 1e9, F.col("tarea"))).withColumn("err_dmdtda", 1e9 * ratio("dmdt", "err_dmdt"))
    for c, by in (("perc_area_res", "_r"), ("perc_area_meas", "_m"), ("valid_obs", "_r"), ("valid_obs_py", "_r")):
        g = g.withColumn(c, F.try_divide(F.col(f"_{c}"), F.col(by))).withColumn(f"area_share_{c}", F.try_divide(F.col(f"_{c}"), F.col("area")))
    return g.drop("_et", "_r", "_m", "_perc_area_res", "_perc_area_meas", "_valid_obs", "_valid_obs_py")


def feature_rates(df: DataFrame, start: float, end: float, t: str = "time", as_rate: bool = True) -> DataFrame:
    """Per feature, between the dates of its series nearest to ``start`` and ``end`` (decimal years)."""
    near = lambda at: F.min_by(F.struct(F.col(t).alias("t"), "dh", "err_dh"), F.struct(F.abs(F.col(t) - at), F.col(t)))
    g = df.groupBy("rgiid").agg(near(start).alias("a"), near(end).alias("b"), F.max("area").alias("area"), F.max("perc_err_cont").alias("p"))
    years = F.col("b.t") - F.col("a.t") if as_rate else F.lit(1.0)
    g = g.withColumn("_dh", F.col("b.dh") - F.col("a.dh")).withColumn("_e", F.sqrt(_square(F.col("a.err_dh")) + _square(F.col("b.err_dh")))).withColumn("_y", years)
    g = g.withColumn("_v", F.col("_dh") * F.col("area")).withColumn("_ev", F.sqrt(_square(F.col("_e") * F.col("area")) + _square(F.col("_dh") * F.col("p") / 100 * F.col("area"))))
    per = lambda c: F.try_divide(c, F.col("_y"))
    mass = F.col("_v") * DENSITY / 1e9
    mass_err = F.sqrt(_square(F.col("_ev") * DENSITY / 1e9) + _square(F.col("_v") * DENSITY_ERROR / 1e9))
    return g.select(
        "rgiid", per(F.col("_dh")).alias("dh"), per(F.col("_e")).alias("err_dh"), per(F.col("_v")).alias("dvol"), per(F.col("_ev")).alias("err_dvol"), per(mass).alias("dm"), per(mass_err).alias("err_dm"),
        per(mass * 1e9 / F.col("area")).alias("dmda"), (F.col("area") / 1e6).alias("area_km2"),
    )


def categories(df: DataFrame, tidewater: tuple[int, ...] = (1,)) -> DataFrame:
    """Each row under ``all`` and under ``tw`` or ``ntw`` by its terminus."""
    return df.withColumn("category", F.explode(F.array(F.lit("all"), F.when(F.col("term").isin(*tidewater), F.lit("tw")).otherwise("ntw"))))


def tile_keys(df: DataFrame, size: float) -> DataFrame:
    """Adds the lower corner (tile_lat, tile_lon) of the tile of ``size`` degrees that holds the feature."""
    return df.withColumn("tile_lat", F.floor(F.col("lat") / size) * size).withColumn("tile_lon", F.floor(F.col("lon") / size) * size)

