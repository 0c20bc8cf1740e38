"""Command line: ``python -m elevspark.cli fit|stack|rates ...`` over Parquet tables.

Run it through spark-submit on a cluster; the session's settings come from there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import pipelines
from .sources import readers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="elevspark", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    stack = sub.add_parser("stack", help="one table from the cells of dated rasters")
    stack.add_argument("cells")
    stack.add_argument("dem")
    stack.add_argument("out")
    stack.add_argument("--ref", help="reference surface (px, py, ref_z); cells far from it go")
    stack.add_argument("--below", type=float, default=-400.0)
    stack.add_argument("--above", type=float, default=1000.0)
    stack.add_argument("--uncert", type=float, default=5.0, help="uncertainty of rasters without one")
    fit = sub.add_parser("fit", help="a series or a line for every pixel of a stack")
    fit.add_argument("obs")
    fit.add_argument("dem")
    fit.add_argument("ref")
    fit.add_argument("out")
    fit.add_argument("--method", choices=("gpr", "wls", "ols"), default="gpr")
    fit.add_argument("--prefilter", choices=("min_max", "time", "both", "none"), default="both")
    fit.add_argument("--step", type=float, default=0.25, help="years between steps of the series")
    fit.add_argument("--span", type=float, nargs=2, help="first and last year of the series")
    fit.add_argument("--res", type=float, default=100.0)
    fit.add_argument("--wls-filter", action="store_true")
    fit.add_argument("--max-uncert", type=float, default=20.0)
    fit.add_argument("--conf", type=float, default=0.68)
    fit.add_argument("--conf-filter", type=float)
    rates = sub.add_parser("rates", help="rates of regions and periods from feature series")
    rates.add_argument("series")
    rates.add_argument("base")
    rates.add_argument("out")
    rates.add_argument("--lengths", type=int, nargs="+", default=[1, 2, 4, 5, 10, 20])
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"elevspark {a.what}").getOrCreate()
    read = spark.read.parquet
    if a.what == "stack":
        out = readers.build_stack(read(a.cells), read(a.dem), read(a.ref) if a.ref else None, a.below, a.above, a.uncert)
        readers.write_table(out, a.out, ("tile",) if "tile" in out.columns else ())
    elif a.what == "fit":
        obs = read(a.obs)
        keys = ("tile",) if "tile" in obs.columns else ()
        fitted = pipelines.fit_stack(
            obs, read(a.dem), read(a.ref), a.method, None if a.prefilter == "none" else a.prefilter, res=a.res, step=a.step, span=tuple(a.span) if a.span else None,
            wls_filter=a.wls_filter, max_uncert=a.max_uncert, conf=a.conf, conf_filter=a.conf_filter, keys=keys,
        )
        readers.write_table(fitted, a.out, keys)
    else:
        readers.write_table(pipelines.regional_rates(read(a.series), read(a.base), tuple(a.lengths)), a.out)


if __name__ == "__main__":
    main()
