"""Schemas of the tables that the engine reads and writes. Nothing is inferred."""

SCHEMAS = {
    "dem": "dem_id string, t timestamp_ntz, sensor string, uncert double",
    "stack_obs": "tile string, px int, py int, x double, y double, t timestamp_ntz, dem_id string, z double, corr tinyint",
    "pixel": "tile string, px int, py int, x double, y double, ref_z double, slope double, stable boolean",
    "fit": "tile string, px int, py int, t timestamp_ntz, z double, z_ci double",
    "kept": "tile string, px int, py int, t timestamp_ntz, kept boolean",
    "ls_pixel": "tile string, px int, py int, slope double, interc double, slope_ci double, n bigint, date_min double, date_max double",
    "feature": "rgiid string, ring array<struct<x:double,y:double>>",
    "base": "rgiid string, cl int, nom int, reg int, term int, area double, lon double, lat double",
    "icesat": "x double, y double, lat double, lon double, elev double, utc_day double",
    "icebridge": "lat double, lon double, t string, h double",
    "vgm_samples": "reg int, nb_dt double, bins double, exp double, count bigint, cutoff double, t string",
    "tiles": "epsg int, tile string, utm string, crs map<string,string>",
}
#: On-disk values that stand for missing ones.
FILL, FILL_CORR = -9999.0, -1
