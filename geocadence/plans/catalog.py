"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import extraction, raster, scenarios, series, temporal, weather
from ..sources.bindings import table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LAT, LON = -28.9, 137.1
SCALES = {"wind_speed": 10.0, "wind_dir": 180.0, "wlvl": 4.0, "salinity": 100.0}
COS = raster.cos_mean(-28.9)


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_tables(sql)
        return f

    return register


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


# Water levels

_CLEAN = """WITH b AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM levels WHERE wse IS NOT NULL),
k AS (SELECT site, file, t, wse FROM b WHERE n < 4 OR wse BETWEEN -16 AND 6),
q AS (SELECT site, count(*) AS n, quantile_cont(wse, 0.25) AS a, quantile_cont(wse, 0.75) AS c FROM k GROUP BY site),
clean AS (SELECT k.site, k.file, k.t, round(k.wse + 0.5, 3) AS wse FROM k JOIN q USING (site) WHERE q.n < 4 OR k.wse BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)) """


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return series.clean_series(table(spark, d, "levels"), ["site"], offset=0.5)


@query(_CLEAN + "SELECT * FROM clean")
def clean_series(spark, d):
    return _clean(spark, d)


@query(_CLEAN + "SELECT site, count(*) AS n, min(wse) AS min_wse, max(wse) AS max_wse, min(t) AS first_t, max(t) AS last_t, arg_max(wse, (t, file)) AS latest_wse FROM clean GROUP BY site")
def series_stats(spark, d):
    return series.series_stats(_clean(spark, d), ["site"])


@query("""SELECT id, name, regexp_extract(name, '_([0-9]{3})_([0-9]{3})_([0-9]{3}[FR])_', 2) AS pass, regexp_extract(name, '_([0-9]+)m_', 1) AS resolution, regexp_extract(name, '_([0-9]{3}[FR])_', 1) AS tile,
replace(regexp_extract(name, '[0-9]{8}T[0-9]{6}'), 'T', '') AS acquired FROM granules WHERE NOT starts_with(name, '.') AND contains(name, '100m') AND abs(utm_zone - 53) <= 1""")
def granule_catalogue(spark, d):
    g = table(spark, d, "granules").where(~F.col("name").startswith(".") & F.col("name").contains("100m") & (F.abs(F.col("utm_zone") - 53) <= 1))
    part = lambda p, i: F.regexp_extract("name", p, i)
    return g.select("id", "name", part(r"_([0-9]{3})_([0-9]{3})_([0-9]{3}[FR])_", 2).alias("pass"), part("_([0-9]+)m_", 1).alias("resolution"), part("_([0-9]{3}[FR])_", 1).alias("tile"), F.replace(part("[0-9]{8}T[0-9]{6}", 0), F.lit("T"), F.lit("")).alias("acquired"))


@query("SELECT id, name, size FROM granules WHERE cached = 0 OR (cached = 1 AND size % 2 = 1)")
def incremental_new_files(spark, d):
    g = table(spark, d, "granules")
    cached = g.where("cached > 0").select("id", F.when((F.col("cached") == 1) & (F.col("size") % 2 == 1), F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return series.new_files(g.select("id", "name", "size"), cached, ["id", "size"])


@query("SELECT file, site, wse FROM levels SEMI JOIN (SELECT id FROM granules WHERE cached > 0) g ON levels.file = g.id WHERE wse IS NOT NULL")
def incremental_reassemble(spark, d):
    keep = table(spark, d, "granules").where("cached > 0").select(F.col("id").alias("file"))
    return series.reassemble(table(spark, d, "levels"), keep, ["file"]).select("file", "site", "wse")


# Points in rasters

@query("""SELECT s.site, c.granule, round(c.wse, 6) AS wse, c.qual FROM sites s JOIN cells c ON c.iy = s.cy AND c.ix = s.cx WHERE c.wse IS NOT NULL AND c.qual <= 1""")
def extract_point(spark, d):
    s, c = table(spark, d, "sites"), table(spark, d, "cells")
    centres = s.selectExpr("cy AS iy", "cx AS ix").distinct()
    values = c.where(c.wse.isNotNull() & (c.qual <= 1)).join(extraction.few_or_merged(centres, centres.count()), ["iy", "ix"])
    return extraction.to_sites(values.select("granule", F.col("iy").alias("cy"), F.col("ix").alias("cx"), r6("wse"), "qual"), s, ["cy", "cx"]).select("site", "granule", "wse", "qual")


@query("""SELECT s.site, c.granule, round(avg(c.wse), 6) AS wse, count(c.wse) AS n FROM sites s JOIN cells c ON abs(c.iy - s.cy) <= 2 AND abs(c.ix - s.cx) <= 2 GROUP BY s.site, c.granule""")
def extract_window(spark, d):
    s = table(spark, d, "sites")
    around = raster.window_stats(table(spark, d, "cells"), s, ["granule"], "wse", 2)
    return extraction.to_sites(around.select("granule", "cy", "cx", r6("mean", "wse"), "n"), s, ["cy", "cx"]).select("site", "granule", "wse", "n")


@query("""SELECT day, round(100.0e0 * count_if(qual = 0) / count(*), 6) AS q0, round(100.0e0 * count_if(qual = 1) / count(*), 6) AS q1, round(100.0e0 * count_if(qual = 2) / count(*), 6) AS q2, round(100.0e0 * count_if(qual = 3) / count(*), 6) AS q3 FROM cells GROUP BY day""")
def quality_percentages(spark, d):
    return extraction.quality_shares(table(spark, d, "cells"), "day")


# Areas

_MASK = "coalesce(water_frac BETWEEN 0.1 AND 0.99 AND qual <= 1, false)"


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").withColumn("mask", raster.water_mask(F.col("water_frac"), F.col("qual")))


@query(f"SELECT granule, iy, ix, {_MASK} AS mask FROM cells")
def water_mask(spark, d):
    return _masked(spark, d).select("granule", "iy", "ix", "mask")


@query(f"""WITH m AS (SELECT granule, iy, ix, CAST({_MASK} AS INT) AS v FROM cells), o AS (SELECT unnest(range(-2, 3)) AS d)
SELECT c.granule, c.iy, c.ix, sum(m.v) * 2 > 25 AS mask FROM m c CROSS JOIN o a CROSS JOIN o b JOIN m ON m.granule = c.granule AND m.iy = greatest(0, least(23, c.iy + a.d)) AND m.ix = greatest(0, least(23, c.ix + b.d)) GROUP BY c.granule, c.iy, c.ix""")
def majority_filter(spark, d):
    return raster.majority_filter(_masked(spark, d), ["granule"], "mask", 5).select("granule", "iy", "ix", "mask")


@query(f"""SELECT granule, iy, ix FROM cells c WHERE EXISTS (SELECT 1 FROM boundary b WHERE pow((c.lon - b.lon) * {COS!r}, 2) + pow(c.lat - b.lat, 2) <= {(2 / 111.32) ** 2!r})""")
def inside_boundary(spark, d):
    return raster.inside_boundary(table(spark, d, "cells"), table(spark, d, "boundary"), COS).select("granule", "iy", "ix")


_SCENES = f"""WITH s AS (SELECT day, granule, sum(CASE WHEN {_MASK} THEN coalesce(water_area, 0) ELSE 0 END) AS area_m2, sqrt(sum(CASE WHEN {_MASK} THEN coalesce(uncert * uncert, 0) ELSE 0 END)) AS uncert_m2, count_if({_MASK}) AS n_cells, count_if(water_frac IS NOT NULL) AS covered_cells FROM cells GROUP BY day, granule) """


@query(_SCENES + "SELECT day, granule, round(area_m2, 3) AS area_m2, round(uncert_m2, 6) AS uncert_m2, CAST(n_cells AS BIGINT) AS n_cells, CAST(covered_cells AS BIGINT) AS covered_cells FROM s")
def scene_area(spark, d):
    return raster.scene_area(_masked(spark, d), ["day", "granule"], "mask").select("day", "granule", F.round("area_m2", 3).alias("area_m2"), r6("uncert_m2"), "n_cells", "covered_cells")


@query(_SCENES + """SELECT day, round(sum(area_m2) / 1e6, 3) AS area_km2, round(sqrt(sum(uncert_m2 * uncert_m2)) / 1e6, 6) AS uncert_km2, count(*) AS n_scenes, CAST(sum(n_cells) AS BIGINT) AS n_cells, round(sum(covered_cells) / 576e0, 6) AS coverage, round(sum(covered_cells) / 576e0, 6) < 0.9 AS partial FROM s WHERE covered_cells > 0 OR n_cells > 0 GROUP BY day""")
def area_daily(spark, d):
    return raster.combine_scenes(raster.scene_area(_masked(spark, d), ["day", "granule"], "mask"), 576)


@query(f"""WITH a AS (SELECT day, granule, CAST(round_even((lat + 29.03) / 0.23 * 11, 0) AS BIGINT) AS gy, CAST(round_even((lon - 137) / 0.23 * 11, 0) AS BIGINT) AS gx, water_area FROM cells WHERE {_MASK}),
b AS (SELECT day, gy, gx, granule, sum(water_area) AS a FROM a GROUP BY ALL), c AS (SELECT day, gy, gx, avg(a) AS m, sum(a) AS s, count(*) AS n FROM b GROUP BY day, gy, gx)
SELECT day, round(sum(m) / 1e6, 6) AS area_km2, round(sum(s) / 1e6, 6) AS scene_area_km2, CAST(count_if(n > 1) AS BIGINT) AS overlap_bins, sum(s) / sum(m) > 1.02 AS overlaps FROM c GROUP BY day""")
def area_merged(spark, d):
    cells = _masked(spark, d).withColumn("gy", raster.grid_index(F.col("lat"), -29.03, -28.8, 12)).withColumn("gx", raster.grid_index(F.col("lon"), 137.0, 137.23, 12))
    return raster.merged_area(cells, "mask")


# Weather

_NOW = 1_705_000_000


@query("""WITH f AS (SELECT DISTINCT src FROM obs WHERE fresh = 1 AND src = 'bom'), u AS (SELECT *, 1 AS k FROM obs WHERE fresh = 1 AND src = 'bom' UNION ALL SELECT *, 0 AS k FROM obs WHERE fresh = 0 AND src IN (SELECT src FROM f)),
r AS (SELECT *, row_number() OVER (PARTITION BY station, t ORDER BY k DESC, id DESC) AS n FROM u)
SELECT station, id, t, air_temp, src FROM r WHERE n = 1 AND t >= (SELECT max(t) FROM obs) - 168 * 3600""")
def archive_merge(spark, d):
    o = table(spark, d, "obs")
    newest = o.agg(F.max("t").alias("newest"))
    merged = weather.merge_archive(o.where("fresh = 0"), o.where("fresh = 1 AND src = 'bom'"), None)
    return merged.join(F.broadcast(newest), F.col("t").isNull() | (F.col("t") >= F.col("newest") - 168 * 3600)).select("station", "id", "t", "air_temp", "src")  # one row


@query("""WITH s AS (SELECT DISTINCT station FROM obs), f AS (SELECT station, max(t) AS t, arg_max(air_temp, (t, id)) AS a FROM obs WHERE fresh = 1 AND station < 'p' GROUP BY station), p AS (SELECT station, max(t) AS t, arg_max(air_temp, (t, id)) AS a FROM obs WHERE fresh = 0 GROUP BY station)
SELECT s.station, coalesce(f.t, p.t) AS t, coalesce(f.a, p.a) AS air_temp, f.t IS NULL AND p.t IS NOT NULL AS stale FROM s LEFT JOIN f USING (station) LEFT JOIN p USING (station)""")
def stale_fallback(spark, d):
    o = table(spark, d, "obs")
    last = lambda rows: rows.groupBy("station").agg(F.max("t").alias("t"), F.max_by("air_temp", F.struct("t", "id")).alias("air_temp"))
    return weather.stale_fallback(o.select("station").distinct(), last(o.where("fresh = 1 AND station < 'p'")), last(o.where("fresh = 0")))


_ROSE = """k AS (SELECT station, CASE WHEN wind_spd_kmh <= 0 OR wind_dir_deg IS NULL THEN -1 ELSE CAST(floor(wind_dir_deg / 22.5 + 0.5) AS INT) % 16 END AS sector,
CASE WHEN wind_spd_kmh <= 0 OR wind_dir_deg IS NULL THEN -1 WHEN wind_spd_kmh < 10 THEN 0 WHEN wind_spd_kmh < 20 THEN 1 WHEN wind_spd_kmh < 30 THEN 2 WHEN wind_spd_kmh < 40 THEN 3 ELSE 4 END AS bin FROM sel WHERE wind_spd_kmh IS NOT NULL)
SELECT station, sector, bin, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY station), 6) AS percent FROM k GROUP BY station, sector, bin"""
_SUN = f"""(WITH e AS (SELECT *, t / 86400e0 + 2440587.5e0 - 2451545e0 AS d FROM obs), g AS (SELECT *, radians(280.459e0 + 0.98564736e0 * d + 1.915e0 * sin(radians(357.529e0 + 0.98560028e0 * d)) + 0.020e0 * sin(2 * radians(357.529e0 + 0.98560028e0 * d))) AS l, radians(23.439e0 - 0.00000036e0 * d) AS x FROM e),
h AS (SELECT *, asin(sin(x) * sin(l)) AS dec, radians((((18.697374558e0 + 24.06570982441908e0 * d) % 24 + 24) % 24) * 15 + {LON}) - atan2(cos(x) * sin(l), cos(l)) AS ha FROM g)
SELECT *, degrees(asin(sin(radians({LAT})) * sin(dec) + cos(radians({LAT})) * cos(dec) * cos(ha))) AS sun FROM h)"""


def _sunny(obs: DataFrame) -> DataFrame:
    return obs.withColumn("sun", geo.solar_elevation(F.col("t"), LAT, LON))


@query("WITH sel AS (SELECT * FROM obs), " + _ROSE)
def rose_all(spark, d):
    return weather.wind_rose(table(spark, d, "obs"))


@query("WITH sel AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY station) AS m FROM obs) WHERE t >= m - 86400), " + _ROSE)
def rose_24h(spark, d):
    return weather.wind_rose(temporal.trailing(table(spark, d, "obs"), 86400))


@query(f"WITH sel AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY station) AS m FROM {_SUN}) WHERE t >= m - 7 * 86400 AND sun > 0), " + _ROSE)
def rose_7d_day(spark, d):
    return weather.wind_rose(_sunny(temporal.trailing(table(spark, d, "obs"), 7 * 86400)).where("sun > 0"))


@query(f"SELECT station, id, round(sun, 6) AS sun FROM {_SUN} s WHERE EXISTS (SELECT 1 FROM obs o WHERE o.id = s.id)")
def solar_elevation(spark, d):
    return _sunny(table(spark, d, "obs")).select("station", "id", r6("sun"))


@query(f"""WITH p AS (SELECT *, sun > 0 AS phase FROM {_SUN}), g AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY t, id) - row_number() OVER (PARTITION BY station, phase ORDER BY t, id) AS run FROM p),
w AS (SELECT *, max(run) OVER (PARTITION BY station) AS last FROM g WHERE phase) SELECT station, id, t FROM w, (SELECT count(*) FROM obs) WHERE run = last""")
def last_day_run(spark, d):
    phased = _sunny(table(spark, d, "obs")).withColumn("phase", F.col("sun") > 0)
    return temporal.last_run(phased, "phase", True).select("station", "id", "t")


@query("SELECT DISTINCT t FROM obs WHERE wind_spd_kmh IS NOT NULL")
def timeline(spark, d):
    return temporal.timeline(table(spark, d, "obs"))


@query("SELECT (max(t) - min(t)) / 3600e0 AS hours FROM obs")
def archive_span(spark, d):
    return temporal.archive_span(table(spark, d, "obs"))


# Conditions as of instants

def _instants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "obs").select("station", (F.floor(F.col("t") / 3600) * 3600 + 600).alias("t")).distinct()


_INSTANTS = "WITH i AS (SELECT DISTINCT station, CAST(floor(t / 3600) AS BIGINT) * 3600 + 600 AS t FROM obs), o AS (SELECT station, t, arg_max(id, id) AS id, arg_max(air_temp, id) AS air_temp FROM obs GROUP BY station, t), "
_SIDES = """b AS (SELECT i.station, i.t, o.t AS bt, o.air_temp AS ba FROM i ASOF LEFT JOIN o ON i.station = o.station AND i.t >= o.t), a AS (SELECT i.station, i.t, o.t AS ft, o.air_temp AS fa FROM i ASOF LEFT JOIN o ON i.station = o.station AND i.t < o.t) """


@query(_INSTANTS + _SIDES + "SELECT station, t, CASE WHEN bt IS NULL OR ft - t < t - bt THEN coalesce(ft, bt) ELSE bt END AS obs_t FROM b JOIN a USING (station, t)")
def asof_nearest(spark, d):
    return temporal.asof(_instants(spark, d), table(spark, d, "obs"), "station", ["air_temp"]).select("station", "t", temporal.nearest_row()["t"].alias("obs_t"))


@query(_INSTANTS + _SIDES + "SELECT station, t, bt AS obs_t, ba AS air_temp FROM b")
def asof_backward(spark, d):
    return temporal.asof(_instants(spark, d), table(spark, d, "obs"), "station", ["air_temp"]).select("station", "t", F.col("back.t").alias("obs_t"), F.col("back.air_temp").alias("air_temp"))


# Scenarios

_VALUES = "WITH v AS (SELECT DISTINCT param, value FROM (SELECT unnest(['wind_speed', 'wind_dir', 'wlvl', 'salinity']) AS param, unnest([wind_speed, wind_dir, wlvl, salinity]) AS value FROM scenarios)) "


@query(_VALUES + "SELECT param, value FROM v")
def param_grid(spark, d):
    return scenarios.parameter_values(table(spark, d, "scenarios"))


@query(_VALUES + ", g AS (SELECT *, value - lag(value) OVER (PARTITION BY param ORDER BY value) AS gap FROM v) SELECT param, count(*) AS n_values, min(value) AS lo, max(value) AS hi, quantile_cont(gap, 0.5) AS step, CASE WHEN param = 'wind_dir' THEN 180e0 WHEN max(value) > min(value) THEN max(value) - min(value) ELSE 1e0 END AS scale FROM g GROUP BY param")
def param_scales(spark, d):
    return scenarios.parameter_scales(table(spark, d, "scenarios"))


def _match_sql(cap: bool) -> str:
    return f"""WITH l AS (SELECT min(wlvl) AS lo, max(wlvl) AS hi FROM scenarios), p AS (SELECT t.target, s.key, t.wlvl AS tw, l.*, sqrt(pow((s.wind_speed - t.wind_speed) / 10, 2) + pow(((((s.wind_dir - t.wind_dir + 180) % 360) + 360) % 360 - 180) / 180, 2) + pow((s.wlvl - t.wlvl) / 4, 2)) AS dist
FROM targets t CROSS JOIN l JOIN scenarios s ON {"s.wlvl <= t.wlvl + 1e-6 OR t.wlvl + 1e-6 < l.lo" if cap else "true"}), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY dist, key) AS rank FROM p)
SELECT target, CAST(rank AS INT) AS rank, key, round(dist, 3) AS dist, NOT tw + 1e-6 < lo AS capped, CASE WHEN tw < lo THEN 'below' WHEN tw > hi THEN 'above' ELSE 'in' END AS level_flag FROM r WHERE rank <= 5"""


@query(_match_sql(False))
def match_topk(spark, d):
    return scenarios.match(table(spark, d, "targets"), table(spark, d, "scenarios"), SCALES, cap_level=False)


@query(_match_sql(True))
def match_capped(spark, d):
    return scenarios.match(table(spark, d, "targets"), table(spark, d, "scenarios"), SCALES)


@query("""WITH w AS (SELECT DISTINCT * FROM design), h AS (SELECT DISTINCT wind_speed, wind_dir, wlvl, salinity FROM scenarios), b AS (SELECT * FROM w INTERSECT SELECT * FROM h)
SELECT (SELECT count(*) FROM design) AS n_design, (SELECT count(*) FROM w) AS n_unique, (SELECT count(*) FROM b) AS n_done, (SELECT count(*) FROM w) - (SELECT count(*) FROM b) AS n_missing, (SELECT count(*) FROM h) - (SELECT count(*) FROM b) AS n_extra""")
def design_coverage(spark, d):
    return scenarios.design_coverage(table(spark, d, "design"), table(spark, d, "scenarios"))


_NUM = "TRY_CAST(replace(regexp_extract(name, '{0}(-?[0-9]+[_.][0-9]+)', 1), '_', '.') AS DOUBLE)"


@query("SELECT id, name, " + ", ".join(f"{_NUM.format(t)} AS {c}" for t, c in (("wind-sp", "wind_speed"), ("wind-dir", "wind_dir"), ("wlvl", "wlvl"), ("sal", "salinity"))) + ", CASE WHEN starts_with(name, 'wave_') THEN 'wave' ELSE 'flow' END AS source, regexp_replace(regexp_replace(name, '^wave_', ''), '[.]nc$', '') AS key FROM names")
def scenario_parse(spark, d):
    return scenarios.parse_name(table(spark, d, "names"), strict=False)


@query("""WITH c AS (SELECT source, n_time, n_layer, count(*) AS n, min(key) AS k FROM runs GROUP BY ALL), m AS (SELECT source, n_time AS mt, n_layer AS ml, row_number() OVER (PARTITION BY source ORDER BY n DESC, k) AS r FROM c)
SELECT key, runs.source, concat_ws(' ; ', CASE WHEN n_time <> mt THEN 'time ' || n_time END, CASE WHEN n_layer <> ml THEN 'layer ' || n_layer END, CASE WHEN no_dir THEN 'missing dir' END) AS problems FROM runs JOIN m ON runs.source = m.source AND r = 1 WHERE n_time <> mt OR n_layer <> ml OR no_dir""")
def run_check(spark, d):
    runs = table(spark, d, "runs")
    shapes = runs.groupBy("source", "n_time", "n_layer").agg(F.count("*").alias("n"), F.min("key").alias("k"))
    major = shapes.groupBy("source").agg(F.max_by(F.struct("n_time", "n_layer"), F.struct("n", -F.col("k"))).alias("m"))
    told = F.concat_ws(" ; ", F.when(F.col("n_time") != F.col("m.n_time"), F.concat(F.lit("time "), "n_time")), F.when(F.col("n_layer") != F.col("m.n_layer"), F.concat(F.lit("layer "), "n_layer")), F.when(F.col("no_dir"), F.lit("missing dir")))
    return runs.join(major, "source").select("key", "source", told.alias("problems")).where("problems != ''")


# Fields and coordinates

@query("""SELECT key, layer, cell, round(u * cos(radians(turn)) - v * sin(radians(turn)), 6) + 0e0 AS ue, round(u * sin(radians(turn)) + v * cos(radians(turn)), 6) + 0e0 AS vn FROM fields""")
def rotate_vectors(spark, d):
    ue, vn = geo.rotate(F.col("u"), F.col("v"), F.col("turn"))
    return table(spark, d, "fields").select("key", "layer", "cell", (F.round(ue, 6) + 0.0).alias("ue"), (F.round(vn, 6) + 0.0).alias("vn"))


@query("""SELECT layer, round(quantile_cont(sqrt(u * u + v * v), 0.99), 6) AS p99, round(max(sqrt(u * u + v * v)), 6) AS zmax, count_if(u <> 0 OR v <> 0) AS n_wet FROM fields GROUP BY layer""")
def layer_bounds(spark, d):
    speed = table(spark, d, "fields").select("layer", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2).alias("z"), ((F.col("u") != 0) | (F.col("v") != 0)).alias("wet"))
    top = speed.groupBy("layer").agg(F.round(F.max("z"), 6).alias("zmax"), F.count_if("wet").alias("n_wet"))
    return top.join(series.quantiles(speed, ["layer"], "z", {"p99": 0.99}), "layer").select("layer", F.round("p99", 6).alias("p99"), "zmax", "n_wet")


@query("""SELECT layer, count(*) AS n, CAST(count_if(abs(round_even(big / 0.1, 0)) > 32767) AS BIGINT) AS clipped, CAST(sum(greatest(least(round_even(big / 0.1, 0), 32767), -32767)) AS BIGINT) AS packed_sum FROM fields GROUP BY layer""")
def pack_fields(spark, d):
    packed = geo.pack_int16(F.col("big"), 0.1)
    return table(spark, d, "fields").groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.abs(F.bround(F.col("big") / 0.1)) > 32767).alias("clipped"), F.sum(packed).alias("packed_sum"))


@query("SELECT id, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone, round(degrees(atan(tan(radians(lon - (zone * 6 - 183))) * sin(radians(lat)))), 6) AS convergence, true AS round_trip FROM points")
def utm_round_trip(spark, d):
    p = table(spark, d, "points")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    near = (F.abs(lon - F.col("lon")) < 1e-8) & (F.abs(lat - F.col("lat")) < 1e-8)
    return p.select("id", geo.utm_zone(F.col("lon")).alias("zone"), F.round(geo.convergence(F.col("lon"), F.col("lat"), F.col("zone")), 6).alias("convergence"), near.alias("round_trip"))
