"""Registered queries of extraction, feeds, catalogues, conditions, areas, fields and streams, and their SQL twins.

Queries without SQL (smoothing by triangles, streams with windows) are compared with plain loops in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, parse
from ..operators import catalogue, extraction, fields, raster, scenarios, series, temporal, weather
from ..sources import feeds, sinks
from ..sources.bindings import table, with_tables
from ..sources.shared import shared_folder
from ..streaming import archive
from .catalog import _CLEAN, COS, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N = 20  # points of a side of the regular grids here


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return register


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, as cells of granules would be; the projections behind them run once."""
    folder = shared_folder(spark, "table")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


# Extraction

_NEAREST = """b AS (SELECT granule, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM cells GROUP BY granule),
h AS (SELECT p.*, b.granule FROM places p JOIN b ON p.lon BETWEEN x0 AND x1 AND p.lat BETWEEN y0 AND y1),
r AS (SELECT h.site, h.granule, c.iy, c.ix, c.qual, c.wse, row_number() OVER (PARTITION BY h.site, h.granule ORDER BY pow(c.lon - h.lon, 2) + pow(c.lat - h.lat, 2), c.iy, c.ix) AS n FROM h JOIN cells c ON c.granule = h.granule AND abs(c.lon - h.lon) < 0.02 AND abs(c.lat - h.lat) < 0.02),
q AS (SELECT * FROM r WHERE n = 1) """
_PIXEL = ("granule", "iy", "ix", "lon", "lat", "qual")


@query("WITH " + _NEAREST + "SELECT site, granule, round(wse, 6) AS wse, qual FROM q WHERE qual IN (0, 1) AND wse IS NOT NULL")
def extract_nearest(spark, d):
    return extraction.extract_series(table(spark, d, "places"), _stored(spark, table(spark, d, "cells").select(*_PIXEL, "wse")), 0, [0, 1], digits=6).select("site", "granule", "wse", "qual")


@query("WITH " + _NEAREST + "SELECT q.site, q.granule, round(avg(c.wse), 6) AS wse, count(c.wse) AS n FROM q JOIN cells c ON c.granule = q.granule AND abs(c.iy - q.iy) <= 2 AND abs(c.ix - q.ix) <= 2 WHERE q.qual IN (0, 1) GROUP BY q.site, q.granule HAVING count(c.wse) > 0")
def extract_mean(spark, d):
    return extraction.extract_series(table(spark, d, "places"), _stored(spark, table(spark, d, "cells").select(*_PIXEL, "wse")), 2, [0, 1], digits=6).select("site", "granule", "wse", "n")


@query("WITH " + _NEAREST + "SELECT site, granule, qual * 1e0 AS quality FROM q")
def extract_quality(spark, d):
    return extraction.extract_quality(table(spark, d, "places"), _stored(spark, table(spark, d, "cells").select(*_PIXEL)))


@query("SELECT s.site, t.z AS terrain FROM spots s LEFT JOIN terrain t ON t.r = floor((5000e0 - s.y) / 10e0) AND t.c = floor((s.x - 1000e0) / 10e0)")
def terrain_sample(spark, d):
    terrain = table(spark, d, "terrain").withColumnsRenamed({"r": "row", "c": "col"})
    return extraction.sample_terrain(table(spark, d, "spots"), terrain, 1000.0, 5000.0, 10.0, 10.0).select("site", "terrain")


@query(_CLEAN + ", m AS (SELECT site, avg(wse) AS m FROM clean GROUP BY site) SELECT m.site, round(m.m, 6) AS mean_wse, round(p.z, 6) AS corrected, round(m.m - p.z, 2) AS height FROM m JOIN (SELECT c AS site, min(z) AS z FROM terrain GROUP BY c) p ON p.site = m.site")
def terrain_correction(spark, d):
    clean = series.clean_series(table(spark, d, "levels"), ["site"], offset=0.5)
    terrain = table(spark, d, "terrain").groupBy(F.col("c").alias("site")).agg(F.min("z").alias("terrain"))
    return extraction.level_over_terrain(clean, terrain).select("site", r6("mean_wse"), r6("corrected"), "height")


# Series

@query("SELECT site, file, t FROM levels WHERE t >= 1700100000 AND t <= 1701216000")
def series_window(spark, d):
    return series.time_window(table(spark, d, "levels"), 1_700_100_000, 1_701_216_000).select("site", "file", "t")


@query("SELECT site, file, t FROM levels WHERE t >= 1701216000 AND t < 1701302400")
def day_slice(spark, d):
    return series.on_day(table(spark, d, "levels"), "2023-11-29").select("site", "file", "t")


@query(_CLEAN + "SELECT site, count(*) AS n, min(wse) AS min_wse, max(wse) AS max_wse, min(t) AS first_t, max(t) AS last_t, arg_max(wse, (t, file)) AS latest_wse, arg_min(wse, (t, file)) AS first_wse FROM clean GROUP BY site")
def series_payload(spark, d):
    p = sinks.series_payload(series.clean_series(table(spark, d, "levels"), ["site"], offset=0.5))
    return p.select("site", F.col("stats.n").cast("long").alias("n"), F.col("stats.min").alias("min_wse"), F.col("stats.max").alias("max_wse"), F.col("stats.first_t").alias("first_t"), F.col("stats.last_t").alias("last_t"), F.col("latest.wse").alias("latest_wse"), F.element_at("series", 1)["wse"].alias("first_wse"))


@query(_CLEAN + "SELECT 2 AS part, concat_ws(',', CAST(file AS VARCHAR), CAST(t AS VARCHAR), CAST(CAST(wse AS DECIMAL(10, 3)) AS VARCHAR), CASE WHEN file % 7 = 0 THEN '\"a,b\"\"c\"' ELSE '' END) AS line FROM clean UNION ALL SELECT 0, '# source, levels' UNION ALL SELECT 0, '# datum +0.5' UNION ALL SELECT 1, 'file,t,wse,note'")
def csv_export(spark, d):
    clean = series.clean_series(table(spark, d, "levels"), ["site"], offset=0.5)
    columns = {"file": F.col("file"), "t": F.col("t"), "wse": F.col("wse").cast("decimal(10,3)"), "note": F.when(F.col("file") % 7 == 0, 'a,b"c')}
    return sinks.csv_lines(clean, columns, ["source, levels", "datum +0.5"], ["site", "t", "file"]).select("part", "line")


@query("SELECT DISTINCT '@' || CASE WHEN lon < 0 THEN '' ELSE '' END || printf('%.6f', lon) || ',' || printf('%.6f', lat) AS site_key FROM places")
def site_keys(spark, d):
    return table(spark, d, "places").select(parse.site_key(F.col("lon"), F.col("lat")).alias("site_key")).distinct()


# Feeds

@query("""SELECT station, id, utc, CAST(ts AS BIGINT) AS ts, air_temp, wind_dir_deg, wind_spd_kmh, press_hpa, latest FROM (
SELECT station, id, '2024010' || CAST(1 + id % 9 AS VARCHAR) || '123000' AS utc, 1704112200 + (id % 9) * 86400 AS ts, CASE WHEN id % 7 < 2 THEN NULL ELSE 10e0 + id % 20 END AS air_temp, CASE id % 5 WHEN 1 THEN 0e0 WHEN 2 THEN 202.5e0 WHEN 3 THEN 292.5e0 WHEN 4 THEN 90e0 END AS wind_dir_deg, (id % 40) * 1e0 AS wind_spd_kmh,
CASE WHEN id % 3 = 0 THEN 1005e0 ELSE 1010.5e0 END AS press_hpa, true AS latest FROM feed UNION ALL SELECT station, id, '20240101T110000', 1704106800, 7.5e0, NULL, NULL, NULL, false FROM feed)""")
def feed_parse(spark, d):
    rows = feeds.parse_feed(table(spark, d, "feed"))
    return rows.select("station", "id", "utc", F.unix_seconds("ts").alias("ts"), "air_temp", "wind_dir_deg", "wind_spd_kmh", "press_hpa", "latest")


@query("SELECT id, CASE WHEN id % 5 = 4 THEN NULL ELSE 1710064800 + (id % 9) * 86400 + (id % 10) * 3600 + 1800 - CASE WHEN id % 5 IN (1, 2) THEN 7200 ELSE 0 END END AS t FROM isos")
def instants_parsed(spark, d):
    return table(spark, d, "isos").select("id", F.unix_seconds(parse.instant(F.col("iso"))).alias("t"))


# Catalogues

@query("SELECT id, name FROM granules WHERE NOT starts_with(name, '.') AND contains(name, '_394_') AND contains(name, '250m') AND contains(name, '103F')")
def granule_filter(spark, d):
    return catalogue.select_granules(table(spark, d, "granules"), "_394_", "250m", "103F").select("id", "name")


@query("WITH a AS (SELECT max(strptime(regexp_extract(name, '[0-9]{8}T[0-9]{6}'), '%Y%m%dT%H%M%S')) AS m FROM granules) SELECT CAST(epoch(m) AS BIGINT) AS newest, CAST(epoch(m) AS BIGINT) - 45 * 86400 AS since FROM a")
def search_start(spark, d):
    found = catalogue.search_start(catalogue.parsed_granules(table(spark, d, "granules")), 45, "2023-01-01")
    return found.select(F.unix_seconds("newest").alias("newest"), F.unix_seconds("since").alias("since"))


@query("SELECT DISTINCT granule FROM remote WHERE name LIKE '%.nc' AND name NOT IN (SELECT name FROM locals)")
def remote_new(spark, d):
    remote = table(spark, d, "remote").groupBy("granule").agg(F.collect_list("name").alias("names"))
    return catalogue.new_remote(remote, table(spark, d, "locals"))


@query("SELECT name FROM remote UNION SELECT name FROM locals")
def all_names(spark, d):
    return catalogue.distinct_names(table(spark, d, "remote"), table(spark, d, "locals"))


@query("""WITH k AS (SELECT id, name, regexp_replace(regexp_replace(name, '^wave_', ''), '[.]nc$', '') AS key, CASE WHEN starts_with(name, 'wave_') THEN 'wave' ELSE 'flow' END AS source FROM names)
SELECT id, name, key, source FROM (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY id) AS r FROM k) WHERE r = 1""")
def unique_scenarios(spark, d):
    parsed = scenarios.parse_name(table(spark, d, "names"), strict=False).select("id", "name", "key", "source")
    return catalogue.keep_first(parsed, ["key", "source"], ["id"])


def _classified(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "paths").withColumn("head", F.encode("head", "ISO-8859-1"))
    return catalogue.classified(files)


_CLASSES = """WITH c AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM paths), k AS (SELECT *, CASE WHEN contains(path, '__MACOSX/') OR contains(path, '/.') OR starts_with(base, '.') THEN 'junk' WHEN NOT contains(base, '_sal') THEN 'unnamed' WHEN head = 'XXXX' THEN 'bad_format' ELSE 'kept' END AS class,
CASE WHEN starts_with(base, 'wave_') OR contains(path, 'wave_out/') THEN 'wave' ELSE 'flow' END AS source, regexp_replace(regexp_replace(base, '^wave_', ''), '[.]nc$', '') AS key FROM c) """


@query(_CLASSES + "SELECT class, count(*) AS n, min(path) AS first_path FROM k GROUP BY class")
def scenario_classes(spark, d):
    return catalogue.class_report(_classified(spark, d)).select("class", "n", F.element_at("samples", 1).alias("first_path"))


@query(_CLASSES + """SELECT key, CAST(regexp_extract(key, 'wind-sp([0-9]+)', 1) AS DOUBLE) AS wind_speed, -CAST(replace(regexp_extract(key, 'wlvl-([0-9]+_[0-9]+)', 1), '_', '.') AS DOUBLE) AS wlvl, CAST(regexp_extract(key, 'sal([0-9]+)', 1) AS DOUBLE) AS salinity, max(CASE WHEN source = 'wave' THEN path END) AS wave, max(CASE WHEN source = 'flow' THEN path END) AS flow FROM k WHERE class = 'kept' GROUP BY key""")
def scenario_pairs(spark, d):
    p = catalogue.paired(_classified(spark, d))
    return p.select("key", "wind_speed", "wlvl", "salinity", F.try_element_at("files", F.lit("wave")).alias("wave"), F.try_element_at("files", F.lit("flow")).alias("flow"))


@query(_CLASSES + """, g AS (SELECT key, max(CAST(source = 'wave' AS INT)) AS w, max(CAST(source = 'flow' AS INT)) AS f, any_value(regexp_extract(key, 'wind-sp([0-9]+)', 1)) AS a, any_value(regexp_extract(key, 'wind-dir([0-9]+)', 1)) AS b, any_value(regexp_extract(key, 'wlvl-([0-9]+)', 1)) AS c, any_value(regexp_extract(key, 'sal([0-9]+)', 1)) AS e FROM k WHERE class = 'kept' GROUP BY key)
SELECT count(*) AS n_scenarios, CAST(sum(w) AS BIGINT) AS n_wave, CAST(sum(f) AS BIGINT) AS n_flow, round(count(*) / (count(DISTINCT a) * count(DISTINCT b) * count(DISTINCT c) * count(DISTINCT e) * 1e0), 9) AS fill FROM g""")
def catalogue_counts(spark, d):
    return catalogue.catalogue_counts(catalogue.paired(_classified(spark, d))).withColumn("fill", F.round("fill", 9))


@query(_CLASSES + "SELECT key, source, path FROM k WHERE class = 'kept' AND path IN (SELECT path FROM paths WHERE id % 5 <> 0)")
def existing_outputs(spark, d):
    files = _classified(spark, d).where("class = 'kept'").select("key", "source", "path")
    return catalogue.on_disk(files, table(spark, d, "paths").where("id % 5 != 0")).select("key", "source", "path")


@query("SELECT id, 'wlvl' || replace(CAST(-(7 + id % 7) - 0.5e0 AS VARCHAR), '.', '_') AS name FROM paths")
def name_numbers(spark, d):
    return table(spark, d, "paths").select("id", F.concat(F.lit("wlvl"), parse.name_number(-(7 + F.col("id") % 7) - 0.5)).alias("name"))


@query("""WITH o AS (SELECT key, source, n_time, n_layer, no_dir FROM runs WHERE key % 43 <> 0), c AS (SELECT source, n_time, count(*) AS n, min(key) AS k FROM o GROUP BY ALL), t AS (SELECT source, n_time AS mt FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, k) AS r FROM c) WHERE r = 1),
e AS (SELECT source, n_layer, count(*) AS n, min(key) AS k FROM o GROUP BY ALL), l AS (SELECT source, n_layer AS ml FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, k) AS r FROM e) WHERE r = 1)
SELECT key, concat_ws(' ; ', CASE WHEN o.source = 'flow' THEN 'no output of wave' ELSE 'no output of flow' END, CASE WHEN key % 53 = 0 THEN o.source || ': unreadable' END, CASE WHEN key % 53 <> 0 AND key % 47 = 0 THEN o.source || ': empty dimension time' END, CASE WHEN key % 53 <> 0 AND no_dir AND o.source = 'wave' THEN 'wave: missing dir' END,
CASE WHEN key % 53 <> 0 AND n_time <> mt THEN o.source || ': times ' || n_time END, CASE WHEN key % 53 <> 0 AND n_layer <> ml THEN o.source || ': layers ' || n_layer END) AS problems FROM o JOIN t ON t.source = o.source JOIN l ON l.source = o.source""")
def run_problems(spark, d):
    runs = table(spark, d, "runs").where("key % 43 != 0").withColumn("readable", F.col("key") % 53 != 0).withColumn("vars", F.when(F.col("no_dir"), F.array(F.lit("Hsign"))).otherwise(F.array(F.lit("hsign"), F.lit("DIR"))))
    runs = runs.withColumn("empty_dims", F.when(F.col("key") % 47 == 0, F.array(F.lit("time"))).otherwise(F.array().cast("array<string>"))).withColumn("empty_vars", F.array().cast("array<string>"))
    return catalogue.check_runs(runs, {"wave": ["hsign", "dir"], "flow": ["hsign"]}).select("key", F.concat_ws(" ; ", "problems").alias("problems"))


@query("SELECT source, CAST(count(DISTINCT key) * 576 * 2 * 3 AS BIGINT) AS bytes FROM flow GROUP BY source")
def size_estimate(spark, d):
    return catalogue.size_estimate(table(spark, d, "flow"), table(spark, d, "mesh"), {"flow": 3})


@query("SELECT (SELECT count(*) FROM granules) AS n_granules, (SELECT CAST(epoch(max(strptime(regexp_extract(name, '[0-9]{8}T[0-9]{6}'), '%Y%m%dT%H%M%S'))) AS BIGINT) FROM granules) AS last_granule, (SELECT count(DISTINCT file) FROM levels WHERE file % 5 = 0) AS new_this_run")
def freshness(spark, d):
    g = catalogue.parsed_granules(table(spark, d, "granules"))
    return catalogue.freshness(g, table(spark, d, "levels").where("file % 5 = 0")).select("n_granules", F.unix_timestamp("last_granule").alias("last_granule"), "new_this_run")


# Conditions and matches

_ASKED = """WITH o AS (SELECT t, arg_max(wind_spd_kmh, id) AS s, arg_max(wind_dir_deg, id) AS w, max(id) AS id FROM (SELECT *, max(id) OVER (PARTITION BY t) AS m FROM obs WHERE station = (SELECT min(station) FROM obs)) WHERE id = m GROUP BY t),
i AS (SELECT DISTINCT moment FROM asked), l AS (SELECT t, max(file) AS f FROM levels WHERE site = 1 GROUP BY t), lv AS (SELECT l.t, v.wse FROM l JOIN levels v ON v.site = 1 AND v.t = l.t AND v.file = l.f),
b AS (SELECT i.moment, o.t FROM i ASOF LEFT JOIN o ON i.moment >= o.t), a AS (SELECT i.moment, o.t FROM i ASOF LEFT JOIN o ON i.moment < o.t), n AS (SELECT i.moment, b.t AS bt, a.t AS ft FROM i LEFT JOIN b ON b.moment = i.moment LEFT JOIN a ON a.moment = i.moment),
p AS (SELECT moment, CASE WHEN moment IS NULL OR (bt IS NULL AND ft IS NULL) THEN (SELECT max(t) FROM o) WHEN bt IS NULL OR ft - moment < moment - bt THEN coalesce(ft, bt) ELSE bt END AS ot FROM n),
w AS (SELECT i.moment, lv.t AS lt FROM i ASOF LEFT JOIN lv ON i.moment >= lv.t), z AS (SELECT p.moment, p.ot, coalesce(w.lt, (SELECT max(t) FROM lv)) AS lt FROM p LEFT JOIN w ON w.moment = p.moment)
SELECT z.moment, round(o.s / 3.6e0, 2) AS wind_speed, (o.w + 180) % 360 AS wind_dir, round(lv.wse + 0.25e0, 3) AS wlvl, z.ot AS obs_t, z.lt AS level_t, (SELECT min(station) FROM obs) AS station, CAST(1 AS BIGINT) AS site, coalesce(CAST(round((z.moment - z.ot) / 60e0) AS BIGINT), 0) AS offset_min FROM z JOIN o ON o.t = z.ot JOIN lv ON lv.t = z.lt"""


@query(_ASKED)
def conditions_at(spark, d):
    found = temporal.conditions_at(table(spark, d, "asked").withColumnRenamed("moment", "at"), table(spark, d, "obs"), table(spark, d, "levels"), "nowhere", 1, 0.25, "to")
    return found.select(F.col("at").alias("moment"), "wind_speed", "wind_dir", "wlvl", "obs_t", "level_t", "station", "site", "offset_min")


_SPAN = "WITH l AS (SELECT min(wlvl) AS lo, max(wlvl) AS hi, max(wind_speed) - min(wind_speed) AS ws, max(wlvl) - min(wlvl) AS wl, max(salinity) - min(salinity) AS sl, min(wind_speed) AS w0, max(wind_speed) AS w1, min(salinity) AS s0, max(salinity) AS s1 FROM scenarios), "
_TARGETS = "t AS (SELECT target, CASE WHEN target % 9 = 0 THEN 33.5e0 ELSE wind_speed END AS wind_speed, wind_dir, wlvl, CASE WHEN target % 4 = 0 THEN NULL ELSE (target % 30) * 10e0 END AS salinity FROM targets), "
_RANKED = """p AS (SELECT t.target, s.key, s.wind_speed AS a, s.wind_dir AS b, s.wlvl AS c, s.salinity AS e, sqrt(pow(2 * (t.wind_speed - s.wind_speed) / ws, 2) + pow(((((t.wind_dir - s.wind_dir + 180) % 360) + 360) % 360 - 180) / 180, 2) + pow((t.wlvl - s.wlvl) / wl, 2) + coalesce(pow(0.5 * (t.salinity - s.salinity) / sl, 2), 0)) AS dist
FROM t CROSS JOIN l JOIN scenarios s ON s.wlvl <= t.wlvl + 1e-6 OR t.wlvl + 1e-6 < l.lo), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(dist, 9), key) AS rank FROM p) """
_WEIGHTS = {"wind_speed": 2.0, "salinity": 0.5}


def _whole_match(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, float]]:
    own = table(spark, d, "targets").withColumn("salinity", F.when(F.col("target") % 4 != 0, (F.col("target") % 30) * 10.0))
    given = own.where("target % 9 = 0").select("target", F.lit("33.5").alias("wind_speed"), *(F.lit(None).cast("string").alias(p) for p in ("wind_dir", "wlvl", "salinity")))
    targets, known = scenarios.overridden(own, given), table(spark, d, "scenarios")
    scales = scenarios.scales_of(known)
    return targets, known, scenarios.match(targets, known, scales, k, weights=_WEIGHTS), scales


@query(_SPAN + _TARGETS + _RANKED + "SELECT target, CAST(rank AS INT) AS rank, round(dist, 3) AS dist FROM r WHERE rank <= 5")
def match_weighted(spark, d):
    return _whole_match(spark, d, 5)[2].select("target", "rank", "dist")


@query(_SPAN + _TARGETS + _RANKED + """SELECT r.target, CASE WHEN t.wind_speed < w0 THEN 'below' WHEN t.wind_speed > w1 THEN 'above' ELSE 'in' END AS flag_wind_speed, CASE WHEN t.wlvl < lo THEN 'below' WHEN t.wlvl > hi THEN 'above' ELSE 'in' END AS flag_wlvl,
CASE WHEN t.salinity IS NULL THEN NULL WHEN t.salinity < s0 THEN 'below' WHEN t.salinity > s1 THEN 'above' ELSE 'in' END AS flag_salinity FROM r JOIN t ON t.target = r.target CROSS JOIN l WHERE rank = 1""")
def match_envelope(spark, d):
    targets, known, found, scales = _whole_match(spark, d, 1)
    return scenarios.envelope(found, targets, known, scales).select("target", "flag_wind_speed", "flag_wlvl", "flag_salinity")


_VECTORS = "SELECT DISTINCT round(wind_speed, 3) AS a, round(wind_dir, 3) AS b, round(wlvl, 3) AS c, round(salinity, 3) AS e FROM "


@query(f"WITH w AS ({_VECTORS} design), h AS ({_VECTORS} scenarios), m AS (SELECT * FROM w EXCEPT SELECT * FROM h), x AS (SELECT * FROM h EXCEPT SELECT * FROM w) SELECT 'missing' AS kind, count(*) AS n, min(a) AS first_speed FROM m HAVING count(*) > 0 UNION ALL SELECT 'extra', count(*), min(a) FROM x HAVING count(*) > 0")
def design_samples(spark, d):
    found = scenarios.missing_and_extra(table(spark, d, "design"), table(spark, d, "scenarios"))
    return found.select("kind", "n", F.element_at("samples", 1)["wind_speed"].alias("first_speed"))


# Weather

@query("""WITH k AS (SELECT station, CAST(floor(wind_dir_deg / 22.5 + 0.5) AS INT) % 16 AS sector, wind_spd_kmh > 0 AND wind_dir_deg IS NOT NULL AS moves FROM obs WHERE wind_spd_kmh IS NOT NULL), c AS (SELECT station, sector, count(*) AS n FROM k WHERE moves GROUP BY ALL), t AS (SELECT station, count(*) AS n FROM k GROUP BY station)
SELECT c.station, round(max(100e0 * c.n / t.n), 4) AS percent FROM c JOIN t ON t.station = c.station GROUP BY c.station""")
def rose_scale(spark, d):
    return weather.largest_sector(weather.wind_rose(table(spark, d, "obs"))).withColumn("percent", F.round("percent", 4))


# Areas

def _lake_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").withColumn("utm_zone", (52 + F.col("granule") % 4).cast("int"))


@query(f"""WITH z AS (SELECT *, CAST(coalesce(water_frac BETWEEN 0.1 AND 0.99 AND qual <= 1, false) AS INT) AS v FROM cells WHERE abs(52 + granule % 4 - 53) <= 1), o AS (SELECT unnest(range(-2, 3)) AS d),
f AS (SELECT c.granule, c.iy, c.ix, sum(m.v) * 2 > 25 AS mask FROM z c CROSS JOIN o a CROSS JOIN o b JOIN z m ON m.granule = c.granule AND m.iy = greatest(0, least(23, c.iy + a.d)) AND m.ix = greatest(0, least(23, c.ix + b.d)) GROUP BY c.granule, c.iy, c.ix),
s AS (SELECT z.day, z.granule, sum(CASE WHEN f.mask THEN coalesce(z.water_area, 0) ELSE 0 END) AS a, count_if(f.mask) AS n, count(z.water_frac) AS c FROM z JOIN f ON f.granule = z.granule AND f.iy = z.iy AND f.ix = z.ix WHERE EXISTS (SELECT 1 FROM boundary b WHERE pow((z.lon - b.lon) * {COS!r}, 2) + pow(z.lat - b.lat, 2) <= {(2 / 111.32) ** 2!r}) GROUP BY z.day, z.granule)
SELECT day, round(sum(a) / 1e6, 3) AS area_km2, count(*) AS n_scenes, CAST(sum(n) AS BIGINT) AS n_cells, round(CAST(sum(c) AS DOUBLE) / (SELECT count(*) FROM boundary), 6) AS coverage FROM s WHERE c > 0 OR n > 0 GROUP BY day""")
def lake_area_daily(spark, d):
    days = raster.lake_area(_lake_cells(spark, d), table(spark, d, "boundary"), COS, (137.0, 137.23, -29.03, -28.8), 12, 53)
    return days.select("day", "area_km2", "n_scenes", "n_cells", "coverage")


@query("SELECT day, granule, round(sum(CASE WHEN water_frac BETWEEN 0.1 AND 0.99 AND qual <= 1 AND iy < 12 THEN water_frac * 10000 ELSE 0 END), 3) AS area_m2, count(water_frac) AS n_valid, CAST(count_if(water_frac IS NOT NULL AND iy < 12) AS BIGINT) AS covered_cells FROM cells GROUP BY day, granule")
def scene_area_by_fraction(spark, d):
    cells = table(spark, d, "cells").withColumn("mask", raster.water_mask(F.col("water_frac"), F.col("qual"))).withColumn("inside", F.col("iy") < 12).drop("water_area", "uncert")
    return raster.scene_area(cells, ["day", "granule"], "mask", "inside", 10_000.0).select("day", "granule", F.round("area_m2", 3).alias("area_m2"), "n_valid", "covered_cells")


@query("""WITH a AS (SELECT day, CAST(round_even((lat + 29.0) / 0.15 * 9, 0) AS BIGINT) AS gy, CAST(round_even((lon - 137.05) / 0.1 * 9, 0) AS BIGINT) AS gx, water_frac FROM cells WHERE lon BETWEEN 137.05 AND 137.15 AND lat BETWEEN -29.0 AND -28.85 AND coalesce(water_frac BETWEEN 0.1 AND 0.99 AND qual <= 1, false))
SELECT day, greatest(0, least(9, gy)) AS gy, greatest(0, least(9, gx)) AS gx, round(avg(water_frac), 6) AS frac, CAST(floor(avg(water_frac) * 205 + 1e-9) AS INT) AS opacity FROM a GROUP BY ALL""")
def fraction_bins(spark, d):
    cells = table(spark, d, "cells").withColumn("mask", raster.water_mask(F.col("water_frac"), F.col("qual")))
    return raster.fraction_bins(raster.binned(cells, (137.05, 137.15, -29.0, -28.85), 10), "mask").select("day", "gy", "gx", r6("frac"), "opacity")


@query("WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mesh WHERE iy BETWEEN 8 AND 15 AND ix BETWEEN 8 AND 15) SELECT f.source, f.key, f.layer, f.cell FROM flow f JOIN mesh m ON m.cell = f.cell CROSS JOIN b WHERE m.x BETWEEN x0 - 2000 AND x1 + 2000 AND m.y BETWEEN y0 - 2000 AND y1 + 2000")
def sub_block(spark, d):
    mesh = table(spark, d, "mesh")
    cells = table(spark, d, "flow").join(mesh, ["source", "cell"])
    return raster.block_of(cells, mesh.where("iy BETWEEN 8 AND 15 AND ix BETWEEN 8 AND 15"), 2000.0).select("source", "key", "layer", "cell")


@query("SELECT layer, round(sqrt(avg(u) * avg(u) + avg(v) * avg(v)), 9) AS error FROM flow GROUP BY layer")
def volume_error(spark, d):
    return table(spark, d, "flow").groupBy("layer").agg(F.round(raster.relative_volume_error(F.avg("u"), F.avg("v")), 9).alias("error"))


# Coordinates

_ARC = """(6378137e0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256) * {p} - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * {p})
+ (15 * e2 * e2 / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * {p}) - 35 * pow(e2, 3) / 3072 * sin(6 * {p})))"""


@query(f"""WITH k AS (SELECT *, radians(lat) AS p, radians(lon - ((zone - 1) * 6 - 177)) AS l, 0.0066943800229007869e0 AS e2, 0.0067394967754789573e0 AS ep FROM points),
q AS (SELECT *, 6378137e0 / sqrt(1 - e2 * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, ep * cos(p) * cos(p) AS c, l * cos(p) AS a FROM k)
SELECT id, round(500000 + 0.9996e0 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120), 3) AS x, round(10000000 + 0.9996e0 * ({_ARC.format(p="p")} + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)), 1) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM q""")
def utm_points(spark, d):
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    p = table(spark, d, "points").select("id", "zone", x.alias("x"), y.alias("y"))
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 1).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE zone END AS zone FROM points")
def zone_detected(spark, d):
    p = table(spark, d, "points")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    shifted = p.withColumn("x", x).withColumn("y", y).withColumn("hint", F.col("lon") + F.when(F.col("id") % 3 == 0, 3.1).otherwise(0.4))
    return shifted.select("id", geo.detect_zone(F.col("x"), F.col("y"), F.col("hint"))[0].alias("zone"))


@query("""WITH b AS (SELECT *, x >= 1e30 OR abs(x + 999.999e0) <= 1e-8 + 1e-5 * 999.999e0 OR abs(x + 999) <= 1e-8 + 1e-5 * 999 OR abs(x - 999.999e0) <= 1e-8 + 1e-5 * 999.999e0 AS bx, abs(y - 999.999e0) <= 1e-8 + 1e-5 * 999.999e0 AS byy FROM coords),
g AS (SELECT grid, max(CASE WHEN NOT bx THEN abs(x) END) > 1000 OR max(CASE WHEN NOT byy THEN abs(y) END) > 1000 AS m FROM b GROUP BY grid)
SELECT id, n, p, s, CASE WHEN NOT (bx OR byy OR (m AND (x = 0 OR y = 0))) THEN x END AS x, CASE WHEN NOT (bx OR byy OR (m AND (x = 0 OR y = 0))) THEN y END AS y FROM b JOIN g ON g.grid = b.grid""")
def sentinel_clean(spark, d):
    return fields.clean_coordinates(table(spark, d, "coords"), ["grid"]).select("id", "n", "p", "s", "x", "y")


@query("SELECT id, name, CASE WHEN p_zero = 0 AND lower(name) = 'u1' THEN NULL ELSE p_zero * 1e0 END AS value FROM (SELECT id, name, id % 3 AS p_zero FROM model_vars)")
def zero_mask(spark, d):
    return table(spark, d, "model_vars").select("id", "name", fields.mask_zero((F.col("id") % 3).cast("double"), F.col("name")).alias("value"))


@query("SELECT key, layer, cell, coalesce(u <> 0, false) AS by_level, coalesce(v > 0, false) AS by_value FROM (SELECT key, layer, cell, CASE WHEN cell % 7 = 0 THEN NULL ELSE u END AS u, v FROM flow)")
def wet_mask(spark, d):
    level = F.when(F.col("cell") % 7 != 0, F.col("u"))
    return table(spark, d, "flow").select("key", "layer", "cell", fields.wet_mask(F.col("value"), level).alias("by_level"), fields.wet_mask(F.col("v")).alias("by_value"))


@query("""SELECT id, CASE WHEN starts_with(dims, 'time') OR starts_with(dims, 'TIME') THEN 'time' WHEN starts_with(dims, 'kmax') THEN 'layer' ELSE 'other' END AS role, CASE WHEN long_name <> '' THEN long_name ELSE CASE lower(name) WHEN 's1' THEN 'Water level' WHEN 'u1' THEN 'U velocity' WHEN 'hsign' THEN 'Significant wave height' WHEN 'r1' THEN 'Concentration' ELSE name END END AS label FROM model_vars""")
def variable_labels(spark, d):
    v = table(spark, d, "model_vars")
    return v.select("id", parse.dim_role(F.split("dims", ",")[0]).alias("role"), parse.field_label(F.col("name"), F.col("long_name")).alias("label"))


@query("SELECT id, name, dims LIKE 'time%' OR dims LIKE 'TIME%' AS has_time FROM model_vars WHERE dims IN ('time,M,N', 'kmaxout_restr,M,N', 'M,N') AND name <> 'XZ'")
def variable_inventory(spark, d):
    v = table(spark, d, "model_vars").withColumn("dims", F.split("dims", ","))
    return fields.spatial_variables(v, ["XZ", "YZ"]).select("id", "name", "has_time")


@query("""WITH r AS (SELECT file, id, name, CASE lower(name) WHEN 'hsign' THEN 0 WHEN 's1' THEN 3 WHEN 'u1' THEN 12 WHEN 'r1' THEN 17 ELSE CASE WHEN long_name <> '' THEN 22 ELSE 99 END END AS k FROM model_vars) SELECT file, arg_min(name, (k, id % 2, name)) AS name FROM r GROUP BY file""")
def field_choice(spark, d):
    v = table(spark, d, "model_vars").withColumn("on_coords", F.col("id") % 2 == 0)
    return fields.preferred_field(v, parse.field_rank(F.col("name"), F.col("long_name")))


@query("""WITH c AS (SELECT grid, CASE WHEN n % 2 = 1 THEN 'XZ' ELSE 'x' END AS pair, n, x, y FROM coords WHERE n IN (1, 2, 4)), g AS (SELECT grid, pair, max(x) - min(x) AS sx, count(*) AS n FROM c WHERE n = 4 GROUP BY ALL) SELECT grid AS file, pair FROM g WHERE sx > 0 ORDER BY 1""")
def coordinate_choice(spark, d):
    c = table(spark, d, "coords").where("n IN (1, 2, 4)").select(F.col("grid").alias("file"), F.when(F.col("n") % 2 == 1, "XZ").otherwise("x").alias("pair"), F.when(F.col("n") == 1, -999.0).otherwise(F.col("x")).alias("x"), "y")
    return fields.first_coordinates(c, ["XZ", "x"])


@query("SELECT layer AS n, false AS turned, true AS plain FROM (SELECT DISTINCT layer FROM flow)")
def full_grids(spark, d):
    m = table(spark, d, "flow").select("layer").distinct().join(F.broadcast(table(spark, d, "mesh")))
    plain = fields.full_grid(m.select("layer", "iy", "ix", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y")), ["layer"]).withColumnRenamed("regular", "plain")
    return fields.full_grid(m, ["layer"]).join(plain, "layer").select(F.col("layer").alias("n"), F.col("regular").alias("turned"), "plain")


@query("WITH s AS (SELECT key, count(DISTINCT layer) AS n FROM flow GROUP BY key), a AS (SELECT unnest([-5, -1, 0, 1, 9]) AS i) SELECT key, i AS asked, CAST(greatest(least(CASE WHEN i < 0 THEN i + n ELSE i END, n - 1), 0) AS BIGINT) AS index FROM s CROSS JOIN a")
def layer_index(spark, d):
    sizes = table(spark, d, "flow").groupBy("key").agg(F.count_distinct("layer").alias("n"))
    return sizes.withColumn("asked", F.explode(F.array(*map(F.lit, (-5, -1, 0, 1, 9))))).select("key", "asked", fields.clamped_index(F.col("asked"), F.col("n")).alias("index"))


@query("WITH b AS (SELECT granule, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM cells GROUP BY granule) SELECT granule, round(greatest(x0, 137.1 + (granule % 2)), 6) AS west, round(least(x1, 137.15 + (granule % 2)), 6) AS east, true AS far FROM b WHERE granule % 2 = 0 UNION ALL SELECT granule, NULL, NULL, true FROM b WHERE granule % 2 = 1")
def extent_clip(spark, d):
    b = extraction.granule_boxes(table(spark, d, "cells"))
    clip = lambda x: fields.clip_extent(*map(F.col, ("lon_min", "lon_max", "lat_min", "lat_max")), (x, x + 0.05, -29.0, -28.9))
    b = b.withColumn("e", F.when(F.col("granule") % 2 == 0, clip(137.1)).otherwise(clip(138.1)))
    far = fields.far_from((F.col("lon_min") + F.col("lon_max")) / 2, (F.col("lat_min") + F.col("lat_max")) / 2, (140.0, -28.0))
    return b.select("granule", F.round("e.lon_min", 6).alias("west"), F.round("e.lon_max", 6).alias("east"), far.isNotNull().alias("far"))


# Fields

_TRUE = "degrees(atan2(0.34e0, 0.94e0)) + degrees(atan(tan(radians(m.lon - 135)) * sin(radians(m.lat))))"


@query(f"""WITH t AS (SELECT f.*, radians({_TRUE}) AS a FROM flow f JOIN mesh m ON m.cell = f.cell), e AS (SELECT *, u * cos(a) - v * sin(a) AS ue, u * sin(a) + v * cos(a) AS vn FROM t)
SELECT key, layer, cell, round(ue, 6) + 0e0 AS ue, round(vn, 6) + 0e0 AS vn, round(sqrt(ue * ue + vn * vn), 6) AS speed, round(((degrees(atan2(ue, vn)) % 360) + 360) % 360, 4) % 360 AS bearing FROM e WHERE sqrt(u * u + v * v) > 1e-9""")
def rotate_true_north(spark, d):
    mesh = fields.rotation_terms(table(spark, d, "mesh"), ["source"], F.lit(53))
    out = fields.to_true_north(table(spark, d, "flow").where("sqrt(u * u + v * v) > 1e-9"), mesh, ["source", "cell"])
    return out.select("key", "layer", "cell", (F.round("ue", 6) + 0.0).alias("ue"), (F.round("vn", 6) + 0.0).alias("vn"), r6("speed"), F.pmod(F.round("bearing", 4), F.lit(360.0)).alias("bearing"))


@query("SELECT key, layer, cell, round((turn + 180) % 360, 6) AS towards, turn AS same FROM fields")
def wave_bearings(spark, d):
    return table(spark, d, "fields").select("key", "layer", "cell", F.round(fields.wave_bearing(F.col("turn")), 6).alias("towards"), fields.wave_bearing(F.col("turn"), "to").alias("same"))


_GRID = f"""b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM mesh), g AS (SELECT CAST(y.v AS INT) AS gy, CAST(x.v AS INT) AS gx, x0 + (x1 - x0) * x.v / {N - 1} AS lon, y0 + (y1 - y0) * y.v / {N - 1} AS lat FROM b CROSS JOIN (SELECT unnest(range({N})) AS v) y CROSS JOIN (SELECT unnest(range({N})) AS v) x),
w AS (SELECT g.gy, g.gx, m.cell, row_number() OVER (PARTITION BY g.gy, g.gx ORDER BY pow((m.lon - g.lon) * {COS!r}, 2) + pow(m.lat - g.lat, 2), m.iy, m.ix) AS n FROM g CROSS JOIN mesh m), k AS (SELECT gy, gx, cell FROM w WHERE n = 1) """


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mesh = table(spark, d, "mesh")
    targets = fields.target_grid(mesh, N)
    return mesh, targets, fields.nearest_weights(targets, mesh, 0.05, COS)


@query("WITH " + _GRID + "SELECT f.key, f.layer, k.gy, k.gx, round(f.value, 6) AS value, f.wet FROM flow f JOIN k ON k.cell = f.cell")
def layer_nearest(spark, d):
    near = _near(spark, d)[2]
    return table(spark, d, "flow").join(near, ["source", "cell"]).select("key", "layer", "gy", "gx", r6("value"), "wet")


def _linear(x: str, y: str, n: int, scale: float) -> str:
    """SQL: grid g over the extent of x and y, the nearest cell k, and weights wt of the first of all triangles that holds a point."""
    corner = lambda t, c: f"{t}.cell AS c{c}, {t}.{x} AS x{c}, {t}.{y} AS y{c}"
    quad = "mesh a JOIN mesh b ON b.iy = a.iy AND b.ix = a.ix + 1 JOIN mesh c ON c.iy = a.iy + 1 AND c.ix = a.ix"
    return f"""b AS (SELECT min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, max({y}) AS y1 FROM mesh), g AS (SELECT CAST(v.v AS INT) AS gy, CAST(h.v AS INT) AS gx, x0 + (x1 - x0) * h.v / {n - 1} AS x, y0 + (y1 - y0) * v.v / {n - 1} AS y FROM b CROSS JOIN (SELECT unnest(range({n})) AS v) v CROSS JOIN (SELECT unnest(range({n})) AS v) h),
k AS (SELECT gy, gx, cell FROM (SELECT g.gy, g.gx, m.cell, row_number() OVER (PARTITION BY g.gy, g.gx ORDER BY pow((m.{x} - g.x) * {scale!r}, 2) + pow(m.{y} - g.y, 2), m.iy, m.ix) AS n FROM g CROSS JOIN mesh m) WHERE n = 1),
tri AS (SELECT a.iy, a.ix, 0 AS half, {corner("a", "p")}, {corner("b", "q")}, {corner("c", "r")} FROM {quad} UNION ALL SELECT a.iy, a.ix, 1, {corner("f", "p")}, {corner("b", "q")}, {corner("c", "r")} FROM {quad} JOIN mesh f ON f.iy = a.iy + 1 AND f.ix = a.ix + 1),
bar AS (SELECT gy, gx, iy, ix, half, cp, cq, cr, ((yq - yr) * (x - xr) + (xr - xq) * (y - yr)) / area AS wp, ((yr - yp) * (x - xr) + (xp - xr) * (y - yr)) / area AS wq FROM g CROSS JOIN (SELECT *, (yq - yr) * (xp - xr) + (xr - xq) * (yp - yr) AS area FROM tri)),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gy, gx ORDER BY iy, ix, half) AS n FROM bar WHERE wp >= -1e-9 AND wq >= -1e-9 AND 1 - wp - wq >= -1e-9) WHERE n = 1),
wt AS (SELECT gy, gx, cp AS cell, wp AS w FROM first UNION ALL SELECT gy, gx, cq, wq FROM first UNION ALL SELECT gy, gx, cr, 1 - wp - wq FROM first) """


_SMOOTHED = """z AS (SELECT f.key, f.layer, t.gy, t.gx, sum(t.w * coalesce(f.value, 0)) AS z FROM flow f JOIN wt t ON t.cell = f.cell WHERE EXISTS (SELECT 1 FROM flow e JOIN k ON k.cell = e.cell WHERE e.wet AND e.key = f.key AND e.layer = f.layer AND k.gy = t.gy AND k.gx = t.gx) GROUP BY ALL)"""


@query("WITH " + _linear("lon", "lat", N, COS) + ", " + _SMOOTHED + " SELECT key, layer, gy, gx, round(z, 6) + 0e0 AS z FROM z")
def layer_linear(spark, d):
    mesh, _, near = _near(spark, d)
    return fields.resample(table(spark, d, "flow"), ["key", "layer"], fields.linear_weights(mesh, N), near).select("key", "layer", "gy", "gx", (F.round("z", 6) + 0.0).alias("z"))


def _current_sql(n: int) -> str:
    return "WITH " + _linear("x", "y", n, 1.0) + """, c AS (SELECT f.key, f.layer, t.gy, t.gx, sum(t.w * f.u) AS u, sum(t.w * f.v) AS v FROM flow f JOIN wt t ON t.cell = f.cell WHERE EXISTS (SELECT 1 FROM flow e JOIN k ON k.cell = e.cell WHERE e.wet AND e.key = f.key AND e.layer = f.layer AND k.gy = t.gy AND k.gx = t.gx) GROUP BY ALL),
s AS (SELECT c.*, g.x, g.y, sqrt(u * u + v * v) AS speed FROM c JOIN g ON g.gy = c.gy AND g.gx = c.gx) """


@query(_current_sql(N) + "SELECT key, layer, gy, gx, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y, CASE WHEN speed >= 1e-6 THEN round(speed, 6) END AS speed FROM s")
def current_map(spark, d):
    speeds, _ = fields.current_map(table(spark, d, "flow"), table(spark, d, "mesh"), ["key", "layer"], N, 9)
    return speeds.select("key", "layer", "gy", "gx", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"), r6("speed"))


@query(_current_sql(9) + "SELECT key, layer, gy, gx, round(((degrees(atan2(u, v)) % 360) + 360) % 360, 2) % 360 AS bearing, round(speed, 5) AS speed FROM s WHERE speed >= 1e-6")
def current_arrows(spark, d):
    _, arrows = fields.current_map(table(spark, d, "flow"), table(spark, d, "mesh"), ["key", "layer"], N, 9)
    return arrows.select("key", "layer", "gy", "gx", "bearing", "speed")


_SLAB = """n AS (SELECT key, name, max(time) + 1 AS nt, max(layer) + 1 AS nl, max(constituent) + 1 AS nc FROM model_cells GROUP BY ALL), i AS (SELECT unnest([-9, -1, 0, 2, 99]) AS i),
a AS (SELECT n.key, n.name, i.i AS asked, greatest(least(CASE WHEN i < 0 THEN i + nt ELSE i END, nt - 1), 0) AS t, nl - 1 AS l, greatest(least(i * i, nc - 1), 0) AS c FROM n CROSS JOIN i) """


def _model_cells(spark: SparkSession, d: str) -> DataFrame:
    folder, cells = shared_folder(spark, "model"), table(spark, d, "model_cells").withColumns({c: F.col(c).cast("int") for c in fields.DIMENSIONS})
    fields.write_model_cells(cells, folder)
    return spark.read.schema(cells.schema).parquet(folder)


@query("WITH " + _SLAB + "SELECT a.key, a.name, a.asked, CAST(a.t AS INT) AS time, CAST(a.l AS INT) AS layer, CAST(a.c AS INT) AS constituent, m.cell, round(m.value, 6) AS value FROM a JOIN model_cells m ON m.key = a.key AND m.name = a.name AND m.time = a.t AND m.layer = a.l AND m.constituent = a.c")
def hyperslab(spark, d):
    cells = _model_cells(spark, d)
    sizes = fields.dimension_sizes(cells)
    index = F.explode(F.array(*map(F.lit, (-9, -1, 0, 2, 99)))).alias("asked")
    asked = sizes.select("key", "name", index).select("key", "name", "asked", F.col("asked").alias("time"), F.lit(-1).alias("layer"), (F.col("asked") * F.col("asked")).alias("constituent"))
    return fields.hyperslab(cells, sizes, asked).select("key", "name", "asked", *fields.DIMENSIONS, "cell", r6("value"))


@query("""WITH n AS (SELECT key, name, max(time) + 1 AS nt, max(layer) + 1 AS nl, max(constituent) + 1 AS nc FROM model_cells GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE name WHEN 'S1' THEN 3 ELSE 12 END) AS r FROM n WHERE key % 2 = 0 OR name = 'U1')
SELECT m.key, m.name, m.cell, round(g.lon, 6) AS lon, round(g.lat, 6) AS lat, CASE WHEN m.name = 'U1' AND m.value = 0 THEN NULL ELSE round(m.value, 6) END AS value FROM p JOIN model_cells m ON m.key = p.key AND m.name = p.name AND m.time = p.nt - 1 AND m.layer = least(1, p.nl - 1) AND m.constituent = 0 JOIN mesh g ON g.cell = m.cell WHERE p.r = 1""")
def read_field(spark, d):
    """The last time of the second layer of each run; runs with an odd key lack the preferred variable."""
    cells = _model_cells(spark, d)
    cells = cells.where("key % 2 = 0 OR name = 'U1'")
    variables = cells.select(F.col("key").alias("file"), "name", F.lit("").alias("long_name"), F.lit(True).alias("on_coords")).distinct()
    asked = cells.select("key").distinct().select("key", F.lit(-1).alias("time"), F.lit(1).alias("layer"), F.lit(None).cast("int").alias("constituent"))
    return fields.read_field(cells, table(spark, d, "mesh"), variables, asked).select("key", "name", "cell", r6("lon"), r6("lat"), r6("value"))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """One layer grid for each key and layer, by the nearest cell."""
    near = _near(spark, d)[2]
    return table(spark, d, "flow").where("wet").join(near, ["source", "cell"]).select("key", "layer", "gy", "gx", F.col("value").alias("z"))


_LAYER = "WITH " + _GRID + ", z AS (SELECT f.key, f.layer, k.gy, k.gx, f.value AS z FROM flow f JOIN k ON k.cell = f.cell WHERE f.wet) "
_KERNEL = "o AS (SELECT o, exp(-0.5e0 * o * o / 1e0) / (SELECT sum(exp(-0.5e0 * i * i / 1e0)) FROM (SELECT unnest(range(-4, 5)) AS i)) AS w FROM (SELECT unnest(range(-4, 5)) AS o))"
_BACK = "CASE WHEN {0} < 0 THEN -{0} - 1 WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"


@query(_LAYER + f""", {_KERNEL}, t AS (SELECT DISTINCT key, layer, gy FROM z), c AS (SELECT unnest(range({N})) AS gx), r AS (SELECT DISTINCT key, layer FROM z), cy AS (SELECT unnest(range({N})) AS gy),
x AS (SELECT t.key, t.layer, t.gy, c.gx, sum(o.w * z.z) AS num, sum(o.w) AS den FROM t CROSS JOIN c CROSS JOIN o JOIN z ON z.key = t.key AND z.layer = t.layer AND z.gy = t.gy AND z.gx = {_BACK.format("(c.gx + o.o)", N)} GROUP BY ALL),
y AS (SELECT r.key, r.layer, cy.gy, x.gx, sum(o.w * x.num) AS num, sum(o.w * x.den) AS den FROM r CROSS JOIN cy CROSS JOIN o JOIN x ON x.key = r.key AND x.layer = r.layer AND x.gy = {_BACK.format("(cy.gy + o.o)", N)} GROUP BY ALL)
SELECT z.key, z.layer, z.gy, z.gx, round(y.num / y.den, 6) AS z FROM z JOIN y ON y.key = z.key AND y.layer = z.layer AND y.gy = z.gy AND y.gx = z.gx""")
def smooth_field(spark, d):
    return fields.smooth(_layers(spark, d), ["key", "layer"], N, N, 1.0).select("key", "layer", "gy", "gx", r6("z"))


_SMOOTH = f"""{_KERNEL}, t AS (SELECT DISTINCT key, layer, gy FROM z), c AS (SELECT unnest(range({N})) AS gx), r AS (SELECT DISTINCT key, layer FROM z), cy AS (SELECT unnest(range({N})) AS gy),
x AS (SELECT t.key, t.layer, t.gy, c.gx, sum(o.w * z.z) AS num, sum(o.w) AS den FROM t CROSS JOIN c CROSS JOIN o JOIN z ON z.key = t.key AND z.layer = t.layer AND z.gy = t.gy AND z.gx = {_BACK.format("(c.gx + o.o)", N)} GROUP BY ALL),
y AS (SELECT r.key, r.layer, cy.gy, x.gx, sum(o.w * x.num) AS num, sum(o.w * x.den) AS den FROM r CROSS JOIN cy CROSS JOIN o JOIN x ON x.key = r.key AND x.layer = r.layer AND x.gy = {_BACK.format("(cy.gy + o.o)", N)} GROUP BY ALL),
m AS (SELECT z.key, z.layer, z.gy, z.gx, y.num / y.den AS z FROM z JOIN y ON y.key = z.key AND y.layer = z.layer AND y.gy = z.gy AND y.gx = z.gx)"""


@query("WITH " + _linear("lon", "lat", N, COS) + ", " + _SMOOTHED + ", " + _SMOOTH + """ SELECT key, layer, count(*) AS n_valid, round(min(z), 6) + 0e0 AS zmin, round(max(z), 6) AS zmax, round(quantile_cont(z, 0.99), 6) AS p99, round(sum(z), 4) AS total, CAST(sum(gy * 20 + gx) AS BIGINT) AS places FROM m GROUP BY key, layer""")
def map_layer(spark, d):
    z, stats = fields.map_layer(table(spark, d, "flow"), table(spark, d, "mesh"), ["key", "layer"], N, 1.0, COS)
    sums = z.groupBy("key", "layer").agg(F.round(F.sum("z"), 4).alias("total"), F.sum(F.col("gy") * N + F.col("gx")).cast("long").alias("places"))
    return stats.join(sums, ["key", "layer"]).select("key", "layer", "n_valid", (F.round("zmin", 6) + 0.0).alias("zmin"), r6("zmax"), r6("p99"), "total", "places")


@query(_LAYER + ", s AS (SELECT key, layer, min(z) AS a, max(z) AS b, quantile_cont(z, 0.99) AS p, count(z) AS n FROM z GROUP BY key, layer) SELECT key, layer, round(a, 6) AS zmin, round(b, 6) AS zmax, round(p, 6) AS p99, n AS n_valid, 0e0 AS vmin, round(CASE WHEN p <> 0 THEN p ELSE b END, 6) AS vmax FROM s")
def layer_colour_bounds(spark, d):
    s = fields.layer_stats(_layers(spark, d), ["key", "layer"])
    return s.select("key", "layer", r6("zmin"), r6("zmax"), r6("p99"), "n_valid", "vmin", r6("vmax"))


@query("""WITH m AS (SELECT key, layer, max(value) AS z FROM flow GROUP BY ALL), k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM flow)), p AS (SELECT key FROM k WHERE i % greatest(1, n // 5) = 0 AND i / greatest(1, n // 5) < 5)
SELECT layer, CASE WHEN layer = 2 THEN 1e0 ELSE 0e0 END AS vmin, CASE WHEN layer = 2 THEN 3e0 ELSE round(quantile_cont(z, 0.95), 6) END AS vmax FROM m WHERE key IN (SELECT key FROM p) GROUP BY layer""")
def common_bounds(spark, d):
    top = table(spark, d, "flow").groupBy("key", "layer").agg(F.max("value").alias("zmax"))
    return fields.common_bounds(top, 5, {2: (1.0, 3.0)}).select("layer", "vmin", r6("vmax"))


@query("WITH " + _GRID + "SELECT f.key, f.layer, k.gy, k.gx, round(((degrees(atan2(f.u, f.v)) % 360) + 360) % 360, 1) AS bearing, round(f.value, 4) AS value FROM flow f JOIN k ON k.cell = f.cell WHERE f.wet AND sqrt(f.u * f.u + f.v * f.v) > 0")
def arrow_pack(spark, d):
    near = _near(spark, d)[2]
    rows = table(spark, d, "flow").where("wet AND sqrt(u * u + v * v) > 0").join(near, ["source", "cell"]).withColumn("bearing", geo.bearing(F.col("u"), F.col("v")))
    packed = fields.pack_arrows(rows, ["key", "layer"], N)
    return fields.unpack_arrows(packed, ["key", "layer"], N).select("key", "layer", "gy", "gx", "bearing", "value")


@query(_LAYER + "SELECT key, layer, CAST(round_even(gy * 6 / 19e0, 0) AS BIGINT) AS gy, CAST(round_even(gx * 6 / 19e0, 0) AS BIGINT) AS gx, round(z, 6) AS z FROM z WHERE gy IN (0, 3, 6, 10, 13, 16, 19) AND gx IN (0, 3, 6, 10, 13, 16, 19)")
def coarse_grid(spark, d):
    g = fields.coarse_grid(_layers(spark, d), N, N, 7)
    return g.select("key", "layer", "gy", "gx", r6("z"))


@query(_LAYER + "SELECT key, layer, gy, gx, round(z, 6) AS z FROM z WHERE gy % 2 = 0 AND gx % 2 = 0")
def thinned_grid(spark, d):
    z = _layers(spark, d)
    return fields.thinned(fields.thinned(z, "gy", N, 9), "gx", N, 9).select("key", "layer", "gy", "gx", r6("z"))


@query(_LAYER + """, q AS (SELECT id, CASE WHEN lon BETWEEN 136.95 AND 137.2 AND lat BETWEEN -29.0 AND -28.75 THEN CAST(floor((lat + 29.0) / 0.25 * 19 + 0.5) AS INT) END AS gy, CASE WHEN lon BETWEEN 136.95 AND 137.2 AND lat BETWEEN -29.0 AND -28.75 THEN CAST(floor((lon - 136.95) / 0.25 * 19 + 0.5) AS INT) END AS gx FROM stops),
f AS (SELECT * FROM z WHERE layer = 0 AND key = (SELECT min(key) FROM flow)) SELECT q.id, round(f.z, 6) AS z FROM q LEFT JOIN f ON f.gy = q.gy AND f.gx = q.gx""")
def hover_lookup(spark, d):
    low = table(spark, d, "flow").agg(F.min("key").alias("least"))
    one = _layers(spark, d).where("layer = 0").join(F.broadcast(low), F.col("key") == F.col("least"))  # one row
    return fields.grid_lookup(table(spark, d, "stops"), one, (136.95, 137.2, -29.0, -28.75), N, N).select("id", r6("z"))


_ARROWS = "a AS (WITH " + _linear("lon", "lat", 9, COS) + """, v AS (SELECT f.key, f.layer, t.gy, t.gx, sum(t.w * coalesce(f.value, 0)) AS value FROM flow f JOIN wt t ON t.cell = f.cell GROUP BY ALL)
SELECT f.key, f.layer, k.gy * 9 + k.gx AS i, round(CAST(round(((degrees(atan2(f.u, f.v)) % 360) + 360) % 360, 2) % 360 AS DECIMAL(18, 2)), 1) AS b, round(CAST(round(v.value, 5) AS DECIMAL(18, 5)), 4) AS v
FROM flow f JOIN k ON k.cell = f.cell JOIN v ON v.key = f.key AND v.layer = f.layer AND v.gy = k.gy AND v.gx = k.gx WHERE f.wet AND sqrt(f.u * f.u + f.v * f.v) > 0) """
_COARSE = "c AS (SELECT key, layer, CAST(round_even(gy * 6 / 19e0, 0) AS BIGINT) * 7 + CAST(round_even(gx * 6 / 19e0, 0) AS BIGINT) AS i, round(z, 4) AS z FROM z WHERE gy IN (0, 3, 6, 10, 13, 16, 19) AND gx IN (0, 3, 6, 10, 13, 16, 19))"


@query(_LAYER + ", " + _ARROWS + ", " + _COARSE + """, s AS (SELECT key, layer, min(z) AS zmin, max(z) AS zmax, quantile_cont(z, 0.99) AS p, count(z) AS n FROM z WHERE key IN (SELECT key FROM scenarios) GROUP BY key, layer),
aa AS (SELECT key, layer, count(*) AS n, sum(i) AS i, sum(b) AS b, sum(v) AS v FROM a GROUP BY key, layer), cc AS (SELECT key, layer, count(*) AS n, sum(i) AS i, sum(z) AS z FROM c GROUP BY key, layer)
SELECT s.key, s.layer, e.wind_speed, e.salinity, round(s.zmin, 6) AS zmin, round(s.zmax, 6) AS zmax, s.n AS n_valid, 0e0 AS vmin, round(CASE WHEN s.p <> 0 THEN s.p ELSE s.zmax END, 6) AS vmax, coalesce(aa.n, 0) AS n_arrows, CAST(coalesce(aa.i, 0) AS BIGINT) AS arrow_places, round(coalesce(CAST(aa.b AS DOUBLE), 0), 1) AS bearings, round(coalesce(CAST(aa.v AS DOUBLE), 0), 3) AS arrow_values,
coalesce(cc.n, 0) AS n_coarse, CAST(coalesce(cc.i, 0) AS BIGINT) AS coarse_places, round(coalesce(cc.z, 0), 3) AS coarse_total, (SELECT count(DISTINCT key) FROM s) AS n_scenarios, (SELECT count(*) FROM scenarios) - (SELECT count(DISTINCT key) FROM s) AS n_missing, round((SELECT x0 - (x1 - x0) / 38 FROM b), 6) AS west, round((SELECT y1 + (y1 - y0) / 38 FROM b), 6) AS north
FROM s JOIN scenarios e ON e.key = s.key LEFT JOIN aa ON aa.key = s.key AND aa.layer = s.layer LEFT JOIN cc ON cc.key = s.key AND cc.layer = s.layer""")
def export_layers(spark, d):
    """All layers of all scenarios written and read back: grids of 20 x 20 points, arrows on 9 x 9, values for reading on 7 x 7."""
    mesh, flow, key = table(spark, d, "mesh"), table(spark, d, "flow"), ["key", "layer"]
    targets = fields.target_grid(mesh, 9)
    rows = fields.arrows(flow.withColumns({"ue": F.col("u"), "vn": F.col("v")}), key, targets, fields.linear_weights(mesh, 9), fields.nearest_weights(targets, mesh, None, COS))
    path = shared_folder(spark, "export")
    sinks.export_layers(_layers(spark, d).withColumn("source", F.lit("flow")), rows, mesh, table(spark, d, "scenarios"), ["wind_speed", "wind_dir", "wlvl", "salinity"], path, N, N, 9, 7)
    about, docs, index = sinks.read_export(spark, path)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    places = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    frame, zone = about["frames"][0], docs.join(index, "key")
    return zone.select("key", "layer", "wind_speed", "salinity", r6("zmin"), r6("zmax"), "n_valid", "vmin", r6("vmax"), F.size("i").cast("long").alias("n_arrows"), places("i").alias("arrow_places"), F.round(total("b"), 1).alias("bearings"), F.round(total("v"), 3).alias("arrow_values"),
        F.size("ci").cast("long").alias("n_coarse"), places("ci").alias("coarse_places"), F.round(total("cz"), 3).alias("coarse_total"), F.lit(about["n_scenarios"]).alias("n_scenarios"), F.lit(about["n_missing"]).alias("n_missing"), F.round(F.lit(frame["west"]), 6).alias("west"), F.round(F.lit(frame["north"]), 6).alias("north"))


def _ramp_sql(k: int) -> str:
    """SQL: one channel of the fixed colours at t, straight between neighbours."""
    parts = [f"WHEN t <= {b[0]!r}e0 THEN {a[k]} + ({b[k]} - {a[k]}) * (t - {a[0]!r}e0) / {b[0] - a[0]!r}e0" for a, b in zip(fields.RAMP, fields.RAMP[1:], strict=False)]
    return f"CAST(floor(CASE {' '.join(parts)} ELSE {fields.RAMP[-1][k]} END + 1e-9) AS INT)"


@query(f"SELECT key, layer, cell, CAST({_ramp_sql(1)} AS INT) AS red, {_ramp_sql(2)} AS green, {_ramp_sql(3)} AS blue, CASE WHEN gap THEN 0 ELSE 205 END AS alpha FROM (SELECT key, layer, cell, cell % 11 = 0 AS gap, greatest(least(CASE WHEN cell % 11 = 0 THEN 0e0 ELSE value / 4e0 - 0.1e0 END, 1e0), 0e0) AS t FROM flow)")
def colour_ramp(spark, d):
    """All channels, with values under and over the ramp, and without a value."""
    rgb = fields.ramp(F.when(F.col("cell") % 11 != 0, F.col("value") / 4.0 - 0.1))
    return table(spark, d, "flow").select("key", "layer", "cell", *(rgb[c].alias(c) for c in ("red", "green", "blue", "alpha")))


@query("SELECT key, layer, count(*) AS n, round(max(abs(u - round_even(u / 1e-4, 0) * 1e-4)), 9) <= 3e-4 AS good, round(sum(round_even(u / 1e-4, 0) * 1e-4), 4) AS total FROM flow GROUP BY key, layer")
def unpack_roundtrip(spark, d):
    rows = table(spark, d, "flow")
    store = shared_folder(spark, "store")
    sinks.write_store(rows.select("source", "key", "layer", "cell", "u", "v"), table(spark, d, "mesh"), store, {"u": 1e-4, "v": 1e-4})
    held = sinks.read_store(spark, store).select("source", F.col("key").cast("long").alias("key"), "layer", "cell", F.col("u").alias("back"))
    both = rows.join(held, ["source", "key", "layer", "cell"])
    return both.groupBy("key", "layer").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("u") - F.col("back"))) <= 3e-4).alias("good"), F.round(F.sum("back"), 4).alias("total"))


@query("""WITH s AS (SELECT unnest([1, 2, 3, 4]) AS step), r AS (SELECT s.step, f.key, f.layer, f.cell, CASE s.step WHEN 3 THEN round_even(f.u / 1e-2, 0) * 1e-2 ELSE round_even(CASE WHEN s.step = 4 AND f.key % 3 = 0 THEN f.u + 1 ELSE f.u END / 1e-4, 0) * 1e-4 END AS u FROM s CROSS JOIN flow f WHERE s.step > 1 OR f.layer < 2)
SELECT step, key, layer, count(*) AS n, CAST(sum(cell) AS BIGINT) AS cells, round(sum(u), 4) AS total FROM r GROUP BY ALL""")
def store_resumed(spark, d):
    """One store written four times: two layers (half of the keys first), all layers, another scale, and the first scale
    again with a third of the keys replaced. What is read after each."""
    rows, mesh = table(spark, d, "flow").select("source", "key", "layer", "cell", "u"), table(spark, d, "mesh")
    store, out = shared_folder(spark, "store"), []

    def written(step: int, part: DataFrame, scale: float, replace: bool = False) -> None:
        version = sinks.write_store(part, mesh, store, {"u": scale}, replace)
        out.append(sinks.read_store(spark, store, version=version).select(F.lit(step).alias("step"), F.col("key").cast("long").alias("key"), "layer", "cell", "u"))

    few = rows.where("layer < 2")
    sinks.write_store(few.where("key % 2 = 0"), mesh, store, {"u": 1e-4})
    written(1, few, 1e-4)
    written(3, rows, 1e-2)
    first = sinks.write_store(rows, mesh, store, {"u": 1e-4})
    kept = sinks.read_store(spark, store, version=first).select(F.lit(2).alias("step"), F.col("key").cast("long").alias("key"), "layer", "cell", "u")
    folder = shared_folder(spark, "read")
    kept.write.parquet(folder)  # read before its keys are replaced
    written(4, rows.where("key % 3 = 0").withColumn("u", F.col("u") + 1), 1e-4, replace=True)
    whole = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(spark.read.schema(kept.schema).parquet(folder))
    return whole.groupBy("step", "key", "layer").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"), F.round(F.sum("u"), 4).alias("total"))


# Streams

def _deliveries(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """A stream over parts that arrive one after the other, each as files in the shared folder."""
    folder = shared_folder(spark, "stream")
    for part in parts:
        part.repartition(1).write.mode("append").parquet(folder)  # one file for each delivery, so that a batch is one
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _thirds(spark: SparkSession, rows: DataFrame, by: str) -> DataFrame:
    """All rows as three deliveries in the order of ``by``, each a third of its range."""
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    part = F.least(F.floor((F.col(by) - lo) * 3 / F.lit(max(1, hi - lo))), F.lit(2))
    return _deliveries(spark, *(rows.where(part == i) for i in range(3)))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY station, t, src ORDER BY id DESC) AS n FROM obs) SELECT station, id, t, air_temp, src FROM r WHERE n = 1 AND t >= (SELECT max(t) FROM obs) - 168 * 3600")
def stream_archive(spark, d):
    rows = table(spark, d, "obs").select("station", "id", "t", "air_temp", "src")
    return archive.stream_archive(_thirds(spark, rows, "id"), shared_folder(spark, "archive"), shared_folder(spark, "checkpoint"))


@query("""WITH s AS (SELECT day, granule, sum(CASE WHEN m THEN coalesce(water_area, 0) ELSE 0 END) AS a, sum(CASE WHEN m THEN coalesce(uncert * uncert, 0) ELSE 0 END) AS u, count(uncert) AS k, count_if(m) AS n, count(water_frac) AS c FROM (SELECT *, coalesce(water_frac BETWEEN 0.1 AND 0.99 AND qual <= 1, false) AS m FROM cells) GROUP BY day, granule)
SELECT day, round(sum(a) / 1e6, 3) AS area_km2, round(sqrt(sum(CASE WHEN k > 0 THEN u END)) / 1e6, 6) AS uncert_km2, count(*) AS n_scenes, CAST(sum(n) AS BIGINT) AS n_cells, round(CAST(sum(c) AS DOUBLE) / 576, 6) AS coverage, round(CAST(sum(c) AS DOUBLE) / 576, 6) < 0.9 AS partial FROM s WHERE c > 0 OR n > 0 GROUP BY day""")
def stream_daily_area(spark, d):
    """Every scene is cut in three, and a part of the cells comes first with other values, which are corrected later."""
    cells = table(spark, d, "cells").withColumn("mask", raster.water_mask(F.col("water_frac"), F.col("qual")))
    cells, third = _stored(spark, cells), (F.col("iy") * 5 + F.col("ix")) % 3
    wrong = cells.where((third == 1) & (F.col("ix") % 4 == 0)).withColumn("water_area", F.col("water_area") + 7).withColumn("mask", ~F.col("mask"))
    stream = _deliveries(spark, cells.where(third == 0).unionByName(wrong), cells.where(third == 1), cells.where(third == 2))
    return archive.stream_daily_area(stream, shared_folder(spark, "checkpoint"), shared_folder(spark, "areas"), 576)


@query("""WITH k AS (SELECT station, t, CASE WHEN wind_spd_kmh <= 0 OR wind_dir_deg IS NULL THEN -1 ELSE CAST(floor(wind_dir_deg / 22.5 + 0.5) AS INT) % 16 END AS sector FROM obs WHERE wind_spd_kmh IS NOT NULL)
SELECT station, CAST(floor(t / 86400e0) AS BIGINT) * 86400 - o.i * 86400 AS start, sector, count(*) AS n FROM k CROSS JOIN (SELECT unnest(range(7)) AS i) o GROUP BY ALL""")
def stream_rose(spark, d):
    rows = table(spark, d, "obs").select("station", "id", F.timestamp_seconds("t").alias("ts"), "wind_spd_kmh", "wind_dir_deg")
    rose = archive.stream_rose(_thirds(spark, rows, "id"), shared_folder(spark, "checkpoint"), shared_folder(spark, "roses"), late="3650 days")
    return rose.groupBy("station", "start", "sector").agg(F.sum("n").alias("n"))


@query("""WITH p AS (SELECT station, CAST(floor(t / 43200e0) AS BIGINT) % 2 AS phase, t, count(*) AS c FROM obs GROUP BY ALL), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY station, phase ORDER BY t) < 2700 THEN 0 ELSE 1 END AS b FROM p), s AS (SELECT *, sum(b) OVER (PARTITION BY station, phase ORDER BY t) AS k FROM g)
SELECT station, phase, min(t) AS start, max(t) + 2700 AS end, CAST(sum(c) AS BIGINT) AS n FROM s GROUP BY station, phase, k HAVING max(t) + 2700 <= (SELECT max(t) FROM obs) - 3600""")
def stream_sessions(spark, d):
    """Half-days as phases; sessions that are not an hour past their end are still open when the stream ends."""
    rows = table(spark, d, "obs").select("station", "t", F.timestamp_seconds("t").alias("ts"), (F.floor(F.col("t") / 43200) % 2).alias("phase"))
    return archive.stream_sessions(_thirds(spark, rows, "t"), shared_folder(spark, "checkpoint"), shared_folder(spark, "sessions"), late="1 hour")


@query("""WITH o AS (SELECT station || '-' || CAST(id % 97 AS VARCHAR) AS station, id, t, CASE WHEN id % 13 <> 0 THEN air_temp END AS air_temp FROM obs), k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY t DESC, id DESC) AS n FROM o WHERE air_temp IS NOT NULL)
SELECT k.station, k.t, k.air_temp, k.t < (SELECT max(o.t) FROM o WHERE o.station = k.station) OR k.t + 86407 < (SELECT max(t) FROM o) - 3600 AS stale FROM k WHERE n = 1""")
def stream_last_known(spark, d):
    """97 sensors at each station, each thirteenth reading failed; a value is stale after a day."""
    rows = table(spark, d, "obs").select(F.concat("station", F.lit("-"), (F.col("id") % 97).cast("string")).alias("station"), "id", "t", F.timestamp_seconds("t").alias("ts"), F.when(F.col("id") % 13 != 0, F.col("air_temp")).alias("air_temp"))
    return archive.last_known(_thirds(spark, rows, "t"), shared_folder(spark, "checkpoint"), shared_folder(spark, "known"), patience=86407)


@query("""WITH f AS (SELECT file, t, wse, site, CASE WHEN file % 7 = 0 THEN file % 1000 + 5 ELSE file % 1000 END AS size FROM levels WHERE wse IS NOT NULL)
SELECT r.reach, site, file, size, round(wse + r.reach + size / 1000e0, 6) AS wse FROM f CROSS JOIN (SELECT unnest([0, 2]) AS reach) r""")
def extract_changed(spark, d):
    """Three deliveries: all files, then those with a changed size, and an old listing that comes late; for two fingerprints."""
    levels = table(spark, d, "levels").withColumn("file", F.col("file").cast("string"))
    listed = levels.select("file", F.expr("CAST(file AS BIGINT) % 1000").alias("size"), F.lit(1).cast("long").alias("modified")).distinct()
    changed = listed.where("CAST(file AS BIGINT) % 7 = 0").select("file", (F.col("size") + 5).alias("size"), F.lit(2).cast("long").alias("modified"))
    late = listed.where("CAST(file AS BIGINT) % 14 = 0").select("file", (F.col("size") + 9).alias("size"), F.lit(0).cast("long").alias("modified"))
    stream, store, out = _deliveries(spark, listed, changed, late), shared_folder(spark, "extractions"), []
    for reach in (0, 2):
        print_of = parse.fingerprint(F.col("lon"), F.col("lat"), F.lit(reach), F.array(F.lit(1), F.lit(0)))
        marks = table(spark, d, "places").agg(F.sum(F.xxhash64(print_of).cast("decimal(38,0)"))).first()[0]  # of all sites, in any order

        def extract(files: DataFrame, reach: int = reach) -> DataFrame:
            return files.join(levels, "file").where("wse IS NOT NULL").select("site", "file", "size", (F.col("wse") + reach + F.col("size") / 1000).alias("wse"))

        out.append(archive.stream_extract(stream, extract, store, f"sites={marks}").withColumn("reach", F.lit(reach)))
    return out[0].unionByName(out[1]).select("reach", "site", F.col("file").cast("long").alias("file"), "size", r6("wse"))
