"""Domain tables as projections of the driver's tables, one text for Spark and DuckDB.

``EPOCH(x)`` stands for the seconds of a timestamp, ``{grid}`` for the numbers 0 to 23, ``{table}`` for a
table; each engine fills them in its own way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "orders", "lineitem", "supplier", "part", "customer")
BINDINGS = {
    "obs": """SELECT event_type AS station, event_id AS id, CAST(floor(EPOCH(ts) / 1800) AS BIGINT) * 1800 AS t,
        CASE WHEN event_id % 50 = 7 THEN NULL WHEN event_id % 37 = 5 THEN 0e0 ELSE value / 5e0 END AS wind_spd_kmh,
        CASE WHEN event_id % 41 = 3 THEN NULL ELSE (event_id % 16) * 22.5e0 END AS wind_dir_deg,
        15e0 + user_id % 10 AS air_temp, CASE WHEN event_id % 20 = 0 THEN 'demo' ELSE 'bom' END AS src, event_id % 2 AS fresh FROM {events}""",
    "levels": """SELECT o_custkey % 2 AS site, o_orderkey AS file, 1700000000 + (o_orderkey % 720) * 3600 AS t,
        -14e0 + (CAST(floor(o_totalprice) AS BIGINT) % 200) / 100e0 + CASE WHEN o_orderkey % 97 = 0 THEN 8e0 WHEN o_orderkey % 89 = 0 THEN -6e0 ELSE 0e0 END AS wse FROM {orders}""",
    "granules": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 29 = 0 THEN '._' ELSE '' END || 'L2_Raster_' || CASE WHEN o_orderkey % 3 = 0 THEN '250m' ELSE '100m' END || '_020_'
        || CASE WHEN o_orderkey % 2 = 0 THEN '394' ELSE '435' END || '_' || CASE WHEN o_orderkey % 5 < 2 THEN '102F' ELSE '103F' END || '_20250' || CAST(1 + o_orderkey % 9 AS VARCHAR(9)) || '1' || CAST(o_orderkey % 9 AS VARCHAR(9)) || 'T17020' || CAST(o_orderkey % 10 AS VARCHAR(9)) || '_01.nc' AS name,
        o_orderkey % 1000 + 1 AS size, 52 + o_orderkey % 4 AS utm_zone, o_custkey % 3 AS cached FROM {orders}""",
    "cells": """SELECT g.granule, g.granule % 7 AS day, y.v AS iy, x.v AS ix, 137e0 + x.v * 0.01e0 AS lon, -28.8e0 - y.v * 0.01e0 AS lat, s.water_frac, coalesce(s.qual, 0) AS qual, s.water_area, s.uncert, s.wse
        FROM (SELECT DISTINCT CAST(floor(l_orderkey / 300e0) AS BIGINT) AS granule FROM {lineitem}) g CROSS JOIN {grid} y CROSS JOIN {grid} x LEFT JOIN (
        SELECT granule, iy, ix, CASE WHEN (iy - 12) * (iy - 12) + (ix - 12) * (ix - 12) <= 90 THEN 0.1e0 + l_discount * 9e0 WHEN l_linenumber = 1 THEN l_discount * 10e0 ELSE 0e0 END AS water_frac,
        CASE WHEN l_linenumber = 7 THEN 2 WHEN l_linenumber >= 5 THEN 1 ELSE 0 END AS qual, l_quantity * 100e0 AS water_area, l_tax * 100e0 AS uncert, -16e0 + CAST(floor(l_extendedprice) AS BIGINT) % 10 AS wse FROM (
        SELECT *, row_number() OVER (PARTITION BY granule, iy, ix ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM (
        SELECT *, CAST(floor(l_orderkey / 300e0) AS BIGINT) AS granule, l_partkey % 24 AS iy, (l_suppkey * 7 + l_linenumber * 5 + l_orderkey) % 24 AS ix FROM {lineitem}) a) b WHERE rn = 1) s
        ON g.granule = s.granule AND y.v = s.iy AND x.v = s.ix""",
    "boundary": """SELECT 137e0 + x.v * 0.01e0 AS lon, -28.8e0 - y.v * 0.01e0 AS lat FROM {grid} y CROSS JOIN {grid} x
        WHERE (y.v - 12) * (y.v - 12) + (x.v - 12) * (x.v - 12) <= 90 AND y.v % 2 = 0 AND x.v % 2 = 0""",
    "sites": """SELECT s_suppkey AS site, 8 + s_suppkey % 9 AS cy, 8 + (s_suppkey * 5) % 9 AS cx FROM {supplier}""",
    "scenarios": """SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS wind_speed, (p_partkey % 8) * 45e0 AS wind_dir, -14e0 + (p_partkey % 16) * 0.5e0 AS wlvl, (p_partkey % 6) * 50e0 AS salinity FROM {part}""",
    "design": """SELECT CAST(p_size AS DOUBLE) AS wind_speed, (p_partkey % 8) * 45e0 AS wind_dir, -14e0 + ((p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 16) * 0.5e0 AS wlvl, (p_partkey % 6) * 50e0 AS salinity FROM {part}""",
    "targets": """SELECT c_custkey AS target, abs(c_acctbal) / 180e0 AS wind_speed, c_nationkey * 14.4e0 AS wind_dir, -16e0 + (c_custkey % 40) * 0.25e0 AS wlvl, CAST(NULL AS DOUBLE) AS salinity FROM {customer}""",
    "names": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'wave_' ELSE '' END || 'wind-sp' || CAST(p_size AS VARCHAR(9)) || '_0_wind-dir' || CAST((p_partkey % 8) * 45 AS VARCHAR(9)) || '_0_wlvl-' || CAST(7 + p_partkey % 7 AS VARCHAR(9)) || '_5' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '_sal' || CAST((p_partkey % 6) * 50 AS VARCHAR(9)) || '_0' END || '.nc' AS name FROM {part}""",
    "runs": """SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'wave' ELSE 'flow' END AS source, CASE WHEN p_partkey % 31 = 0 THEN 6 ELSE 24 END AS n_time, CASE WHEN p_partkey % 37 = 0 THEN 1 ELSE 10 END AS n_layer, p_partkey % 41 = 0 AS no_dir FROM {part}""",
    "fields": """SELECT l_orderkey AS key, l_linenumber AS layer, l_partkey AS cell, l_discount * 10e0 - 0.5e0 AS u, l_tax * 10e0 - 0.4e0 AS v, (l_partkey % 360) * 1e0 AS turn, l_extendedprice AS big FROM {lineitem}""",
    "places": """SELECT s_suppkey AS site, 137e0 + (s_suppkey % 23) * 0.01e0 + 0.003e0 AS lon, -28.8e0 - (s_suppkey % 19) * 0.01e0 - 0.002e0 AS lat FROM {supplier}""",
    "terrain": """SELECT p_partkey % 40 AS r, CAST(floor(p_partkey / 40e0) AS BIGINT) % 40 AS c, max(p_size) * 1e0 AS z FROM {part} GROUP BY 1, 2""",
    "spots": """SELECT s_suppkey AS site, 1000e0 + (s_suppkey % 45) * 10e0 + 3e0 AS x, 5000e0 - (s_suppkey % 43) * 10e0 - 4e0 AS y FROM {supplier}""",
    "feed": """SELECT event_type AS station, event_id AS id, replace(replace('<"observations":<"data":[<"aifstime_utc":"2024010' || CAST(1 + event_id % 9 AS VARCHAR(9)) || '123000","air_temp":' || CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_id % 7 = 1 THEN '"-"' ELSE CAST(10 + event_id % 20 AS VARCHAR(9)) END
        || ',"wind_dir":"' || CASE event_id % 5 WHEN 0 THEN 'CALM' WHEN 1 THEN 'N' WHEN 2 THEN 'SSW' WHEN 3 THEN 'WNW' ELSE 'E' END || '","wind_spd_kmh":' || CAST(event_id % 40 AS VARCHAR(9)) || ',"press_qnh":' || CASE WHEN event_id % 3 = 0 THEN '0' ELSE '1010.5' END
        || ',"press":1005>,<"aifstime_utc":"","air_temp":5>,<"aifstime_utc":"20240101T110000","air_temp":"7.5">]>>', '<', chr(123)), '>', chr(125)) AS value FROM {events}""",
    "isos": """SELECT event_id AS id, '2024-03-1' || CAST(event_id % 9 AS VARCHAR(9)) || 'T1' || CAST(event_id % 10 AS VARCHAR(9)) || ':30:00' || CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN ' 02:00' WHEN 3 THEN '' ELSE 'x' END AS iso FROM {events}""",
    "paths": """SELECT p_partkey AS id, CASE WHEN p_partkey % 23 = 0 THEN '__MACOSX/' WHEN p_partkey % 19 = 0 THEN 'a/.hidden/' WHEN p_partkey % 3 = 0 THEN 'wave_out/x/' ELSE 'runs/' END || CASE WHEN p_partkey % 29 = 0 THEN '._' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'wave_' ELSE '' END
        || 'wind-sp' || CAST(p_size AS VARCHAR(9)) || '_0_wind-dir' || CAST((p_partkey % 8) * 45 AS VARCHAR(9)) || '_0_wlvl-' || CAST(7 + p_partkey % 7 AS VARCHAR(9)) || '_5' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '_sal' || CAST((p_partkey % 6) * 50 AS VARCHAR(9)) END || '.nc' AS path,
        CASE WHEN p_partkey % 13 = 0 THEN 'XXXX' ELSE 'CDF' || chr(1) END AS head FROM {part}""",
    "remote": """SELECT l_orderkey AS granule, 'g' || CAST(l_partkey AS VARCHAR(9)) || CASE WHEN l_linenumber = 4 THEN '.md5' ELSE '.nc' END AS name FROM {lineitem}""",
    "locals": """SELECT DISTINCT 'g' || CAST(l_partkey AS VARCHAR(9)) || '.nc' AS name FROM {lineitem} WHERE l_partkey % 4 <> 0""",
    "model_vars": """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'S1' WHEN 1 THEN 'U1' WHEN 2 THEN 'XZ' WHEN 3 THEN 'hsign' WHEN 4 THEN 'R1' ELSE 'foo' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'water level at ' || CAST(p_size AS VARCHAR(9)) ELSE '' END AS long_name,
        CASE p_partkey % 5 WHEN 0 THEN 'time,M,N' WHEN 1 THEN 'kmaxout_restr,M,N' WHEN 2 THEN 'M,N' WHEN 3 THEN 'TIME,LSTSCI,N' ELSE 'M' END AS dims, CAST(floor(p_partkey / 10e0) AS BIGINT) AS file FROM {part}""",
    "coords": """SELECT l_orderkey AS id, l_linenumber AS n, CAST(floor(l_orderkey / 300e0) AS BIGINT) AS grid, l_partkey AS p, l_suppkey AS s, CASE WHEN l_linenumber = 1 THEN 0e0 WHEN l_linenumber = 2 THEN -999.999e0 WHEN l_linenumber = 3 THEN 1e31 ELSE l_partkey * CASE WHEN floor(l_orderkey / 300e0) % 2 = 0 THEN 100e0 ELSE 0.01e0 END END AS x,
        CASE WHEN l_linenumber = 5 THEN 999.999e0 ELSE l_suppkey * 1e0 END AS y FROM {lineitem}""",
    "mesh": """SELECT 'flow' AS source, y.v * 24 + x.v AS cell, y.v AS iy, x.v AS ix, 137e0 + (x.v * 0.94e0 - y.v * 0.34e0) * 0.01e0 AS lon, -29e0 + (x.v * 0.34e0 + y.v * 0.94e0) * 0.01e0 AS lat, (x.v * 0.94e0 - y.v * 0.34e0) * 1000e0 AS x, (x.v * 0.34e0 + y.v * 0.94e0) * 1000e0 AS y FROM {grid} y CROSS JOIN {grid} x""",
    "flow": """SELECT 'flow' AS source, CAST(floor(l_orderkey / 3000e0) AS BIGINT) AS key, l_linenumber % 3 AS layer, (l_partkey % 24) * 24 + (l_suppkey * 7 + l_linenumber * 5 + l_orderkey) % 24 AS cell, max(l_discount) * 10e0 - 0.5e0 AS u, max(l_tax) * 10e0 - 0.4e0 AS v, max(l_quantity) * 0.1e0 AS value, min(l_quantity) > 3 AS wet FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "model_cells": """SELECT 'flow' AS source, CAST(floor(l_orderkey / 6000e0) AS BIGINT) AS key, CASE WHEN l_partkey % 2 = 0 THEN 'S1' ELSE 'U1' END AS name, l_linenumber % 4 AS time, l_quantity % 3 AS layer, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_suppkey % 2 END AS constituent,
        (l_partkey % 24) * 24 + (l_suppkey * 7 + l_orderkey) % 24 AS cell, min(l_discount) * 10e0 - 0.3e0 AS value FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "stops": """SELECT s_suppkey AS id, 136.95e0 + (s_suppkey % 31) * 0.01e0 AS lon, -29.05e0 + (s_suppkey % 37) * 0.01e0 AS lat FROM {supplier}""",
    "asked": """SELECT CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE 1700000000 + (o_orderkey % 1500) * 1800 + 600 END AS moment FROM {orders}""",
    "points": """SELECT c_custkey AS id, 136e0 + (c_custkey % 400) * 0.01e0 AS lon, -29.5e0 + (c_custkey % 37) * 0.05e0 AS lat, CASE WHEN c_custkey % 400 < 200 THEN 53 ELSE 54 END AS zone FROM {customer}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table ``name`` over the driver's Parquet tables."""
    text = re.sub(r"EPOCH\((\w+)\)", r"unix_seconds(CAST(\1 AS TIMESTAMP))", BINDINGS[name]).replace("{grid}", "(SELECT explode(sequence(0L, 23L)) AS v)")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def with_tables(sql: str) -> str:
    """DuckDB SQL: ``sql`` with each domain table that it names as a common table expression."""
    ctes = []
    for name, text in BINDINGS.items():
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            text = re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text).replace("{grid}", "(SELECT unnest(range(24)) AS v)")
            ctes.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return "WITH " + ",\n".join(ctes) + "\n" + re.sub(r"^\s*WITH\b", ",", sql.strip())
