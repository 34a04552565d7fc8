"""Readers, writers, streams and fields against plain loops and small exact cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geocadence.functions import geo, parse
from geocadence.operators import catalogue, extraction, fields, raster, scenarios, series, temporal
from geocadence.plans import catalog, more
from geocadence.plans.catalog import table
from geocadence.sources import feeds, sinks
from geocadence.sources.shared import shared_folder
from geocadence.streaming import archive

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_texts(spark):
    lit = F.lit
    assert one(spark, *(parse.number(lit(x)) for x in ("12.5", "-", "", "x", "NaN"))) == (12.5, None, None, None, None)
    assert one(spark, *(parse.compass_degrees(lit(x)) for x in ("N", "NNW", "CALM"))) == (0.0, 337.5, None)
    assert one(spark, parse.first_pressure(lit(0.0), lit(1005.0)), parse.first_pressure(lit(1010.0), lit(5.0)), parse.first_pressure(lit(None).cast("double"), lit(0.0))) == (1005.0, 1010.0, None)
    assert one(spark, *(F.unix_seconds(parse.instant(lit(x))) for x in ("2024-01-01T10:00:00Z", "2024-01-01 10:00", "2024-01-01T10:00:00 02:00", "soon"))) == (1704103200, 1704103200, 1704096000, None)
    assert one(spark, *(parse.is_junk(lit(x)) for x in ("a/b.nc", "a/._b.nc", ".x/b.nc", "__MACOSX/b.nc", "a.b/c.nc"))) == (False, True, True, True, False)
    assert one(spark, parse.is_netcdf(lit(b"CDF\x01rest")), parse.is_netcdf(lit(b"\x89HDF")), parse.is_netcdf(lit(b"no"))) == (True, True, False)
    assert one(spark, parse.name_number(lit(-7.0)), parse.slug(lit(" Lake Eyre (N) ")), parse.csv_cell(lit('a"b')), parse.csv_cell(lit(None).cast("string"))) == ("-7_0", "lake-eyre-n", '"a""b"', "")
    assert one(spark, *(parse.dim_role(lit(x)) for x in ("time", "KMAXOUT_RESTR", "LSTSCI", "M"))) == ("time", "layer", "constituent", "other")
    assert one(spark, parse.field_rank(lit("Hsig"), lit(None).cast("string")), parse.field_rank(lit("q"), lit("Water level")), parse.field_rank(lit("q"), lit("x"))) == (1, 22, 99)


def test_zone_and_bearing(spark):
    for lon, lat in ((137.3, -28.5), (132.01, -25.0), (143.99, -35.0)):
        x, y = geo.utm_forward(F.lit(lon), F.lit(lat), geo.utm_zone(F.lit(lon)))
        zone, off = one(spark, *geo.detect_zone(x, y, F.lit(lon), F.lit(lat)))
        assert zone == int((lon + 180) / 6) + 1 and off < 1e-6
        back = geo.utm_inverse(x, y, geo.utm_zone(F.lit(lon)))
        assert np.allclose(one(spark, *back), (lon, lat), atol=1e-8)
    x, y = geo.utm_forward(F.lit(137.3), F.lit(-28.5), F.lit(53))
    assert one(spark, geo.detect_zone(x, y, F.lit(145.6))[0]) == (None,)
    assert one(spark, geo.bearing(F.lit(1.0), F.lit(0.0)), geo.bearing(F.lit(-1.0), F.lit(0.0))) == (90.0, 270.0)


def test_names(spark):
    names = ["wave_wind-sp1_0_wind-dir0_0_wlvl-7_0_sal250.nc", "wind-sp1.5_wind-dir90_wlvl-7_5_sal0.nc", "wind-sp1_0_wlvl-7_0_sal0.nc"]
    df = spark.createDataFrame([(n, f"WAVE run/a/{n}") for n in names], "name string, path string")
    rows = {r.name: r for r in scenarios.parse_name(df, parents="path").collect()}
    assert tuple(rows[names[0]])[2:] == (1.0, 0.0, -7.0, 250.0, "wave", names[0][5:-3])
    assert tuple(rows[names[1]])[2:7] == (1.5, 90.0, -7.5, 0.0, "wave") and rows[names[2]].wind_speed is None
    assert {r.name: r.wlvl for r in scenarios.parse_name(df, sign="positive").collect()}[names[1]] == 7.5


def test_files_and_rasters(spark, tmp_path):
    for name, head in (("a/x_100m.nc", b"CDF\x01..."), ("a/._x.nc", b"CDF\x01"), ("__MACOSX/y.nc", b"CDF\x01"), ("z_250m.nc", b"HTML"), ("note.txt", b"t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(head)
    files = feeds.list_files(spark, str(tmp_path), head=True)
    assert {(r.path, r.size, bytes(r.head)) for r in files.collect()} == {("a/x_100m.nc", 7, b"CDF\x01"), ("z_250m.nc", 4, b"HTML")}
    assert [r.name for r in feeds.list_files(spark, str(tmp_path), part="250m").collect()] == ["z_250m.nc"]
    assert {r.path: r.good for r in files.select("path", parse.is_netcdf(F.col("head")).alias("good")).collect()} == {"a/x_100m.nc": True, "z_250m.nc": False}

    def decode(path):
        if path.startswith("z"):
            raise ValueError("no raster")
        return pd.DataFrame({"iy": [0, 1], "wse": [1.0, None]})

    rows = feeds.read_rasters(files, decode, "iy int, wse double")
    assert rows.where("error IS NULL").count() == 2 and [(r.path, r.error) for r in feeds.failures(rows).collect()] == [("z_250m.nc", "ValueError: no raster")]
    feeds.fail_if_systematic(rows)
    with pytest.raises(RuntimeError, match="1 of 1"):
        feeds.fail_if_systematic(rows.where("error IS NOT NULL"))


def test_a_source_with_a_decoder(spark, tmp_path):
    class LinesOfFiles(feeds.FileSource):
        @staticmethod
        def decode(path):
            with open(path) as f:
                yield from ((path, line.strip()) for line in f)

    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"{i}\n{i * i}\n")
    spark.dataSource.register(LinesOfFiles)
    rows = spark.read.format("decoded_files").schema("path string, line string").option("paths", "\n".join(map(str, tmp_path.glob("*.txt")))).load()
    assert sorted(r.line for r in rows.collect()) == ["0", "0", "1", "1", "2", "4"]


def test_feeds_designs_and_snapshots(spark, tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "marree.json").write_text('{"observations":\n {"data": [{"aifstime_utc": "20240101120000", "local_date_time_full": "x", "wind_dir": "SW", "air_temp": 3}, {"aifstime_utc": "20240101110000"}]}}')
    (tmp_path / "feeds" / "empty.json").write_text('{"observations": {"data": []}}')
    rows = {r.utc: r for r in feeds.read_feed(spark, str(tmp_path / "feeds")).collect()}
    assert len(rows) == 2 and rows["20240101120000"].latest and rows["20240101120000"].local_time == "x" and rows["20240101120000"].wind_dir_deg == 225.0 and rows["20240101110000"].station == "marree"
    (tmp_path / "design.csv").write_bytes("﻿wind_sp,wind_dir,wlvl,sal\n1.5,90,-7,250\n,,,\n\n2,180,-8,\n".encode())
    assert sorted(map(tuple, feeds.read_design(spark, str(tmp_path / "design.csv")).collect())) == [(1.5, 90.0, -7.0, 250.0), (2.0, 180.0, -8.0, None)]
    assert feeds.read_snapshot(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_csv_and_payloads_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, "b,c", None), (1, 1, 'q"', 1.5)], "t long, file long, note string, wse double")
    lines = sinks.csv_lines(df, {"t": F.col("t"), "note": F.col("note"), "wse": F.col("wse")}, ["made up"], ["t", "file"])
    sinks.write_csv_lines(lines, str(tmp_path / "csv"))
    back = spark.read.option("comment", "#").option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert [tuple(r) for r in back.collect()] == [("1", 'q"', "1.5"), ("2", "b,c", None)]
    payload = sinks.series_payload(df.withColumn("site", F.lit("s")).withColumn("wse", F.when(F.col("t") == 2, F.lit(float("nan"))).otherwise(F.col("wse"))))
    sinks.write_json(payload, str(tmp_path / "json"))
    text = spark.read.text(str(tmp_path / "json")).first().value
    assert "NaN" not in text and '"n":2' in text and '"max":1.5' in text
    sinks.write_by_site(df.withColumn("site", F.lit("s")), str(tmp_path / "sites"))
    assert (tmp_path / "sites" / "site=s").is_dir()
    sinks.write_suspects(spark.createDataFrame([("k", ["a", "b"])], "key string, problems array<string>"), str(tmp_path / "bad"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bad")).first().problems == "a ; b"
    days = spark.createDataFrame([(2, 5.0), (1, float("inf"))], "day long, area_km2 double")
    assert sinks.area_payload(days).first().series[0].area_km2 is None
    sinks.write_layers(spark.createDataFrame([("k", 1, [1], [2.0], [3.0])], "key string, layer int, i array<int>, b array<double>, v array<double>"), days, str(tmp_path / "layers"))
    assert spark.read.json(str(tmp_path / "layers" / "arrows")).first().layer == 1


def test_store(spark, tmp_path):
    mesh = spark.range(4).selectExpr("'flow' AS source", "id AS cell", "id * 0.1 AS lon", "0.0 AS lat")
    fs = mesh.crossJoin(spark.createDataFrame([("a", 3), ("a", 7)], "key string, layer int")).selectExpr("source", "key", "layer", "cell", "CASE WHEN cell = 3 THEN NULL ELSE lon * layer END AS ue")
    path, scales = str(tmp_path / "store"), {"ue": 1e-3}
    sinks.write_store(fs, mesh, path, scales)
    dry = fs.withColumn("key", F.lit("dry")).withColumn("ue", F.lit(None).cast("double"))
    version = sinks.write_store(fs.unionByName(dry), mesh, path, scales)  # "a" is there already
    assert spark.read.parquet(f"{path}/version={version}/fields").groupBy("key").count().orderBy("key").collect() == [("a", 8), ("dry", 8)]
    assert {r.layer for r in sinks.read_store(spark, path, "flow", "a", -1).collect()} == {7} == {r.layer for r in sinks.read_store(spark, path, "flow", "a", 99).collect()}
    check = sinks.roundtrip_errors(fs, sinks.read_store(spark, path, "flow", "a"), scales).first()
    assert check.good and check.worst <= 5.1e-4
    with pytest.raises(ValueError, match="dry"):
        sinks.read_store(spark, path, "flow", "dry")
    assert sinks.clip_counts(fs.withColumn("ue", F.col("ue") * 1e6), scales).first().clipped == 4


def test_store_written_again(spark, tmp_path):
    mesh = spark.range(2).selectExpr("'flow' AS source", "id AS cell", "id * 0.1 AS lon", "0.0 AS lat")
    fs = lambda key, layers, x=0.5: mesh.select("source", F.lit(key).alias("key"), F.explode(F.array(*map(F.lit, layers))).alias("layer"), "cell", F.lit(x).alias("ue"))
    path, read = str(tmp_path / "store"), lambda **how: sorted((r.key, r.layer, r.ue) for r in sinks.read_store(spark, path, **how).where("cell = 0").collect())
    with pytest.raises(ValueError, match="no such store"):
        read()
    first = sinks.write_store(fs("a", [0, 1]), mesh, path, {"ue": 0.1})
    assert sinks.write_store(fs("b", [0, 1]), mesh, path, {"ue": 0.1}) == first
    assert read() == [("a", 0, 0.5), ("a", 1, 0.5), ("b", 0, 0.5), ("b", 1, 0.5)]
    assert sinks.write_store(fs("a", [0, 1], 0.9), mesh, path, {"ue": 0.1}) == first and read()[0] == ("a", 0, 0.5)  # finished
    sinks.write_store(fs("a", [0, 1], 0.9), mesh, path, {"ue": 0.1}, replace=True)
    assert [round(r[2], 6) for r in read()] == [0.9, 0.9, 0.5, 0.5]
    second = sinks.write_store(fs("a", [0, 1, 2]), mesh, path, {"ue": 0.1})  # more layers: a version of its own, whole
    assert second != first and read() == [("a", 0, 0.5), ("a", 1, 0.5), ("a", 2, 0.5)]
    third = sinks.write_store(fs("a", [0, 1]), mesh, path, {"ue": 0.01})  # another scale
    assert len({first, second, third}) == 3 and read() == [("a", 0, 0.5), ("a", 1, 0.5)] and len(read(version=first)) == 4
    shifted = mesh.withColumn("lon", F.col("lon") + 1)
    assert sinks.write_store(fs("a", [0, 1]), shifted, path, {"ue": 0.01}) not in (first, second, third)
    # A write that broke off before a key was noted: the key is not read, and replaced as a whole.
    place = f"{path}/version={first}"
    sinks.packed_fields(fs("c", [0]), {"ue": 0.1}).write.mode("append").partitionBy("source", "key").parquet(f"{place}/fields")
    assert len(read(version=first)) == 4
    assert sinks.write_store(fs("c", [0, 1], 0.3), mesh, path, {"ue": 0.1}) == first
    assert [(k, n, round(x, 6)) for k, n, x in read()][-2:] == [("c", 0, 0.3), ("c", 1, 0.3)]


def mesh_of(spark, n=12, m=15):
    """A turned and bent grid, and its coordinates."""
    iy, ix = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    lon, lat = 137 + (0.9 * ix - 0.4 * iy) * 0.01 + 0.0002 * iy**2, -29 + (0.4 * ix + 0.9 * iy) * 0.01 + 0.0001 * ix**2
    rows = [("flow", int(i * m + j), int(i), int(j), float(lon[i, j]), float(lat[i, j])) for i in range(n) for j in range(m)]
    return spark.createDataFrame(rows, "source string, cell long, iy int, ix int, lon double, lat double"), lon, lat


def test_resampling_reproduces_a_plane(spark):
    mesh, lon, lat = mesh_of(spark)
    plane = 3 * (lon - 137) - 2 * (lat + 29) + 0.5
    rows = [("k", "flow", int(i), float(plane.flat[i]), i % 15 > 2) for i in range(plane.size)]
    fs = spark.createDataFrame(rows, "key string, source string, cell long, value double, wet boolean")
    targets = fields.target_grid(mesh, 16)
    near = fields.nearest_weights(targets, mesh, 0.02, 0.9).cache()
    grid = {(r.gy, r.gx): (r.lon, r.lat) for r in targets.collect()}
    pts = np.column_stack([lon.ravel(), lat.ravel()])
    for r in near.collect():
        x, y = grid[r.gy, r.gx]
        d = ((pts[:, 0] - x) * 0.9) ** 2 + (pts[:, 1] - y) ** 2
        assert d[r.cell] <= d.min() + 1e-15
    out = fields.resample(fs, ["key"], fields.linear_weights(mesh, 16), near).collect()
    wet = {(r.gy, r.gx) for r in near.collect() if r.cell % 15 > 2}
    assert len(out) > 80 and {(r.gy, r.gx) for r in out} <= wet
    for r in out:
        x, y = grid[r.gy, r.gx]
        assert r.z == pytest.approx(3 * (x - 137) - 2 * (y + 29) + 0.5, abs=1e-9)
    moving = fs.withColumn("ue", F.lit(1.0)).withColumn("vn", F.when(F.col("cell") % 2 == 0, 0.0).otherwise(1.0))
    marks = fields.arrows(moving, ["key"], targets, fields.linear_weights(mesh, 16), near).collect()
    assert len(marks) == len(out) and {r.bearing for r in marks} == {90.0, 45.0}


@pytest.mark.parametrize(("n", "sigma"), [(12, 2.0), (5, 2.0), (7, 0.7)])
def test_smoothing_equals_a_plain_loop(spark, n, sigma):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(n, n))
    z[rng.random((n, n)) < 0.2] = np.nan
    rows = [("k", i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(n) for j in range(n)]
    got = {(r.gy, r.gx): r.z for r in fields.smooth(spark.createDataFrame(rows, "key string, gy int, gx int, z double"), ["key"], n, n, sigma).collect()}
    kernel = fields.gaussian(sigma)

    def back(i):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    for i in range(n):
        for j in range(n):
            if np.isnan(z[i, j]):
                assert got[i, j] is None
                continue
            cells = [(z[back(i + a), back(j + b)], v * w) for a, v in kernel for b, w in kernel]
            num, den = sum(x * w for x, w in cells if not np.isnan(x)), sum(w for x, w in cells if not np.isnan(x))
            assert got[i, j] == pytest.approx(num / den)


def test_small_field_rules(spark):
    df = spark.createDataFrame([(0, float(i), float(v)) for i, v in enumerate([1, 4, 9, 16])], "line int, i double, v double")
    assert [r.g for r in fields.gradient(df, ["line"], "i", "v", "g").orderBy("i").collect()] == [3.0, 4.0, 6.0, 7.0]
    assert fields.sub_indices(10, 4) == [0, 3, 6, 9] and fields.sub_indices(3, 9) == [0, 1, 2]
    rgb = one(spark, *(fields.ramp(F.lit(x)) for x in (0.0, 1.0, 9.0, float("nan"))))
    assert tuple(rgb[0]) == (48, 18, 59, 205) and tuple(rgb[1]) == tuple(rgb[2]) == (122, 4, 3, 205) and rgb[3].alpha == 0
    assert tuple(one(spark, fields.image_bounds(F.lit(0.0), F.lit(9.0), F.lit(0.0), F.lit(18.0), 10))[0]) == (-0.5, 9.5, -1.0, 19.0)
    flat = spark.createDataFrame([(0, 0, 0, 0.0)], "key int, gy int, gx int, z double")
    s = fields.layer_stats(flat, ["key"]).first()
    assert s.vmin == 0 and s.vmax == 1e-6 and fields.layer_stats(flat, ["key"], 1.0, 3.0).first().vmax == 3.0
    assert fields.layer_stats(flat.withColumn("z", F.lit(None).cast("double")), ["key"]).first().vmax == 1.0


def test_extraction_falls_back_to_far_pixels(spark):
    cells = spark.createDataFrame([(1, 0, 0, 137.0, -29.0, 0, 1.0), (1, 0, 9, 137.9, -29.0, None, 2.0), (1, 9, 0, 137.0, -28.1, 1, 3.0)], "granule int, iy int, ix int, lon double, lat double, qual int, wse double")
    sites = spark.createDataFrame([("a", 137.4, -28.9), ("b", 137.85, -28.95), ("out", 140.0, -29.0)], "site string, lon double, lat double")
    assert {r.site: r.wse for r in extraction.extract_series(sites, cells).collect()} == {"a": 1.0, "b": 2.0}
    assert {r.site for r in extraction.extract_series(sites, cells, quals=[0, 1]).collect()} == {"a"}  # no quality is none
    assert extraction.extract_series(sites, cells.limit(0)).count() == 0


def _pixel_table(spark):
    """Granules 1 to 4 on one grid, 5 on a shifted one; a pixel that is listed twice, and gaps of quality, level and place."""
    def row(g, y, x):
        k, shift = g * 31 + y * 7 + x, 0.004 if g == 5 else 0.0
        return g, y, x, None if (y, x) == (5, 0) else 137.0 + x * 0.01 + shift, -29.0 + y * 0.01 + shift, None if k % 11 == 0 else k % 4, None if k % 7 == 0 else float(k % 13)

    rows = [row(g, y, x) for g in range(1, 6) for y in range(6) for x in range(6)]
    rows += [(g, 2, 2, 137.02, -28.98, 3 - g % 3, g / 2) for g in range(1, 5)]
    places = [(137.011, -28.989), (137.019, -28.981), (137.038, -28.962), (137.002, -28.949), (137.0345, -28.9655), (139.0, -29.0), (None, -29.0)]
    sites = [(i, *places[i % 7]) for i in range(70)] + [(3, 137.011, -28.971), (None, 137.04, -28.99)]
    return rows, sites, spark.createDataFrame(rows, "granule int, iy int, ix int, lon double, lat double, qual int, wse double"), spark.createDataFrame(sites, "site int, lon double, lat double")


def _extracted(rows, sites, reach, quals, per_pixel):
    """extract_series by plain loops."""
    out, last = set(), lambda v: (v is None, v)
    for site in {s[0] for s in sites}:
        for g in range(1, 6):
            own = [r for r in rows if r[0] == g]
            known = [r for r in own if r[3] is not None]
            lons, lats = [r[3] for r in known], [r[4] for r in own]
            at = [(x, y) for s, x, y in sites if s == site and x is not None and min(lons) <= x <= max(lons) and min(lats) <= y <= max(lats)]
            if not at:
                continue
            best = min(((r[3] - x) ** 2 + (r[4] - y) ** 2, r[1], r[2], last(r[5]), last(r[6])) for r in known for x, y in at)
            qual, values = best[3][1], [best[4][1]]
            if quals and qual not in quals:
                continue
            if reach:
                values = [r[6] for r in own if abs(r[1] - best[1]) <= reach and abs(r[2] - best[2]) <= reach and (not per_pixel or r[5] in quals)]
            if values := [v for v in values if v is not None]:
                out.add((site, g, round(sum(values) / len(values), 9), qual, len(values)))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize(("reach", "quals", "per_pixel"), [(0, None, False), (0, [0, 1], False), (1, [0, 1, 2], False), (2, [0, 1], True)])
def test_extraction_equals_plain_loops(spark, monkeypatch, reach, quals, per_pixel, most):
    """Shared and own grids, sites at one place, with joins that are broadcast and that aren't."""
    rows, sites, cells, at = _pixel_table(spark)
    monkeypatch.setattr(extraction.few_or_merged, "__defaults__", (most,))
    got = [(r.site, r.granule, round(r.wse, 9), r.qual, r.n) for r in extraction.extract_series(at, cells, reach, quals, per_pixel).collect()]
    assert len(got) == len(set(got)) and set(got) == _extracted(rows, sites, reach, quals, per_pixel)


def test_places_and_grids_are_searched_once(spark, monkeypatch):
    """Before, each site was sought in each granule, so that pairs of both crossed the shuffles."""
    _, _, cells, sites = _pixel_table(spark)
    seen, real = [], extraction.nearest

    def spied(points, pixels, *rest):
        seen.extend((points.count(), pixels.count()))
        return real(points, pixels, *rest)

    monkeypatch.setattr(extraction, "nearest", spied)
    n = extraction.extract_series(sites, cells).count()
    assert n > 150 and seen[0] <= 14 and seen[1] == 2 * 35  # 7 places by 2 grids


def test_what_was_found_is_broadcast_by_its_rows(spark, monkeypatch):
    """Before, Spark judged by the size of compressed files whether the driver gathers all points that were found."""
    _, _, cells, sites = _pixel_table(spark)
    points = sites.where("site IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["site"]).crossJoin(spark.range(1, 6).selectExpr("CAST(id AS INT) AS granule"))
    asked, real = [], extraction.few_or_merged
    monkeypatch.setattr(extraction, "few_or_merged", lambda rows, count: asked.append((rows.columns, count)) or real(rows, count, 0))
    got = extraction.nearest(points, cells.withColumn("at", F.col("lon")), ["site"], ["granule"], ["iy", "ix"])
    assert [c for c, _ in asked] == [["site", "granule"]] * 2 and sum(n for _, n in asked) <= got.count() == 60 * 5
    joins = spark.range(9).join(real(spark.range(9), 9, 8), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joins and "Broadcast" not in joins


def test_no_pairs_of_sites_and_granules_are_stored(spark, monkeypatch, tmp_path):
    """Before, the pixel of each site in each granule was written to the shared folder, beside all columns of the cells."""
    _, _, cells, _ = _pixel_table(spark)
    sites = spark.range(2000).selectExpr("id AS site", "137.011 + (id % 3) * 0.01 AS lon", "-28.99 + (id % 2) * 0.01 AS lat")
    for module in (extraction, more):
        monkeypatch.setattr(module, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    assert extraction.extract_series(sites, cells).count() > 7000
    assert max(spark.read.parquet(str(f)).count() for f in tmp_path.iterdir()) <= 2 * 2000
    more.QUERIES["extract_nearest"](spark, SF).count()
    stored = [spark.read.parquet(str(f)).columns for f in tmp_path.iterdir() if f.name.startswith("table-")]
    assert stored == [["granule", "iy", "ix", "lon", "lat", "qual", "wse"]]


@pytest.mark.parametrize("name", ["extract_window", "extract_point"])
def test_many_sites_make_small_files(spark, tmp_path, name):
    """Before, the sites of a value came in any length and order of runs, and files took 4 bytes a row."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/lineitem.parquet").symlink_to("/root/testdata/sf0.01/lineitem.parquet")
    spark.range(20_000).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/in/supplier.parquet")
    rows = catalog.QUERIES[name](spark, f"{tmp_path}/in")
    rows.write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == 20_000 * 50 if name == "extract_window" else n > 20_000 * 30
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) / n
    print(name, n, size)
    assert size < 0.7


def test_sites_of_a_value_in_blocks(spark):
    """A key with most sites goes to many blocks; each meets each value once."""
    asked = spark.range(900).selectExpr("CAST(id AS INT) AS site", "CASE WHEN id < 850 THEN 0 ELSE id % 5 END AS k")
    values = spark.range(60).selectExpr("id % 12 AS granule", "id DIV 12 AS k", "id AS wse")
    got = extraction.to_sites(values, asked, ["k"], block=16)
    want = values.join(asked, "k").select("granule", "wse", "site")
    assert got.count() == want.count() == 12 * 900
    assert got.select("granule", "wse", "site").exceptAll(want).isEmpty()
    assert extraction.to_sites(values, asked.limit(0), ["k"]).count() == 0


def test_areas(spark):
    cells = spark.createDataFrame([(1, 1, 0.5, None, True), (1, 1, 0.2, None, True), (1, 2, None, None, False)], "day long, granule long, water_frac double, uncert double, mask boolean")
    s = {r.granule: r for r in raster.scene_area(cells, ["day", "granule"], "mask", cell_area=100.0).collect()}
    assert s[1].area_m2 == pytest.approx(70.0) and s[1].uncert_m2 is None and s[1].n_valid == 2
    with pytest.raises(ValueError, match="water_area"):
        raster.scene_area(cells, ["day"], "mask")
    scenes = raster.scene_area(cells, ["day", "granule"], "mask", cell_area=100.0)
    d = raster.combine_scenes(scenes, None).first()
    assert d.coverage is None and d.partial is False and d.n_scenes == 1
    assert raster.outside_scenes(scenes).first().n_outside == 1
    assert one(spark, raster.relative_volume_error(F.lit(3.0), F.lit(4.0))) == (5.0,)


def test_asof_over_blocks_of_time(spark):
    rng = np.random.default_rng(5)
    obs = [("ab"[i % 2], int(t), i, float(i)) for i, t in enumerate(rng.integers(0, 5000, 200))]
    at = [("abc"[i % 3], int(t)) for i, t in enumerate(rng.integers(-500, 6000, 300))]
    df = temporal.asof(spark.createDataFrame(at, "station string, t long"), spark.createDataFrame(obs, "station string, t long, id long, x double"), "station", ["x"], span=300)
    for r in df.collect():
        before = max(((t, i) for s, t, i, _ in obs if s == r.station and t <= r.t), default=None)
        after = min((t for s, t, _, _ in obs if s == r.station and t > r.t), default=None)
        assert (r.back and (r.back.t, int(r.back.x))) == before and (r.ahead and r.ahead.t) == after


def test_conditions(spark):
    obs = spark.createDataFrame([("a", 0, 1, 36.0, 90.0), ("a", 1000, 2, 18.0, 350.0), ("b", 0, 3, 1.0, 1.0)], "station string, t long, id long, wind_spd_kmh double, wind_dir_deg double")
    levels = spark.createDataFrame([(1, 500, 1, -12.0), (1, 900, 2, -11.0), (2, 0, 3, 0.0)], "site long, t long, file long, wse double")
    at = spark.createDataFrame([(500,), (501,), (100,), (None,)], "at long")
    rows = {r["at"]: r for r in temporal.conditions_at(at, obs, levels, "a", None, 0.5).collect()}
    assert (rows[500].wind_speed, rows[500].wlvl, rows[500].offset_min) == (10.0, -11.5, 8) and rows[501].wind_speed == 5.0
    assert rows[100].wlvl == -10.5 and rows[None].obs_t == 1000 and rows[None].level_t == 900 and rows[None].offset_min == 0


def test_warnings_and_overrides(spark):
    names = "wind_speed double, wind_dir double, wlvl double, salinity double"
    s = spark.createDataFrame([(1, 10.0, 0.0, -12.0, 0.0), (2, 20.0, 0.0, -14.0, 0.0)], "key long, " + names)
    t = spark.createDataFrame([(1, 30.0, 350.0, -15.0, None), (2, 14.0, 40.0, -12.0, 0.0)], "target long, " + names)
    scales = scenarios.scales_of(s)
    rows = {r.target: r for r in scenarios.envelope(scenarios.match(t, s, scales, 1), t, s, scales).collect()}
    assert (rows[1].flag_wind_speed, rows[1].flag_wind_dir, rows[1].flag_wlvl, rows[1].flag_salinity) == ("above", "in", "below", None)
    assert rows[1].delta_wind_dir == -10.0 and len(rows[1].warnings) == 2 and len(rows[2].warnings) == 2
    o = spark.createDataFrame([(1, "12", None, None, None)], "target long, wind_speed string, wind_dir string, wlvl string, salinity string")
    assert {r.target: r.wind_speed for r in scenarios.overridden(t, o).collect()} == {1: 12.0, 2: 14.0}
    with pytest.raises(Exception, match="no number"):
        scenarios.overridden(t, o.withColumn("wlvl", F.lit("deep"))).collect()
    assert catalogue.first(t, ["target"], 1).count() == 1 and catalogue.first(t, ["target"], None).count() == 2


def test_incremental_extraction(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(list(rows), "file string, size long, print string")
    seen, path = [], str(tmp_path / "cache")

    def extract(todo):
        seen.append({r.file for r in todo.collect()})
        return todo.withColumn("wse", F.when(F.col("file") != "bad", F.col("size").cast("double")))

    keys = ["file", "size", "print"]
    assert series.incremental_extract(path, files(("a", 1, "p"), ("bad", 2, "p")), extract, keys).count() == 1
    assert series.incremental_extract(path, files(("a", 1, "p"), ("bad", 2, "p"), ("c", 3, "p")), extract, keys).count() == 2
    assert {r.wse for r in series.incremental_extract(path, files(("a", 9, "p")), extract, keys).collect()} == {9.0}
    assert series.incremental_extract(path, files(("a", 9, "q")), extract, keys).count() == 1
    assert seen == [{"a", "bad"}, {"c"}, {"a"}, {"a"}]


def test_streams_go_on_where_they_stopped(spark):
    folder, check, out = (shared_folder(spark, x) for x in ("in", "check", "out"))
    schema = "station string, id long, t long, x double, src string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
    day = 86400
    for rows in ([("a", 1, 0, 1.0, "bom"), ("a", 2, 8 * day, 2.0, "bom"), ("d", 3, 8 * day, 0.0, "demo")], [("a", 4, 8 * day, 5.0, "bom"), ("b", 5, 9 * day, 6.0, "bom")]):
        put(*rows)
        got = archive.stream_archive(spark.readStream.schema(schema).parquet(folder), out, check).collect()
    assert sorted((r.station, r.t, r.x) for r in got) == [("a", 8 * day, 5.0), ("b", 9 * day, 6.0), ("d", 8 * day, 0.0)]
    put(("a", 6, 8 * day, 7.0, None), ("a", 7, 9 * day, 8.0, None))
    got = archive.stream_archive(spark.readStream.schema(schema).parquet(folder), out, check).collect()
    assert sorted((r.station, r.t, r.x) for r in got) == [("a", 8 * day, 5.0), ("a", 9 * day, 8.0), ("b", 9 * day, 6.0), ("d", 8 * day, 0.0)]


def test_changed_files_are_extracted_again(spark):
    folder, store, seen, schema = shared_folder(spark, "listings"), shared_folder(spark, "store"), [], "file string, size long, modified long"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    def extract(files):
        seen.append(sorted(tuple(r) for r in files.select("file", "size").collect()))
        return files.where("file != 'bare'").select("file", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("x"))

    def run(mark):
        del seen[:]
        rows = archive.stream_extract(spark.readStream.schema(schema).parquet(folder), extract, store, mark).collect()
        return sorted((r.file, r.x) for r in rows), [s for s in seen if s]

    put(("f1", 1, 10), ("bare", 1, 10))
    assert run("p") == ([("f1", 1)], [[("bare", 1), ("f1", 1)]])
    assert run("p") == ([("f1", 1)], [])
    put(("f1", 3, 20), ("bare", 1, 30), ("f2", 2, 20))
    assert run("p") == ([("f1", 1), ("f1", 2), ("f1", 3), ("f2", 1), ("f2", 2)], [[("f1", 3), ("f2", 2)]])
    put(("f1", 1, 15))  # an old listing that comes late
    assert run("p")[1] == []
    assert run("q")[1] == [[("bare", 1), ("f1", 3), ("f2", 2)]]


def test_scenes_that_come_in_pieces(spark):
    folder, place, check = (shared_folder(spark, x) for x in ("cells", "areas", "check"))
    schema = "day long, granule long, iy long, ix long, water_frac double, water_area double, uncert double, mask boolean"
    put = lambda *rows: spark.createDataFrame([(d, g, y, x, 0.5, a, None, m) for d, g, y, x, a, m in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: {r.day: (r.area_km2, r.n_scenes, r.n_cells) for r in archive.stream_daily_area(spark.readStream.schema(schema).parquet(folder), check, place, 4).collect()}
    put((1, 1, 0, 0, 1e6, True), (2, 5, 0, 0, 4e6, True))
    assert run() == {1: (1.0, 1, 1), 2: (4.0, 1, 1)}
    put((1, 1, 0, 1, 2e6, True), (1, 2, 0, 0, 5e6, True))
    assert run() == {1: (8.0, 2, 3), 2: (4.0, 1, 1)}
    put((1, 1, 0, 0, 1e6, False), (1, 1, 0, 1, 3e6, True))
    assert run() == {1: (8.0, 2, 2), 2: (4.0, 1, 1)} == run()


def test_last_known_value(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder, schema, got = shared_folder(spark, "in"), "station string, t long, air_temp double", []
        spark.createDataFrame([("a", 1, 5.0), ("a", 3, 6.0), ("b", None, 1.0)], schema).coalesce(1).write.parquet(folder)
        stream = archive.stream_last_known(spark.readStream.schema(schema).parquet(folder))
        archive.run(stream, shared_folder(spark, "check"), lambda batch, _: got.extend(map(tuple, batch.collect())), "update", idle=False)
        assert got == [("a", 3, 6.0, False)]
    finally:
        spark.conf.unset(provider)


def test_runs_without_problems_are_left_out(spark):
    rows = [(i, s, True, ["S1"], [], [], 24, 10) for i in range(5) for s in ("flow", "wave")] + [(9, "flow", True, [], ["time"], ["s1"], 6, 10)]
    df = spark.createDataFrame(rows, "key long, source string, readable boolean, vars array<string>, empty_dims array<string>, empty_vars array<string>, n_time long, n_layer long")
    got = catalogue.check_runs(df, {"flow": ["s1"], "wave": []}).collect()
    assert [(r.key, r.problems) for r in got] == [(9, ["no output of wave", "flow: empty dimension time", "flow: missing s1", "flow: no values in s1", "flow: times 6"])]


def test_tables_of_bindings_are_whole(spark):
    for name, own in (("places", "supplier"), ("paths", "part"), ("feed", "events")):
        assert table(spark, SF, name).count() == spark.read.parquet(f"{SF}/{own}.parquet").count()


def test_currents_within_bounds(spark):
    mesh = spark.range(400).selectExpr("'flow' AS source", "id AS cell", "CAST(id / 20 AS INT) AS iy", "CAST(id % 20 AS INT) AS ix", "0.0 AS lon", "0.0 AS lat", "CAST(id % 20 AS INT) * 100.0D AS x", "CAST(id / 20 AS INT) * 100.0D AS y")
    flow = mesh.selectExpr("source", "1 AS key", "cell", "IF(ix < 10, 0.0D, 0.03D * iy) AS u", "IF(ix < 10, 0.0D, 0.04D * iy) AS v", "ix < 15 AS wet")
    speeds, arrows = fields.current_map(flow, mesh, ["key"], 9, 5, (1000.0, 1800.0, 500.0, 5000.0))
    rows = {(r.gy, r.gx): r for r in speeds.collect()}
    assert {r.x for r in rows.values()} == {1000.0 + 100 * i for i in range(5)} and max(r.y for r in rows.values()) == 1900.0  # dry from x = 1500
    assert all(r.speed == pytest.approx(0.05 * r.y / 100) for r in rows.values())
    assert {(r.x, round(r.bearing, 2)) for r in arrows.collect()} == {(x, 36.87) for x in (1000.0, 1200.0, 1400.0)}
    still = fields.currents(flow.where("ix < 10"), mesh, ["key"], 9, (0.0, 500.0, 0.0, 500.0)).collect()
    assert still and all(r.speed is None and r.bearing is None for r in still)
    with pytest.raises(Exception, match="nothing lies within"):
        fields.currents(flow, mesh, ["key"], 9, (9000.0, 9900.0, 0.0, 1.0)).collect()


def test_slabs_read_their_folders_only(spark, tmp_path):
    cells = spark.range(480).selectExpr("'flow' AS source", "id % 2 AS key", "'U1' AS name", "CAST(id % 6 AS INT) AS time", "CAST(id % 4 AS INT) AS layer", "0 AS constituent", "id AS cell", "CAST(id % 5 AS DOUBLE) AS value")
    fields.write_model_cells(cells, str(tmp_path / "cells"))
    held = spark.read.schema(cells.schema).parquet(str(tmp_path / "cells"))
    asked = spark.createDataFrame([(0, "U1", -1, 99, None), (1, "U1", 0, -99, 5)], "key long, name string, time int, layer int, constituent int")
    sizes = spark.createDataFrame([(0, "U1", 6, 4, 1), (1, "U1", 6, 4, 1)], "key long, name string, n_time int, n_layer int, n_constituent int")
    slab = fields.hyperslab(held, sizes, asked)
    plan = slab._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "IN (" in plan.replace("INSET", "IN (").split("PartitionFilters: [")[1][:300]
    assert {(r.key, r.time, r.layer, r.constituent) for r in slab.collect()} <= {(0, 5, 3, 0), (1, 0, 0, 0)}
    with pytest.raises(Exception, match="empty dimension"):
        fields.hyperslab(held, sizes.withColumn("n_time", F.lit(0)), asked)
    mesh = spark.range(480).selectExpr("'flow' AS source", "id AS cell", "id * 1.0D AS lon", "id * 2.0D AS lat")
    variables = spark.createDataFrame([(0, "U1", "", True), (0, "foo", "", True), (1, "U1", "", True)], "file long, name string, long_name string, on_coords boolean")
    got = fields.read_field(held, mesh, variables, asked.select("key", F.lit(1).alias("time"), F.lit(1).alias("layer"), "constituent")).collect()
    assert got and all(r.name == "U1" and r.lat == 2 * r.cell and (r.value is None) == (r.cell % 5 == 0) for r in got)


def test_last_known_in_event_time(spark):
    """Failed readings, silence, ties, rows behind the watermark, and a second call from the same checkpoint."""
    schema = "station string, id long, t long, air_temp double"
    folder, check, log, out = (shared_folder(spark, n) for n in ("in", "check", "log", "out"))

    def put(*rows):
        spark.createDataFrame(list(rows), schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(folder)

    def got():
        stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        return {r.station: (r.t, r.air_temp, r.stale) for r in archive.last_known(stream, check, log, patience=100, late="10 seconds").collect()}

    put(("a", 1, 1000, 5.0), ("a", 3, 1000, 7.0), ("a", 2, 1000, 6.0), ("b", 4, 1000, 1.0), ("b", 5, 1001, None), ("c", 6, 1000, None), ("d", 7, None, 2.0))
    assert got() == {"a": (1000, 7.0, False), "b": (1000, 1.0, True)}
    put(("b", 8, 1050, 2.0), ("e", 9, 1200, 3.0))
    assert got() == {"a": (1000, 7.0, True), "b": (1050, 2.0, True), "e": (1200, 3.0, False)}
    put(("a", 10, 1195, 8.0), ("b", 11, 1100, 9.0))  # the second lies behind the watermark
    assert got() == {"a": (1195, 8.0, False), "b": (1050, 2.0, True), "e": (1200, 3.0, False)} == got()


def test_export_of_layers(spark, tmp_path):
    """A second export takes the place of the first; what broke off before its manifest is not read; empty ones."""
    path = str(tmp_path / "export")
    with pytest.raises(ValueError, match="no export"):
        sinks.read_export(spark, path)
    mesh = spark.createDataFrame([("s", i, i // 3, i % 3, float(i % 3), float(i // 3)) for i in range(9)], "source string, cell int, iy int, ix int, lon double, lat double")
    grid = spark.createDataFrame([(k, "s", layer, y, x, None if k == "dry" else 1.0 + y * 4 + x) for k in ("k", "dry", "other") for layer in (0, 1) for y in range(4) for x in range(4)], "key string, source string, layer int, gy int, gx int, z double")
    arrows = spark.createDataFrame([("k", 0, 1, 1, 90.04, 2.00004), ("other", 0, 0, 0, 1.0, 1.0)], "key string, layer int, gy int, gx int, bearing double, value double")
    scenarios = spark.createDataFrame([("k", 3.0, "/a"), ("dry", 4.0, "/b")], "key string, wind_speed double, path string")
    first = sinks.export_layers(grid, arrows, mesh, scenarios, ["wind_speed"], path, 4, 4, 2, 2, fixed=True, configured={1: (2.0, 3.0)})
    about, docs, index = sinks.read_export(spark, path)
    assert (about["export"], about["n_scenarios"], about["n_missing"], index.columns) == (first, 1, 1, ["key", "wind_speed"])
    assert about["frames"][0].asDict() == {"source": "s", "west": pytest.approx(-1 / 3), "east": pytest.approx(7 / 3), "south": pytest.approx(-1 / 3), "north": pytest.approx(7 / 3)}
    rows = {r.layer: r for r in docs.collect()}
    assert (rows[0].key, rows[0].i, rows[0].b, rows[0].v, rows[0].ci, rows[0].cz) == ("k", [3], [90.0], [2.0], [0, 1, 2, 3], [1.0, 4.0, 13.0, 16.0])
    assert (rows[1].i, rows[1].vmin, rows[1].vmax, rows[0].vmin, rows[0].vmax, rows[0].n_valid) == ([], 2.0, 3.0, 0.0, 16.0, 16)
    with pytest.raises(Exception, match="no_such"):
        sinks.export_layers(grid, arrows, mesh, scenarios, ["no_such"], path, 4, 4, 2, 2)
    docs.limit(0).drop("layer").write.parquet(f"{path}/export=broken/layers")
    assert sinks.read_export(spark, path)[0]["export"] == first
    second = sinks.export_layers(grid.where("layer = 0"), arrows, mesh, scenarios, ["wind_speed"], path, 4, 4, 2, 2)
    about, docs, _ = sinks.read_export(spark, path, layer=0)
    assert second != first and about["seq"] == 2 and [(r.layer, r.vmin, round(r.vmax, 2)) for r in docs.collect()] == [(0, 0.0, 15.85)]
    sinks.export_layers(grid.limit(0), arrows.limit(0), mesh, scenarios, ["wind_speed"], path, 4, 4, 2, 2)
    about, docs, index = sinks.read_export(spark, path)
    assert (about["n_scenarios"], about["n_missing"]) == (0, 2) and docs.isEmpty() and index.isEmpty()


def test_smoothing_of_odd_lines(spark):
    """Lines of one point, a lone value, a layer without any value, an empty table."""
    schema = "key string, gy int, gx int, z double"
    one = spark.createDataFrame([("k", 0, 0, 5.0), ("n", 0, 0, None)], schema)
    assert {r.key: r.z for r in fields.smooth(one, ["key"], 1, 1, 2.0).collect()} == {"k": pytest.approx(5.0), "n": None}
    lone = fields.smooth(spark.createDataFrame([("k", 0, 3, 5.0), ("k", 2, 2, None)], schema), ["key"], 6, 6, 0.7)
    assert {(r.gy, r.gx): r.z for r in lone.collect()} == {(0, 3): pytest.approx(5.0), (2, 2): None}
    assert fields.smooth(one.limit(0), ["key"], 5, 5, 1.0).isEmpty()
