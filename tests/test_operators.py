"""Small exact cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocadence.functions import geo
from geocadence.operators import catalogue, raster, scenarios, series, temporal, weather
from geocadence.sources.bindings import table


def test_outliers(spark):
    df = spark.createDataFrame([(1, i, i, w) for i, w in enumerate([-13.0, -12.8, -12.9, -20.0, 0.5, -13.1])], "site long, file long, t long, wse double")
    assert sorted(r.wse for r in series.clean_series(df, ["site"]).collect()) == [-13.1, -13.0, -12.9, -12.8]
    assert series.series_stats(series.clean_series(df, ["site"]), ["site"]).first().latest_wse == -13.1


def test_majority(spark):
    cells = spark.range(81).selectExpr("1 AS g", "id div 9 AS iy", "id % 9 AS ix", "id = 40 AS m")
    assert raster.majority_filter(cells, ["g"], "m").where("m").count() == 0
    block = spark.range(121).selectExpr("1 AS g", "id div 11 AS iy", "id % 11 AS ix", "(id div 11 BETWEEN 3 AND 7) AND (id % 11 BETWEEN 3 AND 7) AS m")
    kept = raster.majority_filter(block, ["g"], "m").where("m").collect()
    assert len(kept) >= 9 and (5, 5) in {(r.iy, r.ix) for r in kept}


def test_angles(spark):
    row = spark.range(1).select(geo.circular_delta(F.lit(350.0), F.lit(0.0)), geo.sector(F.lit(349.0)), geo.sector(F.lit(11.0)), geo.sector(F.lit(100.0)), geo.pack_int16(F.lit(1e6), 1e-4)).first()
    assert tuple(row) == (-10.0, 0, 0, 4, 32767)


def test_rose_counts_calm_apart(spark):
    obs = spark.createDataFrame([("a", 0.0, None), ("a", 12.0, 180.0), ("a", None, 90.0)], "station string, wind_spd_kmh double, wind_dir_deg double")
    assert {(r.sector, r.n, r.percent) for r in weather.wind_rose(obs).collect()} == {(-1, 1, 50.0), (8, 1, 50.0)}


def test_level_cap(spark):
    s = spark.createDataFrame([(1, 10.0, 0.0, -12.0, 0.0), (2, 10.0, 0.0, -14.0, 0.0)], "key long, wind_speed double, wind_dir double, wlvl double, salinity double")
    t = spark.createDataFrame([(1, 10.0, 0.0, -12.4, None), (2, 10.0, 0.0, -16.5, None)], "target long, wind_speed double, wind_dir double, wlvl double, salinity double")
    best = {r.target: r for r in scenarios.match(t, s, {"wind_speed": 1.0, "wind_dir": 180.0, "wlvl": 1.0, "salinity": 1.0}, k=1).collect()}
    assert best[1].key == 2 and best[1].capped and best[2].level_flag == "below" and not best[2].capped


def test_asof_tie_goes_to_the_earlier(spark):
    obs = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 10, 2, 2.0)], "station string, t long, id long, x double")
    at = spark.createDataFrame([("a", 5), ("a", 6), ("a", 20), ("b", 1)], "station string, t long")
    got = temporal.asof(at, obs, "station", ["x"]).select("station", "t", temporal.nearest_row()["x"].alias("x"))
    assert {(r.station, r.t): r.x for r in got.collect()} == {("a", 5): 1.0, ("a", 6): 2.0, ("a", 20): 2.0, ("b", 1): None}


def test_all_customers_and_suppliers_are_targets_and_sites(spark):
    d = "/root/testdata/sf0.001"
    for name, own in (("targets", "customer"), ("sites", "supplier")):
        assert table(spark, d, name).count() == spark.read.parquet(f"{d}/{own}.parquet").count()


@pytest.mark.parametrize(("most", "caps"), [(64, (False, True)), (2, (True,))])
def test_match_equals_all_pairs(spark, most, caps):
    rng = np.random.default_rng(3)
    pick = lambda values, p=0.1: None if rng.random() < p else float(rng.choice(values))
    rows = lambda n, p: [(i, pick(rng.normal(20, 9, 40).round(1), p), pick(np.arange(-360, 720, 7.5), p), pick(np.arange(-14, -6, 0.5), p), pick([0, 50, 100], p)) for i in range(n)]
    names, scales = "wind_speed double, wind_dir double, wlvl double, salinity double", {"wind_speed": 10.0, "wind_dir": 180.0, "wlvl": 4.0, "salinity": 100.0}
    s, t = rows(300, 0.05), [*rows(60, 0.1), (60, 20.0, 10.0, -15.0, None)]
    for cap in caps:
        df = scenarios.match(spark.createDataFrame(t, "target long, " + names), spark.createDataFrame(s + [(1000 + r[0], *r[1:]) for r in s], "key long, " + names), scales, cap_level=cap, most=most)
        got = {(r.target, r.rank): (r.key, r.dist) for r in df.collect()}
        want = {}
        for i, *a in t:
            near = []
            for j, *b in s:
                if cap and not (a[2] is not None and a[2] + 1e-6 < -14 or None not in (a[2], b[2]) and b[2] <= a[2] + 1e-6):
                    continue
                delta = [0 if None in (x, y) else ((y - x + 180) % 360 - 180 if p == "wind_dir" else y - x) / scales[p] for p, x, y in zip(scales, a, b)]
                near += [(round(sum(x * x for x in delta) ** 0.5, 9), k) for k in (j, 1000 + j)]
            want |= {(i, n + 1): (k, round(dist, 3)) for n, (dist, k) in enumerate(sorted(near)[:5])}
        assert got.keys() == want.keys() and all(abs(got[x][1] - want[x][1]) <= 0.0011 for x in want)


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 3000)] + [("b", 1.0)] * 50 + [("c", None), ("d", 3.5), (None, 2.0), (None, 4.0), (None, None)]
    rows += [("e", float(x)) for x in 10.0 ** rng.uniform(-12, 12, 999)] + [("f", float(x)) for x in rng.integers(-3, 3, 400)] + [("g", x) for x in (1e300, -1e300, 0.0, 5e-324)]
    df = spark.createDataFrame(rows, "k string, x double")
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    for ranges in (4096, 3):
        got = {r.k: tuple(r)[1:] for r in series.quantiles(df, ["k"], "x", wanted, ranges).collect()}
        want = {r.k: tuple(r)[1:] for r in df.where("x IS NOT NULL").groupBy("k").agg(*(F.percentile("x", F.lit(p)).alias(n) for n, p in wanted.items())).collect()}
        assert got == want
    assert series.quantiles(df.limit(0), ["k"], "x", wanted).collect() == []


def test_first_rows_and_names_of_listings(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 1, "x"), (None, 5, None), (None, 4, "n"), ("b", None, "q"), ("b", 0, "z")], "k string, i long, name string")
    assert sorted(map(tuple, catalogue.keep_first(df, ["k"], ["i"]).collect()), key=str) == [("a", 1, "x"), ("b", None, "q"), (None, 4, "n")]
    assert catalogue.keep_first(df.limit(0), ["k"], ["i"]).collect() == []
    assert {r.name for r in catalogue.distinct_names(df, df.select("name").where("name > 'x'")).collect()} == {"x", "y", "z", "n", "q", None}
