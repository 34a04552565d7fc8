"""Values of raster granules at points: covering granules, nearest pixels, windows around them, terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def inside_box(lon: Column, lat: Column, lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> Column:
    return lon.between(lon_min, lon_max) & lat.between(lat_min, lat_max)


def granule_boxes(cells: DataFrame) -> DataFrame:
    """granule, lon_min, lon_max, lat_min, lat_max."""
    return cells.groupBy("granule").agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def covering(sites: DataFrame, granules: DataFrame, step: float = 1.0) -> DataFrame:
    """Each site (``site``, ``lon``, ``lat``) with every granule whose box holds it: boxes are spread over squares
    of ``step`` degrees, which makes the range join an equi-join."""
    squares = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step)))
    boxes = granules.withColumn("_x", squares("lon_min", "lon_max")).withColumn("_y", squares("lat_min", "lat_max"))
    own = sites.withColumn("_x", F.floor(F.col("lon") / step)).withColumn("_y", F.floor(F.col("lat") / step))
    hit = own.join(boxes, ["_x", "_y"]).where(inside_box(*map(F.col, ("lon", "lat", "lon_min", "lon_max", "lat_min", "lat_max"))))
    return hit.select(*sites.columns, "granule")


def pitches(cells: DataFrame, group: list[str], scale: float = 1.0) -> DataFrame:
    """``group``, _pitch: about the distance of neighbouring cells, in degrees, from the box of a group and its count."""
    lon, lat = (F.max("lon") - F.min("lon")) * scale, F.max("lat") - F.min("lat")
    return cells.groupBy(*group).agg(F.greatest(F.sqrt(lon * lat / F.count("*")), F.greatest(lon, lat) / F.count("*"), F.lit(1e-9)).alias("_pitch"))


def nearest(points: DataFrame, cells: DataFrame, point: list[str], group: list[str], order: list[str], step: float | None = None, scale: float = 1.0, widen: int = 4) -> DataFrame:
    """``point`` and ``group`` of each of ``points`` with ``cell``, the nearest of ``cells`` in the same group.

    Both have ``lon`` and ``lat``; distances are in degrees, those of longitude times ``scale``. Ties go to
    the least of ``order``. Points meet the cells in the nine squares around them, whose side is ``step`` or else
    the group's own pitch, so a few cells each. Where the nearest of these is not proven by lying within a side, the
    point goes on alone: once with squares ``widen`` times as wide, then against all cells of its group. What is
    found with the first squares is written to the shared folder, as both the rest and the result need it.
    """
    spark = points.sparkSession
    placed = cells.where("lon IS NOT NULL AND lat IS NOT NULL")
    side = pitches(placed, group, scale) if step is None else placed.select(*group).distinct().withColumn("_pitch", F.lit(float(step)))
    placed = placed.join(side, group)
    asked = points.select(*point, *group, F.col("lon").alias("_plon"), F.col("lat").alias("_plat")).join(side, group)
    around = F.array(*map(F.lit, (-1, 0, 1)))
    far = (((F.col("lon") - F.col("_plon")) * scale) ** 2 + (F.col("lat") - F.col("_plat")) ** 2).alias("_d")
    names = [c for c in cells.columns if c not in (*group, "lon", "lat")]

    def least(pairs: DataFrame) -> DataFrame:
        own = pairs.select(*point, *group, "_plon", "_plat", "_pitch", F.struct(far, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*names).alias("_cell")).alias("_c"))
        rank = F.struct("_c._d", *(f"_c._o{i}" for i in range(len(order))))
        return own.groupBy(*point, *group).agg(F.min_by("_c", rank).alias("_best"), F.first("_pitch").alias("_pitch"))

    def within(asked: DataFrame, times: int) -> DataFrame:
        square = lambda c, k: F.floor(F.col(c) * k / (F.col("_pitch") * times))
        at = asked.withColumn("_x", square("_plon", scale)).withColumn("_y", square("_plat", 1.0)).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        at = at.select(*point, *group, "_plon", "_plat", (F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y"))
        found = least(placed.withColumn("_x", square("lon", scale)).withColumn("_y", square("lat", 1.0)).join(at, [*group, "_x", "_y"]))
        return found.where(F.col("_best._d") < (F.col("_pitch") * times * (1 - 1e-9)) ** 2).select(*point, *group, F.col("_best._cell").alias("cell"))

    folder, near = shared_folder(spark, "nearest"), within(asked, 1)
    near.write.parquet(folder)
    near = spark.read.schema(near.schema).parquet(folder)
    rest = asked.join(few_or_merged(near.select(*point, *group), near.count()), [*point, *group], "left_anti")
    if rest.isEmpty():
        return near
    folder, wide = shared_folder(spark, "nearest"), within(rest, widen)
    wide.write.parquet(folder)
    wide = spark.read.schema(wide.schema).parquet(folder)
    far_off = rest.join(few_or_merged(wide.select(*point, *group), wide.count()), [*point, *group], "left_anti")
    last = least(placed.join(far_off.drop("_pitch"), group))
    return near.unionByName(wide).unionByName(last.select(*point, *group, F.col("_best._cell").alias("cell")))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def few_or_merged(rows: DataFrame, count: int, most: int = 200_000) -> DataFrame:
    """``rows``, to be broadcast in a join if their ``count`` is ``most`` at most; more are never broadcast, whatever their size is taken for."""
    return F.broadcast(rows) if count <= most else rows.hint("merge")


def to_sites(values: DataFrame, asked: DataFrame, key: list[str], block: int = 256) -> DataFrame:
    """Each of ``values`` (``key``, ``granule``) with every site of ``asked`` (``site``, ``key``) that has its key.

    Each result row is made once, where it is written: only values and sites cross a shuffle. The sites of a key are
    cut into blocks of about ``block``, so no task holds more of them, and the few that a value meets in turn come in
    the same order, which files keep small; keys of few blocks are spread over more tasks by their granules.
    """
    blocks = _kept(asked.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("_blocks")), "blocks")
    keys, total = blocks.agg(F.count("*"), F.coalesce(F.sum("_blocks"), F.lit(1))).first()
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread, blocks = max(1, min(64, -(-8 * parts // total))), few_or_merged(blocks, keys)
    own = values.join(blocks, key).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).withColumn("_part", F.pmod(F.xxhash64("granule"), F.lit(spread).cast("long"))).drop("_blocks")
    sites = asked.join(blocks, key).withColumn("_block", F.pmod(F.xxhash64("site"), F.col("_blocks"))).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))).drop("_blocks")
    on = [*key, "_block", "_part"]
    return own.repartition(parts, *on).join(sites.hint("merge"), on).drop(*on)


def grids(cells: DataFrame) -> DataFrame:
    """granule, grid and box: granules with the same pixels (``iy``, ``ix``, ``lon``, ``lat``) have the least of them as ``grid``.

    The same are those with equal counts, boxes and sums of two 64-bit hashes over their pixels.
    """
    pixel = [x for c in ("iy", "ix", "lon", "lat") for x in (F.col(c), F.isnull(c))]  # a hash passes over nulls
    halves = {f"_h{i}": (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))) for i, h in enumerate((F.xxhash64(F.lit(1), *pixel), F.xxhash64(F.lit(2), *pixel)))}
    sums = [F.sum(x).alias(f"{name}{k}") for name, pair in halves.items() for k, x in enumerate(pair)]
    box = [f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))]
    own = cells.groupBy("granule").agg(F.count("*").alias("_count"), *sums, *box)
    same = ["_count", "_h00", "_h01", "_h10", "_h11"]
    first = own.groupBy(*same).agg(F.min("granule").alias("grid"))
    return own.join(first, same).select("granule", "grid", "lon_min", "lon_max", "lat_min", "lat_max")


def nearest_pixels(sites: DataFrame, cells: DataFrame, granules: DataFrame, step: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``pixel``, grid, iy, ix, clon, clat, copies of the pixels that are nearest to a site, and ``site``, ``pixel``.

    Pixels are sought once for each grid (``granules`` as of ``grids``) and once for all sites at the same places.
    """
    at = F.sort_array(F.collect_set(F.struct("lon", "lat"))).alias("_at")
    placed = sites.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("site").agg(at)
    spots = _kept(placed.select("_at").distinct().withColumn("spot", F.monotonically_increasing_id()), "spots")
    own = granules.where("granule = grid")
    pixels = cells.where("lon IS NOT NULL AND lat IS NOT NULL").join(own.select("granule", "grid"), "granule").groupBy("grid", "iy", "ix", "lon", "lat").agg(F.count("*").alias("copies"))
    pixels = _kept(pixels.withColumns({"clon": F.col("lon"), "clat": F.col("lat")}), "pixels")
    points = covering(spots.select("spot", F.inline("_at")), own, 1.0).withColumnRenamed("granule", "grid")
    picked = _kept(nearest(points, pixels, ["spot"], ["grid"], ["iy", "ix"], step).select("spot", "grid", "cell.*"), "picked")
    found = _kept(picked.drop("spot").distinct().withColumn("pixel", F.monotonically_increasing_id()), "found")
    a, b = picked.alias("a"), found.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("grid", "iy", "ix", "clon", "clat")]
    by_spot = a.join(b, same).select("a.spot", "b.pixel")
    return found, _kept(placed.join(spots, "_at").join(by_spot, "spot").select("site", "pixel"), "asked")


def extract_series(sites: DataFrame, cells: DataFrame, reach: int = 0, quals: list[int] | None = None, per_pixel: bool = False, step: float | None = None, digits: int | None = None) -> DataFrame:
    """site, granule, wse, qual, n: the level at each site in every granule that covers it.

    The value is that of the nearest pixel, or with ``reach`` the mean over the square of pixels within it;
    ``quals`` are allowed qualities of the nearest pixel (a null quality is none), with ``per_pixel`` of all
    averaged ones, too. Rows without a value are dropped. Of a pixel that a granule lists twice at the same place
    the least quality counts, then the least value. Levels are rounded to ``digits``, if given, before sites share them.
    """
    level = F.col("wse") if digits is None else F.round("wse", digits)
    granules = _kept(grids(cells), "grids")
    pixels, asked = nearest_pixels(sites, cells.select("granule", "iy", "ix", "lon", "lat"), granules, step)
    count, parts = pixels.count(), int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cells.select("granule", "iy", "ix", "lon", "lat", "qual", "wse").join(granules.select("granule", "grid"), "granule")
    allowed = F.lit(True) if quals is None else F.col("qual").isin(*quals)
    if not reach:
        a, b = placed.alias("a"), few_or_merged(pixels, count).alias("b")
        same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}")) for x, y in (("grid", "grid"), ("iy", "iy"), ("ix", "ix"), ("lon", "clon"), ("lat", "clat"))]
        values = a.join(b, same).select("a.granule", "b.pixel", "a.qual", "a.wse")
        if not pixels.where("copies > 1").isEmpty():
            least = F.min(F.struct(F.isnull("qual"), "qual", F.isnull("wse"), "wse"))
            values = values.groupBy("granule", "pixel").agg(least.alias("_v")).select("granule", "pixel", "_v.qual", "_v.wse")
        return to_sites(values.where(allowed & F.col("wse").isNotNull()).withColumn("wse", level), asked, ["pixel"]).select("site", "granule", "wse", "qual", F.lit(1).cast("long").alias("n"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = pixels.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).withColumn("_mid", (F.col("_dy") == 0) & (F.col("_dx") == 0))
    around = around.select("grid", (F.col("iy") + F.col("_dy")).alias("iy"), (F.col("ix") + F.col("_dx")).alias("ix"), "pixel", *(F.when(F.col("_mid"), F.col(c)).alias(c) for c in ("clon", "clat")))
    own = placed.repartition(parts, "granule").join(few_or_merged(around, count * (2 * reach + 1) ** 2), ["grid", "iy", "ix"])
    value = F.when(allowed, F.col("wse")) if per_pixel else F.col("wse")
    qual = F.min(F.when((F.col("lon") == F.col("clon")) & (F.col("lat") == F.col("clat")), F.col("qual")))
    mean = own.groupBy("granule", "pixel").agg(F.avg(value).alias("wse"), qual.alias("qual"), F.count(value).alias("n"))
    return to_sites(mean.where(allowed & F.col("wse").isNotNull()).withColumn("wse", level), asked, ["pixel"]).select("site", "granule", "wse", "qual", "n")


def extract_quality(sites: DataFrame, cells: DataFrame, reach: int = 0, step: float | None = None) -> DataFrame:
    """site, granule, quality: that of the nearest pixel, or the mean within ``reach``; nothing is filtered."""
    as_value = cells.withColumn("wse", F.col("qual").cast("double"))
    return extract_series(sites, as_value, reach, None, step=step).select("site", "granule", F.col("wse").alias("quality"))


def quality_shares(cells: DataFrame, label: str) -> DataFrame:
    """Percentages of the qualities 0 to 3 for each label: q0 to q3."""
    return cells.groupBy(label).agg(*(F.round(100.0 * F.count_if(F.col("qual") == q) / F.count("*"), 6).alias(f"q{q}") for q in range(4)))


def sample_terrain(points: DataFrame, terrain: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """``points`` (``x``, ``y``) with ``terrain``: the ``z`` of the raster cell (``row``, ``col``) that they lie in, null outside."""
    asked = points.withColumn("row", F.floor((y0 - F.col("y")) / dy)).withColumn("col", F.floor((F.col("x") - x0) / dx))
    return asked.join(terrain.select("row", "col", F.col("z").alias("terrain")), ["row", "col"], "left").drop("row", "col")


def level_over_terrain(series: DataFrame, terrain: DataFrame) -> DataFrame:
    """site, mean_wse, corrected (mean plus terrain less mean), height (mean less terrain, two decimals)."""
    mean = series.groupBy("site").agg(F.avg("wse").alias("mean_wse"))
    return mean.join(terrain.select("site", "terrain"), "site").select("site", "mean_wse", (F.col("mean_wse") + (F.col("terrain") - F.col("mean_wse"))).alias("corrected"), F.round(F.col("mean_wse") - F.col("terrain"), 2).alias("height"))
