"""Raster cells in long form: masks, majority filter, radius semi-join, areas without double counting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .extraction import few_or_merged


def water_mask(frac: Column, qual: Column | None = None, lo: float = 0.1, hi: float = 0.99, max_qual: int = 1) -> Column:
    """Fraction within [lo, hi] and quality not above ``max_qual``; null is no water."""
    ok = frac.between(lo, hi) if qual is None else frac.between(lo, hi) & (qual <= max_qual)
    return F.coalesce(ok, F.lit(False))


def _box(df: DataFrame, scene: list[str], line: str, along: str, value: str, before: int, after: int, out: str) -> DataFrame:
    """Sum over [-before, after] along one axis, the edge values standing in for what lies outside."""
    whole = Window.partitionBy(*scene, line).orderBy(along)
    full = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside, first, last = F.sum(value).over(whole.rowsBetween(-before, after)), F.first(value).over(full), F.last(value).over(full)
    i, n = F.row_number().over(whole) - 1, F.count("*").over(full)
    under, over = F.greatest(F.lit(0), before - i), F.greatest(F.lit(0), i + after - n + 1)
    return df.withColumn(out, inside + first * under + last * over)


def majority_filter(cells: DataFrame, scene: list[str], mask: str, size: int = 5) -> DataFrame:
    """Replaces ``mask`` by the majority of its size x size box; a dense grid, separable in two window passes."""
    if size < 2:
        return cells
    before, after = size // 2, (size - 1) // 2
    out = _box(cells.withColumn("_m", F.col(mask).cast("long")), scene, "iy", "ix", "_m", before, after, "_row")
    out = _box(out, scene, "ix", "iy", "_row", before, after, "_sum")
    return out.withColumn(mask, F.col("_sum") * 2 > size * size).drop("_m", "_row", "_sum")


def inside_boundary(cells: DataFrame, boundary: DataFrame, cos_lat: float, km: float = 2.0) -> DataFrame:
    """Cells with a boundary point within ``km``: squares of the tolerance make the radius an equi-join."""
    tol = km / 111.32
    square = lambda c, k: F.floor(F.col(c) * k / tol)
    near = boundary.select(F.col("lon").alias("blon"), F.col("lat").alias("blat"), square("lon", cos_lat).alias("bx"), square("lat", 1.0).alias("by"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = near.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("blon", "blat", (F.col("bx") + F.col("dx")).alias("sx"), (F.col("by") + F.col("dy")).alias("sy"))
    own = cells.withColumn("_x", square("lon", cos_lat)).withColumn("_y", square("lat", 1.0))
    far = ((F.col("lon") - F.col("blon")) * cos_lat) ** 2 + (F.col("lat") - F.col("blat")) ** 2
    return own.join(near, (F.col("_x") == F.col("sx")) & (F.col("_y") == F.col("sy")) & (far <= tol * tol), "left_semi").drop("_x", "_y")


def scene_area(cells: DataFrame, scene: list[str], mask: str, inside: str | None = None, cell_area: float | None = None) -> DataFrame:
    """Area, quadrature uncertainty and cell counts of the masked cells of each scene.

    ``inside``: a boolean column; other cells count for nothing but n_valid. Without a column water_area the
    area of a cell is its water fraction times ``cell_area``. The uncertainty is null for a scene without any.
    """
    within = F.lit(True) if inside is None else F.coalesce(F.col(inside), F.lit(False))
    on = F.col(mask) & within
    if "water_area" in cells.columns:
        area = F.col("water_area")
    elif cell_area is not None:
        area = F.col("water_frac") * float(cell_area)
    else:
        raise ValueError("water_area or cell_area is needed")
    uncert = F.col("uncert") if "uncert" in cells.columns else F.lit(None).cast("double")
    return cells.groupBy(*scene).agg(
        F.sum(F.when(on, F.coalesce(area, F.lit(0.0))).otherwise(0.0)).alias("area_m2"),
        F.when(F.count(uncert) > 0, F.sqrt(F.sum(F.when(on, F.coalesce(uncert**2, F.lit(0.0))).otherwise(0.0)))).alias("uncert_m2"),
        F.count_if(on).alias("n_cells"),
        F.count("water_frac").alias("n_valid"),
        F.count_if(F.col("water_frac").isNotNull() & within).alias("covered_cells"),
    )


def combine_scenes(scenes: DataFrame, boundary_cells: int | None, least: float = 0.9) -> DataFrame:
    """Scenes of a day that meet the boundary: summed area, quadrature of uncertainties, coverage ratio and partial
    flag. Where the cells of the boundary are not known, coverage is null and no day partial."""
    out = scenes.where((F.col("covered_cells") > 0) | (F.col("n_cells") > 0)).groupBy("day").agg(
        F.round(F.sum("area_m2") / 1e6, 3).alias("area_km2"), F.round(F.sqrt(F.sum(F.col("uncert_m2") ** 2)) / 1e6, 6).alias("uncert_km2"),
        F.count("*").alias("n_scenes"), F.sum("n_cells").alias("n_cells"), F.round(F.sum("covered_cells") / F.lit(boundary_cells).cast("double"), 6).alias("coverage"),
    )
    return out.withColumn("partial", F.coalesce(F.col("coverage") < least, F.lit(False)))


def outside_scenes(scenes: DataFrame) -> DataFrame:
    """day, n_outside: scenes of a day that do not meet the boundary."""
    return scenes.groupBy("day").agg(F.count_if((F.col("covered_cells") == 0) & (F.col("n_cells") == 0)).alias("n_outside"))


def block_of(cells: DataFrame, boundary: DataFrame, margin: float = 5000.0) -> DataFrame:
    """Cells whose x and y lie in the box of the boundary's, widened by ``margin`` metres."""
    box = boundary.agg(*(f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    inside = [F.col(c).between(F.col(f"_lo{c}") - margin, F.col(f"_hi{c}") + margin) for c in ("x", "y")]
    return cells.join(F.broadcast(box), inside[0] & inside[1]).select(*cells.columns)  # one row


def fraction_bins(cells: DataFrame, mask: str) -> DataFrame:
    """day, gy, gx, frac, opacity: the mean water fraction of the masked cells of each bin, and its opacity up to 205."""
    mean = cells.where(F.col(mask)).groupBy("day", "gy", "gx").agg(F.avg("water_frac").alias("frac"))
    return mean.withColumn("opacity", F.floor(F.greatest(F.least(F.col("frac"), F.lit(1.0)), F.lit(0.0)) * 205 + 1e-9).cast("int"))


def binned(cells: DataFrame, box: tuple[float, float, float, float], n: int) -> DataFrame:
    """Cells within ``box`` (lon0, lon1, lat0, lat1) with gy and gx on n x n points; those outside are dropped."""
    lon0, lon1, lat0, lat1 = box
    inside = F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1)
    return cells.where(inside).withColumn("gy", grid_index(F.col("lat"), lat0, lat1, n)).withColumn("gx", grid_index(F.col("lon"), lon0, lon1, n))


def relative_volume_error(depth: Column, area: Column) -> Column:
    return F.sqrt(depth**2 + area**2)


def lake_area(cells: DataFrame, boundary: DataFrame | None, cos_lat: float, box: tuple[float, float, float, float], n: int, zone: int | None = None, size: int = 5, km: float = 2.0) -> DataFrame:
    """The daily series: mask, majority filter, boundary, scenes, days, and areas without double counting.

    ``cells``: day, granule, iy, ix, lon, lat and the values, dense in each granule; with ``zone`` also utm_zone, of
    which at most the neighbours are taken. Without a boundary every cell is inside.
    """
    own = cells if zone is None else cells.where(F.abs(F.col("utm_zone") - zone) <= 1)
    masked = majority_filter(own.withColumn("mask", water_mask(F.col("water_frac"), F.col("qual"))), ["granule"], "mask", size)
    if boundary is None:
        masked, known = masked.withColumn("inside", F.lit(True)), None
    else:
        hit = inside_boundary(masked, boundary, cos_lat, km).select("granule", "iy", "ix", F.lit(True).alias("inside"))
        masked, known = masked.join(hit, ["granule", "iy", "ix"], "left"), boundary.count()
    days = combine_scenes(scene_area(masked, ["day", "granule"], "mask", "inside"), known)
    merged = merged_area(binned(masked.where("inside"), box, n), "mask").withColumnRenamed("area_km2", "merged_km2")
    return days.join(merged, "day", "left")


def grid_index(value: Column, lo: float, hi: float, n: int) -> Column:
    """Half-even index on n points from lo to hi, held within them."""
    return F.greatest(F.least(F.bround((value - lo) / (hi - lo) * (n - 1)), F.lit(n - 1.0)), F.lit(0.0)).cast("long")


def merged_area(cells: DataFrame, mask: str) -> DataFrame:
    """Daily area without double counting: per bin the sum within a scene, then the mean over scenes."""
    by_scene = cells.where(F.col(mask)).groupBy("day", "gy", "gx", "granule").agg(F.sum("water_area").alias("a"))
    bins = by_scene.groupBy("day", "gy", "gx").agg(F.avg("a").alias("mean_a"), F.sum("a").alias("all_a"), F.count("*").alias("n"))
    return bins.groupBy("day").agg(F.round(F.sum("mean_a") / 1e6, 6).alias("area_km2"), F.round(F.sum("all_a") / 1e6, 6).alias("scene_area_km2"), F.count_if(F.col("n") > 1).alias("overlap_bins"), (F.sum("all_a") / F.sum("mean_a") > 1.02).alias("overlaps"))


def cos_mean(lat: float) -> float:
    return math.cos(math.radians(lat))


def window_stats(cells: DataFrame, centres: DataFrame, key: list[str], value: str, reach: int) -> DataFrame:
    """cy, cx, ``key``, mean and n of ``value`` over the cells within ``reach`` rows and columns of each
    distinct centre (``cy``, ``cx``): centres are spread over their cells and joined on these."""
    step = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    own = centres.select("cy", "cx").distinct()
    spread = own.withColumn("iy", step("cy")).withColumn("ix", step("cx"))
    return cells.join(few_or_merged(spread, own.count() * (2 * reach + 1) ** 2), ["iy", "ix"]).groupBy("cy", "cx", *key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
