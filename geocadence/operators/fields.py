"""Model fields on curvilinear meshes: coordinates, masks, rotation, resampling to regular grids, smoothing, arrows.

A mesh has ``source``, ``cell``, ``iy``, ``ix``, ``lon``, ``lat``; fields refer to it by (source, cell). Weights of
target points are found once for each source and joined to all of its fields.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .extraction import nearest

#: What stands for no value in coordinates, variables whose zeros mean no value, the colour ramp.
FILL_LIMIT, SENTINELS = 1e30, (-999.999, -999.0, 999.999)
ZERO_IS_NONE = ("u1", "v1", "tauksi", "taueta", "taumax")
RAMP = [(0.00, 48, 18, 59), (0.13, 65, 69, 171), (0.25, 70, 117, 237), (0.38, 57, 162, 252), (0.50, 27, 207, 212), (0.63, 98, 252, 107), (0.75, 210, 233, 53), (0.88, 254, 155, 45), (0.96, 234, 74, 19), (1.00, 122, 4, 3)]
OPACITY = 205


# Coordinates

def no_coordinate(v: Column) -> Column:
    """Null, not finite, a fill value or close to a sentinel."""
    close = [F.abs(v - s) <= 1e-8 + 1e-5 * abs(s) for s in SENTINELS]
    return F.coalesce(F.isnan(v) | (F.abs(v) >= FILL_LIMIT) | close[0] | close[1] | close[2], F.lit(True))


def clean_coordinates(df: DataFrame, grid: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``x`` and ``y`` null where either holds no coordinate. An exact 0 is none if the grid's largest is over 1000,
    as in metres; the largest is aggregated for each grid and joined back."""
    size = lambda c: F.max(F.when(~no_coordinate(F.col(c)), F.abs(F.col(c))))
    scale = df.groupBy(*grid).agg((F.greatest(size(x), size(y)) > 1000).alias("_metres"))
    zero = F.coalesce(F.col("_metres"), F.lit(False)) & ((F.col(x) == 0) | (F.col(y) == 0))
    bad = no_coordinate(F.col(x)) | no_coordinate(F.col(y)) | zero
    return df.join(scale, grid).withColumn("_bad", bad).withColumn(x, F.when(~F.col("_bad"), F.col(x))).withColumn(y, F.when(~F.col("_bad"), F.col(y))).drop("_bad", "_metres")


def first_coordinates(df: DataFrame, preference: list[str], least: float = 0.01) -> DataFrame:
    """file, pair: the first pair of coordinates by ``preference`` of which ``least`` of the cells are valid and not
    all the same. ``df``: file, pair, x, y."""
    stats = clean_coordinates(df, ["file", "pair"]).groupBy("file", "pair").agg(
        F.count("x").alias("n"), F.count("*").alias("all"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("spread"))
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("pair"))
    usable = stats.where((F.col("n") > 0) & (F.col("n") >= least * F.col("all")) & (F.col("spread") > 0) & (rank > 0))
    return usable.groupBy("file").agg(F.min_by("pair", rank).alias("pair"))


def preferred_field(df: DataFrame, rank: Column) -> DataFrame:
    """file, name: the field of least (``rank``, off the coordinates, name). ``df``: file, name, on_coords."""
    return df.groupBy("file").agg(F.min_by("name", F.struct(rank, (~F.col("on_coords")).alias("off"), "name")).alias("name"))


def full_grid(df: DataFrame, grid: list[str]) -> DataFrame:
    """``grid``, regular: whether all cells (iy, ix, x, y) are valid and x is that of its column, y that of its row,
    within a millionth of the larger span of the axes."""
    columns = df.groupBy(*grid, "ix").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min_by("x", "iy").alias("axis"), F.count_if(F.col("x").isNull()).alias("none"))
    rows = df.groupBy(*grid, "iy").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.min_by("y", "ix").alias("axis"), F.count_if(F.col("y").isNull()).alias("none"))
    off = lambda: F.max(F.greatest(F.col("hi") - F.col("axis"), F.col("axis") - F.col("lo")))
    side = lambda t, n: t.groupBy(*grid).agg(off().alias(f"off{n}"), (F.max("axis") - F.min("axis")).alias(f"span{n}"), F.sum("none").alias(f"none{n}"))
    both = side(columns, 0).join(side(rows, 1), grid)
    span = F.greatest("span0", "span1")
    limit = F.when(span > 0, span).otherwise(1.0) * 1e-6
    return both.select(*grid, F.coalesce((F.col("none0") == 0) & (F.col("none1") == 0) & (F.greatest("off0", "off1") <= limit), F.lit(False)).alias("regular"))


def clip_extent(lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column, asked: tuple[float, float, float, float]) -> Column:
    """The part of the domain within ``asked`` (the same four bounds), or null if there is none."""
    a, b, c, d = F.greatest(lon_min, F.lit(asked[0])), F.least(lon_max, F.lit(asked[1])), F.greatest(lat_min, F.lit(asked[2])), F.least(lat_max, F.lit(asked[3]))
    return F.when((a < b) & (c < d), F.struct(a.alias("lon_min"), b.alias("lon_max"), c.alias("lat_min"), d.alias("lat_max")))


def far_from(lon: Column, lat: Column, centre: tuple[float, float], degrees: float = 2.0) -> Column:
    """A warning if a domain's centre is farther than ``degrees`` from where it should be, else null."""
    off = F.sqrt((lon - centre[0]) ** 2 + (lat - centre[1]) ** 2)
    return F.when(off > degrees, F.format_string("domain centre is %.2f degrees off", off))


# Masks and slices

def mask_zero(value: Column, name: Column, policy: str = "auto") -> Column:
    """Zeros become null: always (``true``), never (``false``), or for variables that write them for no value (``auto``)."""
    masked = {"true": F.lit(True), "false": F.lit(False)}.get(policy, F.lower(name).isin(*ZERO_IS_NONE))
    return F.when(~(masked & (value == 0)) | value.isNull(), value)


def wet_mask(value: Column, level: Column | None = None) -> Column:
    """In water: a level or depth that is finite and not 0; without that variable, a value over 0."""
    on = (value > 0) if level is None else (level != 0) & (F.abs(level) < float("inf"))
    return F.coalesce(on, F.lit(False))


def clamped_index(index: Column, size: Column) -> Column:
    """An index from 0, counted from the end if negative, held within the dimension; an empty one is an error."""
    held = F.greatest(F.least(F.when(index < 0, index + size).otherwise(index), size - 1), F.lit(0))
    return F.when(size > 0, held).otherwise(F.raise_error(F.lit("empty dimension")).cast("long")).cast("long")


def spatial_variables(variables: DataFrame, coordinates: list[str]) -> DataFrame:
    """Variables (``name``, ``dims``, ``long_name``) of two spatial dimensions or more that are no coordinates, with
    ``extra`` dimensions and ``has_time``."""
    from ..functions.parse import dim_role, field_label

    spatial = F.filter("dims", lambda d: dim_role(d) == "other")
    kept = variables.where((F.size(spatial) >= 2) & ~F.lower("name").isin(*(c.lower() for c in coordinates)))
    return kept.withColumn("label", field_label(F.col("name"), F.col("long_name"))).withColumn("extra", F.filter("dims", lambda d: dim_role(d) != "other")).withColumn("has_time", F.exists("dims", lambda d: dim_role(d) == "time"))


# Vectors

def gradient(df: DataFrame, line: list[str], along: str, value: str, out: str) -> DataFrame:
    """Central differences along an axis, one-sided at both ends."""
    w = Window.partitionBy(*line).orderBy(along)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    return df.withColumn(out, F.when(first & last, F.lit(None).cast("double")).when(first, after - own).when(last, own - before).otherwise((after - before) / 2))


def rotation_terms(mesh: DataFrame, grid: list[str], zone: Column) -> DataFrame:
    """``mesh`` (grid, iy, ix, x, y, lon, lat) with cos_a and sin_a of the grid's angle to true north: that of
    its last axis plus the meridian convergence."""
    g = gradient(gradient(mesh, [*grid, "iy"], "ix", "x", "_dx"), [*grid, "iy"], "ix", "y", "_dy")
    angle = F.atan2("_dy", "_dx") + F.radians(geo.convergence(F.col("lon"), F.col("lat"), zone))
    return g.withColumn("cos_a", F.cos(angle)).withColumn("sin_a", F.sin(angle)).drop("_dx", "_dy")


def to_true_north(fields: DataFrame, mesh: DataFrame, key: list[str]) -> DataFrame:
    """``fields`` (u, v along the grid) with ue, vn, speed and bearing, by the mesh's rotation terms."""
    turned = fields.join(mesh.select(*key, "cos_a", "sin_a"), key)
    ue, vn = F.col("u") * F.col("cos_a") - F.col("v") * F.col("sin_a"), F.col("u") * F.col("sin_a") + F.col("v") * F.col("cos_a")
    turned = turned.withColumn("ue", ue).withColumn("vn", vn).drop("cos_a", "sin_a")
    return turned.withColumn("speed", F.hypot("ue", "vn")).withColumn("bearing", geo.bearing(F.col("ue"), F.col("vn")))


def wave_bearing(direction: Column, convention: str = "from") -> Column:
    """Where waves go to, of the direction they come from or go to."""
    return F.pmod(direction + (180.0 if convention == "from" else 0.0), F.lit(360.0))


# Regular grids

def mesh_boxes(mesh: DataFrame) -> DataFrame:
    """source, lon0, lon1, lat0, lat1."""
    return mesh.groupBy("source").agg(F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))


def clipped_boxes(mesh: DataFrame, asked: tuple[float, float, float, float]) -> DataFrame:
    """``mesh_boxes`` within ``asked`` (lon0, lon1, lat0, lat1); a source that has no part in it is an error."""
    part = clip_extent(F.col("lon0"), F.col("lon1"), F.col("lat0"), F.col("lat1"), asked)
    held = F.when(part.isNotNull(), part).otherwise(F.raise_error(F.lit(f"nothing lies within {asked}")).cast("struct<lon_min: double, lon_max: double, lat_min: double, lat_max: double>"))
    return mesh_boxes(mesh).select("source", held.alias("e")).select("source", *(F.col(f"e.{a}").alias(b) for a, b in (("lon_min", "lon0"), ("lon_max", "lon1"), ("lat_min", "lat0"), ("lat_max", "lat1"))))


def target_grid(mesh: DataFrame, n: int, box: DataFrame | None = None) -> DataFrame:
    """source, gy, gx, lon, lat and kx: n x n points over the extent of each source, or its ``box``; kx shrinks longitudes
    to the scale of latitudes."""
    box = mesh_boxes(mesh) if box is None else box
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda a, b, g: F.col(a) + (F.col(b) - F.col(a)) * F.col(g) / (n - 1)
    grid = box.withColumn("gy", axis()).withColumn("gx", axis())
    return grid.select("source", "gy", "gx", at("lon0", "lon1", "gx").alias("lon"), at("lat0", "lat1", "gy").alias("lat"), F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2)).alias("kx"))


def nearest_weights(targets: DataFrame, mesh: DataFrame, step: float | None = None, scale: float = 1.0) -> DataFrame:
    """source, gy, gx, cell: the mesh cell nearest to each target, longitudes times ``scale``."""
    found = nearest(targets, mesh.select("source", "cell", "iy", "ix", "lon", "lat"), ["gy", "gx"], ["source"], ["iy", "ix"], step, scale)
    return found.select("source", "gy", "gx", F.col("cell.cell").alias("cell"))


def linear_weights(mesh: DataFrame, n: int, box: DataFrame | None = None) -> DataFrame:
    """source, gy, gx, cell, w: weights of the three corners of the triangle that each point of the n x n target grid
    (of ``box``, if given) lies in; points outside all have none.

    Each quad of neighbouring cells is cut in two along one diagonal. A triangle goes straight to the targets
    of its box, as the grid is regular; a target on an edge takes the first triangle.
    """
    box = mesh_boxes(mesh) if box is None else box
    corner = F.struct("cell", "lon", "lat")
    own = mesh.where("lon IS NOT NULL AND lat IS NOT NULL").select("source", "iy", "ix", corner.alias("c"))
    shifted = lambda dy, dx, name: own.select("source", (F.col("iy") - dy).alias("iy"), (F.col("ix") - dx).alias("ix"), F.col("c").alias(name))
    at = ["source", "iy", "ix"]
    quads = own.join(shifted(0, 1, "d"), at).join(shifted(1, 0, "e"), at)
    far = own.join(shifted(0, 1, "d"), at).join(shifted(1, 0, "e"), at).join(shifted(1, 1, "f"), at)
    halves = quads.select(*at, F.lit(0).alias("half"), F.col("c").alias("p"), F.col("d").alias("q"), F.col("e").alias("r"))
    halves = halves.unionByName(far.select(*at, F.lit(1).alias("half"), F.col("f").alias("p"), F.col("d").alias("q"), F.col("e").alias("r"))).join(F.broadcast(box), "source")  # a row for each source
    xs, ys = [F.col(f"{k}.lon") for k in "pqr"], [F.col(f"{k}.lat") for k in "pqr"]
    place = lambda v, a, b: (v - F.col(a)) / (F.col(b) - F.col(a)) * (n - 1)

    def covered(vs: list[Column], a: str, b: str) -> Column:
        lo, hi = F.greatest(F.ceil(place(F.least(*vs), a, b) - 1e-9), F.lit(0)), F.least(F.floor(place(F.greatest(*vs), a, b) + 1e-9), F.lit(n - 1))
        return F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))

    hit = halves.withColumn("gx", covered(xs, "lon0", "lon1")).withColumn("gy", covered(ys, "lat0", "lat1"))
    x, y = F.col("lon0") + (F.col("lon1") - F.col("lon0")) * F.col("gx") / (n - 1), F.col("lat0") + (F.col("lat1") - F.col("lat0")) * F.col("gy") / (n - 1)
    area = (ys[1] - ys[2]) * (xs[0] - xs[2]) + (xs[2] - xs[1]) * (ys[0] - ys[2])
    wp = ((ys[1] - ys[2]) * (x - xs[2]) + (xs[2] - xs[1]) * (y - ys[2])) / area
    wq = ((ys[2] - ys[0]) * (x - xs[2]) + (xs[0] - xs[2]) * (y - ys[2])) / area
    hit = hit.where(area != 0).withColumn("wp", wp).withColumn("wq", wq).withColumn("wr", 1 - F.col("wp") - F.col("wq")).where("wp >= -1e-9 AND wq >= -1e-9 AND wr >= -1e-9")
    corners = F.array(*(F.struct(F.col(f"{k}.cell").alias("cell"), F.col(f"w{k}").alias("w")) for k in "pqr"))
    one = hit.groupBy("source", "gy", "gx").agg(F.min_by(corners, F.struct("iy", "ix", "half")).alias("k"))
    return one.select("source", "gy", "gx", F.explode("k").alias("k")).select("source", F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), "k.cell", "k.w")


def resample(fields: DataFrame, key: list[str], weights: DataFrame, near: DataFrame) -> DataFrame:
    """``key``, source, gy, gx, z: the field (``key``, source, cell, value, wet) at the targets, null where the nearest
    cell is dry or the target lies outside the mesh. Null values count as 0, as do those of dry cells."""
    values = fields.join(weights, ["source", "cell"]).groupBy(*key, "source", "gy", "gx").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("z"))
    gate = fields.where("wet").join(near, ["source", "cell"]).select(*key, "source", "gy", "gx")
    return values.join(gate, [*key, "source", "gy", "gx"], "left_semi")


def in_metres(mesh: DataFrame) -> DataFrame:
    """``mesh`` with x and y in place of lon and lat, so that grids and weights are in metres."""
    return mesh.withColumns({"lon": F.col("x"), "lat": F.col("y")})


def currents(fields: DataFrame, mesh: DataFrame, key: list[str], n: int, bounds: tuple[float, float, float, float] | None = None, least: float = 1e-6) -> DataFrame:
    """``key``, source, gy, gx, x, y, u, v, speed, bearing on n x n points in metres over the mesh, or over its part within
    ``bounds`` (x0, x1, y0, y1; an error if there is none).

    ``fields``: key, source, cell, u, v, wet. Both components are interpolated in the triangle that holds a
    point; a point whose nearest cell is dry, or outside the mesh, has no row. Speeds under ``least`` are null, as is their
    bearing. Weights belong to the mesh: they are found once and joined to all layers.
    """
    flat = in_metres(mesh)
    box = clipped_boxes(flat, bounds) if bounds else mesh_boxes(flat)
    targets, weights = target_grid(flat, n, box), linear_weights(flat, n, box)
    near = nearest_weights(targets, flat)
    at = ["source", "gy", "gx"]
    mixed = lambda c: F.sum(F.col("w") * F.coalesce(c, F.lit(0.0))).alias(c)
    values = fields.join(weights, ["source", "cell"]).groupBy(*key, *at).agg(mixed("u"), mixed("v"))
    gate = fields.where("wet").join(near, ["source", "cell"]).select(*key, *at)
    out = values.join(gate, [*key, *at], "left_semi").join(targets.select(*at, F.col("lon").alias("x"), F.col("lat").alias("y")), at)
    moves = F.hypot("u", "v") >= least
    return out.select(*key, *at, "x", "y", "u", "v", F.when(moves, F.hypot("u", "v")).alias("speed"), F.when(moves, geo.bearing(F.col("u"), F.col("v"))).alias("bearing"))


def current_map(fields: DataFrame, mesh: DataFrame, key: list[str], n: int, arrows: int, bounds: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(speeds on n x n points, arrows on a grid of their own of ``arrows`` x ``arrows`` points, where it moves); see ``currents``."""
    moving = currents(fields, mesh, key, arrows, bounds).where("speed IS NOT NULL")
    return currents(fields, mesh, key, n, bounds).drop("u", "v", "bearing"), moving.select(*key, "source", "gy", "gx", "x", "y", F.pmod(F.round("bearing", 2), F.lit(360.0)).alias("bearing"), F.round("speed", 5).alias("speed"))


def map_layer(fields: DataFrame, mesh: DataFrame, key: list[str], n: int, sigma: float = 0.0, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(``key``, source, gy, gx, z of each layer; its ``layer_stats`` with the frame of its image): values interpolated, dry
    ones left out, smoothed."""
    targets = target_grid(mesh, n)
    z = resample(fields, key, linear_weights(mesh, n), nearest_weights(targets, mesh, None, scale))
    z = smooth(z, [*key, "source"], n, n, sigma)
    frame = image_bounds(*map(F.col, ("lon0", "lon1", "lat0", "lat1")), n).alias("frame")
    return z, layer_stats(z, [*key, "source"]).join(mesh_boxes(mesh).select("source", frame), "source")


DIMENSIONS = ("time", "layer", "constituent")


def write_model_cells(cells: DataFrame, path: str) -> None:
    """Cells (key, name, time, layer, constituent, cell, value) by time, layer and constituent; a dimension that a variable
    lacks is 0."""
    cells.repartition(*DIMENSIONS).write.mode("overwrite").partitionBy(*DIMENSIONS).parquet(path)


def dimension_sizes(cells: DataFrame) -> DataFrame:
    """key, name, n_time, n_layer, n_constituent."""
    return cells.groupBy("key", "name").agg(*((F.max(c) + 1).alias(f"n_{c}") for c in DIMENSIONS))


def hyperslab(cells: DataFrame, sizes: DataFrame, asked: DataFrame, small: int = 10_000) -> DataFrame:
    """The cells of each slab of ``asked`` (key, name, time, layer, constituent, other columns): indices count from the end
    if negative and are held within the ``sizes`` of the variable; an empty dimension is an error. A null index is 0.

    The indices are joined to the columns that the table is partitioned by. If up to ``small`` slabs are asked for, only the
    folders of their times, layers and constituents are read, and the slabs broadcast.
    """
    held = asked.join(sizes, ["key", "name"])
    held = held.withColumns({c: clamped_index(F.coalesce(c, F.lit(0)), F.col(f"n_{c}")).cast("int") for c in DIMENSIONS}).drop(*(f"n_{c}" for c in DIMENSIONS))
    cells = cells.withColumns({c: F.col(c).cast("int") for c in DIMENSIONS})
    if asked.limit(small + 1).count() > small:
        return cells.join(held, ["key", "name", *DIMENSIONS])
    wanted = held.agg(*(F.collect_set(c).alias(c) for c in DIMENSIONS)).first()  # of up to ``small`` slabs
    for c in DIMENSIONS:
        cells = cells.where(F.col(c).isin(wanted[c]))
    return cells.join(F.broadcast(held), ["key", "name", *DIMENSIONS])


def read_field(cells: DataFrame, mesh: DataFrame, variables: DataFrame, asked: DataFrame, n: int | None = None, policy: str = "auto") -> DataFrame:
    """One field of each run as a map: the preferred variable of a run (``variables``: file as the key, name, long_name, on_coords),
    its slab at the indices of ``asked`` (key, time, layer, constituent), zeros that mean no value as nulls, with
    the coordinates of its cells, or with ``n`` on n x n points over the mesh. Nulls have no row on the grid."""
    from ..functions.parse import field_rank

    chosen = preferred_field(variables, field_rank(F.col("name"), F.col("long_name"))).withColumnRenamed("file", "key")
    slab = hyperslab(cells, dimension_sizes(cells), asked.join(chosen, "key"))
    slab = slab.withColumn("value", mask_zero(F.col("value"), F.col("name"), policy))
    if n is None:
        return slab.join(mesh.select("source", "cell", "lon", "lat"), ["source", "cell"])
    known, key = slab.where("value IS NOT NULL").withColumn("wet", F.lit(True)), ["key", "name", *DIMENSIONS]
    return resample(known, key, linear_weights(mesh, n), nearest_weights(target_grid(mesh, n), mesh))


def gaussian(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of the kernel, cut at four sigma."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i - r, w / sum(raw)) for i, w in enumerate(raw)]


def _convolved(value: Callable[[Column], Column], n: int, kernel: list[tuple[int, float]]) -> Column:
    """The array of the values at 0 to n - 1 by the kernel, the line reflected at both ends, as often as the kernel is longer
    than it. ``value`` gives that at a place."""
    r, half = kernel[-1][0], [w for o, w in kernel if o >= 0]

    def mirrored(i: Column) -> Column:
        turn = F.pmod(i, F.lit(2 * n))
        return value(F.least(turn, 2 * n - 1 - turn))

    def at(wide: Column) -> Column:
        def target(i: Column) -> Column:  # the kernel is the same on both sides
            out = F.get(wide, i) * half[0]
            for o in range(1, r + 1):
                out = out + (F.get(wide, i - o) + F.get(wide, i + o)) * half[o]
            return out

        return F.transform(F.sequence(F.lit(r), F.lit(n - 1 + r)), target)

    wide = F.transform(F.sequence(F.lit(-r), F.lit(n - 1 + r)), mirrored)
    return F.get(F.transform(F.array(wide), at), F.lit(0))  # an array of one, so that ``wide`` is made once and not for each place


def _blur(df: DataFrame, line: list[str], along: str, n: int, sigma: float, sums: list[str]) -> DataFrame:
    """Each line as one row of arrays, convolved there. One shuffle, by the line, serves both aggregates."""
    kernel = gaussian(sigma)
    cells = df.repartition(*line).groupBy(*line, along).agg(*(F.sum(s).alias(s) for s in sums))
    lines = cells.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct(along, F.struct(*sums)))).alias("_cells"))
    held = lambda s: lambda i: F.coalesce(F.try_element_at("_cells", i)[s], F.lit(0.0))
    arrays = lines.select(*line, *(_convolved(held(s), n, kernel).alias(s) for s in sums))
    out = arrays.select(*line, F.posexplode(F.arrays_zip(*sums)).alias(along, "_v"))
    return out.select(*line, along, *(F.col("_v")[s].alias(s) for s in sums))


def smooth(df: DataFrame, key: list[str], ny: int, nx: int, sigma: float = 2.0) -> DataFrame:
    """``z`` of (key, gy, gx) by a Gaussian that leaves nulls out of its means and keeps them null; no row is a null.

    Separable: along x, then along y, for the sum of values and that of weights.
    """
    if not sigma:
        return df
    known = df.where("z IS NOT NULL").select(*key, F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), F.col("z").alias("num"), F.lit(1.0).alias("den"))
    out = _blur(_blur(known, [*key, "gy"], "gx", nx, sigma, ["num", "den"]), [*key, "gx"], "gy", ny, sigma, ["num", "den"])
    means = out.where("den > 0").select(*key, F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), (F.col("num") / F.col("den")).alias("_z"))
    return df.join(means, [*key, "gy", "gx"], "left").withColumn("z", F.when(F.col("z").isNotNull(), F.col("_z"))).drop("_z")


def layer_stats(grid: DataFrame, key: list[str], vmin: float | None = None, vmax: float | None = None) -> DataFrame:
    """zmin, zmax, p99, n_valid, n_wet (of a column ``wet``, if there is one) and the colour bounds of each layer: 0 or ``vmin``
    up to ``vmax``, else the 99th percentile, else (if that is 0 or none) the maximum, else 1; never an empty range. The
    percentile's buffer holds one layer grid; ``series.quantiles`` is for groups without a bound."""
    wet = [F.count_if("wet").alias("n_wet")] if "wet" in grid.columns else []
    s = grid.groupBy(*key).agg(*wet, F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.percentile("z", F.lit(0.99)).alias("p99"), F.count("z").alias("n_valid"))
    lo = F.lit(0.0 if vmin is None else float(vmin))
    hi = F.lit(float(vmax)) if vmax is not None else F.coalesce(F.nullif("p99", F.lit(0.0)), "zmax", F.lit(1.0))
    return s.withColumn("vmin", lo).withColumn("vmax", F.when(hi <= lo, lo + 1e-6).otherwise(hi))


def image_bounds(lon0: Column, lon1: Column, lat0: Column, lat1: Column, n: int) -> Column:
    """The frame of an image of n x n points: half a step around them."""
    dx, dy = (lon1 - lon0) / max(1, n - 1) / 2, (lat1 - lat0) / max(1, n - 1) / 2
    return F.struct((lon0 - dx).alias("west"), (lon1 + dx).alias("east"), (lat0 - dy).alias("south"), (lat1 + dy).alias("north"))


def thinned(df: DataFrame, axis: str, n: int, most: int) -> DataFrame:
    """Every s-th line of an axis of ``n``, s = max(1, n // most)."""
    return df.where(F.col(axis) % max(1, n // most) == 0)


def sub_indices(n: int, k: int) -> list[int]:
    """min(k, n) indices spread evenly over 0..n-1, halves to even."""
    k = min(k, n)
    return [round(i * (n - 1) / (k - 1)) for i in range(k)] if k > 1 else [0]


def coarse_grid(grid: DataFrame, ny: int, nx: int, size: int = 48) -> DataFrame:
    """The rows of a layer grid on a coarser one: gy and gx become its indices."""
    pick = lambda c, n: F.array_position(F.array(*map(F.lit, sub_indices(n, size))), F.col(c)) - 1
    return grid.withColumn("_y", pick("gy", ny)).withColumn("_x", pick("gx", nx)).where("_y >= 0 AND _x >= 0").drop("gy", "gx").withColumnsRenamed({"_y": "gy", "_x": "gx"})


def grid_lookup(points: DataFrame, grid: DataFrame, box: tuple[float, float, float, float], ny: int, nx: int) -> DataFrame:
    """``points`` (lon, lat) with z of the nearest point of a grid over ``box`` (lon0, lon1, lat0, lat1); null outside."""
    lon0, lon1, lat0, lat1 = box
    inside = F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1)
    at = lambda v, a, b, n: F.when(inside, F.floor((F.col(v) - a) / (b - a) * (n - 1) + 0.5).cast("int"))
    asked = points.withColumn("gy", at("lat", lat0, lat1, ny)).withColumn("gx", at("lon", lon0, lon1, nx))
    return asked.join(grid.select("gy", "gx", "z"), ["gy", "gx"], "left").drop("gy", "gx")


# Arrows and colours

def arrows(fields: DataFrame, key: list[str], targets: DataFrame, weights: DataFrame, near: DataFrame) -> DataFrame:
    """key, source, gy, gx, lon, lat, bearing, value: an arrow at each target whose nearest cell is wet and moves,
    inside the mesh. ``fields``: key, source, cell, value, wet, ue, vn."""
    value = fields.join(weights, ["source", "cell"]).groupBy(*key, "source", "gy", "gx").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))
    moving = fields.where("wet").join(near, ["source", "cell"]).where(F.hypot("ue", "vn") > 0).select(*key, "source", "gy", "gx", geo.bearing(F.col("ue"), F.col("vn")).alias("bearing"))
    out = moving.join(value, [*key, "source", "gy", "gx"]).join(targets.select("source", "gy", "gx", "lon", "lat"), ["source", "gy", "gx"])
    return out.select(*key, "source", "gy", "gx", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.pmod(F.round("bearing", 2), F.lit(360.0)).alias("bearing"), F.round("value", 5).alias("value"))


def pack_arrows(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """key with arrays i (gy * n + gx, in order), b (one decimal) and v (four decimals): one row for each layer of n x n."""
    at = (F.col("gy") * n + F.col("gx")).alias("i")
    packed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(at, F.round("bearing", 1).alias("b"), F.round("value", 4).alias("v")))).alias("a"))
    return packed.select(*key, F.col("a.i").alias("i"), F.col("a.b").alias("b"), F.col("a.v").alias("v"))


def unpack_arrows(packed: DataFrame, key: list[str], n: int) -> DataFrame:
    """The inverse of ``pack_arrows``."""
    each = packed.select(*key, F.explode(F.arrays_zip("i", "b", "v")).alias("a"))
    return each.select(*key, F.floor(F.col("a.i") / n).cast("int").alias("gy"), (F.col("a.i") % n).cast("int").alias("gx"), F.col("a.b").alias("bearing"), F.col("a.v").alias("value"))


def ramp(t: Column) -> Column:
    """red, green, blue (0 to 255, cut) and alpha of a value scaled to 0..1; null is transparent."""
    held = F.greatest(F.least(F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))

    def channel(k: int) -> Column:
        out = F.lit(float(RAMP[-1][k]))
        for a, b in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
            out = F.when(held <= b[0], a[k] + (b[k] - a[k]) * (held - a[0]) / (b[0] - a[0])).otherwise(out)
        return F.floor(out + 1e-9).cast("int")

    return F.struct(channel(1).alias("red"), channel(2).alias("green"), channel(3).alias("blue"), F.when(t.isNull() | F.isnan(t), 0).otherwise(OPACITY).alias("alpha"))


def common_bounds(layers: DataFrame, sample: int = 40, configured: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """layer, vmin, vmax: 0 and the 95th percentile of the maxima of every k-th scenario, at most ``sample`` of them in
    the order of their keys; configured bounds win. ``layers``: key, layer, zmax."""
    keys = layers.select("key").distinct()
    n = keys.count()
    place = F.row_number().over(Window.orderBy("key")) - 1  # a row for each scenario
    probe = keys.withColumn("_i", place).where(F.col("_i") % max(1, n // sample) == 0).where(F.col("_i") / max(1, n // sample) < sample).select("key")
    own = layers.join(probe, "key", "left_semi").groupBy("layer").agg(F.percentile("zmax", F.lit(0.95)).alias("hi"))
    lo, hi = F.lit(0.0), F.coalesce("hi", F.lit(1.0))
    for layer, (a, b) in (configured or {}).items():
        lo, hi = F.when(F.col("layer") == layer, float(a)).otherwise(lo), F.when(F.col("layer") == layer, float(b)).otherwise(hi)
    return layers.select("layer").distinct().join(own, "layer", "left").select("layer", lo.alias("vmin"), hi.alias("vmax"))
