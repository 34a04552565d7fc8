"""Scenario catalogues: grids, scales, coverage of a design, nearest scenario of observed conditions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geo
from ..sources.shared import shared_folder

PARAMS = ("wind_speed", "wind_dir", "wlvl", "salinity")


def parameter_values(scenarios: DataFrame) -> DataFrame:
    """Distinct values of each parameter in long form: param, value."""
    return scenarios.unpivot([], list(PARAMS), "param", "value").where(F.col("value").isNotNull()).distinct()


def parameter_scales(scenarios: DataFrame) -> DataFrame:
    """param, lo, hi, range (0 becomes 1; direction is 180), step: median gap between sorted values."""
    gap = F.col("value") - F.lag("value").over(Window.partitionBy("param").orderBy("value"))
    gaps = parameter_values(scenarios).withColumn("gap", gap)
    s = gaps.groupBy("param").agg(F.count("*").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile("gap", F.lit(0.5)).alias("step"))
    span = F.when(F.col("param") == "wind_dir", 180.0).when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return s.withColumn("scale", span)


#: Bits of a parameter's place within its range, and how many of them tell the cells of the first level; each split adds one.
_BITS, _FIRST = 14, {"wind_speed": 4, "wind_dir": 4, "wlvl": 4, "salinity": 0}
_DEEPEST = _BITS - max(_FIRST.values())


def _places(scenarios: DataFrame) -> DataFrame:
    """``scenarios`` with the place of each parameter within its range, and which of them are null."""
    linear = [p for p in PARAMS if p != "wind_dir"]
    span = scenarios.agg(*(f(p).alias(f"{f.__name__}_{p}") for p in linear for f in (F.min, F.max))).first()
    top = (1 << _BITS) - 1
    at = {"wind_dir": F.pmod(F.col("wind_dir"), F.lit(360.0)) / 360.0}
    for p in linear:
        lo, hi = span[f"min_{p}"], span[f"max_{p}"]
        at[p] = (F.col(p) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.0)
    nulls = [F.when(F.col(p).isNull(), 1 << i).otherwise(0) for i, p in enumerate(PARAMS)]
    places = {f"_at_{p}": F.coalesce(F.least(F.floor(v * (top + 1)), F.lit(top)), F.lit(0)).cast("long") for p, v in at.items()}
    return scenarios.withColumns(places).withColumn("_nulls", (nulls[0] + nulls[1] + nulls[2] + nulls[3]).cast("long"))


def _cell(level: int) -> Column:
    """The cell of a level: which parameters are null, then the first bits of each place."""
    out = F.col("_nulls")
    for p in PARAMS:
        out = out * (1 << _FIRST[p] + level) + F.shiftright(F.col(f"_at_{p}"), _BITS - _FIRST[p] - level)
    return out


def _boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """n and the bounds of each parameter in the cells of ``rows``, and whether a cell has any extent."""
    turned = lambda p: F.pmod(F.col(p), F.lit(360.0)) if p == "wind_dir" else F.col(p).cast("double")
    wide = [F.min(turned(p)) < F.max(turned(p)) for p in PARAMS]
    bounds = [f(turned(p)).alias(f"{n}_{p}") for p in PARAMS for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.greatest(*wide), F.lit(False)).alias("wide"), *bounds)


def _reach(t: dict[str, np.ndarray], box: dict[str, np.ndarray], scales: dict[str, float], cap_level: bool, lowest: float | None) -> list[np.ndarray]:
    """(least and greatest distance of targets from the scenarios of boxes, whether some and whether all of these are
    candidates). A null parameter of either side (NaN) adds nothing to a distance."""
    near = far = 0.0
    for p in PARAMS:
        lo, hi, at = box[f"lo_{p}"], box[f"hi_{p}"], t[p]
        if p == "wind_dir":
            at = at % 360
            a, b = (np.abs((e - at + 180) % 360 - 180) for e in (lo, hi))
            least = np.where((lo <= at) & (at <= hi), 0, np.minimum(a, b))
            back = (at + 180) % 360
            most = np.where((lo <= back) & (back <= hi), 180, np.maximum(a, b))
        else:
            least, most = np.maximum(np.maximum(lo - at, at - hi), 0), np.maximum(np.abs(lo - at), np.abs(hi - at))
        near, far = near + np.nan_to_num(least / scales[p]) ** 2, far + np.nan_to_num(most / scales[p]) ** 2
    some = sure = np.ones(np.shape(near), bool)
    if cap_level:
        level = t["wlvl"] + 1e-6
        none = level < (np.nan if lowest is None else lowest)
        some, sure = none | (box["lo_wlvl"] <= level), none | (box["hi_wlvl"] <= level)
    return [np.sqrt(near), np.sqrt(far), some, sure]


def _doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


_BOUNDS = [f"{f}_{p}" for p in PARAMS for f in ("lo", "hi")]
_FOUND = "level int, cell long, n long, open boolean, near double, far double, sure boolean"


def _near_cells(batches: Iterator[pa.RecordBatch], boxes: pa.Table, scales: dict[str, float], k: int, cap_level: bool, lowest: float | None) -> Iterator[pa.RecordBatch]:
    """A target with each cell of the first level that can hold one of its ``k`` nearest.

    Cells wholly within some distance hold ``k`` candidates or more; a cell that begins farther off has
    none of the nearest."""
    if not boxes.num_rows:
        return
    count, opens = boxes["n"].to_numpy(), boxes["open"].to_numpy()
    box = {b: _doubles(boxes[b])[None] for b in _BOUNDS}
    rows = max(1, (1 << 19) // len(count))
    for batch in batches:
        for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
            near, far, some, sure = _reach({p: _doubles(part.column(f"t_{p}"))[:, None] for p in PARAMS}, box, scales, cap_level, lowest)
            order = np.argsort(np.where(sure, far, np.inf), axis=1)
            held = np.cumsum(np.take_along_axis(np.where(sure, count[None], 0), order, axis=1), axis=1)
            last = np.take_along_axis(np.where(sure, far, np.inf), order, axis=1)
            limit = np.where(held[:, -1] >= k, last[np.arange(len(last)), (held >= k).argmax(axis=1)], np.inf)
            row, col = np.nonzero(some & (near <= limit[:, None] * (1 + 1e-9) + 1e-9))
            found = [np.zeros(len(row), np.int32), boxes["cell"].to_numpy()[col], count[col], opens[col], near[row, col], far[row, col], sure[row, col]]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in part.schema.names), *map(pa.array, found)], [*part.schema.names, *(x.split()[0] for x in _FOUND.split(", "))])


def _narrower(batches: Iterator[pa.RecordBatch], scales: dict[str, float], cap_level: bool, lowest: float | None) -> Iterator[pa.RecordBatch]:
    """The cells of targets, those that were split replaced by the parts with a candidate."""
    for batch in batches:
        near, far, some, sure = _reach({p: _doubles(batch.column(f"t_{p}")) for p in PARAMS}, {b: _doubles(batch.column(b)) for b in _BOUNDS}, scales, cap_level, lowest)
        part = batch.column("c_cell").is_valid()
        own = {"near": near, "far": far, "sure": sure}
        new = {c: pc.if_else(part, pa.array(own[c]) if c in own else batch.column(f"c_{c}"), batch.column(c)) for c in (x.split()[0] for x in _FOUND.split(", "))}
        names = [c for c in batch.schema.names if c.startswith("t_") or c == "target"]
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new.values()], [*names, *new])
        yield out.filter(pc.or_(pc.invert(part), pa.array(some)))


def _cells(spark: SparkSession, targets: DataFrame, few: DataFrame, most: int, **how: object) -> tuple[DataFrame, DataFrame]:
    """(``targets`` with level and cell of what can hold one of their nearest, ``few`` with their level and cell).

    A cell of over ``most`` scenarios is split in the middle of each parameter, level by level; after each split a
    target keeps the cells that begin before the distance within which ``k`` candidates are sure to lie. So the
    cells that a target meets depend on its neighbourhood, not on how large the catalogue is."""
    opens = ((F.col("n") > most) & F.col("wide")).alias("open")
    schema = T.StructType([*targets.schema.fields, *T.StructType.fromDDL(_FOUND)])
    rows = _places(few).withColumns({"level": F.lit(0), "cell": _cell(0)})
    boxes = _boxes(rows, "cell").select("cell", "n", opens, *_BOUNDS).toArrow()  # cells of the first level, whatever the size
    near = targets.mapInArrow(partial(_near_cells, boxes=boxes, **how), schema)
    split, level, k = boxes.filter(boxes["open"]).num_rows > 0, 0, how.pop("k")
    of = Window.partitionBy("target")
    while split and level < _DEEPEST:
        place, level = shared_folder(spark, "match-cells"), level + 1
        large = _boxes(rows.where(F.col("level") == level - 1), "cell").where(opens).select("cell", F.lit(True).alias("_split"))
        parted = rows.join(large.withColumn("level", F.lit(level - 1)), ["level", "cell"], "left")
        parted = parted.withColumn("_up", F.when(F.col("_split"), F.col("cell"))).withColumns({"level": F.when(F.col("_split"), level).otherwise(F.col("level")), "cell": F.when(F.col("_split"), _cell(level)).otherwise(F.col("cell"))}).drop("_split")
        parted.write.parquet(place)
        parted = spark.read.schema(parted.schema).parquet(place)
        parts = _boxes(parted.where(F.col("level") == level), "_up", "cell").select(F.col("_up"), F.lit(level).alias("c_level"), F.col("cell").alias("c_cell"), F.col("n").alias("c_n"), opens.alias("c_open"), *_BOUNDS)
        split, rows = not parts.where("c_open").isEmpty(), parted.drop("_up")
        joined = near.join(parts, (F.col("_up") == F.col("cell")) & (F.col("c_level") == F.col("level") + 1), "left")
        near = joined.mapInArrow(partial(_narrower, **how), schema)
        held = near.withColumn("_held", F.sum(F.when(F.col("sure"), F.col("n"))).over(of.orderBy("far")))
        limit = F.coalesce(F.min(F.when(F.col("_held") >= k, F.col("far"))).over(of), F.lit(float("inf")))
        near = held.withColumn("_limit", limit).where(F.col("near") <= F.col("_limit") * (1 + 1e-9) + 1e-9).select(*schema.names)
    return near.drop("n", "open", "near", "far", "sure"), rows.drop("_nulls", *(f"_at_{p}" for p in PARAMS))


def scales_of(scenarios: DataFrame, mode: str = "range") -> dict[str, float]:
    """The scale of each parameter by ``parameter_scales``, a row for each; with ``mode`` "step" the gap between values."""
    rows = {r["param"]: r for r in parameter_scales(scenarios).collect()}
    return {p: 1.0 if p not in rows else float((rows[p]["step"] if mode == "step" and p != "wind_dir" else rows[p]["scale"]) or 1.0) for p in PARAMS}


def match(targets: DataFrame, scenarios: DataFrame, scales: dict[str, float], k: int = 5, cap_level: bool = True, weights: dict[str, float] | None = None, most: int = 64) -> DataFrame:
    """The ``k`` nearest scenarios of each target: rank, key, dist, capped, level flag.

    ``weights`` multiply the scaled differences of parameters, 1 by default. With ``cap_level`` only levels at or below the target are candidates, unless there are none. Of equal
    scenarios the ``k`` smallest keys are enough. They lie in cells of ``most`` scenarios at most (if these differ at
    all), whose bounds tell for each target which cells can hold one of its nearest; targets meet the
    scenarios of these by an equi-join on the cell.
    """
    scales = {p: scales[p] / w if (w := (weights or {}).get(p, 1.0)) else float("inf") for p in PARAMS}
    low = scenarios.agg(F.min("wlvl").alias("lowest"), F.max("wlvl").alias("highest"))
    of = Window.partitionBy(*PARAMS).orderBy("key")
    few = scenarios.select("key", *PARAMS).withColumn("_i", F.row_number().over(of)).where(F.col("_i") <= k).drop("_i")
    t = targets.select("target", *(F.col(p).cast("double").alias(f"t_{p}") for p in PARAMS))
    near, few = _cells(targets.sparkSession, t, few, most, scales=scales, k=k, cap_level=cap_level, lowest=low.first()["lowest"])
    near = near.crossJoin(low)  # one row
    fits = F.col("wlvl") <= F.col("t_wlvl") + 1e-6
    none = F.col("t_wlvl") + 1e-6 < F.col("lowest")
    pairs = near.join(few, ["level", "cell"]).where(fits | none if cap_level else F.lit(True))
    terms = [F.coalesce(((geo.circular_delta(F.col(p), F.col(f"t_{p}")) if p == "wind_dir" else F.col(p) - F.col(f"t_{p}")) / scales[p]) ** 2, F.lit(0.0)) for p in PARAMS]
    dist = F.sqrt(terms[0] + terms[1] + terms[2] + terms[3])
    ranked = pairs.withColumn("dist", dist).withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("dist", "key"))).where(F.col("rank") <= k)
    flag = F.when(F.col("t_wlvl") < F.col("lowest"), "below").when(F.col("t_wlvl") > F.col("highest"), "above").otherwise("in")
    return ranked.select("target", "rank", "key", F.round("dist", 3).alias("dist"), (~none).alias("capped"), flag.alias("level_flag"))


def design_coverage(design: DataFrame, present: DataFrame, digits: int = 3) -> DataFrame:
    """One row: n_design, n_unique, n_done, n_missing, n_extra by rounded parameters."""
    sign = lambda df: df.select(*(F.round(p, digits).alias(p) for p in PARAMS))
    want, have = sign(design), sign(present).distinct()
    unique = want.distinct()
    both = unique.withColumn("w", F.lit(1)).unionByName(have.withColumn("h", F.lit(1)), allowMissingColumns=True).groupBy(*PARAMS).agg(F.max("w").alias("w"), F.max("h").alias("h"))
    counts = both.agg(F.count("w").alias("n_unique"), F.count_if(F.col("w").isNotNull() & F.col("h").isNotNull()).alias("n_done"), F.count_if(F.col("h").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_extra"))
    return want.agg(F.count("*").alias("n_design")).crossJoin(counts)


def parse_name(names: DataFrame, column: str = "name", sign: str = "negative", parents: str | None = None, strict: bool = True) -> DataFrame:
    """wind_speed, wind_dir, wlvl, salinity, source class and key of file names like wave_wind-sp1_0_wind-dir0_0_wlvl-7_0_sal250_0.nc.

    Decimals may follow ``_`` or a dot, or be left out. With ``sign`` "positive" the hyphen before a level is no minus.
    If a parameter is missing all four are null, unless not ``strict``. A name that does not begin with
    ``wave_`` is of the class that one of its three nearest folders in the path ``parents`` names, else flow.
    """
    number = lambda token: F.regexp_extract(column, rf"{token}([0-9]+(?:[_.][0-9]+)?)", 1)
    value = lambda token: F.nullif(F.regexp_replace(number(token), "_", "."), F.lit("")).cast("double")
    signed = lambda token: F.when(F.regexp_like(column, F.lit(rf"{token}-[0-9]")), -value(token + "-")).otherwise(value(token))
    values = {"wind_speed": signed("wind-sp"), "wind_dir": signed("wind-dir"), "wlvl": signed("wlvl") if sign == "negative" else value("wlvl-?"), "salinity": signed("sal")}
    whole = values["wind_speed"].isNotNull() & values["wind_dir"].isNotNull() & values["wlvl"].isNotNull() & values["salinity"].isNotNull()
    folders = F.lower(F.regexp_extract(parents, r"((?:[^/]*/){0,3})[^/]*$", 1)) if parents else F.lit("")
    source = F.when(F.col(column).startswith("wave_"), "wave").when(folders.contains("wave"), "wave").otherwise("flow")
    return names.select("*", *((F.when(whole, v) if strict else v).alias(p) for p, v in values.items()), source.alias("source"), F.regexp_replace(column, r"^wave_|\.nc$", "").alias("key"))


def envelope(matches: DataFrame, targets: DataFrame, scenarios: DataFrame, scales: dict[str, float]) -> DataFrame:
    """``matches`` of rank 1 with, for each parameter p, delta_p (target less scenario, three decimals) and flag_p (below,
    above or in the range of the scenarios; a direction is always in), and warnings: what is out of range, or
    within it but over 0.12 scales away. A level that was capped is not warned of."""
    span = scenarios.agg(*(f(p).alias(f"_{n}_{p}") for p in PARAMS for n, f in (("lo", F.min), ("hi", F.max))))
    best = matches.where("rank = 1").join(targets.select("target", *(F.col(p).cast("double").alias(f"_t_{p}") for p in PARAMS)), "target")
    best = best.join(scenarios.select("key", *(F.col(p).alias(f"_s_{p}") for p in PARAMS)), "key").join(F.broadcast(span))  # one row
    out, told = [], []
    for p in PARAMS:
        t, s, lo, hi = (F.col(f"_{k}_{p}") for k in ("t", "s", "lo", "hi"))
        both = t.isNotNull() & s.isNotNull()
        delta = F.round(geo.circular_delta(t, s) if p == "wind_dir" else t - s, 3)
        flag = F.when(both, F.lit("in") if p == "wind_dir" else F.when(t < lo, "below").when(t > hi, "above").otherwise("in"))
        out += [delta.alias(f"delta_{p}"), flag.alias(f"flag_{p}")]
        quiet = F.col("capped") if p == "wlvl" else F.lit(False)
        told.append(F.when(flag != "in", F.concat(F.lit(f"{p} "), flag, F.lit(" the simulated range"))).when((flag == "in") & ~quiet & (F.abs(delta) > 0.12 * scales[p]), f"{p} away from the closest scenario"))
    return best.select("target", "key", "dist", "capped", *out, F.array_compact(F.array(*told)).alias("warnings"))


def overridden(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """``targets`` with the values of ``overrides`` (target, and texts of parameters) in place of observed ones; a
    text that is no number is an error."""
    given = overrides.select("target", *(F.col(p).alias(f"_{p}") for p in PARAMS))
    value = lambda p: F.when(F.col(f"_{p}").isNotNull(), F.coalesce(F.col(f"_{p}").try_cast("double"), F.raise_error(F.concat(F.lit(f"{p} is no number: "), F.col(f"_{p}"))).cast("double"))).otherwise(F.col(p))
    return targets.join(given, "target", "left").withColumns({p: value(p) for p in PARAMS}).drop(*(f"_{p}" for p in PARAMS))


def missing_and_extra(design: DataFrame, present: DataFrame, digits: int = 3, samples: int = 10) -> DataFrame:
    """kind (missing or extra) with the first rounded parameter vectors of each kind."""
    sign = lambda df: df.select(*(F.round(p, digits).alias(p) for p in PARAMS)).distinct()
    want, have = sign(design), sign(present)
    both = want.exceptAll(have).withColumn("kind", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("kind", F.lit("extra")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct(*PARAMS))), 1, samples).alias("samples"))
