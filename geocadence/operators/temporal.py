"""As-of joins, trailing windows, unbroken runs and conditions at instants.

No window here holds all rows of a key: as-of joins run within blocks of time, to which the edge rows of
their neighbours are carried over; the others are aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(instants: DataFrame, obs: DataFrame, key: str, values: list[str], order: str = "id", span: int = 7 * 86400) -> DataFrame:
    """Adds the last row at or before and the first row after each instant.

    ``obs`` has ``key``, ``t``, ``order`` and ``values``; instants have ``key`` and ``t``. Gives structs
    ``back`` and ``ahead`` of (t, *values); of rows at one time the largest ``order`` is the last. Null
    times have neither. ``span``: seconds of a block of time.
    """
    row = F.struct("t", *values)
    both = obs.where(F.col("t").isNotNull()).select(key, "t", F.lit(0).alias("_k"), F.col(order).alias("_o"), row.alias("_row")).unionByName(
        instants.select(key, "t", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_o")), allowMissingColumns=True
    ).withColumn("_b", F.floor(F.col("t") / span))
    by = F.struct("t", "_k", "_o")
    blocks = both.groupBy(key, "_b").agg(F.max_by("_row", F.when(F.col("_k") == 0, by)).alias("_last"), F.min_by("_row", F.when(F.col("_k") == 0, by)).alias("_first"))
    w = Window.partitionBy(key).orderBy("_b")  # a row for each block of time
    carried = blocks.select(F.col(key).alias("_key"), F.col("_b").alias("_block"),
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inside = Window.partitionBy(key, "_b")
    back = F.last("_row", ignorenulls=True).over(inside.orderBy("t", "_k", "_o").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_row", ignorenulls=True).over(inside.orderBy(F.desc("t"), F.desc("_k"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_k = 1")
    found = found.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_block")), "left")
    return found.select(key, "t", F.coalesce("_back", "_before").alias("back"), F.coalesce("_ahead", "_after").alias("ahead"))


def nearest_row() -> Column:
    """Of ``back`` and ``ahead``, the closer to ``t``; ties go to the earlier."""
    closer = F.col("ahead.t") - F.col("t") < F.col("t") - F.col("back.t")
    return F.when(F.col("back").isNull() | closer, F.coalesce("ahead", "back")).otherwise(F.col("back"))


def _with(obs: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """``obs`` with the columns of ``stats``, a row for each key; null keys meet."""
    stats = stats.withColumnRenamed(key, "_key")
    return obs.join(stats, obs[key].eqNullSafe(F.col("_key")), "left").drop("_key")


def trailing(obs: DataFrame, seconds: int, key: str = "station") -> DataFrame:
    """Rows within ``seconds`` of the key's newest row."""
    newest = obs.groupBy(key).agg(F.max("t").alias("_m"))
    return _with(obs, newest, key).where(F.col("t") >= F.col("_m") - seconds).drop("_m")


def last_run(obs: DataFrame, phase: str, wanted: bool, key: str = "station", order: list[str] | None = None) -> DataFrame:
    """Rows of the last unbroken run in which ``phase`` is ``wanted``: those after the newest other row before the
    newest wanted one. Rows of another or no phase break a run."""
    at, on = F.struct(*(order or ["t", "id"])), F.col(phase).eqNullSafe(F.lit(wanted))
    newest = obs.groupBy(key).agg(F.max(F.when(on, at)).alias("_end"))
    ended = _with(obs, newest, key)
    breaks = ended.where(~on & (at < F.col("_end"))).groupBy(key).agg(F.max(at).alias("_break"))
    return _with(ended, breaks, key).where(on & (F.col("_break").isNull() | (at > F.col("_break")))).drop("_end", "_break")


def _preferred(rows: DataFrame, name: str, wanted: str | None) -> DataFrame:
    """One row: the wanted name if it has rows, else the first in order."""
    least = F.min(F.struct((~F.col(name).eqNullSafe(F.lit(wanted))).alias("other"), F.col(name).alias("name")))
    return rows.agg(least.alias("p")).select(F.col("p.name").alias(f"_{name}"))


def conditions_at(instants: DataFrame, obs: DataFrame, levels: DataFrame, station: str | None = None, site: str | None = None, offset: float = 0.0, convention: str = "from") -> DataFrame:
    """Wind and water level at each instant (``at``, epoch seconds; null: the latest).

    ``obs``: station, t, id, wind_spd_kmh, wind_dir_deg; ``levels``: site, t, file, wse. The named station and
    site count if they have data, else the first that have. Wind is of the observation nearest in time, ties
    to the earlier, and of observations of one time that with the largest ``id``; the level is the last at or before the instant, and the newest of all where there is none.
    Speeds become m/s with two decimals; with ``convention`` "to" directions are turned round. Returns at,
    wind_speed, wind_dir, wlvl and where they come from: station, obs_t, offset_min, site, level_t.
    """
    obs = obs.join(F.broadcast(_preferred(obs, "station", station)), F.col("station") == F.col("_station")).drop("_station")  # one row
    levels = levels.where("wse IS NOT NULL")
    levels = levels.join(F.broadcast(_preferred(levels, "site", site)), F.col("site") == F.col("_site")).drop("_site")
    values = ["wind_spd_kmh", "wind_dir_deg"]
    obs = obs.groupBy("station", "t").agg(F.max_by(F.struct("id", *values), "id").alias("_w")).select("station", "t", "_w.*")  # an archive has one row for each time
    newest = obs.groupBy("station").agg(F.max_by(F.struct("t", *values), F.struct("t", "id")).alias("_newest"))
    newest_level = levels.groupBy("site").agg(F.max_by(F.struct("t", "wse"), F.struct("t", "file")).alias("_newest"))
    asked = instants.select("at").distinct()
    one = lambda stats, key: asked.crossJoin(F.broadcast(stats))  # one row
    wind = one(newest, "station").withColumnRenamed("at", "t")
    picked = asof(wind, obs, "station", values).withColumn("_near", nearest_row()).distinct()
    wind = wind.join(picked.select(F.col("t").alias("_t"), "_near"), F.col("t").eqNullSafe(F.col("_t")), "left").select(F.col("t").alias("at"), "station", F.coalesce("_near", "_newest").alias("w"))
    level = one(newest_level, "site").withColumnRenamed("at", "t")
    before = asof(level, levels, "site", ["wse"], "file").distinct()
    level = level.join(before.select(F.col("t").alias("_t"), "back"), F.col("t").eqNullSafe(F.col("_t")), "left").select(F.col("t").alias("_at"), "site", F.coalesce("back", "_newest").alias("l"))
    turned = F.col("w.wind_dir_deg") if convention == "from" else F.pmod(F.col("w.wind_dir_deg") + 180.0, F.lit(360.0))
    found = asked.join(wind, asked["at"].eqNullSafe(wind["at"]), "left").select(asked["at"], "station", "w")
    return found.join(level, F.col("at").eqNullSafe(F.col("_at")), "left").select(
        "at", F.round(F.col("w.wind_spd_kmh") / 3.6, 2).alias("wind_speed"), turned.alias("wind_dir"), F.round(F.col("l.wse") + offset, 3).alias("wlvl"),
        "station", F.col("w.t").alias("obs_t"), F.coalesce(F.round((F.col("at") - F.col("w.t")) / 60.0), F.lit(0)).cast("long").alias("offset_min"), "site", F.col("l.t").alias("level_t"),
    )


def timeline(obs: DataFrame) -> DataFrame:
    """Distinct times at which any station has a wind speed."""
    return obs.where("wind_spd_kmh IS NOT NULL").select("t").distinct()


def archive_span(obs: DataFrame) -> DataFrame:
    """Hours between the first and the last observation of all stations."""
    return obs.agg(((F.max("t") - F.min("t")) / 3600.0).alias("hours"))
