"""Station archives and wind roses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo


def merge_archive(previous: DataFrame, fresh: DataFrame, now: int | None, hours: int = 168) -> DataFrame:
    """Previous and fresh rows of one provenance, one per (station, t), fresh first, within ``hours`` before ``now``
    (null: all).

    Rows of a provenance that the fresh batch does not have never merge; a null time is kept.
    """
    known = fresh.select(F.col("src").alias("_s")).distinct()
    old = previous.join(known, F.col("src").isNull() | (F.col("src") == F.col("_s")), "left_semi")
    both = fresh.withColumn("_f", F.lit(1)).unionByName(old.withColumn("_f", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("station", "t").orderBy(F.desc("_f"), F.desc("id")))
    kept = both.withColumn("_r", first).where("_r = 1").drop("_f", "_r")
    return kept if now is None else kept.where(F.col("t").isNull() | (F.col("t") >= now - hours * 3600))


def stale_fallback(stations: DataFrame, fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Each station's fresh row, else its previous one marked stale."""
    joined = stations.join(fresh.select("station", F.struct("t", "air_temp").alias("f")), "station", "left").join(previous.select("station", F.struct("t", "air_temp").alias("p")), "station", "left")
    pick = F.coalesce("f", "p")
    return joined.select("station", pick["t"].alias("t"), pick["air_temp"].alias("air_temp"), (F.col("f").isNull() & F.col("p").isNotNull()).alias("stale"))


def rose_keys(obs: DataFrame) -> DataFrame:
    """Readings with a speed, and their sector and speed bin; both are -1 where it is calm or the direction unknown."""
    calm = (F.col("wind_spd_kmh") <= 0) | F.col("wind_dir_deg").isNull()
    sector, speed = geo.sector(F.col("wind_dir_deg")), geo.speed_bin(F.col("wind_spd_kmh"))
    return obs.where(F.col("wind_spd_kmh").isNotNull()).withColumn("sector", F.when(calm, -1).otherwise(sector)).withColumn("bin", F.when(calm, -1).otherwise(speed))


def wind_rose(obs: DataFrame) -> DataFrame:
    """Share in percent of each (sector, speed bin) of all readings with a speed; calm is sector -1."""
    counts = rose_keys(obs).groupBy("station", "sector", "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("station"))  # 81 rows of a station at most
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 6))


def largest_sector(rose: DataFrame) -> DataFrame:
    """station, percent: the largest total of a sector, calm left out; it scales the plot."""
    sectors = rose.where("sector >= 0").groupBy("station", "sector").agg(F.sum("percent").alias("p"))
    return sectors.groupBy("station").agg(F.max("p").alias("percent"))
