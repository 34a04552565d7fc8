"""Water-level series per site: bounds and quartile filters, datum, statistics, incremental files.

Counts and quartiles are aggregated for each group and joined back, a row for each group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _with(df: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """``df`` with the columns of ``stats``; groups with null keys meet, too."""
    renamed = stats.withColumnsRenamed({g: f"_key_{g}" for g in group})
    same = reduce(lambda a, b: a & b, (df[g].eqNullSafe(F.col(f"_key_{g}")) for g in group))
    return df.join(renamed, same).drop(*(f"_key_{g}" for g in group))


def bounds_filter(df: DataFrame, group: list[str], lo: float = -16.0, hi: float = 6.0, least: int = 4) -> DataFrame:
    """Keeps lo <= wse <= hi in groups of ``least`` rows or more; smaller groups pass."""
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return _with(df, counts, group).where((F.col("_n") < least) | F.col("wse").between(lo, hi)).drop("_n")


def _narrowed(known: DataFrame, ranks: DataFrame, group: list[str], ranges: int) -> DataFrame:
    """``ranks`` (group, _rank, _lo, _hi, _before) with the smallest and largest value of that of ``ranges`` equal parts of
    _lo.._hi that holds the rank, and the count of values below it."""
    spans = ranks.select(*group, "_lo", "_hi").distinct()
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges), F.lit(ranges - 1))).otherwise(0)
    inside = _with(known, spans, group).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    counts = inside.groupBy(*group, "_lo", "_hi", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    below = F.sum("_c").over(Window.partitionBy(*group, "_lo", "_hi").orderBy("_part")) - F.col("_c")  # at most ``ranges`` rows
    counts = counts.withColumn("_below", below)
    return _holding(ranks, counts, group).select(*group, "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_before") + F.col("_below")).alias("_before"))


def _holding(ranks: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    """Each rank with the row of ``counts`` (group, _lo, _hi, _below, _c) that holds it."""
    at = F.col("_rank") - F.col("_before")
    return _with(ranks, counts, [*group, "_lo", "_hi"]).where((at >= F.col("_below")) & (at < F.col("_below") + F.col("_c")))


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float], ranges: int = 4096) -> DataFrame:
    """``group`` and, by name, the exact quantiles of ``value`` with linear interpolation, as Spark's ``percentile`` gives
    them; nulls are left out, groups with nulls in their keys kept.

    No task holds the values of a group: counts in ``ranges`` equal parts tell which one holds a rank, and that
    again by its own smallest and largest value; within the part of a part then left, equal values are counted
    together. Each step is an aggregate that is combined before the shuffle, of at most ``ranges`` rows a rank.
    """
    known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_x"))
    stats = known.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    both = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(h), F.ceil(h)) for h in at.values()))))
    ranks = stats.select(*group, F.explode(both).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"))
    for _ in range(2):
        ranks = _narrowed(known, ranks, group, ranges)
    inside = _with(known, ranks.select(*group, "_lo", "_hi").distinct(), group).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    counts = inside.groupBy(*group, "_lo", "_hi", "_x").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_below", F.sum("_c").over(Window.partitionBy(*group, "_lo", "_hi").orderBy("_x")) - F.col("_c"))
    found = _holding(ranks, counts, group).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_v"))  # two ranks a quantile
    out = _with(stats, found, group)
    lo, hi = (lambda h: F.col("_v")[F.floor(h)]), (lambda h: F.col("_v")[F.ceil(h)])
    between = lambda h: F.when(F.floor(h) == F.ceil(h), lo(h)).otherwise((F.ceil(h) - h) * lo(h) + (h - F.floor(h)) * hi(h))
    return out.select(*group, *(between(h).alias(name) for name, h in at.items()))


def iqr_filter(df: DataFrame, group: list[str], least: int = 4, whisker: float = 1.5) -> DataFrame:
    """Keeps values within ``whisker`` interquartile ranges of the quartiles, in groups of ``least`` or more."""
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    q = _with(counts, quantiles(df, group, "wse", {"_a": 0.25, "_b": 0.75}), group)
    room = whisker * (F.col("_b") - F.col("_a"))
    return _with(df, q, group).where((F.col("_n") < least) | F.col("wse").between(F.col("_a") - room, F.col("_b") + room)).drop("_n", "_a", "_b")


def time_window(df: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Rows from ``since`` to ``until`` (epoch seconds, both included); with the midnight of a day as ``until`` its later hours drop out."""
    out = df if since is None else df.where(F.col("t") >= since)
    return out if until is None else out.where(F.col("t") <= until)


def on_day(df: DataFrame, day: str) -> DataFrame:
    """Rows of one UTC day, ``YYYY-MM-DD``."""
    return df.where(F.floor(F.col("t") / 86400) == F.datediff(F.lit(day).cast("date"), F.lit("1970-01-01").cast("date")))


def clean_series(df: DataFrame, group: list[str], since: int | None = None, until: int | None = None, offset: Column | float = 0.0) -> DataFrame:
    """Null drop, bounds, quartiles, time window, datum shift to three decimals."""
    out = time_window(iqr_filter(bounds_filter(df.where(F.col("wse").isNotNull()), group), group), since, until)
    return out.withColumn("wse", F.round(F.col("wse") + offset, 3))


def series_stats(df: DataFrame, group: list[str]) -> DataFrame:
    """n, min, max, first and last time and the latest value; of equal times the last file counts."""
    latest = F.max_by("wse", F.struct("t", "file"))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.min("wse").alias("min_wse"), F.max("wse").alias("max_wse"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), latest.alias("latest_wse"))


def new_files(catalogue: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Files that the cache does not hold with the same size (and, if it is a key, the same fingerprint)."""
    return catalogue.join(cached, keys, "left_anti")


def reassemble(extractions: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Cached values of files that still exist, without nulls."""
    return extractions.join(catalogue, keys, "left_semi").where(F.col("wse").isNotNull())


def incremental_extract(spark_path: str, files: DataFrame, extract, keys: list[str]) -> DataFrame:
    """Extracts the ``files`` that the table at ``spark_path`` does not hold under the same ``keys`` by ``extract``
    (a function of a DataFrame of files that keeps the keys), appends them there, rows without a value
    included, and gives the values of all files that are still there."""
    spark = files.sparkSession
    try:
        cached = spark.read.parquet(spark_path)
        todo = new_files(files, cached.select(*keys), keys)
    except Exception as e:  # no table yet: Spark tells by this condition
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = files
    extract(todo).write.mode("append").parquet(spark_path)
    return reassemble(spark.read.parquet(spark_path), files, keys)
