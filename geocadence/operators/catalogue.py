"""Catalogues of files and runs: what is new, what is missing, what belongs together, what is suspect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from .scenarios import PARAMS, parse_name


def select_granules(granules: DataFrame, pass_: str | None = None, resolution: str | None = None, tile: str | None = None) -> DataFrame:
    """Granules whose name holds all of the given parts, hidden files left out."""
    out = granules.where(~parse.is_junk(F.col("name")))
    for part in (pass_, resolution, tile):
        out = out if part is None else out.where(F.col("name").contains(part))
    return out


def parsed_granules(granules: DataFrame) -> DataFrame:
    """``granules`` with pass, resolution, tile and the acquisition time of their names."""
    part = lambda p, i: F.regexp_extract("name", p, i)
    orbit = r"_([0-9]{3})_([0-9]{3})_([0-9]{3}[FR])_"
    return granules.withColumns({"pass": part(orbit, 2), "resolution": part(r"_([0-9]+)m_", 1), "tile": part(orbit, 3), "acquired": parse.acquired(F.col("name"))})


def search_start(granules: DataFrame, days: int, start: str) -> DataFrame:
    """One row: newest (acquisition) and since, ``days`` before it, or ``start`` for an empty catalogue."""
    newest = granules.agg(F.max("acquired").alias("newest"))
    return newest.withColumn("since", F.coalesce(F.col("newest") - F.make_dt_interval(F.lit(days)), F.lit(start).cast("timestamp")))


def new_remote(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote granules (``granule``, ``names``) with a .nc name of which not all are in ``local`` (``name``)."""
    names = remote.select("granule", F.explode("names").alias("name")).where(F.col("name").endswith(".nc")).distinct()
    return names.join(local.select("name").distinct(), "name", "left_anti").select("granule").distinct()


def on_disk(files: DataFrame, present: DataFrame) -> DataFrame:
    """Entries (``key``, ``source``, ``path``) whose path still exists; keys without any are gone."""
    return files.join(present.select("path").distinct(), "path", "left_semi")


def classified(files: DataFrame, sign: str = "negative") -> DataFrame:
    """``files`` (path, head) with their parameters and class: junk, unnamed, bad_format or kept, the first that applies."""
    own = parse_name(files.withColumn("name", F.regexp_extract("path", "[^/]*$", 0)), sign=sign, parents="path")
    none = F.col(PARAMS[0]).isNull()
    return own.withColumn("class", F.when(parse.is_junk(F.col("path")), "junk").when(none, "unnamed").when(~parse.is_netcdf(F.col("head")), "bad_format").otherwise("kept"))


def class_report(files: DataFrame, samples: int = 10) -> DataFrame:
    """class, n and the first paths of each class of ``classified``."""
    ranked = files.groupBy("class").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("path")), 1, samples).alias("samples"))
    return ranked


def paired(files: DataFrame) -> DataFrame:
    """A row for each key of the kept files with its parameters and a map from source to path; of several paths of
    one source the last in order counts."""
    last = files.where("class = 'kept'").groupBy("key", "source").agg(F.max_by(F.struct("path", *PARAMS), "path").alias("f"))
    one = last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "f.path")))).alias("files"), F.min_by("f", "source").alias("f"))
    return one.select("key", *(F.col(f"f.{p}").alias(p) for p in PARAMS), "files")


def catalogue_counts(scenarios: DataFrame) -> DataFrame:
    """One row: n_scenarios, n_wave, n_flow and fill, the share of the full factorial of all parameter values."""
    has = lambda s: F.count_if(F.map_contains_key("files", F.lit(s)))
    kinds = [F.greatest(F.count_distinct(p), F.lit(1)) for p in PARAMS]
    return scenarios.agg(F.count("*").alias("n_scenarios"), has("wave").alias("n_wave"), has("flow").alias("n_flow"), (F.count("*") / (kinds[0] * kinds[1] * kinds[2] * kinds[3])).alias("fill"))


def freshness(granules: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: n_granules, last_granule and new_this_run, the distinct new files of all sites."""
    return granules.agg(F.count("*").alias("n_granules"), F.max("acquired").alias("last_granule")).crossJoin(extracted.agg(F.count_distinct("file").alias("new_this_run")))  # one row each


def size_estimate(scenarios: DataFrame, mesh: DataFrame, layers: dict[str, int]) -> DataFrame:
    """source, bytes: scenarios x cells x two bytes x layers of each source."""
    per = F.create_map(*(F.lit(x) for pair in layers.items() for x in pair))
    cells = mesh.groupBy("source").agg(F.count("*").alias("cells"))
    runs = scenarios.groupBy("source").agg(F.count_distinct("key").alias("runs"))
    return runs.join(cells, "source").select("source", (F.col("runs") * F.col("cells") * 2 * F.try_element_at(per, F.col("source"))).alias("bytes"))


def majority(runs: DataFrame, column: str) -> DataFrame:
    """source, and ``column``: its most frequent value; of equally frequent ones that of the smallest key."""
    counts = runs.where(F.col(column).isNotNull()).groupBy("source", column).agg(F.count("*").alias("n"), F.min("key").alias("k"))
    return counts.groupBy("source").agg(F.max_by(column, F.struct("n", -F.col("k"))).alias(column))


def check_runs(runs: DataFrame, required: dict[str, list[str]], sources: tuple[str, ...] = ("flow", "wave")) -> DataFrame:
    """key, problems: what is wrong with the outputs of a run, an array in a fixed order; runs without are left out.

    ``runs``: key, source, readable, vars (array), empty_dims (array), empty_vars (array), n_time, n_layer. Told
    are: a missing output, an unreadable file, an empty dimension, a missing variable, a variable without
    values, and a number of times or layers that is not the most frequent one of the source.
    """
    shape = majority(runs, "n_time").withColumnRenamed("n_time", "_t").join(majority(runs, "n_layer").withColumnRenamed("n_layer", "_l"), "source", "full")
    need = F.create_map(*(x for s, names in required.items() for x in (F.lit(s), F.array(*map(F.lit, names)))))
    told = lambda prefix, names: F.transform(names, lambda n: F.concat(F.lit(prefix), n))
    odd = lambda column, most, name: F.when(F.col(column) != F.col(most), F.concat(F.lit(name), F.col(column).cast("string")))
    lacking = F.array_except(F.try_element_at(need, F.col("source")), F.transform("vars", F.lower))
    single = F.array_compact(F.array(F.when(~F.col("readable"), F.lit("unreadable"))))
    late = F.array_compact(F.array(odd("n_time", "_t", "times "), odd("n_layer", "_l", "layers ")))
    own = F.when(F.col("readable"), F.concat(told("empty dimension ", F.col("empty_dims")), told("missing ", lacking), told("no values in ", F.col("empty_vars")), late)).otherwise(single)
    found = runs.join(shape, "source", "left").select("key", "source", F.transform(own, lambda p: F.concat(F.col("source"), F.lit(": "), p)).alias("p"))
    absent = F.array_except(F.array(*map(F.lit, sources)), F.collect_set("source"))
    all_ = found.groupBy("key").agg(F.flatten(F.array_sort(F.collect_list("p"))).alias("p"), told("no output of ", F.array_sort(absent)).alias("a"))
    return all_.select("key", F.concat("a", "p").alias("problems")).where(F.size("problems") > 0)


def first(df: DataFrame, order: list[str | Column], n: int | None) -> DataFrame:
    """The first ``n`` rows in order, or all."""
    return df if n is None else df.orderBy(*order).limit(n)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with one ``key`` (nulls are equal) the first in ``order``, which should tell them apart; null sorts first.
    Aggregated before the shuffle, so a key with many rows is no hot one."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return one.select(*(F.col("_first")[c].alias(c) if c in rest else F.col(c) for c in df.columns))


def distinct_names(*listings: DataFrame) -> DataFrame:
    """The names of all ``listings`` (name, other columns), each once."""
    names = [listing.select("name") for listing in listings]
    return reduce(DataFrame.unionByName, names).distinct()
