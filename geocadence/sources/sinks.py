"""Writers: nested payloads, CSV with a commented head, layers, and the packed store of model fields."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, parse
from ..operators import fields as maps
from ..operators.fields import clamped_index


# Payloads

def series_payload(series: DataFrame) -> DataFrame:
    """site, series (array of t, file, wse in the order of t and file), latest, stats: a row for each site."""
    row = F.struct("t", "file", parse.finite(F.col("wse")).alias("wse"))
    nested = series.groupBy("site").agg(F.array_sort(F.collect_list(row)).alias("series"))
    times, values = F.col("series.t"), F.array_compact(F.col("series.wse"))
    stats = F.struct(F.size("series").alias("n"), F.array_min(values).alias("min"), F.array_max(values).alias("max"), F.array_min(times).alias("first_t"), F.array_max(times).alias("last_t"))
    return nested.select("site", "series", F.element_at("series", -1).alias("latest"), stats.alias("stats"))


def area_payload(days: DataFrame) -> DataFrame:
    """One row: the daily series in order, with its first and last day and their number."""
    row = F.struct("day", *(parse.finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in days.dtypes if c != "day"))
    return days.agg(F.array_sort(F.collect_list(row)).alias("series"), F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document for each row; non-finite numbers must have become null before."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


# CSV

def csv_lines(df: DataFrame, columns: dict[str, Column], head: list[str], order: list[str]) -> DataFrame:
    """part, seq and line: ``head`` as lines with # (part 0), the names of ``columns`` (part 1), then a line for each
    row (part 2) whose seq is a struct of ``order``; nulls are empty, cells are quoted where needed."""
    spark, key = df.sparkSession, F.struct(*order)
    line = F.concat_ws(",", *(parse.csv_cell(c.cast("string")) for c in columns.values()))
    body = df.select(F.lit(2).alias("part"), key.alias("seq"), line.alias("line"))
    top = [(0, i, f"# {h}") for i, h in enumerate(head)] + [(1, 0, ",".join(columns))]
    first = spark.createDataFrame(top, "part int, i int, line string").select("part", "i", "line")
    return first.unionByName(body, allowMissingColumns=True)


def write_csv_lines(lines: DataFrame, path: str) -> None:
    """The lines in order; ``spark.read.option("comment", "#").csv`` reads them back."""
    lines.orderBy("part", "i", "seq").select("line").write.mode("overwrite").text(path)


def write_by_site(series: DataFrame, path: str) -> None:
    """A folder of CSV for each site."""
    series.write.mode("overwrite").partitionBy("site").option("header", True).csv(path)


def write_suspects(problems: DataFrame, path: str) -> None:
    """key and its problems joined by `` ; ``, as CSV."""
    problems.select("key", F.concat_ws(" ; ", "problems").alias("problems")).write.mode("overwrite").option("header", True).csv(path)


# Layers

def slim_index(scenarios: DataFrame, parameters: list[str]) -> DataFrame:
    """key and parameters without paths."""
    return scenarios.select("key", *parameters)


def write_layers(arrows: DataFrame, bounds: DataFrame, path: str) -> None:
    """Packed arrows (key, layer, i, b, v) by layer, and the bounds used for each layer."""
    arrows.write.mode("overwrite").partitionBy("layer").json(f"{path}/arrows")
    bounds.write.mode("overwrite").json(f"{path}/manifest")


_EXPORTS = "seq long, export string, schema string, n_scenarios long, n_missing long, ny int, nx int, n_arrows int, n_coarse int, scales array<struct<layer: int, vmin: double, vmax: double>>, frames array<struct<source: string, west: double, east: double, south: double, north: double>>"


def layer_documents(grid: DataFrame, arrows: DataFrame, ny: int, nx: int, n_arrows: int, n_coarse: int = 48, fixed: DataFrame | None = None) -> DataFrame:
    """key, layer, source, zmin, zmax, n_valid, the colour bounds used (vmin, vmax; those of ``fixed`` (layer, vmin, vmax), if
    given), packed arrows (i, b, v) and a coarse grid (ci: gy * width + gx, cz to four decimals; dry points left out).

    ``grid``: key, source, layer, gy, gx, z of ``ny`` x ``nx`` points. A layer without any arrow or coarse point has empty
    arrays; one without any value has no document. All arrays are bounded by their grids.
    """
    key = ["key", "layer"]
    docs = maps.layer_stats(grid, [*key, "source"]).where("n_valid > 0").drop("p99", "n_wet")
    if fixed is not None:
        docs = docs.drop("vmin", "vmax").join(F.broadcast(fixed), "layer")  # a row for each layer
    point = F.struct((F.col("gy") * min(n_coarse, nx) + F.col("gx")).cast("int").alias("i"), F.round("z", 4).alias("z"))
    coarse = maps.coarse_grid(grid.where("z IS NOT NULL AND NOT isnan(z)"), ny, nx, n_coarse).groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("_c"))
    packed = maps.pack_arrows(arrows, key, n_arrows).withColumn("i", F.col("i").cast("array<int>"))
    out = docs.join(packed, key, "left").join(coarse, key, "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return out.withColumns({"i": none("i", "int"), "b": none("b", "double"), "v": none("v", "double"), "ci": none(F.col("_c.i"), "int"), "cz": none(F.col("_c.z"), "double")}).drop("_c")


def export_layers(grid: DataFrame, arrows: DataFrame, mesh: DataFrame, scenarios: DataFrame, parameters: list[str], path: str, ny: int, nx: int, n_arrows: int, n_coarse: int = 48, fixed: bool = False, sample: int = 40, configured: dict[str, tuple[float, float]] | None = None) -> str:
    """The layers of all ``scenarios`` (key, ``parameters``) for a site that only reads files; gives the export's name.

    A folder of its own holds the documents of ``layer_documents``, partitioned by layer, the slim index of the scenarios that
    have any, and the colour bounds common to all scenarios; with ``fixed`` documents are coloured by these. The
    manifest gets its row when all of that is written, so readers never see a part of an export and, until then, see
    the one before. It counts the scenarios without any layer. A name serves one export; what broke off is left behind
    unread.
    """
    spark = grid.sparkSession
    seq = _known(spark, f"{path}/manifest", _EXPORTS).agg(F.max("seq")).first()[0]
    name = uuid.uuid4().hex[:16]
    place, asked = f"{path}/export={name}", slim_index(scenarios, parameters)
    here = grid.join(asked.select("key"), "key", "left_semi")
    maxima = here.groupBy("key", "layer").agg(F.max("z").alias("zmax"))
    maps.common_bounds(maxima, sample, configured).select(F.col("layer").cast("int").alias("layer"), "vmin", "vmax").write.parquet(f"{place}/scales")
    scales = spark.read.parquet(f"{place}/scales")
    docs = layer_documents(here, arrows, ny, nx, n_arrows, n_coarse, scales if fixed else None)
    docs.repartition("layer", "key").write.partitionBy("layer").option("compression", "zstd").parquet(f"{place}/layers")
    held = spark.read.schema(docs.schema).parquet(f"{place}/layers").select("key").distinct()
    asked.join(held, "key", "left_semi").write.parquet(f"{place}/index")
    frames = maps.mesh_boxes(mesh).select("source", maps.image_bounds(*map(F.col, ("lon0", "lon1", "lat0", "lat1")), max(ny, nx)).alias("f")).select("source", "f.*")
    n, most = spark.read.parquet(f"{place}/index").count(), scenarios.count()
    about = ((seq or 0) + 1, name, docs.schema.json(), n, most - n, ny, nx, n_arrows, n_coarse, sorted(map(tuple, scales.collect())), sorted(map(tuple, frames.collect())))  # a row for each layer and source
    spark.createDataFrame([about], _EXPORTS).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return name


def read_export(spark: SparkSession, path: str, layer: int | None = None) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, layer documents, index) of the newest whole export, or of one of its layers, of which only the folder is
    read; an error if there is none."""
    about = _known(spark, f"{path}/manifest", _EXPORTS).orderBy(F.desc("seq")).first()
    if about is None:
        raise ValueError("no export")
    place = f"{path}/export={about['export']}"
    docs = spark.read.schema(T.StructType.fromJson(json.loads(about["schema"]))).parquet(f"{place}/layers")  # there may be no file
    return about.asDict(), docs if layer is None else docs.where(F.col("layer") == layer), spark.read.parquet(f"{place}/index")


# Packed store

def packed_fields(fields: DataFrame, scales: dict[str, float]) -> DataFrame:
    """``fields`` with each variable of ``scales`` as a smallint multiple of its scale; nulls stay null."""
    return fields.withColumns({v: geo.pack_int16(F.col(v), s) for v, s in scales.items()})


def clip_counts(fields: DataFrame, scales: dict[str, float]) -> DataFrame:
    """variable, clipped: values that the smallint range can't hold."""
    counts = [F.count_if(F.abs(F.bround(F.col(v) / s)) > 32767).alias(v) for v, s in scales.items()]
    return fields.agg(*counts).unpivot([], list(scales), "variable", "clipped")


_MANIFEST = "seq long, version string, scales map<string,double>, layers array<struct<source: string, layer: int>>"
_KEYS = "source string, key string, cells long"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # Spark tells by this condition
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _published(spark: SparkSession, path: str) -> dict | None:
    """The newest row of the manifest."""
    last = _known(spark, f"{path}/manifest", _MANIFEST).orderBy(F.desc("seq")).first()
    return last.asDict() if last else None


def store_version(fields: DataFrame, mesh: DataFrame, scales: dict[str, float]) -> tuple[str, list]:
    """(name of the version, its layers): what all keys of a version have in common, the scales, the layers of each source
    and the mesh. The mesh counts by the sum of its rows' hashes, in any order."""
    layers = sorted((r["source"], r["layer"]) for r in fields.select("source", F.col("layer").cast("int").alias("layer")).distinct().collect())  # a row for each layer
    marks = mesh.agg(F.count("*"), F.sum(F.xxhash64(*sorted(mesh.columns)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((sorted(scales.items()), layers, tuple(marks))).encode()).hexdigest()[:16], layers


def write_store(fields: DataFrame, mesh: DataFrame, path: str, scales: dict[str, float], replace: bool = False) -> str:
    """Packed ``fields`` (source, key, layer, cell, variables), the mesh once, and a manifest; gives the version's name.

    All keys of a version have the same scales, layers and mesh. Others start a new version in a folder of its
    own, so rows packed in different ways never lie together. Keys are written whole, each its own partition,
    and noted as finished behind that: a write that broke off is taken up with the keys that are not, which
    replace what is left of them. Finished keys are passed over, or with ``replace`` written again whole. The
    manifest gets a row when all is written; until then readers see the version before.
    """
    spark = fields.sparkSession
    version, layers = store_version(fields, mesh, scales)
    place, known = f"{path}/version={version}", _published(spark, path)
    if _known(spark, f"{place}/keys", _KEYS).isEmpty():
        mesh.write.mode("overwrite").parquet(f"{place}/mesh")
    todo = fields if replace else fields.join(finished(spark, place), ["source", "key"], "left_anti")
    out = packed_fields(todo, scales).repartition("source", "key").sortWithinPartitions("source", "key", "layer", "cell")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source", "key").parquet(f"{place}/fields")
    done = todo.groupBy("source", F.col("key").cast("string").alias("key")).agg(F.count("*").alias("cells"))
    done.write.mode("append").parquet(f"{place}/keys")
    if not known or known["version"] != version:
        row = ((known["seq"] if known else 0) + 1, version, {v: float(s) for v, s in scales.items()}, layers)
        spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def finished(spark: SparkSession, place: str) -> DataFrame:
    """source, key of what a version's folder holds whole."""
    return _known(spark, f"{place}/keys", _KEYS).select("source", "key").distinct()


def read_store(spark: SparkSession, path: str, source: str | None = None, key: str | None = None, layer: int | None = None, version: str | None = None) -> DataFrame:
    """Unpacked fields of the newest version, or of ``version``, with the coordinates of their cells; keys are strings. A
    layer is an index of the stored layers, from the end if negative, held within them; the layer numbers stay those of the
    model. A slice without any value is an error, as is a store without a version. Only finished keys are read, and of
    these, with ``source`` and ``key``, only their partitions."""
    held = _known(spark, f"{path}/manifest", _MANIFEST)
    about = (held if version is None else held.where(F.col("version") == version)).orderBy(F.desc("seq")).first()
    if about is None:
        raise ValueError("no such store")
    place, scales = f"{path}/version={about['version']}", about["scales"]
    rows = spark.read.parquet(f"{place}/fields").withColumn("key", F.col("key").cast("string")).join(finished(spark, place), ["source", "key"], "left_semi")
    rows = rows if source is None else rows.where(F.col("source") == source)
    rows = rows if key is None else rows.where(F.col("key") == str(key))
    if layer is not None:
        stored = spark.createDataFrame([tuple(x) for x in about["layers"]], "source string, layer int").groupBy("source").agg(F.array_sort(F.collect_set("layer")).alias("_all"))  # a row for each layer
        at = stored.select("source", F.element_at("_all", (clamped_index(F.lit(layer), F.size("_all")) + 1).cast("int")).alias("layer"))
        rows = rows.join(F.broadcast(at), ["source", "layer"], "left_semi")  # a row for each source
    out = rows.withColumns({v: F.col(v) * s for v, s in scales.items()})
    if key is not None and out.where(F.coalesce(*scales).isNotNull()).isEmpty():
        raise ValueError(f"all cells of {key} are dry")
    return out.join(spark.read.parquet(f"{place}/mesh"), ["source", "cell"])


def roundtrip_errors(fields: DataFrame, stored: DataFrame, scales: dict[str, float], factor: float = 3.0) -> DataFrame:
    """variable, worst, good: the largest difference between what was written and what is read, and whether it is
    within ``factor`` scales. Values that were clipped count, too."""
    both = fields.withColumn("key", F.col("key").cast("string")).alias("a").join(stored.alias("b"), ["source", "key", "layer", "cell"])
    worst = both.agg(*(F.max(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))).alias(v) for v in scales)).unpivot([], list(scales), "variable", "worst")
    limit = F.create_map(*(F.lit(x) for v, s in scales.items() for x in (v, factor * s)))
    return worst.withColumn("good", F.coalesce(F.col("worst") <= F.try_element_at(limit, F.col("variable")), F.lit(True)))
