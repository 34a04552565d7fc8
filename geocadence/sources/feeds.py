"""Readers: file listings, rasters by a decoder, station feeds, designs and snapshots; errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import parse

#: Columns of a design and the parameters that they hold.
DESIGN = {"wind_sp": "wind_speed", "wind_dir": "wind_dir", "wlvl": "wlvl", "sal": "salinity"}
READING = "aifstime_utc string, local_date_time_full string, air_temp string, rel_hum string, wind_dir string, wind_spd_kmh string, gust_kmh string, rain_trace string, press_qnh string, press string"
FEED = f"observations struct<data: array<struct<{READING.replace(' string', ': string')}>>>"


def list_files(spark: SparkSession, folder: str, suffix: str = ".nc", part: str | None = None, head: bool = False) -> DataFrame:
    """path (relative), name, size and modified of all files below ``folder``, hidden ones and those of system folders
    left out; with ``head`` their first four bytes. Contents are not read otherwise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    place = folder.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), place, -1)
    out = files.select(path.alias("path"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.substring("content", 1, 4).alias("head")] if head else []))
    out = out.where(F.col("name").endswith(suffix) & ~parse.is_junk(F.col("path")))
    return out if part is None else out.where(F.col("name").contains(part))


def read_rasters(files: DataFrame, decode: Callable[[str], pd.DataFrame], schema: str) -> DataFrame:
    """Cells of the files (``path``) by ``decode``, which reads one file into a frame of ``schema``'s columns, and
    ``path`` and ``error``: a file that can't be read gives one row with the error and nulls else."""
    fields = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    yield decode(path)[fields].assign(path=path, error=None)
                except Exception as e:  # told as data
                    yield pd.DataFrame([{**dict.fromkeys(fields), "path": path, "error": f"{type(e).__name__}: {e}"}])

    return files.select("path").mapInPandas(run, f"{schema}, path string, error string")


class FileSource(DataSource):
    """``spark.read.format("decoded_files").option("paths", "a\\nb")`` with a decoder of the subclass: a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "decoded_files"

    @staticmethod
    def decode(path: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> DataSourceReader:
        source = self

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(p) for p in source.options.get("paths", "").split("\n") if p]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                yield from source.decode(partition.value)

        return Reader()


def failures(rows: DataFrame) -> DataFrame:
    """path and error of the files that could not be read."""
    return rows.where("error IS NOT NULL").select("path", "error").distinct()


def fail_if_systematic(rows: DataFrame, least: int = 12) -> None:
    """Raises if all files failed, or all of the first ``least`` in order: a fault of the setup, not of files."""
    by_file = rows.groupBy("path").agg(F.max("error").alias("error"))
    total, bad = by_file.agg(F.count("*"), F.count("error")).first()
    early = [r["error"] for r in by_file.orderBy("path").limit(least).collect()]
    if total and (bad == total or len(early) == least and all(early)):
        raise RuntimeError(f"{bad} of {total} files failed, first: {early[0]}")


def reading(o: Column, source: str = "bom") -> list[Column]:
    """The columns kept of one reading of a feed."""
    number = lambda name: parse.number(o[name]).alias(name)
    return [
        F.lit(source).alias("src"), o["aifstime_utc"].alias("utc"), parse.station_time(o["aifstime_utc"]).alias("ts"), number("air_temp"), number("rel_hum"),
        F.nullif(o["wind_dir"], F.lit("")).alias("wind_dir"), parse.compass_degrees(o["wind_dir"]).alias("wind_dir_deg"), number("wind_spd_kmh"), number("gust_kmh"),
        parse.number(o["rain_trace"]).alias("rain_since_9am"), parse.first_pressure(parse.number(o["press_qnh"]), parse.number(o["press"])).alias("press_hpa"),
    ]


def parse_feed(payloads: DataFrame, text: str = "value", source: str = "bom") -> DataFrame:
    """A row for each reading of the feeds: ``station`` (if given) and the columns of ``reading``, with latest, true
    for the first of a feed, and its local_time. Readings without a time count only as the latest. A feed that is
    empty or no JSON gives no row."""
    keys = [c for c in payloads.columns if c != text]
    data = F.from_json(text, FEED)["observations"]["data"]
    each = payloads.select(*keys, F.posexplode(data).alias("pos", "o"))
    latest = F.col("pos") == 0
    return each.where(latest | F.coalesce(F.col("o.aifstime_utc") != "", F.lit(False))).select(*keys, *reading(F.col("o"), source), latest.alias("latest"), F.when(latest, F.col("o.local_date_time_full")).alias("local_time"))


def read_feed(spark: SparkSession, folder: str, source: str = "bom") -> DataFrame:
    """``parse_feed`` of all JSON files of a folder; the station is the file's name without its ending."""
    files = spark.read.text(folder, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^./]*$", 1).alias("station"))
    return parse_feed(files, source=source)


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """A design as CSV with a header and perhaps a byte-order mark: its four parameters, empty rows left out."""
    raw = spark.read.csv(path, header=True)
    clean = raw.toDF(*(c.strip("﻿ ").lower() for c in raw.columns))
    return clean.select(*(F.trim(c).try_cast("double").alias(p) for c, p in DESIGN.items())).dropna(how="all")


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with a known schema; no rows if there is no such file."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:  # Spark tells a missing path by this condition
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
