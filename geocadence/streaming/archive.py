"""Streams of observations and scenes.

Streams run to the end of what has arrived (``availableNow``) and go on from their checkpoint at the next call.
What must be kept (readings, the cells of scenes, states of files) is a log: each batch writes its own rows only, and of
rows with one key those of the newest batch count. Windows and sessions are Spark's own stateful aggregates
with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import raster, weather


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", idle: bool = True) -> None:
    """Hands every micro-batch of what has arrived to ``each`` and returns. ``idle``: also run batches without data, which
    close windows; off for streams with timers of processing time, where such batches never end."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(idle).lower())
    try:
        started = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)  # the stream has its own copy
    started.awaitTermination()


class Log:
    """The rows of a stream as they came: a folder for each batch, within it one for each value of ``parts``. A batch that is
    run again replaces its own folder, so nothing is counted twice; no batch rewrites what others wrote."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, *parts: str):
        self.spark, self.path, self.schema, self.parts = spark, path, schema, parts

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        """All rows, with their ``batch``; none before the first one."""
        schema = T.StructType([*self.schema.fields]).add("batch", "long")
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # Spark tells a missing path by this condition
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)


def newest(rows: DataFrame, key: list[str], *then: str) -> DataFrame:
    """Of the rows with one ``key`` (nulls are equal) that of the newest batch, of the largest ``then`` within it."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("batch", *then)).alias("_last"))
    return last.select(*key, *(F.col("_last")[c].alias(c) for c in rest))


def stream_archive(obs: DataFrame, path: str, checkpoint: str, hours: int = 168) -> DataFrame:
    """The rolling archive of a stream of readings (station, id, t, src, …): re-delivered times overwrite (in one delivery
    the largest id), readings older than ``hours`` before the newest go, provenances never mix, and a reading without one gives
    way to one that has it. Returns the table; only the days within ``hours`` are read for it."""
    spark, day = obs.sparkSession, F.floor(F.col("t") / 86400)
    log = Log(spark, path, T.StructType([*obs.schema.fields]).add("_day", "long"), "_day")
    run(obs.withColumn("_day", day), checkpoint, log.write)
    top = log.read().agg(F.max("_day"), F.max("t")).first()[1]
    held = log.read()
    if top is not None:
        since = top - hours * 3600
        held = held.where(F.col("_day").isNull() | (F.col("_day") >= since // 86400)).where(F.col("t").isNull() | (F.col("t") >= since))
    last = newest(held, ["station", "t", "src"], "id").select(*obs.columns)
    known = last.where("src IS NOT NULL").select("station", "t").distinct()
    return last.where("src IS NOT NULL").unionByName(last.where("src IS NULL").join(known, ["station", "t"], "left_anti").select(*obs.columns))


def stream_rose(obs: DataFrame, checkpoint: str, path: str, width: str = "7 days", slide: str = "1 day", late: str = "168 hours") -> DataFrame:
    """Counts of sector and speed bin in sliding windows of a stream (station, ts, wind_spd_kmh, wind_dir_deg). Each batch
    writes the counts that it changed."""
    keyed = weather.rose_keys(obs.withWatermark("ts", late)).groupBy(F.window("ts", width, slide).alias("w"), "station", "sector", "bin").agg(F.count("*").alias("n"))
    flat = keyed.select("station", F.unix_seconds("w.start").alias("start"), "sector", "bin", "n")
    log = Log(obs.sparkSession, path, flat.schema)
    run(flat, checkpoint, log.write, "update")
    return newest(log.read(), ["station", "start", "sector", "bin"]).drop("batch")


def stream_sessions(obs: DataFrame, checkpoint: str, path: str, gap: str = "45 minutes", late: str = "168 hours") -> DataFrame:
    """station, phase, start, end, n: unbroken phases of a stream (station, ts, phase), ended by a pause of ``gap``. A session
    is written once, when the newest reading is ``late`` past its end; its state ends with it."""
    keyed = obs.withWatermark("ts", late).groupBy("station", "phase", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    flat = keyed.select("station", "phase", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")
    log = Log(obs.sparkSession, path, flat.schema)
    run(flat, checkpoint, log.write)
    return log.read().drop("batch")


def stream_daily_area(cells: DataFrame, checkpoint: str, path: str, boundary_cells: int | None) -> DataFrame:
    """Daily areas of a stream of masked cells (day, granule, iy, ix, mask, …).

    A scene may arrive in any number of pieces, and a cell that comes again replaces itself. Each batch logs
    its cells by day and then rebuilds the days that it touched, and no others, from all cells logged for them.
    """
    spark = cells.sparkSession
    log, scene = Log(spark, f"{path}/cells", cells.schema, "day"), ["day", "granule"]

    def rebuilt(number: int) -> DataFrame:
        held = log.read().where(F.col("batch") <= number)
        touched = held.where(F.col("batch") == number).select("day").distinct()
        whole = newest(held.join(touched, "day", "left_semi"), [*scene, "iy", "ix"], *(f.name for f in cells.schema if f.name not in (*scene, "iy", "ix")))
        return touched.join(raster.combine_scenes(raster.scene_area(whole, scene, "mask"), boundary_cells), "day", "left")

    log.write(spark.createDataFrame([], cells.schema), -1)  # so that the days have a schema before the first batch
    days = Log(spark, f"{path}/days", rebuilt(-1).schema)

    def each(batch: DataFrame, number: int) -> None:
        log.write(batch, number)
        days.write(rebuilt(number), number)

    run(cells, checkpoint, each)
    return newest(days.read(), ["day"]).where("n_scenes IS NOT NULL").drop("batch")  # a day may have lost all of its scenes


def stream_extract(listings: DataFrame, extract: Callable[[DataFrame], DataFrame], store: str, fingerprint: str) -> DataFrame:
    """Extracts each file once for each ``fingerprint`` of the parameters, and again if its size has changed since.

    ``listings`` is a stream of what deliveries hold (file, size, modified); ``extract`` takes files (these columns) and
    gives rows that keep ``file``. Listings older than the one that a file was extracted by are passed over.
    The state of the files is written behind their values, so a batch that broke off is done again whole. Returns
    the values of the newest state of each file, those without any left out.
    """
    spark, place = listings.sparkSession, f"{store}/{fingerprint}"
    files = Log(spark, f"{place}/files", T.StructType.fromDDL("file string, size long, modified long"))
    values = extract(spark.createDataFrame([], files.schema)).schema
    log = Log(spark, f"{place}/values", values)

    def each(batch: DataFrame, number: int) -> None:
        told = batch.groupBy("file").agg(F.max_by(F.struct("size", "modified"), F.struct("modified", "size")).alias("x")).select("file", "x.size", "x.modified")
        known = newest(files.read().where(F.col("batch") < number), ["file"]).select("file", F.col("size").alias("_size"), F.col("modified").alias("_was"))
        todo = told.join(known, "file", "left").where(F.col("_was").isNull() | (F.col("size") != F.col("_size")) & (F.col("modified") >= F.col("_was"))).select("file", "size", "modified")
        log.write(extract(todo), number)
        files.write(todo, number)

    run(listings, f"{place}/checkpoint", each)
    last = newest(files.read(), ["file"]).select("file", "batch")
    return log.read().join(last, ["file", "batch"], "left_semi").drop("batch")


class LastKnown(StatefulProcessor):
    """Keeps the last reading of a station and gives it again, marked stale, once none has come for ``patience_ms``. With
    ``event``, time is that of the readings, and one without a value tells that its station failed."""

    def __init__(self, patience_ms: int, event: bool = False):
        self.patience_ms, self.event = patience_ms, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t long, id long, air_temp double, tried long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t, number, temp, tried = self.last.get() if self.last.exists() else (None, None, None, None)
        before = t
        for frame in rows:
            frame = frame.dropna(subset=["t"])
            if self.event and len(frame):
                tried = int(frame["t"].max()) if tried is None else max(tried, int(frame["t"].max()))
                frame = frame.dropna(subset=["air_temp"])
            if len(frame):
                new = frame.sort_values(["t", "id"] if self.event else ["t"], kind="stable").iloc[-1]
                at = (int(new["t"]), int(new["id"]) if self.event else 0)
                if t is None or at >= (t, number):
                    t, number, temp = *at, float(new["air_temp"])
        if t is None and tried is None:
            return
        self.last.update((t, number, temp, tried))
        if t is None:
            return  # it never had a value to keep
        if not self.event or t != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((t * 1000 if self.event else timerValues.getCurrentProcessingTimeInMs()) + self.patience_ms)
        yield self._row(key, t, temp, tried is not None and tried > t)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            t, _, temp, _ = self.last.get()
            yield self._row(key, t, temp, True)

    @staticmethod
    def _row(key: tuple, t: int, temp: float, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"station": [key[0]], "t": [t], "air_temp": [temp], "stale": [stale]})

    def close(self) -> None:
        pass


KNOWN = "station string, t long, air_temp double, stale boolean"


def stream_last_known(obs: DataFrame, patience_ms: int = 3_600_000) -> DataFrame:
    """station, t, air_temp, stale of a stream (station, t, air_temp), station by station: one that fails does not hold
    up the others. Needs the RocksDB state store; ``run`` it with ``idle`` off."""
    return obs.groupBy("station").transformWithStateInPandas(LastKnown(patience_ms), KNOWN, "Update", "ProcessingTime")


def last_known(obs: DataFrame, checkpoint: str, path: str, patience: int = 3600, late: str = "1 hour") -> DataFrame:
    """station, t, air_temp, stale of each station of a stream (station, id, t, ts, air_temp) that ever had a value: its last
    one, of equal times that of the largest id. It is stale if a later reading failed (has no value), or once the watermark, ``late`` behind the
    newest reading of all stations, is over ``patience`` seconds past it. Time is event time: the same deliveries give the same rows.
    Readings behind the watermark are passed over, as are those without a time."""
    spark, key = obs.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    known = obs.withWatermark("ts", late).groupBy("station").transformWithStateInPandas(LastKnown(patience * 1000, event=True), KNOWN, "Update", "EventTime")
    log, before = Log(spark, path, T.StructType.fromDDL(KNOWN)), spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run(known, checkpoint, log.write, "update")
    finally:
        spark.conf.set(key, before)
    return newest(log.read(), ["station"], "t", "stale").drop("batch")
