"""Exact deduplication by a stateful stream whose keyed state lives on disk and never expires.

A streaming aggregation over the digests of normalised texts holds, in RocksDB, one state row per
distinct digest: how many rows had it, the largest document id and where that document's content is.
No watermark is set, so state is never dropped. The state is then read as a table, and every hit (a
digest that several rows share) is checked on the full bytes of the texts. Native plans only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, shared_fs, spread_join, staged, unused, workspace

#: Checksum files would cost each partition's store threads of its own, which stay with the executor; the state is read
#: once, right after the stream, and deleted.
_STATE = {
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def advance(spark: SparkSession, keys_path: str, schema: str, checkpoint: str, batch: int = 64 << 30) -> DataFrame:
    """Brings the stream up to date with all files under ``keys_path``; returns its state.

    Rows have ``digest``, ``doc_id`` and ``locator``. Each call resumes from ``checkpoint``, so files that
    came since are the only ones read. A micro-batch takes up to ``batch`` bytes of files.
    """
    was = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch)).parquet(keys_path)
        state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        table = spark.read.format("statestore").load(checkpoint)
        value = table.schema["value"].dataType.names
        return table.select(F.col("key.digest").alias("digest"), F.col(f"value.{value[0]}").alias("keeper"), F.col(f"value.{value[1]}").alias("group_size"))
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salt_rows: int = 2048) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id stays; a null doc_id is below all others. Where a doc_id itself repeats with an equal text, all
    its rows carry kept = true, as they can't be told apart. Texts that share a digest but not their bytes
    are told apart by the bytes. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.input_file_name().alias("locator"))
    schema = "doc_id long, digest string, locator string, text_sha256 string"
    keys_path = workspace(spark, "digests")
    docs.select("doc_id", digest(F.col("text")).alias("digest"), "locator", sha256(F.col("text")).alias("text_sha256")).write.parquet(keys_path)
    keys = spark.read.schema(schema).parquet(keys_path)
    if keys.isEmpty():
        return keys.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    state_path = workspace(spark, "dedup-state")
    state = staged(spark, advance(spark, keys_path, schema, state_path), "dedup-groups")
    facts = state.select("digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.locator").alias("keep_locator"), "group_size")
    proven = staged(spark, spread_join(keys, facts, "digest", "group_size", ["doc_id", "locator"], salt_rows), "dedup-proven")
    for path in (keys_path, state_path):
        fs, place = shared_fs(path)
        fs.delete_dir(place)

    # Full bytes of the hits, fetched once: members, dealt over salts, meet the text of their keeper, once for each salt.
    salts = F.ceil(F.col("group_size") / salt_rows).cast("int")
    suspects = proven.where("group_size > 1").select("digest", F.col("doc_id").alias("m"), F.col("locator").alias("ml"), "keep_id", "keep_locator", salts.alias("salts")).distinct()
    texts = docs.select(F.col("doc_id").alias("d"), F.col("locator").alias("l"), digest(F.col("text")).alias("g"), "text")
    found = suspects.join(texts, (F.col("digest") == F.col("g")) & F.col("m").eqNullSafe(F.col("d")) & (F.col("ml") == F.col("l")))
    salt = F.pmod(F.xxhash64("m", "ml"), F.col("salts")).cast("int")
    keeps = F.col("m").eqNullSafe(F.col("keep_id")) & (F.col("ml") == F.col("keep_locator"))
    found = staged(spark, found.select("digest", "salts", salt.alias("salt"), keeps.alias("keeps"), "text"), "dedup-hits")
    keepers = found.where("keeps").groupBy("digest", "salts").agg(F.max("text").alias("keep_text"))
    keepers = keepers.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "keep_text")
    compared = found.select("digest", "salt", "text").join(keepers, ["digest", "salt"]).where(F.col("text") != F.col("keep_text"))
    clashes = staged(spark, compared.select("digest").distinct(), "dedup-clashes")
    discard(state, found)

    row = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("text_sha256")]
    if clashes.isEmpty():
        return proven.select(*row)
    clear = proven.join(clashes, "digest", "left_anti").select(*row)
    apart = docs.withColumn("digest", digest(F.col("text"))).join(clashes, "digest").withColumn("text_sha256", sha256(F.col("text")))
    groups = apart.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return clear.unionByName(apart.join(groups, "text").select(*row))


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of each group of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays, a
    null doc_id only if there is no other; of rows that repeat both doc_id and text one stays, any of them.
    An empty table gives no rows.
    """
    kept_id, key, n, sha = unused(docs.columns, "_kept", "_key", "_n", "_sha")
    decided = exact_dedup(docs)
    kept = decided.where("kept").groupBy(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(key)).agg(F.count("*").alias(n))
    kept = staged(docs.sparkSession, kept, "dedup-kept")
    rows = docs.withColumn(sha, sha256(ascii_lower(F.coalesce(F.col("text"), F.lit("")))))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(key)), "left_semi")
    if not kept.where(F.col(n) > 1).isEmpty():
        stay = stay.dropDuplicates(["doc_id", sha])
    return stay.drop(sha)
