"""Shared folders, staging and column helpers of the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOCAL: list[str] = []
_STAGED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset (tests, one machine) a temporary folder of this machine stands in.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with its lineage cut."""
    path = workspace(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of ``staged`` frames that nothing reads any more."""
    for frame in frames:
        if path := _STAGED.pop(frame, None):
            fs, place = shared_fs(path)
            fs.delete_dir(place)


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever is in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def numbered(schema: T.StructType) -> tuple[list[str], T.StructType]:
    """Plain names for columns of any name, and the schema with them."""
    names = [f"c{i}" for i in range(len(schema))]
    return names, T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema, strict=True)])


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, by: list[str], most: int = 4096, small: int = 0, marks: int = 65_536) -> DataFrame:
    """Inner join with ``right``, which has a row for each key and, in ``count``, how many rows of ``left`` have it.

    A ``right`` of up to ``small`` rows is broadcast. Else rows of keys with over ``most`` of them are dealt
    over salts by a hash of ``by`` and meet a copy of the key's row in each; if there are up to ``marks``
    such keys they are broadcast to mark their rows, else all keys have 16 salts. ``right`` should be
    staged, as it is read several times.
    """
    rows, hot, top = right.agg(F.count("*"), F.count_if(F.col(count) > most), F.max(count)).first()
    if rows <= small:
        return left.join(F.broadcast(right), key)
    if not hot:
        return left.join(right, key)
    marked = hot <= marks
    salt, is_hot = unused([*left.columns, *right.columns], "_salt", "_hot")
    salts = min(1024, math.ceil(top / most)) if marked else 16
    turn, all_salts = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
    if marked:
        keys = right.where(F.col(count) > most).select(key, F.lit(True).alias(is_hot))
        left = left.join(F.broadcast(keys), key, "left").withColumn(salt, F.when(F.col(is_hot), turn).otherwise(0)).drop(is_hot)
        all_salts = F.when(F.col(count) > most, all_salts).otherwise(F.array(F.lit(0)))
    else:
        left = left.withColumn(salt, turn)
    return left.join(right.withColumn(salt, F.explode(all_salts)), [key, salt]).drop(salt)


def mark_possible(left: DataFrame, right: DataFrame, by: list[str], flag: str, places: int = 8, most: int = 1 << 28) -> DataFrame:
    """``left`` with the boolean ``flag``, false only where no row of ``right`` has its values in the columns ``by``.

    One bit is set for the hash of each row of ``right``, among ``places`` bits a row; the bits, ``most`` of them (32 MB)
    however many rows there are, are broadcast as chunks of 512 words. A row without a partner is marked by chance in an
    eighth of the cases, more often once ``most`` is reached: this thins what the join after it shuffles, and only that
    join decides.
    """
    spark = left.sparkSession
    bits = 1 << 15
    bits *= max(1, math.ceil(min(right.count() * places, most) / bits))
    place, chunk, words = unused(left.columns, "_place", "_chunk", "_words")
    place_of, bit = F.pmod(F.xxhash64(*quoted(by)), F.lit(bits)), F.col(place).bitwiseAND(63).cast("int")
    held = right.select(place_of.alias(place)).select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    held = held.unionByName(spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = held.groupBy(F.shiftright("word", 9).alias(chunk)).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias(words))
    placed = left.withColumn(place, place_of).withColumn(chunk, F.shiftright(place, 15)).join(F.broadcast(chunks), chunk)
    word = F.get(F.col(words), F.shiftright(place, 6).bitwiseAND(511).cast("int"))
    return placed.withColumn(flag, F.call_function("shiftrightunsigned", word, bit).bitwiseAND(1) == 1).drop(place, chunk, words)


def shared_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI in the shared folder, for tasks that keep their own file format."""
    return pafs.FileSystem.from_uri(uri)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def shards(spark: SparkSession) -> int:
    """How many ways to deal data out: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def limit_arrow(spark: SparkSession, most: str) -> None:
    """Arrow batches of about ``most`` bytes go to Python workers, a row at least: from now on in this session,
    as Spark takes the limit when a frame runs, not when it is made. By default it is 64 MB and 10,000 rows, so a
    batch holds a whole partition of texts, once in the JVM's direct memory and once in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def limit_scans(spark: SparkSession, rows: int) -> None:
    """Scans of Parquet files hold ``rows`` rows of a task at once: from now on in this session. By default it is 4,096, whose
    texts lie in one array."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", rows)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of the string column at most; a row is never split."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (size + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)
