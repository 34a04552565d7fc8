"""Token-id output: one zstandard frame per document with a shared dictionary, and an offset index.

A store is a folder with ``shards/*.bin`` (frames back to back), ``dictionary.zdict`` and ``index`` (a
Parquet table with the place of every document's frame and the hash of the dictionary it needs). A
document's ids are serialised little-endian in the narrowest of 16 and 32 bits that holds the
vocabulary, so one document is read with one seek.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shared_fs, shards, small_batches, staged
from .encode import encoder, vocabulary

_PLACED = "doc_id long, shard int, file string, ordinal long, start_in_shard long, n_tokens long, offset long, size int"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _narrow(raw: bytes, end_id: int, width: int) -> bytes:
    ids = np.frombuffer(raw, "<u4")
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def _samples(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in small_batches(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array([_narrow(x, end_id, width) for x in enc.encode(batch.column("text").to_pylist())], pa.binary())], ["ids"])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int = 800, longest: int = 8000, size: int = 65536) -> tuple[bytes, int]:
    """(a zstandard dictionary fitted on the ids of ``sample`` whole documents of up to ``longest`` characters,
    bytes of all texts).

    The sample takes the texts with the smallest hashes, each once, so it is the same at every run. Too few documents
    for training give a plain content dictionary, no documents an empty one.
    """
    import zstandard

    slim = staged(docs.sparkSession, docs.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"), (F.length("text") <= longest).alias("short")), "token-sizes")
    smallest = slim.where("short").select("h").distinct().orderBy("h").limit(sample)  # copies count once
    held = docs.where(F.length("text") <= longest).select("text", F.xxhash64("text").alias("h"))
    picked = held.join(F.broadcast(smallest), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text")  # of ``sample`` rows
    samples = [bytes(r.ids) for r in picked.mapInArrow(partial(_samples, tokenizer=tokenizer, end_id=end_id, width=width), "ids binary").collect()]
    whole, plain = slim.agg(F.sum("bytes")).first()[0] or 0, b"".join(samples)[-size:]
    discard(slim)
    if sum(map(len, samples)) < 100 * 256:
        return plain, whole
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 10), samples).as_bytes(), whole
    except zstandard.ZstdError:
        return plain, whole


def _write_shard(batches: Iterator[pa.RecordBatch], store: str, tokenizer: str, end_id: int, width: int, dictionary: bytes, level: int) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    fs, root = shared_fs(store)
    fs.create_dir(f"{root}/shards", recursive=True)
    # Each attempt has a file of its own; the index names the file of the attempt that succeeded.
    name = f"shards/{shard:06d}-{uuid.uuid4().hex[:8]}.bin"
    out, offset, tokens, ordinal = None, 0, 0, 0
    try:
        for batch in small_batches(batches, "text"):
            out = out or fs.open_output_stream(f"{root}/{name}")
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                frame = squeeze.compress(_narrow(raw, end_id, width))
                out.write(frame)
                rows.append((doc_id, shard, name, ordinal, tokens, n := len(raw) // 4 + 1, offset, len(frame)))
                offset, tokens, ordinal = offset + len(frame), tokens + n, ordinal + 1
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = [x.split()[0] for x in _PLACED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    finally:
        if out:
            out.close()


def write_token_files(docs: DataFrame, store: str, tokenizer: str, end_id: int, level: int = 3, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes ``doc_id, text`` and writes the store in ascending order of doc_id; returns its index.

    Rows of one doc_id come in the order of their texts' hashes, and are split over shards like all others.
    Null texts count as empty (one id: the end). Repeated rows each get a frame. A null doc_id comes
    first. An empty table gives an empty store. Other columns are ignored, whatever their names. There is
    a shard for each ``shard_bytes`` of text, and at least one for each shuffle partition.
    Index: doc_id, start (ids of all documents before), n_tokens, file, offset, size, dictionary (sha256).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if max(vocabulary(tokenizer) - 1, end_id) < 1 << 16 else 4
    dictionary, size = train_dictionary(docs, tokenizer, end_id, width)
    fs, root = shared_fs(store)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(dictionary)
    keyed, n = docs.withColumn("h", F.xxhash64("text")), max(shards(spark), -(-size // shard_bytes))
    ordered = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    placed = staged(spark, ordered.mapInArrow(partial(_write_shard, store=store, tokenizer=tokenizer, end_id=end_id, width=width, dictionary=dictionary, level=level), _PLACED), "placed")
    # One row for each shard.
    totals = placed.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    index = placed.join(before, "shard").select(
        "doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "file", "offset", "size", F.lit(width).alias("width"), F.lit(hashlib.sha256(dictionary).hexdigest()).alias("dictionary")
    )
    index.write.parquet(f"{store}/index")
    return spark.read.parquet(f"{store}/index")


def _read_frames(batches: Iterator[pa.RecordBatch], store: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    import zstandard

    fs, root = shared_fs(store)
    with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
        dictionary = f.read()
    found = hashlib.sha256(dictionary).hexdigest()
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    name = file = None
    try:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in sorted(rows, key=lambda r: (r["file"], r["offset"])):
                if r["dictionary"] != found:
                    raise ValueError(f"frames of {r['file']} need dictionary {r['dictionary']}, the store has {found}")
                if r["file"] != name:
                    if file:
                        file.close()
                    name, file = r["file"], fs.open_input_file(f"{root}/{r['file']}")
                ids = np.frombuffer(expand.decompress(file.read_at(r["size"], r["offset"])), f"<u{r['width']}").astype("<u4")
                out.append((r["doc_id"], r["start"], len(ids), zlib.crc32(ids.tobytes()), ids.tobytes() if keep_ids else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [x.split()[0] for x in _READ.split(", ")])
    finally:
        if file:
            file.close()


def read_token_files(spark: SparkSession, store: str, keep_ids: bool = True, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with ``keep_ids``) ids as little-endian uint32, from the files."""
    index = spark.read.parquet(f"{store}/index")
    if doc_ids is not None:
        index = index.where(F.col("doc_id").isin(doc_ids))
    return index.mapInArrow(partial(_read_frames, store=store, keep_ids=keep_ids), _READ)
