"""Interpolated modified Kneser-Ney bigram model in sorted hash arrays.

Words are counted by 64-bit hash, in two scans. The first counts tokens and bigrams; the second looks
the bigram counts up and gathers, for each word, how many distinct bigrams it starts (with count 1, 2 and
more) and ends: each occurrence of a bigram of count c adds 1/c. Counts travel as sorted arrays, combined
in each task and dealt over shards by the high bits of the hash, so frequent words spread like all others.
Shards are raw little-endian files in the shared folder, which scoring tasks memory-map.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, shared_fs, shards, small_batches, staged, workspace
from .words import mix, word_hashes

END, BEGIN = np.uint64(0x51ED270B9F8A4D21), np.uint64(0xA24BAED4963EE407)
_PART = "kind string, shard int, keys binary, data binary"
_FILE = "kind string, shard int, file string, n long, total double, ones long, twos long, threes long, fours long"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FLUSH = 2_000_000


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end after each text, the token before each or BEGIN, tokens of each text)."""
    hashes, at = word_hashes(batch.column("text"))
    lengths = np.diff(at) + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.full(int(lengths.sum()), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - lengths + 1] = BEGIN
    return tokens, before, lengths


def _pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _sum_by(keys: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the columns of ``data``."""
    if not len(keys):
        return keys, data
    order = np.argsort(keys, kind="stable")
    keys, data = keys[order], data[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(data, starts, axis=0)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes: the high planes are nearly all zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


class Gather:
    """Adds up (keys, data) of one kind in a task and gives packed rows per shard."""

    def __init__(self, kind: str, n: int, width: int):
        self.kind, self.n, self.width, self.held, self.size = kind, n, width, [], 0

    def add(self, keys: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, data))
        self.size += len(keys)
        if self.size > FLUSH:
            keys, data = self._sum()
            self.held, self.size = [(keys, data)], len(keys)
            if self.size > FLUSH // 2:
                yield from self.flush()

    def _sum(self) -> tuple[np.ndarray, np.ndarray]:
        return _sum_by(np.concatenate([k for k, _ in self.held]), np.concatenate([d for _, d in self.held])) if self.held else (np.zeros(0, np.uint64), np.zeros((0, self.width)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        keys, data = self._sum()
        self.held, self.size = [], 0
        squeeze = zstandard.ZstdCompressor(level=1)
        cuts = np.searchsorted(shard_of(keys, self.n), np.arange(self.n + 1))
        for i in range(self.n):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                row = (self.kind, i, squeeze.compress(_pack_keys(keys[a:b])), squeeze.compress(np.ascontiguousarray(data[a:b].T).astype("<f8").view(np.uint8).reshape(-1, 8).T.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "shard", "keys", "data"])


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Grows with the key, so a shard is a range of hashes."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words, pairs = Gather("word", n, 1), Gather("pair", n, 1)
    for batch in small_batches(batches, "text", 4 << 20, 8192):
        tokens, before, _ = _tokens(batch)
        for gather, keys in ((words, tokens), (pairs, _pair(before, tokens))):
            distinct, counts = np.unique(keys, return_counts=True)
            yield from gather.add(distinct, counts.astype(np.float64)[:, None])
        yield from words.add(np.array([BEGIN]), np.array([[float(batch.num_rows)]]))
    yield from words.flush()
    yield from pairs.flush()


def _merge_write(batches: Iterator[pa.RecordBatch], store: str, finish: Callable[[str, int, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each shard, as they come sorted by (kind, shard), and writes its arrays."""
    import zstandard

    fs, root = shared_fs(store)
    fs.create_dir(root, recursive=True)
    expand, at, held = zstandard.ZstdDecompressor(), None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys, data = _sum_by(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]))
        counts = np.rint(data[:, -1])  # of tokens or pairs, or of distinct bigrams that a word ends
        file = f"{at[0]}-{at[1]:06d}-{uuid.uuid4().hex[:8]}"  # the table of files names the attempt that counts
        for name, column in finish(*at, keys, data).items():
            with fs.open_output_stream(f"{root}/{file}.{name}") as f:
                f.write(column.tobytes())
        real = counts[keys != BEGIN] if at[0] == "word" else counts
        row = (*at, file, len(keys), float(real.sum()), *(int((real == c).sum()) for c in (1, 2, 3, 4)))
        types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in _FILE.split(", ")])
        held.clear()

    for batch in batches:
        for kind, shard, keys, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "keys", "data")), strict=True):
            if at != (kind, shard):
                yield from close()
                at = (kind, shard)
            keys = _unpack_keys(expand.decompress(keys))
            planes = np.frombuffer(expand.decompress(data), np.uint8).reshape(8, -1)
            held.append((keys, np.ascontiguousarray(planes.T).view("<f8").reshape(-1, len(keys)).T))
            if len(held) > 1 and sum(len(k) for k, _ in held) > 2 * FLUSH:
                held[:] = [_sum_by(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]))]
    yield from close()


def _write(spark: SparkSession, parts: DataFrame, store: str, finish: Callable, n: int, name: str) -> list:
    """One task for a shard and kind; the driver gets a row for each file."""
    dealt = parts.repartition(2 * n, "kind", "shard").sortWithinPartitions("kind", "shard")
    return staged(spark, dealt.mapInArrow(partial(_merge_write, store=store, finish=finish), _FILE), name).collect()


class Shards:
    """Memory-mapped sorted arrays of one kind; looked up with the shard of each key."""

    def __init__(self, store: str, files: list[tuple[int, str]], n: int, columns: dict[str, str]):
        self.fs, self.root = shared_fs(store)
        self.files, self.n, self.columns, self.open = dict(files), n, columns, {}

    def _map(self, file: str, name: str, dtype: str) -> np.ndarray:
        path = f"{self.root}/{file}.{name}"
        if type(self.fs).__name__ == "LocalFileSystem" or getattr(self.fs, "type_name", "") == "local":
            return np.memmap(path, dtype, "r")
        with self.fs.open_input_stream(path) as f:  # a store without mapped files
            return np.frombuffer(f.read(), dtype)

    def look(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns at each key; 0 where it is unknown. ``keys`` must be sorted and distinct."""
        out = [np.zeros(len(keys), np.float64) for _ in self.columns]
        cuts = np.searchsorted(shard_of(keys, self.n), np.arange(self.n + 1))
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            if shard not in self.files:
                continue
            if shard not in self.open:
                self.open[shard] = (self._map(self.files[shard], "keys", "<u8"), [self._map(self.files[shard], c, t) for c, t in self.columns.items()])
            own, columns = self.open[shard]
            a, b = cuts[shard], cuts[shard + 1]
            at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
            hit = own[at] == keys[a:b]
            for o, c in zip(out, columns, strict=True):
                o[a:b] = np.where(hit, c[at], 0)
        return out


def _contexts(batches: Iterator[pa.RecordBatch], store: str, pairs: list, n: int) -> Iterator[pa.RecordBatch]:
    counts, gather = Shards(store, pairs, n, {"count": "<f8"}), Gather("word", n, 5)
    for batch in small_batches(batches, "text", 4 << 20, 8192):
        tokens, before, _ = _tokens(batch)
        keys, back = np.unique(_pair(before, tokens), return_inverse=True)
        c = counts.look(keys)[0][back]
        share, none = 1 / c, np.zeros(len(c))
        # count of the token, its contexts of count 1, 2 and more as a first word, distinct bigrams as a second
        first = np.column_stack([none, (c == 1) * share, (c == 2) * share, (c > 2) * share, none])
        second = np.column_stack([np.ones(len(c)), none, none, none, share])
        yield from gather.add(*_sum_by(np.concatenate([before, tokens]), np.concatenate([first, second])))
        yield from gather.add(np.array([BEGIN]), np.array([[float(batch.num_rows), 0, 0, 0, 0]]))
    yield from gather.flush()


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; 0.5, 0.75 and 0.9 where there is too little to fit them."""
    if not (ones and twos and threes):
        return 0.5, 0.75, 0.9
    y = ones / (ones + 2 * twos)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, ones, twos), (2, twos, threes), (3, threes, fours)))


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c < 1, 0.0, np.where(c < 2, d[0], np.where(c < 3, d[1], d[2])))


def _plain(kind: str, shard: int, keys: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    return {"keys": keys.astype("<u8"), "count": np.rint(data[:, 0]).astype("<f8")}


def _finished(kind: str, shard: int, keys: np.ndarray, data: np.ndarray, d: tuple[float, float, float]) -> dict[str, np.ndarray]:
    total = np.rint(data)
    spared = (total[:, 1:4] @ np.array(d)) / np.maximum(total[:, 0], 1)
    return {"keys": keys.astype("<u8"), "count": total[:, 0].astype("<f8"), "spared": spared.astype("<f4"), "ends": total[:, 4].astype("<f8")}


def _score(batches: Iterator[pa.RecordBatch], store: str, words: list, pairs: list, n: int, m: dict) -> Iterator[pa.RecordBatch]:
    word, pair = Shards(store, words, n, {"count": "<f8", "spared": "<f4", "ends": "<f8"}), Shards(store, pairs, n, {"count": "<f8"})
    for batch in small_batches(batches, "text", 4 << 20, 8192):
        tokens, before, lengths = _tokens(batch)
        keys, back = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        count, spared, ends = word.look(keys)
        here, past = back[: len(tokens)], back[len(tokens) :]
        keys, back = np.unique(_pair(before, tokens), return_inverse=True)
        c2 = pair.look(keys)[0][back]
        c, e, context = count[here], ends[here], count[past]
        base = np.log10((c + 1) / (m["tokens"] + m["types"] + 1))
        low = np.maximum(e - _discount(e, m["low"]), 0) / m["pairs"] + m["left"] / (m["types"] + 1) if m["pairs"] else np.full(len(c), 1 / (m["types"] + 1))
        high = np.maximum(c2 - _discount(c2, m["high"]), 0) / np.maximum(context, 1) + np.where(context > 0, spared[past], 1.0) * low
        starts = np.cumsum(lengths) - lengths
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.full(len(lengths), m["tokens"], np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(high), starts))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORE.split(", ")])


def score(docs: DataFrame, folds: int = 7, held: int = 2, shard_bytes: int = 64 << 20) -> DataFrame:
    """Log10 probabilities of all texts under a model of those whose fold is not ``held``.

    The fold of a document is the crc32 of its id's decimal text modulo ``folds``; a null id has none and
    is learned from. Returns doc_id, held_out, n_tokens (with the end), n_known, train_tokens, base_score
    (add-one unigram) and score, one row per row. Null texts count as empty: the end alone. Repeated rows
    count each time. With nothing to learn from every token is equally unlikely. Other columns are ignored.
    An empty table gives no rows. The model has a file of each kind for each ``shard_bytes`` of text, and at
    least as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    train, store = docs.where("not held_out").select("text"), workspace(spark, "model")
    n = max(shards(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    files = _write(spark, train.mapInArrow(partial(_count, n=n), _PART), store, _plain, n, "model-files")
    pairs = [(r["shard"], r["file"]) for r in files if r["kind"] == "pair"]
    of = lambda kind, column, rows: sum(r[column] for r in rows if r["kind"] == kind)
    high = discounts(*(of("pair", c, files) for c in ("ones", "twos", "threes", "fours")))
    begins = 1 if files else 0
    tokens, types, kinds = int(of("word", "total", files)), of("word", "n", files) - begins, of("pair", "n", files)
    contexts = train.mapInArrow(partial(_contexts, store=store, pairs=pairs, n=n), _PART)
    final = _write(spark, contexts, store, partial(_finished, d=high), n, "context-files")
    low_counts = [of("word", c, final) for c in ("ones", "twos", "threes", "fours")]
    low = discounts(*low_counts)
    more = types - low_counts[0] - low_counts[1]
    left = (low[0] * low_counts[0] + low[1] * low_counts[1] + low[2] * more) / kinds if kinds else 1.0
    m = {"tokens": tokens, "types": types, "pairs": kinds, "high": high, "low": low, "left": left}
    words = [(r["shard"], r["file"]) for r in final]
    assert math.isfinite(left)
    return docs.mapInArrow(partial(_score, store=store, words=words, pairs=pairs, n=n, m=m), _SCORE)
