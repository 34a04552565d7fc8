"""Approximate nearest neighbours by collision counting over single projections.

Vectors are dealt into blocks, once; queries lie in the shared folder, where the task of every block reads
them part by part, so neither side is copied in a shuffle. A block projects its vectors on random orthonormal directions and sorts
each projection by itself. A query opens a window around its own projection in every sorted array and
widens all of them together, by virtual rehashing, counting how often each vector falls in; those that
collide in enough projections are verified by exact inner products. Widening ends once a given share of
the block has been verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shared_fs, staged, workspace

_FOUND = "query_row long, query_id long, vec_ids array<long>, scores array<double>"


class Block:
    """The index of one block. Equal vectors are held once, with their ids and row numbers."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, vectors: np.ndarray, projections: int):
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        by = np.lexsort((ids, inverse))
        self.ids, self.row, self.first = ids[by], row[by], np.searchsorted(inverse[by], np.arange(len(self.vectors) + 1))
        # With one more coordinate all norms are equal, and the largest inner product is the smallest distance.
        squares = (self.vectors**2).sum(axis=1)
        whole = np.column_stack([self.vectors, np.sqrt(np.maximum(squares.max() - squares, 0))])
        d, rng = whole.shape[1], np.random.default_rng(7)
        turns = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-projections // d))]
        self.directions = np.hstack(turns)[:, :projections]
        placed = (whole @ self.directions).T
        self.order = np.argsort(placed, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(placed, self.order, axis=1)
        self.place = np.empty(self.order.shape, np.uint16 if len(self.vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.broadcast_to(np.arange(len(self.vectors), dtype=self.place.dtype), self.order.shape), axis=1)
        self.scale = np.sqrt(squares.max())

    def windows(self, at: np.ndarray, radius: float) -> np.ndarray:
        """First and last place of every query's window in every sorted array (projections x 2 x queries)."""
        return np.array([np.searchsorted(row, (x - radius, x + radius)) for row, x in zip(self.sorted, at, strict=True)])

    def search(self, queries: np.ndarray, own: list[int], k: int, threshold: float, share: float, start: float, widen: float) -> Iterator[tuple[list[int], list[float]]]:
        m, n = self.order.shape
        wanted, need = min(n, max(k + 1, int(np.ceil(share * n)))), int(np.ceil(threshold * m))
        # Norms are equal now, so the nearest lie where the query points: search from its place on the sphere.
        norms = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        at = (np.column_stack([queries, np.zeros(len(queries))]) * (self.scale / norms) @ self.directions).T
        radius, steps = start * self.scale / np.sqrt(len(self.directions)), []
        for q, (query, me) in enumerate(zip(queries, own, strict=True)):
            counts, edges, step = np.zeros(n, np.int16), None, 0
            while True:
                if step == len(steps):  # one radius more, for all queries at once
                    steps.append(self.windows(at, radius * widen**step))
                now = steps[step][:, :, q]
                if edges is None:  # places from the window's first, wrapping round below it, fall in where they are under its width
                    first, width = now.astype(self.place.dtype).T[:, :, None]
                    counts += np.add.reduce((self.place - first) < (width - first), axis=0, dtype=np.int16)
                else:
                    for order, (a, b), was in zip(self.order, now.tolist(), edges.tolist(), strict=True):
                        counts[order[a : was[0]]] += 1
                        counts[order[was[1] : b]] += 1
                edges, step = now, step + 1
                hits = np.flatnonzero(counts >= need)
                if len(hits) >= wanted or (now[:, 0] == 0).all() and (now[:, 1] == n).all():
                    break
            scores = self.vectors[hits] @ query
            if len(hits) > k + 1:
                best = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
                hits, scores = hits[best], scores[best]
            rows = []
            for h, s in zip(hits.tolist(), scores.tolist(), strict=True):
                part = slice(self.first[h], min(self.first[h + 1], self.first[h] + k + 1))
                rows += [(-s, i) for i, row in zip(self.ids[part].tolist(), self.row[part].tolist(), strict=True) if row != me]
            rows = sorted(rows)[:k]
            yield [i for _, i in rows], [-s for s, _ in rows]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _query_parts(path: str, dim: int, size: int) -> Iterator[pa.RecordBatch]:
    """The queries of one dimension from the shared folder, ``size`` at a time."""
    fs, place = shared_fs(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(place)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(size):
                    batch = batch.filter(pc.equal(batch.column("dim"), dim))
                    if batch.num_rows:
                        yield batch


def _search_blocks(batches: Iterator[pa.RecordBatch], path: str, queries: int, projections: int, **how: float) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
    for batch in batches:
        for dim, data in zip(batch.column("dim").to_pylist(), batch.column("data"), strict=True):
            held = data.values
            block = Block(held.field("vec_id").to_numpy(), held.field("row").to_numpy(), _matrix(held.field("embedding"), len(held)), projections)
            for part in _query_parts(path, dim, queries):
                row, own = part.column("row").to_pylist(), part.column("vec_id").to_pylist()
                found = block.search(_matrix(part.column("embedding"), len(row)), row, **how)
                out = [(r, i, *hits) for r, i, hits in zip(row, own, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], [x.split()[0] for x in _FOUND.split(", ")])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, projections: int = 64, threshold: float = 0.7, share: float = 0.3, start: float = 1.33, widen: float = 1.06, rows: int = 8192, queries: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by inner product of each query.

    Queries are the rows of ``vectors`` (``vec_id``, ``embedding``) whose vec_id is divisible by ``every``;
    every other row of the same dimension is a candidate. Null vec_ids and vectors that are null, empty,
    zero or hold a null or non-finite component take no part. Ties go to the smaller vec_id. Rows that share
    a vec_id are queries and candidates each for itself, so such a query_id has ranks 1 to ``k`` for each of
    its rows. Other columns are ignored, an empty table gives no rows. Work grows with queries times blocks
    of ``rows``, of each of which about ``share`` is verified, whatever its size; memory is one block and ``queries``
    queries. On random directions of 64 dimensions, the hardest case, 0.3 gives a recall of 0.99, 0.1 one of 0.92.
    """
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(usable, F.lit(False)))
    good = staged(spark, good.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    path = workspace(spark, "queries")
    good.where(F.col("vec_id") % every == 0).write.parquet(path)
    blocks = max(1, -(-good.count() // rows))
    data = good.groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("row", "vec_id", "embedding")).alias("data"))
    search = partial(_search_blocks, path=path, queries=queries, projections=projections, k=k, threshold=threshold, share=share, start=start, widen=widen)
    # Written out: the files of queries and vectors are no longer needed then.
    found = staged(spark, data.mapInArrow(search, _FOUND), "neighbours")
    discard(good)
    fs, place = shared_fs(path)
    fs.delete_dir(place)
    each = found.select("query_row", "query_id", F.explode(F.arrays_zip(F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))).alias("x")).select("query_row", "query_id", "x.vec_id", "x.score")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
