"""k-means on integer vectors with geometric drift tightening.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of that to all
others. After a round the upper bound grows by the drift of the own centroid. The lower bound need not
shrink by the largest drift: all vectors of a cluster lie in a sphere around its old centroid, and by planar
geometry only the part of another centroid's move that can come closer to that sphere counts. Vectors whose
bounds still tell their centroid apart are left alone; the others are scanned exactly, in integers.

A round is one pass over the vectors by Spark and one aggregate of a row for each component of a centroid,
which comes to the driver: its size is given by the parameters alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Components beyond this would let a squared distance leave 64 bits.
LARGEST = 1 << 27
#: Room for the rounding of bounds, which are doubles; a bound that is off by it costs a scan, never a result.
_ROOM = 1e-9
_STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, scans int, distance long"


def tightened(own: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much nearer a centroid moving from ``old`` to ``new`` can come, at most, to any point of the sphere of
    ``radius`` around ``own``.

    In the plane through the three points, d(x, old) - d(x, new) is constant on branches of a hyperbola with
    ``old`` and ``new`` as foci, and at most drift * cos(angle at their midpoint between x and the move). The
    sphere, seen from the midpoint, is a disc; its edge nearest to the move's direction bounds the angle.
    """
    move = new - old
    drift = float(np.sqrt(move @ move))
    if not drift:
        return 0.0
    view = own - (old + new) / 2
    far = float(np.sqrt(view @ view))
    if radius >= far:
        return drift
    angle = np.arccos(np.clip(view @ move / (far * drift), -1, 1)) - np.arcsin(radius / far)
    return drift * float(np.clip(np.cos(max(angle, 0.0)), 0, 1))


def loosening(old: np.ndarray, new: np.ndarray, radii: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(drift of each centroid, how much the lower bounds of each cluster's vectors shrink)."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    k = len(a)
    shrink = np.array([max((tightened(a[i], radii[i], a[j], b[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])
    return np.sqrt(((a - b) ** 2).sum(axis=1)), shrink * (1 + _ROOM)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=-1)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray | None, shrink: np.ndarray | None, last: bool) -> Iterator[pa.RecordBatch]:
    k, d = centroids.shape
    for whole in batches:
        for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
            n = batch.num_rows
            x = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(n, d)
            cluster, upper, lower, scans = (batch.column(c).to_numpy().copy() for c in ("cluster", "upper", "lower", "scans"))
            unsure = np.arange(n)
            if drift is not None:
                upper += drift[cluster]
                lower -= shrink[cluster]
                unsure = np.flatnonzero(upper * (1 + _ROOM) >= lower * (1 - _ROOM))
                upper[unsure] = np.sqrt(_squares(x[unsure], centroids[cluster[unsure]]))  # the own distance may settle it
                unsure = unsure[upper[unsure] * (1 + _ROOM) >= lower[unsure] * (1 - _ROOM)]
            if len(unsure):
                far = np.stack([_squares(x[unsure], c) for c in centroids])
                cluster[unsure] = far.argmin(axis=0)  # of equal distances the smaller number
                near = np.sort(far, axis=0)
                upper[unsure], lower[unsure] = np.sqrt(near[0]), np.sqrt(near[1]) if k > 1 else np.inf
                scans[unsure] += 1
            distance = _squares(x, centroids[cluster]) if last else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *map(pa.array, (cluster, upper, lower, scans, distance))], [c.split()[0] for c in _STATE.split(", ")])


def kept_vectors(vectors: DataFrame, column: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and ``vector``, the integers floor(scale * component) of the vectors that are whole and finite. An integer
    beyond ``LARGEST`` is an error."""
    whole = F.col(column).isNotNull() & (F.size(column) == dimensions) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    floor = lambda x: F.floor(x.cast("double") * scale)
    held = lambda x: F.when(F.abs(x.cast("double") * scale) <= LARGEST, floor(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, held).cast("array<int>").alias("vector"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans: a row for each kept row of ``vectors``
    (``vec_id``, ``column``).

    Vectors that are null, of other than ``dimensions`` components or hold a null or non-finite one are left
    out. Starts are the ``k`` vectors of the smallest sha256 of ``seed:vec_id``; of equal ids (repeated rows)
    the smaller vector comes first, null ids come last. With fewer vectors there are fewer centroids, an
    empty table gives no rows; other columns are ignored. Equal distances go to the smaller number; centroids
    become the floor of the exact mean, empty ones stay. ``scans`` counts how often all centroids were
    compared.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, column, dimensions, scale)
    starts = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "vector")
    first = starts.orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()  # k rows
    state = kept.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans"), F.lit(0).cast("long").alias("distance"))
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        none = spark.createDataFrame([], names)
        return state.join(none, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
    centroids, drift, shrink = np.array([r.vector for r in first], np.int64), None, None
    for turn in range(rounds + 1):
        how = partial(_assigned, centroids=centroids, drift=drift, shrink=shrink, last=turn == rounds)
        old, state = state, staged(spark, state.mapInArrow(how, _STATE), "assigned")
        discard(old)
        if turn < rounds:
            parts = state.select("cluster", "upper", F.posexplode("vector").alias("i", "x")).groupBy("cluster", "i")
            moved, radii = centroids.copy(), [0.0] * len(centroids)
            for g in parts.agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("s"), F.max("upper").alias("radius")).collect():  # up to k * dimensions rows
                moved[g.cluster, g.i], radii[g.cluster] = g.s // g.n, g.radius * (1 + _ROOM)
            drift, shrink = loosening(centroids, moved, radii)
            centroids = moved
    totals = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # up to k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, s, sum(totals.values()), digest[c]) for c, s in totals.items()], names)
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")  # up to k rows
