"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles; equal sets form a class with one representative. Representatives
that agree on a band of MinHash values are candidates. A candidate pair is looked at hash by hash, in
batches of the signature: it goes as soon as the posterior probability of reaching the similarity falls
under the chosen miss probability. What survives is verified on the full sets of words.

A bucket is first compared with one of its members only (a star); once the links found so far are
joined, only buckets that still span several components go on, with another member of the largest part as
the centre, for as long as this halves what is left outside. The members then outside meet all others in
pairs of blocks, each a row dealt to tasks by itself: blocks of signatures first, of which each member's
likeliest partner in every other component is verified, then, for what that leaves, blocks of texts. No pair
is emitted before its signatures agree, and no bucket is cut short.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small_batches, spread_join, staged, unused
from .components import components
from .words import mix, word_hashes, words

ROWS, BANDS, STEP, MISS = 8, 56, 32, 1e-6
#: Sets of words that a task keeps while it verifies pairs, and shingles in all of them.
SETS, SHINGLES = 64, 1 << 16
_SIGNED = "node long, doc_id long, text_hash long, n_shingles long, cls binary, signature binary, bands array<long>"


@lru_cache
def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def _minima(shingles: np.ndarray, k: int) -> np.ndarray:
    a, b = _family(k)
    low, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        out = np.minimum(out, (a[:, None] * low[None, i : i + 256] + b[:, None]).min(axis=1))
    return out


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the word shingles of one text; with fewer words, the whole sequence is one."""
    width = max(1, min(width, len(hashes)))
    if not len(hashes):
        return hashes
    h = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(h)


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    k, salt = ROWS * BANDS, np.arange(BANDS, dtype=np.uint64) << np.uint64(40)
    for batch in small_batches(batches, "text", 2 << 20):
        hashes, at = word_hashes(batch.column("text"))
        rows = []
        for i in range(batch.num_rows):
            own = shingle_hashes(hashes[at[i] : at[i + 1]], width)
            if not len(own):
                rows.append((0, None, None, None))
                continue
            least = _minima(own, k)
            band = salt.copy()
            for column in least.reshape(BANDS, ROWS).T:
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + column)
            rows.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), mix(least.astype(np.uint64)).astype(np.uint8).tobytes(), band.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("node", "doc_id", "text_hash")), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))))],
            [x.split()[0] for x in _SIGNED.split(", ")],
        )


@lru_cache
def least_matches(similarity: float, k: int, step: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes seen, fewest matches to go on). With a uniform prior the chance that the true agreement is
    at least t after m of n matches is P(Bin(n + 1, t) <= m); one byte of a hash agrees by chance in 1/256."""
    t = similarity + (1 - similarity) / 256
    seen = np.arange(step, k + 1, step)
    fewest = []
    for n in seen.tolist():
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        fewest.append(m)
    return seen, np.array(fewest)


def _plausible(batches: Iterator[pa.RecordBatch], percent: int, miss: float) -> Iterator[pa.RecordBatch]:
    seen, fewest = least_matches(percent / 100, ROWS * BANDS, STEP, miss)
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            n, m = (part.column(c).to_numpy() for c in ("na", "nb"))
            keep = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            a, b = (np.frombuffer(b"".join(part.column(c).take(pa.array(keep)).to_pylist()), np.uint8).reshape(len(keep), -1) for c in ("sa", "sb"))
            matches = np.zeros(len(keep), np.int64)
            for n_seen, least in zip(seen, fewest, strict=True):
                matches += (a[:, n_seen - STEP : n_seen] == b[:, n_seen - STEP : n_seen]).sum(axis=1)
                go = matches >= least
                if not go.all():
                    a, b, keep, matches = a[go], b[go], keep[go], matches[go]
            yield part.select(["u", "v"]).take(pa.array(keep))


def shingle_set(text: str, width: int) -> frozenset:
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _verified(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    kept: OrderedDict[int, frozenset] = OrderedDict()  # a few sets of this task; stars meet the same one again
    held = 0

    def own(node: int, text: str) -> frozenset:
        nonlocal held
        if node in kept:
            return kept[node]
        found = kept[node] = shingle_set(text, width)
        held += len(found)
        while kept and (len(kept) > SETS or held > SHINGLES):
            held -= len(kept.popitem(last=False)[1])
        return found

    for batch in batches:
        keep = []
        for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "ta", "tb")), strict=True):
            a, b = own(u, a), own(v, b)
            both = len(a & b)
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _side(members: DataFrame, end: str, s: str, columns: dict[str, str]) -> DataFrame:
    return members.select(F.col("node").alias(end), *(F.col(c).alias(short + s) for c, short in columns.items()))


def _likely(pairs: DataFrame, members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (u, v) of nodes that their signatures do not rule out."""
    about = {"n_shingles": "n", "signature": "s"}
    signed = pairs.join(_side(members, "u", "a", about), "u").join(_side(members, "v", "b", about), "v")
    return signed.mapInArrow(partial(_plausible, percent=percent, miss=miss), "u long, v long")


def _similar(pairs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs whose full sets are similar."""
    texts = pairs.join(_side(members, "u", "a", {"text": "t"}), "u").join(_side(members, "v", "b", {"text": "t"}), "v")
    return staged(members.sparkSession, texts.mapInArrow(partial(_verified, percent=percent, width=width), "u long, v long"), "links")


def _signed_sides(batch: pa.RecordBatch, texts: bool) -> Iterator[tuple]:
    """(pos, left, right) of each row; a side is node, root, n, signature matrix, band matrix and texts."""
    for pos, *sides in zip(batch.column("pos").to_pylist(), batch.column("l"), batch.column("r"), strict=True):
        out = []
        for side in sides:
            rows = side.values
            signature = rows.field("signature").to_pylist()
            out.append((*(rows.field(c).to_numpy() for c in ("node", "root", "n")), np.frombuffer(b"".join(signature), np.uint8).reshape(len(signature), -1), rows.field("bands").flatten().to_numpy().reshape(-1, BANDS), rows.field("text").to_pylist() if texts else None))
        yield pos, *out


def _likely_of(pos: int, left: tuple, right: tuple, percent: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of likely pairs of different components and their matches, some left members at a time. A pair is
    looked at in the first of the bands that it shares only, by the hashes that made the buckets (the bytes
    of the signature may agree by chance)."""
    seen, fewest = least_matches(percent / 100, ROWS * BANDS, STEP, miss)
    (_, root, n, a, p, _), (_, other, m, b, q, _) = left, right
    for at in range(0, len(root), max(1, 8192 // max(1, len(other)))):
        part = slice(at, at + max(1, 8192 // max(1, len(other))))
        i, j = np.nonzero((root[part, None] != other[None]) & (100 * np.minimum(n[part, None], m[None]) >= percent * np.maximum(n[part, None], m[None])))
        i += at
        go = (p[i] == q[j]).argmax(axis=1) == pos
        i, j, matches = i[go], j[go], np.zeros(int(go.sum()), np.int64)
        for n_seen, least in zip(seen, fewest, strict=True):
            matches += (a[i, n_seen - STEP : n_seen] == b[j, n_seen - STEP : n_seen]).sum(axis=1)
            go = matches >= least
            i, j, matches = i[go], j[go], matches[go]
        yield i, j, matches


def _block_best(batches: Iterator[pa.RecordBatch], percent: int, miss: float) -> Iterator[pa.RecordBatch]:
    """x, y, other, matches: each left member's likeliest partner in every other component, and the reverse
    with null matches, so that both ends are known to have a likely partner."""
    for batch in batches:
        for pos, left, right in _signed_sides(batch, False):
            best, seen = {}, set()
            for i, j, matches in _likely_of(pos, left, right, percent, miss):
                for x, y, m in zip(i.tolist(), j.tolist(), matches.tolist(), strict=True):
                    key = (x, right[1][y])
                    if key not in best or best[key][0] < m:
                        best[key] = (m, y)
                    seen.add(y)
            rows = [(int(left[0][x]), int(right[0][y]), int(other), m) for (x, other), (m, y) in best.items()] + [(int(right[0][y]), None, None, None) for y in seen]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["x", "y", "other", "matches"])


def _block_links(batches: Iterator[pa.RecordBatch], percent: int, width: int, miss: float) -> Iterator[pa.RecordBatch]:
    """Links between the members of two blocks of a bucket, of different components so far; a member is
    compared with a component until it has met it."""
    for batch in batches:
        for pos, left, right in _signed_sides(batch, True):
            own = lru_cache(None)(lambda text: shingle_set(text, width))
            met, links = set(), []
            for i, j, _ in _likely_of(pos, left, right, percent, miss):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if (x, right[1][y]) in met:
                        continue
                    p, q = own(left[5][x]), own(right[5][y])
                    both = len(p & q)
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        met.add((x, right[1][y]))
                        links.append((int(max(left[0][x], right[0][y])), int(min(left[0][x], right[0][y]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def _block_pairs(open_: DataFrame, members: DataFrame, size: int, texts: bool) -> DataFrame:
    """A row for each pair of a block of members outside the largest part with a block of all members of their
    bucket; blocks hold about ``size`` of them, and the rows of one bucket go to many tasks."""
    held = open_.join(members.select("node", F.col("n_shingles").alias("own"), "signature", "bands", *(["text"] if texts else [])), "node")
    row = F.struct("node", "root", F.col("own").alias("n"), "signature", "bands", *(["text"] if texts else []))
    block = lambda count: F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / size)).cast("int")
    all_blocks = F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1)
    left = held.where("root != major").withColumn("lb", block("rest")).withColumn("rb", F.explode(all_blocks))
    left = left.groupBy("band", "pos", "lb", "rb").agg(F.collect_list(row).alias("l"))
    right = held.groupBy("band", "pos", block("n").alias("rb")).agg(F.collect_list(row).alias("r"))
    return left.join(right, ["band", "pos", "rb"])


def _classes(docs: DataFrame, width: int, percent: int, miss: float, blocks: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(a row per document with its class, a row per class with the root of its component and its size)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = staged(spark, docs.withColumn("node", F.monotonically_increasing_id()).mapInArrow(partial(_sign, width=width), _SIGNED), "signed")
    classes = staged(spark, signed.where("n_shingles > 0").groupBy("cls").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes")
    banded = signed.select("node", "bands").join(classes.select("node"), "node").select(F.posexplode("bands").alias("pos", "band"), "node")
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most"), F.count("*").alias("n")).where("hub != most").select("band", "hub", "n")
    shared = staged(spark, shared, "shared")
    buckets = staged(spark, spread_join(banded, shared, "band", "n", ["node"]).drop("n"), "buckets")
    wanted = signed.select("node", "doc_id", "text_hash", "n_shingles", "signature", "bands").join(buckets.select("node").distinct(), "node")
    found = wanted.join(docs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "text"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    members = staged(spark, found.select("node", "n_shingles", "signature", "bands", "text").dropDuplicates(["node"]), "members")

    def joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is not None:
            links = links.unionByName(roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        return components(spark, links)

    def verified(pairs: DataFrame) -> DataFrame:
        return _similar(staged(spark, pairs, "likely"), members, percent, width)

    def reopened(buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, int, int, int]:
        """(members of buckets over several components, how many, how many outside the largest parts, pairs to look at)."""
        now = buckets.join(roots, "node", "left").select("band", "pos", "node", F.coalesce("root", "node").alias("root"))
        now = staged(spark, now, "rooted")
        parts = now.groupBy("band", "root").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
        spans = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "root", "hub")).alias("major"))
        spans = staged(spark, spans.where("parts > 1").select("band", "n", F.col("major.root").alias("major"), F.col("major.hub").alias("hub"), (F.col("n") - F.col("major.n")).alias("rest")), "spans")
        open_ = staged(spark, spread_join(now, spans, "band", "n", ["node"]), "open")
        rows, rest, pairs = spans.agg(F.sum("n"), F.sum("rest"), F.sum(F.col("n").cast("double") * F.col("rest"))).first()
        discard(now, spans)
        return open_, rows or 0, rest or 0, pairs or 0

    pairs = buckets.where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    roots = joined(verified(_likely(pairs, members, percent, miss)), None)
    # A member that has met all of its bucket leaves it.
    old, buckets = buckets, buckets.where("node != hub").select("band", "pos", "node")
    open_, rows, rest, pairs = reopened(buckets, roots)
    was = math.inf
    while pairs > 256 * rows and rest <= was / 2:  # many pairs, and centres still halve what is outside
        was = rest
        stars = open_.where("root != major").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        roots = joined(verified(_likely(stars, members, percent, miss)), roots)
        buckets, done = open_.where("node != hub").select("band", "pos", "node"), open_
        open_, rows, rest, pairs = reopened(buckets, roots)
        discard(done)
    if rows:
        likely = _block_pairs(open_, members, blocks[0], False).mapInArrow(partial(_block_best, percent=percent, miss=miss), "x long, y long, other long, matches long")
        likely = staged(spark, likely, "likely-ends")
        best = likely.where("y IS NOT NULL").groupBy("x", "other").agg(F.max_by("y", F.struct("matches", "y")).alias("y"))
        roots = joined(verified(best.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()), roots)
        ends = likely.select(F.col("x").alias("node")).distinct()
        last, rows, _, _ = reopened(open_.select("band", "pos", "node").join(ends, "node"), roots)
        if rows:
            links = _block_pairs(last, members, blocks[1], True).mapInArrow(partial(_block_links, percent=percent, width=width, miss=miss), "u long, v long")
            roots = joined(links, roots)
        discard(likely, last)
    rooted = classes.join(roots, "node", "left").select("cls", "node", "least", "size", F.coalesce("root", "node").alias("root"))
    rooted = staged(spark, rooted, "class-roots")
    lowest = staged(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "lowest")
    out = staged(spark, spread_join(rooted, lowest, "root", "n", ["node"]).select("cls", "root", "component_id", "size"), "class-components")
    discard(classes, shared, old, members, open_, rooted, lowest)
    return signed, out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, blocks: tuple[int, int] = (1024, 64)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (``doc_id``, ``text``).

    Texts are linked when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles
    (A-Z lower-cased); component_id is the smallest doc_id reachable. Null texts and texts without words have
    an empty set and stand alone. Repeated rows each get a row; null doc_ids have component_id null unless
    linked to one that is not. An empty table gives no rows; other columns are ignored. Candidates miss a
    pair at exactly 0.8 with probability (1 - 0.8^8)^56 = 3e-5, and ``miss`` for each batch of the signature.
    ``blocks``: members in a block of signatures and of texts.
    """
    signed, classes = _classes(docs, width, percent, miss, blocks)
    own = signed.select("doc_id", "n_shingles", "cls", "text_hash", "node").where("n_shingles > 0")
    some = spread_join(own, classes.select("cls", "component_id", "size"), "cls", "size", ["node"])
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, blocks: tuple[int, int] = (1024, 64)) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns, whatever their names.

    Of each component the row with the smallest doc_id stays (a null doc_id only if there is no other; of
    equal doc_ids the smallest text hash; of equal rows any one), and every row whose text is null or has
    no words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    signed, classes = _classes(docs, width, percent, miss, blocks)
    some = signed.select("doc_id", "text_hash", "n_shingles", "cls", "node").where("n_shingles > 0")
    some = spread_join(some, classes.select("cls", "root", "size"), "cls", "size", ["node"])
    first = some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash")
    bare = signed.where("n_shingles = 0").select("doc_id", "text_hash")
    # A row without words stands for itself; of equal rows with words one stays.
    t, d, h = unused(docs.columns, "_t", "_d", "_h")
    first = staged(spark, first.unionByName(bare.distinct()).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)), "near-kept")
    repeated = not signed.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    discard(signed, classes)
    stay = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit(""))))
    stay = stay.join(first, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(h)), "left_semi")
    if repeated:
        empty = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        stay = stay.where(~empty).dropDuplicates(["doc_id", t]).unionByName(stay.where(empty))
    return stay.drop(t)
