"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents are sets of word shingles; equal sets form a class with one representative. Two sets that are
similar enough share a gram within a short prefix of each, in any one order of all grams; with the rare grams
first, few others share it.

1. The range of hashes is cut into parts, some more than similar sets can have differences. Each difference
   falls into one part, so similar sets have the same grams in several of them: a representative whose parts are nobody
   else's has no partner. Parts are digests of several grams each, which texts seldom share by chance, however many.
2. The grams of the others are counted. Ordered by the octave of their count, grams of one document alone
   come first; a document whose whole prefix is made of these has no partner. The rest of its grams are
   its keys.
3. Documents that share a gram of their prefixes form a bucket. Its members meet one centre first; once
   the links found so far are joined, only buckets that still span several components go on, with another
   centre for as long as this halves what is left. Then small buckets name their pairs of different components, and
   large ones are settled in pairs of blocks of bounded bytes: no bucket is cut short, and no large one emits
   its pairs.
4. A pair goes through the filters on keys, then the overlap of its keys; what is left is verified on the sets of
   words themselves, once, as both ends belong to one component then.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mark_possible, small_batches, spread_join, staged
from .components import components
from .near_dedup import _similar, shingle_hashes
from .words import mix, word_hashes

_SETS = "node long, doc_id long, text_hash long, n_shingles long, cls binary, probes array<struct<need: int, parts: array<long>>>"
#: Keys are the octave of a gram's count (5 bits) before the upper 58 bits of its hash, so they sort rare-first. Two grams
#: of one key only let more pairs through the filters.
_OCTAVES, _CUT = 31, 6
#: Members of a bucket whose pairs are named; larger ones are settled in blocks.
SMALL = 32


@lru_cache
def size_ranges(percent: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Ranges of set sizes as (where each begins, (largest partner of a set within it, most differences of a pair whose
    smaller set lies within it, parts)). A pair is looked for in the range of its smaller set."""
    begins, about = [1], []
    while begins[-1] < 1 << 40:
        begins.append(begins[-1] + -(-begins[-1] // 2))
        most = begins[-1] - 1
        partner = most * 100 // percent
        differences = (most + partner) * (100 - percent) // (100 + percent)
        about.append((partner, differences, differences + 1 + -(-differences // 8)))
    return begins, about


def part_probes(grams: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(how many parts a partner must share at least, digests of the parts that hold grams) of a set of sorted hashes, for
    each range that a partner may meet it in."""
    n, out = len(grams), []
    begins, about = size_ranges(percent)
    for c in range(bisect_right(begins, n) - 1, -1, -1):
        partner, differences, parts = about[c]
        if partner < n:
            break
        if differences:
            place = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # hashes are sorted, so parts lie together
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            own = mix(np.add.reduceat(mix(grams), starts) + (place[starts] << np.uint64(8)) + np.uint64(c))
            out.append((parts - differences - (parts - len(starts)), own))
    return out


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 2 << 20):
        hashes, at = word_hashes(batch.column("text"))
        rows, probes, counts = [], [], [0]
        for i in range(batch.num_rows):
            own = shingle_hashes(hashes[at[i] : at[i + 1]], width)
            rows.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None))
            probes += part_probes(own, percent) if len(own) else []
            counts.append(len(probes))
        parts = pa.ListArray.from_arrays(np.cumsum([0, *(len(p) for _, p in probes)], dtype=np.int32), np.concatenate([np.zeros(0, np.uint64), *(p for _, p in probes)]).view(np.int64))
        each = pa.StructArray.from_arrays([pa.array([n for n, _ in probes], pa.int32()), parts], ["need", "parts"])
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary()))] + [pa.ListArray.from_arrays(np.array(counts, np.int32), each)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "doc_id", "text_hash")), *made], ["node", "doc_id", "text_hash", "n_shingles", "cls", "probes"])


def _grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 2 << 20):
        hashes, at = word_hashes(batch.column("text"))
        own = [shingle_hashes(hashes[at[i] : at[i + 1]], width).view(np.int64) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "grams"])


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection of sets of n and m that are similar."""
    return -(-percent * (n + m) // (100 + percent))


def _prefix(keys: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The keys within the prefix of n - ceil(n * percent / 100) + 1 grams; those of one document come first and are no keys."""
    return keys[: max(0, n + percent * -n // 100 + 1 - (n - len(keys)))]


def suffix_distance(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of how many elements of two sorted arrays have no partner: both are parted at the middle of ``y``,
    ``depth`` times, and the parts' sizes compared. Ends early once it is over ``most``."""
    if depth == 0 or not len(x) or not len(y) or abs(len(x) - len(y)) > most:
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    hit = int(at < len(x) and x[at] == y[middle])
    rest = abs(len(x) - at - hit - (len(y) - middle - 1)) + 1 - hit
    left = suffix_distance(x[:at], y[:middle], most - rest, depth - 1)
    if left + rest > most:
        return left + rest
    return left + 1 - hit + suffix_distance(x[at + hit :], y[middle + 1 :], most - left - 1 + hit, depth - 1)


def first_shared(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> int | None:
    """The first key in both prefixes."""
    both = np.intersect1d(_prefix(a, n, percent), _prefix(b, m, percent), assume_unique=True)
    return int(both[0]) if len(both) else None


def similar_keys(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int, first: int | None, depth: int = 3) -> bool:
    """Whether sets of n and m grams with the sorted keys a and b, whose prefixes share ``first`` first, pass all filters and
    overlap enough in their keys."""
    if first is None or 100 * min(n, m) < percent * max(n, m):
        return False
    need, i, j = least_overlap(n, m, percent), int(np.searchsorted(a, first)), int(np.searchsorted(b, first))
    if 1 + min(len(a) - i, len(b) - j) - 1 < need:  # position
        return False
    most = n + m - 2 * need - (n - len(a) + i) - (m - len(b) + j)
    if most < 0 or suffix_distance(a[i + 1 :], b[j + 1 :], most, depth) > most:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, n, b, m in zip(*(batch.column(c) for c in ("ka", "na", "kb", "nb")), strict=True):
            a, n, b, m = a.values.to_numpy(), n.as_py(), b.values.to_numpy(), m.as_py()
            keep.append(similar_keys(a, n, b, m, percent, first_shared(a, n, b, m, percent)))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Similar pairs of two blocks of a bucket; a member is compared with a component until it has met it, and a pair in
    the bucket of the first gram that it shares only."""
    for batch in batches:
        for gram, *sides in zip(batch.column("gram").to_pylist(), batch.column("l"), batch.column("r"), strict=True):
            left, right = ([(node, root, n, keys.values.to_numpy()) for node, root, n, keys in zip(*(side.values.field(c).to_pylist() for c in ("node", "root", "n")), side.values.field("keys"), strict=True)] for side in sides)
            links = []
            for u, root, n, a in left:
                met = {root}
                for v, other, m, b in right:
                    if other in met or 100 * min(n, m) < percent * max(n, m):
                        continue
                    if (first := first_shared(a, n, b, m, percent)) == gram and similar_keys(a, n, b, m, percent, first):
                        met.add(other)
                        links.append((max(u, v), min(u, v)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def _filtered(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that pass the filters on keys; a v of many pairs is dealt over tasks."""
    spark = members.sparkSession
    pairs = staged(spark, pairs, "pairs")
    a = members.select(F.col("node").alias("u"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    b = pairs.groupBy("v").agg(F.count("*").alias("times")).join(members.select(F.col("node").alias("v"), F.col("n").alias("nb"), F.col("keys").alias("kb")), "v")
    b = staged(spark, b, "centres")
    out = staged(spark, spread_join(pairs.join(a, "u"), b, "v", "times", ["u"]).mapInArrow(partial(_pairs, percent=percent), "u long, v long"), "likely")
    discard(pairs, b)
    return out


def _key(gram: Column, count: Column) -> Column:
    octave = F.least(F.length(F.bin(count)) - 1, F.lit(_OCTAVES)).cast("long")
    return F.shiftleft(octave, 64 - _CUT).bitwiseOR(F.shiftrightunsigned(gram, _CUT))


def _unsettled(spark: SparkSession, buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, int, float, float]:
    """(members of buckets over several components with the largest part, its centre and weights, how many rows, how many
    outside the largest parts, pairs between these and all)."""
    now = buckets.join(roots, "node", "left").select("gram", "node", "weight", F.coalesce("root", "node").alias("root"))
    now = staged(spark, now, "rooted")
    parts = now.groupBy("gram", "root").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.sum("weight").alias("w"))
    spans = parts.groupBy("gram").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), F.sum("w").alias("w"), F.max(F.struct("n", "root", "hub", "w")).alias("major")).where("parts > 1")
    spans = spans.select("gram", "members", "w", F.col("major.root").alias("major"), F.col("major.hub").alias("hub"), (F.col("members") - F.col("major.n")).alias("rest"), (F.col("w") - F.col("major.w")).alias("rest_w"))
    spans = staged(spark, spans, "spans")
    rows, rest, pairs = spans.agg(F.sum("members"), F.sum("rest"), F.sum(F.col("members").cast("double") * F.col("rest"))).first()
    out = staged(spark, spread_join(now, spans, "gram", "members", ["node"]), "open")
    discard(now, spans)
    return out, rows or 0, rest or 0, pairs or 0


def _settled(members: DataFrame, buckets: DataFrame, percent: int, width: int, block_bytes: int) -> DataFrame:
    """node, root of the members that have a link. ``members``: node, n, keys, text; ``buckets``: gram, node, weight, of two
    members or more."""
    spark = members.sparkSession

    def joined(likely: DataFrame, roots: DataFrame | None) -> DataFrame:
        links = _similar(likely, members, percent, width)
        if roots is not None:
            links = links.unionByName(roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        return components(spark, links)

    hubs = buckets.groupBy("gram").agg(F.min("node").alias("hub"), F.count("*").alias("members"))
    met = spread_join(buckets, staged(spark, hubs, "hubs"), "gram", "members", ["node"])
    pairs = met.where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    roots = joined(_filtered(pairs, members, percent), None)
    rest_of = met.where("node != hub").select("gram", "node", "weight")
    open_, rows, rest, pairs = _unsettled(spark, rest_of, roots)
    was = math.inf
    while pairs > 256 * rows and rest <= was / 2:  # many pairs, and centres still halve what is outside
        was, done = rest, open_
        stars = open_.where("root != major").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        roots = joined(_filtered(stars, members, percent), roots)
        open_, rows, rest, pairs = _unsettled(spark, open_.where("node != hub").select("gram", "node", "weight"), roots)
        discard(done)
    if not rows:
        return roots
    # A small bucket gives its pairs, so that long documents are not copied for each gram of their prefixes: under SMALL / 2 a row.
    few, done = open_.where(F.col("members") <= SMALL).select("gram", "node", "root", "major"), open_
    others = few.select("gram", F.col("node").alias("v"), F.col("root").alias("other"))
    pairs = few.where("root != major").join(others, "gram").where("root != other").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v"))
    roots = joined(_filtered(pairs.distinct(), members, percent), roots)
    open_, rows, rest, pairs = _unsettled(spark, done.where(F.col("members") > SMALL).select("gram", "node", "weight"), roots)
    discard(done)
    if not rows:
        return roots
    held = open_.join(members.select("node", "n", "keys"), "node")
    row = F.struct("node", "root", "n", "keys")
    blocks = lambda w: F.ceil(F.col(w) * 8 / block_bytes).cast("int")
    block = lambda w: F.pmod(F.xxhash64("node"), blocks(w)).cast("int")
    left = held.where("root != major").withColumn("lb", block("rest_w")).withColumn("rb", F.explode(F.sequence(F.lit(0), blocks("w") - 1)))
    left = left.groupBy("gram", "lb", "rb").agg(F.collect_list(row).alias("l"))
    right = held.groupBy("gram", block("w").alias("rb")).agg(F.collect_list(row).alias("r"))
    found = left.join(right, ["gram", "rb"]).mapInArrow(partial(_block_pairs, percent=percent), "u long, v long")
    return joined(staged(spark, found.distinct(), "block-pairs"), roots)


def _partners(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """node of the representatives that share enough parts with others; where a partner may share empty parts only, all stay.
    Only sets that may have copies are joined to find their representative, and only parts that may be shared are shuffled
    to find their sharers: most sets have neither."""
    spark = signed.sparkSession
    sets = mark_possible(signed.where("n_shingles > 0").select("node", "cls", "probes"), classes.where("size > 1"), ["cls"], "copied")
    alone = sets.where("NOT copied").select("node", "probes")
    first = sets.where("copied").select("node", "probes").join(classes.select("node"), "node")
    probes = alone.unionByName(first).select("node", F.posexplode("probes").alias("c", "p"))
    parts = probes.where("p.need > 0").select("node", "c", "p.need", F.explode("p.parts").alias("part"))
    shared = staged(spark, parts.groupBy("part").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    parts = mark_possible(parts, shared, ["part"], "possible").where("possible").drop("possible")
    hits = spread_join(parts, shared, "part", "times", ["node"]).groupBy("node", "c", "need").agg(F.count("*").alias("hits"))
    out = staged(spark, hits.where("hits >= need").select("node").unionByName(probes.where("p.need <= 0").select("node")).distinct(), "partners")
    discard(shared)
    return out


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs`` (``doc_id``, ``text``).

    Texts link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles (A-Z
    lower-cased; with fewer words, the whole sequence is one shingle); component_id is the smallest doc_id reachable.
    No link between different texts is lost. Null texts and texts without words have an empty set and stand
    alone. Repeated rows each get a row; null doc_ids have component_id null unless linked to one that is not.
    An empty table gives no rows; other columns are ignored. A text of any length is one set, held by one task.
    ``block_bytes``: keys in a block, where a bucket has to be settled pair by pair.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = staged(spark, docs.withColumn("node", F.monotonically_increasing_id()).mapInArrow(partial(_sets, width=width, percent=percent), _SETS), "sets")
    classes = staged(spark, signed.where("n_shingles > 0").groupBy("cls").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes")
    partners = _partners(signed, classes)
    wanted = staged(spark, signed.select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).join(partners, "node"), "wanted")
    given = mark_possible(docs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "text"), wanted, ["d", "h"], "possible").where("possible")  # few texts are shuffled
    found = wanted.alias("w").join(given.alias("g"), F.col("w.d").eqNullSafe(F.col("g.d")) & (F.col("w.h") == F.col("g.h"))).select("node", "text")
    if not signed.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["node"])
    texts = staged(spark, found, "texts")
    own = staged(spark, signed.select("doc_id", "n_shingles", "cls", "node"), "own")
    discard(signed, partners, wanted)
    grams = staged(spark, texts.mapInArrow(partial(_grams, width=width), "node long, grams array<long>"), "grams")
    each = grams.select("node", F.explode("grams").alias("gram"))
    counts = staged(spark, each.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"), "counts")
    keyed = spread_join(each, counts, "gram", "times", ["node"]).groupBy("node").agg(F.array_sort(F.collect_list(_key(F.col("gram"), F.col("times")))).alias("keys"))
    members = grams.select("node", F.size("grams").cast("long").alias("n")).join(keyed, "node")
    inside = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - (F.col("n") - F.size("keys"))).cast("int")
    members = staged(spark, members.withColumn("inside", inside).where("inside > 0").join(texts, "node"), "members")
    prefixes = members.select("node", F.size("keys").alias("weight"), F.explode(F.slice("keys", F.lit(1), F.col("inside"))).alias("gram"))
    several = staged(spark, prefixes.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1"), "several")
    buckets = staged(spark, spread_join(prefixes, several, "gram", "members", ["node"]).select("gram", "node", "weight"), "buckets")
    discard(grams, counts, texts, several)
    roots = _settled(members, buckets, percent, width, block_bytes)
    rooted = staged(spark, classes.join(roots, "node", "left").select("cls", "node", "least", "size", F.coalesce("root", "node").alias("root")), "class-roots")
    lowest = staged(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "lowest")
    joined = staged(spark, spread_join(rooted, lowest, "root", "n", ["node"]).select("cls", "component_id", "size"), "class-components")
    discard(members, buckets, rooted, lowest, classes)
    some = spread_join(own.where("n_shingles > 0"), joined, "cls", "size", ["node"])
    none = own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none)
