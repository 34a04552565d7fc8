"""Temperature mixing of sources: weights by bisection, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, quoted, spread_join, staged, unused

#: Exponents that one pass over the sources tries, and passes of a search: 64^6 steps of the interval.
TRIED, PASSES = 64, 6
_SPAN = float(1 << 62)


def _last(holds: Callable[[list[float]], list[bool]]) -> float:
    """The largest x in [0, 1] for which a condition holds that holds at 0 and fails from some point on."""
    lo, hi = 0.0, 1.0
    if holds([1.0])[0]:
        return 1.0
    for _ in range(PASSES):
        steps = [lo + (hi - lo) * i / TRIED for i in range(TRIED + 1)]
        good = [True, *holds(steps[1:-1]), False]
        i = good.index(False) - 1
        lo, hi = steps[i], steps[i + 1]
    return lo


def find_exponent(sums: Callable[[list[float]], list[tuple[float, float]]], kinds: int, smallest: float, budget: float, target: float, most: float) -> float:
    """The exponent in [0, 1] nearest to 1 whose entropy reaches ``target`` times that of equal weights;
    raised again, if need be, until no source repeats over ``most`` times (at 1 all repeat equally).

    ``sums`` gives for each exponent a the sums over all sources of p^a and of p^a ln p, where p is the share
    of a source in all tokens; ``smallest`` is the least share and ``budget`` a multiple of all tokens. With
    exponents under 1 the smallest source repeats most.
    """
    if kinds == 0:
        return 1.0
    even = math.log(kinds)
    enough = lambda tried: [math.log(z) - a * s / z >= target * even - 1e-12 for a, (z, s) in zip(tried, sums(tried), strict=True)]
    repeats = lambda tried: [smallest ** (a - 1) / z * budget for a, (z, _) in zip(tried, sums(tried), strict=True)]
    a = _last(enough)
    if repeats([a])[0] <= most + 1e-12:
        return a
    return 1.0 - _last(lambda tried: [r <= most + 1e-12 for r in repeats([1.0 - x for x in tried])])


def _hash(seed: str, *columns: Column) -> Column:
    """A pseudo-random number from 0 to 2^62 - 1 of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)


def _cut(units: DataFrame, keys: list[str], order: str, tokens: str, inside: str) -> DataFrame:
    """Of each ``keys`` the unit in which a running sum by ``order`` passes ``_room``, with ``_room`` lessened by the
    units before it; ``inside``: name for the unit's ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = units.withColumn("_end", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = upto.where((F.col("_end") > F.col("_room")) & (F.col("_end") - F.col(tokens) <= F.col("_room")) & (F.col(tokens) > 0))
    return hit.select(*keys, F.col(order).alias(inside), (F.col("_room") - F.col("_end") + F.col(tokens)).alias("_room"))


def mix_sources(docs: DataFrame, target: float = 0.97, most: float = 2.0, budget: int | None = None, rows_per_block: int = 1024, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each as often as it is repeated.

    Tokens are the words of whole texts. The budget defaults to all tokens; a source's quota is its tempered
    weight of it. Each source's rows are dealt by hash into blocks of about ``rows_per_block``; a pass takes
    the blocks in an order permuted anew for that pass, and the rows of a block in the order of their
    hashes. Full passes take every row; the last one takes the rows up to the place that comes nearest to
    the quota, so a source misses it by half of one of its documents at most, however long it is.

    Keeps all columns of ``docs`` and adds ``repetition`` (the pass, from 0), ``block``, ``position`` (0 to 1:
    sorted by it, every stretch of the mixture holds the sources at about their weights) and ``n_tokens``;
    a name that ``docs`` already has, in any case, gets underscores behind it. A null source is a source of
    its own. Null or empty texts count no tokens; they come with every full pass. Rows of equal doc_id, text
    and source are taken together. An empty table gives no rows. No row moves to be chosen: each is compared
    with its source's place of the cut.
    """
    spark = docs.sparkSession
    repetition, block, position, n_tokens, s, d, kept, p, count = unused(docs.columns, "repetition", "block", "position", "n_tokens", "_source", "_row", "_passes", "_plan", "_rows")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = _hash(seed, F.lit("row"), F.col("doc_id"), F.col("text"))
    slim = staged(spark, docs.select(source.alias("_s"), row.alias("_d"), words.alias("_n")), "mix-documents")
    totals = staged(spark, slim.groupBy("_s").agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows")), "mix-sources")
    all_tokens, kinds, smallest = totals.where("_tokens > 0").agg(F.coalesce(F.sum("_tokens"), F.lit(0)), F.count("*"), F.min("_tokens")).first()
    budget = all_tokens if budget is None else budget
    share = F.col("_tokens") / F.lit(float(all_tokens or 1))

    def sums(tried: list[float]) -> list[tuple[float, float]]:
        """One pass over the table of sources for all exponents tried."""
        of = totals.where("_tokens > 0").select(share.alias("p"), F.posexplode(F.array(*map(F.lit, tried))).alias("i", "a"))
        got = {r["i"]: (r["z"], r["s"]) for r in of.groupBy("i").agg(F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("s")).collect()}
        return [got[i] for i in range(len(tried))]

    exponent = find_exponent(sums, kinds, (smallest or 1) / (all_tokens or 1), budget / (all_tokens or 1), target, most)
    whole = sums([exponent])[0][0] if kinds else 1.0
    quota = F.when(F.col("_tokens") > 0, F.pow(share, F.lit(exponent)) / whole * F.lit(float(budget))).otherwise(0.0)
    full = F.when(F.col("_tokens") > 0, F.floor(F.col("_quota") / F.col("_tokens") + 1e-12)).otherwise(1)
    plan = totals.withColumn("_quota", quota).withColumn("_full", full.cast("long")).withColumn("_room", F.greatest(F.lit(0.0), F.col("_quota") - F.col("_full") * F.col("_tokens")))
    plan = staged(spark, plan.withColumn("_blocks", F.ceil(F.col("_rows") / rows_per_block).cast("long")), "mix-plan")

    def block_of(row: Column, blocks: Column) -> Column:
        return F.pmod(_hash(seed, F.lit("block"), row), blocks)

    def order_of(source: Column, turn: Column, block: Column) -> Column:
        """The place of a block among those of its source in one pass."""
        return _hash(seed, F.lit("order"), source, turn.cast("long"), block)

    # Where the last pass ends: by ranges of the order, then by its blocks there, then by rows of that block.
    order = order_of(F.col("_s"), F.col("_full"), block_of(F.col("_d"), F.col("_blocks")))
    rows = spread_join(slim, plan.where("_room > 0").select("_s", "_full", "_blocks", "_room", "_rows"), "_s", "_rows", ["_d"], small=65_536).withColumn("_b", order)
    blocks = staged(spark, rows.groupBy("_s", F.shiftright("_b", 50).alias("_range"), "_b").agg(F.sum("_n").alias("_n"), F.first("_room").alias("_room")), "mix-blocks")
    in_range = _cut(blocks.groupBy("_s", "_range").agg(F.sum("_n").alias("_n"), F.first("_room").alias("_room")), ["_s"], "_range", "_n", "_range")
    in_block = _cut(blocks.drop("_room").join(in_range, ["_s", "_range"]), ["_s", "_range"], "_b", "_n", "_b").select("_s", F.col("_b").alias("_cut"), "_room")
    in_block = staged(spark, in_block.join(plan.select("_s", "_full", "_blocks", "_rows"), "_s"), "mix-cuts")
    cut_rows = spread_join(slim, in_block, "_s", "_rows", ["_d"], small=65_536).where(order == F.col("_cut"))
    cut_rows = cut_rows.groupBy("_s", "_d").agg(F.sum("_n").alias("_n"), F.first("_room").alias("_room"))
    w = Window.partitionBy("_s").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)  # rows of one block
    nearest = cut_rows.withColumn("_end", F.sum("_n").over(w)).where((F.col("_end") <= F.col("_room")) | (F.col("_end") - F.col("_room") < F.col("_room") - F.col("_end") + F.col("_n")))
    ends = in_block.select("_s", "_cut").join(nearest.groupBy("_s").agg(F.max("_d").alias("_last")), "_s", "left")
    old = plan
    plan = plan.join(ends, "_s", "left").select(F.col("_s").alias(s), F.col("_rows").alias(count), F.struct("_full", "_blocks", "_tokens", "_room", "_cut", "_last").alias(p))
    plan = staged(spark, plan, "mix-ends")
    discard(slim, totals, blocks, in_block, old)

    of = F.col(p)
    tagged = spread_join(docs.withColumn(s, source).withColumn(d, row), plan, s, count, [d], small=65_536).withColumn(block, block_of(F.col(d), of["_blocks"]))
    place = order_of(F.col(s), of["_full"], F.col(block))
    before = of["_cut"].isNull() | (place < of["_cut"]) | ((place == of["_cut"]) & (F.col(d) <= F.coalesce(of["_last"], F.lit(-1))))
    taken = tagged.withColumn(kept, of["_full"].cast("int") + F.when((of["_room"] > 0) & before, 1).otherwise(0)).where(F.col(kept) > 0)
    taken = taken.withColumn(repetition, F.explode(F.sequence(F.lit(0), F.col(kept) - 1)))
    reach = F.greatest(of["_full"] + of["_room"] / F.greatest(of["_tokens"], F.lit(1)), F.lit(1e-9))
    spot = (F.col(repetition) + order_of(F.col(s), F.col(repetition), F.col(block)) / F.lit(_SPAN)) / reach
    return taken.select(*quoted(docs.columns), repetition, block, F.least(F.lit(1.0), spot).alias(position), words.alias(n_tokens))
