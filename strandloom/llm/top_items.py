"""The N best items of every group by simultaneous bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, lookup_join
from ..session import Workspace

#: Midpoints counted in one round; 15 of them do four halvings in one pass.
MIDPOINTS = 15
#: Bytes of an identifier in one word of its code.
WORD = 7
_TOP = 1 << (8 * WORD)


def score_code(score: Column) -> Column:
    """A bigint that orders as the finite double does and differs for different doubles.

    Exponent and fraction are put together as they stand in the number's IEEE 754 form; every step is exact.
    """
    size = F.abs(score)
    # exponent by log2 may miss by one at powers of two; the fraction corrects it
    guess = F.floor(F.log2(size))
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    exponent = F.greatest(exponent, F.lit(-1022))
    fraction = size / F.pow(F.lit(2.0), exponent)  # 1 <= fraction < 2, less for subnormal numbers
    bits = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + (fraction * F.lit(float(1 << 52))).cast("bigint")
    return F.when(score == 0, F.lit(0)).when(score < 0, -bits).otherwise(bits)


def _word(level: Column, score: Column, item: Column) -> Column:
    """The level-th word of an item's code: its score, then its bytes, WORD at a time, so that smaller bytes rank higher, then its length (shorter first)."""
    hexed = F.hex(item.cast("binary"))
    part = F.rpad(F.substring(hexed, (level - 1) * (2 * WORD) + 1, F.lit(2 * WORD)), 2 * WORD, "0")
    value = F.conv(part, 16, 10).cast("bigint")
    beyond = (level - 1) * (2 * WORD) >= F.length(hexed)
    return F.when(level == 0, score_code(score)).when(beyond, F.lit(2 * _TOP) - F.length(hexed)).otherwise(F.lit(_TOP) - value)


def top_items(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The n best items of each group (all, if fewer): columns group, item, score.

    An item's score is its highest finite one; rows with a null group, item or score, or a score that is no finite
    number, count for nothing. Equal scores rank the smaller item (byte order of its UTF-8 text) first. item must
    be text; other columns are ignored; n below 1 gives no rows.

    Each item has an order-preserving code, its score followed by its identifier. Every group keeps an interval of
    codes that holds its cutoff; a round counts, for all groups at once and combined before the shuffle, the items
    above several midpoints, keeps what is above the cutoff's interval, drops what is below and goes on with the
    rest, until each group holds exactly n. No group is sorted or brought into one task: groups with more than
    1/1000 of the rows meet their cutoffs by a broadcast of at most 1000 rows, others by a join.
    """
    ws = Workspace(rows.sparkSession, "top")
    value = F.col(score).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    best = (
        rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & finite)
        .groupBy(F.col(group).alias("_g"), F.col(item).alias("_i"))
        .agg(F.max(value).alias("_s"))
    )
    left = ws.save(best.withColumn("_w", score_code(F.col("_s"))))
    bounds = ws.save(_bounds(left).select("_g", "_lo", "_hi", "_n", F.lit(n).cast("bigint").alias("_need"), F.lit(0).alias("_level")))
    chosen: DataFrame | None = None
    while True:
        taken, left, bounds = _round(ws, left, bounds)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        if bounds.isEmpty():
            return chosen.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score))


def _bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_g").agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi"), F.count("*").alias("_n"))


def _round(ws: Workspace, left: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settle what is settled and narrow the rest. Gives the chosen rows, the open rows and the open groups' intervals."""
    heavy = heavy_keys(bounds, "_g", left.count(), "_n")
    joined = lookup_join(left, bounds, "_g", heavy)
    done = F.col("_n") <= F.col("_need")
    # a group of one code left, yet too many items: go on to the next word of the code
    tied = ~done & (F.col("_lo") == F.col("_hi"))
    crossing = (F.col("_lo") < 0) & (F.col("_hi") >= 0)  # the first midpoint is 0, so that no difference overflows
    even = F.expr(f"(_w - _lo) div greatest(1L, (_hi - _lo) div {MIDPOINTS + 1} + 1)")
    slot = F.when(done | tied, F.lit(0).cast("bigint")).when(crossing, (F.col("_w") >= 0).cast("bigint")).otherwise(even)
    word = F.when(tied, _word(F.col("_level") + 1, F.col("_s"), F.col("_i"))).otherwise(F.col("_w"))
    level = F.when(tied, F.col("_level") + 1).otherwise(F.col("_level"))
    marked = ws.save(joined.select("_g", "_i", "_s", word.alias("_w"), slot.alias("_slot"), done.alias("_done"), level.alias("_level"), "_need"))
    open_rows = marked.filter("not _done")
    slots = open_rows.groupBy("_g", "_slot").agg(
        F.count("*").alias("_n"), F.min("_w").alias("_lo"), F.max("_w").alias("_hi"), F.first("_need").alias("_need"), F.first("_level").alias("_level")
    )
    # the items above each midpoint; a group has at most MIDPOINTS + 1 slots
    above = F.sum("_n").over(W.partitionBy("_g").orderBy(F.desc("_slot"))) - F.col("_n")
    holds = slots.withColumn("_above", above).filter("_above < _need and _above + _n >= _need")
    cut = ws.save(holds.select("_g", F.col("_slot").alias("_cut"), "_n", "_lo", "_hi", (F.col("_need") - F.col("_above")).alias("_need"), "_level"))
    met = lookup_join(open_rows.select("_g", "_i", "_s", "_w", "_slot"), cut.select("_g", "_cut", "_n", "_need"), "_g", heavy).filter("_slot >= _cut")
    wanted = (F.col("_slot") > F.col("_cut")) | (F.col("_n") == F.col("_need"))
    met = ws.save(met.select("_g", "_i", "_s", "_w", wanted.alias("_wanted")))
    taken = marked.filter("_done").select("_g", "_i", "_s").unionByName(met.filter("_wanted").select("_g", "_i", "_s"))
    following = met.filter("not _wanted").select("_g", "_i", "_s", "_w")
    return taken, following, cut.filter("_n != _need").select("_g", "_lo", "_hi", "_n", "_need", "_level")
