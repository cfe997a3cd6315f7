"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions in one block of the first merging step; a hot entity is spread over its blocks.
BLOCK = 1 << 16
#: The last position; positions stand for seconds of timestamps and lengths for intervals, which reach no farther.
LAST = 10**11


def covered_periods(intervals: DataFrame, entity: str, first: str | Column, last: str | Column, block: int = BLOCK) -> DataFrame:
    """Maximal runs of covered positions: columns entity, first_pos, last_pos (bigint).

    Intervals are closed and may be given with their ends in either order; rows with a null entity or end, or an
    end outside 1 .. 10**11, count for nothing. Touching intervals (10 and 11) are one period.

    Intervals starting at one position are reduced to the longest before the shuffle, which bounds what a hot
    entity can send. ``session_window`` with the interval's own length as its gap then merges overlaps, first in
    blocks of start positions and then over the entity; what only touches is joined afterwards.
    """
    lo, hi = F.least(_col(first), _col(last)), F.greatest(_col(first), _col(last))
    usable = _col(first).isNotNull() & _col(last).isNotNull() & (lo >= 1) & (hi <= LAST) & F.col(entity).isNotNull()
    longest = (
        intervals.filter(usable)
        .select(F.col(entity).alias("_entity"), lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
        .groupBy("_entity", "_lo")
        .agg(F.max("_hi").alias("_hi"))
    )
    in_blocks = _merge_sessions(longest.withColumn("_block", F.floor(F.col("_lo") / block)), ["_entity", "_block"])
    merged = _merge_sessions(in_blocks, ["_entity"])
    order = W.partitionBy("_entity").orderBy("_lo")
    opens = F.when(F.col("_lo") <= F.lag("_hi").over(order) + 1, 0).otherwise(1)
    runs = merged.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    return runs.groupBy("_entity", "_run").agg(F.min("_lo").alias("first_pos"), F.max("_hi").alias("last_pos")).select(F.col("_entity").alias(entity), "first_pos", "last_pos")


def periods_and_gaps(intervals: DataFrame, entity: str, first: str | Column, last: str | Column) -> DataFrame:
    """The periods of :func:`covered_periods` and, between two of them, the gap: entity, kind, first_pos, last_pos."""
    periods = covered_periods(intervals, entity, first, last)
    order = W.partitionBy(entity).orderBy("first_pos")
    following = periods.withColumn("_next", F.lead("first_pos").over(order))
    period = F.struct(F.lit("period").alias("kind"), F.col("first_pos"), F.col("last_pos"))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("last_pos") + 1).alias("first_pos"), (F.col("_next") - 1).alias("last_pos"))
    both = F.when(F.col("_next").isNotNull(), F.array(period, gap)).otherwise(F.array(period))
    return following.select(entity, F.explode(both).alias("_x")).select(entity, "_x.kind", "_x.first_pos", "_x.last_pos")


def _merge_sessions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Position p stands for second p; a session lasts as long as its intervals do."""
    length = F.make_interval(secs=F.col("_hi") - F.col("_lo") + 1)
    session = F.session_window(F.timestamp_seconds("_lo"), length)
    grouped = rows.groupBy(*keys, session.alias("_session")).agg(F.count("*").alias("_n"))
    return grouped.select(
        keys[0], F.unix_seconds("_session.start").alias("_lo"), (F.unix_seconds("_session.end") - 1).alias("_hi")
    )


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
