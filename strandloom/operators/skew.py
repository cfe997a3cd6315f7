"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one in HEAVY_PART of the rows, so fewer than HEAVY_PART keys are heavy ...
HEAVY_PART = 1000
#: ... and more rows than a task takes without trouble.
HEAVY_LEAST = 100_000


def heavy_limit(total: int) -> float:
    """The rows beyond which a key is heavy in a table of ``total`` rows."""
    return max(total / HEAVY_PART, HEAVY_LEAST)


def heavy_keys(df: DataFrame, key: str, total: int | None = None, weight: str | None = None) -> list[Any]:
    """The heavy keys of a table, fewer than HEAVY_PART whatever its size.

    ``weight`` names a column that already holds each key's rows; then ``df`` has one row for each key and
    ``total`` must be given. Null is no key.
    """
    total = df.count() if total is None else total
    if total <= HEAVY_LEAST:
        return []
    counts = df.select(key, F.col(weight).alias("_rows")) if weight else df.groupBy(key).agg(F.count("*").alias("_rows"))
    return [r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col("_rows") > heavy_limit(total))).select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, heavy: list[Any], how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row for each key.

    Rows of the ``heavy`` keys (see :func:`heavy_keys`) meet a broadcast table of at most as many rows and are not
    shuffled; all others go through an ordinary join. Null keys find no partner (``how='left'`` keeps them).
    """
    if not heavy:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    few = F.broadcast(right.filter(F.col(key).isin(heavy)))
    return left.filter(is_hot).join(few, key, how).unionByName(left.filter(~is_hot).join(right, key, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, heavy: list[Any], salts: int = 64) -> DataFrame:
    """Inner join of two tables that may both have many rows for a key.

    Rows of the ``heavy`` keys of ``left`` are dealt out to ``salts`` groups by a hash of the whole row; the rows of
    ``right`` with these keys go to each of the groups. All others go through an ordinary join.
    """
    if not heavy:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    dealt = left.filter(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copies = right.filter(F.col(key).isin(heavy)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt").unionByName(left.filter(~is_hot).join(right, key))
