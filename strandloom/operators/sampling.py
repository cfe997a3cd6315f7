"""Taking part of the records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace


def numbered(records: DataFrame, order: list[str]) -> DataFrame:
    """Records with their place (from 1) in a total order, without bringing them into one task.

    Rows are sorted by ranges; a place is the rows of all earlier ranges plus the place within the range.
    """
    ws = Workspace(records.sparkSession, "numbered")
    parted = ws.save(records.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_in", within).join(F.broadcast(before), "_part").select(*records.columns, (F.col("_in") + F.col("_before")).alias("place"))


def head(records: DataFrame, order: list[str], n: int, skip: int = 0) -> DataFrame:
    """The n records after the first ``skip`` in an order."""
    return numbered(records, order).filter((F.col("place") > skip) & (F.col("place") <= skip + n)).drop("place")


def at_positions(records: DataFrame, order: list[str], positions: DataFrame) -> DataFrame:
    """Records whose place is listed in ``positions`` (column place)."""
    return numbered(records, order).join(positions.select(F.col("place").cast("bigint").alias("place")).distinct(), "place", "left_semi")


def random_sample(records: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n records (all, if fewer) chosen by a hash of their key and a seed; mates that share a key are chosen alike.

    Records whose hash is below a threshold that leaves somewhat more than n are numbered in the order of hash and
    key, so no task holds the sample. Null keys come first of all. Jobs run while the result is built.
    """
    hashed = records.withColumn("_hash", F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit("")))
    total = records.count()
    part = min(1.0, 1.1 * n / total + 1e-4) if total else 1.0
    while part < 1 and hashed.filter(F.col("_hash") < f"{int(part * 16**8):08x}").count() < n:
        part = min(1.0, 2 * part)
    few = hashed if part >= 1 else hashed.filter(F.col("_hash") < f"{int(part * 16**8):08x}")
    return numbered(few, ["_hash", key]).filter(F.col("place") <= n).select(*records.columns)


def fraction_count(total: int, fraction: float) -> int:
    """Records of a fraction that is rounded up to its leading decimal digit."""
    if fraction <= 0:
        return 0
    step = 10.0 ** math.floor(math.log10(fraction))
    return min(total, math.ceil(total * math.ceil(round(fraction / step, 9)) * step - 1e-9))


def coverage(records: DataFrame, sequence: str, genome_size: int) -> DataFrame:
    """reads, mean_length and coverage (letters per letter of the genome)."""
    length = F.length(sequence)
    return records.agg(F.count(sequence).alias("reads"), F.round(F.avg(length), 6).alias("mean_length"), F.round(F.coalesce(F.sum(length), F.lit(0)) / genome_size, 6).alias("coverage"))
