"""Hits that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hits import finite


def distinct_stream(hits: DataFrame, late: str = "30 days") -> DataFrame:
    """Each hit once, however often it is loaded again within ``late`` of its search time."""
    keys = ["queryid", "subjectid", "querystart", "queryend", "subjectstart", "subjectend", "cigar", "searched_at"]
    return hits.withColumn("searched_at", F.col("searched_at").cast("timestamp")).withWatermark("searched_at", late).dropDuplicatesWithinWatermark(keys)


def hits_by_day(hits: DataFrame, late: str = "30 days") -> DataFrame:
    """Hits, usable hits and best bitscore of each day of search; days close once the watermark has passed."""
    timed = hits.withColumn("searched_at", F.col("searched_at").cast("timestamp")).withWatermark("searched_at", late)
    return timed.groupBy(F.window("searched_at", "1 day")).agg(
        F.count("*").alias("hits"), F.count_if(finite("bitscore")).alias("usable"), F.max(F.when(finite("bitscore"), F.col("bitscore"))).alias("best")
    ).select(F.col("window.start").alias("day"), "hits", "usable", "best")
