"""Consolidating matches into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import heavy_keys, lookup_join
from ..session import Workspace


def consolidate_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One group identifier for all records linked directly or through others: columns group_id, record_id.

    The identifier is the smallest record of the group. Null ends are ignored; records without a partner other
    than themselves have no row. Minimum labels are propagated along the pairs and pointers jumped, each round
    being a durable table, until no label changes (:func:`connected_components`).
    """
    linked = pairs.filter(F.col(a) != F.col(b))
    found = connected_components(linked, a, b)
    return found.select(F.col("component").alias("group_id"), F.col("node").alias("record_id"))


def consolidate_by_key(rows: DataFrame, record: str, key: str) -> DataFrame:
    """The groups of records that share a key, directly or through others, as :func:`consolidate_pairs` gives them.

    A key held by k records contributes its k - 1 pairs with its smallest record, never all pairs. A key with a
    large part of the rows is pre-aggregated before the shuffle and joined by a bounded broadcast. Null records
    and null keys are ignored.
    """
    ws = Workspace(rows.sparkSession, "consolidate")
    held = ws.save(rows.select(F.col(record).alias("_r"), F.col(key).alias("_k")).filter("_r is not null and _k is not null").distinct())
    first = held.groupBy("_k").agg(F.min("_r").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    first = ws.save(first)
    heavy = heavy_keys(first, "_k", held.count(), "_n")
    stars = lookup_join(held, first.select("_k", "_first"), "_k", heavy)
    return consolidate_pairs(stars, "_first", "_r")


def kmer_groups(kmer_index: DataFrame) -> DataFrame:
    """Groups of records with a k-mer in common: group_msaindex, msaindex.

    Rows count if msaindex is at least 1 and kmer has one letter or more, all of them A, C, G or T in either case.
    """
    rows = kmer_index.filter(F.col("kmer").rlike("^[ACGTacgt]+$") & ~F.col("kmer").endswith("\n") & (F.col("msaindex") >= 1))
    groups = consolidate_by_key(rows.select("msaindex", F.upper("kmer").alias("kmer")), "msaindex", "kmer")
    return groups.select(F.col("group_id").alias("group_msaindex"), F.col("record_id").alias("msaindex"))
