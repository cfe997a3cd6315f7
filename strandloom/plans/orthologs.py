"""Comparing the best hit of each reference with it: the whole sequences aligned, scored and summarised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cig
from ..functions.alignment import aligned_pair
from ..operators import search as search_ops
from ..operators import stats
from ..session import Workspace


@dataclass(frozen=True)
class Comparison:
    """Statistics of each reference that was found, their summary and histograms."""

    statistics: DataFrame
    summary: DataFrame
    coverage: DataFrame
    identity: DataFrame


def scored_pairs(pairs: DataFrame, query: str, reference: str, *keep: str) -> DataFrame:
    """Local alignments of two sequence columns: lengths, counts, distance, query_cover and percent_identity beside the columns ``keep``."""
    rows = pairs.select(*keep, F.length(query).alias("query_len"), F.length(reference).alias("reference_len"), aligned_pair(F.col(query), F.col(reference), local=True).alias("a"))
    rows = rows.select(*keep, "query_len", "reference_len", "a.*")
    distance: Column = F.col("mismatches") + F.col("insertions") + F.col("deletions")
    cover = F.when(F.col("reference_len") > 0, F.bround(100 * (F.col("matches") + F.col("mismatches")) / F.col("reference_len"), 2)).otherwise(0.0)
    return rows.select("*", distance.alias("distance"), cover.alias("query_cover"), cig.gap_excluded_identity(F.col("matches"), F.col("mismatches")).alias("percent_identity"))


def compare_orthologs(queries: DataFrame, markers: DataFrame, nucleotides: bool = False, **options) -> Comparison:
    """Search proteins (or contigs, ``nucleotides``) against references and align the best hit of each reference as a whole.

    queries has seq_id and sequencedata, markers subjectid and sequencedata; ``options`` are those of a search. A
    contig is compared in the frame of its hit. Jobs run while the result is built.
    """
    ws = Workspace(queries.sparkSession, "orthologs")
    best = search_ops.best_pairs(queries, markers, nucleotides, **options)
    table = ws.save(scored_pairs(best, "protein", "reference", "queryid", "subjectid"))
    numbers = [c for c, kind in table.dtypes if kind != "string"]
    return Comparison(
        table, stats.describe(table, numbers), stats.histogram(table, "query_cover", stats.COVERAGE_CLASSES), stats.histogram(table, "percent_identity", stats.IDENTITY_CLASSES)
    )
