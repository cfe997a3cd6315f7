"""The whole marker job: hits and references in, stitched sequences and statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import otu_part, sequence_part
from ..operators import hits as hit_ops
from ..operators import stats, stitch
from ..session import Workspace
from ..sources import writers


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; 0 switches a limit off."""

    identity: float = 0
    score: float = 0
    length: int = 0
    query_cover: float = 0
    subject_cover: float = 0
    evalue: float = 0
    top_percent: float = 0
    max_targets: int = 25
    max_hsps: int = 1
    retain_stops: bool = False
    retain_ambiguous: bool = False
    trim: bool = True
    window: int = 4
    least_mean: float = -7.0
    nucleotides: bool = True
    gap_open: int = 11
    gap_extend: int = 1
    matrix: dict[tuple[str, str], int] | None = None
    by_species: bool = False
    by_overlap: bool = False


@dataclass(frozen=True)
class Markers:
    """Results of a run: stitched sequences, statistics for each marker, their summary and histograms."""

    sequences: DataFrame
    statistics: DataFrame
    summary: DataFrame
    coverage: DataFrame
    identity: DataFrame

    def write(self, path: str, overwrite: bool = False) -> None:
        named = self.sequences.withColumn("marker", sequence_part(F.col("subjectid")))
        writers.write_fasta(named, f"{path}/sequences", "subjectid", "residues", by="marker", overwrite=overwrite)
        if "dna" in named.columns:
            writers.write_fasta(named, f"{path}/nucleotides", "subjectid", "dna", by="marker", overwrite=overwrite)
        for name in ("statistics", "summary", "coverage", "identity"):
            writers.write_table(getattr(self, name), f"{path}/{name}", overwrite)


def _species(hits: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects told apart by the OTU of the query."""
    otu = otu_part(F.col("queryid"))
    named = hits.filter("queryid is not null and subjectid is not null").withColumn("_plain", F.col("subjectid")).withColumn("subjectid", F.concat(otu, F.lit("|"), "subjectid"))
    pairs = named.select("_plain", F.col("subjectid").alias("_named")).distinct()
    copies = markers.join(pairs, F.col("subjectid") == F.col("_plain")).withColumn("subjectid", F.col("_named")).drop("_plain", "_named")
    return named.drop("_plain"), copies


def retrieve_markers(hits: DataFrame, markers: DataFrame, settings: Settings | None = None) -> Markers:
    """Filter and rank hits, let the best own each reference position, mask, trim, stitch and summarise.

    ``hits`` may come from a table, :func:`strandloom.sources.readers.read_hits` or :func:`strandloom.operators.search.search`.
    No hits give empty sequences and statistics. With ``by_species`` the hits of each OTU of the queries are stitched
    for themselves, under the reference's id with the OTU in front (``otu|subjectid``); with ``by_overlap`` overlaps go to
    the hit that scores best there (:func:`strandloom.operators.stitch.regions_by_overlap`). Jobs run while the result is built.
    """
    s = settings or Settings()
    ws = Workspace(hits.sparkSession, "markers")
    if s.by_species:
        hits, markers = _species(hits, markers)
    usable = hit_ops.filter_hits(hits, s.identity, s.score, s.length, s.query_cover, s.subject_cover, s.evalue, markers)
    usable = usable.filter("subjectstart is not null and subjectend is not null")  # else a hit without a place takes another's turn
    ranked = hit_ops.distinct_ids(usable, "queryid", "subjectid", "bitscore")
    if s.top_percent:
        ranked = hit_ops.top_percent(ranked, s.top_percent)
    ranked = ws.save(hit_ops.best_targets(ranked, s.max_targets, s.max_hsps))
    chosen = ws.save(usable.join(ranked.select("hit_id"), "hit_id", "left_semi"))  # sequences move only now
    owned = stitch.regions_by_overlap(chosen, markers, s.matrix) if s.by_overlap else None
    regions = ws.save(stitch.masked(stitch.resolve_regions(chosen, s.nucleotides, owned), s.retain_stops, s.retain_ambiguous))
    rows = stitch.stitched_on(regions, markers)
    if s.trim:
        rows = stitch.trimmed(rows, s.window, s.least_mean, gap_open=s.gap_open, gap_extend=s.gap_extend, matrix=s.matrix)
    rows = ws.save(rows)
    table = ws.save(stitch.aligned_statistics(ranked, regions, rows))
    numbers = [c for c, kind in table.dtypes if kind != "string"]
    return Markers(
        rows.drop("reference"), table, stats.describe(table, numbers),
        stats.histogram(table, "query_coverage", stats.COVERAGE_CLASSES), stats.histogram(table, "identity", stats.IDENTITY_CLASSES),
    )
