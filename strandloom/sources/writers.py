"""Writing sequences, hits and summaries. Folders are written whole; ``overwrite`` replaces what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cig
from ..functions.identifiers import record_header


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def fasta_text(identifier: Column, sequence: Column, wrap: int = 0) -> Column:
    """A FASTA record, its sequence in lines of ``wrap`` letters (0: one line)."""
    body = F.regexp_replace(sequence, f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else sequence
    return F.concat(F.lit(">"), identifier, F.lit("\n"), body)


def write_fasta(records: DataFrame, path: str, identifier: str, sequence: str, by: str | None = None, whole_id: bool = False, wrap: int = 0, overwrite: bool = False) -> None:
    """FASTA files, in a folder for each value of ``by`` if it is given. Headers are the OTU part unless ``whole_id``."""
    head = F.col(identifier) if whole_id else record_header(F.col(identifier))
    rows = records.select(fasta_text(head, F.col(sequence), wrap).alias("value"), *([by] if by else []))
    writer = rows.write.mode(_mode(overwrite))
    (writer.partitionBy(by) if by else writer).text(path)


def write_chunks(records: DataFrame, path: str, identifier: str, sequence: str, per_file: int = 1_000_000, overwrite: bool = False) -> None:
    """FASTA files of at most ``per_file`` records each."""
    rows = records.select(fasta_text(F.col(identifier), F.col(sequence)).alias("value"))
    rows.write.mode(_mode(overwrite)).option("maxRecordsPerFile", per_file).text(path)


def write_hits(hits: DataFrame, path: str, omit: tuple[str, ...] = (), header: bool = False, by: str | None = None, overwrite: bool = False) -> None:
    """Hits as tab-separated text without some columns."""
    writer = hits.drop(*omit).write.mode(_mode(overwrite))
    (writer.partitionBy(by) if by else writer).csv(path, sep="\t", header=header, quote="")


def write_table(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Statistics as CSV with a header."""
    rows.write.mode(_mode(overwrite)).csv(path, header=True)


def alignment_text(stats: DataFrame) -> Column:
    """A readable block for each row of marker statistics."""
    shown = [
        ("Reference", "subjectid"), ("Reference length", "reference_len"), ("Query length", "query_len"), ("Contigs", "contigs"), ("Matches", "matches"),
        ("Mismatches", "mismatches"), ("Deletions", "deletions"),
    ]
    taken = cig.percentage(F.col("matches") + F.col("mismatches"), F.col("reference_len"), 2)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in shown], F.concat(F.lit("Occupancy: "), taken.cast("string")))
