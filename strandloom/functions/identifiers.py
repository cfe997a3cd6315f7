"""Columns over identifiers of the form ``OTU@part``. A null identifier gives null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITER = "@"


def otu_part(identifier: Column, delimiter: str = DELIMITER) -> Column:
    """What stands before the first delimiter; '' if there is none."""
    return F.when(F.contains(identifier, F.lit(delimiter)), F.substring_index(identifier, delimiter, 1)).when(identifier.isNotNull(), "")


def sequence_part(identifier: Column, delimiter: str = DELIMITER) -> Column:
    """What stands after the last delimiter; the whole identifier if there is none."""
    return F.substring_index(identifier, delimiter, -1)


def has_spaces(identifier: Column) -> Column:
    return F.contains(identifier, F.lit(" "))


def compose(otu: Column, part: Column, delimiter: str = DELIMITER) -> Column:
    """OTU and part joined; the part alone where the OTU is null or ''."""
    return F.when(F.coalesce(otu, F.lit("")) == "", part).otherwise(F.concat(otu, F.lit(delimiter), part))


def with_prefix(identifier: Column, species: Column, delimiter: str = DELIMITER) -> Column:
    """The species in front of an identifier that names none."""
    return F.when(F.contains(identifier, F.lit(delimiter)), identifier).otherwise(F.concat(species, F.lit(delimiter), identifier))


def with_suffix(identifier: Column, gene: Column, delimiter: str = DELIMITER) -> Column:
    return F.concat(identifier, F.lit(delimiter), gene)


def fasta_header(fastq_header: Column) -> Column:
    """A FASTA header from a FASTQ header: first sign dropped, blanks as underscores, '>' in front."""
    return F.concat(F.lit(">"), F.translate(F.substr(fastq_header, F.lit(2)), " ", "_"))


def record_header(identifier: Column, delimiter: str = DELIMITER) -> Column:
    """The name a record is written under: its OTU, or the whole identifier where it has none."""
    return F.when(otu_part(identifier, delimiter) == "", identifier).otherwise(otu_part(identifier, delimiter))
