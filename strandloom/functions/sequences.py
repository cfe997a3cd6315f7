"""Columns over sequences written as text. A null sequence gives null unless stated otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "-"
# The IUPAC nucleotide letters and their complements.
_NUCLEOTIDES = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
_COMPLEMENTS = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
# The bases in the order of the standard genetic code, and its amino acids.
BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


# What other genetic codes (by number) read differently from the standard one (11 reads alike).
OTHER_CODES = {
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"}, 4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, 6: {"TAA": "Q", "TAG": "Q"}, 9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"}, 10: {"TGA": "C"}, 11: {}, 12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"}, 14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"}, 15: {"TAG": "Q"}, 16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"}, 22: {"TCA": "*", "TAG": "L"}, 23: {"TTA": "*"}, 24: {"AGA": "S", "AGG": "K", "TGA": "W"}, 25: {"TGA": "G"}, 26: {"CTG": "A"},
}
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYBJOUXZ"


def genetic_code(number: int = 1) -> str:
    """The amino acids of all codons in the order T, C, A, G of a genetic code; ValueError if the number is unknown."""
    if number != 1 and number not in OTHER_CODES:
        raise ValueError(f"unknown genetic code {number}")
    code = list(STANDARD_CODE)
    for (a, b, c), amino in OTHER_CODES.get(number, {}).items():
        code[BASES.index(a) * 16 + BASES.index(b) * 4 + BASES.index(c)] = amino
    return "".join(code)


def ungapped(sequence: Column) -> Column:
    return F.translate(sequence, GAP, "")


def gap_count(sequence: Column) -> Column:
    return F.length(sequence) - F.length(ungapped(sequence))


def has_gaps(sequence: Column) -> Column:
    return F.contains(sequence, F.lit(GAP))


def missing_fraction(sequence: Column) -> Column:
    """Gaps per letter; 0 for an empty sequence."""
    return F.when(F.length(sequence) == 0, 0.0).otherwise(gap_count(sequence) / F.length(sequence))


def covered_fraction(sequence: Column) -> Column:
    """Letters that are no gap, per letter; 0 for an empty sequence."""
    return F.when(F.length(sequence) == 0, 0.0).otherwise(1 - gap_count(sequence) / F.length(sequence))


def gap_vector(sequence: Column) -> Column:
    """1 for each gap and 0 for each other letter."""
    return F.transform(letters(sequence), lambda c: (c == GAP).cast("int"))


def letters(sequence: Column) -> Column:
    """The letters as an array; empty for an empty sequence."""
    return F.when(F.length(sequence) == 0, F.array().cast("array<string>")).otherwise(F.split(sequence, ""))


def nongap_runs(sequence: Column) -> Column:
    """Runs of letters between gaps as an array of (first, last), counted from 1, the last run included."""
    pieces = F.regexp_extract_all(sequence, F.lit("-+|[^-]+"), F.lit(0))
    kind = "struct<at:int,runs:array<struct<first:int,last:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("runs")).cast(kind)

    def step(acc: Column, piece: Column) -> Column:
        run = F.struct((acc["at"] + 1).alias("first"), (acc["at"] + F.length(piece)).alias("last"))
        runs = F.when(F.startswith(piece, F.lit(GAP)), acc["runs"]).otherwise(F.concat(acc["runs"], F.array(run)))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), runs.alias("runs")).cast(kind)

    return F.aggregate(pieces, start, step, lambda acc: acc["runs"])


def padded(piece: Column, first: Column, last: Column, width: Column) -> Column:
    """A slice that covers first .. last of a sequence, filled with gaps to the full width."""
    return F.concat(F.repeat(F.lit(GAP), first - 1), piece, F.repeat(F.lit(GAP), width - last))


def reverse_complement(sequence: Column) -> Column:
    """The other strand; letters that are no nucleotide stay as they are. U becomes A."""
    return F.reverse(F.translate(sequence, _NUCLEOTIDES, _COMPLEMENTS))


def canonical(sequence: Column) -> Column:
    """The smaller of a sequence and its reverse complement, without gaps and in upper case: the same for both strands."""
    plain = F.upper(ungapped(sequence))
    return F.least(plain, reverse_complement(plain))


def is_nucleotide(sequence: Column) -> Column:
    """Nucleotide letters, gaps and stops of either case only."""
    return sequence.rlike("^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]*$")


def is_amino_acid(sequence: Column) -> Column:
    """Amino acid letters, gaps and stops of either case only, and not only such as stand for nucleotides too."""
    return sequence.rlike(f"(?i)^[{AMINO_ACIDS}*-]*$") & ~is_nucleotide(sequence)


def translated(sequence: Column, frame: int = 1, code: str = STANDARD_CODE) -> Column:
    """Amino acids of one reading frame (1..3, or -1..-3 on the other strand) of a sequence without gaps.

    Letters of U count as T; codons with other letters give X, an incomplete last codon nothing. ``code`` lists
    the amino acids of all codons in the order T, C, A, G.
    """
    strand = F.translate(F.upper(ungapped(sequence)), "U", "T")
    strand = reverse_complement(strand) if frame < 0 else strand
    shift = abs(frame) - 1
    place = np.full(256, 64, np.int16)
    place[[ord(c) for c in BASES]] = range(4)
    amino = np.frombuffer((code + "X").encode(), np.uint8)

    @F.pandas_udf("string")
    def translate(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            v = place[np.frombuffer(text.encode("ascii", "replace"), np.uint8)][shift:]
            v = v[: len(v) // 3 * 3].reshape(-1, 3)
            out.append(amino[np.minimum(v[:, 0] * 16 + v[:, 1] * 4 + v[:, 2], 64)].tobytes().decode())
        return pd.Series(out, dtype=object)

    return translate(strand)
