"""Columns over alignments written as operation strings (CIGAR) such as ``10M2D5M``.

``M``, ``=`` and ``X`` take a letter of query and reference, ``I`` of the query only, ``D`` and ``N`` of the reference
only; ``\\`` and ``/`` are frame shifts, forward and back. A null string gives null; '' has no operations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHED = ("M", "=", "X")
DELETED = ("D", "N")
OPERATION = r"\d+[MIDNSHP=X]"
SHIFT = r"\d+[\\/]"


def cleaned(cigar: Column) -> Column:
    """Plain operations only, without frame shifts."""
    return F.array_join(F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(0)), "")


def fused(cigar: Column) -> Column:
    """Plain operations only, equal neighbours as one."""
    kind = "struct<out:string,op:string,n:bigint>"
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("op"), F.lit(0).alias("n")).cast(kind)

    def written(acc: Column) -> Column:
        return F.when(acc["op"] == "", acc["out"]).otherwise(F.concat(acc["out"], acc["n"].cast("string"), acc["op"]))

    def step(acc: Column, o: Column) -> Column:
        same = acc["op"] == o["op"]
        return F.struct(F.when(same, acc["out"]).otherwise(written(acc)).alias("out"), o["op"].alias("op"), (F.when(same, acc["n"]).otherwise(0) + o["size"]).alias("n")).cast(kind)

    return F.aggregate(operations(cigar), start, step, written)


def operations(cigar: Column, shifts: bool = False) -> Column:
    """Plain operations, and frame shifts if asked for, as an array of (op, size)."""
    parts = F.regexp_extract_all(cigar, F.lit(rf"{OPERATION}|{SHIFT}" if shifts else OPERATION), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("size")))


def total(cigar: Column, kinds: tuple[str, ...]) -> Column:
    """Summed size of the operations of some kinds."""
    pattern = rf"(\d+)[{''.join(kinds)}]"
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1)), F.lit(0).cast("bigint"), lambda s, n: s + n.cast("bigint"))


def aligned(cigar: Column) -> Column:
    """Letters of the query that stand opposite a letter of the reference."""
    return total(cigar, MATCHED)


def deleted(cigar: Column) -> Column:
    """Letters of the reference that stand opposite a gap."""
    return total(cigar, DELETED)


def inserted(cigar: Column) -> Column:
    return total(cigar, ("I",))


def reference_span(cigar: Column) -> Column:
    return total(cigar, MATCHED + DELETED)


def shifts(cigar: Column) -> Column:
    """Frame shifts in the alignment."""
    return F.size(F.regexp_extract_all(cigar, F.lit(SHIFT), F.lit(0)))


def occupancy(cigar: Column) -> Column:
    """Aligned letters per letter of the reference; 0 for an alignment without reference."""
    return F.when(reference_span(cigar) == 0, 0.0).otherwise(aligned(cigar) / reference_span(cigar))


def gap_excluded_identity(matches: Column, mismatches: Column, digits: int = 2) -> Column:
    """Percentage of matches among aligned pairs, half to even; 0 without pairs."""
    pairs = matches + mismatches
    return F.when(pairs == 0, 0.0).otherwise(F.bround(100 * matches / pairs, digits))


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 x part / whole, half to even; 0 where the whole is not above 0."""
    return F.when(whole <= 0, 0.0).otherwise(F.bround(100 * part / whole, digits))


def repaired(nucleotides: Column, cigar: Column) -> Column:
    """The letters of a nucleotide segment that an alignment reads, frame shifts applied.

    Sizes of plain operations count codons. A forward shift skips letters, a backward shift steps back; deletions
    take nothing; every other operation takes three letters for each codon.
    """
    parts = F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X\\/]"), F.lit(0)), lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("n")))
    kind = "struct<at:int,out:string>"
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        taken = F.when(p["op"].isin("\\", "/", "D", "N"), 0).otherwise(p["n"] * 3)
        moved = F.when(p["op"] == "\\", p["n"]).when(p["op"] == "/", -p["n"]).otherwise(taken)
        piece = F.when(taken > 0, F.substr(nucleotides, F.greatest(acc["at"], F.lit(1)), taken)).otherwise("")
        return F.struct((acc["at"] + moved).alias("at"), F.concat(acc["out"], piece).alias("out")).cast(kind)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def placed(cigar: Column) -> Column:
    """Plain operations as an array of (op, size, on_reference, on_query): the letters of both that stand before each."""
    kind = "struct<r:int,q:int,out:array<struct<op:string,size:int,on_reference:int,on_query:int>>>"
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<op:string,size:int,on_reference:int,on_query:int>>").alias("out")).cast(kind)

    def step(acc: Column, o: Column) -> Column:
        here = F.struct(o["op"].alias("op"), o["size"].alias("size"), acc["r"].alias("on_reference"), acc["q"].alias("on_query"))
        r = acc["r"] + F.when(o["op"].isin(*MATCHED, *DELETED), o["size"]).otherwise(0)
        q = acc["q"] + F.when(o["op"].isin(*MATCHED, "I"), o["size"]).otherwise(0)
        return F.struct(r.alias("r"), q.alias("q"), F.concat(acc["out"], F.array(here)).alias("out")).cast(kind)

    return F.aggregate(operations(cigar), start, step, lambda acc: acc["out"])


def sliced(cigar: Column, first: Column, last: Column) -> Column:
    """The part of an alignment on reference letters first .. last (of the aligned ones, from 1), as a struct.

    Fields cigar, reference_first, reference_last, query_first, query_last (letters of the aligned sequences). Gaps at
    the ends are dropped, so that the part begins and ends with a pair of letters; insertions between two kept letters
    stay. Nothing is aligned anew. Null if no pair of letters is left.
    """

    def cut(o: Column) -> Column:
        low, high = F.greatest(first, o["on_reference"] + 1), F.least(last, o["on_reference"] + o["size"])
        pair, gap = o["op"].isin(*MATCHED), o["op"].isin(*DELETED)
        inside = (o["op"] == "I") & (first <= o["on_reference"]) & (o["on_reference"] < last)
        size = F.when(pair | gap, high - low + 1).when(inside, o["size"]).otherwise(0)
        on_query = o["on_query"] + low - o["on_reference"]
        return F.struct(o["op"].alias("op"), size.cast("int").alias("size"), pair.alias("pair"), low.cast("int").alias("low"), high.cast("int").alias("high"), on_query.cast("int").alias("from"))

    def whole(parts: Column) -> Column:
        pairs = F.transform(parts, lambda p: p["pair"])
        a, b = F.array_position(pairs, True), F.size(parts) + 1 - F.array_position(F.reverse(pairs), True)
        start, end = F.get(parts, (a - 1).cast("int")), F.get(parts, (b - 1).cast("int"))
        text = F.array_join(F.transform(F.slice(parts, a.cast("int"), (b - a + 1).cast("int")), lambda p: F.concat(p["size"].cast("string"), p["op"])), "")
        return F.when(a > 0, F.struct(
            text.alias("cigar"), start["low"].alias("reference_first"), end["high"].alias("reference_last"), start["from"].alias("query_first"), (end["from"] + end["size"] - 1).alias("query_last")
        ))

    parts = F.filter(F.transform(placed(cigar), cut), lambda p: p["size"] > 0)
    return F.get(F.transform(F.array(parts), whole), F.lit(0))  # the parts are made once
