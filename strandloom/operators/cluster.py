"""Clustering of reads by the k-mers they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .skew import heavy_keys, lookup_join

# The 16-bit numbers of the nucleotide letters in the k-mer hash.
HASH_NUMBERS = {
    "A": 0x4567, "C": 0x23C6, "G": 0x9869, "T": 0x4873, "M": 0xDC51, "R": 0x5CFF, "W": 0x944A, "S": 0x58EC, "Y": 0x1F29,
    "K": 0x7CCD, "V": 0x58BA, "H": 0xD7AB, "D": 0x41F2, "B": 0x1EFB, "N": 0xA9E3, "-": 0xE146,
}
#: Length of a k-mer, k-mers kept for a sequence, and least identity of a cluster's members.
K, M, IDENTITY = 14, 20, 0.95


def kmer_table(records: DataFrame, index: str, sequence: str, k: int = K, m: int = M) -> DataFrame:
    """The m k-mers of each sequence with the lowest hashes: kmer, seqlen, kmerpos (from 1), msaindex, hash.

    The hash goes through the k-mer letter by letter: rotate 16 bits by 5, then XOR the letter's number. Of equal
    hashes the earlier position comes first, so that a k-mer counts as often as it occurs. Sequences are taken in
    upper case; k-mers with other letters are left out, as are records with a null index or sequence.
    """
    numbers = np.full(256, -1, np.int64)
    numbers[[ord(c) for c in HASH_NUMBERS]] = list(HASH_NUMBERS.values())

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = numbers[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                n = len(value) - k + 1
                if n < 1:
                    continue
                h, bad = np.zeros(n, np.int64), np.zeros(n, bool)
                for i in range(k):
                    part = value[i : i + n]
                    h = (((h << 5) | (h >> 11)) & 0xFFFF) ^ np.maximum(part, 0)
                    bad |= part < 0
                at = np.flatnonzero(~bad)
                at = at[np.argsort(h[at], kind="stable")[:m]]
                out += [(text[p : p + k], len(text), int(p) + 1, where, int(h[p])) for p in at]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kmer", "seqlen", "kmerpos", "msaindex", "hash"])

    plain = records.filter(F.col(index).isNotNull() & F.col(sequence).isNotNull()).select(F.col(index).cast("bigint").alias("i"), F.upper(sequence).alias("s"))
    return plain.mapInArrow(select, "kmer string, seqlen bigint, kmerpos bigint, msaindex bigint, hash int")


def kmer_centers(index: DataFrame) -> DataFrame:
    """Pairs (center, member), each once: every record of a k-mer with the longest of them (of equals, the smallest index).

    Rows without a k-mer, length or index count for nothing. A k-mer with a large part of the rows is combined
    before the shuffle and joined by a bounded broadcast.
    """
    rows = index.filter((F.col("kmer") != "") & F.col("seqlen").isNotNull() & (F.col("msaindex") >= 1)).select("kmer", "seqlen", "msaindex")
    best = rows.groupBy("kmer").agg(F.max(F.struct("seqlen", (-F.col("msaindex")).alias("n"))).alias("_c")).select("kmer", (-F.col("_c.n")).alias("center"))
    pairs = lookup_join(rows.select("kmer", "msaindex"), best, "kmer", heavy_keys(rows, "kmer"))
    return pairs.filter("center <> msaindex").select("center", F.col("msaindex").alias("member")).distinct()


def gap_free_matches(pairs: DataFrame, records: DataFrame, index: str, sequence: str, least: float = IDENTITY) -> DataFrame:
    """Pairs whose sequences, laid upon each other without gaps, agree in at least ``least`` of the shorter one's letters.

    Columns center, member, identity (of the first best shift). The first letters of both, as many as the shorter one
    has, are compared at every shift that leaves enough letters opposite each other to reach ``least``; overhanging
    letters count as different. Pairs with a record that is missing or empty are no match. Records are looked up by
    ``index``; of several the smallest sequence counts.
    """
    one = records.filter(F.col(index).isNotNull() & F.col(sequence).isNotNull()).groupBy(F.col(index).alias("_i")).agg(F.min(F.upper(sequence)).alias("_s")).filter("_s <> ''")
    both = pairs.select("center", "member")
    for end, text in (("center", "a"), ("member", "b")):  # a center with a large part of the pairs meets its text by broadcast
        both = lookup_join(both, one.select(F.col("_i").alias(end), F.col("_s").alias(text)), end, heavy_keys(pairs, end))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = min(len(a), len(b))
                x, y = (np.frombuffer(t.encode("ascii", "replace"), np.uint8)[:n] for t in (a, b))
                best = int((x == y).sum())
                for shift in range(1, n):
                    if n - shift <= best or n - shift < least * n:
                        break
                    best = max(best, int((x[shift:] == y[: n - shift]).sum()), int((y[shift:] == x[: n - shift]).sum()))
                out.append(best / n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["center", "member", "identity"])

    found = both.select("center", "member", "a", "b").mapInArrow(measure, "center bigint, member bigint, identity double")
    return found.filter(F.col("identity") >= least)


def cluster_reads(records: DataFrame, index: str, sequence: str, k: int = K, m: int = M, least: float = IDENTITY) -> DataFrame:
    """The whole clustering: k-mers, centers, gap-free comparison, greedy cover. Gives record and removed_by for all records that match another."""
    ws = Workspace(records.sparkSession, "clusters")
    pairs = ws.save(kmer_centers(kmer_table(records, index, sequence, k, m)))
    return greedy_cover(ws.save(gap_free_matches(pairs, records, index, sequence, least).select("center", "member")))


def greedy_cover(pairs: DataFrame) -> DataFrame:
    """Greedy set cover: centers from the one with most members down; a center that is not removed yet removes its members.

    Gives record and removed_by (the first center that removed it, null if it stands) for every record of the
    pairs. Of equally large clusters the smaller center comes first. A center is decided once all earlier centers
    that hold it as a member are; rounds are durable tables, and jobs run while the result is built.
    """
    ws = Workspace(pairs.sparkSession, "cover")
    once = ws.save(pairs.filter("center <> member").select("center", "member").distinct())
    sizes = ws.save(once.groupBy("center").agg(F.count("*").alias("n")))
    rank = F.struct((-F.col("n")).alias("n"), F.col("center").alias("c"))
    heavy = heavy_keys(sizes, "center", once.count(), "n")
    ranked = ws.save(lookup_join(once, sizes.select("center", rank.alias("rank")), "center", heavy))
    own = sizes.select(F.col("center").alias("member"), rank.alias("own"))
    # a center waits for the earlier ones that hold it as a member
    waiting = ws.save(lookup_join(ranked, own, "member", heavy_keys(ranked, "member")).filter("rank < own").select("center", "member"))
    gone = []
    while not waiting.isEmpty():
        free = waiting.join(waiting.select(F.col("member").alias("center")).distinct(), "center", "left_anti")
        removed = ws.save(free.select("member").distinct())
        left = waiting.join(removed, "member", "left_anti").join(removed.withColumnRenamed("member", "center"), "center", "left_anti")
        waiting = ws.save(left.select("center", "member"))
        gone.append(removed)
    acting = ranked
    if gone:
        acting = lookup_join(ranked, ws.together(*gone).select(F.col("member").alias("center")), "center", heavy, "left_anti")
    first = acting.groupBy("member").agg(F.min("rank").alias("r"))
    records = once.select(F.explode(F.array("center", "member")).alias("record")).distinct()
    return records.join(first.select(F.col("member").alias("record"), F.col("r.c").alias("removed_by")), "record", "left")
