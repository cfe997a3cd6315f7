"""Selecting and deduplicating search hits and sequence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as cig
from ..functions.identifiers import otu_part
from ..functions.sequences import canonical, reverse_complement, translated
from .skew import heavy_keys, lookup_join


def finite(score: str | Column) -> Column:
    """A score that is neither null nor infinite nor no number."""
    c = F.col(score) if isinstance(score, str) else score
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def distinct_hits(hits: DataFrame, ignore: tuple[str, ...] = ("hit_id", "loaded_at")) -> DataFrame:
    """One row for each hit whatever the number of its loads; of ``ignore`` the smallest value is kept."""
    keys = [c for c in hits.columns if c not in ignore]
    return hits.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ignore if c in hits.columns]).select(*hits.columns)


def distinct_ids(hits: DataFrame, *keep: str, ignore: tuple[str, ...] = ("hit_id", "loaded_at")) -> DataFrame:
    """The smallest hit_id of each hit whatever the number of its loads, with some of its columns: hit_id, keep.

    Hits are told apart by 128 bits of hashes of all columns but ``ignore``, so that no sequence is shuffled.
    """
    columns = [c for c in hits.columns if c not in ignore]
    values = [*[F.isnull(c) for c in columns], *columns]
    rows = hits.select("hit_id", *keep, F.xxhash64(*values).alias("_p"), F.xxhash64(F.lit(1), *values).alias("_q"))
    return rows.groupBy("_p", "_q").agg(F.min(F.struct("hit_id", *keep)).alias("_h")).select("_h.*")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order; null keys are a group. Groups are cut down before the shuffle."""
    return top_rows(rows, keys, order, 1)


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (0: all); every task passes on n rows of a group at most."""
    if not n:
        return rows
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def best_hit_per_subject(hits: DataFrame) -> DataFrame:
    """The hit with the highest finite bitscore of each subject; of equal ones the smallest hit_id."""
    usable = hits.filter(finite("bitscore") & F.col("subjectid").isNotNull())
    return first_of(usable, ["subjectid"], [F.desc("bitscore"), F.asc("hit_id")])


def max_target_seqs(hits: DataFrame, n: int = 25) -> DataFrame:
    """The n best hits of each query (0: all)."""
    usable = hits.filter(finite("bitscore") & F.col("queryid").isNotNull())
    return top_rows(usable, ["queryid"], [F.desc("bitscore"), F.asc("hit_id")], n)


def max_hsps(hits: DataFrame, n: int = 1) -> DataFrame:
    """The n best hits of each query and subject (0: all)."""
    usable = hits.filter(finite("bitscore") & F.col("queryid").isNotNull() & F.col("subjectid").isNotNull())
    return top_rows(usable, ["queryid", "subjectid"], [F.desc("bitscore"), F.asc("hit_id")], n)


def best_targets(hits: DataFrame, targets: int = 25, per_target: int = 1) -> DataFrame:
    """The ``per_target`` best hits of each query and subject (0: all), of the ``targets`` best subjects of each query (0: all).

    A subject ranks by its best hit, so that many hits on one subject don't push out others.
    """
    chosen = max_hsps(hits, per_target)
    if not targets:
        return chosen
    best = top_rows(max_hsps(chosen, 1), ["queryid"], [F.desc("bitscore"), F.asc("hit_id")], targets)
    return best if per_target == 1 else chosen.join(best.select("queryid", "subjectid"), ["queryid", "subjectid"], "left_semi").select(*hits.columns)


def top_percent(hits: DataFrame, percent: float = 10) -> DataFrame:
    """Hits whose bitscore is at most ``percent`` % below the best of their query."""
    usable = hits.filter(finite("bitscore") & F.col("queryid").isNotNull())
    best = usable.groupBy("queryid").agg(F.max("bitscore").alias("_best"))
    joined = lookup_join(usable, best, "queryid", heavy_keys(usable, "queryid"))
    return joined.filter(F.col("bitscore") >= F.col("_best") * (1 - percent / 100)).select(*hits.columns)


def filter_hits(
    hits: DataFrame, identity: float = 0, score: float = 0, length: int = 0, query_cover: float = 0, subject_cover: float = 0, evalue: float = 0, markers: DataFrame | None = None
) -> DataFrame:
    """Hits within limits for percentage identity, bitscore, covered subject letters, covered part (%) of query and subject, and evalue; 0 switches a limit off.

    subject_cover needs ``markers`` (subjectid, reference_len); hits on other subjects are left out then. evalue is an
    upper limit on the column of that name.
    """
    span = F.abs(F.col("subjectend").cast("bigint") - F.col("subjectstart")) + 1
    cover = 100 * (F.abs(F.col("queryend").cast("bigint") - F.col("querystart")) + 1) / F.length("full_querysequence")
    keep = finite("bitscore")
    if identity:
        keep = keep & (F.col("percentidentical") >= identity)
    if score:
        keep = keep & (F.col("bitscore") >= score)
    if length:
        keep = keep & (span >= length)
    if query_cover:
        keep = keep & (F.col("full_querysequence") != "") & (cover >= query_cover)
    if evalue:
        keep = keep & (F.col("evalue") <= evalue)
    if not subject_cover:
        return hits.filter(keep)
    sizes = markers.filter("subjectid is not null and reference_len > 0").groupBy("subjectid").agg(F.min("reference_len").alias("_len"))
    sized = lookup_join(hits.filter(keep), sizes, "subjectid", heavy_keys(hits, "subjectid"))
    return sized.filter(100 * span / F.col("_len") >= subject_cover).select(*hits.columns)


def same_otu_subjects(hits: DataFrame, delimiter: str = "@") -> DataFrame:
    """Subjects whose hits all come from queries of one OTU: subjectid, otu. Hits without a query count for nothing."""
    named = hits.filter("subjectid is not null and queryid is not null").groupBy("subjectid")
    otu = otu_part(F.col("queryid"), delimiter)
    return named.agg(F.min(otu).alias("otu"), F.max(otu).alias("_other")).filter("otu = _other").select("subjectid", "otu")


def dedup_canonical(records: DataFrame, sequence: str, order: list[str]) -> DataFrame:
    """One record for each sequence or its reverse complement, gaps and case ignored: the first in ``order``.

    Records without a sequence are dropped.
    """
    keyed = records.filter(F.col(sequence).isNotNull()).withColumn("_canon", F.unhex(F.sha2(canonical(F.col(sequence)).cast("binary"), 256)))
    return first_of(keyed, ["_canon"], [F.asc(c) for c in order]).drop("_canon")


def dedup_ids(records: DataFrame, identifier: str, order: list[str]) -> DataFrame:
    """One record for each identifier: the first in ``order``; null identifiers are dropped."""
    return first_of(records.filter(F.col(identifier).isNotNull()), [identifier], [F.asc(c) for c in order])


def combined(records: DataFrame, identifier: str, sequence: str) -> DataFrame:
    """Pooled records, each sequence (or its reverse complement) and each identifier once, the first in the order of sequence and identifier."""
    once = dedup_canonical(records, sequence, [sequence, identifier])
    return dedup_ids(once, identifier, [sequence])


def repaired_hits(hits: DataFrame) -> DataFrame:
    """Hits on the strand they are read on, frame shifts repaired: hit_id, nucleotides, protein, shifts.

    The segment between the query coordinates, reverse-complemented where they run backwards, is read as the cigar
    says and translated in its first frame. Hits without query, cigar or coordinates from 1 on are left out.
    """
    first, last = F.col("querystart"), F.col("queryend")
    usable = hits.filter(F.col("full_querysequence").isNotNull() & F.col("cigar").isNotNull() & (first >= 1) & (last >= 1))
    segment = F.substr("full_querysequence", F.least(first, last), F.abs(last - first) + 1)
    read = usable.select("hit_id", "cigar", F.when(first > last, reverse_complement(segment)).otherwise(segment).alias("_s"))
    mended = read.select("hit_id", cig.repaired(F.col("_s"), F.col("cigar")).alias("nucleotides"), cig.shifts(F.col("cigar")).alias("shifts"))
    return mended.select("hit_id", "nucleotides", translated(F.col("nucleotides")).alias("protein"), "shifts")


def repaired_queries(hits: DataFrame) -> DataFrame:
    """Full queries with the repaired segment in place: hit_id, query, querystart, queryend, queryframe, cigar, protein.

    A query whose coordinates run backwards is reverse-complemented as a whole; coordinates and the then positive
    frame count on the strand read. cigar has plain operations only, equal neighbours fused. protein is the reported
    one (without gaps) between the translated flanks, which lose the letters of incomplete codons at their outer ends;
    it is null if none is reported. The same hits as in :func:`repaired_hits` are left out.
    """
    first, last, size = F.col("querystart"), F.col("queryend"), F.length("full_querysequence")
    usable = hits.filter(F.col("full_querysequence").isNotNull() & F.col("cigar").isNotNull() & (first >= 1) & (last >= 1))
    back = first > last
    read = usable.select(
        "hit_id", "cigar", F.regexp_replace("translated_querysequence", "-", "").alias("_p"), F.abs("queryframe").alias("queryframe"),
        F.when(back, reverse_complement(F.col("full_querysequence"))).otherwise(F.col("full_querysequence")).alias("_q"),
        F.when(back, size - first + 1).otherwise(first).alias("_f"), F.when(back, size - last + 1).otherwise(last).alias("_l"),
    )
    before, after = F.substr("_q", F.lit(1), F.greatest(F.col("_f") - 1, F.lit(0))), F.substr("_q", F.greatest(F.col("_l") + 1, F.lit(1)))
    segment = F.substr("_q", F.greatest(F.col("_f"), F.lit(1)), F.col("_l") - F.greatest(F.col("_f"), F.lit(1)) + 1)
    parts = read.select("hit_id", "cigar", "_p", "queryframe", "_f", before.alias("_b"), cig.repaired(segment, F.col("cigar")).alias("_n"), after.alias("_a"))
    whole = F.substr("_b", F.length("_b") % 3 + 1)
    return parts.select(
        "hit_id", F.concat("_b", "_n", "_a").alias("query"), F.col("_f").alias("querystart"), (F.col("_f") + F.length("_n") - 1).alias("queryend"), "queryframe",
        cig.fused(F.col("cigar")).alias("cigar"), F.concat(translated(whole), "_p", translated(F.col("_a"))).alias("protein"),
    )
