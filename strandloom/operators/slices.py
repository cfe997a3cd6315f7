"""Parts of hits: slices on a stretch of the reference, positions seen from the query, and overlaps scored anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as cig
from ..functions.alignment import aligned_pair
from ..functions.intervals import codon
from .stitch import owned_regions, placed_hits, references


def slice_hits(placed: DataFrame, first: Column, last: Column) -> DataFrame:
    """Hits of :func:`strandloom.operators.stitch.placed_hits` cut to subject positions first .. last, both counted on the whole subject.

    Subject and query coordinates, cigar and sequences become those of the slice (see :func:`strandloom.functions.cigar.sliced`);
    query coordinates keep their direction. Hits without a pair of letters there have no row. Other columns stay.
    """
    at = F.col("first_pos") - 1
    part = placed.withColumn("_s", cig.sliced(F.col("cigar"), first - at, last - at)).filter("_s is not null")
    s = lambda name: F.col(f"_s.{name}")
    one, two = codon(s("query_first"), F.col("querystart"), F.col("queryend")), codon(s("query_last"), F.col("querystart"), F.col("queryend"))
    changed = {
        "subjectstart": (at + s("reference_first")).cast("int"), "subjectend": (at + s("reference_last")).cast("int"), "querystart": one.first, "queryend": two.last, "cigar": s("cigar"),
        "translated_querysequence": F.substr("translated_querysequence", s("query_first"), s("query_last") - s("query_first") + 1),
    }
    if "subjectsequence" in placed.columns:
        changed["subjectsequence"] = F.substr("subjectsequence", s("reference_first"), s("reference_last") - s("reference_first") + 1)
    return part.withColumns(changed).drop("_s", "first_pos", "last_pos")


def region_slices(hits: DataFrame) -> DataFrame:
    """The slice of its hit that each region of the winners keeps: region_first, region_last and the sliced hit."""
    regions = owned_regions(hits).select("subjectid", "hit_id", F.col("first_pos").alias("region_first"), F.col("last_pos").alias("region_last"))
    return slice_hits(placed_hits(hits).join(regions, ["subjectid", "hit_id"]), F.col("region_first"), F.col("region_last"))


def query_coordinates(hits: DataFrame) -> DataFrame:
    """Letters of each hit's aligned query with their subject position: hit_id, query_pos, pos, inserted.

    An inserted letter has the subject position before it. The same hits as in ``placed_hits`` count.
    """
    ops = F.filter(cig.placed(F.col("cigar")), lambda o: o["op"].isin(*cig.MATCHED, "I") & (o["size"] > 0))
    each = placed_hits(hits).select("hit_id", "first_pos", "last_pos", F.explode(ops).alias("o"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("o.size"))).alias("k"))
    inserted = F.col("o.op") == "I"
    pos = F.col("first_pos") - 1 + F.col("o.on_reference") + F.when(inserted, 0).otherwise(F.col("k"))
    return each.select("hit_id", (F.col("o.on_query") + F.col("k")).alias("query_pos"), pos.alias("pos"), inserted.alias("inserted"), "last_pos").filter("pos <= last_pos").drop("last_pos")


def overlap_order(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """Neighbouring hits that overlap, with the score of each one's slice of the overlap, aligned anew with the reference.

    Of hits with the same interval the best counts; neighbours stand next to each other in the order of first and last
    position. Columns subjectid, hit_a, hit_b, overlap_first, overlap_last, score_a, score_b (local alignment scores; 0
    for a slice without a letter), by_overlap (the hit with the higher of them; of equal ones the one with the better
    bitscore, then the smaller hit_id) and by_bitscore (the hit that owns the overlap otherwise).
    """
    placed = placed_hits(hits)
    best = placed.groupBy("subjectid", "first_pos", "last_pos").agg(F.max(F.struct("bitscore", (-F.col("hit_id")).alias("nid"), "cigar", "translated_querysequence")).alias("h"))
    order = W.partitionBy("subjectid").orderBy("first_pos", "last_pos")
    pairs = best.select("subjectid", "first_pos", "last_pos", "h", F.lead("first_pos").over(order).alias("f2"), F.lead("last_pos").over(order).alias("l2"), F.lead("h").over(order).alias("h2")).filter("f2 <= last_pos")
    begin, end = F.col("f2"), F.least("last_pos", "l2")
    refs = pairs.join(references(markers), "subjectid").filter(begin <= F.length("reference"))
    piece = F.substr("reference", begin.cast("int"), (end - begin + 1).cast("int"))

    def score(hit: str, at: str) -> Column:
        s = cig.sliced(F.col(f"{hit}.cigar"), begin - F.col(at) + 1, end - F.col(at) + 1)
        text = F.substr(F.col(f"{hit}.translated_querysequence"), s["query_first"], s["query_last"] - s["query_first"] + 1)
        return aligned_pair(F.coalesce(text, F.lit("")), piece, local=True)["score"]

    rows = refs.select(
        "subjectid", (-F.col("h.nid")).alias("hit_a"), (-F.col("h2.nid")).alias("hit_b"), begin.alias("overlap_first"), end.alias("overlap_last"),
        score("h", "first_pos").alias("score_a"), score("h2", "f2").alias("score_b"), F.struct("h.bitscore", "h.nid").alias("_a"), F.struct("h2.bitscore", "h2.nid").alias("_b"),
    )
    by_bitscore = F.when(F.col("_a") > F.col("_b"), F.col("hit_a")).otherwise(F.col("hit_b"))
    by_overlap = F.when(F.col("score_a") > F.col("score_b"), F.col("hit_a")).when(F.col("score_a") < F.col("score_b"), F.col("hit_b")).otherwise(by_bitscore)
    return rows.select("subjectid", "hit_a", "hit_b", "overlap_first", "overlap_last", "score_a", "score_b", by_overlap.alias("by_overlap"), by_bitscore.alias("by_bitscore"))


def framed_query(query: Column, first: Column, last: Column) -> Column:
    """A whole query cut to full codons in the frame of its aligned letters first .. last (on the strand given); null outside the query."""
    begin = F.pmod(first - 1, F.lit(3)) + 1
    end = F.length(query) - F.pmod(F.length(query) - last, F.lit(3))
    return F.when((first >= 1) & (last >= first) & (last <= F.length(query)), F.substr(query, begin.cast("int"), (end - begin + 1).cast("int")))
