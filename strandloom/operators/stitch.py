"""Resolving overlapping hits on each reference and stitching the winners along it.

Hits are resolved as intervals: each is cut at the borders of blocks of reference positions, equal intervals are
combined before the shuffle, and a block, which can hold no more than BLOCK * (BLOCK + 1) / 2 different ones, is
painted from the worst to the best. Sequences are looked up for the winners only. What follows works on regions, or
on a row for each reference, never on a row for each residue of a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as cig
from ..functions.alignment import GAP_EXTEND, GAP_OPEN, blosum62, local_score, lookup
from ..functions.intervals import codon
from ..functions.sequences import letters, reverse_complement
from .hits import finite
from .skew import heavy_keys, lookup_join

#: Residues that masking removes unless told otherwise.
STOP = "*"
AMBIGUOUS = "BJZX"
#: Reference positions that are resolved together.
BLOCK = 256


def placed_hits(hits: DataFrame) -> DataFrame:
    """Hits that have a place on a reference, with it: all columns, first_pos, last_pos (bigint).

    Hits count if subject, hit_id, sequence, cigar and coordinates are given, coordinates are at least 1 and the
    bitscore is finite. Coordinates may stand in either order; a hit covers as many positions from the first one as
    its cigar has on the reference, up to the last one.
    """
    start, end = F.col("subjectstart").cast("bigint"), F.col("subjectend").cast("bigint")
    usable = hits.filter(
        F.col("subjectid").isNotNull() & F.col("hit_id").isNotNull() & F.col("translated_querysequence").isNotNull() & F.col("cigar").isNotNull()
        & (start >= 1) & (end >= 1) & finite("bitscore")
    )
    first = F.least(start, end)
    placed = usable.withColumns({"first_pos": first, "last_pos": F.least(F.greatest(start, end), first + cig.reference_span(F.col("cigar")) - 1)})
    return placed.filter("first_pos <= last_pos")


def owned_regions(hits: DataFrame) -> DataFrame:
    """Non-overlapping regions: maximal runs of positions owned by one hit (subjectid, hit_id, bitscore, first_pos, last_pos).

    The hit with the highest bitscore owns a position; of equal ones the smallest hit_id.
    """
    spans = placed_hits(hits).select("subjectid", "hit_id", "bitscore", "first_pos", "last_pos")
    block = F.explode(F.sequence(F.expr(f"first_pos div {BLOCK}"), F.expr(f"last_pos div {BLOCK}"))).alias("_block")
    cut = spans.select("subjectid", "hit_id", "bitscore", "first_pos", "last_pos", block)
    a = F.greatest(F.col("first_pos") - F.col("_block") * BLOCK, F.lit(0)).cast("int").alias("a")
    b = F.least(F.col("last_pos") - F.col("_block") * BLOCK, F.lit(BLOCK - 1)).cast("int").alias("b")
    best = cut.select("subjectid", "_block", a, b, "bitscore", (-F.col("hit_id")).cast("bigint").alias("nid")).groupBy("subjectid", "_block", "a", "b").agg(F.max(F.struct("bitscore", "nid")).alias("_m"))
    blocks = best.groupBy("subjectid", "_block").agg(F.collect_list(F.struct("a", "b", "_m.bitscore", "_m.nid")).alias("_spans"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            a, b, score, nid = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
            ends = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            rows, owners, firsts, lasts = [], [], [], []
            for row in range(batch.num_rows):
                here = np.arange(ends[row], ends[row + 1])
                cells = np.full(BLOCK, -1)
                for i in here[np.lexsort((nid[here], score[here]))]:
                    cells[a[i] : b[i] + 1] = i
                begin = np.flatnonzero(np.diff(cells, prepend=-2))
                stop = np.append(begin[1:], BLOCK) - 1
                kept = cells[begin] >= 0
                rows.append(np.full(kept.sum(), row))
                owners.append(cells[begin][kept])
                firsts.append(begin[kept])
                lasts.append(stop[kept])
            if not rows:
                continue
            row, owner = np.concatenate(rows), np.concatenate(owners)
            base = batch.column(1).to_numpy()[row] * BLOCK
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row)), pa.array(-nid[owner]), pa.array(score[owner]), pa.array(base + np.concatenate(firsts)), pa.array(base + np.concatenate(lasts))],
                names=["subjectid", "hit_id", "bitscore", "first_pos", "last_pos"],
            )

    return _joined_runs(blocks.mapInArrow(paint, "subjectid string, hit_id bigint, bitscore double, first_pos bigint, last_pos bigint"))


def _joined_runs(owned: DataFrame) -> DataFrame:
    """Stretches of one hit that touch each other as one."""
    order = W.partitionBy("subjectid", "hit_id").orderBy("first_pos")
    new = F.when(F.lag("last_pos").over(order) == F.col("first_pos") - 1, 0).otherwise(1)
    runs = owned.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy("subjectid", "hit_id", "_run").agg(F.max("bitscore").alias("bitscore"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")).drop("_run")


def regions_by_overlap(hits: DataFrame, markers: DataFrame, matrix: dict | None = None) -> DataFrame:
    """Regions as in :func:`owned_regions`, but what several hits cover goes to the one that scores best there.

    Each stretch that the same hits cover from end to end is scored for each of them: the hit's slice is aligned anew,
    locally, with the reference. The highest score owns the stretch; of equal ones the highest bitscore, then the
    smallest hit_id. For two overlapping hits that is the score of their overlap. Stretches of references without a
    sequence go by bitscore.

    A hit becomes a row for each stretch it covers, so at most one for each of its positions; these are combined
    before the shuffle. The ends of all hits meet in blocks of reference positions, which bounds them.
    """
    placed = placed_hits(hits)
    block = F.explode(F.sequence(F.expr(f"first_pos div {BLOCK}"), F.expr(f"last_pos div {BLOCK}"))).alias("_block")
    cut = placed.select("subjectid", "hit_id", "bitscore", "first_pos", "last_pos", block)
    base = F.col("_block") * BLOCK
    cut = cut.select(
        F.concat_ws("#", "_block", "subjectid").alias("_key"), "subjectid", "hit_id", "bitscore", "first_pos", "last_pos",
        F.greatest("first_pos", base).alias("_lo"), F.least("last_pos", base + BLOCK - 1).alias("_hi"),
    )
    ends = placed.select("subjectid", F.explode(F.array(F.col("first_pos"), F.col("last_pos") + 1)).alias("_e")).select(F.concat_ws("#", F.expr(f"_e div {BLOCK}"), "subjectid").alias("_key"), "_e")
    edges = ends.groupBy("_key").agg(F.sort_array(F.collect_set("_e")).alias("_edges"))
    both = lookup_join(cut, edges, "_key", heavy_keys(cut, "_key"), "left")
    inner = F.filter(F.coalesce("_edges", F.array().cast("array<bigint>")), lambda e: (e > F.col("_lo")) & (e <= F.col("_hi")))
    starts = F.concat(F.array("_lo"), inner)
    stops = F.concat(F.transform(inner, lambda e: e - 1), F.array("_hi"))
    # a stretch goes on over the border of a block if no hit begins or ends there
    goes_on = ~F.coalesce(F.array_contains("_edges", F.col("_lo")), F.lit(False)) & (F.col("_lo") > F.col("first_pos"))
    each = both.select("subjectid", "hit_id", "bitscore", "first_pos", "last_pos", goes_on.alias("_on"), F.posexplode(F.arrays_zip(starts.alias("a"), stops.alias("b"))).alias("_i", "_x"))
    order = W.partitionBy("subjectid", "hit_id", "first_pos", "last_pos", "bitscore").orderBy("_x.a")
    opens = F.when((F.col("_i") == 0) & F.col("_on"), 0).otherwise(1)
    runs = each.dropDuplicates(["subjectid", "hit_id", "first_pos", "last_pos", "bitscore", "_x"]).withColumn("_o", opens).withColumn("_run", F.sum("_o").over(order))
    keys = ["subjectid", "hit_id", "first_pos", "last_pos", "bitscore"]
    stretches = runs.groupBy(*keys, "_run").agg(F.min("_x.a").alias("_a"), F.max("_x.b").alias("_b")).drop("_run")
    texts = placed.select(*keys, F.struct("cigar", "translated_querysequence").alias("_h")).groupBy(*keys).agg(F.max("_h").alias("_h"))
    at, size = F.col("_a") - F.col("first_pos") + 1, F.col("_b") - F.col("_a") + 1
    part = cig.sliced(F.col("_h.cigar"), at, at + size - 1)
    whole = F.col("_h.cigar").rlike(r"^\d+[M=X]$")  # without gaps there is nothing to look for
    span = F.when(whole, F.struct(at.cast("int").alias("f"), size.cast("int").alias("n"))).otherwise(F.struct(part["query_first"].alias("f"), (part["query_last"] - part["query_first"] + 1).alias("n")))
    query = F.get(F.transform(F.array(span), lambda s: F.substr("_h.translated_querysequence", s["f"], s["n"])), F.lit(0))
    sliced = stretches.join(texts, keys)
    lined = lookup_join(sliced.select(*keys, "_a", "_b", query.alias("_q")), references(markers), "subjectid", heavy_keys(stretches, "subjectid"), "left")
    piece = F.substr("reference", F.col("_a").cast("int"), (F.col("_b") - F.col("_a") + 1).cast("int"))
    score = F.coalesce(local_score(F.coalesce("_q", F.lit("")), piece, matrix), F.lit(0))
    rows = lined.select("subjectid", "_a", "_b", score.alias("score"), "bitscore", (-F.col("hit_id")).cast("bigint").alias("nid"))
    best = rows.groupBy("subjectid", "_a", "_b").agg(F.max(F.struct("score", "bitscore", "nid")).alias("_m"))
    return _joined_runs(best.select("subjectid", (-F.col("_m.nid")).alias("hit_id"), F.col("_m.bitscore").alias("bitscore"), F.col("_a").alias("first_pos"), F.col("_b").alias("last_pos")))


def resolve_regions(hits: DataFrame, nucleotides: bool = False, owned: DataFrame | None = None) -> DataFrame:
    """The regions of :func:`owned_regions` (or others, ``owned``) with the slice that each keeps of its hit: residues, and codons if asked for.

    A letter of residues (three of codons) for each position; '-' where the hit has a deletion or its sequence ends
    too early, and codons of '-' where the hit has no query or no query coordinates from 1 on.
    """
    placed = placed_hits(hits)
    texts = [aligned_residues(F.col("translated_querysequence"), F.col("cigar")).alias("_residues")]
    if nucleotides:
        texts.append(aligned_nucleotides(F.col("full_querysequence"), F.col("querystart"), F.col("queryend"), F.col("cigar")).alias("_codons"))
    whole = placed.select("subjectid", "hit_id", F.col("bitscore").alias("_score"), F.col("first_pos").alias("_f"), F.col("last_pos").alias("_l"), *texts)
    both = (owned_regions(hits) if owned is None else owned).join(whole, ["subjectid", "hit_id"]).filter("bitscore = _score and _f <= first_pos and last_pos <= _l")
    at, size = (F.col("first_pos") - F.col("_f")).cast("int"), (F.col("last_pos") - F.col("first_pos") + 1).cast("int")
    parts = [F.substr("_residues", at + 1, size).alias("residues")]
    if nucleotides:
        codons = F.substr("_codons", 3 * at + 1, 3 * size)
        parts.append(F.coalesce(codons, F.repeat(F.lit("-"), 3 * size)).alias("codons"))
    # a hit that stands in several rows counts once
    keys = ["subjectid", "hit_id", "bitscore", "first_pos", "last_pos"]
    return both.select(*keys, F.struct(*parts).alias("_t")).groupBy(*keys).agg(F.max("_t").alias("_t")).select(*keys, "_t.*")


def aligned_residues(sequence: Column, cigar: Column) -> Column:
    """The letters of an aligned query along its reference: insertions left out, '-' for deletions and missing letters."""
    kind = "struct<at:int,out:string>"
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out")).cast(kind)

    def step(acc: Column, o: Column) -> Column:
        pairs, gap = o["op"].isin(*cig.MATCHED), o["op"].isin(*cig.DELETED)
        piece = F.when(pairs, F.rpad(F.substr(sequence, acc["at"], o["size"]), o["size"], "-")).when(gap, F.repeat(F.lit("-"), o["size"])).otherwise("")
        return F.struct((acc["at"] + F.when(pairs | (o["op"] == "I"), o["size"]).otherwise(0)).alias("at"), F.concat(acc["out"], piece).alias("out")).cast(kind)

    return F.aggregate(cig.operations(cigar), start, step, lambda acc: acc["out"])


def aligned_nucleotides(query: Column, first: Column, last: Column, cigar: Column) -> Column:
    """Three letters of the whole query for each letter of :func:`aligned_residues`, frame shifts applied; null without a usable query."""
    segment = F.substr(query, F.least(first, last), F.abs(last - first) + 1)
    read = F.when(first > last, reverse_complement(segment)).otherwise(segment)
    kind = "struct<at:int,out:string>"
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out")).cast(kind)

    def step(acc: Column, o: Column) -> Column:
        size = 3 * o["size"]
        pairs, gap = o["op"].isin(*cig.MATCHED), o["op"].isin(*cig.DELETED)
        piece = F.when(pairs, F.rpad(F.substr(read, F.greatest(acc["at"], F.lit(1)), size), size, "-")).when(gap, F.repeat(F.lit("-"), size)).otherwise("")
        moved = F.when(o["op"] == "\\", o["size"]).when(o["op"] == "/", -o["size"]).when(gap, 0).otherwise(size)
        return F.struct((acc["at"] + moved).alias("at"), F.concat(acc["out"], piece).alias("out")).cast(kind)

    text = F.aggregate(cig.operations(cigar, shifts=True), start, step, lambda acc: acc["out"])
    return F.when(query.isNotNull() & (first >= 1) & (last >= 1), text)


def aligned_text(hits: DataFrame) -> DataFrame:
    """Each hit's residues along the reference, insertions masked: hit_id, first_pos, residues. A row is as long as its hit."""
    size = (F.col("last_pos") - F.col("first_pos") + 1).cast("int")
    return placed_hits(hits).select("hit_id", "first_pos", F.substr(aligned_residues(F.col("translated_querysequence"), F.col("cigar")), F.lit(1), size).alias("residues"))


def aligned_positions(hits: DataFrame, *keep: str) -> DataFrame:
    """Every hit position by position: subjectid, pos, hit_id, query_pos, deleted, and the columns ``keep``.

    Insertions have no position; deletions have the query_pos before them (0 if there is none). query_pos counts the
    aligned query from 1. The same hits as in :func:`placed_hits` count. This is for tables of coordinates; hits are
    resolved without it.
    """
    usable = placed_hits(hits).select("subjectid", "hit_id", *keep, "first_pos", "last_pos", cig.operations(F.col("cigar")).alias("_ops"))
    before = lambda i, kinds: F.aggregate(F.slice("_ops", F.lit(1), i), F.lit(0), lambda s, o: s + F.when(o["op"].isin(*kinds), o["size"]).otherwise(0))
    on_reference, on_query = cig.MATCHED + cig.DELETED, cig.MATCHED + ("I",)
    pieces = F.transform("_ops", lambda o, i: F.struct(o["op"].alias("op"), o["size"].alias("size"), before(i, on_reference).alias("r"), before(i, on_query).alias("q")))
    each = usable.select("*", F.explode(pieces).alias("_o")).filter(F.col("_o.op").isin(*on_reference) & (F.col("_o.size") > 0))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("_o.size") - 1)).alias("_k"))
    gap = F.col("_o.op").isin(*cig.DELETED)
    on_aligned = F.when(gap, F.col("_o.q")).otherwise(F.col("_o.q") + F.col("_k") + 1)
    pos = F.col("first_pos") + F.col("_o.r") + F.col("_k")
    return each.select("subjectid", pos.alias("pos"), "hit_id", on_aligned.alias("query_pos"), gap.alias("deleted"), *keep, "last_pos").filter("pos <= last_pos").drop("last_pos")


def coordinate_table(hits: DataFrame) -> DataFrame:
    """Subject positions of each hit with the aligned query position and the codon in the whole query.

    Columns hit_id, pos, query_pos, codon_first, codon_last; codons run backwards where the query coordinates do.
    Deleted positions have the codon of the query position before them, null if there is none.
    """
    c = codon(F.when(F.col("query_pos") > 0, F.col("query_pos")), F.col("querystart"), F.col("queryend"))
    return aligned_positions(hits, "querystart", "queryend").select("hit_id", "pos", "query_pos", c.first.alias("codon_first"), c.last.alias("codon_last"))


def positions(regions: DataFrame) -> DataFrame:
    """The winner of each covered position: subjectid, pos, hit_id, bitscore, residue."""
    each = regions.select("subjectid", "hit_id", "bitscore", "first_pos", F.posexplode(letters(F.col("residues"))).alias("_i", "residue"))
    return each.select("subjectid", (F.col("first_pos") + F.col("_i")).alias("pos"), "hit_id", "bitscore", "residue")


def resolve_positions(hits: DataFrame) -> DataFrame:
    """The winner of each covered position: subjectid, pos, hit_id, bitscore, residue (see :func:`owned_regions`)."""
    return positions(resolve_regions(hits))


def resolved_regions(won: DataFrame) -> DataFrame:
    """Maximal runs of positions owned by one hit (subjectid, hit_id, first_pos, last_pos), from rows for positions or regions."""
    if "pos" not in won.columns:
        return won.select("subjectid", "hit_id", "first_pos", "last_pos")
    return region_sequences(won).drop("residues")


def region_sequences(won: DataFrame) -> DataFrame:
    """Rows for positions as rows for runs of one hit: subjectid, hit_id, first_pos, last_pos, residues. Rows are as long as their region."""
    order = W.partitionBy("subjectid", "hit_id").orderBy("pos")
    runs = won.withColumn("_run", F.col("pos") - F.row_number().over(order))
    cells = runs.groupBy("subjectid", "hit_id", "_run").agg(F.sort_array(F.collect_list(F.struct("pos", "residue"))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda c: c["residue"]), "")
    return cells.select("subjectid", "hit_id", F.col("_c")[0]["pos"].alias("first_pos"), F.element_at("_c", -1)["pos"].alias("last_pos"), text.alias("residues"))


def references(markers: DataFrame) -> DataFrame:
    """subjectid and reference, the smallest of the sequences given for it; references without a sequence are left out."""
    return markers.filter(F.col("subjectid").isNotNull() & F.col("sequencedata").isNotNull()).groupBy("subjectid").agg(F.min("sequencedata").alias("reference"))


def with_reference(won: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows for positions (of :func:`positions`) or regions beside the reference's residue: adds ref_residue and reference_len.

    Regions come out as positions. References without a sequence have no rows, nor have positions beyond it.
    """
    regions = won if "pos" not in won.columns else region_sequences(won)
    size = (F.col("last_pos") - F.col("first_pos") + 1).cast("int")
    joined = regions.join(references(markers), "subjectid").filter(F.col("first_pos") <= F.length("reference"))
    both = F.arrays_zip(letters(F.col("residues")).alias("residue"), letters(F.substr("reference", F.col("first_pos").cast("int"), size)).alias("ref_residue"))
    each = joined.select("subjectid", "hit_id", "first_pos", F.length("reference").alias("reference_len"), F.posexplode(both).alias("_i", "_x")).filter("_x.ref_residue is not null")
    return each.select("subjectid", (F.col("first_pos") + F.col("_i")).alias("pos"), "hit_id", "_x.residue", "_x.ref_residue", "reference_len")


def masked(won: DataFrame, retain_stops: bool = False, retain_ambiguous: bool = False) -> DataFrame:
    """Stops and ambiguous residues of positions or regions replaced by gaps, with their codons if there are any."""
    removed = ("" if retain_stops else STOP) + ("" if retain_ambiguous else AMBIGUOUS + AMBIGUOUS.lower())
    column = "residue" if "pos" in won.columns else "residues"
    rows = won.withColumn(column, F.translate(column, removed, "-" * len(removed))) if removed else won
    return rows.withColumn("codons", codons_of(F.col("codons"), F.col(column))) if "codons" in won.columns else rows


def codons_of(codons: Column, residues: Column) -> Column:
    """Codons of residues, with '---' wherever the residue is a gap."""
    triples = F.regexp_extract_all(codons, F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.zip_with(letters(residues), triples, lambda r, c: F.when(r == "-", "---").otherwise(c)), "")


def sliding_mean(scored: DataFrame, score: str, size: int = 4) -> DataFrame:
    """The mean score of the window of ``size`` adjacent positions that starts at each position (full windows only)."""
    ahead = W.partitionBy("subjectid").orderBy("pos").rangeBetween(0, size - 1)
    rows = scored.select("*", F.avg(score).over(ahead).alias("window_mean"), F.count(score).over(ahead).alias("_n"))
    return rows.filter(F.col("_n") == size).drop("_n")


def window_trimmed(aligned: Column, reference: Column, size: int = 4, least: float = -7.0, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, matrix: dict | None = None) -> Column:
    """An aligned text without the positions of windows of ``size`` letters whose mean score is below ``least``: they become '-'.

    A window scores the matrix value of each pair of letters, and for each run of gaps inside it the opening cost once
    and the extension for each letter. A text shorter than a window is one window. Null texts stay null.
    """
    table = lookup(matrix or blosum62())

    @F.pandas_udf("string")
    def trim(texts: pd.Series, references: pd.Series) -> pd.Series:
        out = []
        for text, ref in zip(texts, references, strict=True):
            if text is None or ref is None or not text:
                out.append(text)
                continue
            x, y = (np.frombuffer(t.upper().encode("ascii", "replace"), np.uint8) & 127 for t in (text, ref))
            n, wide = len(x), min(size, len(x))
            gap = x == ord("-")
            value = np.where(gap, -gap_extend, table[x, y[:n]])
            opens = np.append(0, gap[1:] & ~gap[:-1])  # openings after the first letter of a window
            sums = [np.append(0, np.cumsum(v)) for v in (value, opens)]
            at = np.arange(n - wide + 1)
            total = sums[0][at + wide] - sums[0][at] - gap_open * (sums[1][at + wide] - sums[1][at + 1] + gap[at])
            edge = np.zeros(n + 1, np.int64)
            bad = at[total / wide < least]
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + wide, -1)
            cut = np.cumsum(edge)[:n] > 0
            out.append("".join("-" if c else t for c, t in zip(cut, text, strict=True)) if cut.any() else text)
        return pd.Series(out, dtype=object)

    return trim(aligned, reference)


def stitched(won: DataFrame, markers: DataFrame, fill: str = "-") -> DataFrame:
    """One aligned sequence for each reference that has winners: subjectid, reference_len, aligned, residues.

    ``won`` has rows for positions or regions. ``aligned`` has a letter for each reference position, ``fill`` where
    nothing is; ``residues`` leaves those out. Regions with codons give aligned_dna and dna too, three letters for
    each of the others. A row's text is as long as its reference, whatever the number of hits.
    """
    return _along(won, markers, fill).drop("reference")


def _along(won: DataFrame, markers: DataFrame, fill: str = "-") -> DataFrame:
    regions = won if "pos" not in won.columns else region_sequences(won)
    names = ["residues", *(["codons"] if "codons" in regions.columns else [])]
    joined = regions.join(references(markers), "subjectid").withColumn("_n", F.length("reference")).filter("first_pos <= _n")
    room = F.least(F.col("_n") - F.col("first_pos") + 1, F.col("last_pos") - F.col("first_pos") + 1).cast("int")
    piece = F.struct("first_pos", F.least("last_pos", "_n").alias("last_pos"), *[F.substr(c, F.lit(1), room * (3 if c == "codons" else 1)).alias(c) for c in names])
    rows = joined.groupBy("subjectid").agg(F.max("reference").alias("reference"), F.sort_array(F.collect_list(piece)).alias("_p"))

    def text(column: str, width: int) -> Column:
        hole = lambda n: F.repeat(F.lit(fill), (n * width).cast("int"))
        before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("_p", i - 1)["last_pos"])
        parts = F.transform("_p", lambda p, i: F.concat(hole(p["first_pos"] - 1 - before(i)), p[column]))
        return F.concat(F.array_join(parts, ""), hole(F.length("reference") - F.element_at("_p", -1)["last_pos"]))

    out = rows.select("subjectid", F.length("reference").alias("reference_len"), "reference", text("residues", 1).alias("aligned"), *([text("codons", 3).alias("aligned_dna")] if len(names) > 1 else []))
    return without_gaps(out, fill)


def without_gaps(rows: DataFrame, fill: str = "-") -> DataFrame:
    """Rows of :func:`stitched` with residues (and dna) made anew from the aligned texts."""
    rows = rows.withColumn("residues", F.translate("aligned", fill, ""))
    return rows.withColumn("dna", F.translate("aligned_dna", fill, "")) if "aligned_dna" in rows.columns else rows


def trimmed(rows: DataFrame, size: int = 4, least: float = -7.0, **costs) -> DataFrame:
    """Rows of a reference with their aligned texts (of ``stitched_on``) after :func:`window_trimmed`."""
    cut = rows.withColumn("aligned", window_trimmed(F.col("aligned"), F.col("reference"), size, least, **costs))
    if "aligned_dna" in rows.columns:
        cut = cut.withColumn("aligned_dna", codons_of(F.col("aligned_dna"), F.col("aligned")))
    return without_gaps(cut)


def stitched_on(won: DataFrame, markers: DataFrame) -> DataFrame:
    """The rows of :func:`stitched` with the reference they are aligned to."""
    return _along(won, markers)


def bridges(regions: DataFrame, markers: DataFrame) -> DataFrame:
    """Uncovered stretches of each reference before, between and after its regions: subjectid, first_pos, last_pos."""
    order = W.partitionBy("subjectid").orderBy("first_pos")
    sizes = markers.filter("subjectid is not null and reference_len is not null").groupBy("subjectid").agg(F.min("reference_len").alias("_len"))
    placed = regions.join(sizes, "subjectid").filter(F.col("first_pos") <= F.col("_len"))
    ends = placed.select("subjectid", "_len", "first_pos", "last_pos", F.lag("last_pos", 1, 0).over(order).alias("_before"), F.lead("first_pos").over(order).alias("_next"))
    inner = F.struct((F.col("_before") + 1).cast("bigint").alias("first_pos"), (F.col("first_pos") - 1).cast("bigint").alias("last_pos"))
    tail = F.struct((F.col("last_pos") + 1).cast("bigint").alias("first_pos"), F.col("_len").alias("last_pos"))
    gaps = F.when(F.col("_next").isNull(), F.array(inner, tail)).otherwise(F.array(inner))
    return ends.select("subjectid", F.explode(gaps).alias("_g")).select("subjectid", "_g.first_pos", "_g.last_pos").filter("first_pos <= last_pos")


def marker_statistics(hits: DataFrame, won: DataFrame, markers: DataFrame) -> DataFrame:
    """A row for each reference with winners: subjectid, reference_len, query_len, regions, contigs, matches, mismatches, deletions, query_coverage, identity.

    ``won`` has rows for positions or regions.
    """
    regions = won if "pos" not in won.columns else region_sequences(won)
    return aligned_statistics(hits, regions, stitched_on(regions, markers))


def aligned_statistics(hits: DataFrame, regions: DataFrame, rows: DataFrame) -> DataFrame:
    """The statistics of :func:`marker_statistics` from the regions and the rows of :func:`stitched_on`."""
    pairs = F.zip_with(letters(F.upper("aligned")), letters(F.upper("reference")), lambda a, b: F.when(a == "-", F.lit(0)).when(a == b, 1).otherwise(2))
    count = lambda kind: F.size(F.filter("_pairs", lambda p: p == kind)).cast("bigint")
    counts = rows.select("subjectid", "reference_len", pairs.alias("_pairs")).select("subjectid", "reference_len", count(1).alias("matches"), count(2).alias("mismatches"))
    owned = regions.groupBy("subjectid").agg(F.count("*").alias("regions"))
    contigs = hits.filter("subjectid is not null").groupBy("subjectid").agg(F.count("*").alias("contigs"))
    both = counts.join(owned, "subjectid").join(contigs, "subjectid")
    aligned = F.col("matches") + F.col("mismatches")
    return both.select(
        "subjectid", "reference_len", aligned.alias("query_len"), "regions", "contigs", "matches", "mismatches", (F.col("reference_len") - aligned).alias("deletions"),
        F.bround(100 * aligned / F.col("reference_len"), 2).alias("query_coverage"), cig.gap_excluded_identity(F.col("matches"), F.col("mismatches")).alias("identity"),
    )
