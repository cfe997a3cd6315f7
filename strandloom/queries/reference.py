"""Queries of the sequence domain over whole tables, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as cig
from ..functions import identifiers as ids
from ..functions import sequences as seq
from ..functions.alignment import aligned_pair, pair_scores
from ..functions.intervals import Interval, codon, full_to_subject
from ..operators import cluster, features, hits, sampling, search, slices, stats, stitch
from ..operators.skew import heavy_keys, lookup_join
from ..plans.markers import Settings
from ..plans.markers import retrieve_markers as plan
from ..plans.orthologs import compare_orthologs, scored_pairs
from ..streaming.hits import hits_by_day as by_day

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of one function over a reader of tables, with its SQL."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- identifiers

@query("""select seq_id, case when contains(seq_id, '@') then split_part(seq_id, '@', 1) else '' end otu_part, split_part(seq_id, '@', -1) part,
          contains(seq_id, ' ') spaces, length(seq_id)::int id_length from sequences""")
def otu_split(t):
    c = F.col("seq_id")
    return t("sequences").select("seq_id", ids.otu_part(c).alias("otu_part"), ids.sequence_part(c).alias("part"), ids.has_spaces(c).alias("spaces"), F.length(c).alias("id_length"))


@query("""select seq_id, '>' || translate(substr('@' || seq_id || ' part', 2), ' ', '_') header, seq_id || '@gene' with_gene,
          case when contains(seq_id, '@') then seq_id else 'species@' || seq_id end with_species from sequences""")
def header_insert(t):
    c = F.col("seq_id")
    return t("sequences").select(
        c, ids.fasta_header(F.concat(F.lit("@"), c, F.lit(" part"))).alias("header"), ids.with_suffix(c, F.lit("gene")).alias("with_gene"), ids.with_prefix(c, F.lit("species")).alias("with_species")
    )


@query("select queryid, subjectid, case when split_part(queryid, '@', 1) = split_part(subjectid, '@', 1) then 1 else 0 end same_otu, count(*) hits from hits where queryid is not null and subjectid is not null group by all")
def same_otu_pairs(t):
    rows = t("hits").filter("queryid is not null and subjectid is not null")
    same = (ids.otu_part(F.col("queryid")) == ids.otu_part(F.col("subjectid"))).cast("int")
    return rows.groupBy("queryid", "subjectid", same.alias("same_otu")).agg(F.count("*").alias("hits"))


# ---- sequences

@query("select count(*) records, sum(length(sequencedata))::bigint residues, max(length(sequencedata))::int longest, sum(length(replace(sequencedata, '-', '')))::bigint ungapped from sequences where sequencedata is not null")
def seq_stats(t):
    s = F.col("sequencedata")
    return t("sequences").filter(s.isNotNull()).agg(F.count("*").alias("records"), F.sum(F.length(s)).alias("residues"), F.max(F.length(s)).alias("longest"), F.sum(F.length(seq.ungapped(s))).alias("ungapped"))


@query("""select seq_id, loaded_at, reverse(translate(sequencedata, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) rc,
          regexp_full_match(sequencedata, '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]*') nucleotide from sequences""")
def reverse_complement(t):
    s = F.col("sequencedata")
    return t("sequences").select("seq_id", "loaded_at", seq.reverse_complement(s).alias("rc"), seq.is_nucleotide(s).alias("nucleotide"))


_TRANSLATE = """
s as (select seq_id, loaded_at, translate(upper(replace(sequencedata, '-', '')), 'U', 'T') f from sequences where sequencedata is not null),
x as (select *, reverse(translate(f, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) r from s),
y as (select seq_id, loaded_at, frame, substr(case when frame > 0 then f else r end, abs(frame)) d from x, (values (1), (2), (3), (-1), (-2), (-3)) v(frame)),
c as (select seq_id, loaded_at, frame, d, list_transform(range(length(d) // 3), lambda i: substr(d, (i * 3 + 1)::bigint, 3)) k from y)
"""


@query(f"""with {_TRANSLATE} select seq_id, loaded_at, frame, coalesce(array_to_string(list_transform(k, lambda c: case when regexp_full_match(c, '[TCAG]{{3}}')
          then substr('{seq.STANDARD_CODE}', instr('TCAG', c[1]) * 16 + instr('TCAG', c[2]) * 4 + instr('TCAG', c[3]) - 20, 1) else 'X' end), ''), '') protein from c""")
def translate_frames(t):
    rows = t("sequences").filter("sequencedata is not null")
    parts = F.array(*[F.struct(F.lit(f).alias("frame"), seq.translated(F.col("sequencedata"), f).alias("protein")) for f in search.FRAMES])
    return rows.select("seq_id", "loaded_at", F.explode(parts).alias("x")).select("seq_id", "loaded_at", "x.frame", "x.protein")


@query("""select seq_id, loaded_at, (length(sequencedata) - length(replace(sequencedata, '-', '')))::int gaps, contains(sequencedata, '-') gapped,
          round(case when length(sequencedata) = 0 then 0 else (length(sequencedata) - length(replace(sequencedata, '-', ''))) / length(sequencedata) end, 6)::double missing from sequences where sequencedata is not null""")
def gap_stats(t):
    s = F.col("sequencedata")
    return t("sequences").filter(s.isNotNull()).select("seq_id", "loaded_at", seq.gap_count(s).alias("gaps"), seq.has_gaps(s).alias("gapped"), F.round(seq.missing_fraction(s), 6).alias("missing"))


_RUNS = """
c as (select seq_id, loaded_at, sequencedata s, i, substr(sequencedata, i, 1) x from sequences, generate_series(1, length(sequencedata)) g(i) where sequencedata is not null),
k as (select *, i - row_number() over (partition by seq_id, loaded_at, s order by i) run from c where x <> '-'),
r as (select seq_id, loaded_at, s, min(i) first, max(i) last from k group by seq_id, loaded_at, s, run)
"""


@query(f"with {_RUNS} select seq_id, loaded_at, first::int first_pos, last::int last_pos, repeat('-', (first - 1)::bigint) || substr(s, first::bigint, (last - first + 1)::bigint) || repeat('-', (length(s) - last)::bigint) padded from r")
def compound_regions(t):
    s = F.col("sequencedata")
    rows = t("sequences").filter(s.isNotNull()).select("seq_id", "loaded_at", "sequencedata", F.explode(seq.nongap_runs(s)).alias("r"))
    first, last = F.col("r.first"), F.col("r.last")
    piece = seq.padded(F.substr("sequencedata", first, last - first + 1), first, last, F.length("sequencedata"))
    return rows.select("seq_id", "loaded_at", first.alias("first_pos"), last.alias("last_pos"), piece.alias("padded"))


@query(f"with {_RUNS}, m as (select seq_id, loaded_at, length(s) n, min(first) f, min_by(last, first) l from r group by all) select seq_id, loaded_at, f::int first_pos, l::int last_pos, l - f + 1 < n compound from m")
def nongap_range(t):
    s = F.col("sequencedata")
    rows = t("sequences").filter(s.isNotNull()).select("seq_id", "loaded_at", F.length(s).alias("n"), F.get(seq.nongap_runs(s), F.lit(0)).alias("r")).filter("r is not null")
    return rows.select("seq_id", "loaded_at", F.col("r.first").alias("first_pos"), F.col("r.last").alias("last_pos"), (F.col("r.last") - F.col("r.first") + 1 < F.col("n")).alias("compound"))


@query("""select i::int pos, sum(case when substr(sequencedata, i, 1) = '-' then 1 else 0 end)::bigint gaps, count(*) letters,
          round(avg(case when substr(sequencedata, i, 1) = '-' then 1 else 0 end), 6)::double part
          from sequences, generate_series(1, length(sequencedata)) g(i) where sequencedata is not null group by i""")
def gap_column_frequency(t):
    rows = t("sequences").filter("sequencedata is not null").select(F.posexplode(seq.gap_vector(F.col("sequencedata"))).alias("p", "gap"))
    return rows.groupBy((F.col("p") + 1).alias("pos")).agg(F.sum("gap").alias("gaps"), F.count("*").alias("letters"), F.round(F.avg("gap"), 6).alias("part"))


@query("select otu, count(*) records from sequences group by otu")
def otu_frequencies(t):
    return t("sequences").groupBy("otu").agg(F.count("*").alias("records"))


@query("""select count(distinct otu) otus, count(distinct length(sequencedata)) = 1 equal_length, count(distinct sequencedata) = count(sequencedata) unique_sequences,
          round(avg(case when length(sequencedata) = 0 then 0 else length(replace(sequencedata, '-', '')) / length(sequencedata) end), 6)::double mean_coverage, bool_or(contains(sequencedata, '-')) gapped from sequences""")
def alignment_summary(t):
    s = F.col("sequencedata")
    print_of = F.unhex(F.sha2(s, 256))  # whole texts would be the keys of a shuffle
    return t("sequences").agg(
        F.countDistinct("otu").alias("otus"), F.coalesce(F.min(F.length(s)) == F.max(F.length(s)), F.lit(False)).alias("equal_length"), (F.countDistinct(print_of) == F.count(s)).alias("unique_sequences"),
        F.round(F.avg(seq.covered_fraction(s)), 6).alias("mean_coverage"), F.bool_or(seq.has_gaps(s)).alias("gapped"),
    )


# ---- alignments as operation strings

_COUNT = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[{}]', 1), lambda n: n::bigint)), 0)::bigint"


@query(rf"select hit_id, array_to_string(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), '') cleaned, len(regexp_extract_all(cigar, '\d+[\\/]'))::int shifts from hits where cigar is not null")
def cigar_clean(t):
    c = F.col("cigar")
    return t("hits").filter(c.isNotNull()).select("hit_id", cig.cleaned(c).alias("cleaned"), cig.shifts(c).alias("shifts"))


@query(f"""with c as (select hit_id, {_COUNT.format('M=X')} m, {_COUNT.format('DN')} d, {_COUNT.format('I')} i from hits where cigar is not null)
          select hit_id, m aligned, d deleted, i inserted, round(case when m + d = 0 then 0 else m / (m + d) end, 6)::double occupancy from c""")
def cigar_counts(t):
    c = F.col("cigar")
    return t("hits").filter(c.isNotNull()).select("hit_id", cig.aligned(c).alias("aligned"), cig.deleted(c).alias("deleted"), cig.inserted(c).alias("inserted"), F.round(cig.occupancy(c), 6).alias("occupancy"))


@query(r"""with h as (select hit_id, cigar, case when querystart > queryend
            then reverse(translate(substr(full_querysequence, least(querystart, queryend), abs(queryend - querystart) + 1), 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn'))
            else substr(full_querysequence, least(querystart, queryend), abs(queryend - querystart) + 1) end s,
            regexp_extract_all(cigar, '\d+[MIDNSHP=X\\/]') o from hits where full_querysequence is not null and cigar is not null and querystart >= 1 and queryend >= 1),
          p as (select hit_id, cigar, s, i, right(o[i], 1) op, left(o[i], length(o[i]) - 1)::int n from h, generate_series(1, len(o)) g(i)),
          c as (select *, case when op in ('\', '/', 'D', 'N') then 0 else 3 * n end taken, 1 + coalesce(sum(case op when '\' then n when '/' then -n when 'D' then 0 when 'N' then 0 else 3 * n end)
            over (partition by hit_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint pos from p),
          r as (select hit_id, string_agg(case when taken > 0 then substr(s, greatest(pos, 1), taken) else '' end, '' order by i) nucleotides, count(*) filter (where op in ('\', '/')) shifts from c group by hit_id)
          select hit_id, coalesce(nucleotides, '') nucleotides, coalesce(shifts, 0)::int shifts from h left join r using (hit_id)""")
def frameshift_repair(t):
    return hits.repaired_hits(t("hits")).select("hit_id", "nucleotides", "shifts")


def _amino(text: str) -> str:
    """SQL for the translation of a text's first frame."""
    codons = f"list_transform(range(length({text}) // 3), lambda i: substr(translate(upper(replace({text}, '-', '')), 'U', 'T'), (i * 3 + 1)::bigint, 3))"
    letter = f"case when regexp_full_match(c, '[TCAG]{{3}}') then substr('{seq.STANDARD_CODE}', instr('TCAG', c[1]) * 16 + instr('TCAG', c[2]) * 4 + instr('TCAG', c[3]) - 20, 1) else 'X' end"
    return f"coalesce(array_to_string(list_transform(list_filter({codons}, lambda c: length(c) = 3), lambda c: {letter}), ''), '')"


@query(rf"""with h as (select hit_id, cigar, querystart > queryend back, length(full_querysequence) size, querystart a, queryend b, abs(queryframe) queryframe, replace(translated_querysequence, '-', '') reported,
            case when querystart > queryend then reverse(translate(full_querysequence, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) else full_querysequence end q,
            regexp_extract_all(cigar, '\d+[MIDNSHP=X\\/]') o from hits where full_querysequence is not null and cigar is not null and querystart >= 1 and queryend >= 1),
          m as (select *, case when back then size - a + 1 else a end f, case when back then size - b + 1 else b end l from h),
          s as (select *, substr(q, 1, greatest(f - 1, 0)) pre, substr(q, greatest(f, 1), greatest(l - greatest(f, 1) + 1, 0)) seg, substr(q, greatest(l + 1, 1)) post from m),
          p as (select hit_id, seg, i, right(o[i], 1) op, left(o[i], length(o[i]) - 1)::int n from s, generate_series(1, len(o)) g(i)),
          c as (select *, case when op in ('\', '/', 'D', 'N') then 0 else 3 * n end taken, 1 + coalesce(sum(case op when '\' then n when '/' then -n when 'D' then 0 when 'N' then 0 else 3 * n end)
            over (partition by hit_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint pos from p),
          r as (select hit_id, string_agg(case when taken > 0 then substr(seg, greatest(pos, 1), taken) else '' end, '' order by i) nuc from c group by hit_id),
          k as (select hit_id, op, i, n, case when lag(op) over (partition by hit_id order by i) = op then 0 else 1 end new from p where op not in ('\', '/')),
          j as (select hit_id, string_agg(n::varchar || op, '' order by run) cigar from (select hit_id, run, any_value(op) op, sum(n)::bigint n from (select *, sum(new) over (partition by hit_id order by i) run from k) group by hit_id, run) group by hit_id),
          x as (select s.*, coalesce(nuc, '') nuc, coalesce(j.cigar, '') fused, substr(pre, (length(pre) % 3 + 1)::bigint) lead from s left join r using (hit_id) left join j using (hit_id))
          select hit_id, {_amino('nuc')} protein, {_amino('nuc')} = reported same, pre || nuc || post query, f::int querystart, (f + length(nuc) - 1)::int queryend, queryframe, fused cigar,
            {_amino('lead')} || reported || {_amino('post')} patched from x""")
def patched_translation(t):
    """Repaired full queries with the patched protein, and whether the segment, repaired and translated, agrees with the reported one."""
    reported = t("hits").select("hit_id", F.regexp_replace("translated_querysequence", "-", "").alias("reported"))
    rows = hits.repaired_hits(t("hits")).join(reported, "hit_id").select("hit_id", "protein", (F.col("protein") == F.col("reported")).alias("same"))
    return rows.join(hits.repaired_queries(t("hits")).withColumnRenamed("protein", "patched"), "hit_id")


# ---- intervals

_SPANS = """v as (select distinct subjectid, least(subjectstart, subjectend) f, greatest(subjectstart, subjectend) l from hits where subjectid is not null and subjectstart >= 1 and subjectend >= 1),
w as (select subjectid, f, l, lead(f) over o nf, lead(l) over o nl from v window o as (partition by subjectid order by f, l))"""


def _spans(t) -> DataFrame:
    """Distinct usable intervals of each subject."""
    return t("hits").filter("subjectid is not null and subjectstart >= 1 and subjectend >= 1").select("subjectid", F.least("subjectstart", "subjectend").alias("f"), F.greatest("subjectstart", "subjectend").alias("l")).distinct()


def _neighbours(t) -> DataFrame:
    order = W.partitionBy("subjectid").orderBy("f", "l")
    return _spans(t).select("subjectid", "f", "l", F.lead("f").over(order).alias("nf"), F.lead("l").over(order).alias("nl")).filter("nf is not null")


@query(f"""with {_SPANS} select subjectid, f, l, nf, nl, f <= nl and nf <= l as "overlaps", f <= nf ordered, f < nf "precedes", l - f > nl - nf and f <= nf and l >= nl shadows from w where nf is not null""")
def interval_relations(t):
    a, b = Interval(F.col("f"), F.col("l")), Interval(F.col("nf"), F.col("nl"))
    return _neighbours(t).select("subjectid", "f", "l", "nf", "nl", a.overlaps(b).alias("overlaps"), a.ordered(b).alias("ordered"), a.precedes(b).alias("precedes"), a.shadows(b).alias("shadows"))


@query(f"""with {_SPANS} select subjectid, f, l, nf, nl, greatest(f, nf) common_first, least(l, nl) common_last,
          case when f <> nf then least(f, nf) end before_first, case when f <> nf then greatest(f, nf) - 1 end before_last,
          case when l <> nl then least(l, nl) + 1 end after_first, case when l <> nl then greatest(l, nl) end after_last,
          least(f, nf) hull_first, greatest(l, nl) hull_last, case when l - f >= nl - nf then f else nf end longer_first from w where f <= nl and nf <= l""")
def interval_geometry(t):
    a, b = Interval(F.col("f"), F.col("l")), Interval(F.col("nf"), F.col("nl"))
    shown = {"common": a.overlap(b), "before": a.before_overlap(b), "after": a.after_overlap(b), "hull": a.hull(b)}
    columns = [getattr(i, end).alias(f"{name}_{end}") for name, i in shown.items() for end in ("first", "last")]
    return _neighbours(t).filter(a.overlaps(b)).select("subjectid", "f", "l", "nf", "nl", *columns, a.longer(b).first.alias("longer_first"))


@query(f"with {_SPANS} select subjectid, count(*) intervals, coalesce(bool_or(nf <= l), false) overlapping from w group by subjectid")
def has_overlaps(t):
    order = W.partitionBy("subjectid").orderBy("f", "l")
    rows = _spans(t).select("subjectid", "l", F.lead("f").over(order).alias("nf"))
    return rows.groupBy("subjectid").agg(F.count("*").alias("intervals"), F.coalesce(F.bool_or(F.col("nf") <= F.col("l")), F.lit(False)).alias("overlapping"))


@query("""select hit_id, least(subjectstart, subjectend) + (greatest(subjectstart, subjectend) - least(subjectstart, subjectend)) // 2 middle,
          (greatest(subjectstart, subjectend) - least(subjectstart, subjectend)) // 2 + 1 on_aligned,
          case when querystart > queryend then querystart - 3 * ((greatest(subjectstart, subjectend) - least(subjectstart, subjectend)) // 2) else querystart + 3 * ((greatest(subjectstart, subjectend) - least(subjectstart, subjectend)) // 2) end codon_first,
          querystart > queryend reversed from hits where subjectstart >= 1 and subjectend >= 1""")
def coordinate_maps(t):
    s = Interval(F.col("subjectstart"), F.col("subjectend")).oriented()
    rows = t("hits").filter("subjectstart >= 1 and subjectend >= 1").withColumn("middle", (s.first + F.floor((s.last - s.first) / 2)).cast("int"))
    place = full_to_subject(F.col("middle"), s.first, s.last)
    c = codon(place, F.col("querystart"), F.col("queryend"))
    return rows.select("hit_id", "middle", place.alias("on_aligned"), c.first.alias("codon_first"), Interval(F.col("querystart"), F.col("queryend")).is_reverse.alias("reversed"))


# ---- joins and set operations

@query("select h.hit_id, h.subjectid, m.otu, m.reference_len from hits h join markers m using (subjectid)")
def hits_with_reference(t):
    found = lookup_join(t("hits").select("hit_id", "subjectid"), t("markers").select("subjectid", "otu", "reference_len"), "subjectid", heavy_keys(t("hits"), "subjectid"))
    return found.select("hit_id", "subjectid", "otu", "reference_len")


@query("select hit_id, queryid from hits where queryid is not null and queryid not in (select seq_id from sequences where seq_id is not null)")
def orphan_hits(t):
    known = t("sequences").filter("seq_id is not null").select(F.col("seq_id").alias("queryid")).distinct()
    rows = t("hits").filter("queryid is not null").select("hit_id", "queryid")
    return lookup_join(rows, known, "queryid", heavy_keys(rows, "queryid"), "left_anti").select("hit_id", "queryid")


@query("select seq_id, loaded_at, length(sequencedata)::int n from sequences where seq_id in (select queryid from hits)")
def select_sequences(t):
    wanted = t("hits").filter("queryid is not null").select(F.col("queryid").alias("seq_id")).distinct()  # combined before the shuffle
    return t("sequences").join(wanted, "seq_id", "left_semi").select("seq_id", "loaded_at", F.length("sequencedata").alias("n"))


@query("select subjectid, min(hit_id) first_hit, count(*) hits from hits where subjectid is not null group by subjectid")
def distinct_subjects(t):
    return t("hits").filter("subjectid is not null").groupBy("subjectid").agg(F.min("hit_id").alias("first_hit"), F.count("*").alias("hits"))


@query("select min(hit_id) hit_id, queryid, subjectid, querystart, queryend, subjectstart, subjectend, cigar, bitscore from hits group by all_columns".replace("group by all_columns", "group by queryid, translated_querysequence, full_querysequence, querystart, queryend, queryframe, subjectid, subjectsequence, subjectstart, subjectend, cigar, percentidentical, bitscore, searched_at"))
def distinct_hits(t):
    return hits.distinct_hits(t("hits")).select("hit_id", "queryid", "subjectid", "querystart", "queryend", "subjectstart", "subjectend", "cigar", "bitscore")


@query("select hit_id, queryid, querystart, queryend from (select *, row_number() over (partition by queryid, querystart, queryend order by hit_id) r from hits) where r = 1")
def dedup_query_range(t):
    return hits.first_of(t("hits").select("hit_id", "queryid", "querystart", "queryend"), ["queryid", "querystart", "queryend"], [F.asc("hit_id")])


_CANONICAL = """x as (select *, upper(replace(sequencedata, '-', '')) p from sequences where sequencedata is not null),
y as (select *, least(p, reverse(translate(p, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))) canon from x)"""


@query(f"with {_CANONICAL} select seq_id, loaded_at, length(sequencedata)::int n from (select *, row_number() over (partition by canon order by seq_id, loaded_at, sequencedata) r from y) where r = 1")
def dedup_canonical(t):
    return hits.dedup_canonical(t("sequences"), "sequencedata", ["seq_id", "loaded_at", "sequencedata"]).select("seq_id", "loaded_at", F.length("sequencedata").alias("n"))


@query("select seq_id, loaded_at, length(sequencedata)::int n from (select *, row_number() over (partition by seq_id order by loaded_at nulls first, sequencedata nulls first) r from sequences where seq_id is not null) where r = 1")
def dedup_ids(t):
    return hits.dedup_ids(t("sequences"), "seq_id", ["loaded_at", "sequencedata"]).select("seq_id", "loaded_at", F.length("sequencedata").alias("n"))


@query("select translated_querysequence, hit_id from (select *, row_number() over (partition by translated_querysequence order by percentidentical desc, hit_id) r from hits where translated_querysequence is not null) where r = 1")
def unique_sequences(t):
    """The hit with the best identity among those of equal sequence."""
    rows = t("hits").filter("translated_querysequence is not null").select("translated_querysequence", "hit_id", "percentidentical")
    return hits.first_of(rows, ["translated_querysequence"], [F.desc("percentidentical"), F.asc("hit_id")]).select("translated_querysequence", "hit_id")


@query(f"with {_CANONICAL}, o as (select * from (select *, row_number() over (partition by canon order by sequencedata, seq_id) r from y) where r = 1) select seq_id, sequencedata from (select *, row_number() over (partition by seq_id order by sequencedata) q from o) where q = 1")
def combined_records(t):
    return hits.combined(t("sequences").filter("seq_id is not null").select("seq_id", "sequencedata"), "seq_id", "sequencedata")


@query("select seq_id, loaded_at, row_number() over (order by sequencedata nulls first, seq_id, loaded_at) place from sequences")
def sort_permutation(t):
    return sampling.numbered(t("sequences").select("seq_id", "loaded_at", "sequencedata"), ["sequencedata", "seq_id", "loaded_at"]).drop("sequencedata")


@query("select seq_id record_id, 'contig' kind from sequences where seq_id is not null union select subjectid, 'reference' from markers where subjectid is not null")
def pooled_records(t):
    a = t("sequences").filter("seq_id is not null").select(F.col("seq_id").alias("record_id"), F.lit("contig").alias("kind"))
    return a.unionByName(t("markers").filter("subjectid is not null").select(F.col("subjectid").alias("record_id"), F.lit("reference").alias("kind"))).distinct()


# ---- ranking

_RANKED = "select hit_id, queryid, subjectid, bitscore from (select *, row_number() over (partition by {} order by bitscore desc, hit_id) r from hits where isfinite(bitscore) and {}) where r <= {}"
_SHORT = ("hit_id", "queryid", "subjectid", "bitscore")


@query(_RANKED.format("subjectid", "subjectid is not null", 1))
def best_hit_per_subject(t):
    return hits.best_hit_per_subject(t("hits").select(*_SHORT))


@query(_RANKED.format("queryid", "queryid is not null", 25))
def max_target_seqs(t):
    return hits.max_target_seqs(t("hits").select(*_SHORT))


@query(_RANKED.format("queryid, subjectid", "queryid is not null and subjectid is not null", 1))
def max_hsps(t):
    return hits.max_hsps(t("hits").select(*_SHORT))


@query("select hit_id, queryid, subjectid, bitscore from (select *, max(bitscore) over (partition by queryid) best from hits where isfinite(bitscore) and queryid is not null) where bitscore >= best * (1 - 10 / 100.0)")
def top_percent(t):
    return hits.top_percent(t("hits").select(*_SHORT), 10)


@query("""select hit_id, queryid, subjectid, bitscore from hits where isfinite(bitscore) and percentidentical >= 70 and bitscore >= 50
          and abs(subjectend - subjectstart) + 1 >= 20 and full_querysequence <> '' and 100 * (abs(queryend - querystart) + 1) / length(full_querysequence) >= 5""")
def hit_filters(t):
    return hits.filter_hits(t("hits"), 70, 50, 20, 5).select(*_SHORT)


# ---- resolving and stitching

def _whole_numbers(rows: DataFrame) -> DataFrame:
    """Positions as int, as the tables have them."""
    return rows.withColumns({c: F.col(c).cast("int") for c in rows.columns if c in ("pos", "first_pos", "last_pos")})


def _won(hits: str, markers: str = "markers") -> str:
    """Common table expressions of the winners among the hits of a table."""
    return _WINNERS.replace("from hits where", f"from {hits} where").replace("from markers where", f"from {markers} where")


_WINNERS = r"""
h as (select hit_id, subjectid, bitscore, translated_querysequence q, least(subjectstart, subjectend) f, greatest(subjectstart, subjectend) l, regexp_extract_all(cigar, '\d+[MIDNSHP=X]') o
      from hits where subjectid is not null and translated_querysequence is not null and cigar is not null and subjectstart >= 1 and subjectend >= 1 and isfinite(bitscore)),
p as (select hit_id, subjectid, bitscore, q, f, l, i, right(o[i], 1) op, left(o[i], length(o[i]) - 1)::int n from h, generate_series(1, len(o)) g(i)),
s as (select *, coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then n else 0 end) over w, 0)::bigint r, coalesce(sum(case when op in ('M', '=', 'X', 'I') then n else 0 end) over w, 0)::bigint k
      from p window w as (partition by hit_id order by i rows between unbounded preceding and 1 preceding)),
a as (select subjectid, f + r + j pos, hit_id, bitscore, case when op in ('D', 'N') or substr(q, k + j + 1, 1) = '' then '-' else substr(q, k + j + 1, 1) end residue, l
      from s, generate_series(0, n - 1) g(j) where op in ('M', '=', 'X', 'D', 'N')),
won as (select subjectid, pos, hit_id, bitscore, residue from (select *, row_number() over (partition by subjectid, pos order by bitscore desc, hit_id, residue desc) x from a where pos <= l) where x = 1),
ref as (select subjectid, min(sequencedata) z from markers where subjectid is not null and sequencedata is not null group by subjectid),
lined as (select won.*, substr(z, pos, 1) ref_residue, length(z) reference_len from won join ref using (subjectid) where substr(z, pos, 1) <> ''),
runs as (select subjectid, hit_id, min(pos) first_pos, max(pos) last_pos from (select *, pos - row_number() over (partition by subjectid, hit_id order by pos) g from won) group by subjectid, hit_id, g)
"""
_WON = _won("hits")


@query(f"with {_WON} select subjectid, hit_id, first_pos::int first_pos, last_pos::int last_pos from runs")
def resolve_overlaps(t):
    return _whole_numbers(stitch.owned_regions(t("hits")).drop("bitscore"))


@query(f"""with {_WON}, z as (select subjectid, min(reference_len) n from markers where subjectid is not null and reference_len is not null group by subjectid),
          e as (select subjectid, n, first_pos, last_pos, lag(last_pos, 1, 0) over o b, lead(first_pos) over o x from runs join z using (subjectid) where first_pos <= n window o as (partition by subjectid order by first_pos))
          select subjectid, (b + 1)::bigint first_pos, (first_pos - 1)::bigint last_pos from e where b + 1 <= first_pos - 1
          union all select subjectid, (last_pos + 1)::bigint, n from e where x is null and last_pos + 1 <= n""")
def stitch_bridges(t):
    return stitch.bridges(stitch.owned_regions(t("hits")), t("markers"))


@query(f"with {_WON} select subjectid, reference_len::int reference_len, string_agg(coalesce(residue, '-'), '' order by i) aligned, replace(string_agg(coalesce(residue, '-'), '' order by i), '-', '') residues from (select subjectid, reference_len, unnest(generate_series(1, reference_len)) i from (select distinct subjectid, reference_len from lined)) g left join (select subjectid, pos i, residue from lined) using (subjectid, i) group by subjectid, reference_len")
def stitched_sequences(t):
    return stitch.stitched(stitch.resolve_regions(t("hits")), t("markers"))


_SEGMENT = """case when querystart > queryend
            then reverse(translate(substr(full_querysequence, least(querystart, queryend), abs(queryend - querystart) + 1), 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn'))
            else substr(full_querysequence, least(querystart, queryend), abs(queryend - querystart) + 1) end"""
_CODONS = rf"""
d as (select hit_id, case when querystart >= 1 and queryend >= 1 then {_SEGMENT} end seg, regexp_extract_all(cigar, '\d+[MIDNSHP=X\\/]') o from hits where cigar is not null),
e as (select hit_id, seg, i, right(o[i], 1) op, left(o[i], length(o[i]) - 1)::int n from d, generate_series(1, len(o)) g(i)),
placed as (select *, coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then n else 0 end) over w, 0)::bigint r,
       1 + coalesce(sum(case op when '\' then n when '/' then -n when 'D' then 0 when 'N' then 0 else 3 * n end) over w, 0)::bigint p from e window w as (partition by hit_id order by i rows between unbounded preceding and 1 preceding)),
codon as (select hit_id, r + j r, case when op in ('D', 'N') then '---' else rpad(substr(seg, greatest(p, 1) + 3 * j, 3), 3, '-') end codon from placed, generate_series(0, n - 1) g(j) where op in ('M', '=', 'X', 'D', 'N'))
"""


@query(f"""with {_WON}, {_CODONS}, c as (select lined.*, coalesce(codon, '---') codon from lined join h using (hit_id) left join codon on codon.hit_id = lined.hit_id and r = pos - f)
          select subjectid, reference_len::int reference_len, string_agg(coalesce(codon, '---'), '' order by i) aligned_dna, replace(string_agg(coalesce(codon, '---'), '' order by i), '-', '') dna
          from (select subjectid, reference_len, unnest(generate_series(1, reference_len)) i from (select distinct subjectid, reference_len from lined)) g left join (select subjectid, pos i, codon from c) using (subjectid, i) group by all""")
def stitched_dna(t):
    """The nucleotides of the stitched sequences, three letters for each residue."""
    return stitch.stitched(stitch.resolve_regions(t("hits"), nucleotides=True), t("markers")).select("subjectid", "reference_len", "aligned_dna", "dna")


@query(f"with {_WON} select subjectid, pos::int pos, case when contains('*BJZX', upper(residue)) then '-' else residue end residue from won")
def mask_columns(t):
    return _whole_numbers(stitch.masked(stitch.resolve_positions(t("hits"))).select("subjectid", "pos", "residue"))


_SCORE = f"""score as (select subjectid, pos, case when residue = '-' then -12 when upper(residue) = upper(ref_residue) then 5 else -2 end v from lined)"""


def _scored(t) -> DataFrame:
    lined = stitch.with_reference(stitch.resolve_regions(t("hits")), t("markers"))
    value = F.when(F.col("residue") == "-", -12).when(F.upper("residue") == F.upper("ref_residue"), 5).otherwise(-2)
    return lined.select("subjectid", "pos", "residue", value.alias("v"))


@query(f"with {_WON}, {_SCORE} select subjectid, pos::int pos, round(m, 6)::double window_mean from (select subjectid, pos, avg(v) over w m, count(*) over w n from score window w as (partition by subjectid order by pos range between current row and 3 following)) where n = 4")
def sliding_mean(t):
    return _whole_numbers(stitch.sliding_mean(_scored(t), "v").select("subjectid", "pos", F.round("window_mean", 6).alias("window_mean")))


_BLOSUM = ", ".join(f"('{pair}', {v})" for pair, v in pair_scores().items())
_CELLS = f"""
shown as (select subjectid, pos, case when contains('*BJZX', upper(residue)) then '-' else residue end residue from lined),
grid as (select subjectid, n, unnest(generate_series(1, n)) i from (select distinct subjectid, reference_len n from lined)),
cell as (select g.subjectid, n, i, coalesce(residue, '-') residue, substr(z, i::bigint, 1) letter from grid g join ref using (subjectid) left join shown m on m.subjectid = g.subjectid and m.pos = i),
blosum(pair, v) as (values {_BLOSUM}),
valued as (select cell.*, residue = '-' gap, case when residue = '-' then -1 else coalesce(v, -4) end v, lag(residue) over (partition by subjectid order by i) before from cell left join blosum on pair = upper(residue || letter)),
spot as (select subjectid, i, n, gap, count(*) over f c, sum(v) over f - 11 * (gap::int + coalesce(sum(case when gap and before <> '-' then 1 else 0 end) over (partition by subjectid order by i rows between 1 following and 3 following), 0)) total
         from valued window f as (partition by subjectid order by i rows between current row and 3 following)),
cut as (select distinct subjectid, i + j i from spot, generate_series(0, 3) g(j) where c = least(4, n) and total / c < -7.0),
kept as (select cell.subjectid, n, i, letter, case when cut.i is not null then '-' else residue end residue from cell left join cut using (subjectid, i))
"""


@query(f"with {_WON}, {_CELLS} select subjectid, n::int reference_len, string_agg(residue, '' order by i) aligned, replace(string_agg(residue, '' order by i), '-', '') residues from kept group by subjectid, n")
def sliding_trim(t):
    """Stitched sequences after windows that score below -7.0 on BLOSUM62 have been cut."""
    rows = stitch.stitched_on(stitch.masked(stitch.resolve_regions(t("hits"))), t("markers"))
    return stitch.trimmed(rows).drop("reference")


_STATS = f"""{_WON}, k as (select subjectid, reference_len, count(*) filter (residue <> '-') query_len, count(*) filter (residue <> '-' and upper(residue) = upper(ref_residue)) matches,
  count(*) filter (residue <> '-' and upper(residue) <> upper(ref_residue)) mismatches from lined group by all),
m as (select subjectid, reference_len::int reference_len, query_len, (select count(*) from runs r where r.subjectid = k.subjectid) regions, (select count(*) from hits h where h.subjectid = k.subjectid) contigs,
  matches, mismatches, reference_len - matches - mismatches deletions, round_even(100.0 * (matches + mismatches) / reference_len, 2)::double query_coverage,
  case when matches + mismatches = 0 then 0 else round_even(100.0 * matches / (matches + mismatches), 2) end::double identity from k)"""


def _marker_stats(t) -> DataFrame:
    return stitch.marker_statistics(t("hits"), stitch.resolve_regions(t("hits")), t("markers"))


@query(f"with {_STATS} select * from m")
def marker_stats(t):
    return _marker_stats(t)


_NUMBERS = ("reference_len", "query_len", "regions", "contigs", "matches", "mismatches", "deletions", "query_coverage", "identity")


@query(f"with {_STATS} " + " union all ".join(f"select '{c}' as variable, round(avg({c}), 6)::double mean, round(min({c}), 6)::double min, round(quantile_cont({c}, 0.5), 6)::double median, round(max({c}), 6)::double max from m" for c in _NUMBERS))
def stats_summary(t):
    return stats.describe(_marker_stats(t), list(_NUMBERS))


def _classes(column: str, ends: tuple[float, ...]) -> str:
    cases = " ".join(f"when {column} <= {e} then {i}" for i, e in enumerate(ends, 1))
    listed = ", ".join(f"({i}, {e}::double)" for i, e in enumerate(ends, 1))
    return f"with {_STATS}, b as (select case {cases} else 0 end class_no, count(*) n from m group by 1) select class_no::int class_no, class_end, coalesce(n, 0)::bigint n from (values {listed}) v(class_no, class_end) full join b using (class_no)"


@query(_classes("query_coverage", stats.COVERAGE_CLASSES))
def coverage_histogram(t):
    return stats.histogram(_marker_stats(t), "query_coverage", stats.COVERAGE_CLASSES)


@query(_classes("identity", stats.IDENTITY_CLASSES))
def identity_histogram(t):
    return stats.histogram(_marker_stats(t), "identity", stats.IDENTITY_CLASSES)


@query(f"with {_STATS} select (select count(*) from m) markers_out, (select count(distinct subjectid) from markers) markers_in, round_even(100.0 * (select count(*) from m) / (select count(distinct subjectid) from markers), 1)::double percent")
def marker_yield(t):
    out = _marker_stats(t).agg(F.count("*").alias("markers_out"))
    return out.join(t("markers").agg(F.countDistinct("subjectid").alias("markers_in"))).withColumn("percent", cig.percentage(F.col("markers_out"), F.col("markers_in")))


@query(f"with {_WON} select subjectid, hit_id, min(pos)::int first_pos, max(pos)::int last_pos, string_agg(residue, '' order by pos) residues from (select *, pos - row_number() over (partition by subjectid, hit_id order by pos) g from won) group by subjectid, hit_id, g")
def region_sequences(t):
    return _whole_numbers(stitch.resolve_regions(t("hits")).drop("bitscore"))


@query(f"with {_WON} select hit_id, min(pos)::int first_pos, string_agg(residue, '' order by pos) residues from a where pos <= l group by hit_id")
def mask_insertions(t):
    return _whole_numbers(stitch.aligned_text(t("hits")))


@query(f"""with {_WON}, m as (select a.hit_id, pos, case when op in ('D', 'N') then k else k + j + 1 end query_pos from (select hit_id, f + r + j pos, op, k, j, l from s, generate_series(0, n - 1) g(j) where op in ('M', '=', 'X', 'D', 'N')) a where pos <= l),
          c as (select m.*, querystart a, queryend b from m join hits using (hit_id))
          select hit_id, pos::int pos, query_pos::int query_pos, case when query_pos > 0 then case when a > b then a - 3 * (query_pos - 1) else a + 3 * (query_pos - 1) end end::int codon_first,
          case when query_pos > 0 then case when a > b then a - 3 * (query_pos - 1) - 2 else a + 3 * (query_pos - 1) + 2 end end::int codon_last from c""")
def coordinate_table(t):
    return _whole_numbers(stitch.coordinate_table(t("hits")))


_MATCH = "op in ('M', '=', 'X')"


@query(f"""with {_WON}, x as (select r.subjectid, r.hit_id, r.first_pos, r.last_pos, i, op, n, s.r, k, q, f, r.first_pos - f + 1 a, r.last_pos - f + 1 b, greatest(r.first_pos - f + 1, s.r + 1) lo, least(r.last_pos - f + 1, s.r + n) hi from runs r join s using (hit_id)),
          y as (select *, case when {_MATCH} or op in ('D', 'N') then hi - lo + 1 when op = 'I' and a <= r and r < b then n else 0 end size from x),
          z as (select *, min(case when {_MATCH} then i end) over w i0, max(case when {_MATCH} then i end) over w i1 from y where size > 0 window w as (partition by hit_id, first_pos)),
          e as (select subjectid, hit_id, first_pos, last_pos, any_value(f) f, any_value(q) q, string_agg(size::bigint::varchar || op, '' order by i) cigar, min(lo) filter ({_MATCH}) r0, max(hi) filter ({_MATCH}) r1,
            min(k + lo - r) filter ({_MATCH}) q0, max(k + hi - r) filter ({_MATCH}) q1 from z where i between i0 and i1 group by all)
          select e.subjectid, e.hit_id, first_pos::int region_first, last_pos::int region_last, (f + r0 - 1)::int subjectstart, (f + r1 - 1)::int subjectend, e.cigar, substr(q, q0::bigint, (q1 - q0 + 1)::bigint) translated_querysequence,
            case when querystart > queryend then querystart - 3 * (q0 - 1) else querystart + 3 * (q0 - 1) end::int querystart, case when querystart > queryend then querystart - 3 * (q1 - 1) - 2 else querystart + 3 * (q1 - 1) + 2 end::int queryend
          from e join hits using (hit_id)""")
def region_slices(t):
    """The winners' slices with cigar and coordinates on subject and query."""
    rows = slices.region_slices(t("hits"))
    return rows.select("subjectid", "hit_id", *[F.col(c).cast("int").alias(c) for c in ("region_first", "region_last")], "subjectstart", "subjectend", "cigar", "translated_querysequence", "querystart", "queryend")


@query(f"""with {_WON}, z as (select hit_id, least(any_value(l), any_value(f) + sum(case when {_MATCH} or op in ('D', 'N') then n else 0 end) - 1) e from s group by hit_id),
          x as (select hit_id, k + j query_pos, f - 1 + r + case when op = 'I' then 0 else j end pos, op = 'I' inserted, f, e from s join z using (hit_id), generate_series(1, n) g(j) where op = 'I' or {_MATCH})
          select hit_id, query_pos::int query_pos, pos::int pos, inserted from x where pos <= e and f <= e""")
def query_coordinates(t):
    return _whole_numbers(slices.query_coordinates(t("hits")))


@query()
def overlap_order(t):
    """Which of two overlapping neighbours owns the overlap, by the score of the overlap alone and by bitscore."""
    return slices.overlap_order(t("hits"), t("markers"))


@query()
def resolve_by_overlap(t):
    """Regions of the hits that score best on each stretch, and their score there against the references."""
    return _whole_numbers(stitch.regions_by_overlap(t("hits"), t("markers")))


# ---- alignment and search

@query()
def align_global(t):
    """Global alignment of each different pair of aligned query and subject sequences."""
    pairs = t("hits").filter("translated_querysequence is not null and subjectsequence is not null").select("translated_querysequence", "subjectsequence").distinct()
    return pairs.select("*", aligned_pair(F.col("translated_querysequence"), F.col("subjectsequence")).alias("a")).select("translated_querysequence", "subjectsequence", "a.*")


@query()
def score_alignment(t):
    """The best hit of each subject aligned locally: lengths, counts, coverage and identity."""
    best = hits.best_hit_per_subject(t("hits").filter("translated_querysequence is not null and subjectsequence is not null"))
    return scored_pairs(best, "translated_querysequence", "subjectsequence", "subjectid")


@query(f"""with {_TRANSLATE}, d as (select distinct seq_id, frame, array_to_string(list_transform(k, lambda c: case when regexp_full_match(c, '[TCAG]{{3}}')
          then substr('{seq.STANDARD_CODE}', instr('TCAG', c[1]) * 16 + instr('TCAG', c[2]) * 4 + instr('TCAG', c[3]) - 20, 1) else 'X' end), '') s from c),
          q as (select seq_id, frame, i, substr(s, i, 6) w from d, generate_series(1, length(s) - 5) g(i)),
          b as (select subjectid, i, substr(sequencedata, i, 6) w from markers, generate_series(1, length(sequencedata) - 5) g(i))
          select seq_id, frame, subjectid, (b.i - q.i)::int diagonal, count(*) seeds from q join b using (w) where regexp_full_match(w, '[ACDEFGHIKLMNPQRSTVWY]*') group by all""")
def seed_join(t):
    frames = search.translated_frames(t("sequences"), "seq_id", "sequencedata").distinct()
    return search.seed_diagonals(frames, t("markers"))


@query()
def translated_search(t):
    """All versions of all contigs searched against the references: seeds, then local alignment of the best frame."""
    return search.search(t("sequences"), t("markers"))


@query()
def searched_markers(t):
    """Contigs and references in, marker statistics out: the search's hits go through the whole marker job."""
    return plan(search.search(t("sequences"), t("markers")), t("markers")).statistics


@query()
def ortholog_comparison(t):
    """The best contig of each reference aligned with it as a whole."""
    return compare_orthologs(t("sequences"), t("markers"), nucleotides=True).statistics


# ---- k-mers

_HASH = " ".join(f"when '{c}' then {n}" for c, n in cluster.HASH_NUMBERS.items())


_KMERS = f"""s as (select distinct msaindex, upper(sequencedata) s from sequences where msaindex is not null and sequencedata is not null),
k as (select msaindex, s, length(s) n, i, substr(s, i, 14) kmer from s, generate_series(1, length(s) - 13) g(i)),
h as (select msaindex, s, n, i, kmer, list_reduce(list_prepend(0, list_transform(range(14), lambda j: case substr(kmer, (j + 1)::bigint, 1) {_HASH} end)), lambda a, v: xor(((a << 5) | (a >> 11)) & 65535, v)) hash from k where regexp_full_match(kmer, '[ACGTMRWSYKVHDBN-]*')),
lowest as (select * from (select *, row_number() over (partition by msaindex, s order by hash, i) r from h) where r <= 20)"""


@query(f"with {_KMERS} select kmer, n::bigint seqlen, i::bigint kmerpos, msaindex, hash::int hash from lowest")
def kmer_table(t):
    rows = t("sequences").select("msaindex", F.upper("sequencedata").alias("sequencedata")).distinct()
    return cluster.kmer_table(rows, "msaindex", "sequencedata")


_CENTERS = """x as (select kmer, seqlen, msaindex from kmer_index where kmer <> '' and seqlen is not null and msaindex >= 1),
c as (select kmer, msaindex center from (select *, row_number() over (partition by kmer order by seqlen desc, msaindex) r from x) where r = 1),
e as (select distinct center, msaindex member from c join x using (kmer) where center <> msaindex)"""


@query(f"with {_CENTERS} select * from e")
def kmer_centers(t):
    return cluster.kmer_centers(t("kmer_index"))


_GAPFREE = """z as (select msaindex, min(upper(sequencedata)) s from sequences where msaindex is not null and sequencedata is not null group by 1 having min(upper(sequencedata)) <> ''),
p as (select center, member, a.s[:least(length(a.s), length(b.s))] x, b.s[:least(length(a.s), length(b.s))] y, least(length(a.s), length(b.s)) n from e join z a on a.msaindex = center join z b on b.msaindex = member),
d as (select *, unnest(range(-(n // 20), n // 20 + 1)) k from p),
i as (select center, member, n, k, (select count(*) from generate_series(1, n) g(j) where substr(x, j + k, 1) = substr(y, j, 1) and j + k between 1 and n) m from d)"""


@query(f"with {_CENTERS}, {_GAPFREE} select center, member, round(max(m) / n, 6)::double identity from i group by center, member, n having max(m) >= 0.95 * n")
def gapfree_identity(t):
    """Centers and members that agree without gaps in at least 95 % of their letters."""
    pairs = cluster.kmer_centers(t("kmer_index"))
    return cluster.gap_free_matches(pairs, t("sequences"), "msaindex", "sequencedata").withColumn("identity", F.round("identity", 6))


_COVER = """
ranked as (select center, row_number() over (order by count(*) desc, center) k, list(member) m from {pairs} group by center),
walk(k, gone) as (select 0::bigint, []::bigint[] union all
  select ranked.k, case when list_contains(gone, center) then gone else list_distinct(list_concat(gone, m)) end from walk join ranked on ranked.k = walk.k + 1),
acting as (select ranked.* from ranked join walk on walk.k = ranked.k - 1 where not list_contains(gone, center)),
first as (select member, min_by(center, k) removed_by from (select center, k, unnest(m) member from acting) group by member)
select record, removed_by from (select center record from {pairs} union select member from {pairs}) left join first on member = record"""


@query(f"with recursive {_CENTERS}, {_COVER.format(pairs='e')}")
def cluster_cover(t):
    """Greedy cover of the centers and members by k-mers."""
    return cluster.greedy_cover(cluster.kmer_centers(t("kmer_index")))


@query(f"with recursive {_KMERS}, {_CENTERS.replace('from kmer_index', 'from (select kmer, n seqlen, msaindex from lowest)')}, {_GAPFREE}, w as (select center, member from i group by center, member, n having max(m) >= 0.95 * n), {_COVER.format(pairs='w')}")
def cluster_reads(t):
    """The whole clustering of the contigs: k-mers, centers, comparison, cover."""
    return cluster.cluster_reads(t("sequences"), "msaindex", "sequencedata")


# ---- features

_ID = "select distinct id from features where id is not null"
_ATTRIBUTES = """concat_ws(';', 'ID=' || id, 'Name=' || feature_name, 'Alias=' || array_to_string(alias_list, ','), 'Parent=' || array_to_string(parent, ','), 'Target=' || target, 'Gap=' || gap,
          'Derives_from=' || derivesfrom, 'Note=' || note, 'Dbxref=' || array_to_string(dbcrossreference, ','), 'Ontology_term=' || array_to_string(ontologyterm, ','), 'Is_circular=' || iscircular::varchar)"""


@query(f"select feature_no, {_ATTRIBUTES} attributes from features")
def gff_attributes(t):
    rows = t("features")
    return rows.select("feature_no", features.attribute_text(rows).alias("attributes"))


@query(f"""select feature_no, concat_ws(chr(9), coalesce(seqid, '.'), coalesce(source, '.'), coalesce(ftype, '.'), coalesce(start_::varchar, '.'), coalesce(end_::varchar, '.'),
          coalesce(case when isnan(score) then 'NaN' else score::varchar end, '.'), coalesce(strand, '.'), coalesce(phase, '.'), {_ATTRIBUTES}) line from features""")
def gff_lines(t):
    """Records as lines of text, missing fields as '.'."""
    rows = t("features")
    return rows.select("feature_no", features.record_text(rows).alias("line"))


@query("""select feature_no, id is not null and id <> '' has_id, len(parent)::int parents from features""")
def gff_round_trip(t):
    """Attributes written as text and parsed again; text can't tell [] from [''], so parents without any letter are counted in the table."""
    parsed = _parsed(t).select("feature_no", "id", F.col("parent").alias("_parsed")).join(t("features").select("feature_no", "parent"), "feature_no")
    parents = F.when(F.array_join("parent", "") == "", F.size("parent")).otherwise(F.size("_parsed"))
    return parsed.select("feature_no", (F.coalesce("id", F.lit("")) != "").alias("has_id"), parents.alias("parents"))


def _parsed(t) -> DataFrame:
    rows = t("features")
    return features.typed_attributes(rows.select("feature_no", features.attribute_text(rows, encoded=True).alias("attributes"))).drop("attributes")


@query("""select feature_no, id, feature_name, array_to_string(alias_list, '|') alias_list, array_to_string(parent, '|') parent, target, gap, derivesfrom, note,
          array_to_string(dbcrossreference, '|') dbcrossreference, array_to_string(ontologyterm, '|') ontologyterm, iscircular from features""")
def gff_typed(t):
    """Every attribute written as text and parsed again, lists joined by '|'."""
    return _parsed(t).withColumns({c: F.array_join(c, "|") for c in features.LISTS})


@query("select feature_no from features where not coalesce(seqid is not null and start_ >= 1 and start_ <= end_, false)")
def gff_startend(t):
    return features.bad_start_end(t("features")).select("feature_no")


@query("select feature_no from features where ftype = 'CDS' and phase is null")
def gff_cds_phase(t):
    return features.cds_without_phase(t("features")).select("feature_no")


@query(rf"select distinct p parent from (select regexp_replace(x, '^\s+|\s+$', '', 'g') p from (select unnest(string_split(y, ',')) x from (select unnest(parent) y from features))) where p not in ({_ID})")
def gff_orphan_parents(t):
    return features.orphan_parents(t("features"))


@query(rf"select feature_no from features where target is not null and (not regexp_full_match(target, '\S+ \d+ \d+( [+-])?') or split_part(target, ' ', 1) not in ({_ID}))")
def gff_target_format(t):
    return features.bad_targets(t("features")).select("feature_no")


@query(r"select feature_no, target is null no_target, not regexp_full_match(gap, '[DFIMR]\d+( [DFIMR]\d+)*') bad_gap from features where gap is not null and (target is null or not regexp_full_match(gap, '[DFIMR]\d+( [DFIMR]\d+)*'))")
def gff_gap_target(t):
    rows = features.gaps_without_target(t("features")).union(features.bad_gaps(t("features"))).select("feature_no", "target", "gap").distinct()
    return rows.select("feature_no", F.col("target").isNull().alias("no_target"), (~F.col("gap").rlike(features.GAP)).alias("bad_gap"))


@query(f"select feature_no, derivesfrom from features where derivesfrom is not null and derivesfrom not in ({_ID})")
def gff_orphan_derives(t):
    return features.orphan_derives(t("features")).select("feature_no", "derivesfrom")


@query(rf"""select feature_no, 'start_end' problem from features where not coalesce(seqid is not null and start_ >= 1 and start_ <= end_, false)
          union select feature_no, 'cds_phase' from features where ftype = 'CDS' and phase is null
          union select feature_no, 'parent' from (select feature_no, regexp_replace(x, '^\s+|\s+$', '', 'g') p from (select feature_no, unnest(string_split(y, ',')) x from (select feature_no, unnest(parent) y from features))) where p not in ({_ID})
          union select feature_no, 'target' from features where target is not null and (not regexp_full_match(target, '\S+ \d+ \d+( [+-])?') or split_part(target, ' ', 1) not in ({_ID}))
          union select feature_no, 'gap' from features where gap is not null and not regexp_full_match(gap, '[DFIMR]\d+( [DFIMR]\d+)*')
          union select feature_no, 'gap_target' from features where gap is not null and target is null
          union select feature_no, 'derives' from features where derivesfrom is not null and derivesfrom not in ({_ID})""")
def gff_problems(t):
    """All checks of feature records together."""
    return features.problems(t("features"))


# ---- sampling and several runs

@query("select seq_id, loaded_at from (select *, row_number() over (order by seq_id, loaded_at, sequencedata nulls first) r from sequences) where r > 50 and r <= 300")
def subsample_head(t):
    return sampling.head(t("sequences"), ["seq_id", "loaded_at", "sequencedata"], 250, 50).select("seq_id", "loaded_at")


@query("select seq_id, loaded_at from (select *, row_number() over (order by seq_id, loaded_at, sequencedata nulls first) r from sequences) where r in (select hit_id from hits where queryframe = 1)")
def subsample_positions(t):
    wanted = t("hits").filter("queryframe = 1").select(F.col("hit_id").alias("place"))
    return sampling.at_positions(t("sequences"), ["seq_id", "loaded_at", "sequencedata"], wanted).select("seq_id", "loaded_at")


@query("select seq_id from (select distinct seq_id from sequences where seq_id is not null) order by md5('7:' || seq_id), seq_id limit 100")
def subsample_pairs(t):
    return sampling.random_sample(t("sequences").filter("seq_id is not null").select("seq_id").distinct(), "seq_id", 100, 7)


@query("select count(sequencedata) reads, round(avg(length(sequencedata)), 6)::double mean_length, round(sum(length(sequencedata)) / 1000000, 6)::double coverage from sequences")
def coverage_estimate(t):
    return sampling.coverage(t("sequences"), "sequencedata", 1_000_000)


@query("select otu, seq_id, n::int n from (select otu, seq_id, length(sequencedata) n, row_number() over (partition by otu order by length(sequencedata), seq_id, loaded_at) r from sequences where otu is not null and sequencedata is not null) where r = 1")
def smallest_per_species(t):
    rows = t("sequences").filter("otu is not null and sequencedata is not null").withColumn("n", F.length("sequencedata"))
    return hits.first_of(rows, ["otu"], [F.asc("n"), F.asc("seq_id"), F.asc("loaded_at")]).select("otu", "seq_id", "n")


@query("select split_part(subjectid, '@', -1) marker, count(distinct split_part(queryid, '@', 1)) species, count(*) hits from hits where subjectid is not null and queryid is not null group by 1")
def combine_markers(t):
    rows = t("hits").filter("subjectid is not null and queryid is not null")
    return rows.groupBy(ids.sequence_part(F.col("subjectid")).alias("marker")).agg(F.countDistinct(ids.otu_part(F.col("queryid"))).alias("species"), F.count("*").alias("hits"))


# ---- whole jobs

_CHOSEN = """once as (select min(hit_id) hit_id, queryid, translated_querysequence, subjectid, subjectstart, subjectend, cigar, bitscore from hits where isfinite(bitscore) and subjectstart is not null and subjectend is not null
  group by queryid, translated_querysequence, full_querysequence, querystart, queryend, queryframe, subjectid, subjectsequence, subjectstart, subjectend, cigar, percentidentical, bitscore, searched_at),
of_target as (select *, row_number() over (partition by queryid, subjectid order by bitscore desc, hit_id) t from once where queryid is not null and subjectid is not null),
chosen as (select * from (select *, row_number() over (partition by queryid order by bitscore desc, hit_id) u from of_target where t = 1) where u <= 25)"""


@query(f"""with {_CHOSEN}, {_won("chosen")}, {_CELLS},
          k as (select subjectid, n reference_len, count(*) filter (residue <> '-' and upper(residue) = upper(letter)) matches, count(*) filter (residue <> '-' and upper(residue) <> upper(letter)) mismatches from kept group by all)
          select subjectid, reference_len::int reference_len, matches + mismatches query_len, (select count(*) from runs r where r.subjectid = k.subjectid) regions, (select count(*) from chosen h where h.subjectid = k.subjectid) contigs,
          matches, mismatches, reference_len - matches - mismatches deletions, round_even(100.0 * (matches + mismatches) / reference_len, 2)::double query_coverage,
          case when matches + mismatches = 0 then 0 else round_even(100.0 * matches / (matches + mismatches), 2) end::double identity from k""")
def retrieve_markers(t):
    """Statistics of the whole marker job: filter, rank, resolve, mask, trim, stitch, summarise."""
    return plan(t("hits"), t("markers")).statistics


_SPREAD = """spread as (select * replace (case when contains(queryid, '@') then split_part(queryid, '@', 1) else '' end || '|' || subjectid as subjectid), subjectid plain from hits where queryid is not null and subjectid is not null),
own_markers as (select s.subjectid, sequencedata from markers m join (select distinct subjectid, plain from spread) s on plain = m.subjectid)"""


@query(f"""with {_SPREAD}, {_CHOSEN.replace("from hits", "from spread")}, {_won("chosen", "own_markers")}, {_CELLS}
          select subjectid, n::int reference_len, string_agg(residue, '' order by i) aligned, replace(string_agg(residue, '' order by i), '-', '') residues from kept group by subjectid, n""")
def species_markers(t):
    """The whole marker job for the contigs of each species by themselves: stitched sequences."""
    rows = plan(t("hits"), t("markers"), Settings(by_species=True, nucleotides=False)).sequences
    return rows.select("subjectid", "reference_len", "aligned", "residues")


@query("select date_trunc('day', searched_at) as \"day\", count(*) hits, count(*) filter (where isfinite(bitscore)) usable, max(bitscore) filter (where isfinite(bitscore)) best from hits group by 1")
def hits_by_day(t):
    """The streaming aggregation over the whole table as one batch."""
    return by_day(t("hits")).withColumn("day", F.col("day").cast("timestamp_ntz"))
