"""Queries of the training-data problems and the SQL they are compared with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .consolidate import kmer_groups
from .mixing import Target, fingerprint, mix_shares, mix_sources
from .packing import container_bound, pack_items
from .personal import find_personal, mask_personal
from .shared_spans import record_letters, shared_amounts, shared_spans
from .tokens import token_counts
from .top_items import top_items

SHARED_LENGTH = 64
BEST = 5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return record_letters(
        (_table(spark, folder, "sequences"), "seq_id", "sequencedata"), (_table(spark, folder, "hits"), "queryid", "full_querysequence")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(_records(spark, folder), SHARED_LENGTH)


def p3_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return shared_amounts(_records(spark, folder), SHARED_LENGTH)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items(_table(spark, folder, "hits"), "queryid", "subjectid", "bitscore", BEST).select("queryid", "subjectid")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return kmer_groups(_table(spark, folder, "kmer_index"))


def p5_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups have how many records."""
    sizes = kmer_groups(_table(spark, folder, "kmer_index")).groupBy("group_msaindex").agg(F.count("*").alias("records"))
    return sizes.groupBy("records").agg(F.count("*").alias("groups"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in _table(spark, folder, "pack_sizes").collect()}  # a fixed few rows
    sizes = token_counts(_table(spark, folder, "documents"), "text", ["doc_id"])
    return pack_items(sizes, "doc_id", "tokens", capacities)


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every text with its container and the container's unused room."""
    return _packed(spark, folder)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: containers, the bound that no packing can go below, and unused tokens."""
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in _table(spark, folder, "pack_sizes").collect()}
    pieces = _packed(spark, folder)
    boxes = pieces.groupBy("pack_id", "container_id").agg(F.first("unused_tokens").alias("unused"))
    made = boxes.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("unused").alias("unused_tokens"))
    # at most one row for each size up to the capacity
    sizes = pieces.groupBy("pack_id", "piece_tokens").agg(F.count("*").alias("n"))

    def bound(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at_least = container_bound(pdf["piece_tokens"].to_numpy(), capacities[keys[0]], pdf["n"].to_numpy())
        return pd.DataFrame({"pack_id": [keys[0]], "at_least": [at_least]})

    return made.join(sizes.groupBy("pack_id").applyInPandas(bound, "pack_id int, at_least bigint"), "pack_id")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, folder, "mix_targets")
    wanted = {r["source"].strip().lower(): Target(r["target_share"], r["max_repeats"]) for r in targets.collect()}  # a row for each source
    documents = _table(spark, folder, "documents").withColumn("print", fingerprint("text"))
    sizes = token_counts(documents, "text", ["doc_id", "source", "print"])
    return mix_sources(sizes, wanted, "doc_id", "print", "source", "tokens"), targets


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen texts of each source with their tokens and repeats."""
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's target and actual share of all tokens."""
    return mix_shares(*_mixed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(_table(spark, folder, "documents"), _table(spark, folder, "name_parts"))


def p8_masked(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with typed placeholders in place of personal items."""
    return mask_personal(_table(spark, folder, "documents"), _table(spark, folder, "name_parts"))


QUERIES = {f.__name__: f for f in (p3_found, p3_amounts, p4_found, p5_found, p5_group_sizes, p6_pieces, p6_fill, p7_mix, p7_shares, p8_found, p8_masked)}

_SPANS = """
v as (select distinct seq_id id, upper(replace(sequencedata, '-', '')) s from sequences where seq_id is not null and sequencedata is not null
      union select distinct queryid, upper(replace(full_querysequence, '-', '')) from hits where queryid is not null and full_querysequence is not null),
w as (select id, i, substr(s, i, 64) k from v, generate_series(1, length(s) - 63) t(i)),
k as (select k from w where regexp_full_match(k, '[ACGT]{64}') group by k having count(distinct id) > 1),
h as (select distinct id, i from w where k in (from k)),
m as (select *, lag(i) over (partition by id order by i) before from h),
g as (select *, sum(case when i <= before + 64 then 0 else 1 end) over (partition by id order by i) run from m),
spans as (select id record_id, min(i)::int span_start, (max(i) + 63)::int span_end from g group by id, run)
"""
_GROUPS = """
x as (select distinct upper(kmer) kmer, msaindex from kmer_index where msaindex >= 1 and regexp_full_match(kmer, '[ACGTacgt]+')),
e as (select distinct a.msaindex a, b.msaindex b from x a join x b using (kmer) where a.msaindex <> b.msaindex),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
g as (select least(min(b), a) group_msaindex, a msaindex from r group by a)
"""
SQL = {
    "p3_found": f"with {_SPANS} select * from spans",
    "p3_amounts": f"""with {_SPANS}, z as (select id, max(length(s)) letters from v group by id),
        t as (select record_id id, sum(span_end - span_start + 1)::bigint shared_letters from spans group by record_id)
        select z.id record_id, z.letters::bigint letters, coalesce(shared_letters, 0)::bigint shared_letters,
               round(case when letters > 0 then coalesce(shared_letters, 0) / letters else 0 end, 6)::double shared_part
        from z left join t using (id)""",
    "p4_found": """select queryid, subjectid from (
          select queryid, subjectid, row_number() over (partition by queryid order by s desc, encode(subjectid)) r
          from (select queryid, subjectid, max(bitscore) s from hits
                where queryid is not null and subjectid is not null and isfinite(bitscore) group by all)) where r <= 5""",
    "p5_found": f"with recursive {_GROUPS} select * from g",
    "p5_group_sizes": f"""with recursive {_GROUPS}, s as (select count(*) records from g group by group_msaindex)
        select records, count(*) groups from s group by records""",
}
