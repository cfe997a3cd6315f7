"""Queries of the general problems: covered periods and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import hierarchy_descendants, hierarchy_paths, links
from ..operators.periods import covered_periods, periods_and_gaps


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = periods_and_gaps(_table(spark, folder, "hits"), "subjectid", "subjectstart", "subjectend")
    return found.select("subjectid", "kind", F.col("first_pos").cast("int").alias("first_pos"), F.col("last_pos").cast("int").alias("last_pos"))


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Covered positions, periods and the part of the covered stretch that is gap, for each subject."""
    periods = covered_periods(_table(spark, folder, "hits"), "subjectid", "subjectstart", "subjectend")
    return periods.groupBy("subjectid").agg(
        F.count("*").alias("periods"),
        F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("covered"),
        (F.max("last_pos") - F.min("first_pos") + 1).alias("stretch"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes, between = links(_table(spark, folder, "features"))
    return hierarchy_paths(nodes, between)


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    nodes, between = links(_table(spark, folder, "features"))
    return hierarchy_descendants(nodes, between)


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_descendants)}

_PERIODS = """
u as (select subjectid, least(subjectstart, subjectend)::bigint lo, greatest(subjectstart, subjectend)::bigint hi
      from hits where subjectid is not null and subjectstart >= 1 and subjectend >= 1),
m as (select *, max(hi) over (partition by subjectid order by lo, hi rows between unbounded preceding and 1 preceding) before from u),
g as (select *, sum(case when before >= lo - 1 then 0 else 1 end) over (partition by subjectid order by lo, hi rows unbounded preceding) run from m),
p as (select subjectid, min(lo) first_pos, max(hi) last_pos from g group by subjectid, run)
"""
_LINKS = r"""
n as (select distinct id from features where id is not null),
e as (select distinct regexp_replace(x, '^\s+|\s+$', '', 'g') parent, id
      from (select id, unnest(string_split(p, ',')) x from (select id, unnest(parent) p from features where id is not null))),
l as (select * from e where parent in (select id from n)),
r(a, d) as (select parent, id from l union select r.a, l.id from r join l on l.parent = r.d)
"""
SQL = {
    "p1_found": f"""with {_PERIODS}
        select subjectid, 'period' kind, first_pos::int first_pos, last_pos::int last_pos from p
        union all select subjectid, 'gap', (last_pos + 1)::int, (nxt - 1)::int
        from (select *, lead(first_pos) over (partition by subjectid order by first_pos) nxt from p) where nxt is not null""",
    "p1_coverage": f"""with {_PERIODS}
        select subjectid, count(*) periods, sum(last_pos - first_pos + 1)::bigint covered, max(last_pos) - min(first_pos) + 1 stretch
        from p group by subjectid""",
    "p2_found": f"""with recursive {_LINKS},
        c as (select distinct a id from r where a = d),
        b as (select distinct d id from r where a in (select id from c) and d not in (select id from c)),
        w(id, root, depth, path) as (
            select id, id, 0, id from n where id not in (select id from l) union all
            select l.id, w.root, w.depth + 1, w.path || '/' || l.id from w join l on l.parent = w.id
            where l.id not in (select id from c) and l.id not in (select id from b))
        select id, '' root, -1 as depth, '' path from c union all select id, '', -2, '' from b union all select * from w""",
    "p2_descendants": f"with recursive {_LINKS} select a id, d descendant from r",
}
