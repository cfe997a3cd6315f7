"""Feature records (GFF3): text form and checks. Checks give the offending records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import links

#: Attribute names and the columns that hold them.
ATTRIBUTES = (
    ("ID", "id"), ("Name", "feature_name"), ("Alias", "alias_list"), ("Parent", "parent"), ("Target", "target"), ("Gap", "gap"),
    ("Derives_from", "derivesfrom"), ("Note", "note"), ("Dbxref", "dbcrossreference"), ("Ontology_term", "ontologyterm"), ("Is_circular", "iscircular"),
)
LISTS = ("alias_list", "parent", "dbcrossreference", "ontologyterm")
TARGET = r"^\S+ \d+ \d+( [+-])?$"
GAP = r"^[DFIMR]\d+( [DFIMR]\d+)*$"


def attribute_text(records: DataFrame, encoded: bool = False) -> Column:
    """The attributes as ``key=value`` parts joined by ';', lists joined by ','; missing ones are left out.

    ``encoded`` writes signs that have a meaning of their own as ``%XX``, so that the text can be parsed again.
    """
    parts = []
    for name, column in ATTRIBUTES:
        shown = (lambda c: _encoded(c)) if encoded else (lambda c: c)
        value = F.array_join(F.transform(column, shown) if encoded else F.col(column), ",") if column in LISTS else shown(F.col(column).cast("string"))
        parts.append(F.concat(F.lit(f"{name}="), value))
    return F.concat_ws(";", *parts)


def _encoded(value: Column) -> Column:
    for sign in "%;=&,\t\n\r":
        value = F.replace(value, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return value


def _decoded(value: Column) -> Column:
    """%XX as the signs they stand for; text that can't be read so stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def record_text(records: DataFrame) -> Column:
    """The nine columns of a record joined by tabs; missing ones are written as '.'."""
    names = ("seqid", "source", "ftype", "start_", "end_", "score", "strand", "phase")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in names]
    return F.concat_ws("\t", *shown, attribute_text(records))


def parse_attributes(text: Column) -> Column:
    """Attribute text as a map from key to list of values, ``%XX`` decoded; values of a repeated key follow one another.

    An empty value is an empty list; parts without '=' are left out; null gives null.
    """
    pairs = F.transform(F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    listed = lambda v: F.when(v == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(v, ","), _decoded))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: listed(p["v"]))))
    return F.map_from_arrays(F.transform(keys, _decoded), values)


def typed_attributes(records: DataFrame, text: str = "attributes") -> DataFrame:
    """The known attributes of a text column as columns: lists for aliases, parents and references, text or boolean otherwise.

    Several values of an attribute that takes one are joined by ','. Missing attributes are null.
    """
    rows = records.withColumn("_m", parse_attributes(F.col(text)))
    shown = []
    for name, column in ATTRIBUTES:
        values = F.try_element_at("_m", F.lit(name))
        single = F.array_join(values, ",")
        shown.append((values if column in LISTS else single.try_cast("boolean") if column == "iscircular" else single).alias(column))
    return rows.select(*records.columns, *shown)


def filled(records: DataFrame) -> DataFrame:
    """Records with at least one of the nine columns."""
    return records.filter(F.coalesce("seqid", "source", "ftype", F.col("start_").cast("string"), F.col("end_").cast("string"), "id").isNotNull())


def bad_start_end(records: DataFrame) -> DataFrame:
    """Records without a seqid or a start or end, with a start below 1, or with the end before the start."""
    good = F.col("seqid").isNotNull() & (F.col("start_") >= 1) & (F.col("start_") <= F.col("end_"))
    return records.filter(~F.coalesce(good, F.lit(False)))


def cds_without_phase(records: DataFrame) -> DataFrame:
    return records.filter((F.col("ftype") == "CDS") & F.col("phase").isNull())


def orphan_parents(records: DataFrame) -> DataFrame:
    """Parents that are no record's id, each once: parent."""
    nodes, _ = links(records)
    named = records.select(F.explode("parent").alias("_p")).select(F.explode(F.split("_p", ",")).alias("_p"))
    named = named.select(F.regexp_replace("_p", r"^\s+|\s+$", "").alias("parent")).distinct()
    return named.join(nodes, F.col("parent") == F.col("id"), "left_anti")


def bad_targets(records: DataFrame) -> DataFrame:
    """Records whose target is not written as ``id start end [strand]`` or names no record."""
    nodes = records.filter("id is not null").select(F.col("id").alias("_id")).distinct()
    shown = records.filter(F.col("target").isNotNull()).withColumn("_t", F.when(F.col("target").rlike(TARGET), F.substring_index("target", " ", 1)))
    return shown.join(nodes, F.col("_t") == F.col("_id"), "left_anti").drop("_t")


def gaps_without_target(records: DataFrame) -> DataFrame:
    return records.filter(F.col("gap").isNotNull() & F.col("target").isNull())


def bad_gaps(records: DataFrame) -> DataFrame:
    return records.filter(F.col("gap").isNotNull() & ~F.col("gap").rlike(GAP))


def orphan_derives(records: DataFrame) -> DataFrame:
    """Records derived from an id that no record has."""
    nodes = records.filter("id is not null").select(F.col("id").alias("_id")).distinct()
    return records.filter("derivesfrom is not null").join(nodes, F.col("derivesfrom") == F.col("_id"), "left_anti")


def problems(records: DataFrame, number: str = "feature_no") -> DataFrame:
    """Everything that is wrong with feature records: the record's number and problem, a row for each.

    Problems: start_end, cds_phase, parent (a parent that is no record), target, gap, gap_target (a gap without a
    target) and derives (from an id that no record has).
    """
    named = records.select(number, F.explode("parent").alias("_p")).select(number, F.explode(F.split("_p", ",")).alias("_p"))
    named = named.select(number, F.regexp_replace("_p", r"^\s+|\s+$", "").alias("parent"))
    lost = named.join(orphan_parents(records), "parent", "left_semi")
    found = {
        "start_end": bad_start_end(records), "cds_phase": cds_without_phase(records), "parent": lost, "target": bad_targets(records), "gap": bad_gaps(records),
        "gap_target": gaps_without_target(records), "derives": orphan_derives(records),
    }
    one = None
    for problem, rows in found.items():
        rows = rows.select(number, F.lit(problem).alias("problem")).distinct()
        one = rows if one is None else one.unionByName(rows)
    return one
