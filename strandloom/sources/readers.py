"""Reading sequence, hit, matrix and feature files into DataFrames. Compressed files are told by their suffix (.gz)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import otu_part
from ..functions.sequences import ungapped
from ..operators.features import typed_attributes

FASTA_EXTENSIONS = ("fa", "fas", "fasta", "faa", "fna")
FASTQ_EXTENSIONS = ("fq", "fastq")
HITS = (
    "queryid string, querysequence string, full_querysequence string, translated_querysequence string, querystart int, queryend int, queryframe int, "
    "subjectid string, subjectsequence string, subjectstart int, subjectend int, cigar string, percentidentical double, bitscore double"
)
FEATURES = "seqid string, source string, ftype string, start_ bigint, end_ bigint, score double, strand string, phase string, attributes string"


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """FASTA records: file, id (the whole header), sequencedata (lines joined). Records without a header are left out."""
    chunks = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("v"))
    head = F.regexp_replace(F.substring_index("v", "\n", 1), "^>", "")
    body = F.when(F.contains("v", F.lit("\n")), F.regexp_replace(F.substr("v", F.instr("v", "\n") + 1), r"\s", "")).otherwise("")
    return chunks.filter(F.trim("v") != "").select("file", F.trim(head).alias("id"), body.alias("sequencedata"))


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """FASTQ records of four lines each: file, id, sequencedata; qualities are not kept.

    Headers are told from quality lines, which may begin with '@' too, by the '+' line two lines below.
    """
    chunks = spark.read.option("lineSep", "\n@").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("p"))
    whole = chunks.filter((F.size("p") >= 3) & F.startswith(F.get("p", F.lit(2)), F.lit("+")))
    return whole.select("file", F.regexp_replace(F.get("p", F.lit(0)), "^@", "").alias("id"), F.get("p", F.lit(1)).alias("sequencedata"))


def read_sequences(spark: SparkSession, *paths: str) -> DataFrame:
    """FASTA or FASTQ, told by content: file, id, sequencedata. ValueError if the files are not all of one kind."""
    kinds = {sniff(spark, p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("files must be all FASTA or all FASTQ")
    return (read_fasta if kinds == {"FASTA"} else read_fastq)(spark, *paths).select("file", "id", "sequencedata")


def read_contigs(spark: SparkSession, *paths: str) -> DataFrame:
    """Sequences as contigs for a search: seq_id (the header up to its first blank), otu, sequencedata."""
    first = F.substring_index("id", " ", 1)
    return read_sequences(spark, *paths).select(first.alias("seq_id"), otu_part(first).alias("otu"), "sequencedata")


def read_references(spark: SparkSession, *paths: str) -> DataFrame:
    """Sequences as references: subjectid (the header up to its first blank), otu, sequencedata without gaps, reference_len."""
    first, plain = F.substring_index("id", " ", 1), ungapped(F.col("sequencedata"))
    return read_sequences(spark, *paths).select(first.alias("subjectid"), otu_part(first).alias("otu"), plain.alias("sequencedata"), F.length(plain).cast("bigint").alias("reference_len"))


def _files(spark: SparkSession, path: str):
    """The file system that a path belongs to (local, HDFS, object store) and the path in its form."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def _begin(spark: SparkSession, path: str, size: int, unzip: bool = False) -> bytes:
    """The first bytes of a file."""
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        source = spark.sparkContext._jvm.java.util.zip.GZIPInputStream(stream) if unzip else stream
        found = bytearray()
        while len(found) < size and (b := source.read()) >= 0:
            found.append(b)
        return bytes(found)
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> str:
    """FASTA or FASTQ by the first sign of a file that is no blank; ValueError for anything else."""
    zipped = is_gzip(spark, path)
    size = 1
    while len(text := _begin(spark, path, size, zipped)) == size and not text.strip():
        size *= 8
    kinds = {b">": "FASTA", b"@": "FASTQ"}
    if (first := text.strip()[:1]) not in kinds:
        raise ValueError(f"{path} is neither FASTA nor FASTQ")
    return kinds[first]


def is_gzip(spark: SparkSession, path: str) -> bool:
    return _begin(spark, path, 2) == b"\x1f\x8b"


def sequence_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = FASTA_EXTENSIONS) -> list[str]:
    """Paths of files in a folder with one of the extensions (also compressed), sorted."""
    files, place = _files(spark, folder)
    found = [f.getPath() for f in files.listStatus(place) if f.isFile()]
    return sorted(p.toString() for p in found if p.getName().removesuffix(".gz").rpartition(".")[2] in extensions)


def missing_files(spark: SparkSession, *paths: str) -> list[str]:
    return [p for p in paths if not (at := _files(spark, p))[0].exists(at[1])]


def pooled(*tables: DataFrame) -> DataFrame:
    """All records of several tables in one."""
    one = tables[0]
    for t in tables[1:]:
        one = one.unionByName(t, allowMissingColumns=True)
    return one


def read_hits(spark: SparkSession, *paths: str, header: bool = False) -> DataFrame:
    """Tabular hits, each once, with a hit_id that is a hash of all their fields."""
    rows = spark.read.schema(HITS).csv(list(paths), sep="\t", header=header, quote="").distinct()
    return rows.select(F.xxhash64(*rows.columns).alias("hit_id"), "*")


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Feature records (GFF3) with '.' as null; comments and lines of other forms are left out.

    Columns of the record, the attributes as text, and a column for each known attribute (see
    :func:`strandloom.operators.features.typed_attributes`).
    """
    rows = spark.read.text(list(paths)).filter(~F.startswith("value", F.lit("#"))).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("p")).filter(F.size("p") == 9)
    shown = [F.when(F.get("p", F.lit(i)) != ".", F.get("p", F.lit(i))) for i in range(9)]
    names = [c.split(" ") for c in FEATURES.split(", ")]
    return typed_attributes(rows.select(*[c.try_cast(kind).alias(name) for c, (name, kind) in zip(shown, names, strict=True)]))


def count_records(records: DataFrame) -> DataFrame:
    """records and residues of a table of sequences."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("sequencedata")), F.lit(0)).alias("residues"))
