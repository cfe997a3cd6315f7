from __future__ import annotations

import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from strandloom.functions import identifiers, intervals
from strandloom.operators import cluster, features, hits, sampling, skew, stats, stitch
from strandloom.operators.hierarchy import links
from strandloom.plans.markers import retrieve_markers
from strandloom.session import Workspace, build_session, release, shared_folder, sweep
from strandloom.sources import readers, writers

HITS = (
    "hit_id bigint, queryid string, translated_querysequence string, full_querysequence string, querystart int, queryend int, queryframe int, subjectid string, "
    "subjectsequence string, subjectstart int, subjectend int, cigar string, percentidentical double, bitscore double, searched_at string, loaded_at string"
)


def hit(no, query="q", subject="s", text="MKV", start=1, end=3, cigar="3M", score=50.0):
    return (no, query, text, "ATGAAAGTT", 1, 9, 1, subject, "MKV", start, end, cigar, 90.0, score, "t", str(no))


@pytest.fixture
def some_hits(spark):
    rows = [
        hit(1, text="MKVAA", end=5, cigar="5M"), hit(2, start=4, end=6, score=60.0), hit(3, start=4, end=6, score=60.0), hit(4, text="AC", start=9, end=12, cigar="1M2D1M"),
        hit(5, text="AXC", start=15, end=14, cigar="1M1I1M"), hit(6, subject=None), hit(7, score=float("nan")), hit(8, score=None), hit(9, start=None), hit(10, start=0),
        hit(11, text=None), hit(12, subject="r", text="M", cigar="3M", query=None),
    ]
    return spark.createDataFrame(rows, HITS)


def test_resolve_and_stitch(spark, some_hits):
    markers = spark.createDataFrame([("s", "x", "MKVAAKVWWWWWWWWWA", 17), ("r", "x", None, 4), (None, "x", "M", 1)], "subjectid string, otu string, sequencedata string, reference_len bigint")
    won = stitch.resolve_positions(some_hits)
    regions = {tuple(r) for r in stitch.resolved_regions(won).select("subjectid", "hit_id", "first_pos", "last_pos").collect()}
    assert regions == {("s", 1, 1, 3), ("s", 2, 4, 6), ("s", 4, 9, 12), ("s", 5, 14, 15), ("r", 12, 1, 3)}
    text = {r["subjectid"]: r["aligned"] for r in stitch.stitched(won, markers).collect()}
    assert text == {"s": "MKVMKV--A--C-AC--"}
    gaps = {tuple(r) for r in stitch.bridges(stitch.resolved_regions(won), markers).collect()}
    assert gaps == {("s", 7, 8), ("s", 13, 13), ("s", 16, 17), ("r", 4, 4)}
    row = stitch.marker_statistics(some_hits, won, markers).collect()
    assert len(row) == 1 and row[0]["regions"] == 4 and row[0]["matches"] == 3 and row[0]["deletions"] == 7
    full = retrieve_markers(some_hits, markers)
    assert full.sequences.count() == 1 and full.summary.count() == 9
    assert retrieve_markers(some_hits.limit(0), markers).statistics.count() == 0


def test_ranking_and_dedup(spark, some_hits, few_heavy):
    best = {r["subjectid"]: r["hit_id"] for r in hits.best_hit_per_subject(some_hits).collect()}
    assert best == {"s": 2, "r": 12}
    assert [r["hit_id"] for r in hits.max_target_seqs(some_hits, 1).collect()] == [2]
    assert hits.max_target_seqs(some_hits, 0).count() == 9
    assert {r["hit_id"] for r in hits.top_percent(some_hits, 10).collect()} == {2, 3}
    twice = some_hits.unionByName(some_hits)
    assert hits.distinct_hits(twice).count() == 11  # 2 and 3 are one hit
    records = spark.createDataFrame([("a", "AAC-G"), ("b", "CGTT"), ("c", "AAAA"), ("c", None)], "id string, s string")
    assert sorted(r["id"] for r in hits.dedup_canonical(records, "s", ["id"]).collect()) == ["a", "c"]
    assert hits.dedup_ids(records, "id", ["s"]).count() == 3


def test_targets_are_subjects(spark):
    rows = spark.createDataFrame([hit(i, score=100.0 + i) for i in range(30)] + [hit(30, subject="r", score=50.0), hit(31, subject="t", score=40.0)], HITS)
    assert {r["hit_id"] for r in hits.best_targets(rows, 25, 1).collect()} == {29, 30, 31}
    assert {r["hit_id"] for r in hits.best_targets(rows, 2, 0).collect()} == set(range(31))
    assert {r["hit_id"] for r in hits.best_targets(rows, 1, 2).collect()} == {28, 29}
    assert hits.best_targets(rows, 0, 0).count() == 32
    markers = spark.createDataFrame([(s, "x", "MKV", 3) for s in "srt"], "subjectid string, otu string, sequencedata string, reference_len bigint")
    assert {r["subjectid"] for r in retrieve_markers(rows, markers).sequences.collect()} == {"s", "r", "t"}


def test_limits_switched_off(spark):
    rows = spark.createDataFrame([(*hit(1)[:12], None, *hit(1)[13:]), hit(2, start=None), hit(3, score=float("nan")), hit(4, score=-5.0)], HITS)
    assert {r["hit_id"] for r in hits.filter_hits(rows).collect()} == {1, 2, 4}
    assert {r["hit_id"] for r in hits.filter_hits(rows, identity=1, length=1).collect()} == {4}


def test_repaired_queries(spark):
    # A CCC | ATG (a letter skipped) AAA (two stepped back) AAG TTT | GGG TT; the same backwards; nothing reported
    forward = "A" + "CCC" + "ATG" + "C" + "AAA" + "GTTT" + "GGG" + "TT"
    backward = forward[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cigar = "1M1\\1M2/1M1M1D"
    whole = "A" + "CCC" + "ATG" + "AAA" + "AAG" + "TTT" + "GGG" + "TT"
    base = hit(0)
    rows = [(1, "q", "MK-KF", forward, 5, 15, 2, *base[7:11], cigar, *base[12:]), (2, "q", "MKKF", backward, 16, 6, -2, *base[7:11], cigar, *base[12:]), (3, "q", None, forward, 5, 15, 2, *base[7:11], cigar, *base[12:])]
    found = {r["hit_id"]: tuple(r)[1:] for r in hits.repaired_queries(spark.createDataFrame(rows, HITS)).collect()}
    assert found[1] == found[2] == (whole, 5, 16, 2, "4M1D", "PMKKFG") and found[3] == (*found[1][:-1], None)
    segments = {r["hit_id"]: r["nucleotides"] for r in hits.repaired_hits(spark.createDataFrame(rows, HITS)).collect()}
    assert set(segments.values()) == {whole[4:16]}


def test_clusters(spark, few_heavy):
    reads = spark.createDataFrame([(1, "ACGTACGTACGTACGTAA"), (2, "ACGTACGTACGTACGTAC"), (3, "ACGTACGTACGTACG"), (4, "TTTTTTTTTTTTTTTTTT"), (None, "ACGT"), (6, None), (7, "")], "i bigint, s string")
    table = cluster.kmer_table(reads, "i", "s", m=50)
    assert table.filter("msaindex = 3").count() == 2
    pairs = cluster.kmer_centers(table)
    found = {tuple(r) for r in pairs.collect()}
    assert {(1, 2), (1, 3)} <= found and not any(4 in p for p in found)
    same = {(r[0], r[1]): r[2] for r in cluster.gap_free_matches(pairs, reads, "i", "s", 0.9).collect()}
    assert same[1, 3] == 1.0 and same[1, 2] == pytest.approx(17 / 18)
    assert (1, 2) not in {(r[0], r[1]) for r in cluster.gap_free_matches(pairs, reads, "i", "s").collect()}
    shifted = spark.createDataFrame([(1, "ACGTTGCAAC" * 6), (2, "G" + "ACGTTGCAAC" * 6)], "i bigint, s string")
    one = spark.createDataFrame([(1, 2), (1, 9)], "center bigint, member bigint")
    assert [r[2] for r in cluster.gap_free_matches(one, shifted, "i", "s").collect()] == [pytest.approx(59 / 60)]
    assert {tuple(r) for r in cluster.cluster_reads(reads, "i", "s", least=0.9).collect()} >= {(1, None), (3, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_cover(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(9), rng.randrange(14)) for _ in range(25)}
    members: dict[int, set[int]] = {}
    for c, m in pairs:
        if c != m:
            members.setdefault(c, set()).add(m)
    removed: dict[int, int] = {}
    for c in sorted(members, key=lambda c: (-len(members[c]), c)):
        if c not in removed:
            for m in members[c]:
                removed.setdefault(m, c)
    expected = {x: removed.get(x) for c in members for x in {c, *members[c]}}
    assert dict(map(tuple, cluster.greedy_cover(spark.createDataFrame(sorted(pairs), "center bigint, member bigint")).collect())) == expected


def test_sampling(spark):
    rows = spark.createDataFrame([(i, f"r{i:03}") for i in range(50)], "i int, id string").repartition(7)
    assert sorted(r["i"] for r in sampling.head(rows, ["id"], 5, 10).collect()) == list(range(10, 15))
    places = spark.createDataFrame([(1,), (50,), (99,)], "place int")
    assert sorted(r["i"] for r in sampling.at_positions(rows, ["id"], places).collect()) == [0, 49]
    assert sampling.random_sample(rows, "id", 7, 3).count() == 7
    assert sampling.fraction_count(1000, 0.123) == 200 and sampling.fraction_count(10, 0) == 0


def test_stats(spark):
    rows = spark.createDataFrame([(1.0,), (20.99,), (21.0,), (100.0,), (None,)], "x double")
    assert [(r["class_no"], r["n"]) for r in stats.histogram(rows, "x", stats.COVERAGE_CLASSES).orderBy("class_no").collect()] == [(0, 1), (1, 2), (2, 1), (3, 0), (4, 0), (5, 1)]
    assert stats.describe(rows, ["x"]).collect()[0]["median"] == pytest.approx(20.995)


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x@1 long\nAC\nGT\n>y>z\n\n>w\nT\n")
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\n@@II\n@r2 x\nAC\n+r2\nII\n")
    a, b = str(tmp_path / "a.fa"), str(tmp_path / "b.fq")
    assert sorted((r["id"], r["sequencedata"]) for r in readers.read_sequences(spark, a).collect()) == [("w", "T"), ("x@1 long", "ACGT"), ("y>z", "")]
    assert sorted((r["id"], r["sequencedata"]) for r in readers.read_sequences(spark, b).collect()) == [("r1", "ACGT"), ("r2 x", "AC")]
    with pytest.raises(ValueError):
        readers.read_sequences(spark, a, b)
    records = spark.createDataFrame([("o@m1", "ACGTA", "m1"), ("plain", "AC", "m2")], "id string, s string, marker string")
    writers.write_fasta(records, str(tmp_path / "out"), "id", "s", by="marker", wrap=4)
    back = readers.read_fasta(spark, str(tmp_path / "out" / "marker=m1"), str(tmp_path / "out" / "marker=m2"))
    assert sorted((r["id"], r["sequencedata"]) for r in back.collect()) == [("o", "ACGTA"), ("plain", "AC")]
    (tmp_path / "f.gff").write_text("##gff-version 3\nc1\tx\tgene\t1\t9\t.\t+\t.\tID=g1;Parent=a,b\nshort line\n")
    rows = readers.read_features(spark, str(tmp_path / "f.gff")).collect()
    assert len(rows) == 1 and rows[0]["score"] is None and rows[0]["end_"] == 9


def test_streaming(spark, tmp_path, some_hits):
    from strandloom.streaming.hits import distinct_stream

    rows = some_hits.drop("searched_at").selectExpr("*", "timestamp'2024-01-01' as searched_at").unionByName(some_hits.drop("searched_at").selectExpr("*", "timestamp'2024-01-01' as searched_at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = distinct_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("distinct_hits_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("distinct_hits_stream").count() == some_hits.select("queryid", "subjectid", "subjectstart", "subjectend", "cigar").distinct().count()


def test_features_from_text(spark, tmp_path):
    text = "\t".join(["c1", "x", "CDS", "5", "2", ".", "+", ".", "ID=a%3Bb;Parent=p1,p%2C2;Parent=p3;Note=one,two;Is_circular=true;odd;Alias="])
    (tmp_path / "f.gff").write_text(f"##gff-version 3\n{text}\nc1\tx\tgene\t1\t9\t0.5\t+\t.\tID=p1;Target=p1 1 9 +;Gap=M9;Dbxref=a+b,%zz\r\nc1\tx\tgene\t1\t9\t.\t+\t.\t.\n")
    rows = {r["id"]: r for r in readers.read_features(spark, str(tmp_path / "f.gff")).collect()}
    a, p, none = rows["a;b"], rows["p1"], rows[None]
    assert a["parent"] == ["p1", "p,2", "p3"] and a["note"] == "one,two" and a["iscircular"] is True and a["alias_list"] == [] and a["target"] is None
    assert p["dbcrossreference"] == ["a+b", "%zz"] and p["gap"] == "M9" and p["score"] == 0.5 and none["parent"] is None
    table = readers.read_features(spark, str(tmp_path / "f.gff")).selectExpr("row_number() over (order by coalesce(id, '')) as feature_no", "*")
    found = {(r["feature_no"], r["problem"]) for r in features.problems(table).collect()}
    assert found == {(2, "start_end"), (2, "cds_phase"), (2, "parent")}
    nodes, between = links(table)
    assert {(r["parent"], r["id"]) for r in between.collect()} == {("p1", "a;b")}
    again = features.typed_attributes(table.select("feature_no", features.attribute_text(table, encoded=True).alias("attributes")))
    assert {r["id"]: r["parent"] for r in again.collect()} == {"a;b": ["p1", "p,2", "p3"], "p1": None, None: None}
    assert features.problems(table.limit(0)).count() == 0


def test_random_sample(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) key", "1 as place", "'x' as _part").repartition(6)
    order = sorted(range(3000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    for n in (0, 1, 40, 2500, 9000):
        assert {r["key"] for r in sampling.random_sample(rows.select("key"), "key", n, 7).collect()} == {str(i) for i in order[:n]}
    assert sampling.random_sample(rows.limit(0).select("key"), "key", 5).count() == 0


def test_paths_and_chunks(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n\n  >x\nAC\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wb") as f:
        f.write(b"@x\nAC\n+\nII\n")
    (tmp_path / "c.txt").write_text("nothing")
    (tmp_path / "empty.fa").write_text("")
    a, b, c, e = (f"file://{tmp_path}/{n}" for n in ("a.fa", "b.fastq.gz", "c.txt", "empty.fa"))
    assert readers.sniff(spark, a) == "FASTA" and readers.sniff(spark, b) == "FASTQ" and readers.is_gzip(spark, b) and not readers.is_gzip(spark, e)
    for bad in (c, e):
        with pytest.raises(ValueError):
            readers.sniff(spark, bad)
    assert [p.rpartition("/")[2] for p in readers.sequence_files(spark, str(tmp_path))] == ["a.fa", "empty.fa"]
    assert readers.missing_files(spark, a, a + "x") == [a + "x"]
    assert readers.read_sequences(spark, b).collect()[0]["sequencedata"] == "AC"
    records = spark.createDataFrame([(f"o@{i}", "ACGT") for i in range(25)], "id string, sequencedata string").coalesce(1)
    writers.write_chunks(records, str(tmp_path / "chunks"), "id", "sequencedata", per_file=10)
    assert len(list((tmp_path / "chunks").glob("*.txt"))) == 3
    assert tuple(readers.count_records(readers.read_fasta(spark, str(tmp_path / "chunks"))).first()) == (25, 100)
    assert build_session().sparkContext is spark.sparkContext


def test_more_of_hits(spark, few_heavy, some_hits):
    markers = spark.createDataFrame([("s", 12), ("r", None), (None, 3)], "subjectid string, reference_len bigint")
    assert {r["hit_id"] for r in hits.filter_hits(some_hits, subject_cover=30, markers=markers).collect()} == {1, 4, 10}
    rows = spark.createDataFrame([("a@1", "s"), ("a@2", "s"), ("a@1", "t"), ("b@1", "t"), (None, "u"), ("c@1", None)], "queryid string, subjectid string")
    assert [tuple(r) for r in hits.same_otu_subjects(rows).collect()] == [("s", "a")]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["x"] * 40 + ["y", "z", None])], "k string, i int")
    right = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "k string, j int")
    joined = [tuple(r) for r in skew.salted_join(left, right, "k", ["x"]).collect()]
    assert sorted(joined) == sorted([("x", i, j) for i in range(40) for j in (1, 2)] + [("y", 40, 3)])


def test_identifier_and_place(spark):
    df = spark.createDataFrame([("o", "p", 3), (None, "p", 9), ("", "p", 1)], "o string, p string, n int")
    got = [tuple(r) for r in df.select(identifiers.compose(F.col("o"), F.col("p")).alias("i"), intervals.subject_to_full(F.col("n"), F.lit(5), F.lit(10)).alias("x")).collect()]
    assert got == [("o@p", 7), ("p", None), ("p", 5)]


def test_durable_tables_go(spark):
    ws = Workspace(spark, "first")
    ws.save(spark.range(3))
    old, own = ws.root, Workspace(spark, "second")
    own.save(spark.range(2))
    from strandloom import session

    session._ROOTS.discard(old)  # as if another process had left it
    assert sweep(spark, hours=1) == []
    assert [p.rpartition("/")[2] for p in sweep(spark, hours=-1)] == [old.rpartition("/")[2]]
    assert own.together(*[t for t, _ in own._saved.values()]).count() == 2
    release(spark)
    assert not Path(own.root.removeprefix("file://")).exists() and shared_folder(spark)
