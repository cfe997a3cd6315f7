from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from strandloom.functions import cigar, identifiers, sequences
from strandloom.functions.alignment import _lookup, align_batch, blosum62, gap_costs, read_matrix
from strandloom.functions.intervals import Interval


def values(spark, column, rows, schema="s string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_identifiers(spark):
    rows = ["Drosophila_melanogaster@16S", "plain", "a@b@c", "", None]
    s = F.col("s")
    assert values(spark, identifiers.otu_part(s), rows) == ["Drosophila_melanogaster", "", "a", "", None]
    assert values(spark, identifiers.sequence_part(s), rows) == ["16S", "plain", "c", "", None]
    assert values(spark, identifiers.record_header(s), rows) == ["Drosophila_melanogaster", "plain", "a", "", None]
    assert values(spark, identifiers.fasta_header(s), ["@read 1/2"]) == [">read_1/2"]


def test_runs(spark):
    rows = ["---REPIGKFHIQ--", "---REPIGKFHIQ----FHIIGKPR-----", "NILLCTL-----YKCCGC--TEVECLGKCC", "---REP--KFHIQK-", "", "---", None]
    found = values(spark, sequences.nongap_runs(F.col("s")), rows)
    assert [None if f is None else [tuple(x) for x in f] for f in found] == [[(4, 13)], [(4, 13), (18, 25)], [(1, 7), (13, 18), (21, 30)], [(4, 6), (9, 14)], [], [], None]


def test_sequences(spark):
    assert values(spark, sequences.reverse_complement(F.col("s")), ["ACGTN-", "acgR", "", None]) == ["-NACGT", "Ycgt", "", None]
    assert values(spark, sequences.translated(F.col("s"), 1), ["ATGTAAN-", "AU-GGG", "AT", None]) == ["M*", "MG"[:1], "", None]
    assert values(spark, sequences.translated(F.col("s"), -2), ["ATGTAAC"]) == ["YM"[:0] + "LH"]
    assert values(spark, sequences.missing_fraction(F.col("s")), ["A--A", ""]) == [0.5, 0.0]
    assert values(spark, sequences.canonical(F.col("s")), ["aac-g", "CGTT"]) == ["AACG", "AACG"]


def test_cigar(spark):
    rows = ["24M1\\6M", "10M2D5M1I3=", "", None]
    assert values(spark, cigar.cleaned(F.col("s")), rows) == ["24M6M", "10M2D5M1I3=", "", None]
    assert values(spark, cigar.aligned(F.col("s")), rows)[:3] == [30, 18, 0]
    assert values(spark, cigar.occupancy(F.col("s")), rows)[:3] == [1.0, 0.9, 0.0]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 8, 5, 13), (5, 13, 1, 8), (1, 3, 5, 9)], "a int, b int, c int, d int")
    x, y = Interval(F.col("a"), F.col("b")), Interval(F.col("c"), F.col("d"))
    o, e, f, h = x.overlap(y), x.before_overlap(y), x.after_overlap(y), x.hull(y)
    rows = df.filter(x.overlaps(y)).select(o.first, o.last, e.first, e.last, f.first, f.last, h.first, h.last).collect()
    assert [tuple(r) for r in rows] == [(5, 8, 1, 4, 9, 13, 1, 13)] * 2


def test_alignment_scores():
    table = _lookup(blosum62())
    rng = random.Random(2)
    acids = "ACDEFGHIKLMNPQRSTVWY"
    a = ["".join(rng.choices(acids, k=rng.randint(0, 12))) for _ in range(40)]
    b = [x[:3] + x[5:] + "W" if rng.random() < 0.5 else "".join(rng.choices(acids, k=rng.randint(0, 12))) for x in a]

    def brute(x, y, local):
        low, m, n, best = -(10**9), len(x), len(y), 0
        h = [[0] * (n + 1) for _ in range(m + 1)]
        e, f = [[low] * (n + 1) for _ in h], [[low] * (n + 1) for _ in h]
        for i in range(m + 1):
            for j in range(n + 1):
                if i or j:
                    e[i][j] = max(h[i - 1][j] - 12, e[i - 1][j] - 1) if i else low
                    f[i][j] = max(h[i][j - 1] - 12, f[i][j - 1] - 1) if j else low
                    d = h[i - 1][j - 1] + int(table[ord(x[i - 1]), ord(y[j - 1])]) if i and j else low
                    h[i][j] = max(d, e[i][j], f[i][j], 0 if local else low)
                    best = max(best, h[i][j])
        return best if local else h[m][n]

    for local in (False, True):
        found = align_batch(a, b, table, local, 11, 1)
        assert found[:, 0].tolist() == [brute(x, y, local) for x, y in zip(a, b, strict=True)]
        if not local:
            assert all(r[1] + r[2] + r[3] == len(x) and r[1] + r[2] + r[4] == len(y) for r, x, y in zip(found, a, b, strict=True))
    assert align_batch(["A" * 2100], ["A" * 2100], table, False, 11, 1)[0].tolist() == [8400, 2100, 0, 0, 0]


def test_gap_costs(tmp_path):
    assert gap_costs() == (11, 1) and gap_costs("blosum62", -9, -2) == (9, 2)
    with pytest.raises(ValueError):
        gap_costs("BLOSUM62", 1, 1)
    (tmp_path / "m").write_text("# a comment\n  A C\nA 4 -1\nC -1 9\n")
    assert read_matrix(str(tmp_path / "m"))["A", "C"] == -1
