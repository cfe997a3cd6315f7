from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.functions import cigar
from strandloom.functions.alignment import align_batch, blosum62, lookup
from strandloom.operators import slices, stitch

SCHEMA = "hit_id bigint, subjectid string, translated_querysequence string, full_querysequence string, querystart int, queryend int, subjectstart int, subjectend int, cigar string, bitscore double, pos string"


def cells(row):
    """Reference position -> residue and codon of one hit."""
    no, subject, text, full, qs, qe, s, e, cigar, score, _ = row
    lo, hi = min(s, e), max(s, e)
    segment = full[min(qs, qe) - 1 : max(qs, qe)]
    if qs > qe:
        segment = segment[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out, r, q, n, number = {}, lo, 0, 0, ""
    for c in cigar:
        if c.isdigit():
            number += c
            continue
        size, number = int(number), ""
        if c in "\\/":
            n += size if c == "\\" else -size
            continue
        for _ in range(size):
            if c == "M" and r <= hi:
                out[r] = (text[q : q + 1] or "-", segment[max(n, 0) : max(n, 0) + 3].ljust(3, "-"))
            if c == "D" and r <= hi:
                out[r] = ("-", "---")
            r += c in "MD"
            q += c in "MI"
            n += 3 * (c in "MI")
    return out


@pytest.mark.parametrize("block", [5, 256])
def test_winners(spark, monkeypatch, block):
    monkeypatch.setattr(stitch, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for no in range(1, 70):
        ops = [(rng.randint(1, 6), rng.choice("MMMDI" if i % 2 else "M")) for i in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            ops.insert(1, (1, rng.choice("\\/")))
        span = sum(n for n, o in ops if o in "MD")
        start = rng.randint(1, 60)
        text = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYX*", k=sum(n for n, o in ops if o in "MI") - rng.choice([0, 0, 0, 2])))
        full = "".join(rng.choices("ACGT", k=120))
        ends = (start, start + span - 1 - rng.choice([0, 0, 1]))
        at = (3, 110) if rng.random() < 0.5 else (100, 7)
        rows.append((no, rng.choice("st"), text, full, *at, *(ends if rng.random() < 0.7 else ends[::-1]), "".join(f"{n}{o}" for n, o in ops), float(rng.randint(1, 6)), "x"))
    best: dict = {}
    for row in rows:
        for p, cell in cells(row).items():
            key = (-row[9], row[0])
            if (row[1], p) not in best or key < best[row[1], p][0]:
                best[row[1], p] = (key, *cell)
    df = spark.createDataFrame([*rows, *rows[:9], (99, None, "M", "ATG", 1, 3, 1, 1, "1M", 9.0, ""), (98, "s", "M", "ATG", 1, 3, 1, 1, "", 9.0, ""), (97, "s", "M", "ATG", 1, 3, 1, 1, "1I", 9.0, "")], SCHEMA)
    regions = stitch.resolve_regions(df, nucleotides=True).collect()
    found = {(r["subjectid"], r["first_pos"] + i): ((-r["bitscore"], r["hit_id"]), a, r["codons"][3 * i : 3 * i + 3]) for r in regions for i, a in enumerate(r["residues"])}
    assert found == best and sum(r["last_pos"] - r["first_pos"] + 1 for r in regions) == len(best)
    assert {(r["subjectid"], r["pos"]): (r["hit_id"], r["residue"]) for r in stitch.resolve_positions(df).collect()} == {k: (v[0][1], v[1]) for k, v in best.items()}
    runs = {tuple(r) for r in stitch.resolved_regions(stitch.resolve_positions(df)).select("subjectid", "hit_id", "first_pos", "last_pos").collect()}
    assert runs == {(r["subjectid"], r["hit_id"], r["first_pos"], r["last_pos"]) for r in regions}
    markers = spark.createDataFrame([("s", "A" * 50), ("t", "C" * 90)], "subjectid string, sequencedata string")
    rows = {r["subjectid"]: r for r in stitch.stitched(stitch.masked(stitch.resolve_regions(df, True)), markers).collect()}
    for subject, size in (("s", 50), ("t", 90)):
        shown = [best.get((subject, p), (None, "-", "---"))[1:] for p in range(1, size + 1)]
        shown = [("-", "---") if a in "*X-" else (a, c) for a, c in shown]
        assert rows[subject]["aligned"] == "".join(a for a, _ in shown) and rows[subject]["aligned_dna"] == "".join(c for _, c in shown)
    assert stitch.resolve_regions(df.limit(0), True).count() == 0


def test_windows_with_gaps(spark):
    rng = random.Random(1)
    table = blosum62()

    def brute(text, ref, size, least):
        size = min(size, len(text)) or 1
        cut = set()
        for i in range(len(text) - size + 1):
            total = 0
            for k in range(i, i + size):
                if text[k] == "-":
                    total -= 1 + 11 * (k == i or text[k - 1] != "-")
                else:
                    total += table.get((text[k].upper(), ref[k].upper()), -4)
            if total / size < least:
                cut |= set(range(i, i + size))
        return "".join("-" if k in cut else c for k, c in enumerate(text))

    rows = [("".join(rng.choices("-WCPa", k=n)), "".join(rng.choices("WCPAd", k=n)), n) for n in (0, 1, 3, 4, 5, 30, 200)] + [(None, "A", 1), ("A", None, 1)]
    for least in (-7.0, -2.0):
        df = spark.createDataFrame(rows, "a string, b string, n int").select("a", "b", stitch.window_trimmed(F.col("a"), F.col("b"), 4, least).alias("t"))
        for r in df.collect():
            assert r["t"] == (r["a"] if r["a"] is None or r["b"] is None else brute(r["a"], r["b"], 4, least))
    assert np.isclose(-(11 + 1 + 1) - 8, 4 * -5.25)  # two adjacent gaps and two mismatches stay at -7.0
    row = spark.createDataFrame([("--CC", "AAWW")], "a string, b string").select(stitch.window_trimmed(F.col("a"), F.col("b")).alias("t")).first()
    assert row["t"] == "--CC"


def expanded(cigar):
    out, number = "", ""
    for c in cigar:
        if c.isdigit():
            number += c
        else:
            out, number = out + c * int(number), ""
    return out


def test_slices(spark):
    rng = random.Random(8)
    rows = []
    for no in range(60):
        ops = "".join(f"{rng.randint(1, 4)}{o}" for o in rng.choice(["M", "MIM", "MDM", "DMI", "IMD", "D", "MDIM", "MMI"]))
        text = "".join(rng.choices("ACDEF", k=sum(c in "MI" for c in expanded(ops))))
        span = sum(c in "MD" for c in expanded(ops))
        rows.append((no, ops, text, rng.randint(1, span), rng.randint(1, span)))
    df = spark.createDataFrame(rows, "no int, cigar string, text string, a int, b int")
    for r in df.select("*", cigar.sliced(F.col("cigar"), F.col("a"), F.col("b")).alias("s")).collect():
        columns, ref, query = [], 0, 0
        for op in expanded(r["cigar"]):
            ref, query = ref + (op in "MD"), query + (op in "MI")
            if r["a"] <= ref <= r["b"] and (op in "MD" or ref < r["b"]):
                columns.append((op, ref, query))
        while columns and columns[0][0] != "M":
            columns.pop(0)
        while columns and columns[-1][0] != "M":
            columns.pop()
        if not columns:
            assert r["s"] is None
            continue
        assert expanded(r["s"]["cigar"]) == "".join(c for c, _, _ in columns)
        assert tuple(r["s"])[1:] == (columns[0][1], columns[-1][1], columns[0][2], columns[-1][2])


def test_overlaps_scored_anew(spark):
    reference = "MKVLAWHHGERTYPLKDSAQ"
    hits = [(1, "s", reference[:12], "", 1, 36, 1, 12, "12M", 90.0, ""), (2, "s", "AAAA" + reference[12:], "", 1, 36, 9, 20, "12M", 95.0, ""), (3, "s", reference[:12], "", 1, 36, 1, 12, "12M", 80.0, "")]
    df = spark.createDataFrame([*hits, hits[0]], SCHEMA)
    markers = spark.createDataFrame([("s", reference), ("t", None)], "subjectid string, sequencedata string")
    (row,) = slices.overlap_order(df, markers).collect()
    table = blosum62()
    assert (row["hit_a"], row["hit_b"], row["overlap_first"], row["overlap_last"]) == (1, 2, 9, 12)
    assert row["score_a"] == sum(table[c, c] for c in reference[8:12]) and row["score_b"] < row["score_a"] and (row["by_overlap"], row["by_bitscore"]) == (1, 2)
    cut = {(r["hit_id"], r["region_first"]): r for r in slices.region_slices(df).collect()}
    assert cut[1, 1]["translated_querysequence"] == reference[:8] and (cut[1, 1]["querystart"], cut[1, 1]["queryend"], cut[1, 1]["cigar"]) == (1, 24, "8M")
    assert slices.overlap_order(df.limit(0), markers).count() == 0
    query = spark.createDataFrame([("AACCCGGGTT", 3, 8), ("ACG", 1, 3), (None, 1, 2), ("ACG", 2, 9)], "q string, a int, b int")
    assert [r[0] for r in query.select(slices.framed_query(F.col("q"), F.col("a"), F.col("b"))).collect()] == ["CCCGGG", "ACG", None, None]


@pytest.mark.parametrize("block", [4, 256])
def test_overlaps_by_their_score(spark, monkeypatch, few_heavy, block):
    """Every stretch with the same hits goes to the best local alignment there; blocks don't matter."""
    monkeypatch.setattr(stitch, "BLOCK", block)
    rng, table = random.Random(3), lookup(blosum62())
    reference = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=60))
    rows = []
    for no in range(1, 26):
        start, size = rng.randint(1, 45), rng.randint(1, 25)
        text = "".join(rng.choice("ACDEF") if rng.random() < 0.3 else c for c in reference[start - 1 : start - 1 + size])
        ops, span = f"{len(text)}M", len(text)
        if rng.random() < 0.4 and len(text) > 6:
            ops, span = f"3M2D{len(text) - 3}M", len(text) + 2
        rows.append((no, rng.choice("sst"), text, "", 1, 3, start, start + span - 1, ops, float(rng.randint(1, 4)), ""))
    markers = spark.createDataFrame([("s", reference)], "subjectid string, sequencedata string")
    df = spark.createDataFrame([*rows, *rows[:4]], SCHEMA)
    owner = {}
    for subject in "st":
        mine = [r for r in rows if r[1] == subject]
        edges = sorted({e for r in mine for e in (r[6], r[7] + 1)})
        for a, b in zip(edges, edges[1:], strict=False):
            best = []
            for r in mine:
                if r[6] <= a and b - 1 <= r[7]:
                    piece = "".join(c[0] for p, c in sorted(cells(r).items()) if a <= p < b).strip("-")
                    ref = reference[a - 1 : b - 1] if subject == "s" else ""
                    best.append((int(align_batch([piece.replace("-", "")], [ref], table, True, 11, 1)[0, 0]), r[9], -r[0]))
            for p in range(a, b):
                if best:
                    owner[subject, p] = -max(best)[2]
    found = {(r["subjectid"], p): r["hit_id"] for r in stitch.regions_by_overlap(df, markers).collect() for p in range(r["first_pos"], r["last_pos"] + 1)}
    assert found == owner
    from strandloom.plans.markers import Settings, retrieve_markers

    hits = df.selectExpr("*", "cast(hit_id as string) as queryid", "1 as queryframe", "'' as subjectsequence", "90.0 as percentidentical")
    assert retrieve_markers(hits, markers, Settings(by_overlap=True)).sequences.count() == 1
    assert stitch.regions_by_overlap(df.limit(0), markers).count() == 0
