from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from strandloom.functions import alignment
from strandloom.functions.alignment import _counts, _lookup, align_batch, align_paths, blosum62, lookup
from strandloom.functions.sequences import genetic_code, is_amino_acid, translated
from strandloom.operators import search
from strandloom.plans.markers import Settings, retrieve_markers
from strandloom.plans.orthologs import compare_orthologs
from strandloom.sources import readers, writers

CODONS = dict(zip("ARNDCQEGHILKMFPSTWYV", "GCT CGT AAT GAT TGT CAA GAA GGT CAT ATT CTT AAA ATG TTT CCT TCT ACT TGG TAT GTT".split(), strict=True))


def divergent(rng, text):
    """No three letters in a row stay as they are, so no seed word is left."""
    swap = {"I": "V", "L": "M", "K": "R", "F": "Y", "E": "D"}
    return "".join(c if i % 3 else swap.get(c, rng.choice("AST")) for i, c in enumerate(text))


def test_search_aligns_whole_sequences(spark):
    rng = random.Random(4)
    parts = ["".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=k)) for k in (150, 40, 130)]
    end, seed, second = parts
    pairs = {
        "end": (divergent(rng, end) + seed, end + seed),  # a divergent end of more than 100 letters
        "indel": (seed + divergent(rng, end) + second, seed + end + "GS" * 4 + second),  # the other diagonal lies more than 100 letters away
    }
    contigs = spark.createDataFrame([(k, "".join(CODONS[c] for c in q)) for k, (q, _) in pairs.items()], "seq_id string, sequencedata string")
    markers = spark.createDataFrame([(k, r) for k, (_, r) in pairs.items()], "subjectid string, sequencedata string")
    found = {r["seq_id"]: r for r in search.search(contigs, markers, max_targets=0).filter("seq_id = subjectid").collect()}
    for k, (q, r) in pairs.items():
        full = align_batch([q], [r], _lookup(blosum62()), True, 11, 1)[0].tolist()
        assert found[k]["frame"] == 1 and [found[k][c] for c in ("score", "matches", "mismatches", "insertions", "deletions")] == full


def rescored(a, b, i, j, cigar, table):
    total, i, j = 0, i - 1, j - 1
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        total += sum(int(table[ord(x), ord(y)]) for x, y in zip(a[i : i + n], b[j : j + n], strict=True)) if op == "M" else -11 - n
        i, j = i + n * (op != "D"), j + n * (op != "I")
    return total, i, j


@pytest.mark.parametrize("cells", [1 << 25, 40_000])
@pytest.mark.parametrize("local", [False, True])
def test_paths(local, cells):
    """Operations score what the score says, whether a batch is traced at once or in blocks of rows."""
    rng, table, a, b = random.Random(3), lookup(blosum62()), [], []
    for _ in range(200):
        x = rng.choices("ARNDCQEGHILKMFPSTWYV", k=rng.randint(0, 40))
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 4)] = rng.choices("ARNDCQEGHILKMFPSTWYV", k=rng.randint(0, 4))
        a.append("".join(x))
        b.append("".join(y))
    best = align_batch(a, b, table, local, 11, 1)
    for x, y, want, (score, i, ie, j, je, cigar) in zip(a, b, best, align_paths(a, b, table, local, 11, 1, cells), strict=True):
        assert score == want[0]
        if cigar:
            assert rescored(x, y, i, j, cigar, table) == (score, ie, je)
            assert _counts(x, y, i, j, cigar)[0] == want[1]
        if cigar and not local:
            assert (i, ie, j, je) == (1, len(x), 1, len(y))


def test_long_sequences_keep_their_path():
    rng = random.Random(5)
    x = "".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=2600))
    y = x[:900] + x[950:2000] + "WWW" + x[2000:]
    score, *_, cigar = align_paths([x], [y], lookup(blosum62()), True, 11, 1, cells=1 << 20)[0]
    assert cigar == "900M50I1050M3D600M" and score == sum(blosum62()[c, c] for c in x[:900] + x[950:]) - 61 - 14


def back_translated(protein):
    return "".join(CODONS[c] for c in protein)


def reverse(text):
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_files_to_markers(spark, tmp_path):
    """Contigs and references as text, overlapping contigs on both strands, stitched residues and nucleotides out."""
    rng = random.Random(9)
    reference = "".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=160))
    pieces = {"sp@c1": "GG" + back_translated(reference[:70]) + "T", "sp@c2": reverse("A" + back_translated(reference[55:120])), "sp@c3": back_translated(reference[130:])}
    (tmp_path / "contigs.fa").write_text("".join(f">{k} some words\n{v[:50]}\n{v[50:]}\n" for k, v in pieces.items()))
    (tmp_path / "reference.fa").write_text(f">otu@gene\n{reference}\n")
    contigs, markers = readers.read_contigs(spark, str(tmp_path / "contigs.fa")), readers.read_references(spark, str(tmp_path / "reference.fa"))
    found = search.search(contigs, markers, word=5)
    rows = {r["queryid"]: r for r in found.collect()}
    assert rows["sp@c1"]["queryframe"] == 3 and (rows["sp@c1"]["querystart"], rows["sp@c1"]["queryend"], rows["sp@c1"]["subjectend"]) == (3, 212, 70)
    assert rows["sp@c2"]["queryframe"] == -2 and (rows["sp@c2"]["querystart"], rows["sp@c2"]["queryend"]) == (195, 1)
    assert rows["sp@c3"]["cigar"] == "30M" and rows["sp@c3"]["evalue"] < 1e-6 and rows["sp@c3"]["percentidentical"] == 100
    expected = reference[:120] + "-" * 10 + reference[130:]
    result = retrieve_markers(found, markers)
    row = result.sequences.first()
    assert row["aligned"] == expected and row["dna"] == back_translated(expected.replace("-", ""))
    stats = result.statistics.first()
    assert (stats["regions"], stats["contigs"], stats["matches"], stats["deletions"], stats["identity"]) == (3, 3, 150, 10, 100.0)
    # the hits as text, read again
    columns = [c.split(" ")[0] for c in readers.HITS.split(", ")]
    shown = found.withColumn("querysequence", F.lit("")).select(*columns)
    writers.write_hits(shown, str(tmp_path / "hits"))
    again = readers.read_hits(spark, str(tmp_path / "hits"))
    assert again.select("hit_id").distinct().count() == 3
    result = retrieve_markers(again, markers, Settings(subject_cover=10, by_species=True))
    assert [(r["subjectid"], r["aligned"]) for r in result.sequences.collect()] == [("sp|otu@gene", expected)]
    assert retrieve_markers(again, markers, Settings(subject_cover=90)).sequences.count() == 0
    result.write(str(tmp_path / "out"))
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert names == {"sequences", "nucleotides", "statistics", "summary", "coverage", "identity"}
    assert readers.read_fasta(spark, str(tmp_path / "out" / "nucleotides" / "marker=gene")).count() == 1
    block = spark.createDataFrame(result.statistics.collect(), result.statistics.schema).select(writers.alignment_text(result.statistics).alias("t")).first()["t"]
    assert "Matches: 150" in block and "Occupancy: 93.75" in block


def test_options_and_proteins(spark, few_heavy):
    rng = random.Random(2)
    reference = "".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=60))
    markers = spark.createDataFrame([("m", reference + "AAAAAAAA"), ("low", "AAAAAAAAAAAA"), ("none", None), (None, reference)], "subjectid string, sequencedata string")
    contigs = spark.createDataFrame([("q", back_translated(reference)), ("q", back_translated(reference[:30])), ("a", "GCT" * 30), ("n", None), (None, "ACGT"), ("e", "")], "seq_id string, sequencedata string")
    found = search.search(contigs, markers, max_targets=0)
    assert {(r["queryid"], r["subjectid"], r["matches"]) for r in found.collect()} == {("q", "m", 60), ("q", "m", 30), ("a", "low", 12), ("a", "m", 8)}
    assert {r["queryid"] for r in search.search(contigs, markers, masking=True).collect()} == {"q"}
    assert {r["matches"] for r in search.search(contigs, markers, least_orf=40, frames=(1, 2, 3)).collect()} == {60}
    assert search.search(contigs, markers, frames=(-1, -2, -3)).filter("queryid = 'q'").count() == 0
    assert {r["queryid"] for r in search.search(contigs, markers, evalue=1e-9).collect()} == {"q"}
    assert search.search(contigs.limit(0), markers).count() == 0
    proteins = spark.createDataFrame([("p", reference[10:50]), ("x", "WWWWWW")], "seq_id string, sequencedata string")
    row = search.protein_search(proteins, markers).collect()
    assert [(r["queryid"], r["querystart"], r["queryend"], r["subjectstart"], r["cigar"]) for r in row] == [("p", 1, 40, 11, "40M")]
    compared = compare_orthologs(proteins, markers)
    assert [(r["subjectid"], r["matches"], r["distance"], r["percent_identity"]) for r in compared.statistics.collect()] == [("m", 40, 0, 100.0)]
    assert compare_orthologs(contigs, markers, nucleotides=True).statistics.filter("subjectid = 'm'").first()["matches"] == 60


def test_genetic_codes(spark):
    assert len(set(genetic_code(1))) == 21 and genetic_code(11) == genetic_code(1)
    with pytest.raises(ValueError):
        genetic_code(99)
    df = spark.createDataFrame([("TGAATAAGA", "MKV*"), ("ACGT", "ACGT"), (None, None)], "s string, p string")
    rows = df.select(translated(F.col("s"), 1, genetic_code(2)).alias("t"), is_amino_acid(F.col("p")).alias("p")).collect()
    assert [(r["t"], r["p"]) for r in rows] == [("WM*", True), ("T", False), (None, None)]


def drawn_pairs(rng, n, most):
    """Pairs of unrelated texts, and of texts with pieces cut out and put in."""
    letters, pairs = "ARNDCQEGHILKMFPSTWYVX*", []
    for _ in range(n):
        x = rng.choices(letters, k=rng.randint(0, most))
        y = list(x) if rng.random() < 0.5 else rng.choices(letters, k=rng.randint(0, most))
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 12)] = rng.choices(letters, k=rng.randint(0, 12))
        pairs.append(("".join(x), "".join(y)))
    return [x for x, _ in pairs], [y for _, y in pairs]


@pytest.mark.parametrize("costs", [(11, 1), (1, 1), (3, 2), (2, 0)])
def test_windows_keep_paths(costs):
    """Scores are those of whole alignments, and tracing a window gives what tracing whole texts gives."""
    table = lookup(blosum62())
    a, b = drawn_pairs(random.Random(sum(costs)), 400, 60)
    assert alignment.ends_of_many(a, b, table, *costs)[:, 0].tolist() == align_batch(a, b, table, True, *costs)[:, 0].tolist()
    assert alignment.local_paths(a, b, table, *costs) == align_paths(a, b, table, True, *costs)


def test_scores_in_8_bits():
    """Pairs whose scores leave 8 bits are told apart and scored again; all others have their score at once."""
    table = lookup(blosum62())
    a, b = drawn_pairs(random.Random(12), 300, 120)
    best = align_batch(a, b, table, True, 11, 1)[:, 0]
    short, again = alignment._short_ends(a, b, table, 11, 1)
    assert again.tolist() == (best > 127 - 11).tolist() and 20 < again.sum() < 280
    assert short[~again, 0].tolist() == best[~again].tolist()
    assert alignment.local_ends(a, b, table, 11, 1)[:, 0].tolist() == best.tolist()


def test_little_is_traced(monkeypatch):
    """Unrelated pairs are scored whole, but few of their cells are traced."""
    rng, cells = random.Random(8), []
    plain = alignment.align_paths
    monkeypatch.setattr(alignment, "align_paths", lambda a, b, *more: cells.append(sum(len(x) * len(y) for x, y in zip(a, b, strict=True))) or plain(a, b, *more))
    a, b = ([("".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=k))) for _ in range(60)] for k in (130, 370))
    alignment.local_paths(a, b, lookup(blosum62()), 11, 1)
    assert sum(cells) < 0.1 * 60 * 130 * 370


def test_words_by_number(spark):
    """Numbered words are the words; the bitmap of some words keeps all rows of these."""
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY" + "X*" * (k % 2), k=rng.randint(0, 30)))) for k in range(40)] + [(50, "AAAAAAAA"), (51, ""), (52, "AC\u00e4CDEFGHI"), (53, "ABABABAB")]
    df = spark.createDataFrame(rows, "k int, s string")
    for size, masking in ((3, False), (6, True)):
        plain = search.words(df, "s", size, masking).collect()
        coded = search.coded_words(df, "s", size, masking)
        number = lambda w: sum(search.ACIDS.index(c) * 20**i for i, c in enumerate(reversed(w)))
        assert sorted((r["k"], r["pos"], number(r["word"])) for r in plain) == sorted((r["k"], r["pos"], r["word"]) for r in coded.collect())
        bitmap = search.word_bitmap(coded.filter("k < 20 or k = 50"))
        some = {r["word"] for r in coded.filter("k < 20 or k = 50").collect()}
        assert sorted(r for r in coded.collect() if r["word"] in some) == sorted(search.coded_words(df, "s", size, masking, bitmap).collect())


def test_windows_of_long_pairs():
    """A comparison aligns only the piece of long texts that their best alignment takes, with the counts of that alignment."""
    rng = random.Random(21)
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    core, table = draw("ARNDCQEGHILKMFPSTWYV", 80), lookup(blosum62())
    a, b = draw("DEKRNQ", 1200) + core + draw("DEKRNQ", 1000), draw("FWYLIV", 900) + core[:40] + core[43:] + draw("FWYLIV", 1400)
    ((i, ie, j, je),) = alignment.local_windows([a], [b], table, 11, 1)
    assert ie - i < 200 and je - j < 200
    found = align_batch([a[i - 1 : ie]], [b[j - 1 : je]], table, True, 11, 1)[0].tolist()
    score, *places, cigar = align_paths([a], [b], table, True, 11, 1)[0]
    assert found == [score, *_counts(a, b, places[0], places[2], cigar)]


@pytest.mark.parametrize("costs", [(11, 1), (1, 1), (3, 2), (2, 0)])
def test_scores_in_lanes(monkeypatch, costs):
    """Pairs of shared references have the scores of whole alignments, those that leave 8 bits too."""
    monkeypatch.setattr(alignment, "SHARED", 3)
    monkeypatch.setattr(alignment, "LANE_CELLS", 4000)
    rng, table, a, b = random.Random(17), lookup(blosum62()), [], []
    texts, references = drawn_pairs(rng, 300, 90)
    for k, x in enumerate(texts):
        a += [x, x[10:60], x[:30] + x[35:]]
        b += [references[k % 20], references[k % 7], texts[k % 9]]
    best = align_batch(a, b, table, True, *costs)[:, 0]
    assert (best > 127).sum() > 10 and alignment.scores_of_many(a, b, table, *costs).tolist() == best.tolist()


@pytest.mark.parametrize("most", [0, 2])
def test_comparison_traces_only_best_hits(spark, monkeypatch, most):
    """The best hit of each reference is that of the search, and the search's hits aren't traced for it."""
    rng = random.Random(31)
    references = ["".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=k)) for k in (90, 120, 70)]
    pieces = [references[k % 3][k % 40 : k % 40 + 12] + references[(k + 1) % 3][k % 25 : k % 25 + 9] + references[(k + 2) % 3][k % 31 : k % 31 + 8] for k in range(240)]
    contigs = spark.createDataFrame([(f"q{k}", back_translated("".join(rng.choices("ARNDCQEGHILKMFPSTWYV", k=rng.randint(0, 30))) + t)) for k, t in enumerate(pieces)], "seq_id string, sequencedata string")
    markers = spark.createDataFrame([(f"m{k}", t) for k, t in enumerate(references)], "subjectid string, sequencedata string")
    found = search.search(contigs, markers, max_targets=most).collect()
    want = {s: min((-r["bitscore"], r["hit_id"], r["queryid"]) for r in found if r["subjectid"] == s)[2] for s in ("m0", "m1", "m2")}
    monkeypatch.setattr(search, "TOGETHER", 90)

    def traced(*_):
        raise AssertionError("a hit is traced")

    monkeypatch.setattr(search, "aligned_path", traced)
    assert {r["subjectid"]: r["queryid"] for r in compare_orthologs(contigs, markers, nucleotides=True, max_targets=most).statistics.collect()} == want


def test_comparison_keeps_the_genetic_code(spark):
    contigs = spark.createDataFrame([("q", back_translated("ARNDCQEGHILKMFPSTYV").replace("TGG", "TGA") + "TGATGA" + back_translated("KMFPSTYVAR"))], "seq_id string, sequencedata string")
    markers = spark.createDataFrame([("m", "ARNDCQEGHILKMFPSTYVWWKMFPSTYVAR")], "subjectid string, sequencedata string")
    row = compare_orthologs(contigs, markers, nucleotides=True, code=genetic_code(2), frames=(1,)).statistics.first()
    assert (row["matches"], row["mismatches"]) == (31, 0)
