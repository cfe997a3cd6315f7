from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.functions import native
from strandloom.functions.alignment import _counts, align_paths, blosum62, lookup
from strandloom.operators import blocks, search
from strandloom.plans.markers import retrieve_markers
from strandloom.plans.orthologs import compare_orthologs

ACIDS = "ARNDCQEGHILKMFPSTWYV"


@pytest.fixture(params=["compiled", "numpy"])
def kernels(request, monkeypatch):
    """The compiled kernels, and what stands in for them where they can't be loaded."""
    if request.param == "numpy":
        monkeypatch.setattr(native, "library", lambda: None)
    elif native.library() is None:
        pytest.skip("the compiled kernels don't run on this machine")


def related(rng, n, most, letters=ACIDS + "X*"):
    pairs = []
    for _ in range(n):
        x = rng.choices(letters, k=rng.randint(0, most))
        y = list(x) if rng.random() < 0.5 else rng.choices(letters, k=rng.randint(0, most))
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 12)] = rng.choices(letters, k=rng.randint(0, 12))
        pairs.append(("".join(x), "".join(y)))
    return [x for x, _ in pairs], [y for _, y in pairs]


@pytest.mark.parametrize("costs", [(11, 1), (1, 1), (3, 2), (2, 0), (0, 1)])
def test_pairs(kernels, monkeypatch, costs):
    """Scores, places, counts and operations are those of alignments of the whole texts, in 8 and in 16 bits, other letters than ASCII too."""
    monkeypatch.setattr(native, "TRACED", 50)
    monkeypatch.setattr(native, "ROOM", 3000)
    table = lookup(blosum62())
    a, b = related(random.Random(sum(costs)), 150, 60)
    more = related(random.Random(5), 40, 300)
    a, b = [*a, *more[0], "ACDÄFGH"], [*b, *more[1], "WWACDEFGH"]
    full, i = align_paths(a, b, table, True, *costs), np.arange(len(a))
    pairs = native.Pairs(native.Texts.of(a), native.Texts.of(b), table, *costs)
    ends = pairs.ends(i, i)
    assert ends[:, 0].tolist() == [f[0] for f in full] and (ends[:, 0] > 127).sum() > 5
    found, cigars = pairs.paths(i, i, ends)
    want = [(*_counts(x, y, f[1], f[3], f[5]), *f[1:]) for x, y, f in zip(a, b, full, strict=True)]
    got = [(*row, cigar) for row, cigar in zip(found.tolist(), cigars, strict=True)]
    assert [w for w, f in zip(want, full, strict=True) if f[0] > 0] == [g for g, f in zip(got, full, strict=True) if f[0] > 0]


def test_shared_words(kernels):
    """All places of equal words are found, however few of them come at a time."""
    rng = random.Random(7)
    mine, theirs = (rng.choices(range(-1, 3), k=k) for k in (400, 300))
    for size in (1, 3, 5):
        words = native.Words(native.word_numbers(np.array(mine, np.int8), size, 3), size, 3)
        want = sorted((i, j) for i in range(401 - size) for j in range(301 - size) if mine[i : i + size] == theirs[j : j + size] and min(mine[i : i + size]) >= 0)
        for room in (7, 1 << 16):
            parts = list(words.shared(np.array(theirs, np.int8), room))
            assert all(len(m) <= room for m, _ in parts)
            assert sorted((int(i), int(j)) for m, t in parts for i, j in zip(m, t, strict=True)) == want


def tables(spark, seed=3):
    """Contigs with pieces of several references, and references that share pieces."""
    rng = random.Random(seed)
    codon = dict(zip(ACIDS, "GCT CGT AAT GAT TGT CAA GAA GGT CAT ATT CTT AAA ATG TTT CCT TCT ACT TGG TAT GTT".split(), strict=True))
    references = ["".join(rng.choices(ACIDS, k=rng.randint(20, 90))) for _ in range(20)]
    references += [r[:40] + "".join(rng.choices(ACIDS, k=10)) + r[45:] for r in references[:10]] + [references[0]]
    contigs = []
    for _ in range(90):
        text = "".join(rng.choices("ACGT", k=rng.randint(0, 4)))
        for r in rng.sample(references, rng.randint(1, 3)):
            at = rng.randint(0, len(r) - 10)
            text += "".join(codon[c] for c in r[at : at + rng.randint(8, 60)])
        contigs.append(text if rng.random() < 0.5 else text[::-1].translate(str.maketrans("ACGT", "TGCA")))
    return (
        spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(contigs)] + [("q0", contigs[1]), ("n", None)], "seq_id string, sequencedata string"),
        spark.createDataFrame([(f"m{k}", t) for k, t in enumerate(references)] + [("none", None)], "subjectid string, sequencedata string"),
    )


def by_pairs(contigs, markers, **changes):
    """The search over a table of pairs."""
    keyed, frames, o = search._contig_frames(contigs, None, changes)
    return search._aligned(search.Workspace(contigs.sparkSession, "search"), keyed, frames, markers, o, 3)


@pytest.mark.parametrize("passes", [1, 3])
@pytest.mark.parametrize("changes", [{}, {"max_targets": 2, "least_seeds": 2}, {"max_targets": 0, "masking": True}, {"max_targets": 2, "evalue": 1e-6, "least_orf": 20}])
def test_search_in_blocks(spark, monkeypatch, passes, changes):
    """Hits are those of the search over a table of pairs, whatever the queries and references that are held at a time."""
    contigs, markers = tables(spark)
    want = by_pairs(contigs, markers, **changes)
    monkeypatch.setattr(blocks, "LETTERS", 1000)
    monkeypatch.setattr(blocks, "GIVEN", 7)
    monkeypatch.setattr(search, "REFERENCE_LETTERS", 1 << 20 if passes == 1 else 700)
    found = search.search(contigs, markers, **changes)
    assert found.dtypes == want.dtypes and want.count() > 50
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("most", [0, 1, 25])
def test_comparison_without_a_table_of_pairs(spark, monkeypatch, most):
    """The best hit of each reference is found where the queries are; before, all pairs went through shuffles with their texts."""
    contigs, markers = tables(spark, 8)
    hits = by_pairs(contigs, markers, max_targets=most).collect()
    best = {s: min((-r["bitscore"], r["hit_id"], r["queryid"]) for r in hits if r["subjectid"] == s)[2] for s in {r["subjectid"] for r in hits}}

    def scored(*_):
        raise AssertionError("a table of pairs is made")

    monkeypatch.setattr(search, "_scored", scored)
    monkeypatch.setattr(blocks, "LETTERS", 1000)
    found = compare_orthologs(contigs, markers, nucleotides=True, max_targets=most).statistics.filter(F.col("matches") > 0).collect()
    assert {r["subjectid"]: r["queryid"] for r in found} == best and len(best) > 20


def without_pairs(monkeypatch):
    def scored(*_):
        raise AssertionError("a table of pairs is made")

    monkeypatch.setattr(search, "_scored", scored)


def test_hits_without_a_table_of_pairs(spark, monkeypatch):
    """Contigs meet the references where they are; before, pairs were shuffled with the texts of both sides, twice."""
    contigs, markers = tables(spark, 5)
    want = sorted(map(repr, by_pairs(contigs, markers, max_targets=3).collect()))
    without_pairs(monkeypatch)
    assert sorted(map(repr, search.search(contigs, markers, max_targets=3).collect())) == want


def test_markers_of_searched_hits(spark, monkeypatch):
    """The marker job over a search's hits gives the same statistics, without a table of pairs."""
    contigs, markers = tables(spark, 6)
    want = sorted(map(repr, retrieve_markers(by_pairs(contigs, markers), markers).statistics.collect()))
    without_pairs(monkeypatch)
    found = sorted(map(repr, retrieve_markers(search.search(contigs, markers), markers).statistics.collect()))
    assert found == want and len(found) > 20
