from __future__ import annotations

import pytest
from held_out import HELD_OUT, PLAIN
from strandloom.llm.personal import Gazetteer, Scanner, _choose, _slots, _unpack_votes, _pack_votes, find_personal, mask_personal, reliabilities

PARTS = [("Anna", "given"), ("Lena", "given"), ("Tomas", "given"), ("Meerquist", "family"), ("Lindquist", "family"), ("Bergquist", "family"), ("Rosquist", "family"), (None, "given")]
TEXTS = {
    "Curator: Dr. Anna Meerquist, phone +44 20 7946 0000, [mailto:anna+x@mail.example mail]": [("name", "Anna Meerquist"), ("phone", "+44 20 7946 0000"), ("email", "anna+x@mail.example")],
    "call (312) 555-0100 for free soup ask for Lindquist, Lena": [("phone", "(312) 555-0100"), ("name", "Lindquist, Lena")],
    "my passport ZZ1234567 is on the form, signed T.B. van der Rosquist": [("idnum", "ZZ1234567"), ("name", "T.B. van der Rosquist")],
    "Please write to Lena C. Bergquist, Flat 3, 12b Corver Road, Melford ZZ1 2AB.": [("name", "Lena C. Bergquist"), ("address", "Flat 3, 12b Corver Road, Melford ZZ1 2AB")],
    "You can reach me at lena AT mail DOT example or call 555.555.0199 ext. 12.": [("email", "lena AT mail DOT example"), ("phone", "555.555.0199 ext. 12")],
    "Ich wohne in der Corverstraße 7a, 00123 Melford. Erreichbar unter 030 23125000": [("address", "Corverstraße 7a, 00123 Melford"), ("phone", "030 23125000")],
    "J'habite 12 bis, rue de Corver, appelez le 01 99 00 12 34.": [("address", "12 bis, rue de Corver"), ("phone", "01 99 00 12 34")],
    "Vivo en C/ Corver, 8, 2.º B; llamar al +33 6 39 98 12 34.": [("address", "C/ Corver, 8, 2.º B"), ("phone", "+33 6 39 98 12 34")],
    "The Meerquist–Lindquist index was 123,456 (1999). ''Rosa alba'' Lindquist, 1801. ISBN 978-0-2544-3955-3": [],
    "Corver Street is 9 km long; Route 63 crosses it. Revision 735482913 of 8.11.2014 18:11. IP 192.0.2.1": [],
    "Meerquist Bridge (17.8250, -39.4100) Accession QV_219395.7, contig BDBT@m.32178. lot 343125": [],
}


@pytest.fixture
def tables(spark):
    rows, number = [], 0
    for copy in range(12):
        for text in TEXTS:
            number += 1
            rows.append((number, ("filler line\n" * (copy % 3)) + text, "kind"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 40_000, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), spark.createDataFrame(PARTS, "part_text string, part_kind string")


def test_found_and_masked(tables):
    documents, parts = tables
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found: dict[int, list] = {}
    for r in find_personal(documents, parts).collect():
        found.setdefault(r["doc_id"], []).append((r["kind"], texts[r["doc_id"]][r["start_pos"] - 1 : r["end_pos"]]))
    for number, text in texts.items():
        expected = TEXTS.get((text or "").rpartition("\n")[2], [])
        assert sorted(found.get(number, [])) == sorted(expected), text
    masked = {r["doc_id"]: (r["text"], r["items"]) for r in mask_personal(documents, parts).collect()}
    assert masked[900] == (None, 0) and masked[901] == ("", 0) and len(masked) == len(texts)
    assert masked[2] == ("call [PHONE] for free soup ask for [NAME]", 2)


def test_held_out(spark, tables):
    """Sentences in words that no training text has, with names that no list has."""
    documents, parts = tables
    rows = [(10_000 + i, text) for i, (text, _) in enumerate(HELD_OUT)] + [(20_000 + i, text) for i, text in enumerate(PLAIN)]
    texts = dict(rows)
    every = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {(r["doc_id"], r["kind"], texts[r["doc_id"]][r["start_pos"] - 1 : r["end_pos"]]) for r in find_personal(every, parts).collect() if r["doc_id"] in texts}
    wanted = {(10_000 + i, *item) for i, (_, items) in enumerate(HELD_OUT) for item in items}
    assert len(wanted & found) >= 0.9 * len(wanted), sorted(wanted - found)
    assert len(found - wanted) <= 0.15 * len(found), sorted(found - wanted)


def test_empty(spark, tables):
    assert find_personal(tables[0].limit(0), tables[1]).count() == 0


def test_votes():
    for votes in ([1, -1, 0, 0, 1, -1], [1, 1], []):
        assert _unpack_votes(_pack_votes(votes)).tolist() == votes + [0] * (6 - len(votes))
    good, bad = _pack_votes([1, 1, 0, 0]), _pack_votes([0, -1, -1, 0])
    belief = reliabilities({(1, good): 50, (1, bad): 40, (1, _pack_votes([1, 0, 0, 0])): 5})
    assert belief[1, good] > 0.9 and belief[1, bad] < 0.1


def test_overlaps():
    import numpy as np

    weights = np.zeros(1 << 12)
    weights[1], weights[2] = 5.0, 1.0
    assert _choose(weights, [(1, 0, 9, [1]), (2, 3, 12, [2]), (0, 20, 22, [2]), (0, 30, 31, [3])]) == [(1, 0, 9), (0, 20, 22)]
    assert Scanner(Gazetteer(frozenset(), frozenset())).candidates("") == [] and _slots(1, [""])
