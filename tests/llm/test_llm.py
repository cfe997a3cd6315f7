from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from strandloom.llm.consolidate import consolidate_by_key, consolidate_pairs, kmer_groups
from strandloom.llm.mixing import Target, fingerprint, mix_shares, mix_sources, route
from strandloom.llm.packing import best_fit_decreasing, container_bound, pack_items
from strandloom.llm.shared_spans import _first_in_window, record_letters, shared_amounts, shared_spans
from strandloom.llm.tokens import TOKENIZER, _encoding, token_counts
from strandloom.llm.top_items import top_items


# ---- shared spans

def brute_spans(records, length):
    where: dict[str, set[str]] = {}
    for i, s in records.items():
        for p in range(len(s) - length + 1):
            if set(w := s[p : p + length]) <= set("ACGT"):
                where.setdefault(w, set()).add(i)
    out = set()
    for i, s in records.items():
        cells = sorted({q for p in range(len(s) - length + 1) if len(where.get(s[p : p + length], ())) > 1 for q in range(p, p + length)})
        run: list[int] = []
        for q in cells + [None]:
            if run and q != run[-1] + 1:
                out.add((i, run[0] + 1, run[-1] + 1))
                run = []
            if q is not None:
                run.append(q)
    return out


@pytest.mark.parametrize("length", [16, 37, 64])
def test_shared_spans(spark, few_heavy, length):
    rng = random.Random(length)
    core = ["".join(rng.choices("ACGT", k=rng.randint(length - 2, 2 * length))) for _ in range(4)]
    records = {f"r{i}": "".join(x for _ in range(3) for x in (rng.choice(core), "".join(rng.choices("ACGTN", k=rng.randint(0, 9))))) for i in range(12)}
    records |= {"poly1": "A" * 300, "poly2": "A" * 90, "short": "ACG", "own": "".join(rng.choices("ACGT", k=99)) * 2, "empty": ""}
    df = spark.createDataFrame(list(records.items()), "record_id string, letters string")
    assert {tuple(r) for r in shared_spans(df, length).collect()} == brute_spans(records, length)
    amounts = {r[0]: r[2] for r in shared_amounts(df, length).collect()}
    assert set(amounts) == set(records) and amounts["poly1"] == 300 and amounts["short"] == amounts["own"] == 0


def test_first_in_window():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 17, 49, 60):
        order = rng.integers(0, 9, 60).astype(np.uint64)
        assert _first_in_window(order, size).tolist() == [i + int(order[i : i + size].argmin()) for i in range(60 - size + 1)]


def test_record_letters(spark):
    a = spark.createDataFrame([("x", "ac-g", 1), ("x", "ACG", 2), (None, "A", 3), ("y", None, 4), ("z", "aé|-", 5), ("v", "A", 6)], "id string, s string, letters int")
    b = spark.createDataFrame([("x", "ACG"), ("v", "C"), ("w", "")], "id string, t string")
    assert {tuple(r) for r in record_letters((a, "id", "s"), (b, "id", "t")).collect()} == {("x", "ACG"), ("z", "ANN"), ("v", "A|C"), ("w", "")}
    one, two = "ACGT" * 5, "GATTACA" * 3
    versions = spark.createDataFrame([("p", "TTT" + one + "|" + "C" + two), ("q", two)], "record_id string, letters string")
    assert {tuple(r) for r in shared_spans(versions, 16).collect()} == {("p", 2, 22), ("q", 1, 21)}
    assert shared_spans(versions.limit(0), 64).count() == 0


# ---- top items

def brute_top(rows, n):
    best: dict = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and abs(s) < float("inf"):
            best.setdefault(g, {})[i] = max(best.get(g, {}).get(i, -1e999), s)
    return {(g, i) for g, items in best.items() for i in sorted(items, key=lambda i: (-items[i], i.encode()))[:n]}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_items(spark, few_heavy, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(6)}", f"item-{rng.randrange(90)}", rng.choice([1.5, -2.0, 0.0, -0.0, 3.0, rng.uniform(-1e3, 1e3), 1e-320, 1e300])) for _ in range(500)]
    rows += [("ties", f"a{'b' * k}{c}", 7.0) for k in (0, 3, 9, 20) for c in ("", "x", "é", "\0", "\0\0")]
    rows += [(None, "i", 1.0), ("g0", None, 1.0), ("g1", "i", None), ("g2", "i", float("nan")), ("g3", "i", float("inf")), ("g4", "", 2000.0)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "query string, subject string, score double, _g string")
    found = [(r[0], r[1]) for r in top_items(df, "query", "subject", "score", n).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_top(rows, n)


def test_top_items_empty(spark):
    assert top_items(spark.createDataFrame([], "a string, b string, c double"), "a", "b", "c", 5).count() == 0


# ---- groups

def test_groups(spark, few_heavy):
    rng = random.Random(3)
    rows = [(rng.randrange(60), f"k{rng.randrange(70)}") for _ in range(90)] + [(i, "hub") for i in range(70, 90)] + [(None, "hub"), (5, None), (99, "alone")]
    links: dict[int, set[int]] = {}
    by: dict[str, set[int]] = {}
    for r, k in rows:
        if r is not None and k is not None:
            by.setdefault(k, set()).add(r)
    for members in by.values():
        if len(members) > 1:
            joined = set().union(*(links.get(m, {m}) for m in members))
            for m in joined:
                links[m] = joined
    expected = {(min(g), m) for m, g in links.items()}
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec int, k string, node int")
    assert {tuple(r) for r in consolidate_by_key(df, "rec", "k").collect()} == expected
    assert consolidate_pairs(spark.createDataFrame([(1, 1), (None, 2)], "a int, b int"), "a", "b").count() == 0


def test_kmer_groups(spark):
    rows = [("ACG", 2), ("acg", 7), ("ANG", 3), ("ANG", 4), ("", 5), ("", 6), (None, 8), ("TTT", 7), ("TTT", 1), ("GG", 0), ("GG", 9), ("ACG\n", 11)]
    found = kmer_groups(spark.createDataFrame(rows, "kmer string, msaindex bigint"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (1, 2), (1, 7)}


# ---- tokens and packing

def test_tokens(spark):
    rng = random.Random(1)
    texts = ["", None, "a\n\nb", " \n x\n\n\n  y\n", "\n\na", "a\r\nb\n\tc \n d", "''x'' <ref>\n* é\n" * 50] + ["".join(rng.choices("ab \n\t1.", k=60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    encode = _encoding(TOKENIZER).encode_ordinary
    assert {r["doc"]: r["tokens"] for r in token_counts(df, "text", ["doc"]).collect()} == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_bounds_and_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 17, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 30))]
        places = best_fit_decreasing(sizes, capacity)
        load = Counter()
        for s, p in zip(sizes, places, strict=True):
            load[p] += s
        assert max(load.values()) <= capacity
        assert container_bound(np.array(sizes), capacity) <= len(load)
        different, times = np.unique(sizes, return_counts=True)
        assert container_bound(different, capacity, times) == container_bound(np.array(sizes), capacity)
    assert container_bound(np.array([6, 6, 6]), 10) == 3 and container_bound(np.array([], dtype=int), 10) == 0


@pytest.mark.parametrize("part_items", [7, 1000])
def test_packing(spark, part_items):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 5, 33, 64, 65, 200, rng.randint(1, 150)]) for i in range(150)}
    rows = [(i, s, "x") for i, s in sizes.items()] + [(1000, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, n bigint, pack_id string")
    found = pack_items(df, "id", "n", {1: 64, 2: 500}, part_items=part_items).collect()
    for pack, capacity in ((1, 64), (2, 500)):
        mine = [r for r in found if r["pack_id"] == pack]
        total, load = Counter(), Counter()
        for r in mine:
            total[r["id"]] += r["piece_tokens"]
            load[r["container_id"]] += r["piece_tokens"]
        assert dict(total) == {**sizes, 1000: 0}
        assert all(load[r["container_id"]] + r["unused_tokens"] == capacity for r in mine)
        cut = {i for i, n in Counter(r["id"] for r in mine).items() if n > 1}
        assert cut == {i for i, s in sizes.items() if s > capacity}
        if part_items == 1000:
            assert len(load) <= 1.02 * container_bound(np.array([min(s - k, capacity) for s in sizes.values() for k in range(0, s, capacity)]), capacity) + 1
    assert pack_items(df.limit(0), "id", "n", {1: 64}).count() == 0


# ---- mixing

def test_route():
    targets = {"a": Target(0.5, 1), "b": Target(0.5, 4)}
    total, flow = route({("a",): 100, ("b",): 20, ("a", "b"): 10}, targets)
    assert total == 130 and flow[("a",), "a"] + flow[("a", "b"), "a"] == 65 and flow[("b",), "b"] + flow[("a", "b"), "b"] == 65
    assert flow[("a", "b"), "b"] + flow[("a", "b"), "a"] <= 10
    assert route({("b",): 10}, targets)[0] <= 1
    assert route({}, targets)[0] == 0


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, f"text {i}", rng.choice(["A", " a", "b", "c"]), rng.randint(1, 60)) for i in range(600)]
    rows += [(1000 + i, f"text {i}", "B ", rows[i][3]) for i in range(100)] + [(2000, None, "a", 0), (2001, "", "b", 0), (2002, "odd", None, 5), (2003, "odd", "other", 5)]
    df = spark.createDataFrame(rows, "doc bigint, text string, source string, tokens bigint").withColumn("print", fingerprint("text"))
    targets = {"a": Target(0.2, 1), "b": Target(0.5, 3), "c": Target(0.3, 2)}
    mix = mix_sources(df, targets, "doc", "print", "source", "tokens", seed=1)
    used = mix.collect()
    assert sorted(map(tuple, used)) == sorted(map(tuple, mix_sources(df.repartition(5), targets, "doc", "print", "source", "tokens", seed=1).collect()))
    text = {r[0]: r[1] for r in rows}
    home = {}
    for r in rows:
        if r[2] and r[2].strip().lower() in targets:
            home.setdefault(r[1], set()).add(r[2].strip().lower())
    times = Counter()
    for r in used:
        assert r["source"] in home[text[r["doc"]]]
        times[text[r["doc"]]] += r["repeats"]
    assert all(n <= min(targets[s].repeats for s in home[t]) for t, n in times.items())
    table = spark.createDataFrame([("A ", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    for r in mix_shares(mix, table).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.02
    assert mix_sources(df.limit(0), targets, "doc", "print", "source", "tokens").count() == 0
