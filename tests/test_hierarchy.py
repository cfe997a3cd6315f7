from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators.components import connected_components
from strandloom.operators.hierarchy import hierarchy_descendants, hierarchy_paths, links

SCHEMA = "id string, parent array<string>, node string, component int"


def brute(rows):
    nodes = {i for i, _ in rows if i is not None}
    up = {n: set() for n in nodes}
    for i, ps in rows:
        if i is not None:
            up[i] |= {q.strip() for p in ps or [] if p is not None for q in p.split(",") if q.strip() in nodes}

    def above(n):
        seen, stack = set(), list(up[n])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += up[x]
        return seen

    over = {n: above(n) for n in nodes}
    cyclic = {n for n in nodes if n in over[n]}
    out = set()

    def paths(n):
        return [[n]] if not up[n] else [p + [n] for q in up[n] for p in paths(q)]

    for n in nodes:
        if n in cyclic:
            out.add((n, "", -1, ""))
        elif over[n] & cyclic:
            out.add((n, "", -2, ""))
        else:
            out |= {(n, p[0], len(p) - 1, "/".join(p)) for p in paths(n)}
    return out, {(a, n) for n in nodes for a in over[n]}


def check(spark, rows, **more):
    nodes, between = links(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    paths, below = brute(rows)
    found = [tuple(r) for r in hierarchy_paths(nodes, between, **more).collect()]
    assert sorted(found) == sorted(paths)
    found = [tuple(r) for r in hierarchy_descendants(nodes, between, **more).collect()]
    assert sorted(found) == sorted(below)


ROWS = [
    ("a", None), ("b", ["a"]), ("c", [" a , b", "zz"]), ("c", ["a"]), ("d", ["c", None]), (None, ["a"]), ("x", ["z"]), ("y", ["x"]), ("z", ["y"]),
    ("w", ["z"]), ("v", ["w", "a"]), ("s", ["s"]), ("t", ["s"]), ("lone", []), ("m", ["n"]), ("n", ["m", "z"]),
]


def test_paths_cycles_and_dirty_parents(spark):
    check(spark, ROWS)


def test_large_components_are_walked_by_joins(spark):
    check(spark, ROWS, colocate=2)


def test_random_graph(spark, few_heavy):
    rng = random.Random(5)
    rows = [(f"n{i}", [f"n{rng.randrange(max(1, i))}" for _ in range(rng.choice([0, 1, 1, 2]))] if i % 7 else [f"n{rng.randrange(40)}"]) for i in range(40)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (None, 3), (4, 4), (5, 4)], [(i, i + 1) for i in range(40)] + [(99, i) for i in range(60, 90)]])
def test_components(spark, few_heavy, edges):
    groups: dict[int, set[int]] = {}
    for a, b in edges:
        if a is not None and b is not None:
            joined = groups.get(a, {a}) | groups.get(b, {b})
            for x in joined:
                groups[x] = joined
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {n: min(g) for n, g in groups.items()}


@pytest.mark.parametrize("colocate", [3, 12])
def test_large_random_graphs(spark, colocate):
    rng = random.Random(colocate)
    rows = [(f"n{i}", [f"n{rng.randrange(max(1, i))}" for _ in range(rng.choice([0, 1, 1, 1, 2]))] if i % 9 else [f"n{rng.randrange(50)}"]) for i in range(50)]
    rows += [(f"r{i}", [f"r{(i + 1) % 9}"]) for i in range(9)] + [("u", ["r3"]), ("v", ["u"]), ("w", ["v", "n1"]), ("w2", ["w"])]  # a ring of single parents and what hangs on it
    rows += [(f"t{i}", [f"t{i - 1}"] if i else ["t6"]) for i in range(9)] + [("t2", ["n3"])]  # a ring with a second entry, and a tail
    check(spark, rows, colocate=colocate)


def test_shares_of_a_large_result(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", [f"n{rng.randrange(max(0, i - 4), i)}" for _ in range(rng.choice([1, 1, 2]))] if i else []) for i in range(45)] + [("x", ["y"]), ("y", ["x"])]
    check(spark, rows, share=300)


def ladder(n):
    return [("r", [])] + [(f"{s}{i}", [f"a{i - 1}", f"b{i - 1}"] if i else ["r"]) for i in range(n) for s in "ab"]


def test_chain_star_and_ladder(spark):
    rows = [(f"c{i:05}", [f"c{i - 1:05}"] if i else []) for i in range(3000)] + [(f"s{i}", ["s"]) for i in range(1, 60_000)] + [("s", [])] + ladder(13)
    nodes, between = links(spark.createDataFrame(rows, "id string, parent array<string>"))
    found = hierarchy_paths(nodes, between, share=8 << 20)
    counts = {r["k"]: (r["n"], r["d"], r["l"]) for r in found.groupBy(F.left("root", F.lit(1)).alias("k")).agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max(F.length("path")).alias("l")).collect()}
    assert counts == {"c": (3000, 2999, 3000 * 7 - 1), "s": (60_000, 1, 8), "r": (2**14 - 1, 13, counts["r"][2])}
    assert hierarchy_descendants(nodes, between, share=1 << 20).count() == 3000 * 2999 // 2 + 59_999 + 26 + sum(4 * (12 - i) for i in range(13))


def test_long_chains_beyond_a_task(spark):
    rows = [(f"c{i:03}", [f"c{i - 1:03}"] if i else []) for i in range(300)] + [(f"k{i:03}", [f"k{i - 1:03}"] if i else ["k199"]) for i in range(250)] + [("k000", ["c007"])]
    nodes, between = links(spark.createDataFrame(rows, "id string, parent array<string>"))
    depths = {r["id"]: r["depth"] for r in hierarchy_paths(nodes, between, colocate=10).collect()}
    assert depths == {f"c{i:03}": i for i in range(300)} | {f"k{i:03}": -1 if i < 200 else -2 for i in range(250)}
