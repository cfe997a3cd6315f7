from __future__ import annotations

import random

from strandloom.operators.periods import covered_periods, periods_and_gaps

SCHEMA = "subject string, a int, b int, _lo string, kind string"


def brute(rows):
    cells: dict[str, set[int]] = {}
    for s, a, b in rows:
        if s is not None and a is not None and b is not None and min(a, b) >= 1:
            cells.setdefault(s, set()).update(range(min(a, b), max(a, b) + 1))
    out = set()
    for s, c in cells.items():
        runs = []
        for p in sorted(c):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out |= {(s, "period", a, b) for a, b in runs}
        out |= {(s, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:], strict=False)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return [tuple(r) for r in periods_and_gaps(df, "subject", "a", "b", **more).collect()]


def test_touching_nested_and_dirty(spark):
    rows = [("s", 1, 10), ("s", 11, 20), ("s", 30, 25), ("s", 26, 27), ("s", 22, 22), ("t", 5, 5), ("t", 5, 5), (None, 1, 2), ("u", None, 3), ("u", 0, 3), ("u", -4, -2)]
    found = run(spark, rows)
    assert set(found) == brute(rows) and len(found) == len(set(found))
    assert ("s", "period", 1, 20) in found and ("s", "gap", 21, 21) in found


def test_random(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(9)}", rng.randint(-1, 300), rng.randint(-1, 300)) for _ in range(60)]
    rows = [(s, a, min(b, a + 12)) for s, a, b in rows]
    assert set(run(spark, rows)) == brute(rows)


def test_across_blocks(spark):
    rows = [("s", 1, 5), ("s", 4, 14), ("s", 15, 15), ("s", 40, 41)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert [tuple(r) for r in covered_periods(df, "subject", "a", "b", block=4).orderBy("first_pos").collect()] == [("s", 1, 15), ("s", 40, 41)]


def test_empty(spark):
    assert run(spark, []) == []


def test_far_positions(spark):
    rows = [("s", 2**31 - 5, 2**31 + 10), ("s", 2**31 + 11, 2**36), ("s", 10**11 - 3, 10**11), ("s", 5, 10**11 + 1)]
    df = spark.createDataFrame(rows, "subject string, a bigint, b bigint")
    found = {tuple(r)[1:] for r in periods_and_gaps(df, "subject", "a", "b").collect()}
    assert found == {("period", 2**31 - 5, 2**36), ("gap", 2**36 + 1, 10**11 - 4), ("period", 10**11 - 3, 10**11)}
