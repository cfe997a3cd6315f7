"""Pairwise alignment with affine gaps as vectorised functions of two text columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# BLOSUM62 (Henikoff & Henikoff 1992), lower triangle, rows and columns in this order.
_ORDER = "ARNDCQEGHILKMFPSTWYV"
_BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
GAP_OPEN, GAP_EXTEND = 11, 1
#: Pairs that are aligned together.
BATCH = 256


def blosum62() -> dict[tuple[str, str], int]:
    """Scores of amino acid pairs. Other letters: X scores -1, B and Z the mean of their two acids, '*' -4 (1 with itself)."""
    table = {}
    for a, line in zip(_ORDER, _BLOSUM62.split("\n")[1:], strict=False):
        for b, v in zip(_ORDER, line.split(), strict=False):
            table[a, b] = table[b, a] = int(v)
    for extra, parts in (("B", "ND"), ("Z", "QE")):
        for b in _ORDER:
            table[extra, b] = table[b, extra] = round((table[parts[0], b] + table[parts[1], b]) / 2)
    for a in ("B", "Z"):
        for b in ("B", "Z"):
            table[a, b] = 4 if a == b else 1
    letters = _ORDER + "BZ"
    for b in letters + "X":
        table["X", b] = table[b, "X"] = -1
        table["*", b] = table[b, "*"] = -4
    table["*", "*"] = 1
    return table


def read_matrix(path: str) -> dict[tuple[str, str], int]:
    """A substitution matrix from text in NCBI form: comments with '#', a line of letters, then a line for each letter."""
    rows = [line.split() for line in Path(path).read_text().splitlines() if line.strip() and not line.startswith("#")]
    return {(r[0], c): int(v) for r in rows[1:] for c, v in zip(rows[0], r[1:], strict=True)}


def lookup(matrix: dict[tuple[str, str], int]) -> np.ndarray:
    """A matrix as a table by letter codes; pairs it doesn't list score its smallest value."""
    table = np.full((128, 128), min(matrix.values()), np.int32)
    for (a, b), v in matrix.items():
        table[ord(a), ord(b)] = v
    return table


_lookup = lookup


def _codes(texts: list[str]) -> np.ndarray:
    width = max(map(len, texts), default=0)
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.upper().encode("ascii", "replace"), np.uint8) & 127
    return out


def align_batch(a: list[str], b: list[str], table: np.ndarray, local: bool, gap_open: int, gap_extend: int) -> np.ndarray:
    """Best scores with the equal, different, inserted and deleted letters of one best alignment of each pair (n x 5).

    Gotoh's recursion, a row of all pairs at a time. A cell's number holds its score and, in lower digits, the counts
    of the alignment that leads to it, so that one comparison settles both: of equally good alignments the one with
    most equal, then most different, inserted and deleted letters wins. A gap of n letters costs open + n x extend.
    Counts of more than 2,000 letters don't fit into the number; such batches are traced (:func:`align_paths`), and of
    alignments with as many equal letters one is taken.
    """
    if max(map(len, [*a, *b]), default=0) > 2000:
        paths = align_paths(a, b, table, local, gap_open, gap_extend)
        return np.array([(p[0], *_counts(x.upper(), y.upper(), p[1], p[3], p[5])) for x, y, p in zip(a, b, paths, strict=True)], np.int64)
    n, x, y = len(a), _codes(a), _codes(b)
    la, lb = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    bits, kind = 11, np.int64
    unit, equal, different, insert, delete = (1 << (4 * bits)), (1 << (3 * bits)), (1 << (2 * bits)), (1 << bits), 1
    scores = table.astype(kind) * unit + different
    scores[np.arange(128), np.arange(128)] += equal - different
    places = np.arange(y.shape[1] + 1).astype(kind)
    along = -gap_extend * unit + delete
    low = -(1 << 17) * unit
    row = np.zeros((n, y.shape[1] + 1), kind)
    if not local:
        row[:, 1:] = places[1:] * along - gap_open * unit
    up = np.full_like(row, low)
    best = row[np.arange(n), lb] if not local else row[:, 0].copy()
    for i in range(1, x.shape[1] + 1):
        up = np.maximum(row - gap_open * unit, up) - gap_extend * unit + insert
        cell = np.empty_like(row)
        cell[:, 1:] = np.maximum(row[:, :-1] + scores[x[:, i - 1][:, None], y], up[:, 1:])
        cell[:, 0] = up[:, 0]
        if local:
            cell = np.maximum(cell, 0)
        run = np.maximum.accumulate(cell - places * along, axis=1)
        cell[:, 1:] = np.maximum(cell[:, 1:], run[:, :-1] + places[1:] * along - gap_open * unit)
        row = cell
        if local:
            best = np.maximum(best, np.where(i <= la, row.max(axis=1), 0))
        else:
            best = np.where(i == la, row[np.arange(n), lb], best)
    out = np.zeros((n, 5), np.int64)
    for j in range(4, 0, -1):
        out[:, j] = (best % (1 << bits)).astype(np.int64)
        best = best // (1 << bits)
    out[:, 0] = best.astype(np.int64)
    return out


_RESULT = "score int, matches int, mismatches int, insertions int, deletions int"


def aligned_pair(query: Column, reference: Column, local: bool = False, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, matrix: dict | None = None) -> Column:
    """Score and counts of the best global or local alignment of two sequences, as a struct; null if one is null."""
    table = lookup(matrix or blosum62())

    @F.pandas_udf(_RESULT)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(a), 5), np.int32)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        x, y = a.iloc[known].tolist(), b.iloc[known].tolist()
        if local:
            windows = local_windows(x, y, table, gap_open, gap_extend)
            x, y = [t[i - 1 : j] for t, (i, j, *_) in zip(x, windows, strict=True)], [t[i - 1 : j] for t, (*_, i, j) in zip(y, windows, strict=True)]
        rows, columns = (np.array([len(t) for t in texts], np.int64) for texts in (x, y))
        order = np.lexsort((columns, rows // 64))  # like sizes together, as all are filled up to the longest
        for part in np.array_split(order, -(-len(order) // BATCH)) if len(order) else []:
            out[known[part]] = align_batch([x[k] for k in part], [y[k] for k in part], table, local, gap_open, gap_extend)
        frame = pd.DataFrame(out, columns=["score", "matches", "mismatches", "insertions", "deletions"]).astype("Int32")
        frame[(a.isna() | b.isna()).to_numpy()] = pd.NA
        return frame

    return align(query, reference)


#: Cells whose directions a task keeps at a time; more are traced in blocks of rows, each filled a second time.
CELLS = 1 << 25
_DIAGONAL, _UP, _LEFT, _UP_ON, _LEFT_ON = 1, 2, 3, 4, 8
_EQUAL = 1 << 20  # a cell's number: score, then the equal letters of the alignment that leads to it


class _Rows:
    """Gotoh's recursion over a batch of pairs, a row of all pairs at a time."""

    def __init__(self, a: list[str], b: list[str], table: np.ndarray, local: bool, gap_open: int, gap_extend: int):
        self.x, self.y, self.local = _codes(a), _codes(b), local
        self.scores = table.astype(np.int64) * _EQUAL
        self.scores[np.arange(128), np.arange(128)] += 1
        self.open, self.extend = gap_open * _EQUAL, gap_extend * _EQUAL
        self.places = np.arange(self.y.shape[1] + 1, dtype=np.int64) * self.extend

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.zeros((len(self.x), self.y.shape[1] + 1), np.int64)
        if not self.local:
            row[:, 1:] = -self.places[1:] - self.open
        return row, np.full_like(row, -(1 << 60))

    def next(self, i: int, row: np.ndarray, up: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row i from the row before; ``kept`` takes where each cell comes from."""
        opened = row - self.open
        on = up > opened
        up = np.maximum(opened, up) - self.extend
        cell = up.copy()
        straight = row[:, :-1] + self.scores[self.x[:, i - 1][:, None], self.y]
        cell[:, 1:] = np.maximum(straight, up[:, 1:])
        if self.local:
            cell = np.maximum(cell, 0)
        level = cell + self.places
        run = np.maximum.accumulate(level, axis=1)
        left = run[:, :-1] - self.places[1:] - self.open
        out = cell.copy()
        out[:, 1:] = np.maximum(cell[:, 1:], left)
        if kept is not None:
            kept[:] = np.where(out == up, _UP, 0)
            kept[:, 1:] = np.where(out[:, 1:] == straight, _DIAGONAL, np.where(left > cell[:, 1:], _LEFT, kept[:, 1:]))
            if self.local:
                kept[out == 0] = 0
            kept |= np.where(on, _UP_ON, 0).astype(np.uint8)
            kept[:, 1:] |= np.where(run[:, :-1] > level[:, :-1], _LEFT_ON, 0).astype(np.uint8)
        return out, up


def align_paths(a: list[str], b: list[str], table: np.ndarray, local: bool, gap_open: int, gap_extend: int, cells: int = CELLS) -> list[tuple]:
    """The best alignment of each pair: score, first and last letter of a, first and last letter of b (from 1), operations.

    Operations are M, I (a letter of a alone) and D (of b alone). Of equally good alignments one with most equal
    letters is taken, a local one that ends first in a. A local alignment without a positive score is empty, with
    zeros for places.
    """
    rows = _Rows(a, b, table, local, gap_open, gap_extend)
    n, high, wide = len(a), rows.x.shape[1], rows.y.shape[1] + 1
    la, lb = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
    block = max(1, min(high, cells // max(1, n * wide)))
    row, up = rows.start()
    best = np.where(la == 0, row[np.arange(n), lb], 0) if not local else np.zeros(n, np.int64)
    end = np.stack([la, lb], axis=1) if not local else np.zeros((n, 2), np.int64)
    states, kept = [], np.zeros((block, n, wide), np.uint8)
    for i in range(1, high + 1):
        if (i - 1) % block == 0:
            states.append((row, up))
        row, up = rows.next(i, row, up, kept[(i - 1) % block] if high <= block else None)
        if local:
            top = row.max(axis=1)
            better = (top > best) & (i <= la)
            best = np.where(better, top, best)
            end[better] = np.stack([np.full(n, i), row.argmax(axis=1)], axis=1)[better]
        else:
            best = np.where(i == la, row[np.arange(n), lb], best)
    at = [[int(i), int(j), 0] for i, j in end]
    steps: list[list[str]] = [[] for _ in range(n)]
    for no in range(len(states) - 1, -1, -1):
        first = no * block + 1
        if high > block:
            row, up = states[no]
            for i in range(first, min(first + block, high + 1)):
                row, up = rows.next(i, row, up, kept[i - first])
        for k in range(n):
            _trace(kept[:, k], first, at[k], steps[k])
    out = []
    for k in range(n):
        i, j, _ = at[k]
        if not local:  # what is left runs along an edge
            steps[k] += ["I"] * i + ["D"] * j
            i = j = 0
        if not steps[k]:
            out.append((int(best[k]) // _EQUAL, 0, 0, 0, 0, ""))
            continue
        cigar = "".join(f"{len(list(g))}{op}" for op, g in groupby(reversed(steps[k])))
        out.append((int(best[k]) // _EQUAL, i + 1, int(end[k][0]), j + 1, int(end[k][1]), cigar))
    return out


def _trace(kept: np.ndarray, first: int, at: list[int], steps: list[str]) -> None:
    """Go back from a cell (row, column, state) to the row before ``first``, or to where a local alignment begins."""
    i, j, state = at
    while i >= first and state >= 0:
        code = int(kept[i - first, j])
        state = state or code & 3
        if not state:  # a local alignment begins here
            state = -1
        elif state == _DIAGONAL:
            steps.append("M")
            i, j, state = i - 1, j - 1, 0
        elif state == _UP:
            steps.append("I")
            state = _UP if code & _UP_ON else 0
            i -= 1
        else:
            steps.append("D")
            state = _LEFT if code & _LEFT_ON else 0
            j -= 1
    at[:] = i, j, state


#: Pairs whose scores are found together, and letters of their references at most: a row of them fits into a core's cache.
SCORED, SCORED_LETTERS = 512, 1 << 18


#: Rows after which the short kernel looks for ends.
ROWS = 4


def _profiles(a: list[str], b: list[str], table: np.ndarray) -> tuple:
    """For pairs in falling order of a: their order and lengths, letters of a as rows of the profile, a row of pairs after the other, and for each reference and letter the scores along the reference."""
    known = [k for k in range(len(a)) if a[k] and b[k]]
    order = np.array(sorted(known, key=lambda k: -len(a[k])), np.int64)
    lengths, x = np.array([len(a[k]) for k in order], np.int64), _codes([a[k] for k in order])
    letters, x = np.unique(x, return_inverse=True)
    texts = {t: r for r, t in enumerate(dict.fromkeys(b[k] for k in order))}
    codes = _codes(list(texts))
    x = x.reshape(len(order), -1) + np.array([texts[b[k]] * len(letters) for k in order], np.int64)[:, None]

    def profile(kind: type, beyond: int, more: int) -> np.ndarray:
        """Scores and ``more``; before and after a reference, and in the last row, ``beyond``."""
        out = np.full((len(texts) * len(letters) + 1, codes.shape[1] + 1), beyond, kind)
        for t, r in texts.items():
            out[r * len(letters) : (r + 1) * len(letters), 1 : len(t) + 1] = table[letters][:, codes[r, : len(t)]] + more
        return out

    return order, lengths, np.ascontiguousarray(x.T), codes.shape[1], profile


def local_ends(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """Best local score of each pair, and letters of a and of b after which no alignment of that score ends (n x 3).

    Pairs are scored in numbers of 8 bits; those whose scores don't fit are scored again in larger ones.
    """
    step = max(1, SCORED_LETTERS // max(map(len, b), default=1)) if any(b) else len(b)
    if len(a) > step:
        return np.concatenate([local_ends(a[i : i + step], b[i : i + step], table, gap_open, gap_extend) for i in range(0, len(a), step)])
    out = np.zeros((len(a), 3), np.int64)
    again = np.array([bool(x and y) for x, y in zip(a, b, strict=True)], bool)
    if again.any() and _fits_short(table, gap_open, gap_extend):
        out, again = _short_ends(a, b, table, gap_open, gap_extend)
    if (left := np.flatnonzero(again)).size:
        out[left] = _wide_ends([a[k] for k in left], [b[k] for k in left], table, gap_open, gap_extend)
    return out


def _short_ends(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`local_ends` in 8 bits, and for which pairs they don't suffice. Ends in a are those of a few rows."""
    out, again = np.zeros((len(a), 3), np.int64), np.zeros(len(a), bool)
    order, lengths, x, wide, make = _profiles(a, b, table)
    limit, first_gap = 127 - int(table.max()), gap_open + gap_extend
    profile = make(np.int8, -limit, 0)
    n = len(order)
    row = np.zeros((n, wide + 1), np.int8)  # column 0 is the edge
    up = np.full_like(row, -first_gap)
    score, cell, one, two, highest, zero = (np.zeros_like(row) for _ in range(6))
    best, ends, over, began = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros(n, bool), n
    for i in range(1, int(lengths[0]) + 1):
        m = int(np.searchsorted(-lengths, -i, side="right"))
        h, e, s, c, p, q, t = (v[:m] for v in (row, up, score, cell, one, two, highest))
        np.take(profile, x[i - 1, :m], axis=0, out=s, mode="clip")
        np.add(h.ravel()[:-1], s.ravel()[1:], out=c.ravel()[1:])
        np.subtract(h, first_gap, out=p)
        np.subtract(e, gap_extend, out=e)
        np.maximum(e, p, out=e)
        np.maximum(c, e, out=c)
        np.maximum(c, zero[:m], out=c)  # an array, as a plain 0 is ten times slower
        c[:, 0] = 0
        top = int(c.max())
        if top > limit:  # these pairs score nothing any more
            many = np.flatnonzero(c.max(axis=1) > limit)
            over[many], c[many], e[many], x[i:, many] = True, 0, -first_gap, len(profile) - 1
            top = int(c.max())
        if (i - 1) % ROWS == 0:
            t[:] = c
            began = m
        else:
            np.maximum(t, c, out=t)
        if i % ROWS == 0 or i == lengths[0]:
            t = highest[:began]
            tops = t.max(axis=1)
            hit = np.flatnonzero((tops >= best[:began]) & (tops > 0))
            if len(hit):
                v = tops[hit]
                last = wide - (t[hit] == v[:, None])[:, ::-1].argmax(axis=1)
                ends[hit, 1] = np.where(v > best[hit], last, np.maximum(last, ends[hit, 1]))
                ends[hit, 0] = np.minimum(i, lengths[hit])
                best[hit] = v
        reach = min(wide, (top - gap_open - 1) // gap_extend)
        if reach < 1:
            h[:] = c
            continue
        run, k = c, 1
        while k < reach:
            to = p if run is not p else q
            np.subtract(run.ravel()[:-k], k * gap_extend, out=to.ravel()[k:])
            np.maximum(run.ravel()[k:], to.ravel()[k:], out=to.ravel()[k:])
            to[:, :k] = run[:, :k]
            run, k = to, 2 * k
        to = p if run is not p else q
        np.subtract(run, first_gap, out=to)
        np.maximum(c.ravel()[1:], to.ravel()[:-1], out=h.ravel()[1:])
        h[:, 0] = 0
    out[order] = np.column_stack([best, ends])
    again[order] = over
    return out, again


def _wide_ends(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """:func:`local_ends` of pairs without empty texts in 16 bits or more.

    Cells are raised by gap_extend for each letter before them, so that a gap costs its opening alone. Pairs stand in
    falling order of a, so those that are through leave the rows. How far a gap can reach follows from the highest score.
    """
    out = np.zeros((len(a), 3), np.int64)
    order, lengths, x, wide, make = _profiles(a, b, table)
    n = len(order)
    most = int(min(lengths[0], wide)) * max(int(table.max()), 0) + int(lengths[0] + wide + 2) * gap_extend + gap_open - int(min(table.min(), 0))
    kind = np.int16 if most < 16000 else np.int32 if most < 1 << 29 else np.int64
    profile = make(kind, -most, 2 * gap_extend)
    level = (np.arange(wide + 1) * gap_extend).astype(kind)
    row = np.repeat(level[None], n, axis=0)
    up = np.full_like(row, -most)
    score, cell, one, two = (np.empty_like(row) for _ in range(4))
    best, ends, highest = np.zeros(n, kind), np.zeros((n, 2), np.int64), 0
    for i in range(1, int(lengths[0]) + 1):
        m = int(np.searchsorted(-lengths, -i, side="right"))
        h, e, s, c, p, q = (t[:m] for t in (row, up, score, cell, one, two))
        level += gap_extend
        np.take(profile, x[i - 1, :m], axis=0, out=s, mode="clip")
        np.add(h.ravel()[:-1], s.ravel()[1:], out=c.ravel()[1:])
        c[:, 0] = level[0]
        np.subtract(h, gap_open, out=p)
        np.maximum(e, p, out=e)
        np.maximum(c, e, out=c)
        np.maximum(c, level, out=c)
        np.subtract(c, level, out=p)
        top = p.max(axis=1)
        hit = np.flatnonzero((top >= best[:m]) & (top > 0))
        if len(hit):
            t = top[hit]
            last = wide - (p[hit] == t[:, None])[:, ::-1].argmax(axis=1)
            ends[hit, 1] = np.where(t > best[hit], last, np.maximum(last, ends[hit, 1]))
            ends[hit, 0] = i
            best[hit] = t
            highest = max(highest, int(t.max()))
        reach = min(wide, (highest - gap_open - 1) // gap_extend if gap_extend else wide)
        if reach < 1:
            h[:] = c
            continue
        run, k = c, 1
        while k < reach:
            to = p if run is not p else q
            np.maximum(run.ravel()[k:], run.ravel()[:-k], out=to.ravel()[k:])
            to[:, :k] = run[:, :k]
            run, k = to, 2 * k
        to = p if run is not p else q
        np.subtract(run, gap_open, out=to)
        np.maximum(c.ravel()[1:], to.ravel()[:-1], out=h.ravel()[1:])
        h[:, 0] = level[0]
    out[order] = np.column_stack([best, ends])
    return out


def ends_of_many(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """:func:`local_ends` of any number of pairs, references of like length and equal ones together."""
    out = np.zeros((len(a), 3), np.int64)
    order = np.array(sorted(range(len(a)), key=lambda k: (len(b[k]) // 16, b[k])), np.int64)
    for part in np.array_split(order, -(-len(order) // SCORED)) if len(order) else []:
        out[part] = local_ends([a[k] for k in part], [b[k] for k in part], table, gap_open, gap_extend)
    return out


#: Pairs that are scored side by side, as many bytes as a number holds; cells of a batch of them; pairs that must share a reference for it.
LANES, LANE_CELLS, SHARED = 8, 3 << 15, 64


def _fits_short(table: np.ndarray, gap_open: int, gap_extend: int) -> bool:
    """Whether numbers of 8 bits can hold the steps of a score."""
    return bool(0 < table.max() <= 40 and table.min() >= -100 and gap_extend >= 1 and 0 <= gap_open + 2 * gap_extend <= 100)


def scores_of_many(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """The scores of :func:`ends_of_many`. Pairs of a reference that many share stand in lanes of a kernel without scans for gaps."""
    out, known = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    by_reference: dict[str, list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            by_reference.setdefault(y, []).append(k)
        else:
            known[k] = True
    groups = []
    for y, pairs in by_reference.items() if _fits_short(table, gap_open, gap_extend) else ():
        if len(pairs) >= SHARED:
            pairs.sort(key=lambda k: -len(a[k]))
            groups += [(y, pairs[i : i + LANES]) for i in range(0, len(pairs), LANES)]
    like = lambda group: round(4 * np.log2(len(group[0])))
    groups.sort(key=lambda group: (like(group), -len(a[group[1][0]])))
    for _, alike in groupby(groups, key=like):
        alike, at = list(alike), 0
        while at < len(alike):
            part = alike[at : at + max(1, LANE_CELLS // (LANES * len(a[alike[at][1][0]])))]
            at += len(part)
            for (_, pairs), scores in zip(part, _lane_scores(part, a, table, gap_open, gap_extend), strict=True):
                out[pairs] = scores[: len(pairs)]
                known[pairs] = out[pairs] <= 127 - int(table.max())  # beyond, a lane may have left 8 bits
    if (left := np.flatnonzero(~known)).size:
        out[left] = ends_of_many([a[k] for k in left], [b[k] for k in left], table, gap_open, gap_extend)[:, 0]
    return out


def _lane_scores(groups: list[tuple[str, list[int]]], a: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """Best local scores in 8 bits of groups of up to LANES texts of ``a``, each group with its reference (groups x LANES).

    Row i stands at letter t - i of its reference in step t, so that both gaps come from the step before. Scores of a
    group's letters with a letter of the reference are one number. A lane that leaves 8 bits passes the limit first.
    """
    limit, first_gap = 127 - int(table.max()), gap_open + gap_extend
    text = lambda t: t.upper().encode("ascii", "replace")
    high, wide, n = max(len(a[pairs[0]]) for _, pairs in groups), max(len(y) for y, _ in groups), len(groups)
    width, cells = n * LANES, high * n
    size = high * width
    lanes = b"".join((text(a[pairs[k]]) if k < len(pairs) else b"").ljust(high, b"\x80") for _, pairs in groups for k in range(LANES))
    x = np.frombuffer(lanes, np.uint8).reshape(n, LANES, high).transpose(2, 0, 1).tobytes()
    references = [np.frombuffer(text(y), np.uint8) for y, _ in groups]
    letters = np.unique(np.concatenate(references))
    # the scores of all rows with each letter, behind room for the steps; past the ends of a text and of a reference none counts
    front = (wide + high) * n
    numbers = np.empty(front + (len(letters) + 1) * cells, np.int64)
    numbers[:front] = 0
    profile = numbers[front:].view(np.int8).reshape(-1, size)
    scores = np.full((128, 256), -limit, np.int8)
    scores[:, :128] = table
    for r, letter in enumerate(letters.tolist()):
        profile[r] = np.frombuffer(x.translate(scores[letter].tobytes()), np.int8)
    profile[-1] = -limit
    place = np.full((wide + 2 * high, n), len(letters) * cells, np.int64)
    for g, codes in enumerate(references):
        place[high : high + len(codes), g] = np.searchsorted(letters, codes) * cells
    place += np.arange(n) + (wide + 2 * high - np.arange(wide + 2 * high))[:, None] * n
    place = np.ascontiguousarray(place[::-1]).ravel()
    score = np.empty(size, np.int8)
    score_numbers = score.view(np.int64)
    rows = [np.zeros(size + width, np.int8) for _ in range(3)]  # of this step and the two before, each behind an edge
    insert = np.full(size, -first_gap, np.int8)
    delete, one, two = (np.full(size + width, -first_gap, np.int8) for _ in range(3))
    zero, best = np.zeros(size, np.int8), np.zeros(size, np.int8)
    first, further = np.array(first_gap, np.int8), np.array(gap_extend, np.int8)  # quicker than plain numbers
    for t in range(wide + high - 1):
        if t % 8 == 0:  # only rows that stand at a letter, with some beyond
            low, up = max(0, t - wide), min(high, t + 8)
            here, above = slice((low + 1) * width, (up + 1) * width), slice(low * width, up * width)
            s, s_numbers, e, z, top = score[above], score_numbers[low * n : up * n], insert[above], zero[above], best[above]
            f, f_above, opened, opened_above, longer_above = delete[here], delete[above], one[here], one[above], two[above]
            views = [(r[here], r[above]) for r in rows]
        start = (wide + high - 1 - t) * n
        np.take(numbers[t * n :], place[start + low * n : start + up * n], out=s_numbers, mode="clip")
        cell, last, before_last = views[t % 3][0], views[(t - 1) % 3][0], views[(t - 2) % 3][1]
        np.subtract(last, first, out=opened)
        np.subtract(f_above, further, out=longer_above)
        np.maximum(longer_above, opened_above, out=f)
        np.subtract(e, further, out=e)
        np.maximum(e, opened, out=e)
        np.add(before_last, s, out=cell)
        np.maximum(cell, e, out=cell)
        np.maximum(cell, f, out=cell)
        np.maximum(cell, z, out=cell)
        np.maximum(top, cell, out=top)
    return best.reshape(high, n, LANES).max(axis=0)


def local_windows(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int, ends: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """First and last letters of a and of b (from 1) between which all alignments of the best local score lie; ``ends`` are :func:`local_ends`, if known.

    An alignment of these pieces is one of the whole texts. Pairs without a positive score keep their whole texts.
    """
    ends = (ends_of_many(a, b, table, gap_open, gap_extend) if ends is None else ends).tolist()
    # read backwards from the last end, the best alignments end at the first letters
    backward = ends_of_many([x[:i][::-1] for x, (_, i, _) in zip(a, ends, strict=True)], [y[:j][::-1] for y, (_, _, j) in zip(b, ends, strict=True)], table, gap_open, gap_extend).tolist()
    return [(i - k + 1, i, j - m + 1, j) if top > 0 else (1, len(x), 1, len(y)) for x, y, (top, i, j), (_, k, m) in zip(a, b, ends, backward, strict=True)]


def local_paths(a: list[str], b: list[str], table: np.ndarray, gap_open: int, gap_extend: int, ends: np.ndarray | None = None) -> list[tuple]:
    """The same as local :func:`align_paths`, which gets only the letters between which the best alignments lie, and windows of like size together."""
    windows = local_windows(a, b, table, gap_open, gap_extend, ends)
    sizes = np.array([(ie - i + 1, je - j + 1) for i, ie, j, je in windows], np.float64).reshape(-1, 2)
    steps = np.ceil(np.log(np.maximum(sizes, 1)) * 4).astype(np.int64)
    out: list[tuple] = [()] * len(a)
    for _, alike in groupby(np.lexsort((steps[:, 1], steps[:, 0])).tolist(), key=lambda k: tuple(steps[k])):
        alike = list(alike)
        for at in range(0, len(alike), BATCH):
            part = alike[at : at + BATCH]
            x, y = [a[k][windows[k][0] - 1 : windows[k][1]] for k in part], [b[k][windows[k][2] - 1 : windows[k][3]] for k in part]
            for k, (score, i, ie, j, je, cigar) in zip(part, align_paths(x, y, table, True, gap_open, gap_extend), strict=True):
                before, left = (windows[k][0] - 1, windows[k][2] - 1) if score else (0, 0)
                out[k] = (score, i + before, ie + before, j + left, je + left, cigar)
    return out


_PATH = "score int, matches int, mismatches int, insertions int, deletions int, query_first int, query_last int, reference_first int, reference_last int, cigar string"


def aligned_path(query: Column, reference: Column, local: bool = False, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, matrix: dict | None = None, ends: Column | None = None) -> Column:
    """The best alignment of two sequences with its places and operations, as a struct; null if one sequence is null (see :func:`align_paths`).

    ``ends`` are those that :func:`scored_ends` gave for a local one.
    """
    table = lookup(matrix or blosum62())

    def align(a: pd.Series, b: pd.Series, known_ends: pd.DataFrame | None = None) -> pd.DataFrame:
        out: list[tuple] = [(None,) * 10] * len(a)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        sizes = np.array([(len(a.iloc[i]), len(b.iloc[i])) for i in known], np.int64).reshape(-1, 2)
        order = known[np.lexsort((sizes[:, 1], sizes[:, 0] // 64))]
        parts = [order] if local else np.array_split(order, -(-len(order) // BATCH))
        for part in parts if len(order) else []:
            x, y = a.iloc[part].tolist(), b.iloc[part].tolist()
            if local:
                paths = local_paths(x, y, table, gap_open, gap_extend, None if known_ends is None else known_ends.iloc[part].to_numpy(np.int64))
            else:
                paths = align_paths(x, y, table, False, gap_open, gap_extend)
            for k, m, n, (score, i, ie, j, je, cigar) in zip(part, x, y, paths, strict=True):
                out[k] = (score, *_counts(m.upper(), n.upper(), i, j, cigar), i, ie, j, je, cigar)
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _PATH.split(", ")])
        return frame.astype({c: "Int32" for c in frame.columns if c != "cigar"})

    if ends is None:

        @F.pandas_udf(_PATH)
        def alone(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return align(a, b)

        return alone(query, reference)

    @F.pandas_udf(_PATH)
    def ended(a: pd.Series, b: pd.Series, known_ends: pd.DataFrame) -> pd.DataFrame:
        return align(a, b, known_ends)

    return ended(query, reference, ends)


def scored_ends(query: Column, reference: Column, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, matrix: dict | None = None) -> Column:
    """The best local score of two sequences and where it ends, as a struct (see :func:`local_ends`)."""
    table = lookup(matrix or blosum62())

    @F.pandas_udf("score int, query_end int, reference_end int")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(ends_of_many(a.tolist(), b.tolist(), table, gap_open, gap_extend).astype(np.int32), columns=["score", "query_end", "reference_end"])

    return score(query, reference)


def best_score(query: Column, reference: Column, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, matrix: dict | None = None) -> Column:
    """The score of :func:`scored_ends`, quicker where pairs of one reference come together."""
    table = lookup(matrix or blosum62())

    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scores_of_many(a.tolist(), b.tolist(), table, gap_open, gap_extend).astype(np.int32))

    return score(query, reference)


def _counts(a: str, b: str, i: int, j: int, cigar: str) -> tuple[int, int, int, int]:
    """Equal, different, inserted and deleted letters of an alignment that begins at i and j."""
    counts = [0, 0, 0, 0]
    i, j, number = i - 1, j - 1, ""
    for c in cigar:
        if c.isdigit():
            number += c
            continue
        n, number = int(number), ""
        if c == "M":
            same = sum(p == q for p, q in zip(a[i : i + n], b[j : j + n], strict=True))
            counts[0] += same
            counts[1] += n - same
        counts[2] += n * (c == "I")
        counts[3] += n * (c == "D")
        i, j = i + n * (c != "D"), j + n * (c != "I")
    return tuple(counts)


#: Pairs of texts whose scores a task remembers; they are forgotten together when there are more.
REMEMBER = 100_000


def local_score(query: Column, reference: Column, matrix: dict | None = None, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> Column:
    """The score of the best local alignment, for many short and often equal texts: a task aligns equal pairs once. Null if one is null."""
    table = lookup(matrix or blosum62())

    @F.pandas_udf("int")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], int] = {}
        for a, b in batches:
            pairs = [None if x is None or y is None else (x.upper(), y.upper()) for x, y in zip(a, b, strict=True)]
            fresh = sorted({p for p in pairs if p is not None and p not in known}, key=lambda p: (len(p[0]) // 16, len(p[1])))
            for i in range(0, len(fresh), BATCH):
                part = fresh[i : i + BATCH]
                found = align_batch([p[0] for p in part], [p[1] for p in part], table, True, gap_open, gap_extend)
                known.update(zip(part, found[:, 0].tolist(), strict=True))
            yield pd.Series([None if p is None else known[p] for p in pairs], dtype="Int32")
            if len(known) > REMEMBER:
                known.clear()

    return score(query, reference)


def pair_scores(matrix: dict[tuple[str, str], int] | None = None) -> dict[str, int]:
    """A matrix as a map from two letters, for expressions."""
    return {a + b: v for (a, b), v in (matrix or blosum62()).items()}


# Allowed (open, extend) costs of each matrix, and its defaults.
GAP_COSTS = {
    "BLOSUM45": [(10, 3), (11, 3), (12, 3), (13, 3), (12, 2), (13, 2), (14, 2), (15, 2), (16, 2), (16, 1), (17, 1), (18, 1), (19, 1)],
    "BLOSUM50": [(9, 3), (10, 3), (11, 3), (12, 3), (13, 3), (12, 2), (13, 2), (14, 2), (15, 2), (16, 2), (15, 1), (16, 1), (17, 1), (18, 1), (19, 1)],
    "BLOSUM62": [(6, 2), (7, 2), (8, 2), (9, 2), (10, 2), (11, 1), (9, 1), (10, 1), (12, 1), (13, 1)],
    "BLOSUM80": [(6, 2), (7, 2), (8, 2), (9, 2), (9, 1), (10, 1), (11, 1), (13, 2), (25, 2)],
    "BLOSUM90": [(6, 2), (7, 2), (8, 2), (9, 2), (9, 1), (10, 1), (11, 1)],
    "PAM30": [(5, 2), (6, 2), (7, 2), (8, 1), (9, 1), (10, 1)],
    "PAM70": [(6, 2), (7, 2), (8, 2), (9, 1), (10, 1), (11, 1)],
    "PAM250": [(11, 3), (12, 3), (13, 3), (14, 3), (15, 3), (13, 2), (14, 2), (15, 2), (16, 2), (17, 2), (17, 1), (18, 1), (19, 1), (20, 1), (21, 1)],
}
GAP_DEFAULTS = {"BLOSUM45": (14, 2), "BLOSUM50": (13, 2), "BLOSUM62": (11, 1), "BLOSUM80": (10, 1), "BLOSUM90": (10, 1), "PAM30": (9, 1), "PAM70": (10, 1), "PAM250": (14, 2)}


def gap_costs(matrix: str = "BLOSUM62", gap_open: int | None = None, gap_extend: int | None = None) -> tuple[int, int]:
    """Costs for a matrix, signs dropped, defaults filled in; ValueError if the matrix does not allow them."""
    name = matrix.upper()
    if name not in GAP_COSTS:
        raise ValueError(f"unknown matrix {matrix}")
    costs = tuple(abs(given) if given is not None else default for given, default in zip((gap_open, gap_extend), GAP_DEFAULTS[name], strict=True))
    if costs not in GAP_COSTS[name]:
        raise ValueError(f"{name} does not allow gap costs {costs}")
    return costs
