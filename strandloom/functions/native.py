"""Compiled kernels (kernels.rs, built into kernels.so for x86-64 with AVX2); where they can't be loaded, numpy does the same."""

from __future__ import annotations

import ctypes
import tempfile
from functools import lru_cache
from importlib import resources
from pathlib import Path

import numpy as np

from .alignment import CELLS, _counts, _fits_short, ends_of_many
from .alignment import local_paths as traced_paths

#: Pairs that are traced together, and bytes for their operations at a time.
TRACED, ROOM = 4096, 1 << 22


@lru_cache(1)
def library() -> ctypes.CDLL | None:
    """The compiled kernels, or None where the machine can't run them."""
    try:
        found = resources.files(__package__) / "kernels.so"
        if isinstance(found, Path):
            lib = ctypes.CDLL(str(found))
        else:  # the package is read from an archive
            with tempfile.NamedTemporaryFile(suffix=".so") as file:
                file.write(found.read_bytes())
                file.flush()
                lib = ctypes.CDLL(file.name)
        if not lib.usable():
            return None
    except (OSError, AttributeError):
        return None
    lib.local_paths.restype = lib.shared_words.restype = ctypes.c_int64
    return lib


def _at(array: np.ndarray) -> ctypes.c_void_p:
    return array.ctypes.data_as(ctypes.c_void_p)


class Texts:
    """ASCII texts as one array of codes, a letter that is no amino acid between them."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, odd: dict[int, str]):
        self.codes, self.starts, self.lengths, self.odd = codes, starts, lengths, odd

    @staticmethod
    def of(texts: list[str]) -> Texts:
        lengths = np.array([len(t) for t in texts], np.int32)
        starts = np.cumsum(lengths + 1, dtype=np.int64) - lengths - 1
        joined = "\n".join(texts)
        odd = {} if joined.isascii() else {k: t for k, t in enumerate(texts) if not t.isascii()}
        return Texts(np.frombuffer((joined + "\n").encode("ascii", "replace"), np.uint8), starts, lengths, odd)

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, k: int) -> str:
        return self.part(k, 0, int(self.lengths[k]))

    def part(self, k: int, first: int, last: int) -> str:
        """Letters first .. last - 1 (from 0) of text k."""
        if k in self.odd:
            return self.odd[k][first:last]
        return self.codes[self.starts[k] + first : self.starts[k] + last].tobytes().decode()


class Pairs:
    """Local alignments of pairs of two lists of texts, in upper case, with one matrix and one kind of gap costs."""

    def __init__(self, a: Texts, b: Texts, table: np.ndarray, gap_open: int, gap_extend: int):
        self.a, self.b, self.costs, self.table = a, b, (gap_open, gap_extend), np.ascontiguousarray(table, np.int32)
        fits = 0 < table.max() <= 1000 and table.min() >= -1000 and gap_open >= 0 and gap_extend >= 0 and 0 < gap_open + gap_extend <= 1000
        self.lib = library() if fits else None
        self.numbers = (int(table.max()), gap_open, gap_extend, int(_fits_short(table, gap_open, gap_extend)))

    def _sides(self, i: np.ndarray, j: np.ndarray) -> tuple[list[np.ndarray], list]:
        held = [self.a.codes, self.a.starts[i], self.a.lengths[i], self.b.codes, self.b.starts[j], self.b.lengths[j], self.table]
        return held, [_at(x) for x in held]

    def _odd(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not (self.a.odd or self.b.odd):
            return np.zeros(len(i), bool)
        return np.isin(i, list(self.a.odd)) | np.isin(j, list(self.b.odd))

    def ends(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """:func:`ends_of_many` of texts i of the one and j of the other list; equal j best after each other."""
        out = np.full((len(i), 3), -1, np.int32)
        if self.lib and len(i):
            held, sides = self._sides(i, j)
            self.lib.local_ends(ctypes.c_int64(len(i)), *sides, *self.numbers, _at(out))
            out[self._odd(i, j), 0] = -1
            del held
        if (left := np.flatnonzero(out[:, 0] < 0)).size:
            out[left] = ends_of_many([self.a[k] for k in i[left]], [self.b[k] for k in j[left]], self.table, *self.costs)
        return out

    def paths(self, i: np.ndarray, j: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Matches, mismatches, insertions, deletions, first and last letters in both (n x 8) and operations of the alignments that local :func:`align_paths` chooses."""
        out, cigars = np.full((len(i), 8), -1, np.int32), [""] * len(i)
        if self.lib:
            room = ROOM
            at = 0
            while at < len(i):
                part = slice(at, at + TRACED)
                held, sides = self._sides(i[part], j[part])
                text, ops, known, found = np.empty(room, np.uint8), np.zeros(len(held[1]), np.int64), np.ascontiguousarray(ends[part], np.int32), np.zeros((len(held[1]), 8), np.int32)
                done = self.lib.local_paths(ctypes.c_int64(len(ops)), *sides, *self.numbers, _at(known), ctypes.c_int64(CELLS), _at(found), _at(text), ctypes.c_int64(room), _at(ops))
                out[at : at + done] = found[:done]
                letters, begin = text.tobytes().decode("ascii", "replace") if done else "", 0
                for k, end in enumerate(ops[:done].tolist()):
                    cigars[at + k] = letters[begin:end]
                    begin = max(begin, end)
                at += done
                room = ROOM if done else 2 * room
            out[self._odd(i, j), 0] = -1
        if (left := np.flatnonzero(out[:, 0] < 0)).size:
            x, y = [self.a[k] for k in i[left]], [self.b[k] for k in j[left]]
            for k, s, t, (_, first, last, begin, end, cigar) in zip(left, x, y, traced_paths(x, y, self.table, *self.costs, ends[left].astype(np.int64)), strict=True):
                out[k], cigars[k] = (*_counts(s, t, first, begin, cigar), first, last, begin, end), cigar
        return out, cigars


class Words:
    """Words of texts (numbers by place, -1 for none) by which places of the same words in other texts are found."""

    MARK_BITS = 26

    def __init__(self, codes: np.ndarray, size: int, base: int):
        self.codes, self.size, self.base, self.lib = np.ascontiguousarray(codes, np.int64), size, base, library()
        if self.lib:
            self.bits = max(4, min(28, len(codes).bit_length()))
            self.heads, self.next = np.full(1 << self.bits, -1, np.int32), np.empty(len(codes), np.int32)
            self.marks = np.zeros(1 << (self.MARK_BITS - 3), np.uint8)
            self.lib.index_words(_at(self.codes), ctypes.c_int64(len(codes)), self.bits, _at(self.heads), _at(self.next), self.MARK_BITS, _at(self.marks))
        else:
            self.order = np.argsort(self.codes, kind="stable")
            self.sorted = self.codes[self.order]

    def shared(self, letters: np.ndarray, room: int = 1 << 22):
        """Pairs of places (mine, in ``letters``) with the same word, up to ``room`` of them at a time; letters are values below ``base``, -1 for none."""
        if not self.lib:
            yield from self._joined(letters, room)
            return
        state, n = np.array([0, -2], np.int64), ctypes.c_int64(len(letters))
        letters = np.ascontiguousarray(letters, np.int8)
        while state[0] < len(letters):
            mine, theirs = np.empty(room, np.int32), np.empty(room, np.int64)
            found = self.lib.shared_words(
                _at(letters), n, ctypes.c_int64(self.size), ctypes.c_int64(self.base), _at(self.codes), self.bits, _at(self.heads), _at(self.next), self.MARK_BITS, _at(self.marks),
                _at(state), ctypes.c_int64(room), _at(mine), _at(theirs),
            )
            yield mine[:found].astype(np.int64), theirs[:found]

    def _joined(self, letters: np.ndarray, room: int, step: int = 1 << 20):
        for at in range(0, len(letters), step):
            codes = word_numbers(letters[at : at + step + self.size - 1], self.size, self.base)
            places = np.flatnonzero(codes >= 0)
            low, high = (np.searchsorted(self.sorted, codes[places], side) for side in ("left", "right"))
            counts = high - low
            ends = np.cumsum(counts)
            for first in range(0, int(ends[-1]) if len(ends) else 0, room):
                no = np.arange(first, min(first + room, int(ends[-1])))
                row = np.searchsorted(ends, no, "right")
                yield self.order[low[row] + no - (ends[row] - counts[row])], places[row] + at


def word_numbers(letters: np.ndarray, size: int, base: int, different: int = 1) -> np.ndarray:
    """Words of ``size`` letters (values below ``base``, -1 for none) as numbers by their first places; -1 for those with none or fewer than ``different`` letters."""
    count = max(0, len(letters) - size + 1)
    code, known, kinds = np.zeros(count, np.int64), np.ones(count, bool), np.zeros(count, np.int8)
    for k in range(size):
        part = letters[k : k + count]
        code *= base
        code += part
        known &= part >= 0
        if different > 1:
            new = np.ones(count, bool)
            for m in range(k):
                new &= letters[m : m + count] != part
            kinds += new
    if different > 1:
        known &= kinds >= different
    code[~known] = -1
    return code
