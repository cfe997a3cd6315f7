"""Search of blocks of queries against all references inside one task: shared words, scores, the best references and their alignments, without a table of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.native import Pairs, Texts, Words, word_numbers

ACIDS = "ACDEFGHIKLMNPQRSTVWY"
_VALUE = np.full(128, -1, np.int8)
_VALUE[[ord(c) for c in ACIDS]] = range(len(ACIDS))
#: Letters of the queries that a task searches together; pairs that it scores, and rows that it gives, at a time.
LETTERS, SCORED, GIVEN = 1 << 23, 1 << 20, 1 << 13

SCORES = "_key bigint, frame int, subjectid string, seeds bigint, score int, _letters int"
ALIGNED = (
    "_key bigint, seq_id string, sequencedata string, frame int, subjectid string, seeds bigint, score int, _letters int, matches int, mismatches int, insertions int, deletions int, "
    "cigar string, translated_querysequence string, subjectsequence string, _qf int, _ql int, subjectstart int, subjectend int"
)


def references(rows: list[tuple[str, str]]) -> tuple:
    """Names and texts of references, in the order of the names' bytes, as they are sent to the tasks."""
    rows = sorted(rows, key=lambda r: r[0].encode())
    texts = Texts.of([r[1] for r in rows])
    return [r[0] for r in rows], texts.codes, texts.starts, texts.lengths, texts.odd


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counted(pair: np.ndarray, diagonal: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up for each pair and diagonal (0 <= diagonal < span), in their order."""
    if len(pair) and int(pair.max() + 1) * span < 1 << 62:
        both = pair * span + diagonal
        order = np.argsort(both)
    else:
        order = np.lexsort((diagonal, pair))
    pair, diagonal, counts = pair[order], diagonal[order], counts[order]
    at = _runs(pair, diagonal)
    return pair[at], diagonal[at], np.add.reduceat(counts, at) if len(at) else counts


def seeded(frames: Texts, row: np.ndarray, number: np.ndarray, refs: Texts, size: int, masking: bool, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a query and a reference that share words: the frame whose best diagonal has most of them, the reference and the words there.

    ``row`` and ``number`` are query and reading frame of each text of ``frames``; of equally good frames the one with the
    smaller absolute number is taken, then the forward one. Pairs with fewer than ``least`` words are left out.
    """
    words = Words(word_numbers(_VALUE[frames.codes], size, len(ACIDS), 3 if masking else 1), size, len(ACIDS))
    text_of = np.repeat(np.arange(len(frames), dtype=np.int32), frames.lengths + 1)
    most = int(frames.lengths.max(initial=0))
    span = most + int(refs.lengths.max(initial=0)) + 1
    parts = [(np.zeros(0, np.int64),) * 3]
    for mine, theirs in words.shared(_VALUE[refs.codes]):
        ref = np.searchsorted(refs.starts, theirs, "right") - 1
        text = text_of[mine].astype(np.int64)
        diagonal = theirs - refs.starts[ref] - (mine - frames.starts[text]) + most
        parts.append(_counted(text * len(refs) + ref, diagonal, np.ones(len(mine), np.int64), span))
    pair, _, counts = _counted(*(np.concatenate(c) for c in zip(*parts, strict=True)), span) if len(parts) > 2 else parts[-1]
    at = _runs(pair)
    text, ref = np.divmod(pair[at], max(1, len(refs)))
    seeds = np.maximum.reduceat(counts, at) if len(at) else counts
    order = np.lexsort((number[text], -np.abs(number[text]), seeds, ref, row[text]))
    text, ref, seeds = text[order], ref[order], seeds[order]
    last = np.append(_runs(row[text], ref)[1:], len(text))[: len(text)] - 1 if len(text) else np.zeros(0, np.int64)
    kept = last[seeds[last] >= least]
    return text[kept], ref[kept], seeds[kept]


def searched(known: Callable[[], tuple], word: int, masking: bool, least: int, most: int, table: np.ndarray, gap_open: int, gap_extend: int, traced: bool, leading: bool) -> Callable:
    """A function for ``mapInArrow`` over rows of _key, seq_id, sequencedata and _frames (array of frame and protein).

    ``known`` gives the :func:`references`. Of each query the ``most`` best references (0: all) are kept, ties by the
    order of the references. ``traced`` rows are ALIGNED, others SCORES. ``leading`` leaves of these only such as score best
    on their reference among the queries that are searched together.
    """

    def block(batches: list[pa.RecordBatch], names: list[str], refs: Texts) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        keys = rows["_key"].to_numpy()
        lists = rows["_frames"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        row = np.repeat(np.arange(len(rows)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        items = lists.flatten()
        row, items = row[items.field("protein").is_valid().to_numpy(zero_copy_only=False)], items.filter(items.field("protein").is_valid())
        number = items.field("frame").to_numpy(zero_copy_only=False).astype(np.int64)
        frames = Texts.of(items.field("protein").to_pylist())
        if not len(frames) or not len(refs):
            return
        text, ref, seeds = seeded(frames, row, number, refs, word, masking, least)
        order = np.lexsort((text, ref))  # what is made for a reference serves all its pairs
        text, ref, seeds = text[order], ref[order], seeds[order]
        pairs = Pairs(frames, refs, table, gap_open, gap_extend)
        ends = np.concatenate([np.zeros((0, 3), np.int32), *(pairs.ends(text[i : i + SCORED], ref[i : i + SCORED]) for i in range(0, len(text), SCORED))])
        kept = np.flatnonzero(ends[:, 0] > 0)
        kept = kept[np.lexsort((ref[kept], -ends[kept, 0], row[text[kept]]))]
        if most and len(kept):
            at = _runs(row[text[kept]])
            kept = kept[np.arange(len(kept)) - np.repeat(at, np.diff(np.append(at, len(kept)))) < most]
        if leading:
            highest = np.zeros(len(refs), np.int64)
            np.maximum.at(highest, ref[kept], ends[kept, 0])
            kept = kept[ends[kept, 0] == highest[ref[kept]]]
        for i in range(0, len(kept), GIVEN):
            k = kept[i : i + GIVEN]
            t, r, e = text[k], ref[k], ends[k]
            at = pa.array(row[t])
            shared = [pa.array(number[t].astype(np.int32)), pa.array([names[x] for x in r.tolist()], pa.string()), pa.array(seeds[k]), pa.array(e[:, 0]), pa.array(frames.lengths[t])]
            if not traced:
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[t]]), *shared], names=[c.split()[0] for c in SCORES.split(", ")])
                continue
            found, cigars = pairs.paths(t, r, e)
            pieces = ([texts.part(x, first - 1, last) for x, first, last in zip(which.tolist(), found[:, c].tolist(), found[:, c + 1].tolist(), strict=True)] for texts, which, c in ((frames, t, 4), (refs, r, 6)))
            of = lambda name, at=at: rows[name].combine_chunks().take(at)
            plain = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            columns = [pa.array(keys[row[t]]), plain(of("seq_id")), plain(of("sequencedata")), *shared, *(pa.array(found[:, c]) for c in range(4)), pa.array(cigars, pa.string())]
            columns += [*(pa.array(p, pa.string()) for p in pieces), *(pa.array(found[:, c]) for c in range(4, 8))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, names, refs = [], 0, None, None
        for batch in batches:
            if refs is None:
                names, *parts = known()
                refs = Texts(*parts)
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                size = pc.sum(pc.utf8_length(part.column("_frames").flatten().field("protein"))).as_py() or 0
                if held and letters + size > LETTERS:
                    yield from block(held, names, refs)
                    held, letters = [], 0
                held.append(part)
                letters += size
        if held:
            yield from block(held, names, refs)

    return search
