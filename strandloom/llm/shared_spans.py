"""Long exact spans shared between records, by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, lookup_join
from ..session import Workspace

#: Length of the shortest windows; each level doubles it until the wanted length is reached.
SEED = 16
#: Letters that one numpy step takes together.
CHUNK = 1 << 20
_VALUE = np.full(256, 4, np.uint8)
_VALUE[[ord(x) for x in "ACGT"]] = range(4)


def record_letters(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Records (record_id, letters) from (table, id column, sequence column): letters in upper case without '-'.

    The same id is the same record in all tables. Null ids and sequences are left out; letters beyond ASCII and '|'
    count as N. A record written with different letters keeps each version, joined by '|'; versions are told apart again by :func:`shared_windows`.
    """
    one = None
    for table, key, text in tables:
        part = table.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("record_id"), F.col(text).alias("letters")).distinct()
        one = part if one is None else one.unionByName(part)
    plain = F.regexp_replace(F.translate("letters", "|-", "N"), "[^\\x00-\\x7F]", "N")
    return one.groupBy("record_id").agg(F.array_join(F.sort_array(F.collect_set(F.upper(plain))), "|").alias("letters"))


def shared_windows(records: DataFrame, length: int) -> DataFrame:
    """Starts (from 1) of all windows of ``length`` letters A, C, G or T that occur in another record too: record_id, start.

    Level-wise doubling: a window of the wanted length is represented, at level 16, by that window of 16 letters
    in it that comes first in a fixed pseudo-random order. Representatives found in one record only end there,
    with all that they stand for. What is left is represented by windows of 32 letters, and so on, until whole
    windows are compared or no candidate survives. Equal windows have equal representatives, so nothing is lost;
    windows are compared by their letters, not by hashes. Counting is combined before the shuffle, and a window
    with a large part of all occurrences is met by a bounded broadcast.
    """
    ws = Workspace(records.sparkSession, "spans")
    table = ws.save(records.filter(F.length("letters") >= length).withColumn("rid", F.monotonically_increasing_id()))
    keep = table.select("rid", "letters", F.lit(None).cast("array<int>").alias("kept"))
    levels = [SEED]
    while levels[-1] * 2 < length:
        levels.append(levels[-1] * 2)
    levels = [x for x in levels if x < length] + [length]
    for before, level in zip([0, *levels], levels, strict=False):
        found = ws.save(keep.mapInArrow(_emitter(before, level, length), "code binary, rid bigint, pos int"))
        several = found.groupBy("code").agg(F.min("rid").alias("_a"), F.max("rid").alias("_b"), F.count("*").alias("_n"))
        several = ws.save(several.filter("_a < _b").select("code", "_n"))
        heavy = heavy_keys(several, "code", found.count(), "_n")
        again = lookup_join(found, several.select("code"), "code", heavy).select("rid", "pos")
        if level == length:
            return again.distinct().join(table.select("rid", "record_id"), "rid").select("record_id", (F.col("pos") + 1).alias("start"))
        kept = again.groupBy("rid").agg(F.collect_list("pos").alias("kept"))
        keep = table.select("rid", "letters").join(kept, "rid")
    raise AssertionError


def shared_spans(records: DataFrame, length: int) -> DataFrame:
    """Maximal runs of positions that lie in a window of :func:`shared_windows`: record_id, span_start, span_end.

    Positions count the record's letters from 1. length must be at least 16. An empty input, or one in which no
    record has that many letters, gives no rows.
    """
    starts = shared_windows(records, length).groupBy("record_id").agg(F.sort_array(F.collect_set("start")).alias("_s"))
    opens = F.filter("_s", lambda x, i: (i == 0) | (x > F.get("_s", i - 1) + length))
    closes = F.filter("_s", lambda x, i: (i == F.size("_s") - 1) | (F.get("_s", i + 1) > x + length))
    runs = F.arrays_zip(opens.alias("a"), closes.alias("b"))
    return starts.select("record_id", F.explode(runs).alias("_r")).select(
        "record_id", F.col("_r.a").alias("span_start"), (F.col("_r.b") + length - 1).alias("span_end")
    )


def shared_amounts(records: DataFrame, length: int) -> DataFrame:
    """For every record its letters, how many of them are shared, and the part: record_id, letters, shared_letters, shared_part.

    A record of several versions counts the letters of the longest. Records without letters have part 0.
    """
    spans = shared_spans(records, length).groupBy("record_id").agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("shared_letters"))
    longest = F.array_max(F.transform(F.split("letters", "[|]"), F.length))
    sizes = records.select("record_id", longest.cast("bigint").alias("letters"))
    shared = F.coalesce("shared_letters", F.lit(0))
    part = F.when(F.col("letters") > 0, shared / F.col("letters")).otherwise(0.0)
    return sizes.join(spans, "record_id", "left").select("record_id", "letters", shared.alias("shared_letters"), F.round(part, 6).alias("shared_part"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _order(values: np.ndarray, level: int) -> np.ndarray:
    """A pseudo-random number for the window of ``level`` letters at each position, from those of half its length."""
    n = len(values)
    h, size = _mix(values.astype(np.uint64) + np.uint64(1)), 1
    while size < level:
        step = min(size, level - size)
        other = np.zeros(n, np.uint64)
        other[: n - step] = h[step:]
        h, size = _mix(h * np.uint64(0xD6E8FEB86659FD93) + other), size + step
    return h


def _first_in_window(order: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` numbers the place of its smallest one (the leftmost of equals), by doubling windows."""
    best, place, done = order, np.arange(len(order)), 1
    while done < size:
        step = min(done, size - done)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, place, done = np.where(later, best[step:], best[:n]), np.where(later, place[step:], place[:n]), done + step
    return place


def _representatives(values: np.ndarray, level: int, length: int, starts: np.ndarray) -> np.ndarray:
    """For each start the position of the window of ``level`` letters that represents the window of ``length``."""
    if level == length or not len(starts):
        return starts
    return _first_in_window(_order(values, level), length - level + 1)[starts]


def _emitter(before: int, level: int, length: int):
    """Windows of one level that represent candidates, given the windows kept at the level before (0: all)."""

    def candidates(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = _VALUE[letters]
        bad = np.concatenate([[0], np.cumsum(values > 3)])
        starts = np.flatnonzero(bad[length:] == bad[:-length]) if len(values) >= length else np.empty(0, np.int64)
        return values, starts

    def step(texts: list[bytes], rids: np.ndarray, kept: list) -> pa.RecordBatch:
        joined = np.frombuffer(b"|".join(texts) + b"|", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        values, starts = candidates(joined)
        if before:
            alive = np.zeros(len(joined), bool)
            alive[np.concatenate([np.asarray(k, np.int64) + f for k, f in zip(kept, firsts, strict=True)])] = True
            starts = starts[alive[_representatives(values, before, length, starts)]]
        at = np.unique(_representatives(values, level, length, starts))
        # four letters to a byte; the last byte overlaps where the length is no multiple of four
        quads = np.zeros(len(values), np.uint8)
        v = values & 3
        quads[:-3] = v[:-3] << 6 | v[1:-2] << 4 | v[2:-1] << 2 | v[3:] if len(v) > 3 else 0
        offsets = np.unique(np.append(np.arange(0, level - 3, 4), level - 4))
        codes = quads[at[:, None] + offsets[None, :]]
        owner = np.searchsorted(firsts, at, side="right") - 1
        base = firsts[owner]
        if level == length:  # positions within the version
            cuts = np.flatnonzero(joined == ord("|")) + 1
            base = np.concatenate([[0], cuts])[np.searchsorted(cuts, at, side="right")]
        width = len(offsets)
        buffer = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
        code = pa.Array.from_buffers(pa.binary(width), len(at), [None, buffer]).cast(pa.binary())
        return pa.record_batch([code, pa.array(rids[owner], pa.int64()), pa.array((at - base).astype(np.int32))], names=["code", "rid", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("letters").to_pylist()]
            rids = batch.column("rid").to_numpy()
            kept = batch.column("kept").to_pylist() if before else [None] * len(texts)
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) <= CHUNK):
                    total += len(texts[j])
                    j += 1
                yield step(texts[i:j], rids[i:j], kept[i:j])
                i = j

    return run
