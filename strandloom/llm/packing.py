"""Filling containers of fixed capacity: bound-certified repacking."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

#: Items that one task packs together.
PART_ITEMS = 20_000
_PLACED = "pack_id int, capacity int, key bigint, piece_no int, piece_tokens bigint, place string, used bigint, bins bigint, bound bigint"


def container_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """A number of containers that no packing of the sizes can go below, from dual feasible functions.

    ``counts`` tells how often each size occurs (once, if it is left out).

    A function f with f(x1) + ... <= f(capacity) whenever x1 + ... <= capacity turns every packing into one of
    the sizes f(x), so their sum bounds it. Two families are tried: large items counted whole while small ones are
    left out (every threshold up to half the capacity), and sizes rounded down to multiples of capacity / k (k up to
    20); the second is also applied after the first, for about 16 thresholds spread over the sizes.
    """
    counts = np.ones(len(sizes), np.int64) if counts is None else counts
    counts, sizes = counts[sizes > 0], sizes[sizes > 0]
    if not len(sizes):
        return 0
    number = np.zeros(capacity + 1, np.int64)
    np.add.at(number, sizes, counts)
    volume = np.cumsum(number * np.arange(capacity + 1))
    many = np.cumsum(number)
    limits = np.arange(0, capacity // 2 + 1)
    kept = volume[capacity - limits] - np.where(limits > 0, volume[limits - 1], 0)
    best = int(-(-(kept + (many[-1] - many[capacity - limits]) * capacity).max() // capacity))
    x = np.arange(capacity + 1)
    for limit in {0, *np.unique(sizes[sizes * 2 <= capacity])[:: max(1, len(np.unique(sizes)) // 16)].tolist()}:
        shown = np.where(x > capacity - limit, capacity, np.where(x < limit, 0, x))
        for k in range(1, 21):
            whole = (k + 1) * shown % capacity == 0
            scaled = np.where(whole, shown * k, (k + 1) * shown // capacity * capacity)
            best = max(best, int(-(-(number * scaled).sum() // (k * capacity))))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """A bin number for each size: largest first, each into the fullest bin that takes it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    places = [0] * len(sizes)
    rooms: list[int] = []  # different amounts of free room, ascending
    bins: dict[int, list[int]] = {}
    opened = 0
    for i in order:
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            place, room = opened, capacity
            opened += 1
        else:
            room = rooms[at]
            place = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        places[i] = place
        room -= sizes[i]
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append(place)
    return places


def _pack_part(tag: str):
    def pack(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["key", "piece_no"], kind="stable")
        sizes = pdf["piece_tokens"].tolist()
        places = np.array(best_fit_decreasing(sizes, capacity))
        used = np.bincount(places, weights=sizes).astype(np.int64)
        out = pdf[["pack_id", "capacity", "key", "piece_no", "piece_tokens"]].copy()
        out["place"] = [f"{tag}.{keys[1]}.{p}" for p in places]
        out["used"] = used[places]
        out["bins"] = len(used)
        out["bound"] = container_bound(pdf["piece_tokens"].to_numpy(), capacity)
        return out

    return pack


def pack_items(items: DataFrame, key: str, size: str, capacities: dict[int, int], part_items: int = PART_ITEMS) -> DataFrame:
    """Lay all items into containers of each capacity: pack_id, container_id, key, piece_no, piece_tokens, unused_tokens.

    ``capacities`` maps a pack_id to its capacity, at least 1. An item larger than the capacity is cut into full
    pieces and one rest; no other item is cut. Items without a size (null) or of size 0 take no room but are laid
    into a container like all others; a negative size counts as 0. key must be unique and a bigint. Each row is a
    piece with its container and the room that stays unused there. An empty input gives no rows.

    Items are spread over parts of about ``part_items`` by a hash. Each part is packed best-fit decreasing, and a
    lower bound from dual feasible functions certifies it if it is met. The items of containers with room, from
    parts that are not certified, are pooled, spread anew over fewer parts and packed again; the new containers are
    taken where they are fewer. That goes on until every part is certified or nothing is gained. Jobs run while the
    result is built.
    """
    ws = Workspace(items.sparkSession, "packing")
    packs = F.array(*[F.struct(F.lit(i).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for i, c in sorted(capacities.items())])
    sizes = ws.save(items.select(F.col(key).cast("bigint").alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_s")))
    each = sizes.select("key", "_s", F.explode(packs).alias("_p"))
    each = each.select("key", "_s", "_p.pack_id", "_p.capacity")
    full = F.col("_s").cast("bigint") - F.pmod("_s", "capacity")
    whole = F.expr("_s div capacity").cast("int")
    cut = each.filter(whole > 0).select("pack_id", "capacity", "key", F.explode(F.sequence(F.lit(1), whole)).alias("piece_no"))
    cut = cut.select("pack_id", F.concat_ws(".", F.lit("whole"), "key", "piece_no").alias("container_id"), "key", "piece_no", F.col("capacity").cast("bigint").alias("piece_tokens"), F.lit(0).cast("bigint").alias("unused_tokens"))
    rest = each.filter((F.pmod("_s", "capacity") > 0) | (F.col("_s") == 0)).select("pack_id", "capacity", "key", (whole + 1).alias("piece_no"), (F.col("_s") - full).alias("piece_tokens"))
    rest = ws.save(rest)
    settled: DataFrame | None = None
    placed = _pack(ws, rest, 0, part_items)
    for turn in count(1):  # each turn but the last saves containers
        loose = (F.col("bins") > F.col("bound")) & (F.col("used") < F.col("capacity"))
        pool = placed.filter(loose)
        before = {r[0]: r[1] for r in pool.groupBy("pack_id").agg(F.countDistinct("place")).collect()}  # a row for each capacity
        if not before:
            break
        again = _pack(ws, pool.select("pack_id", "capacity", "key", "piece_no", "piece_tokens"), turn, part_items)
        after = {r[0]: r[1] for r in again.groupBy("pack_id").agg(F.countDistinct("place")).collect()}
        gained = [p for p in before if after[p] < before[p]]
        if not gained:
            break
        better = F.col("pack_id").isin(gained)
        stay = placed.filter(~(loose & better))
        settled = stay if settled is None else settled.unionByName(stay)
        placed = again.filter(better)
    done = placed if settled is None else settled.unionByName(placed)
    laid = done.select("pack_id", F.col("place").alias("container_id"), "key", "piece_no", "piece_tokens", (F.col("capacity") - F.col("used")).alias("unused_tokens"))
    return laid.unionByName(cut).withColumnRenamed("key", key)


def _pack(ws: Workspace, rest: DataFrame, turn: int, part_items: int) -> DataFrame:
    counts = {r[0]: r[1] for r in rest.groupBy("pack_id").count().collect()}  # a row for each capacity
    parts = F.lit(1)
    for pack, n in counts.items():
        parts = F.when(F.col("pack_id") == pack, F.lit(max(1, round(n / part_items)))).otherwise(parts)
    part = F.pmod(F.xxhash64("key", F.lit(turn)), parts).alias("part")
    # the parts number the rows of a task, so that parts spread evenly over tasks
    return ws.save(rest.select("*", part).groupBy("pack_id", "part").applyInPandas(_pack_part(f"r{turn}"), _PLACED))
