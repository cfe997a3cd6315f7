"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace

#: Texts of one pattern that a window puts in order together.
BUCKET_TEXTS = 20_000


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


class _Network:
    """Arcs with capacity and cost; integer flow along cheapest paths."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # head, room, cost
        self.out: dict[object, list[int]] = {}

    def add(self, a: object, b: object, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, r, c])
        return len(self.arcs) - 2

    def push(self, start: object, end: object) -> int:
        """The largest flow, at least cost."""
        total = 0
        while True:
            cost, via, queue = {start: 0}, {}, [start]
            for node in queue:
                for i in self.out[node]:
                    head, room, price = self.arcs[i]
                    if room and cost[node] + price < cost.get(head, 1 << 60):
                        cost[head], via[head] = cost[node] + price, i
                        queue.append(head)
            if end not in via:
                return total
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            amount = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= amount
                self.arcs[i ^ 1][1] += amount
            total += amount


def route(volumes: dict[tuple[str, ...], int], targets: dict[str, Target], wanted: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens that each pattern (set of sources that hold a text) gives to each source: (total, {(pattern, source): tokens}).

    A pattern's texts may be used as often as the most restrictive of its sources allows; the k-th use of a text
    costs 2k - 1, so that repetition is spread evenly and comes last. Quotas are share x total. The total is
    ``wanted`` (else the tokens of all different texts) or, if the quotas can't be filled then, the largest for
    which they can.
    """

    def build(total: int) -> tuple[int, int, dict]:
        net, arcs, quota = _Network(), {}, 0
        for s, t in targets.items():
            net.add(("s", s), "end", q := int(t.share * total), 0)
            quota += q
        for p, volume in volumes.items():
            for k in range(1, min(targets[s].repeats for s in p) + 1):
                net.add("start", ("p", p), volume, 2 * k - 1)
            for s in p:
                arcs[p, s] = net.add(("p", p), ("s", s), 1 << 60, 0)
        net.out.setdefault("start", [])
        net.out.setdefault("end", [])
        got = net.push("start", "end")
        return got, quota, {x: net.arcs[i ^ 1][1] for x, i in arcs.items()}

    high = sum(volumes.values()) if wanted is None else wanted
    got, quota, flow = build(high)
    if got == quota:
        return high, flow
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        got, quota, _ = build(middle)
        low, high = (middle, high) if got == quota else (low, middle)
    return low, build(low)[2]


def fingerprint(text: str) -> Column:
    """128 bits that stand for a text; null for a null text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def mix_sources(texts: DataFrame, targets: dict[str, Target], key: str, text: str, source: str, tokens: str, wanted: int | None = None, seed: int = 0) -> DataFrame:
    """Choose texts so that sources reach their shares of all tokens: columns source, key, tokens, repeats.

    A row says that the text of the document ``key`` (the smallest one that holds it in that source) is used
    ``repeats`` times for that source. ``text`` is the column of the texts' fingerprints. Equal texts are one text, which may belong to several sources; it is used at
    most as often, in all, as each of them allows. Rows without text or tokens, and rows of sources without a
    target, are not used; the spelling of ``source`` counts without case and outer white space. The choice depends
    on ``seed`` and the texts alone.

    Texts are reduced to their tokens by set of sources; those few sums are routed to the quotas (:func:`route`).
    Each set's texts then stand in a seeded order as on a line, of which every source gets its stretch; places on
    the line come from running sums within hash buckets and the buckets' sums.
    """
    ws = Workspace(texts.sparkSession, "mixing")
    name = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    rows = texts.select(F.col(text).alias("_t"), name.alias("_src"), F.col(key).alias("_key"), F.col(tokens).alias("_n"))
    rows = rows.filter(F.col("_src").isin(list(targets)) & (F.col("_n") > 0) & F.col("_t").isNotNull())
    held = rows.groupBy("_t", "_src").agg(F.min("_key").alias("_key"), F.max("_n").alias("_n"))
    one = held.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("_src", "_key"))).alias("_in"), F.max("_n").alias("_n"))
    order = F.xxhash64(F.lit(seed), F.col("_t"))
    one = ws.save(one.select("_t", "_in", "_n", F.col("_in._src").alias("_pattern"), order.alias("_order")))
    # one row for each set of sources that occurs
    sums = one.groupBy("_pattern").agg(F.sum("_n").alias("_sum"), F.count("*").alias("_texts")).collect()
    volumes = {tuple(r["_pattern"]): r["_sum"] for r in sums}
    _, flow = route(volumes, targets, wanted)
    plan = []
    for pattern in volumes:
        at = 0
        for s in pattern:
            if amount := flow[pattern, s]:
                plan.append((list(pattern), s, at, amount, volumes[pattern]))
                at += amount
    schema = "_pattern array<string>, _src string, _from bigint, _amount bigint, _volume bigint"
    ranges = F.broadcast(texts.sparkSession.createDataFrame(plan, schema))
    bits = max(0, (max([r["_texts"] for r in sums], default=1) // BUCKET_TEXTS).bit_length())
    bucket = F.shiftrightunsigned(F.shiftright("_order", 1), 63 - bits) if bits else F.lit(0).cast("bigint")
    one = one.withColumn("_bucket", bucket)
    before = one.groupBy("_pattern", "_bucket").agg(F.sum("_n").alias("_b"))
    before = before.select("_pattern", "_bucket", (F.sum("_b").over(W.partitionBy("_pattern").orderBy("_bucket")) - F.col("_b")).alias("_before"))
    within = F.sum("_n").over(W.partitionBy("_pattern", "_bucket").orderBy("_order", "_t").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    lined = one.withColumn("_x", within).join(before, ["_pattern", "_bucket"])
    x = F.col("_before") + F.col("_x")
    used = lined.join(ranges, "_pattern").withColumn("repeats", (F.ceil((F.col("_from") + F.col("_amount") - x) / F.col("_volume")) - F.ceil((F.col("_from") - x) / F.col("_volume"))).cast("int"))
    mine = F.filter("_in", lambda m: m["_src"] == F.col("_src"))[0]["_key"]
    return used.filter("repeats > 0").select(F.col("_src").alias("source"), mine.alias(key), F.col("_n").alias("tokens"), "repeats")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual shares of a mix: source, target_share, texts, used_tokens, actual_share, most_repeats; sources without a text have 0."""
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    used = mix.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    rows = targets.select(name.alias("source"), "target_share").join(used, "source", "left").fillna(0, ["texts", "used_tokens", "most_repeats"])
    total = F.sum("used_tokens").over(W.partitionBy())  # a row for each source
    share = F.when(total > 0, F.round(F.col("used_tokens") / total, 6)).otherwise(0.0)
    return rows.select("source", "target_share", "texts", "used_tokens", share.alias("actual_share"), "most_repeats")
