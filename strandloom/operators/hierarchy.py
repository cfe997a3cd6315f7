"""Parent-child rows to full hierarchies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .components import connected_components
from .skew import heavy_keys, lookup_join

#: Links of the largest component that one task walks, in about 500 bytes each.
COLOCATE_LINKS = 1_000_000
#: Links that share a task.
GROUP_LINKS = 20_000
#: Letters (paths) or rows x ROW_LETTERS (descendants) of the results that one task makes of a component.
SHARE_LETTERS = 256 << 20
ROW_LETTERS = 32
#: A component of so many links has at most 3**(links / 3) paths to a node, so it isn't weighed.
LIGHT_LINKS = 18
#: Rows and letters of a batch of results.
BATCH_ROWS, BATCH_LETTERS = 20_000, 4 << 20
PATHS = "id string, root string, depth int, path string"
PAIRS = "id string, descendant string"
STATES = "id string, state int, knot string"


def links(records: DataFrame, id_col: str = "id", parents: str = "parent") -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and distinct links (parent, id) of records whose array column ``parents`` holds id lists.

    Nodes are the distinct non-null ids. An element of the array may hold several ids separated by commas; outer
    white space is dropped; parents that are no node are ignored.
    """
    nodes = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    named = (
        records.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.explode(parents).alias("_p"))
        .select("id", F.explode(F.split("_p", ",")).alias("_p"))
        .select("id", F.regexp_replace("_p", r"^\s+|\s+$", "").alias("parent"))
        .distinct()
    )
    return nodes, named.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("parent", "id")


def hierarchy_paths(nodes: DataFrame, parent_links: DataFrame, colocate: int = COLOCATE_LINKS, share: int = SHARE_LETTERS) -> DataFrame:
    """One row for each path from a parentless node down to a node: id, root, depth, path (ids joined with '/').

    A node that is its own ancestor has one row with root '', depth -1 and path ''; another node below such a
    node one row with root '', depth -2 and path ''. ``parent_links`` has distinct rows (parent, id) between
    nodes.

    Connected components are co-located and walked depth first with node colouring. What a component gives is
    counted before it is written out: one that gives more than ``share`` letters is walked by several tasks, each of
    which writes its stretch of the walk as a stream. A component of more than ``colocate`` links is first shortened
    for the colouring (runs of single parents become one node, see :func:`cycle_states`), and its paths are put
    together from ways of 1, 2, 4, ... links. The result is the same throughout. Jobs run while the result is built.
    """
    return _walk(nodes, parent_links, colocate, share, False)


def hierarchy_descendants(nodes: DataFrame, parent_links: DataFrame, colocate: int = COLOCATE_LINKS, share: int = SHARE_LETTERS) -> DataFrame:
    """One row (id, descendant) for every node that can be reached from id by one link or more.

    A node of a cycle is a descendant of itself. Nodes without children have no row. Components are handled as in
    :func:`hierarchy_paths`; those of more than ``colocate`` links by doubling the length of the walks.
    """
    return _walk(nodes, parent_links, colocate, share, True)


def _walk(nodes: DataFrame, parent_links: DataFrame, colocate: int, share: int, below: bool) -> DataFrame:
    ws = Workspace(nodes.sparkSession, "hierarchy")
    table = ws.save(parent_links.select("parent", "id"))
    placed, total, largest = _placed(ws, table)
    small = placed.filter(F.col("n") <= colocate) if largest > colocate else placed
    found = _shares(ws, small, total, share, below).groupBy("_unit", "_share").applyInArrow(_descend if below else _paths, PAIRS if below else PATHS)
    if largest > colocate:
        wide = ws.save(placed.filter(F.col("n") > colocate).select("parent", "id"))
        found = found.unionByName(_spread_descendants(ws, wide) if below else _spread_paths(ws, wide, colocate))
    if below:
        return found
    alone = nodes.join(_ends(table), "id", "left_anti")
    return found.unionByName(alone.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("id").alias("path")))


def _placed(ws: Workspace, table: DataFrame) -> tuple[DataFrame, int, int]:
    """Links with their component and its number of links n; the numbers of links in all and of the largest component.

    Components are found on 64-bit hashes of the ids. Two ids with one hash would bring two components together, which
    changes where they are walked but nothing in the result.
    """
    hashed = table.select(F.xxhash64("parent").alias("parent"), F.xxhash64("id").alias("id"))
    parts = ws.save(connected_components(hashed, "parent", "id"))
    joined = ws.save(table.withColumn("_h", F.xxhash64("id")).join(parts, F.col("_h") == F.col("node")).select("parent", "id", "component"))
    sizes = ws.save(joined.groupBy("component").agg(F.count("*").alias("n")))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return lookup_join(joined, sizes, "component", heavy_keys(sizes, "component", total, "n")), total, largest


def _unit(total: int) -> Column:
    """Components that share a task; one of more than GROUP_LINKS links has its own."""
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, total // GROUP_LINKS)))
    return F.when(F.col("n") > GROUP_LINKS, F.concat(F.lit("c"), F.col("component").cast("string"))).otherwise(F.concat(F.lit("b"), bucket.cast("string")))


def _shares(ws: Workspace, placed: DataFrame, total: int, share: int, below: bool) -> DataFrame:
    """Links with the unit that walks them; those of a component with large results once for each of its shares."""
    units = placed.select(_unit(total).alias("_unit"), "component", "parent", "id", "n")
    weighed = units.filter(F.col("n") > LIGHT_LINKS).groupBy("_unit").applyInArrow(_weigher(share, below), "component bigint, shares bigint")
    heavy = ws.save(weighed)
    one = F.lit(1).cast("bigint")
    if heavy.isEmpty():
        return units.select("_unit", F.lit(0).cast("bigint").alias("_share"), one.alias("_of"), "parent", "id")
    marked = units.join(heavy, "component", "left").withColumn("_of", F.coalesce("shares", one))
    unit = F.when(F.col("shares").isNull(), F.col("_unit")).otherwise(F.concat(F.lit("c"), F.col("component").cast("string")))
    return marked.select(unit.alias("_unit"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_of") - 1)).alias("_share"), "_of", "parent", "id")


class _Graph:
    """The links of a task: nodes are numbers, ``children`` of a node lie in a row of one list."""

    def __init__(self, parents: list[str], ids: list[str]):
        codes, names = pd.factorize(np.array([*parents, *ids], dtype=object))
        above, below = codes[: len(parents)], codes[len(parents) :]
        order = np.argsort(above, kind="stable")
        self.names: list[str] = names.tolist()
        self.size = len(self.names)
        self.first = np.searchsorted(above[order], np.arange(self.size + 1)).tolist()
        self.below: list[int] = below[order].tolist()
        self.parents = np.bincount(below, minlength=self.size).tolist()

    def children(self, node: int) -> list[int]:
        return self.below[self.first[node] : self.first[node + 1]]

    def colour(self) -> tuple[list[int], dict[int, int]]:
        """State of each node (-1 on a cycle, -2 under one, 0 otherwise) and, of nodes on cycles, a node of their knot.

        A depth-first walk colours nodes white, grey (on the trail) and black. A link to a grey node closes a cycle;
        ``low`` carries the smallest grey number that a subtree reaches, which joins interlocking cycles to a knot.
        """
        number, low, grey = [-1] * self.size, [0] * self.size, bytearray(self.size)
        trail: list[int] = []
        knots: dict[int, int] = {}
        counter = 0
        for start in range(self.size):
            if number[start] >= 0:
                continue
            stack = [start]
            at = [self.first[start]]
            number[start] = low[start] = counter
            counter += 1
            grey[start] = 1
            trail.append(start)
            while stack:
                node = stack[-1]
                i = at[-1]
                if i < self.first[node + 1]:
                    at[-1] = i + 1
                    child = self.below[i]
                    if number[child] < 0:
                        number[child] = low[child] = counter
                        counter += 1
                        grey[child] = 1
                        trail.append(child)
                        stack.append(child)
                        at.append(self.first[child])
                    elif grey[child] and number[child] < low[node]:
                        low[node] = number[child]
                    continue
                stack.pop()
                at.pop()
                if stack and low[node] < low[stack[-1]]:
                    low[stack[-1]] = low[node]
                if low[node] == number[node]:
                    knot = []
                    while True:
                        member = trail.pop()
                        grey[member] = 0
                        knot.append(member)
                        if member == node:
                            break
                    if len(knot) > 1 or node in self.children(node):
                        knots |= dict.fromkeys(knot, node)
        state = [0] * self.size
        for node in knots:
            state[node] = -1
        waiting = list(knots)
        while waiting:
            for child in self.children(waiting.pop()):
                if not state[child]:
                    state[child] = -2
                    waiting.append(child)
        return state, knots

    def downward(self, state: list[int]) -> list[int]:
        """Nodes that are on and under no cycle, parents first."""
        left = list(self.parents)
        order = [n for n in range(self.size) if not left[n] and not state[n]]
        for node in order:
            for child in self.children(node):
                left[child] -= 1
                if not left[child] and not state[child]:
                    order.append(child)
        return order


def _read(batches: Iterator[pa.RecordBatch], *columns: str) -> list[list]:
    table = pa.Table.from_batches(list(batches))
    return [table.column(c).to_pylist() for c in columns]


def _weigher(share: int, below: bool) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components whose results have more letters than a share, and how many shares they need."""
        component, parents, ids = _read(batches, "component", "parent", "id")
        graph = _Graph(parents, ids)
        state, _ = graph.colour()
        order = graph.downward(state)
        weight = [0] * graph.size
        if below:  # at most: a row for each way down, and for each two nodes of a knot or under one
            for node in range(graph.size):
                weight[node] = graph.size if state[node] else 0
            for node in reversed(order):
                weight[node] = min(graph.size, sum(1 + weight[c] for c in graph.children(node)))
            weight = [w * ROW_LETTERS for w in weight]
        else:
            ways = [0] * graph.size
            for node in order:
                own = len(graph.names[node])
                if not graph.parents[node]:
                    ways[node], weight[node] = 1, own
                weight[node] += ways[node] * (own if graph.parents[node] else 0)
                for child in graph.children(node):
                    if not state[child]:
                        ways[child] += ways[node]
                        weight[child] += weight[node] + ways[node]
        at = {name: i for i, name in enumerate(graph.names)}
        home: dict[int, dict[int, None]] = {}
        for c, p, i in zip(component, parents, ids, strict=True):
            home.setdefault(c, {}).update({at[p]: None, at[i]: None})
        sums = {c: sum(weight[n] for n in members) for c, members in home.items()}
        heavy = [(c, -(-w // share)) for c, w in sums.items() if w > share]
        yield pa.record_batch([pa.array([c for c, _ in heavy], pa.int64()), pa.array([k for _, k in heavy], pa.int64())], names=["component", "shares"])

    return weigh


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one share of a unit: all its paths stand in the order of the walk, and a share is a stretch of it."""
    parents, ids, share, of = _read(batches, "parent", "id", "_share", "_of")
    graph = _Graph(parents, ids)
    share, of = share[0], of[0]
    state, _ = graph.colour()
    order = graph.downward(state)
    rows = [0] * graph.size  # of a node and everything below it
    for node in reversed(order):
        rows[node] = 1 + sum(rows[c] for c in graph.children(node) if not state[c])
    roots = [n for n in order if not graph.parents[n]]
    total = sum(rows[r] for r in roots)
    begin, end = total * share // of, total * (share + 1) // of
    out: list[tuple] = []
    letters = 0
    if not share:
        out = [(name, "", s, "") for name, s in zip(graph.names, state, strict=True) if s]
    rank = 0
    trail: list[int] = []
    for root in roots:
        stack = [(root, 0, rank, "")]
        rank += rows[root]
        while stack:
            node, depth, place, path = stack.pop()
            if place >= end or place + rows[node] <= begin:
                continue
            del trail[depth:]
            trail.append(node)
            if place >= begin:
                path = f"{path}/{graph.names[node]}" if path else "/".join([graph.names[n] for n in trail])
                out.append((graph.names[node], graph.names[root], depth, path))
                letters += len(path)
                if len(out) >= BATCH_ROWS or letters >= BATCH_LETTERS:
                    yield _rows(out)
                    out, letters = [], 0
            place += 1
            for child in graph.children(node):
                if not state[child]:
                    stack.append((child, depth + 1, place, path))
                    place += rows[child]
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ids, roots, depths, paths = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.record_batch([pa.array(ids, pa.string()), pa.array(roots, pa.string()), pa.array(depths, pa.int32()), pa.array(paths, pa.string())], names=["id", "root", "depth", "path"])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of one share of a unit: every so many-th node with all that it reaches."""
    parents, ids, share, of = _read(batches, "parent", "id", "_share", "_of")
    graph = _Graph(parents, ids)
    names = pa.array(graph.names, pa.string())
    above: list[np.ndarray] = []
    reached: list[np.ndarray] = []

    def pairs() -> pa.RecordBatch:
        both = [names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (above, reached)]
        above.clear()
        reached.clear()
        return pa.record_batch(both, names=["id", "descendant"])

    pending = 0
    for node in range(share[0], graph.size, of[0]):
        seen: set[int] = set()
        stack = graph.children(node)
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack.extend(graph.children(x))
        if seen:
            above.append(np.full(len(seen), node))
            reached.append(np.fromiter(seen, np.int64, len(seen)))
            pending += len(seen)
        if pending >= BATCH_ROWS:
            yield pairs()
            pending = 0
    yield pairs()


def _colours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents, ids = _read(batches, "parent", "id")
    graph = _Graph(parents, ids)
    state, knots = graph.colour()
    knot = [graph.names[knots[n]] if n in knots else None for n in range(graph.size)]
    yield pa.record_batch([pa.array(graph.names, pa.string()), pa.array(state, pa.int32()), pa.array(knot, pa.string())], names=["id", "state", "knot"])


def _ends(table: DataFrame) -> DataFrame:
    return table.select(F.explode(F.array("parent", "id")).alias("id")).distinct()


def cycle_states(ws: Workspace, table: DataFrame, colocate: int = COLOCATE_LINKS) -> DataFrame:
    """State of every node of some links (parent, id): -1 on a cycle, -2 under one, 0 otherwise; knot names a node of its cycles.

    Components of at most ``colocate`` links are coloured by a depth-first walk in one task. A larger one is
    shortened first: links from parentless nodes are left out, as they lie neither on nor under a cycle, and every
    node with a single parent is replaced by the first of its ancestors with none or several (its head), found by
    doubling pointers. A ring of single parents, which has no head, becomes a node with a link to itself. The
    states of the heads, found in the same way, give those of all nodes. Only where that doesn't shorten a component
    by a tenth, so that nearly every node has several parents, it is peeled level by level and coloured by joins.
    """
    placed, total, largest = _placed(ws, table)
    fits = placed.filter(F.col("n") <= colocate) if largest > colocate else placed
    found = ws.save(fits.select(_unit(total).alias("_unit"), "parent", "id").groupBy("_unit").applyInArrow(_colours, STATES))
    if largest <= colocate:
        return found
    wide = ws.save(placed.filter(F.col("n") > colocate).select("parent", "id"))
    nodes = ws.save(_ends(wide))
    inner = ws.save(wide.join(wide.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi"))
    single = inner.groupBy("id").agg(F.count("*").alias("_k"), F.min("parent").alias("_p")).filter("_k = 1 and _p <> id")
    steps = [ws.save(nodes.join(single, "id", "left").select("id", F.coalesce("_p", "id").alias("up"), F.least("id", F.coalesce("_p", "id")).alias("least")))]
    heads = ws.save(steps[0].filter("id = up").select("id"))
    reach, count = 1, nodes.count()
    while True:  # up: the ancestor 1, 2, 4, ... links up, or the head
        last = steps[-1]
        over = last.select(F.col("id").alias("up"), F.col("up").alias("_u"), F.col("least").alias("_l"))
        steps.append(ws.save(last.join(over, "up").select("id", F.col("_u").alias("up"), F.least("least", "_l").alias("least"))))
        reach *= 2
        if reach > count or steps[-1].join(heads.select(F.col("id").alias("up")), "up", "left_anti").isEmpty():
            break
    ends = steps[-1].join(heads.select(F.col("id").alias("up"), F.lit(True).alias("_headed")), "up", "left")
    lost = ws.save(ends.filter("_headed is null").select("id", "up", "least"))  # they hang on a ring of single parents
    rings = ws.save(lost.join(lost.select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", F.col("least").alias("knot")))
    on_ring = lost.join(rings.select(F.col("id").alias("up"), "knot"), "up").select("id", F.col("knot").alias("head"))
    home = ws.save(ends.filter("_headed").select("id", F.col("up").alias("head")).unionByName(on_ring))
    crossing = ws.save(inner.join(heads, "id", "left_semi").join(home.withColumnRenamed("id", "parent"), "parent").select("parent", "id", "head"))
    short = crossing.select(F.col("head").alias("parent"), "id").union(rings.select("knot", "knot")).distinct()
    short = ws.save(short.select("parent", "id"))
    if short.isEmpty():
        return ws.together(found, ws.save(nodes.select("id", F.lit(0).alias("state"), F.lit(None).cast("string").alias("knot"))))
    if short.count() > 0.9 * wide.count():
        return ws.together(found, ws.save(_coloured_by_joins(ws, nodes, wide)))
    state = ws.save(cycle_states(ws, short, colocate))
    # a node with a cyclic head is on a cycle if, below it, a link leads to a head of the same knot
    cyclic = state.filter("state = -1").select(F.col("id").alias("head"), "knot")
    back = crossing.join(cyclic, "head").join(cyclic.select(F.col("head").alias("id"), F.col("knot").alias("_k")), "id").filter("knot = _k")
    marked = ws.save(back.select(F.col("parent").alias("id")).distinct())
    for step in steps[:-1]:
        up = marked.join(step, "id").select(F.col("up").alias("id"))
        marked = ws.save(marked.union(up).distinct())
    known = home.join(state.select(F.col("id").alias("head"), "state", "knot"), "head", "left")
    known = known.join(marked.withColumn("_m", F.lit(True)), "id", "left").join(rings.select("id", F.lit(True).alias("_r")), "id", "left")
    on = F.coalesce((F.col("state") == -1) & (F.col("_r") | F.col("_m") | (F.col("id") == F.col("head"))), F.lit(False))
    told = known.select("id", F.when(on, -1).when(F.col("state") < 0, -2).otherwise(0).alias("state"), F.when(on, F.col("knot")).alias("knot"))
    return ws.together(found, ws.save(told))


def _spread_descendants(ws: Workspace, table: DataFrame) -> DataFrame:
    """Reachability of large components: walks of up to 1, 2, 4, ... links."""
    exact = ws.save(table.select(F.col("parent").alias("id"), F.col("id").alias("descendant")).distinct())
    found = [exact]
    while True:
        longer = exact.withColumnRenamed("id", "_m").withColumnRenamed("descendant", "_d")
        step = ws.together(*found).join(longer, F.col("descendant") == F.col("_m")).select("id", F.col("_d").alias("descendant")).distinct()
        fresh = ws.save(step.join(ws.together(*found), ["id", "descendant"], "left_anti"))
        if fresh.isEmpty():
            return ws.together(*found)
        found.append(fresh)
        exact = ws.save(exact.join(longer, F.col("descendant") == F.col("_m")).select("id", F.col("_d").alias("descendant")).distinct())


def _spread_paths(ws: Workspace, table: DataFrame, colocate: int) -> DataFrame:
    """Paths of large components: those of fewer than 1, 2, 4, ... links are extended by ways of exactly so many."""
    state = ws.save(cycle_states(ws, table, colocate))
    odd = state.filter("state < 0").select("id", F.lit("").alias("root"), F.col("state").alias("depth"), F.lit("").alias("path"))
    plain = state.filter("state = 0").select("id")
    roots = plain.join(table, "id", "left_anti")
    found = [ws.save(roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("id").alias("path")))]
    ways = ws.save(table.join(plain, "id", "left_semi").select("parent", "id", F.col("id").alias("way")))
    size = 1
    while not ways.isEmpty():
        step = ws.together(*found).withColumnRenamed("id", "parent").join(ways, "parent")
        found.append(ws.save(step.select("id", "root", (F.col("depth") + size).alias("depth"), F.concat_ws("/", "path", "way").alias("path"))))
        onward = ways.select(F.col("parent").alias("_m"), F.col("id").alias("_i"), F.col("way").alias("_w"))
        ways = ws.save(ways.join(onward, F.col("id") == F.col("_m")).select("parent", F.col("_i").alias("id"), F.concat_ws("/", "way", "_w").alias("way")))
        size *= 2
    return ws.together(*found).unionByName(odd)


def _coloured_by_joins(ws: Workspace, nodes: DataFrame, table: DataFrame) -> DataFrame:
    """The states of :func:`cycle_states` by peeling and colour propagation, a round for each level."""
    left = table
    while True:  # links from parentless nodes
        inner = ws.save(left.join(left.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi"))
        if inner.count() == left.count():
            break
        left = inner
    odd = ws.save(left.select("id").distinct())  # everything left has a parent, so it is on or under a cycle
    knots = _knots(ws, left)
    states = nodes.join(odd.withColumn("_o", F.lit(-2)), "id", "left").join(knots, "id", "left")
    return states.select("id", F.when(F.col("knot").isNotNull(), -1).otherwise(F.coalesce("_o", F.lit(0))).alias("state"), "knot")


def _knots(ws: Workspace, core: DataFrame) -> DataFrame:
    """Nodes on cycles with a node of their knot, in a graph in which every node has a parent.

    Colouring: the largest id flows down the links until nothing changes; nodes that reach the first node of their
    colour within it are a knot if that node reaches itself. Settled nodes leave, and so on.
    """
    found = []
    while not core.isEmpty():
        core = ws.save(core.join(core.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"))  # childless nodes
        colour = ws.save(_ends(core).select("id", F.col("id").alias("c")))
        while True:
            flow = core.join(colour.withColumnRenamed("id", "parent"), "parent").groupBy("id").agg(F.max("c").alias("m"))
            nxt = ws.save(colour.join(flow, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")))
            moved = not nxt.filter("moved").isEmpty()
            colour = nxt.select("id", "c")
            if not moved:
                break
        same = core.join(colour.select(F.col("id").alias("parent"), F.col("c").alias("pc")), "parent").join(colour, "id").filter("pc = c").select("parent", "id", "c")
        same = ws.save(same)
        # walk up from the colour's first node; it is on a cycle if it meets itself
        reach = [ws.save(same.filter("id = c").select(F.col("parent").alias("id"), "c").distinct())]
        while not reach[-1].isEmpty():
            up = reach[-1].join(same, ["id", "c"]).select(F.col("parent").alias("id"), "c").distinct()
            reach.append(ws.save(up.join(ws.together(*reach), ["id", "c"], "left_anti")))
        reached = ws.together(*reach)
        closed = reached.filter("id = c").select("c")
        knot = ws.save(reached.join(closed, "c", "left_semi").select("id", F.col("c").alias("knot")))
        found.append(knot)
        settled = ws.save(knot.select("id").union(colour.filter("id = c").select("id")).distinct())
        core = ws.save(core.join(settled, "id", "left_anti").join(settled.select(F.col("id").alias("parent")), "parent", "left_anti"))
    return ws.together(*found) if found else ws.spark.createDataFrame([], "id string, knot string")
