"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .skew import heavy_keys, lookup_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Give every node of an undirected graph the smallest node of its component: columns node, component.

    Each round every node takes the smallest node among itself and its neighbours (minimum label propagation) and
    then its label's label (pointer jumping) until that changes nothing; the pairs are rewritten in the new labels
    and pairs within one label disappear. Rounds end when no pair is left, i.e. when no label would change. Every
    step is written as a durable table. Hub nodes are joined through a bounded broadcast, so no task holds a
    hub's pairs.

    Pairs with a null end are ignored, repeated pairs and loops do no harm; a node with a loop only is its own
    component. Columns other than a and b are ignored. An empty input gives an empty result.
    """
    ws = Workspace(edges.sparkSession, "components")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    lonely = pairs.filter("u = v").select(F.col("u").alias("node")).distinct()
    current = ws.save(_both_ways(pairs))
    maps: list[DataFrame] = []
    while total := current.count():
        parents = ws.save(current.groupBy("u").agg(F.least("u", F.min("v")).alias("p"), F.count("*").alias("degree")))
        labels = _flatten(ws, parents)
        heavy = heavy_keys(parents, "u", total, "degree")
        left = lookup_join(current, labels, "u", heavy).select(F.col("q").alias("u"), F.col("v").alias("w"))
        mapped = lookup_join(left, labels.select(F.col("u").alias("w"), F.col("q").alias("v")), "w", heavy).select("u", "v")
        following = ws.save(_both_ways(mapped.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))))
        ws.drop(parents, current)
        maps.append(labels)
        current = following
    if not maps:
        return lonely.select("node", F.col("node").alias("component"))
    final = maps[-1]
    for earlier in reversed(maps[:-1]):
        up = final.select(F.col("u").alias("q"), F.col("q").alias("r"))
        step = lookup_join(earlier, up, "q", heavy_keys(earlier, "q"), "left")
        final = ws.save(step.select("u", F.coalesce("r", "q").alias("q")))
    result = final.select(F.col("u").alias("node"), F.col("q").alias("component"))
    alone = lonely.join(result, "node", "left_anti").select("node", F.col("node").alias("component"))
    return result.unionByName(alone)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Distinct pairs in both directions, without loops."""
    once = pairs.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return once.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _flatten(ws: Workspace, parents: DataFrame) -> DataFrame:
    """u and the end q of its chain of parents: the chains halve with every jump."""
    labels = parents.select("u", F.col("p").alias("q"))
    nodes = parents.count()
    while True:
        up = labels.select(F.col("u").alias("q"), F.col("q").alias("r"))
        step = lookup_join(labels, up, "q", heavy_keys(labels, "q", nodes))
        nxt = ws.save(step.select("u", F.col("r").alias("q"), (F.col("q") != F.col("r")).alias("moved")))
        ws.drop(labels)
        if nxt.filter("moved").isEmpty():
            return nxt.select("u", "q")
        labels = nxt
