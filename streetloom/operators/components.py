"""Connected components by alternating large and small stars, and the roots of forests by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def connected_components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable by links (a, b); nodes (node) adds nodes without links."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        after = written(_stars(edges), "links")
        dropped(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    if nodes is None:
        return found.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """Links (a, b), a < b: larger neighbours move to a node's least one, then so do the smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    small = large.groupBy("b").agg(F.min("a").alias("m"))
    ends = large.join(small, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return ends.filter("a < b").distinct()


def roots(up: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up), in which a root is its own: pointers double until none changes."""
    at = written(up.select("node", F.col("up").alias("root")), "roots")
    while True:
        over = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = written(at.join(over, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "roots")
        dropped(at)
        at = after.select("node", "root")
        if after.filter("moved").isEmpty():
            return at


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of links does."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 24).cast("decimal(38,0)")), F.bit_xor(h)).first())
