"""Weights of Steiner trees within twice the optimum, by minimum spanning trees of terminals' distances.

The least crossings between the terminals' cells hold a minimum spanning tree
of all their distances (Mehlhorn 1988), so one search from all terminals at
once replaces one search for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written
from .components import roots
from .graph import FULL_WEIGHT, Graph
from .traverse import frontier_links, nearest_source


#: Links a node among the light ones, about; the shares of all links that they are taken from.
LIGHT, SHARES = 3, [k / 32 for k in range(1, 17)]


def spanning_tree(links: DataFrame) -> DataFrame:
    """(a, b, dist): a minimum spanning forest of links, by Boruvka's rounds; equal lengths are ordered by the ends.

    Where a node has many links, the light ones go first, about LIGHT a node: their forest is part of the whole one's, as all others are longer. Of the
    others only those between its trees are left, which are few, so rounds work on a number of links that goes with the nodes.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist").filter("a < b"), "tree-links")
    r = links.agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("nodes"), F.percentile_approx("dist", SHARES).alias("most")).first()
    share = next((k for k, s in enumerate(SHARES) if s * r["n"] >= LIGHT * r["nodes"]), None)
    if share is None or r["most"] is None:
        return _forest(_live(links), False)[0]
    light = F.coalesce(F.col("dist") <= F.lit(r["most"][share]), F.lit(True))
    tree, trees = _forest(_live(links.filter(light)), True)
    if trees is None:
        return _forest(_live(links), False)[0]
    one, two = (trees.select(F.col("node").alias(c), F.col("root").alias(f"c{c}")) for c in ("a", "b"))
    rest = links.filter(~light).join(one, "a", "left").join(two, "b", "left").select("a", "b", "dist", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return tree.unionByName(_forest(written(rest.filter("ca <> cb"), "live"), False)[0])


def _live(links: DataFrame) -> DataFrame:
    return written(links.select("a", "b", "dist", F.col("a").alias("ca"), F.col("b").alias("cb")), "live")


def _forest(live: DataFrame, named: bool) -> tuple[DataFrame, DataFrame | None]:
    """(forest (a, b, dist); if named, its trees (node, root)) of links (a, b, dist) between trees (ca, cb).

    In a round each tree picks its least link, which makes a forest over the trees once the smaller of two that picked one link is a root;
    pointers double to the roots, and the live links are named by them. Links between the same two trees leave all but the least, so a round
    works on what is live alone, at most half as many trees as the one before.
    """
    least, trees = F.min(F.struct("dist", "a", "b")).alias("m"), None
    picks = [live.limit(0).select("a", "b", "dist")]
    while not live.isEmpty():
        ways = live.select("ca", "cb", "a", "b", "dist").unionByName(live.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "a", "b", "dist"))
        picked = written(ways.groupBy("ca").agg(F.min(F.struct("dist", "a", "b", "cb")).alias("m")).select("ca", "m.*"), "picked")
        picks.append(picked.select("a", "b", "dist"))
        mutual = picked.select(F.col("ca").alias("cb"), F.col("cb").alias("back"))
        up = picked.join(mutual, "cb", "left").select(F.col("ca").alias("node"), F.when((F.col("back") == F.col("ca")) & (F.col("ca") < F.col("cb")), F.col("ca")).otherwise(F.col("cb")).alias("up"))
        names = roots(up)
        if named:
            on = names.select(F.col("node").alias("root"), F.col("root").alias("over"))
            trees = names if trees is None else written(trees.join(on, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "trees")
        one, two = (names.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("ca", "cb"))
        between = live.join(one, "ca").join(two, "cb").filter("rca <> rcb").groupBy(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb")).agg(least)
        rest = written(between.select("m.a", "m.b", "m.dist", "ca", "cb"), "live")
        dropped(live)
        live = rest
    tree = picks[0]
    for p in picks[1:]:
        tree = tree.unionByName(p)
    return tree.distinct(), trees


def tree_weight(terminals: DataFrame, links: DataFrame) -> DataFrame:
    """One row: the spanning tree's weight as a double; 0 for less than two terminals, infinite if links don't connect them."""
    tree = spanning_tree(links).agg(F.count("*").alias("n"), F.sum(F.col("dist").cast("double")).alias("w"))
    many = terminals.agg(F.countDistinct("node").alias("terminals"))
    both = tree.crossJoin(F.broadcast(many))  # one row each
    return both.select(F.when(F.col("terminals") < 2, 0.0).when(F.col("n") < F.col("terminals") - 1, F.lit(float("inf"))).otherwise(F.col("w")).alias("tree_weight"))


def steiner_weight_of(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """Of terminals (node) along edges (src, dst, w), both ways."""
    cells = written(nearest_source(edges, terminals.select("node", F.col("node").alias("label")), mutual=True), "cells")
    return tree_weight(terminals, frontier_links(edges.filter("src < dst"), cells))


def steiner_weight(graph: Graph, terminals: DataFrame) -> DataFrame:
    return steiner_weight_of(written(graph.both_ways(FULL_WEIGHT), "edges"), terminals)


def both_ways(links: DataFrame) -> DataFrame:
    """Links (a, b, dist) of a reduced graph as edges (src, dst, w)."""
    e = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("dist").alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def reduced_steiner_weight(links: DataFrame, terminals: DataFrame) -> DataFrame:
    return steiner_weight_of(written(both_ways(links), "edges"), terminals)
