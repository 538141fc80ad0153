"""Sources, the selected buildings, and the road tree that joins selected clusters."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .contract import contract, sound
from .graph import FULL_WEIGHT, ROAD, Graph, building_node, connector_node
from .traverse import dealt, path_to_sources, released, shortest

log = logging.getLogger(__name__)


def named_sources(ids: DataFrame, graph: Graph) -> DataFrame:
    """(id, ord, node) of ids (id, ord): a building if there is one of that id, else a connector, else null. It takes the graph's nodes alone."""
    nodes = graph.nodes.select("node")
    b, c = nodes.withColumnRenamed("node", "bn"), nodes.withColumnRenamed("node", "cn")
    return ids.join(b, building_node("id") == F.col("bn"), "left").join(c, connector_node("id") == F.col("cn"), "left").select("id", "ord", F.coalesce("bn", "cn").alias("node"))


def resolved_sources(ids: DataFrame, graph: Graph, clusters: DataFrame, near: DataFrame) -> DataFrame:
    """(id, ord, node, cluster_id) of ids (id, ord): named_sources() with the node's own cluster, else the nearest one's. Nulls where there is none."""
    named = named_sources(ids, graph)
    own = clusters.select("node", F.col("cluster_id").alias("own"))
    nearest = near.select("node", F.col("cluster_id").alias("nearest"))
    return named.join(own, "node", "left").join(nearest, "node", "left").select("id", "ord", "node", F.coalesce("own", "nearest").alias("cluster_id"))


def source_clusters(resolved: DataFrame) -> list[int]:
    """The distinct clusters of resolved sources in order. Sources are named by the caller, so they are few."""
    rows = resolved.orderBy("ord").collect()
    if not any(r["node"] for r in rows):
        raise ValueError("no source id matches a building or a connector")
    unknown = [r["id"] for r in rows if r["node"] is None]
    if unknown:
        log.warning("%d source ids match nothing", len(unknown))
    out = list(dict.fromkeys(r["cluster_id"] for r in rows if r["cluster_id"] is not None))
    if not out:
        raise ValueError("no source belongs to a cluster")
    return out


def selected_buildings(clusters: DataFrame, selected: DataFrame) -> DataFrame:
    """(building_id, cluster_id) of the clusters in selected (cluster_id)."""
    return clusters.join(selected, "cluster_id", "left_semi").select("building_id", "cluster_id")


def hubs(clusters: DataFrame) -> DataFrame:
    """(cluster_id, hub): the smallest building node."""
    return clusters.groupBy("cluster_id").agg(F.min("node").alias("hub"))


def road_tree(graph: Graph, hub_nodes: Sequence[str]) -> DataFrame:
    """(segment_id): whole segments on the way from each hub, in order, to what is joined already.

    Hubs that can't be reached are left out; with fewer than two there is nothing to join.
    """
    spark = graph.edges.sparkSession
    none = spark.createDataFrame([], "segment_id string")
    order = list(dict.fromkeys(hub_nodes))
    if len(order) < 2:
        return none
    edges = written(graph.both_ways(FULL_WEIGHT), "edges")
    # contracted and dealt once for all hubs. A way through a chain has both its ends in the tree, so nodes within it needn't be sources
    kept = spark.createDataFrame([(h,) for h in order], "node string")
    parts = contract(sound(edges), kept)
    sources = written(parts.core.select(F.col("src").alias("node")).unionByName(kept).distinct(), "core")
    ways = dealt(parts.core)
    inside = kept.filter(F.col("node") == order[0])
    steps = []
    for hub in order[1:]:
        target = spark.createDataFrame([(hub,)], "node string")
        tree = shortest(edges, inside.join(sources, "node", "left_semi").select("node", F.lit(0).alias("label")), until=hub, over=parts, ways=ways)
        path = written(path_to_sources(tree, target), "path")
        inside = written(inside.unionByName(path.select("node")).distinct(), "inside")
        steps.append(path)
    released(ways)
    pairs = None
    for path in steps:
        a, b = path.select("target", "pos", F.col("node").alias("src")), path.select("target", (F.col("pos") - 1).alias("pos"), F.col("node").alias("dst"))
        step = a.join(b, ["target", "pos"]).select("src", "dst")
        pairs = step if pairs is None else pairs.unionByName(step)
    pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    # the cheapest edge of each step; of equals a road before an access, then the smallest segment
    roads = graph.edges.join(pairs, ["src", "dst"]).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("length_m", F.when(F.col("kind") == ROAD, 0).otherwise(1).alias("k"), "segment_id")).alias("e"))
    return roads.filter("e.k = 0").select("e.segment_id").distinct()
