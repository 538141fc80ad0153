"""Clusters of buildings, and the graph of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .components import connected_components
from .graph import BUILDING, FREE_ACCESS, FULL_WEIGHT, Graph
from .traverse import frontier_links, nearest_source, shortest


#: Buildings in one list of a cluster's members.
LISTED = 10_000


def cluster_buildings(graph: Graph, limit=100.0) -> DataFrame:
    """(node, building_id, cluster_id): buildings chained by road distances of limit or less; access costs nothing.

    One search from all buildings at once cuts the graph into cells. The least
    crossings between cells hold a minimum spanning tree of all building
    distances, so crossings of limit or less have the clusters as components.
    An edge longer than limit lies on no such crossing and is left out before anything moves.
    Cluster ids count from 0 by the smallest building node. A negative limit leaves every building alone.
    """
    buildings = graph.nodes.filter(F.col("kind") == BUILDING).select("node", "id")
    edges = written(graph.both_ways(FREE_ACCESS, limit), "edges")
    # beyond the limit from every building no crossing can count
    cells = shortest(edges, buildings.select("node", F.col("node").alias("label")), limit, pinned=True, parents=False)
    links = frontier_links(edges, cells).filter(F.col("dist") <= limit).select("a", "b")
    groups = connected_components(links, buildings)
    return _numbered(groups).join(buildings, "node").select("node", F.col("id").alias("building_id"), "cluster_id")


def _numbered(groups: DataFrame) -> DataFrame:
    """Component names as numbers from 0 in their order: ranges are numbered apart and then shifted, so no task sees them all."""
    names = groups.select("component").distinct()
    ranged = written(names.repartitionByRange("component").withColumn("part", F.spark_partition_id()), "names")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("part").orderBy("component")
    ids = ranged.withColumn("n", F.row_number().over(within)).join(F.broadcast(shift), "part").select("component", (F.col("shift") + F.col("n") - 1).cast("long").alias("cluster_id"))
    return groups.join(ids, "component").select("node", "cluster_id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("building_count"))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(cluster_id, part, members): each cluster's building ids in order of their nodes, in lists of LISTED at most, so that no list grows with the cluster."""
    ordered = written(clusters.repartitionByRange("cluster_id", "node").sortWithinPartitions("cluster_id", "node").select("cluster_id", "node", "building_id", F.monotonically_increasing_id().alias("row")), "members")
    lists = ordered.groupBy("cluster_id", F.expr(f"row div {LISTED}").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "building_id"))), lambda m: m["building_id"]).alias("members"))
    return lists.select("cluster_id", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("run")) - 1).alias("part"), "members")


def cluster_count(clusters: DataFrame) -> DataFrame:
    """The greatest id and one, which is 1 for no clusters."""
    return clusters.agg((F.coalesce(F.max("cluster_id"), F.lit(0)) + 1).cast("long").alias("cluster_count"))


def reduced_nodes(graph: Graph, clusters: DataFrame) -> DataFrame:
    """(cluster_id, size, centroid_x, centroid_y)."""
    placed = clusters.join(graph.nodes.select("node", "x", "y"), "node")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return placed.groupBy("cluster_id").agg(F.count("*").alias("size"), mean("x").alias("centroid_x"), mean("y").alias("centroid_y"))


def nearest_cluster(graph: Graph, clusters: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node, dist, cluster_id): the cluster whose building is nearest, access included; ties go to the smaller id. edges are graph's both ways, if they are there."""
    if edges is None:
        edges = written(graph.both_ways(FULL_WEIGHT), "edges")
    cells = nearest_source(edges, clusters.select("node", F.col("cluster_id").alias("label")), mutual=not graph.directed)
    return cells.withColumnRenamed("label", "cluster_id")


def reduced_graph(graph: Graph, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges (a, b, dist), nearest cluster of each node): edges are the least crossings between the clusters' cells."""
    edges = written(graph.both_ways(FULL_WEIGHT), "edges")
    near = written(nearest_cluster(graph, clusters, edges), "near")
    if not graph.directed:
        edges = edges.filter("src < dst")  # a crossing is as long from its other end
    edges = frontier_links(edges, near.withColumnRenamed("cluster_id", "label"))
    return reduced_nodes(graph, clusters), edges, near
