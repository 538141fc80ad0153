"""The steps of a run, as functions on DataFrames; the command line adds paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import centroid_xy, length_spheroid, point_wkb, reprojected, to_web_mercator
from ..operators.cluster import cluster_buildings, reduced_graph
from ..operators.graph import Graph, build_graph
from ..operators.nearest import first_link, link_lines, nearest_join
from ..operators.routing import hubs, resolved_sources, road_tree, selected_buildings, source_clusters
from ..operators.search import budgeted_search
from ..sources.files import road_segments
from ..sources.geoparquet import SRID, srid_of
from ..storage import written

#: Fixed values of a run: metres that chain buildings; metres a building, its tolerance, and rounds of the search.
CLUSTER_LIMIT, BUDGET, EPSILON, ITERATIONS = 100.0, 300.0, 1.5, 100


def points(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(id, x, y): the centroid of each feature."""
    return df.select("id", centroid_xy(F.col(geometry)).alias("p")).select("id", "p.x", "p.y")


def centroids(buildings: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(id, geometry): centroids as points."""
    return points(buildings, geometry).select("id", point_wkb(F.col("x"), F.col("y")).alias("geometry")).withMetadata("geometry", {SRID: srid_of(buildings, geometry)})


def building_links(buildings: DataFrame, connectors: DataFrame) -> DataFrame:
    """(building_id, connector_id, distance_m, geometry) from points (id, x, y) in degrees: nearest in web Mercator metres."""
    flat = lambda df: df.select("id", *(c.alias(n) for c, n in zip(to_web_mercator(F.col("x"), F.col("y")), ("x", "y"), strict=True)))
    return link_lines(first_link(nearest_join(flat(buildings), flat(connectors)))).withMetadata("geometry", {SRID: 3857})


def road_refs(segments: DataFrame, axis_order: str = "xy") -> DataFrame:
    """(road_id, connector_id, at, road_length_m, ord) from segments (id, geometry, connectors); geodesic lengths."""
    refs = segments.select(F.col("id").alias("road_id"), length_spheroid(F.col("geometry"), axis_order).alias("road_length_m"), F.posexplode("connectors").alias("ord", "c"))
    return refs.select("road_id", F.col("c.connector_id").alias("connector_id"), F.col("c.at").alias("at"), "road_length_m", "ord")


def graph_of(segments: DataFrame, connectors: DataFrame, buildings: DataFrame) -> Graph:
    """The graph straight from features; no files in between."""
    b, c = points(buildings), points(connectors)
    return build_graph(road_segments(road_refs(segments)), c, b, building_links(b, c).drop("geometry"))


@dataclass
class Outcome:
    clusters: DataFrame
    reduced_nodes: DataFrame
    reduced_edges: DataFrame
    solution: DataFrame
    buildings: DataFrame
    segments: DataFrame


def optimise(graph: Graph, source_ids: DataFrame, limit=CLUSTER_LIMIT, budget: float = BUDGET, epsilon: float = EPSILON, iterations: int = ITERATIONS) -> Outcome:
    """Cluster, coarsen, search from the sources (id, ord), and route."""
    clusters = written(cluster_buildings(graph, limit), "clusters")
    nodes, edges, near = reduced_graph(graph, clusters)
    nodes, edges = written(nodes, "reduced-nodes"), written(edges, "reduced-edges")
    sources = source_clusters(resolved_sources(source_ids, graph, clusters, near))
    solution = budgeted_search(nodes, edges, sources, budget, epsilon, iterations)
    selected = solution.first()["selected"]
    picked = graph.nodes.sparkSession.createDataFrame([(c,) for c in selected], "cluster_id long")
    return Outcome(clusters, nodes, edges, solution, selected_buildings(clusters, picked), road_tree(graph, hubs_in_order(clusters, selected)))


def hubs_in_order(clusters: DataFrame, selected: Sequence[int]) -> list[str]:
    spark = clusters.sparkSession
    order = spark.createDataFrame([(c, n) for n, c in enumerate(selected)], "cluster_id long, n long")
    return [r["hub"] for r in hubs(clusters).join(F.broadcast(order), "cluster_id").orderBy("n").collect()]


def with_clusters(buildings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Buildings with building_id and cluster_id, nulls where there is none."""
    return buildings.join(clusters.select("building_id", "cluster_id"), F.col("id") == F.col("building_id"), "left")


def with_selection(buildings: DataFrame, selected: DataFrame) -> DataFrame:
    return buildings.join(selected.select("building_id", "cluster_id"), F.col("id") == F.col("building_id"))


def tree_segments(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole segments of the tree; an id that is listed twice gives its segment twice, as an inner join does."""
    return segments.join(ids.select(F.col("segment_id").alias("id")), "id")


def reduced_points(nodes: DataFrame) -> DataFrame:
    """Reduced nodes with a point geometry of their centroids, in degrees."""
    return nodes.withColumn("geometry", point_wkb(F.col("centroid_x").cast("double"), F.col("centroid_y").cast("double"))).withMetadata("geometry", {SRID: 4326})


def reproject_points(df: DataFrame, target: int, geometry: str = "geometry") -> DataFrame:
    """Point geometries in another reference system; untouched if it is theirs already."""
    source = srid_of(df, geometry)
    if source == target:
        return df
    p = centroid_xy(F.col(geometry))
    x, y = reprojected(F.col("__p.x"), F.col("__p.y"), source, target)
    return df.withColumn("__p", p).withColumn(geometry, point_wkb(x, y)).drop("__p").withMetadata(geometry, {SRID: target})


def reproject_lines(geometry, source: int, target: int):
    """Line geometries in another reference system, through Arrow."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from ..functions.geo import MERCATOR_RADIUS, line_points, lines_wkb

    def flat(pts):
        if (source, target) == (4326, 3857):
            return np.column_stack([MERCATOR_RADIUS * np.radians(pts[:, 0]), MERCATOR_RADIUS * np.log(np.tan(np.pi / 4 + np.radians(pts[:, 1]) / 2))])
        if (source, target) == (3857, 4326):
            return np.column_stack([np.degrees(pts[:, 0] / MERCATOR_RADIUS), np.degrees(2 * np.arctan(np.exp(pts[:, 1] / MERCATOR_RADIUS)) - np.pi / 2)])
        raise ValueError(f"no transformation from {source} to {target}")

    @F.pandas_udf("binary")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([None if g is None else lines_wkb([flat(x) for x in line_points(bytes(g))]) for g in s], dtype=object)

    return run(geometry)
